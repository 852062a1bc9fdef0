"""Both passes over a chain at once."""

import numpy as np
import pytest

from tidemark.operators import chain


@pytest.mark.parametrize(("k", "r", "t"), [(1, 3, 5), (2, 1, 0), (2, 1, 1), (2, 7, 150), (3, 5, 90), (2, 130, 40)])
def test_both_passes_are_those_of_one_direction_each(k, r, t):
    g = np.random.default_rng([k, r, t])
    first, steps = g.uniform(size=(k, r)), g.uniform(size=(k, k, r, t)) * 10.0 ** g.uniform(-8, 0, size=(k, k, r, t))
    alpha, log, beta = chain.both(first, steps)
    assert (alpha == chain.forward(first, steps)[0]).all() and (log == chain.forward(first, steps)[1]).all() and (beta == chain.backward(steps)).all()
    rows, told = chain._one_by_one(first, steps)
    assert np.allclose(alpha, rows, rtol=1e-10) and np.allclose(log, told, rtol=1e-10)
