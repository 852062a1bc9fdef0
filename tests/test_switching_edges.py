"""A start whose curvature cannot be inverted ends its sharpening and keeps its row."""

import numpy as np

from tidemark.operators import switching as W


def test_a_singular_curvature_ends_the_newton_steps(monkeypatch):
    theta = np.array([0.9, 0.8, 0.1, -0.1, 0.3, 0.2, 1.0, 2.0])
    y = np.random.default_rng(1).normal(size=200)

    def singular(*_):
        raise np.linalg.LinAlgError("Singular matrix")

    monkeypatch.setattr(W, "derivatives", lambda *_: (np.ones((199, 8)), -np.eye(8)))
    monkeypatch.setattr(np.linalg, "solve", singular)
    assert (W.sharpened(theta, y) == theta).all()
