"""One fit for one series."""

import os

import pytest

from tidemark.operators import switching as W
from tidemark.plans import models, reports

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_forest_fits_each_series_once(spark, monkeypatch):
    fit, calls = W.fit_switching, []
    monkeypatch.setattr(models, "SWITCHING_STARTS", 2)
    monkeypatch.setattr(W, "fit_switching", lambda *a, **k: calls.append(a[1]) or fit(*a, **k))
    rows = {(r.venue, r.label): r for r in reports.forest(spark, DATA).collect()}
    assert sorted(calls) == [["venue", "variant"], ["venue", "window"]]  # not the whole series once more
    whole = {v: r for (v, label), r in rows.items() if label == "whole"}
    assert whole and all(r[2:] == rows[v, "variant baseline"][2:] for v, r in whole.items())
