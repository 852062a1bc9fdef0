"""The driver's contract."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_gives_rows_with_a_stable_schema(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["venue", "phase", "n", "share", "smallest", "largest"]


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_filters_and_columns_reach_the_scan(spark):
    from tidemark.plans import floors

    plan = floors.floor_counts(spark, DATA)._jdf.queryExecution().toString()
    scan = plan[plan.rindex("ReadSchema") :][:120]
    assert "event_type" in scan and "value" in scan and "user_id" not in scan and "props" not in scan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_model_queries_run(spark):
    from tidemark.plans import models

    for name in ("hmm_selection", "switching_best", "garch"):
        assert models.QUERIES[name][0](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_documents(spark):
    import json

    from tidemark.plans import documents

    d = json.loads(documents.floor_document(spark, DATA))
    assert set(d) == {"venues", "spans", "phases", "periods", "quantiles"}
    assert d["venues"]["click"]["at"] + d["venues"]["click"]["below"] + d["venues"]["click"]["above"] == d["venues"]["click"]["n"]
    d = json.loads(documents.gap_document(spark, DATA))
    assert set(d["split"]["1"]) == {"location", "averaging", "dispersion"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_documents_are_refreshed_block_by_block(spark, tmp_path, monkeypatch):
    import json

    from tidemark.plans import documents

    folder = f"file://{tmp_path}/history"
    assert documents.refresh(spark, DATA, folder, "history", ["order", "levels"]) == 1
    first = json.loads(documents.stored(spark, folder, "history"))
    assert set(first) == {"order", "levels"} and {"window", "M", "D"} <= set(first["levels"]["click_8h"])

    def lost(spark, d):
        raise RuntimeError("lost")

    parts = documents.DOCUMENTS["history"]
    monkeypatch.setitem(parts, "shift", (lost, parts["shift"][1]))
    with pytest.raises(RuntimeError, match="lost"):
        documents.refresh(spark, DATA, folder, "history", ["ranking", "shift"])
    assert json.loads(documents.stored(spark, folder, "history")) == first  # the earlier artifact is whole
    assert documents.refresh(spark, DATA, folder, "history", ["ranking"]) == 2
    both = json.loads(documents.stored(spark, folder, "history"))
    assert set(both) == {"order", "levels", "ranking"} and both["order"] == first["order"]
    assert json.loads(documents.stored(spark, folder, "history", 1)) == first
    with pytest.raises(ValueError, match="no blocks"):
        documents.refresh(spark, DATA, folder, "history", ["absent"])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_trees_of_documents_have_a_row_per_leaf(spark):
    from tidemark.plans import documents

    for name in ("floors", "history", "gap", "series"):
        for block, (query, keys) in documents.DOCUMENTS[name].items():
            rows = query(spark, DATA)
            assert rows.count() == rows.select(*keys).distinct().count(), (name, block)
