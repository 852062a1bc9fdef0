"""Stores of result tables: versions, blocks, and results kept by content."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import store as T

SCHEMA = "k string, t int, v double"


def series(change=None):
    rows = [(k, t, float(t % 7) if k == "a" else None if t == 3 else -1.5) for k in ("a", "b", None) for t in range(40)]
    return [(k, t, 99.0 if (k, t) == change else v) for k, t, v in rows]


def test_fingerprints_tell_contents_not_orders(spark):
    of = lambda rows, n=4: {r.k: r.fingerprint for r in T.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(n), ["k"], ["t", "v"]).collect()}
    rows = series()
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    assert of(rows) == of(mixed, 7)
    changed, whole = of(series(("a", 5))), of(rows)
    assert changed["a"] != whole["a"] and {k: v for k, v in changed.items() if k != "a"} == {k: v for k, v in whole.items() if k != "a"}
    assert of(rows + [rows[0]])["a"] != whole["a"] and of(rows + [rows[0]] * 2)["a"] != of(rows + [rows[0]])["a"]
    swapped = [("a", 0, 1.0), ("a", 1, 0.0)], [("a", 0, 0.0), ("a", 1, 1.0)]
    assert of(swapped[0]) != of(swapped[1])
    assert of([("a", None, 1.0)]) != of([("a", 1, None)])
    assert of([]) == {}


def test_only_new_contents_are_computed(spark, tmp_path):
    store, seen = T.Store(spark, f"file://{tmp_path}/fits"), []

    def compute(rows):
        seen.append({r.k for r in rows.select("k").distinct().collect()})
        return rows.where("v is not null").groupBy("k").agg(F.sum("v").alias("total"))

    def run(rows, **settings):
        got, n = T.kept(store, "sums", spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "v"], {"version": 1, **settings}, compute)
        return {r.k: r.total for r in got.collect()}, n

    rows = series()
    want = {k: sum(v for kk, _, v in rows if kk == k and v is not None) for k in ("a", "b", None)}
    assert run(rows) == (want, 3) and run(rows[::-1]) == (want, 0) and store.version() == 1
    other = series(("b", 9))
    assert run(other) == ({**want, "b": want["b"] + 100.5}, 1)
    assert run(rows) == (want, 0)  # the earlier content is still known
    assert run(rows, tol=1e-6)[1] == 3
    assert seen == [{"a", "b", None}, {"b"}, {"a", "b", None}]
    assert run([("c", 1, None)]) == ({}, 1) and run([("c", 1, None)]) == ({}, 0)  # no result is a result
    assert run([("a", 1, 2.0)]) == ({"a": 2.0}, 1)


def test_a_failed_run_leaves_the_version_before_it(spark, tmp_path):
    store = T.Store(spark, f"file://{tmp_path}/artifact")
    assert store.version() == 0 and store.blocks() == {}
    table = lambda n: spark.range(n).withColumn("x", F.lit(n))
    assert store.publish({"paper": table(3), "later": table(4)}) == 1
    broken = table(5).withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.publish({"later": table(9), "power": broken})
    assert store.version() == 1 and store.read("later").count() == 4
    assert store.publish({"later": table(9)}, drop=("absent",)) == 2
    assert (store.read("paper").count(), store.read("later").count(), store.read("later", 1).count()) == (3, 9, 4)
    with pytest.raises(KeyError):
        store.read("power")
    assert store.publish({}, drop=("paper",)) == 3 and set(store.blocks()) == {"later"}


def test_two_runs_do_not_publish_one_version(spark, tmp_path):
    one, two = (T.Store(spark, f"file://{tmp_path}/shared") for _ in range(2))
    one.publish({"a": spark.range(1)})
    base = two.version()
    one.publish({"b": spark.range(2)})
    with pytest.raises(RuntimeError, match="another run"):
        two._place(base + 1, "{}")
    assert set(two.blocks()) == {"a", "b"}
