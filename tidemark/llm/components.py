"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.scratch import written


def _nearest(edges: DataFrame) -> DataFrame:
    """For every node its smallest neighbour, itself included."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (two columns, any orderable type).

    ``root`` is the smallest node of the component. Each round lets every node hand its larger
    neighbours, then its smaller ones, to its smallest neighbour; the number of edges never grows
    and the rounds needed grow with the logarithm of the component's size. Every round is written
    to ``folder``. Self loops and null ends are left out; repeated edges do no harm; an empty table
    gives an empty table.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).where("u is not null and v is not null and u != v").distinct()
    now, mark = written(now, folder, "edges-0"), None
    for k in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that Spark can split the rows of a node with very many neighbours in the join
        near = written(_nearest(both), folder, f"nearest-{k}")
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _nearest(large)
        star = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.withColumnRenamed("m", "v"))
        now = written(star.where("u != v").distinct(), folder, f"edges-{k}")
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if mark == tuple(row):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(row)
    raise RuntimeError(f"components: not stable after {most_rounds} rounds")
