"""Mixing sources to target weights.

The words of each source's documents, in a fixed order, are packed into blocks of ``block`` words
(the last one may be shorter). Each source has a quota of slots that makes up its target. Output
shards draw how many of their slots each source fills from a multinomial over what is left of the
quotas: first groups of shards, then, in a task per group, the shards of each. A source's slots k = 0, 1, 2, ... are mapped through a pseudorandom permutation of its
block numbers (k modulo the number of blocks, so a block comes round again only after all others
have), and slots meet the blocks by a join on (source, block).

Positions come from a two-level running total: within hash buckets of a source, and over its
buckets. So the largest source is as well spread as the small ones.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.scratch import free_name, new_folder, written

ROUNDS = 16  # of the permutation
LEAST_BUCKETS = 64  # of a source, for the running total
CHUNK = 10_000  # slots dealt at a time: a source's share of a shard is cut into such pieces


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, most_times: float = 2.0) -> np.ndarray:
    """Share ``total`` by weight; no one gets over ``most_times`` its size, and what is over goes to the rest by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    cap, out, open_ = most_times * sizes, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = min(total, cap.sum())
    while open_.any():
        share = np.where(open_, weights, 0) / weights[open_].sum() * left
        over = open_ & (share > cap)
        if not over.any():
            return np.where(open_, share, out)
        out[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    return out


def shard_counts(quotas: np.ndarray, slots: int, seed) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): multinomial draws from what is left of the quotas, for shards of ``slots`` slots one after the other."""
    rng, left, shard, out = np.random.default_rng(seed), quotas.astype(np.int64).copy(), 0, []
    while left.sum():
        want = min(slots, int(left.sum()))
        drawn = np.zeros_like(left)
        while want:
            rest = left - drawn
            more = np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
            drawn += more
            want -= int(more.sum())
        out += [(shard, int(s), int(quotas[s] - left[s]), int(drawn[s])) for s in np.flatnonzero(drawn)]
        left -= drawn
        shard += 1
    return out


def dealt(spark, quotas: np.ndarray, slots: int, seed: int, driver_counts: int = 1 << 18) -> DataFrame:
    """(shard, source_no, first, n): :func:`shard_counts` in two steps, groups of shards on the driver and shards in tasks.

    A group has as many shards as there are groups, more where the driver would draw over
    ``driver_counts`` numbers (groups times sources); the rest is drawn in the groups' tasks, so only
    who draws depends on the size.
    """
    shards = -(-int(quotas.sum()) // slots)
    per_group = max(1, math.ceil(math.sqrt(shards)), -(-shards * max(int((quotas > 0).sum()), 1) // driver_counts))
    groups: dict[int, tuple[list, list, list]] = {}
    for g, s, first, n in shard_counts(quotas, slots * per_group, seed):
        for values, v in zip(groups.setdefault(g, ([], [], [])), (s, first, n), strict=True):
            values.append(v)
    rows = spark.createDataFrame([(g, *x) for g, x in groups.items()], "grp int, sources array<int>, firsts array<long>, quotas array<long>").repartition(max(len(groups), 1), "grp")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for g, sources, firsts, own in batch.itertuples(index=False):
                for shard, rows in itertools.groupby(shard_counts(np.asarray(own), slots, [seed, g]), lambda r: r[0]):
                    yield pd.DataFrame([(g * per_group + shard, int(sources[s]), int(firsts[s]) + first, n) for _, s, first, n in rows], columns=["shard", "source_no", "first", "n"])

    return rows.mapInPandas(run, "shard int, source_no int, first long, n long")


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 that depends on ``key``: in each round x and its mirror image around a keyed centre swap or stay."""

    def step(at: Column, r: Column) -> Column:
        image = F.pmod(F.pmod(F.xxhash64(key, r), n) + n - at, n)
        return F.when(F.xxhash64(key, r, F.greatest(at, image)) % 2 == 0, image).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), step)


@dataclass
class Mix:
    """What a mix decides. ``documents``: doc_id, text_key, source, size, source_size, target, taken, pieces
    (array of from_word, to_word, times); ``slots``: shard, source_no, slot, block; ``sources``: the plan per source."""

    documents: DataFrame
    slots: DataFrame
    sources: DataFrame


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_times: float = 2.0, block: int = 128, shard_slots: int = 1 << 16, seed: int = 7, most_sources: int = 100_000, bucket_rows: int = 50_000) -> Mix:
    """Decide how often each word of ``docs`` (doc_id, text, source) is taken.

    Sources in code point order, null last, have ``weights``, repeating; together they take
    ``share`` times all words. Fails for over ``most_sources`` sources. A null text has no words.
    Rows that stand twice are two documents. A null doc_id comes first in its bucket. Texts may have
    any length. An empty table, or one without words, takes nothing. The running total of a source
    goes through buckets of some ``bucket_rows`` rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "mixing")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = written(sized, folder, "sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).limit(most_sources + 1).collect()  # a row per source
    if len(rows) > most_sources:
        raise ValueError(f"over {most_sources} sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    sizes = np.array([r.n for r in rows], dtype=np.int64)
    aim = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sizes.sum(), most_times) if len(rows) else np.zeros(0)
    blocks = -(-sizes // block)
    # a source that is taken in full as often as it may has all its blocks that often; else slots of nearly `block` words each
    quota = np.where(blocks > 0, np.minimum(np.rint(aim / np.maximum(sizes / np.maximum(blocks, 1), 1)), np.floor(most_times) * blocks), 0).astype(np.int64)
    plan = [(i, r.source, int(sizes[i]), float(aim[i]), int(blocks[i]), int(quota[i]), max(LEAST_BUCKETS, -(-r.docs // bucket_rows))) for i, r in enumerate(rows)]
    sources = spark.createDataFrame(plan, "source_no int, source string, source_size long, target double, blocks long, quota long, buckets long")
    few = F.broadcast(sources)  # at most most_sources rows

    # slots of the shards, through the permutation, to blocks
    pieces = dealt(spark, quota, shard_slots, seed).select("shard", "source_no", "first", (F.col("first") + F.col("n")).alias("stop"))
    pieces = pieces.select("shard", "source_no", "stop", F.explode(F.sequence("first", F.col("stop") - 1, F.lit(CHUNK))).alias("from"))
    pieces = pieces.repartition(max(1, -(-int(quota.sum()) // (16 * CHUNK))), "source_no", "from")  # by number, so that small rows of many slots are not put together
    each = F.sequence("from", F.least(F.col("from") + CHUNK, "stop") - 1)
    slots = pieces.join(few.select("source_no", "blocks"), "source_no").select("shard", "source_no", "blocks", F.explode(each).alias("slot"))
    slots = slots.select("shard", "source_no", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "source_no")).alias("block"))
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))

    # where each document's words lie
    numbered = sized.join(few.select("source_no", F.col("source").alias("_s"), "source_size", "target", "buckets"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    numbered = numbered.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("buckets")).cast("int")).drop("buckets")
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    heads = numbered.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select("source_no", "bucket", (F.sum("n").over(over) - F.col("n")).alias("head"))
    placed = numbered.withColumn("upto", F.sum("size").over(inside)).withColumn("row", F.row_number().over(inside)).join(heads, ["source_no", "bucket"])
    placed = written(placed.withColumn("start", F.col("head") + F.col("upto") - F.col("size")).drop("upto", "head"), folder, "places")

    spans = placed.where("size > 0").select("source_no", "bucket", "row", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    spans = spans.withColumns({"from_word": F.greatest(F.col("block") * block - F.col("start"), F.lit(0)), "to_word": F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))})
    met = spans.join(times, ["source_no", "block"])
    piece = F.struct("from_word", "to_word", "times")
    taken = met.groupBy("source_no", "bucket", "row").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    out = placed.join(taken, ["source_no", "bucket", "row"], "left").select("doc_id", "text_key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "pieces")
    return Mix(out, slots, sources)


def taken_texts(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The words the mix takes as documents with the columns of ``docs``.

    A document comes once with the words taken once or more and again with those taken twice or
    more, and so on; words that are not taken are cut out, and a text taken whole is unchanged. Of
    rows equal in doc_id, text and source, each of which the mix treats by itself, one gives the
    other columns. ``n_chars``, where it is a column, is the length of the new text. Columns may have any
    names. A null or empty text has no words and is not taken; texts may have any length; an empty
    table gives an empty table.
    """
    columns, fields = docs.columns, docs.schema
    row, size, pieces_, round_ = (free_name(docs, name) for name in ("row_key", "row_size", "row_pieces", "row_round"))

    def key(doc_id, text_key, source):
        null = lambda c: F.coalesce(c, F.lit("-"))
        return F.md5(F.concat(null(doc_id.cast("string")), F.lit(":"), text_key, F.when(source.isNull(), "-").otherwise(F.concat(F.lit(":"), source))))

    plan = mixed.documents.where("taken > 0").select(key(F.col("doc_id"), F.col("text_key"), F.col("source")).alias(row), F.col("size").alias(size), F.col("pieces").alias(pieces_))
    # equal rows become one within tasks, then by a shuffle that the join uses too; each of their plans meets that one
    one = docs.withColumn(row, key(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))), F.col("source").cast("string"))).dropDuplicates([row])
    most = F.array_max(F.col(f"`{pieces_}`.times")).cast("int")
    rounds = one.join(plan.hint("merge"), row).select(*(F.col(f"`{c}`") for c in columns), size, pieces_, F.explode(F.sequence(F.lit(1), most)).alias(round_))

    def run(batches):
        import pyarrow as pa

        from tidemark.llm import kernels as K

        for batch in batches:
            texts, sizes, rounds_ = batch.column("text"), batch.column(size).to_pylist(), batch.column(round_).to_pylist()
            pieces, out = batch.column(pieces_).to_pylist(), []
            for i, j, data, offsets in K.chunks(texts):
                starts, _ = K.spans(~K.SPACE[data], offsets)
                at = np.searchsorted(starts, offsets)
                for t in range(i, j):
                    a, b = int(offsets[t - i]), int(offsets[t - i + 1])
                    own = [p for p in pieces[t] if p["times"] >= rounds_[t]]
                    if sum(p["to_word"] - p["from_word"] for p in own) == sizes[t]:
                        out.append(data[a:b].tobytes())
                        continue
                    edge = np.append(starts[at[t - i] : at[t - i + 1]], b)
                    out.append(b"".join(data[edge[p["from_word"]] : edge[p["to_word"]]].tobytes() for p in own))
            text = pa.array([x.decode("utf-8") for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([text if f.name == "text" else batch.column(f.name) for f in fields], columns)

    taken = rounds.mapInArrow(run, fields)
    return taken.withColumn("n_chars", F.length("text").cast(fields["n_chars"].dataType)) if "n_chars" in columns else taken
