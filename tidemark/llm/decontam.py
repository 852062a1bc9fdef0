"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask over a span of tokens; the masked-out positions do not enter its hash, so a
substituted token there does not hide a match. The hashes of all benchmark windows are joined with
those of all document windows. Around each hit, document and item are laid side by side and the
window of ``overlap`` tokens with the most equal tokens is taken: the pair counts if that share
reaches ``share``. Items shorter than ``overlap`` are compared whole.

The two masks together hit every window of 13 tokens with up to two substitutions (tested by
enumeration). An item shorter than ``overlap`` has seeds of its own: its tokens are cut into one
part more than substitutions are allowed, so that one part stays whole; every part is a seed, at
its place in the item, and documents are searched for parts of those lengths.

Where the seeds of the benchmark are few they are broadcast, and windows never leave their task. Else
a window is a row of three numbers: a broadcast of the seeds' remainders, of bounded size, drops
windows that cannot match, the rest is joined by a shuffle, and only texts with a hit are laid beside
items. Places of a text or an item that look alike (a token over and over) are one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.scratch import free_name, new_folder, written

MASKS = ("11101011", "110100111")
#: Items of fewer tokens than this are too short to tell anything and are left out: one word in common is no leak.
LEAST = 5
#: Remainders of seeds that windows are tried against before a shuffle: at most so many rows are broadcast, however large the benchmark.
REMAINDERS = 1 << 22


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; a null text has none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(mask: str, tokens: str, at: Column) -> Column:
    """Hash of the masked tokens of the window that starts at ``at`` (from 0)."""
    return F.xxhash64(F.lit(len(mask)), *(F.get(F.col(tokens), at + i) for i, c in enumerate(mask) if c == "1"))


def _windows(table: DataFrame, key: str, tokens: str, masks: tuple[str, ...]) -> DataFrame:
    """Every window of every mask: the table's columns, at, seed."""
    shortest = min(map(len, masks))
    starts = F.when(F.size(tokens) >= shortest, F.sequence(F.lit(0), F.size(tokens) - shortest)).otherwise(F.array().cast("array<int>"))
    at = table.select(key, tokens, F.explode(starts).alias("at"))
    seeds = F.array(*(F.when(F.col("at") + len(m) <= F.size(tokens), _seed(m, tokens, F.col("at"))) for m in masks))
    return at.select(key, tokens, "at", F.explode(seeds).alias("seed")).where("seed is not null")


def short_parts(n: int, share: float) -> list[tuple[int, int]]:
    """(start, length) of the parts of an item of ``n`` tokens, one of which stays whole in every match that reaches ``share``."""
    parts = n - math.ceil(n * share - 1e-9) + 1
    parts = min(n, parts)
    edges = [n * i // parts for i in range(parts + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def _best(overlap: Column) -> Column:
    """Most equal tokens in a window of ``overlap`` tokens of the array ``same`` (0 or 1 per token), and where it starts."""
    starts = F.sequence(F.lit(0), F.size("same") - overlap)
    scored = F.transform(starts, lambda i: F.struct(F.aggregate(F.slice("same", i + 1, overlap), F.lit(0), lambda a, x: a + x).alias("equal"), (-i).alias("back")))
    return F.array_max(scored)


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, share: float = 0.8, masks: tuple[str, ...] = MASKS, broadcast_bytes: int = 1 << 25, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_equal, n_compared, doc_token, item_token): the best overlap of every document with every item it holds.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text); other columns are ignored. Seeds of the
    benchmark, each with the stretch of its item that a comparison needs, are broadcast if all of
    them together have up to ``broadcast_bytes``; beyond, Spark joins them by a shuffle, with the same
    result. Items of fewer
    tokens than ``overlap`` match where that share of all their tokens is equal; those of fewer than
    ``least`` match nothing (with a lower ``least``, an item of one to four tokens matches itself alone). Texts that are
    null, empty or without letters and digits match nothing; texts may have any length. Documents
    that stand twice under one doc_id give one row; a null doc_id or item_id is kept. An empty table
    on either side gives an empty table.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _found(given, "doc_id", benchmark, overlap, share, masks, broadcast_bytes, least)


def _hits(given: DataFrame, key: str, seeds: DataFrame, masks: tuple[str, ...], small: bool) -> DataFrame:
    """The windows of ``given`` (``key``, text) whose seed an item has: key, tokens, at and the columns of ``seeds``."""
    tokens = token_hashes(F.col("text")).alias("tokens")
    if small:
        return _windows(given.select(key, tokens), key, "tokens", masks).join(F.broadcast(seeds), "seed")
    # texts of one hash are each compared with what any of them may hold; copies ask once
    text_hash = F.xxhash64("text").alias("text_hash")
    remainder = F.pmod(F.col("seed"), F.lit(REMAINDERS)).alias("remainder")
    known = seeds.select(remainder).distinct()
    windows = _windows(given.select(text_hash, tokens), "text_hash", "tokens", masks).select("text_hash", "at", "seed", remainder)
    asked = windows.join(F.broadcast(known), "remainder", "left_semi").select("text_hash", "at", "seed").distinct()
    met = asked.join(seeds.hint("merge"), "seed")
    # tokens once per text, before the join, not once per hit
    return met.join(given.select(key, text_hash, tokens), "text_hash").select(key, "tokens", "at", *seeds.columns)


def _found(given: DataFrame, key: str, benchmark: DataFrame, overlap: int, share: float, masks: tuple[str, ...], broadcast_bytes: int, least: int) -> DataFrame:
    """As :func:`contaminated`, for rows (``key``, text)."""
    folder = new_folder(given.sparkSession, "decontam")
    reach, after = overlap - 1, overlap + max(map(len, masks))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("item"))
    lead = F.least("at", F.lit(reach))
    long = _windows(items.where(F.size("item") >= overlap), "item_id", "item", masks)
    parts = {n: short_parts(n, share) for n in range(least, overlap)}
    lengths = sorted({r.n for r in items.where(F.size("item").between(least, overlap - 1)).select(F.size("item").alias("n")).distinct().collect()})
    plain = tuple("1" * k for k in sorted({k for n in lengths for _, k in parts[n]}))
    at_length = F.lit(None).cast("array<struct<at:int,seed:bigint>>")
    for n in lengths:
        own = F.array(*(F.struct(F.lit(a).cast("int").alias("at"), _seed("1" * k, "item", F.lit(a)).alias("seed")) for a, k in parts[n]))
        at_length = F.when(F.size("item") == n, own).otherwise(at_length)
    short = items.where(F.size("item").between(least, overlap - 1)).select("item_id", "item", F.inline(at_length)).select("item_id", "item", "at", "seed")
    seeds = long.unionByName(short).select("seed", "item_id", F.col("at").alias("item_at"), lead.alias("lead"), F.size("item").alias("n_item"), F.slice("item", F.col("at") - lead + 1, lead + after).alias("item"))
    # of places with the same stretch around them the first: the others give the same overlaps, later in the item
    seeds = seeds.groupBy("seed", "item_id", "lead", "n_item", "item").agg(F.min("item_at").alias("item_at"))
    seeds = written(seeds, folder, "seeds")
    small = seeds.count() * (8 * (reach + after) + 64) <= broadcast_bytes
    hits = _hits(given, key, seeds, (*masks, *plain), small)
    back = F.least("at", "lead")
    # of places of a text and an item that look alike the first, before anything is compared; its two starts in one number
    alike = hits.select(
        key, "item_id", "n_item",
        F.slice("tokens", F.col("at") - back + 1, back + after).alias("mine"),
        F.slice("item", F.col("lead") - back + 1, back + after).alias("theirs"),
        (F.shiftleft((F.col("at") - back).cast("long"), 32) + (F.col("item_at") - back)).alias("starts"),
    ).groupBy(key, "item_id", "n_item", "mine", "theirs").agg(F.min("starts").alias("starts"))
    # written, so that the comparison below stays out of the join, which then runs as compiled code over all windows
    side = written(alike, folder, "hits")
    side = side.withColumns({"doc_from": F.shiftright("starts", 32).cast("int"), "item_from": F.col("starts").bitwiseAND((1 << 32) - 1).cast("int")})
    n = F.least(F.size("mine"), F.size("theirs"))
    side = side.withColumn("same", F.zip_with(F.slice("mine", F.lit(1), n), F.slice("theirs", F.lit(1), n), lambda a, b: (a == b).cast("int")))
    wide = F.least("n_item", F.lit(overlap))
    scored = side.where(F.size("same") >= wide).withColumn("wide", wide).withColumn("best", _best(F.col("wide")))
    good = scored.where(F.col("best.equal") >= F.ceil(F.col("wide") * share - 1e-9))
    place = F.struct(F.col("best.equal").alias("n_equal"), F.col("wide").alias("n_compared"), (-(F.col("doc_from") - F.col("best.back"))).alias("d"), (-(F.col("item_from") - F.col("best.back"))).alias("i"))
    top = good.groupBy(key, "item_id").agg(F.max(place).alias("p"))
    return top.select(key, "item_id", F.col("p.n_equal").cast("long").alias("n_equal"), F.col("p.n_compared").cast("long").alias("n_compared"), (-F.col("p.d")).cast("long").alias("doc_token"), (-F.col("p.i")).cast("long").alias("item_token"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, share: float = 0.8, masks: tuple[str, ...] = MASKS, broadcast_bytes: int = 1 << 25, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item; all columns, whatever their names.

    What else stands under a doc_id, null or not, plays no part. A null or empty text holds no item;
    texts may have any length; rows that stand twice stay or go together; an empty table gives an
    empty table.
    """
    key = free_name(docs, "text_key")
    digest = F.md5(F.coalesce("text", F.lit("")))
    given = docs.select(digest.alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    bad = _found(given, "text_key", benchmark, overlap, share, masks, broadcast_bytes, least).select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, digest).join(bad, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
