"""Similarity join of documents on word n-grams: MinHash banding, then exact verification.

Words are runs of characters other than ASCII white space; a text's set holds its windows of
``k`` words (all its words, where it has fewer). Two texts are linked if the Jaccard similarity
of their sets is at least ``threshold``.

1. Equal texts form one class from the start (by 128-bit digest); only one of them goes on.
2. Each different text gets ``bands`` hashes of ``rows`` minima each; :func:`band_plan` chooses both for the
   wanted recall. Texts that share a band hash are candidates. The shuffle on band hashes links
   each text to the smallest one of its bucket, so a bucket of any size gives a row per text.
3. Candidates that hang together are compared on their full sets, in blocks of at most about
   ``block`` texts: each task compares two blocks and returns, for each text, its number of links
   and one link of a spanning forest. No table of pairs is ever made. Blocks whose set sizes rule
   out the threshold are not compared.

Every link between candidates that hang together is found, so recall is that of the banding or
better. Comparing a group of n different but similar texts takes on the order of n*n / block**2
tasks of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.llm.kernels import tidied
from tidemark.llm.scratch import free_name, new_folder, written


def band_plan(threshold: float = 0.8, recall: float = 0.999, most_hashes: int = 400) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at ``threshold`` with probability ``recall``."""
    found = (1, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most_hashes:
            break
        found = bands, rows
    return found


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, copy_key, n_grams, bands): of every row its text's digest, number of different n-grams and band hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tidemark.llm import kernels as K

        times = K.multipliers(bands * rows, 11)
        within = K.multipliers(rows, 13)
        for batch in batches:
            sizes, flat = [], []
            for _, _, data, offsets in K.chunks(batch.column("text")):
                grams, at = K.shingles(*K.words(data, offsets), k)
                some = np.flatnonzero(np.diff(at))
                out = np.zeros((len(at) - 1, bands), np.uint64)
                if len(some):
                    for b in range(bands):
                        total = np.zeros(len(some), np.uint64)
                        for r in range(rows):
                            total += np.minimum.reduceat(grams * times[b * rows + r], at[some]) * within[r]
                        out[some, b] = K.mix(total + np.uint64(b + 1))
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                each = np.unique(grams + text.astype(np.uint64) * within[0], return_index=True)[1]
                sizes.append(np.bincount(text[each], minlength=len(at) - 1))  # different n-grams
                flat.append(out)
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            body = np.concatenate(flat) if flat else np.zeros((0, bands), np.uint64)
            keep = np.where(n > 0, bands, 0)  # a text without words has no bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(body[n > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy_key"), pa.array(n, pa.int64()), lists], ["doc_id", "copy_key", "n_grams", "bands"])

    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("copy_key"), text.alias("text"))
    return given.mapInArrow(tidied(run), "doc_id long, copy_key string, n_grams long, bands array<long>")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """Replace the text of each row by its sorted set of n-gram hashes."""
    fields = [f for f in rows.schema if f.name != "text"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tidemark.llm import kernels as K

        for batch in batches:
            out, ends = [], [0]
            for _, _, data, offsets in K.chunks(batch.column("text")):
                grams, at = K.shingles(*K.words(data, offsets), k)
                for i in range(len(at) - 1):
                    out.append(np.unique(grams[at[i] : at[i + 1]]))
                    ends.append(ends[-1] + len(out[-1]))
            grams = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), lists], [*(f.name for f in fields), "grams"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(tidied(run), f"{schema}, grams array<long>")


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """(copy_key, other, links) from rows (pair, side, copy_key, grams) sorted by pair within partitions.

    In a pair of a block with itself, side is 2 for all; else 0 and 1 tell the blocks apart.
    """

    def links_of(keys, sides, sets):
        import numpy as np

        n = len(keys)
        if n < 2:
            return
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        known, ids = np.unique(flat, return_inverse=True)
        at = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(known), np.int32)
        degree, parent = np.zeros(n, np.int64), np.arange(n)

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        two = sides[0] != 2
        first = np.flatnonzero(sides != 1)
        edges = []
        for i in first:
            lo = int(np.searchsorted(sides, 1)) if two else i + 1
            if lo >= n:
                continue
            own = ids[at[i] : at[i + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids[at[lo] :]], at[lo:-1] - at[lo])
            mark[own] = 0
            hits = lo + np.flatnonzero(both >= threshold * (sizes[i] + sizes[lo:] - both) - 1e-9)
            degree[i] += len(hits)
            degree[hits] += 1
            for j in hits:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((i, j))
        for i, j in edges:
            yield keys[i], keys[j], 0
        for i in np.flatnonzero(degree):
            yield keys[i], None, int(degree[i])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def done(group):
            keys, sides, sets, seen = [], [], [], set()
            for side, key, grams in sorted(group, key=lambda x: x[:2]):
                if key not in seen:  # a row of the input that stands there twice
                    seen.add(key)
                    keys.append(key)
                    sides.append(side)
                    sets.append(grams)
            return list(links_of(keys, np.array(sides), sets))

        def batch_of(found):
            a, b, c = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], ["copy_key", "other", "links"])

        now, group = None, []
        for batch in batches:
            found = []
            pairs, sides, keys = (batch.column(c).to_pylist() for c in ("pair", "side", "copy_key"))
            grams = batch.column("grams")
            at = grams.offsets.to_numpy()
            values = grams.values.to_numpy()
            for i, pair in enumerate(pairs):
                if pair != now:
                    found += done(group)
                    now, group = pair, []
                group.append((sides[i], keys[i], values[at[i] : at[i + 1]].copy()))
            yield batch_of(found)
        yield batch_of(done(group))

    return rows.mapInArrow(tidied(run), "copy_key string, other string, links long")


def _classes(docs: DataFrame, k: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy_key) of every row, and of every different text (copy_key, rep, n_copies, n_links, root): rep is its smallest doc_id, root the text that its class is named by."""
    spark = docs.sparkSession
    folder = new_folder(spark, "minhash")
    bands, rows = band_plan(threshold, recall)
    docs = docs.select("doc_id", "text")
    sig = written(signatures(docs, k, bands, rows), folder, "signatures")
    # one row per different text goes on; copies are counted before they move
    texts = written(sig.groupBy("copy_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), folder, "texts")
    node = F.xxhash64("copy_key")  # of candidates only: a clash costs a comparison
    banded = texts.select(node.alias("node"), F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last").select("band", "hub")
    near = banded.join(hubs, "band").where("node != hub").select("node", "hub").distinct()
    hang = written(components(near, f"{folder}/candidates"), folder, "hang")

    # blocks: by candidate group and class of set size, then by digest
    step = -math.log(threshold)
    members = texts.drop("bands").where("n_grams > 0").withColumn("node", F.xxhash64("copy_key")).join(hang, "node")
    members = members.select("copy_key", "rep", F.col("root").alias("hang"), F.floor(F.log("n_grams") / step + 1e-9).cast("int").alias("size_class"))
    members = written(members, folder, "members")
    counts = members.groupBy("hang", "size_class").count().groupBy("hang").agg(F.map_from_entries(F.collect_list(F.struct("size_class", F.ceil(F.col("count") / block).cast("int")))).alias("blocks"))
    own = F.pmod(F.xxhash64("copy_key", F.lit(1)), F.element_at("blocks", F.col("size_class"))).cast("int")
    dealt = members.join(counts, "hang").withColumn("b", own)

    def with_class(c):
        others = F.transform(F.sequence(F.lit(0), F.coalesce(F.element_at("blocks", c), F.lit(0)) - 1), lambda x: F.struct(c.alias("c"), x.cast("int").alias("b")))
        return F.when(F.coalesce(F.element_at("blocks", c), F.lit(0)) > 0, others).otherwise(F.array().cast("array<struct<c:int,b:int>>"))

    me = F.struct(F.col("size_class").alias("c"), F.col("b").alias("b"))
    others = F.explode(F.concat(*(with_class(F.col("size_class") + d) for d in (-1, 0, 1))))
    dealt = dealt.select("copy_key", "rep", "hang", me.alias("me"), others.alias("it")).select(
        "copy_key", "rep",
        F.xxhash64("hang", F.least("me", "it"), F.greatest("me", "it")).alias("pair"),
        F.when(F.col("me") == F.col("it"), 2).otherwise((F.col("me") > F.col("it")).cast("int")).alias("side"),
    )
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("copy_key", F.md5("text"))
    wanted = members.select(F.col("copy_key").alias("m_key"), F.col("rep").alias("m_rep")).hint("merge")  # the same plan at every size
    chosen = chosen.join(wanted, F.col("doc_id").eqNullSafe(F.col("m_rep")) & (F.col("copy_key") == F.col("m_key")))
    sets = _sets(chosen.select("copy_key", "text"), k)
    rows_ = dealt.join(sets, "copy_key").select("pair", "side", "copy_key", "grams").repartition("pair").sortWithinPartitions("pair")
    found = written(_compared(rows_, threshold), folder, "links")

    groups = components(found.where("other is not null").select("copy_key", "other"), f"{folder}/classes")
    links = found.groupBy("copy_key").agg(F.sum("links").alias("n_links"))
    grouped = texts.drop("bands").join(groups.withColumnRenamed("node", "copy_key"), "copy_key", "left").join(links, "copy_key", "left")
    return sig.select("doc_id", "copy_key"), grouped.select("copy_key", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "copy_key").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 128) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``class_id`` is the smallest doc_id among the documents that hang together by equal texts or
    links; ``n_links`` the number of other, different texts linked to the document's text;
    ``n_copies`` the number of rows with its very text. A null text counts as empty. Texts without
    a word are linked only to equal texts. Texts may have any length. A row that stands twice is
    returned twice. A null doc_id is kept and is the smallest only if it is the only one. An empty
    table gives an empty table.
    """
    rows, texts = _classes(docs, k, threshold, recall, block)
    names = texts.groupBy("root").agg(F.min("rep").alias("class_id"))
    labelled = texts.join(names, "root").select("copy_key", "class_id", "n_links", "n_copies")
    return rows.join(labelled, "copy_key").select("doc_id", "class_id", "n_links", "n_copies")


def _row_key(doc_id, copy_key):
    """Of a document: its doc_id and text in 128 bits."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.lit(":"), copy_key))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 128) -> DataFrame:
    """One row of ``docs`` (doc_id, text, any other columns) per class of :func:`near_duplicates`, all columns.

    The row with the smallest doc_id stays (one with a null doc_id only where no other is), of
    several texts under it the one with the smallest digest, and of rows equal in doc_id and text
    one of them. So rows are told apart by doc_id and text together: other rows of the same doc_id
    stay if they are the first of classes of their own. Columns may have any names; a null text counts
    as empty, texts may have any length, and an empty table gives an empty table.
    """
    key = free_name(docs, "row_key")
    _, texts = _classes(docs, k, threshold, recall, block)
    first = F.min(F.struct(F.col("rep").isNull(), "rep", "copy_key")).alias("f")
    kept = texts.groupBy("root").agg(first).select(_row_key(F.col("f.rep"), F.col("f.copy_key")).alias(key))
    # equal rows become one within tasks, then by a shuffle that the join uses too
    one = docs.withColumn(key, _row_key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))).dropDuplicates([key])
    return one.join(kept.hint("merge"), key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
