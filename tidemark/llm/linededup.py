"""Removal of repeated passages by winnowing over the hashes of lines or of words.

The text is a row of units: its lines with a word, or its words. Repeated passages stand inside
lines as often as they fill lines, so words find what lines miss, and passages of whole lines all
the same; lines are the cheaper unit where repeats are whole lines.

Every stretch of ``gram`` units has a hash; of every ``run - gram + 1`` consecutive hashes the
smallest one (the last of equal ones) is the fingerprint of the window of ``run`` units that they
fill. Equal windows have equal fingerprints, so a window whose fingerprint stands once stands once.

Consecutive windows with the same fingerprint place make a block: the fingerprint, extended both
ways. Blocks of a fingerprint are grouped by a hash of all their units: every block but the first of
its group is a repeat as a whole. Where a fingerprint has several different blocks (a phrase in
other surroundings, an end of a passage, a near copy), the first block of each group is cut into its
windows, and every window but the first of its kind is a repeat. So each window is held against all
places of its fingerprint, in joins with one row per block or window, however many documents share a
passage. What is repeated is then cut out of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.kernels import tidied
from tidemark.llm.scratch import free_name, new_folder, written

EMPTY = "array<struct<first:int,last:int>>"


def fingerprints(hashes, offsets, gram: int, run: int):
    """(text, place in the text, number of windows, fingerprint, hash of the words) of the blocks of texts of word hashes."""
    import numpy as np

    from tidemark.llm import kernels as K

    n, wide = len(hashes), run - gram + 1
    none = np.zeros(0, np.int64)
    if n < run:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams, whole = K.rolling(hashes, gram), K.rolling(hashes, run)
    m = len(grams)
    # index of the smallest hash of each window, by windows of doubling width; the later of equals
    best, width = np.arange(m), 1
    while width < wide:
        step = min(width, wide - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] <= grams[left], right, left)
        width += step
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = np.flatnonzero(text[: n - run + 1] == text[run - 1 :])
    if not len(windows):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    picked = best[windows]
    first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    size, begin = np.diff(np.append(first, len(windows))), windows[first]
    of = text[begin]
    # the first and the last window of a block overlap or touch: together they are all its words
    blocks = K.mix(whole[begin] * np.uint64(K.OTHER_SEED) + whole[begin + size - 1] + size.astype(np.uint64))
    return of, begin - offsets[of], size, grams[picked[first]], blocks


def units(data, offsets, unit: str):
    """Starts and ends of the lines or words of texts, and each text's offsets among them."""
    import numpy as np

    from tidemark.llm import kernels as K

    starts, ends = K.lines(data, offsets) if unit == "line" else K.spans(~K.SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def hashes_of(data, offsets, unit: str):
    from tidemark.llm import kernels as K

    starts, ends, at = units(data, offsets, unit)
    return K.span_hashes(data, starts, ends), at


def marks(docs: DataFrame, gram: int, run: int, unit: str) -> DataFrame:
    """(doc_id, tag, n_units, at, size, mark, block): per row its blocks; tag is the text's checksum."""
    kinds = {"at": "int32", "size": "int32", "mark": "int64", "block": "int64"}

    def task(batches):
        import numpy as np
        import pyarrow as pa

        from tidemark.llm import kernels as K

        for batch in batches:
            parts, sizes, counts = {k: [np.zeros(0, v)] for k, v in kinds.items()}, [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in K.chunks(batch.column("text")):
                hashes, at = hashes_of(data, offsets, unit)
                of, place, size, found, blocks = fingerprints(hashes, at, gram, run)
                for k, v in (("at", place.astype(np.int32)), ("size", size.astype(np.int32)), ("mark", found.view(np.int64)), ("block", blocks.view(np.int64))):
                    parts[k].append(v)
                sizes.append(np.bincount(of, minlength=len(at) - 1))
                counts.append(np.diff(at))
            ends = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v))) for v in parts.values()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(np.concatenate(counts), pa.int64()), *lists], ["doc_id", "tag", "n_units", *kinds])

    return _keyed(docs).mapInArrow(tidied(task), "doc_id long, tag long, n_units long, at array<int>, size array<int>, mark array<long>, block array<long>")


def hashed(docs: DataFrame, unit: str) -> DataFrame:
    """(doc_id, tag, units): per row its units' hashes in 32 bits."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        from tidemark.llm import kernels as K

        for batch in batches:
            flat, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for _, _, data, offsets in K.chunks(batch.column("text")):
                hashes, at = hashes_of(data, offsets, unit)
                flat.append((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))
                sizes.append(np.diff(at))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), lists], ["doc_id", "tag", "units"])

    return _keyed(docs).mapInArrow(tidied(task), "doc_id long, tag long, units array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("tag"), text.alias("text"))


def _windows(rows: DataFrame, run: int) -> DataFrame:
    """(doc_id, tag, at, window): the windows of the blocks ``open`` (at, size) of rows of doc_id, tag and units, with a hash of their units."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        from tidemark.llm import kernels as K

        for batch in batches:
            column, blocks = batch.column("units"), batch.column("open")
            at, data = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
            of = blocks.offsets.to_numpy().astype(np.int64)
            begin, size = (blocks.values.field(c).to_numpy() for c in ("at", "size"))
            for i, j in K.runs(at, K.CHUNK // 4):
                whole = K.rolling(data[at[i] : at[j]].view(np.uint32).astype(np.uint64), run)
                part = slice(of[i], of[j])
                row = np.repeat(np.repeat(np.arange(i, j), np.diff(of[i : j + 1])), size[part])
                inside = np.arange(len(row)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                place = np.repeat(begin[part], size[part]) + inside
                lie = place + at[row] - at[i]
                window = whole[lie].view(np.int64)
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(index), batch.column("tag").take(index), pa.array(place.astype(np.int32)), pa.array(window)], ["doc_id", "tag", "at", "window"])

    return rows.mapInArrow(tidied(task), "doc_id long, tag long, at int, window long")


def _merged(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, removed): the ordered ranges ``all`` (first, last) of each row, those that overlap or touch made one."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column("all")
            at = column.offsets.to_numpy()
            first, last = (column.values.field(c).to_numpy() for c in ("first", "last"))
            firsts, lasts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
            for i in range(batch.num_rows):
                a, b = first[at[i] : at[i + 1]], np.maximum.accumulate(last[at[i] : at[i + 1]])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                firsts.append(a[new])
                lasts.append(b[np.append(new[1:] - 1, len(b) - 1)])
                sizes.append(len(new))
            ranges = pa.StructArray.from_arrays([pa.array(np.concatenate(firsts)), pa.array(np.concatenate(lasts))], ["first", "last"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), ranges)], ["doc_id", "tag", "removed"])

    return rows.mapInArrow(tidied(task), f"doc_id long, tag long, removed {EMPTY}")


def _runs(docs: DataFrame, table: DataFrame, run: int, unit: str, folder: str) -> DataFrame:
    """(doc_id, tag, removed) of the documents with units to delete, from the table of blocks."""
    each = table.select("doc_id", "tag", F.explode(F.arrays_zip("at", "size", "mark", "block")).alias("m")).select("doc_id", "tag", "m.*")
    where = F.struct(F.col("doc_id").alias("d"), F.col("tag").alias("t"), F.col("at").alias("a"))
    # sums are written before they are joined, so that Spark can split a frequent key; joins are by merging, the same plan at every size
    often = written(each.groupBy("mark").agg(F.count("*").alias("_n")).where("_n > 1").select("mark"), folder, "often")
    met = written(each.join(often.hint("merge"), "mark"), folder, "blocks")
    groups = written(met.groupBy("mark", "block").agg(F.min(where).alias("first"), F.count("*").alias("n"), F.max("size").alias("size")), folder, "groups")
    copied = groups.where("n > 1").select("mark", "block", "first")
    whole = met.join(copied.hint("merge"), ["mark", "block"]).where(where != F.col("first")).select("doc_id", "tag", F.col("at").alias("first"), (F.col("at") + F.col("size") + (run - 1)).alias("last"))
    # fingerprints with several different blocks: the first of each, window by window
    several = written(groups.groupBy("mark").agg(F.count("*").alias("_n")).where("_n > 1").select("mark"), folder, "several")
    opened = groups.join(several.hint("merge"), "mark").groupBy(F.col("first.d").alias("o_doc"), F.col("first.t").alias("o_tag")).agg(F.collect_list(F.struct(F.col("first.a").alias("at"), "size")).alias("open"))
    held = hashed(docs, unit).join(opened.hint("merge"), F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("tag") == F.col("o_tag"))).select("doc_id", "tag", "units", "open")
    windows = written(_windows(held, run), folder, "windows")
    # a window's hash says all of its units, its fingerprint among them
    earliest = written(windows.groupBy("window").agg(F.min(where).alias("first"), F.count("*").alias("_n")).where("_n > 1").select("window", "first"), folder, "earliest")
    single = windows.join(earliest.hint("merge"), "window").where(where != F.col("first")).select("doc_id", "tag", F.col("at").alias("first"), (F.col("at") + run).alias("last"))
    step = F.struct(F.col("first").alias("first"), F.col("last").alias("last"))
    return written(_merged(whole.unionByName(single).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set(step)).alias("all"))), folder, "removed")


def repeated_runs(docs: DataFrame, run: int = 50, gram: int = 8, unit: str = "word") -> DataFrame:
    """(doc_id, tag, n_units, n_removed, removed) for every row; removed: array of struct(first, last) of units, merged, last exclusive.

    ``unit`` is word or line. ``tag`` is the checksum of the text. Of equal runs the one in the
    smallest (doc_id, tag, place) stays; a document that repeats itself keeps the first part. Rows
    that stand twice with the same doc_id and text are one document to each other, so neither is cut
    for the other. A null doc_id sorts first; a null or empty text has no units. Texts may have any
    length. What goes is every unit in a stretch of ``run`` units that stands earlier.
    """
    folder = new_folder(docs.sparkSession, "linededup")
    docs = docs.select("doc_id", "text")
    table = written(marks(docs, gram, run, unit), folder, "marks")
    runs = _runs(docs, table, run, unit, folder).select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), "removed")
    rows = table.select("doc_id", "tag", "n_units").join(runs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")), "left")
    gone = F.aggregate("removed", F.lit(0), lambda n, x: n + x["last"] - x["first"])
    return rows.select("doc_id", "tag", "n_units", F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast(EMPTY)).alias("removed"))


def drop_repeated(docs: DataFrame, run: int = 50, gram: int = 8, unit: str = "word") -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` freed of repeated runs, plus n_units, n_removed and removed.

    ``removed`` lists struct(first, last) ranges of the old text's units, last exclusive; it is empty
    for a document without repeats, whose text is unchanged. A run goes with the white space after
    it; a line feed stays between what was on different lines. A null text stays null; it and an
    empty one have no units. Columns of ``docs`` named like the new ones are replaced, others may have any names; for the rest
    see :func:`repeated_runs`.
    """
    folder = new_folder(docs.sparkSession, "linededup")
    given = docs.drop("n_units", "n_removed", "removed")
    doc, tag, cut = (free_name(given, name) for name in ("run_doc", "run_tag", "run_cut"))
    table = written(marks(docs.select("doc_id", "text"), gram, run, unit), folder, "marks")
    runs = _runs(docs.select("doc_id", "text"), table, run, unit, folder).select(F.col("doc_id").alias(doc), F.col("tag").alias(tag), F.col("removed").alias(cut))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) == F.col(tag))
    joined = given.join(runs.hint("merge"), same, "left").select(*(F.col(f"`{c}`") for c in given.columns), F.coalesce(cut, F.array().cast(EMPTY)).alias("removed"))
    fields, names = given.schema, given.columns

    def task(batches):
        import numpy as np
        import pyarrow as pa

        from tidemark.llm import kernels as K

        for batch in batches:
            column, removed = batch.column("text"), batch.column("removed")
            at_removed = removed.offsets.to_numpy() - removed.offsets[0].as_py()
            cuts, texts, counts, gone = removed.flatten(), [], [np.zeros(0, np.int64)], np.zeros(batch.num_rows, np.int64)
            lo, hi = cuts.field("first").to_numpy(), cuts.field("last").to_numpy()
            missing = column.is_null().to_numpy(zero_copy_only=False)
            for i, j, data, offsets in K.chunks(column):
                starts, _, at = units(data, offsets, unit)
                counts.append(np.diff(at))
                for t in range(i, j):
                    a, b = int(offsets[t - i]), int(offsets[t - i + 1])
                    if at_removed[t] == at_removed[t + 1]:
                        texts.append(None if missing[t] else data[a:b].tobytes())
                        continue
                    edge, out, done = np.append(starts[at[t - i] : at[t - i + 1]], b), bytearray(), a
                    for first, last in zip(lo[at_removed[t] : at_removed[t + 1]], hi[at_removed[t] : at_removed[t + 1]], strict=True):
                        out += data[done : edge[first]].tobytes()
                        done = int(edge[last])
                        gone[t] += last - first
                        if out and out[-1] != 10 and done < b and 10 in data[edge[first] : done]:
                            out[:] = out.rstrip(b" \t") + b"\n"
                    out += data[done:b].tobytes()
                    texts.append(bytes(out))
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(text if f.name == "text" else batch.column(f.name) for f in fields), pa.array(np.concatenate(counts)), pa.array(gone), removed], [*names, "n_units", "n_removed", "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return joined.mapInArrow(tidied(task), f"{schema}, n_units long, n_removed long, removed {EMPTY}")
