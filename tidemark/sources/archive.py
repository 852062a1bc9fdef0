"""Archive objects: day keys, and LZ4 frames of CSV text read by Spark's binary file source."""

from __future__ import annotations

import struct
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.files import CONTEXT_NAMES, NEEDED, typed_context

# fixed values of the LZ4 frame format and of xxHash32
MAGIC = 0x184D2204
PRIMES = (2654435761, 2246822519, 3266489917, 668265263, 374761393)


def xxh32(data: bytes, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(data, seed)


def block(data: bytes, out: bytearray) -> None:
    """Append a compressed block's content to ``out``; copies may reach back into what is there."""
    i, n = 0, len(data)

    def more(x, i):
        if x == 15:
            while True:
                b = data[i]
                i, x = i + 1, x + b
                if b != 255:
                    break
        return x, i

    while i < n:
        token = data[i]
        literals, i = more(token >> 4, i + 1)
        out += data[i : i + literals]
        i += literals
        if i >= n:
            break
        back = data[i] | data[i + 1] << 8
        size, i = more(token & 15, i + 2)
        start, size = len(out) - back, size + 4
        if back >= size:
            out += out[start : start + size]
        else:
            piece = bytes(out[start:])
            out += (piece * (size // back + 1))[:size]


def unframed(blob: bytes) -> bytes:
    """Content of an LZ4 frame with stored or compressed blocks; the header's checksum is checked."""
    if struct.unpack_from("<I", blob)[0] != MAGIC:
        raise ValueError("not an LZ4 frame")
    flags, at = blob[4], 6
    at += 8 * bool(flags & 8) + 4 * bool(flags & 1)
    if xxh32(blob[4:at]) >> 8 & 0xFF != blob[at]:
        raise ValueError("wrong header checksum")
    at, out = at + 1, bytearray()
    while size := struct.unpack_from("<I", blob, at)[0]:
        at, stored, size = at + 4, size & 0x80000000, size & 0x7FFFFFFF
        piece = blob[at : at + size]
        if stored:
            out += piece
        else:
            block(piece, out)
        at += size + 4 * bool(flags & 16)
    return bytes(out)


def framed(content: bytes, size: int = 1 << 16) -> bytes:
    """A frame of stored blocks, for tests and small files."""
    head = bytes([0x60, 0x40])
    out = struct.pack("<I", MAGIC) + head + bytes([xxh32(head) >> 8 & 0xFF])
    for i in range(0, len(content), size):
        piece = content[i : i + size]
        out += struct.pack("<I", len(piece) | 0x80000000) + piece
    return out + struct.pack("<I", 0)


def day_keys(spark: SparkSession, start: str, end: str, prefix: str = "asset_ctxs/", suffix: str = ".csv.lz4") -> DataFrame:
    """(day, key): one object per UTC day, both ends included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("day")).withColumn("key", F.concat(F.lit(prefix), F.date_format("day", "yyyyMMdd"), F.lit(suffix)))


def key_day(key: Column) -> Column:
    """The day in an object key, or null."""
    digits = F.regexp_extract(key, r"(\d{8})[^/]*$", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")).cast("date")


def sample_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """First days of the months inside a closed span of days."""
    first = F.trunc(F.date_add(F.lit(start).cast("date"), 31), "month")
    first = F.when(F.dayofmonth(F.lit(start).cast("date")) == 1, F.lit(start).cast("date")).otherwise(F.trunc(F.add_months(F.lit(start).cast("date"), 1), "month"))
    days = F.sequence(first, F.greatest(F.lit(end).cast("date"), first), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(days).alias("day")).where(F.col("day") <= F.lit(end).cast("date"))


def cost(objects: Column, total_bytes: Column, lists: Column, free_bytes: float = 100e9) -> Column:
    """Dollars for requests and for bytes beyond the free ones. Prices per 1,000 requests and per GB."""
    return objects * 0.0004 / 1000 + lists * 0.005 / 1000 + F.greatest(total_bytes - free_bytes, F.lit(0.0)) / 1e9 * 0.09


SPAN_BYTES = 8 << 20


def opened(uri: str):
    """A file opened for reading at any place, inside a task."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def frame_head(file) -> tuple[int, bool, int]:
    """(where the blocks begin, whether they are independent, bytes of each block's checksum) of an LZ4 frame."""
    head = bytes(file.read_at(19, 0))
    if len(head) < 7 or struct.unpack_from("<I", head)[0] != MAGIC:
        raise ValueError("not an LZ4 frame")
    flags, at = head[4], 6
    at += 8 * bool(flags & 8) + 4 * bool(flags & 1)
    if xxh32(head[4:at]) >> 8 & 0xFF != head[at]:
        raise ValueError("wrong header checksum")
    return at + 1, bool(flags & 0x20), 4 * bool(flags & 16)


def block_sizes(file):
    """(place of its header, size, stored) of each block; only the headers are read."""
    at, _, tail = frame_head(file)
    while size := struct.unpack("<I", bytes(file.read_at(4, at)))[0]:
        yield at, size & 0x7FFFFFFF, bool(size & 0x80000000)
        at += 4 + (size & 0x7FFFFFFF) + tail


def contents(file, first: int, independent: bool):
    """The content of each block from the one whose header is at ``first``; no more than a block and what it may look back at is held."""
    _, _, tail = frame_head(file)
    at, past = first, b""
    while size := struct.unpack("<I", bytes(file.read_at(4, at)))[0]:
        stored, size = bool(size & 0x80000000), size & 0x7FFFFFFF
        piece = bytes(file.read_at(size, at + 4))
        if stored:
            own = piece
        else:
            out = bytearray(b"" if independent else past)
            skip = len(out)
            block(piece, out)
            own = bytes(out[skip:])
        past = (past + own)[-65_536:]
        yield at, own
        at += 4 + size + tail


def lines_of(file, begin: int, until: int, independent: bool):
    """Lines that begin in the blocks from ``begin`` up to before ``until``; the last may end in later blocks.

    A span drops what comes before its first line feed, unless it begins the frame, and reads on to
    the end of the line that its last block ends in, or ends before.
    """
    start, _, _ = frame_head(file)
    held, wait = b"", begin != start
    for at, own in contents(file, begin, independent):
        if at >= until:
            if wait:  # no line begins in the span
                return
            end = own.find(b"\n")
            if end >= 0:
                yield held + own[:end]
                return
            held += own
            continue
        if wait:
            cut = own.find(b"\n")
            if cut < 0:
                continue
            own, wait = own[cut + 1 :], False
        *whole, held = (held + own).split(b"\n")
        yield from whole
    if held and not wait:
        yield held


def spans(objects: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(path, begin, until, independent): the blocks of each object in spans of about ``span_bytes``; an object whose blocks look back at each other is one span."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path in batch["path"]:
                with opened(path) as file:
                    begin, independent, _ = frame_head(file)
                    out, last = [], begin
                    for at, size, _ in block_sizes(file):
                        if independent and at + size - last > span_bytes and at > last:
                            out.append((path, last, at, independent))
                            last = at
                    out.append((path, last, 2**62, independent))
                yield pd.DataFrame(out, columns=["path", "begin", "until", "independent"])

    return objects.select("path").mapInPandas(run, "path string, begin long, until long, independent boolean")


def cells_of(path: str, begin: int, until: int, independent: bool, names: Mapping[str, tuple[str, ...]] = CONTEXT_NAMES, needed: tuple[str, ...] = NEEDED):
    """Rows of a span, under the canonical names by the header of the object itself."""
    import csv

    plain = lambda s: s.strip().lower().replace("_", "").replace(" ", "")
    with opened(path) as file:
        start, _, _ = frame_head(file)
        header = next(lines_of(file, start, start + 1, independent), b"").decode("utf-8")
        if not header.strip():
            return
        have = {plain(c): i for i, c in reversed(list(enumerate(next(csv.reader([header])))))}
        place = {k: next((have[a] for a in aliases if a in have), None) for k, aliases in names.items()}
        lacking = [k for k in needed if place[k] is None]
        if lacking:
            raise ValueError(f"{path}: columns missing: {', '.join(lacking)}")
        found = lines_of(file, begin, until, independent)
        if begin == start:
            next(found)
        for cells in (next(csv.reader([x.decode("utf-8")]), None) for x in found):
            if cells:
                yield [cells[i] if i is not None and i < len(cells) else None for i in place.values()]


def read_frames(spark: SparkSession, path: str, coin: str, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """Context rows of one coin from a folder of LZ4 frames of CSV text.

    The columns of an object are those of its own header, in any order; a missing needed one is an
    error that names the object. Objects are cut into spans of independent blocks, which are dealt to
    tasks; a task holds a block at a time, so an object may be larger than a task's memory. The
    folder's file system is one that Arrow reads too. A line feed ends a row, also within quotes; an
    object without a header has no rows.
    """
    objects = spark.read.format("binaryFile").option("pathGlobFilter", "*.lz4").load(path).select("path")  # names only
    dealt = spans(objects, span_bytes).repartition(F.col("path"), F.col("begin"))
    names = list(CONTEXT_NAMES)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for span in batch.itertuples(index=False):
                held = []
                for row in cells_of(*span):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                yield pd.DataFrame(held, columns=names)

    return typed_context(dealt.mapInPandas(run, ", ".join(f"{n} string" for n in names)), coin)
