"""Token-id files of independent zstandard frames with a seek table.

Layout of a file: the token ids of its documents, little-endian unsigned 32-bit, cut into frames of
``frame_tokens`` ids, each compressed by itself; then one skippable frame with the seek table of
the public seekable zstandard format: per frame its compressed size, its size, and the low 32 bits
of the XXH64 of its content, then the number of frames and a magic number. A reader of a document
reads the table at the end and then only the frames that hold the document.

The index (a table) has a row per document: file, place of its first id in the file, number of
ids. Files are written by the tasks of a range-partitioned, sorted table, so file after file holds
ascending doc_ids. Each attempt of a task writes files of its own name and the index names only
those of the attempts that counted, so a lost executor costs a rerun and nothing else.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.scratch import new_folder, open_folder, small_batches, written

# fixed values of the seekable zstandard format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80


def _checksum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), WITH_CHECKSUMS, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class FrameWriter:
    """Writes ids into one file; ``place`` is the number of ids so far."""

    def __init__(self, sink, frame_tokens: int, level: int = 3):
        import zstandard

        self.sink, self.size, self.packer = sink, 4 * frame_tokens, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.held, self.place = bytearray(), 0

    def add(self, ids: bytes) -> None:
        self.held += ids
        self.place += len(ids) // 4
        whole = len(self.held) // self.size * self.size
        for at in range(0, whole, self.size):
            self._frame(bytes(self.held[at : at + self.size]))
        del self.held[:whole]

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), _checksum(raw)))

    def close(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
        self.sink.write(seek_table(self.frames))
        self.sink.close()


class FrameReader:
    """Reads ranges of ids from one file, a frame at a time; keeps the last frame."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        end = file.size()
        n, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a token file: no seek table at its end")
        table = np.frombuffer(file.read_at(12 * n, end - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.places = np.concatenate([[0], np.cumsum(table[:, 1] // 4)])
        self.sums, self.at, self.raw, self.frames_read = table[:, 2], -1, b"", 0

    def _frame(self, k: int) -> bytes:
        if k != self.at:
            raw = self.unpacker.decompress(self.file.read_at(int(self.packed[k + 1] - self.packed[k]), int(self.packed[k])))
            if _checksum(raw) != self.sums[k]:
                raise ValueError(f"frame {k}: wrong checksum")
            self.at, self.raw, self.frames_read = k, raw, self.frames_read + 1
        return self.raw

    def ids(self, place: int, n: int) -> bytes:
        """Ids place .. place + n - 1 as bytes."""
        out, k = [], int(np.searchsorted(self.places, place, "right")) - 1
        while n > 0:
            raw, skip = self._frame(k), place - int(self.places[k])
            part = raw[4 * skip : 4 * (skip + n)]
            if not part:
                raise ValueError("range over the end of the file")
            out.append(part)
            place, n, k = place + len(part) // 4, n - len(part) // 4, k + 1
        return b"".join(out)


class WordEncoder:
    """Encodes whole texts with the tokenizers library, remembering the ids of words.

    A byte-level tokenizer always splits a text before a single space between two other characters,
    so the words between such spaces have the ids that they have alone, each with its space. A text
    with other white space at a word's border, or with a special token's string, is encoded whole.

    Words are known by two independent hashes of 64 and 32 bits of their bytes, so only new ones become
    strings; these are encoded many at a time, a line each, and the ids of a line feed part them.
    The memory starts anew after ``most`` words.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tool, self.most = Tokenizer.from_file(path), most
        self.splits = self._splits_at_spaces(path)
        feed = self.tool.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64)
        self.tables = [(none, none.astype(np.uint32), none.astype(np.int32), none.astype(np.int32))] * 2  # sorted keys, checks, places, lengths; the second table is recent
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0

    @staticmethod
    def _splits_at_spaces(path: str) -> bool:
        import json

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        pre = d.get("pre_tokenizer") or {}
        return d.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray):
        """Groups (words, lengths, ids one after the other) of new words; length -1 for one that cannot be encoded alone."""
        # words with white space or a special string inside, or a rare lead byte near an end, are looked at one by one
        risky = ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
        risky[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        count = np.concatenate([[0], np.cumsum(risky)])
        lead = np.isin(data, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8))
        slow = (count[ends] > count[starts]) | lead[starts] | lead[np.maximum(ends - 2, starts)] | lead[np.maximum(ends - 3, starts)]
        if self.feed is None:
            slow[:] = True
        odd = lambda w: w[0].isspace() or w[-1].isspace() or "<|" in w
        held, alone = np.flatnonzero(slow), []
        for i in held:
            w = data[starts[i] : ends[i]].tobytes().decode("utf-8")
            alone.append(None if odd(w) else w if heads[i] else " " + w)
        never = held[[w is None for w in alone]] if len(held) else held
        yield never, np.full(len(never), -1, np.int64), np.zeros(0, "<u4")
        some = held[[w is not None for w in alone]] if len(held) else held
        got = self._whole([w for w in alone if w is not None])
        yield some, np.array([len(x) for x in got], np.int64), np.concatenate([np.zeros(0, "<u4"), *got])
        plain = np.flatnonzero(~slow)
        for k in range(0, len(plain), 512):
            part = plain[k : k + 512]
            # a line per word: (space) word, line feed
            size = ends[part] - starts[part]
            lead_in = (~heads[part]).astype(np.int64)
            line = np.cumsum(size + lead_in + 1)
            put = line - 1 - size
            buffer = np.full(int(line[-1]), 32, np.uint8)
            where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            buffer[np.repeat(put, size) + where] = data[np.repeat(starts[part], size) + where]
            buffer[line - 1] = 10
            ids = self._whole([buffer[:-1].tobytes().decode("utf-8")])[0]
            cut = np.concatenate([[-1], np.flatnonzero(ids == self.feed), [len(ids)]])
            yield part, np.diff(cut) - 1, ids[ids != self.feed]

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of each word's ids: length -1 for one that cannot be encoded alone, place -1 for an unknown one."""
        place, length = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for have, check, places, lengths in self.tables:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = (have[at] == keys) & (check[at] == checks)
                place[hit], length[hit] = places[at[hit]], lengths[at[hit]]
        return place, length

    def _add(self, keys: np.ndarray, checks: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        place = self.used + np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        new = (keys, checks, place.astype(np.int32), length.astype(np.int32))
        self.used += len(ids)
        recent = [np.concatenate(x) for x in zip(self.tables[1], new, strict=True)]
        order = np.argsort(recent[0], kind="stable")
        recent = tuple(x[order] for x in recent)
        if len(recent[0]) > 100_000:
            main = [np.concatenate(x) for x in zip(self.tables[0], recent, strict=True)]
            order = np.argsort(main[0], kind="stable")
            self.tables = [tuple(x[order] for x in main), tuple(x[:0] for x in recent)]
        else:
            self.tables[1] = recent

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids per text) for texts as bytes and offsets."""
        from tidemark.llm import kernels as K

        n = len(offsets) - 1
        text = lambda a, b: data[a:b].tobytes().decode("utf-8")
        if not self.splits:
            whole = self._whole([text(a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.concatenate([np.zeros(0, "<u4"), *whole]), np.array([len(x) for x in whole], np.int64)
        if len(self.tables[0][0]) > self.most:
            self._forget()
        blank = data == 32
        starts, ends = K.spans(~blank, offsets)
        at = np.searchsorted(starts, offsets)
        heads = np.zeros(len(starts), bool)
        heads[at[:-1][np.diff(at) > 0]] = True  # the first word of each text has no space before it
        mark = np.where(heads, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        keys = K.span_hashes(data, starts, ends) ^ mark
        checks = (K.span_hashes(data, starts, ends, K.OTHER_SEED) >> np.uint64(32)).astype(np.uint32)
        first, back = np.unique(keys, return_index=True, return_inverse=True)[1:]
        u_keys, u_checks = keys[first], checks[first]
        place, length = self._find(u_keys, u_checks)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = first[unknown]
            for of, sizes, own in self._learned(data, starts[new], ends[new], heads[new]):
                self._add(u_keys[unknown[of]], u_checks[unknown[of]], sizes, own)
            place, length = self._find(u_keys, u_checks)
        place, length = place[back], length[back]
        # texts that have to be encoded whole: blanks beside blanks or at an end, odd words, and hashes of two words that meet
        bad = np.zeros(n, bool)
        gaps = np.diff(offsets) - np.add.reduceat(np.append(ends - starts, 0), np.minimum(at[:-1], len(starts))) * (np.diff(at) > 0)
        bad |= gaps != np.maximum(np.diff(at) - 1, 0)
        edge = np.flatnonzero(np.diff(offsets) > 0)
        bad[edge] |= blank[offsets[edge]] | blank[offsets[edge + 1] - 1]
        wrong = np.flatnonzero((length < 0) | (place < 0) | (checks != u_checks[back]))
        bad[np.searchsorted(at, wrong, "right") - 1] = True
        length = np.maximum(length, 0)
        counts = np.add.reduceat(np.append(length, 0), np.minimum(at[:-1], len(length))) * (np.diff(at) > 0)
        # ids of all words, one after the other
        total = int(length.sum())
        begin = np.cumsum(length) - length
        ids = self.pool[np.arange(total) + np.repeat(place - begin, length)]
        if bad.any():
            cut = np.concatenate([[0], np.cumsum(counts)])
            which = np.flatnonzero(bad)
            parts = [ids[cut[i] : cut[i + 1]] for i in range(n)]
            for i, own in zip(which, self._whole([text(offsets[i], offsets[i + 1]) for i in which]), strict=True):
                parts[i] = own
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per process and tokenizer file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, frame_tokens: int = 1 << 16, file_tokens: int = 1 << 28) -> DataFrame:
    """Write the ids of all texts of ``docs`` (doc_id, text) in ascending doc_id order; the index of what was written.

    Index: part, file, doc_id, place, n_tokens, in which (part, file, place) is the order of the
    documents; file names within a part ascend. Rows of equal doc_id follow each other by the
    text's hash and the text. Null texts count as empty: they hold the end id alone; a null doc_id
    sorts first. ``tokenizer`` is a path that every executor can open.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from tidemark.llm import kernels as K

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        attempt, count, out, name = uuid.uuid4().hex[:12], 0, None, ""
        for batch in batches:
            names, places, sizes = [], [], []
            for _, _, data, offsets in K.chunks(batch.column("text")):
                tokens, counts = encode(data, offsets)
                tokens = np.insert(tokens, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
                if out is None or out.place >= file_tokens:
                    if out is not None:
                        out.close()
                    name, count = f"tokens-{part:06d}-{count:05d}-{attempt}.bin.zst", count + 1
                    out = FrameWriter(files.open_output_stream(f"{path}/{name}", compression=None), frame_tokens)
                names += [name] * len(counts)
                places.append(out.place + np.cumsum(counts + 1) - counts - 1)
                sizes.append(counts + 1)
                out.add(tokens.tobytes())
            places, sizes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, sizes))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.string()), batch.column("doc_id"), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], ["part", "file", "doc_id", "place", "n_tokens"])
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    from tidemark.llm.kernels import tidied

    with small_batches(docs.sparkSession):
        return written(rows.mapInArrow(tidied(run), "part int, file string, doc_id long, place long, n_tokens long"), folder, "index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """The index rows given (all or some) with ``ids``: their ids as little-endian unsigned 32-bit bytes."""
    fields = [f for f in index.schema]

    def run(batches):
        import pyarrow as pa

        files, path = open_folder(folder)
        name, reader = None, None
        for batch in batches:
            out, size, done = [], 0, 0
            for i, (file, place, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "place", "n_tokens")), strict=True), 1):
                if file != name:
                    name, reader = file, FrameReader(files.open_input_file(f"{path}/{file}"))
                out.append(reader.ids(place, n))
                size += len(out[-1])
                if size > 1 << 22 or i == batch.num_rows:  # hand on a few MB at a time
                    yield pa.RecordBatch.from_arrays([*batch.slice(done, i - done).columns, pa.array(out, pa.binary())], [*batch.schema.names, "ids"])
                    out, size, done = [], 0, i

    cut = F.floor(F.col("place") / (1 << 20))  # tasks smaller than files
    rows = index.repartition("file", cut).sortWithinPartitions("file", "place")
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids binary")


def with_starts(index: DataFrame) -> DataFrame:
    """The index plus ``start``: the ids of all documents before. One row per file goes through the running total."""
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("part", "file")) - F.col("n")).alias("before"))
    return index.join(before, "file").withColumn("start", F.col("before") + F.col("place")).drop("before")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` as token files, read all of them back: doc_id, start, n_tokens, ids_crc32, file, place."""
    folder = new_folder(docs.sparkSession, "tokens")
    index = write_tokens(docs, folder, tokenizer, end_id)
    read = read_tokens(with_starts(index), folder)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"), "file", "place")
