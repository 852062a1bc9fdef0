"""Interpolated modified Kneser-Ney model of order n: counted in Spark, stored as sorted hash arrays, memory-mapped for scoring.

Tokens are the words of a text with A-Z lower-cased, then one end token; before each text stand
``order - 1`` start marks. Training makes, in a folder that all executors reach:

- ``words-<shard>``, ``times-<shard>``, ``ranks-<shard>``: the sorted 64-bit hashes of the training
  tokens, their counts, and their places by falling count. Place and shard make a token's id, so
  frequent tokens have small ids, which pack well.
- for each length m of n-grams and each shard (the top bits of an n-gram's 64-bit key): ``edges``,
  where each of 2**14 buckets (the next bits) begins; ``rest``, the next 32 bits of the keys, in
  order; and, alongside, ``small``, a byte or half a byte for each value, with those too large for
  it in ``over``. Values:
  ``count`` (how often the n-gram stands for m = order, else the number of different tokens before
  it; for one that begins with a start mark, which nothing precedes, how often it stands) and, for
  it as a context, ``total`` (the counts of what follows it) and ``ones``, ``twos``, ``more`` (how
  many different tokens follow it once, twice, and more often).

p(w | v) = max(c(vw) - D(c), 0) / total(v) + (D1 ones + D2 twos + D3 more) / total(v) * p(w | v without
its first token); discounts of each length come from the numbers of n-grams with counts of one to
four; single tokens are interpolated with a uniform share for all tokens and one unseen. A context
that training has not seen leaves everything to the lower order.

Counting is one chain of shuffles, one per length. What moves is blobs: the n-grams of one shard
that a task has summed, as packed columns. Summed before they move, spread by their own hash, a
frequent n-gram or context burdens no task, and a task holds one shard. ``per_shard`` is the number
of tokens per shard: raise it with the corpus, so that shards stay fewer than files should be.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.kernels import tidied
from tidemark.llm.scratch import new_folder, open_folder

END = 0x27220A0F5C1DDE11  # hash of the end token: no bytes stand for it
PORTION = 1 << 21  # tokens a task sums before it hands their n-grams on
BUCKET_BITS = 14
UNKNOWN = 0xFFFFFFFF  # id of tokens that training has not seen
VALUES = ("count", "total", "ones", "twos", "more")
BLOBS = "shard int, n long, data binary"
MOST = np.array([15, 255, 15, 15, 15])  # from which on values of contexts are in ``over``: half bytes, and a byte for total
COUNTS, CONTEXTS = 0, 1  # kinds of blobs: the first of the values, the others
SPREAD = 1024  # groups that sums of shards travel in


def tokens(data, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, end tokens included, and each text's offsets among them."""
    from tidemark.llm import kernels as K

    hashes, at = K.words(data, offsets, lower=True)
    return np.insert(hashes, at[1:], np.uint64(END)), at + np.arange(len(at))


def key_of(ids: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of n-grams given as columns of ids; those of one or two tokens are all different."""
    from tidemark.llm import kernels as K

    wide = [x.astype(np.uint64) for x in ids]
    key = K.mix(wide[0] + np.uint64(1)) if len(wide) == 1 else K.mix(wide[0] << np.uint64(32) | wide[1])
    for x in wide[2:]:
        key = K.mix(key + x * np.uint64(0x9E3779B97F4A7C15))
    return key


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _pack(columns: list[np.ndarray], kind: int) -> bytes:
    """Columns of unsigned numbers, the first in order, as compressed planes of bytes after a mark of their kind."""
    import zstandard

    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    narrow = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in (first, *columns[1:])]
    planes = (c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in narrow)
    return bytes([kind, *(c.itemsize for c in narrow)]) + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(blob: bytes, n: int, kinds: list) -> list[np.ndarray]:
    import zstandard

    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[len(kinds) + 1 :]), np.uint8), 0, []
    for size, kind in zip(blob[1:], kinds):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(f"<u{size}")[:, 0].astype(kind))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _batch(rows):
    import pyarrow as pa

    shard, n, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["shard", "n", "data"])


def _firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def _added(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _blobs(columns: list[np.ndarray], values: list[np.ndarray], bits: int, wide: int, kind: int = COUNTS):
    """(shard, n, blob): different rows of ``columns`` (ids of ``wide`` bits, or hashes) and the sums of their values, shard by shard.

    One sort, by shard, as many columns as fit 64 bits, and bits of the key: equal rows come together
    (those that a clash keeps apart are added up where they arrive).
    """
    keys = key_of(columns) if wide < 64 else columns[0]
    shard, fit = _top(keys, bits), min(len(columns), (64 - bits) // wide)
    mixed = keys
    if wide < 64:
        mixed = shard.astype(np.uint64)
        for c in columns[:fit]:
            mixed = mixed << np.uint64(wide) | c.astype(np.uint64)
        spare = 64 - bits - fit * wide
        if spare:
            mixed = mixed << np.uint64(spare) | keys & np.uint64((1 << spare) - 1)
    order = np.argsort(mixed)
    columns = [c[order] for c in columns]
    first = _firsts(*columns)
    columns, values, shard = [c[first] for c in columns], [_added(v[order], first) for v in values], shard[order[first]]
    edges = np.append(_firsts(shard), len(shard))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(shard[a]), int(b - a), _pack([c[a:b] for c in (*columns, *values)], kind)


def _counted(batches, columns_of, bits: int, wide: int):
    """Blobs of the counts of what ``columns_of`` finds in texts, portion by portion of a task's texts."""
    from tidemark.llm import kernels as K

    def summed():
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return _batch(list(_blobs(columns, [np.ones(len(columns[0]), np.uint32)], bits, wide)))

    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in K.chunks(batch.column("text")):
            held.append(columns_of(data, offsets))
            size += len(held[-1][0])
            if size >= PORTION:
                yield summed()
                held, size = [], 0
    if size:
        yield summed()


def _save(folder: str, **arrays) -> None:
    """Arrays as raw files, moved into place when whole: a task that runs again leaves the same."""
    import uuid

    files, path = open_folder(folder)
    files.create_dir(path, recursive=True)
    for name, array in arrays.items():
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(part, compression=None) as out:
            out.write(np.ascontiguousarray(array).tobytes())
        files.move(part, f"{path}/{name}")


@dataclass
class Model:
    folder: str
    order: int
    word_bits: int = 0
    bits: int = 0  # of the shards of n-grams
    word_sizes: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # tokens per word shard
    mark: int = 0  # id of the start mark, over those of all tokens
    total: int = 0  # training tokens
    distinct: int = 0
    discounts: dict[int, tuple[float, ...]] = field(default_factory=dict)  # by length
    single: int = 0  # the sum of the counts of single tokens
    unseen: float = 0.0  # what a token gets that training has not seen

    def opened(self, name: str, dtype) -> np.ndarray:
        """A file of the folder as a memory map that lives as long as the array; where the folder is not on a mounted file system, its bytes."""
        import os

        from pyarrow import fs

        files, path = open_folder(self.folder)
        if isinstance(files, fs.LocalFileSystem):
            return np.memmap(f"{path}/{name}", dtype, "r") if os.path.getsize(f"{path}/{name}") else np.zeros(0, dtype)
        with files.open_input_file(f"{path}/{name}") as f:
            return np.frombuffer(f.read(), dtype)

    def words(self, hashes: np.ndarray, with_times: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Id of each token (UNKNOWN for one that training has not seen) and, if asked for, its count."""
        known, back = np.unique(hashes, return_inverse=True)
        ids, times = np.full(len(known), UNKNOWN, np.uint32), np.zeros(len(known), np.int64)
        edges = np.searchsorted(_top(known, self.word_bits), np.arange((1 << self.word_bits) + 1))
        for s in np.flatnonzero(np.diff(edges)):
            if not self.word_sizes[s]:
                continue
            part, have = slice(edges[s], edges[s + 1]), self.opened(f"words-{s}", np.uint64)
            at = np.minimum(np.searchsorted(have, known[part]), len(have) - 1)
            hit = have[at] == known[part]
            ids[part] = np.where(hit, (self.opened(f"ranks-{s}", np.uint32)[at].astype(np.int64) << self.word_bits) + s, UNKNOWN)
            if with_times:
                times[part] = np.where(hit, self.opened(f"times-{s}", np.int64)[at], 0)
        return ids[back], times[back]

    def found(self, ids: list[np.ndarray]) -> dict[str, np.ndarray]:
        """The values of n-grams given as columns of ids, zeros for unknown ones; shard after shard, each unmapped after its use."""
        from pyarrow import fs

        files, path = open_folder(self.folder)
        m, keys = len(ids), key_of(ids)
        bits = self.bits if m > 1 else self.word_bits
        order = np.argsort(keys)
        keys = keys[order]
        edges = np.searchsorted(_top(keys, bits), np.arange((1 << bits) + 1))
        names = VALUES if m < self.order else VALUES[:1]
        out = np.zeros((len(keys), len(names)), np.int64)
        for s in np.flatnonzero(np.diff(edges)):
            if files.get_file_info(f"{path}/rest-{m}-{s}").type == fs.FileType.NotFound:
                continue  # no n-gram fell into this shard
            begin, rest = self.opened(f"edges-{m}-{s}", np.uint32), self.opened(f"rest-{m}-{s}", np.uint32)
            bucket, want = _places(keys[edges[s] : edges[s + 1]], bits)
            lo, end = begin[bucket].astype(np.int64), begin[bucket + 1].astype(np.int64)
            hi = end.copy()
            for _ in range(int((hi - lo).max()).bit_length()):
                mid = (lo + hi) >> 1
                less = rest[np.minimum(mid, len(rest) - 1)] < want
                go = lo < hi
                lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
            lo = np.minimum(lo, len(rest) - 1)
            hit = np.flatnonzero((lo < end) & (rest[lo] == want))
            small = self.opened(f"small-{m}-{s}", np.uint8).reshape(len(rest), -1)[lo[hit]].astype(np.int64)
            values, most = (small, 255) if len(names) == 1 else (np.stack([small[:, 0] & 15, small[:, 2], small[:, 1] & 15, small[:, 1] >> 4, small[:, 0] >> 4], 1), MOST)
            large = np.nonzero(values == most)
            if len(large[0]):
                over = self.opened(f"over-{m}-{s}", np.int64).reshape(2, -1)
                values[large] = over[1][np.searchsorted(over[0], lo[hit][large[0]] * len(names) + large[1])]
            out[order[edges[s] + hit]] = values
        return dict(zip(names, out.T, strict=True))


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 bits after it of keys of one shard."""
    below = keys << np.uint64(bits)
    return (below >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), (below << np.uint64(BUCKET_BITS) >> np.uint64(32)).astype(np.uint32)


def padded(hashes_or_ids: np.ndarray, at: np.ndarray, marks: int, mark) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with ``marks`` start marks before each text, and the places of the tokens proper."""
    n, rows = len(hashes_or_ids), len(at) - 1
    place = np.arange(n) + marks * (np.repeat(np.arange(rows), np.diff(at)) + 1)
    out = np.full(n + marks * rows, mark, hashes_or_ids.dtype)
    out[place] = hashes_or_ids
    return out, place


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, kept between 0 and the count."""
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0)
    return tuple(min(max(x, 0.0), k) for k, x in enumerate(d, 1))


def _discount(count: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.choose(np.minimum(count, 3), [0.0, *d])


def _stored(level: int, model: Model):
    """A function for applyInArrow: stores one shard of n-grams of length ``level`` and hands on those of the length below."""
    bits_of = lambda m: model.bits if m > 1 else model.word_bits
    folder, mark, wide = model.folder, model.mark, model.mark.bit_length()
    names = VALUES if level < model.order else VALUES[:1]

    def run(key, table):
        import pyarrow as pa

        shard, sizes, data = key[0].as_py(), table.column("n").to_pylist(), table.column("data").to_pylist()
        if shard < 0:  # sums of shards, by length
            sums = {}
            for m, raw in zip(sizes, data, strict=True):
                sums[m] = sums.get(m, 0) + np.frombuffer(raw, np.int64)
            return pa.Table.from_batches([_batch([(shard, m, v.tobytes()) for m, v in sums.items()])])
        held = [np.zeros((0, level), np.uint32)], [np.zeros((0, len(names)), np.uint64)]
        for n, d in zip(sizes, data, strict=True):
            own = slice(0, 1) if d[0] == COUNTS else slice(1, len(VALUES))
            columns = _unpack(d, n, [np.uint32] * level + [np.uint64] * len(VALUES[own]))
            held[0].append(np.stack(columns[:level], 1))
            held[1].append(np.zeros((n, len(names)), np.uint64))
            held[1][-1][:, own] = np.stack(columns[level:], 1)
        columns = [*np.concatenate(held[0]).T, *np.concatenate(held[1]).T]
        keys = key_of(columns[:level])
        order = np.argsort(keys)
        first = _firsts(keys[order])
        keys, ids, values = keys[order[first]], [c[order[first]] for c in columns[:level]], np.stack([_added(c[order], first) for c in columns[level:]], 1)
        bucket, rest = _places(keys, bits_of(level))
        most = MOST if level < model.order else MOST[1:2]
        small = np.minimum(values, most.astype(np.uint64)).astype(np.uint8)
        if level < model.order:
            small = np.stack([small[:, 0] | small[:, 4] << 4, small[:, 2] | small[:, 3] << 4, small[:, 1]], 1)
        large = np.flatnonzero((values >= most.astype(np.uint64)).ravel())
        _save(folder, **{
            f"edges-{level}-{shard}": np.searchsorted(bucket, np.arange((1 << BUCKET_BITS) + 1)).astype(np.uint32),
            f"small-{level}-{shard}": small,
            f"over-{level}-{shard}": np.stack([large, values.ravel()[large].astype(np.int64)]),
            f"rest-{level}-{shard}": rest,
        })
        count = values[:, 0]
        tops = [count == 1, count == 2, count > 2]
        told = np.array([*(t.sum() for t in tops[:2]), (count == 3).sum(), (count == 4).sum(), tops[2].sum(), count.sum()], np.int64)
        out = [(-1 - shard % SPREAD, level, told.tobytes())]
        if level > 1:
            some = np.flatnonzero(count)  # n-grams of start marks alone are contexts only
            ids, count = [c[some] for c in ids], count[some]
            given = np.where(ids[1] == mark, count, np.uint64(1)) if level > 2 else np.ones(len(some), np.uint64)
            # each n-gram tells the n-gram without its first token of one more token before it, and its context about its count
            out += _blobs(ids[1:], [given], bits_of(level - 1), wide)
            out += _blobs(ids[:-1], [count, *(t[some].astype(np.uint64) for t in tops)], bits_of(level - 1), wide, CONTEXTS)
        return pa.Table.from_batches([_batch(out)])

    return run


def train(texts: DataFrame, order: int = 3, per_shard: int = 1 << 20) -> Model:
    """Count ``texts`` (a column text; null counts as empty) and store the model in a new shared folder.

    ``order`` is the longest n-gram, two at least. Repeated rows count as often as they stand; texts
    may have any length. Fails for over 2**32 - 2 different tokens. ``per_shard`` is the number of
    tokens aimed at per shard. No text gives a model without tokens.
    """
    spark, folder = texts.sparkSession, new_folder(texts.sparkSession, "kneser-ney")
    if order < 2:
        raise ValueError("order is two at least")
    given = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits_for = lambda n: max(0, math.ceil(math.log2(max(size / 6, 1) / n)))  # noqa: E731  some six bytes per token
    model = Model(folder, order, bits_for(per_shard << 3), bits_for(per_shard))

    def store_words(key, table):
        import pyarrow as pa

        shard = key[0].as_py()
        keys, times = (np.concatenate(c) for c in zip(*(_unpack(d, n, [np.uint64, np.int64]) for n, d in zip(table.column("n").to_pylist(), table.column("data").to_pylist(), strict=True)), strict=True))
        order = np.argsort(keys)
        first = _firsts(keys[order])
        keys, times = keys[order[first]], _added(times[order], first)
        ranks = np.empty(len(keys), np.uint32)
        ranks[np.lexsort((keys, -times))] = np.arange(len(keys), dtype=np.uint32)
        _save(folder, **{f"words-{shard}": keys, f"times-{shard}": times, f"ranks-{shard}": ranks})
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(times.sum())], pa.int64())})

    word_bits = model.word_bits
    counted = given.mapInArrow(tidied(lambda b: _counted(b, lambda d, o: [tokens(d, o)[0]], word_bits, 64)), BLOBS)
    sizes = {r.shard: (r.n, r.total) for r in counted.groupBy("shard").applyInArrow(store_words, "shard int, n long, total long").collect()}  # a row per shard
    model.word_sizes = np.array([sizes.get(s, (0, 0))[0] for s in range(1 << word_bits)])
    model.total, model.distinct = sum(t for _, t in sizes.values()), int(model.word_sizes.sum())
    model.mark = int(model.word_sizes.max()) << word_bits
    if model.mark >= UNKNOWN:
        raise ValueError("over 2**32 - 2 ids of tokens")
    if not model.total:
        return model

    def grams(data, offsets):
        hashes, at = tokens(data, offsets)
        ids, place = padded(model.words(hashes)[0], at, order - 1, model.mark)
        return [ids[place - i] for i in range(order - 1, -1, -1)]

    wide = model.mark.bit_length()
    rows = given.mapInArrow(tidied(lambda b: _counted(b, grams, model.bits, wide)), BLOBS)
    for m in range(order, 0, -1):
        rows = rows.groupBy("shard").applyInArrow(_stored(m, model), BLOBS)
    told: dict[int, np.ndarray] = {}
    for r in rows.where("shard < 0").select("n", "data").collect():  # a row per length and group of shards
        told[r.n] = told.get(r.n, 0) + np.frombuffer(bytes(r.data), np.int64)
    model.discounts = {m: discounts(*t[:4].tolist()) for m, t in told.items()}
    ones, twos, _, _, more, model.single = told[1].tolist()
    d = model.discounts[1]
    model.unseen = (d[0] * ones + d[1] * twos + d[2] * more) / model.single / (model.distinct + 1)
    return model


def _logs(model: Model, data, offsets):
    """(offsets, known, base, full) of the tokens of texts."""
    hashes, at = tokens(data, offsets)
    n, v, order = model.total, model.distinct, model.order
    if not n:
        even = np.zeros(len(hashes))
        return at, np.zeros(len(hashes), bool), even, even
    ids, times = model.words(hashes, with_times=True)
    base = np.log10((times + 1) / (n + 1 * (v + 1)))
    ids, place = padded(ids, at, order - 1, model.mark)
    p = np.full(len(place), model.unseen)
    before = None  # values of the n-grams that end one place earlier
    for m in range(1, order + 1):
        # a window for every token, and for m < order for the mark before a text's first
        ends = np.unique(np.concatenate([place, place - 1])) if m < order else place
        now = model.found([ids[ends - i] for i in range(m - 1, -1, -1)])
        count = now["count"][np.searchsorted(ends, place)]
        if m == 1:
            p += np.maximum(count - _discount(count, model.discounts[1]), 0) / model.single
        else:
            d, total = model.discounts[m], before["total"]
            keep = d[0] * before["ones"] + d[1] * before["twos"] + d[2] * before["more"]
            p = np.where(total > 0, (np.maximum(count - _discount(count, d), 0) + keep * p) / np.maximum(total, 1), p)
        if m < order:
            left = np.searchsorted(ends, place - 1)
            before = {k: x[left] for k, x in now.items()}
    return at, times > 0, base, np.log10(p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus n_tokens, n_known, train_tokens, base_score and score.

    ``score`` is the log10 probability of the text's tokens, ``base_score`` that of add-one unigram
    counts, ``n_known`` the tokens that training has seen; columns of these names are replaced. A
    null text has its end token alone. A model of no text gives every token the same share. Every
    row is scored by itself, repeated ones too, over its whole text.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in names]
    given = docs.select(*keep)

    def run(batches):
        import pyarrow as pa

        from tidemark.llm import kernels as K

        for batch in batches:
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
            for _, _, data, offsets in K.chunks(batch.column("text"), 4 * K.CHUNK):
                at, known, base, full = _logs(model, data, offsets)
                parts.append((np.diff(at), np.add.reduceat(known.astype(np.int64), at[:-1]), np.add.reduceat(base, at[:-1]), np.add.reduceat(full, at[:-1])))
            n, k, b, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(k), pa.array(np.full(len(n), model.total, np.int64)), pa.array(b), pa.array(s)], [*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(tidied(run), f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
