"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; each bit has a binary classifier over hashed byte n-grams
that predicts it; a text goes to the language whose codeword is nearest to the predicted bits,
each bit weighted by the classifier's loss. A small gap to the second nearest codeword flags the
text as ambiguous.

The classifiers are log-odds of smoothed n-gram frequencies, computed in closed form from one
count per (language, n-gram bucket): training is one distributed pass over all labelled rows and
needs no sample. What reaches the driver is that count table, a row per language with at most
``buckets`` pairs, for at most ``most_languages`` languages.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.kernels import tidied

BUCKETS = 1 << 15
SIZES = (2, 3)  # byte n-grams


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """An n x bits matrix of +1 and -1 with distinct rows and far-apart codewords.

    Up to 5 languages all splits of them are used (2**(n-1) - 1 bits, one for a single language);
    beyond, the best of some random matrices of ``8 + 6 * log2(n)`` bits.
    """
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=max(n - 1, 0)) if -1 in s] or [()]
        return np.array([[1, *s] for s in splits], dtype=np.int8).T.reshape(n, -1) if n else np.zeros((0, 0), np.int8)
    bits = 8 + 6 * int(np.ceil(np.log2(n)))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        near = (code @ code.T.astype(int) - 2 * bits * np.eye(n, dtype=int)).max()
        if (bits - near) // 2 > far:
            far, best = (bits - near) // 2, code
    return best


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """(bucket of each n-gram, text of each n-gram's first byte) for each n-gram size; no n-gram crosses texts."""
    from tidemark.llm import kernels as K

    low = K.LOWER[data].astype(np.uint64)
    low[K.SPACE[data] | ((data >= 48) & (data < 58))] = 32
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    for n in SIZES:
        if len(low) < n:
            continue
        m = len(low) - n + 1
        code = sum(low[i : m + i] << np.uint64(8 * i) for i in range(n)) + np.uint64(n << 40)
        # clamped by a mask: n-grams over a text's end go to no bucket
        yield (K.mix(code) % np.uint64(buckets)).astype(np.int64), left[:m] >= n


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x bits
    code: np.ndarray = field(repr=False)  # languages x bits

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best, probability, gap) per text: index of the language, share of the softmax, distance to the second."""
        n, bits = len(offsets) - 1, self.code.shape[1]
        total, count = np.zeros((n, bits)), np.zeros(n)
        for bucket, ok in _features(data, offsets, len(self.weights)):
            at = np.minimum(offsets[:-1], len(bucket))
            sums = np.concatenate([[0], np.cumsum(ok)])
            ends = np.minimum(offsets[1:], len(bucket))
            count += sums[ends] - sums[at]
            for b in range(bits):
                run = np.concatenate([[0.0], np.cumsum(np.where(ok, self.weights[bucket, b], 0.0))])
                total[:, b] += run[ends] - run[at]
        margin = total / np.sqrt(np.maximum(count, 1))[:, None]  # evidence grows slower than length: n-grams overlap
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]).sum(2)
        if loss.shape[1] == 1:
            return np.zeros(n, int), np.ones(n), np.full(n, np.inf)
        order = np.argsort(loss, axis=1, kind="stable")[:, :2]
        two = np.take_along_axis(loss, order, 1)
        share = 1 / np.exp(two[:, :1] - loss).sum(1)
        return order[:, 0], share, two[:, 1] - two[:, 0]


def train(labelled: DataFrame, buckets: int = BUCKETS, most_languages: int = 256, smoothing: float = 0.5) -> Model:
    """Fit on all rows of ``labelled`` (text, lang), each as often as it stands; rows with a null in either are left out."""

    def run(batches):
        import pyarrow as pa

        from tidemark.llm import kernels as K

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            for i, j, data, offsets in K.chunks(batch.column("text")):
                own = lang[i:j]
                names, which = np.unique(own.astype(str), return_inverse=True)
                byte_lang = np.repeat(which, np.diff(offsets))
                for bucket, ok in _features(data, offsets, buckets):
                    flat = np.bincount(byte_lang[: len(bucket)][ok] * buckets + bucket[ok], minlength=len(names) * buckets).reshape(len(names), buckets)
                    for k, name in enumerate(names):
                        total[name] = total.get(name, 0) + flat[k]
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    counted = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = counted.mapInArrow(tidied(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = rows.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).limit(most_languages + 1).toArrow()
    if packed.num_rows > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    got = {name: k for k, name in enumerate(packed.column("lang").to_pylist())}
    names = sorted(got)
    counts = np.zeros((len(names), buckets))
    for k, name in enumerate(names):
        counts[k, packed.column("buckets")[got[name]].values.to_numpy()] = packed.column("ns")[got[name]].values.to_numpy()
    share = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True) if names else counts
    code = codewords(len(names))
    weights = np.zeros((buckets, code.shape[1]))
    for b in range(code.shape[1]):
        plus, minus = share[code[:, b] > 0], share[code[:, b] < 0]
        weights[:, b] = np.log(plus.mean(0)) - np.log(minus.mean(0)) if len(plus) and len(minus) else 0.0
    return Model(names, weights, code)


def identify(docs: DataFrame, model: Model, least_gap: float = 1.0) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score (0 to 1) and ambiguous.

    ``lang_pred`` is ``und`` with score 0 for a null text, a text without a letter, and every text
    if the model knows no language. Columns of ``docs`` with these names are replaced; column
    names are otherwise free. Whole texts are read, of any length. Of codewords equally near, that
    of the first language by name is taken and the text is flagged; repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x bits
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    given = docs.select(*keep)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from tidemark.llm import kernels as K

        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            text = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            best, score, gap = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)]
            for _, _, data, offsets in K.chunks(text):
                if m.languages:
                    b, s, g = m.scores(data, offsets)
                else:
                    b, s, g = np.zeros(len(offsets) - 1, int), np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
                best.append(b)
                score.append(s)
                gap.append(g)
            ok = lettered & bool(m.languages)
            best, score, gap = (np.concatenate(x) for x in (best, score, gap))
            which = np.where(ok, best, len(m.languages))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[which], pa.string()), pa.array(np.where(ok, np.clip(score, 0, 1), 0.0)), pa.array(ok & (gap < least_gap))],
                [*keep, "lang_pred", "score", "ambiguous"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(tidied(run), f"{fields}, lang_pred string, score double, ambiguous boolean")
