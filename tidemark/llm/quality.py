"""Quality filtering by weak supervision.

Hand-written rules look at features of the whole text and vote keep (1), drop (0) or abstain (-1).
A latent-class model explains the votes: each rule has, for good and for bad documents, its own
distribution over the three votes; expectation-maximisation estimates them and the share of good
documents from the number of documents with each combination of votes. The posterior probability
that a document is good replaces the usual all-rules-must-pass filter.

The vote table has at most 3**rules rows whatever the corpus size; only it reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.kernels import tidied
from tidemark.llm.scratch import new_folder, written

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_long_words long, n_symbol_words long, n_upper long, n_bangs long"


def features(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus the features of the whole text; columns with these names are replaced.

    Words are runs without ASCII white space; a null text has none. ``n_repeat_words`` counts the
    words inside windows of three words that occur twice or more, the first time included;
    ``n_dup_lines`` the lines with a word that equal an earlier line; ``n_long_words`` the words of
    over 20 characters; ``n_symbol_words`` those with one of the symbols; ``n_upper`` the letters
    A-Z; ``n_bangs`` the exclamation marks.
    """
    names = [x.split()[0] for x in FEATURES.split(", ")]
    keep = [c for c in docs.columns if c not in names]

    def run(batches):
        import pyarrow as pa

        from tidemark.llm import kernels as K

        symbol = np.zeros(256, bool)
        symbol[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
        head = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point

        for batch in batches:
            out = [np.zeros((0, len(names)), np.int64)]
            for _, _, data, offsets in K.chunks(batch.column("text")):
                n = len(offsets) - 1
                got = np.zeros((n, len(names)), np.int64)
                space = K.SPACE[data]
                starts, ends = K.spans(~space, offsets)
                at = np.searchsorted(starts, offsets)

                def per_text(flags, where=offsets):
                    total = np.concatenate([[0], np.cumsum(flags)])
                    return total[where[1:]] - total[where[:-1]]

                points = np.concatenate([[0], np.cumsum(head[data])])
                width = points[ends] - points[starts]
                got[:, 0] = np.diff(at)
                got[:, 1] = per_text(head[data] & ~space)
                got[:, 2] = per_text(symbol[data])
                got[:, 6] = per_text(width > 20, at)
                marks = np.concatenate([[0], np.cumsum(symbol[data])])
                got[:, 7] = per_text(marks[ends] > marks[starts], at)
                got[:, 8] = per_text((data >= 65) & (data < 91))
                got[:, 9] = per_text(data == 33)
                hashes = K.span_hashes(data, starts, ends)
                text_of = np.repeat(np.arange(n), np.diff(at))
                # windows of three words
                m = len(hashes) - 2
                if m > 0:
                    times = K.multipliers(3, 21)
                    key = K.mix(hashes[:-2] * times[0] + hashes[1:-1] * times[1] + hashes[2:] * times[2] + text_of[:-2].astype(np.uint64) * times[0])
                    inside = text_of[:-2] == text_of[2:]
                    where = np.flatnonzero(inside)
                    _, which, count = np.unique(key[where], return_inverse=True, return_counts=True)
                    twice = where[count[which] > 1]
                    marked = np.zeros(len(hashes), bool)
                    for i in range(3):
                        marked[twice + i] = True
                    got[:, 4] = per_text(marked, at)
                # lines
                ls, le = K.spans(data != 10, offsets)
                if len(ls):
                    a, b = np.searchsorted(starts, ls), np.searchsorted(starts, le)
                    full = b > a
                    line_text = np.searchsorted(offsets, ls, "right") - 1
                    key = K.mix(K.span_hashes(data, ls, le) + line_text.astype(np.uint64) * K.multipliers(1, 22)[0])[full]
                    texts = line_text[full]
                    first = np.zeros(len(key), bool)
                    first[np.unique(key, return_index=True)[1]] = True
                    got[:, 3] = np.bincount(texts[~first], minlength=n)
                    got[:, 5] = np.bincount(texts, minlength=n)
                out.append(got)
            table = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(table[:, i]) for i in range(len(names)))], [*keep, *names])

    given = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(tidied(run), f"{fields}, {FEATURES}")


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, 0).when(F.lit(False) if good is None else good, 1).otherwise(-1).cast("byte")


def rules() -> dict[str, Column]:
    """Each rule's vote over the feature columns: 1 keep, 0 drop, -1 abstain. Most only ever drop or abstain."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    per_word = lambda c: F.col(c) / words
    width, same = per_word("word_chars"), F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "length": _vote(F.col("n_words") < 30, F.col("n_words").between(80, 50_000)),
        "word_width": _vote((width < 2.5) | (width > 9), width.between(3, 7)),
        "symbols": _vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.02),
        "symbol_words": _vote(per_word("n_symbol_words") > 0.1),
        "shouting": _vote(F.col("n_upper") > 0.4 * F.greatest(F.col("word_chars"), F.lit(1))),
        "bangs": _vote(per_word("n_bangs") > 0.2),
        "repeated_words": _vote(per_word("n_repeat_words") > 0.3, per_word("n_repeat_words") < 0.1),
        "same_lines": _vote(same > 0.3),
        "long_words": _vote(per_word("n_long_words") > 0.2),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, prior: float = 0.9, weight: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of good per vote pattern, and each rule's table [class bad/good, vote drop/keep/abstain].

    ``patterns``: votes per row, ``counts``: documents with them. The tables start from, and are
    drawn to with the weight of a share ``weight`` of the documents, the belief that a good
    document gets a drop vote in 2 of 100 cases and a bad one in 40, whatever the rule; so good
    stays the class that drop votes speak against.
    """
    m, total = patterns.shape[1], float(counts.sum())
    vote = np.where(patterns < 0, 2, patterns).astype(int)
    keeps = np.array([(counts * (vote[:, r] == 1)).sum() for r in range(m)]) / max(total, 1.0)
    table = np.zeros((m, 2, 3))
    for c, drop in ((0, 0.4), (1, 0.02)):
        table[:, c, 0] = drop
        table[:, c, 1] = (1 - drop) * np.clip(keeps, 0.001, 0.999)
        table[:, c, 2] = 1 - table[:, c, 0] - table[:, c, 1]
    strength = 10 + weight * total
    anchor, good = table * strength, prior
    post, rows = np.full(len(counts), prior), np.arange(m)
    for _ in range(rounds if total else 0):
        log = np.log(table)
        bad_score = np.log(1 - good) + log[rows, 0, vote].sum(1)
        good_score = np.log(good) + log[rows, 1, vote].sum(1)
        new = 1 / (1 + np.exp(np.clip(bad_score - good_score, -700, 700)))
        moved = np.abs(new - post).max()
        post = new
        for c, w in ((0, counts * (1 - post)), (1, counts * post)):
            hits = np.array([[(w * (vote[:, r] == v)).sum() for v in range(3)] for r in range(m)]) + anchor[:, c, :]
            table[:, c, :] = hits / hits.sum(1, keepdims=True)
        good = (counts @ post + prior * strength) / (total + strength)
        if moved < 1e-9:
            break
    return post, table


def judge(docs: DataFrame, least: float = 0.5, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` plus the features, ``quality`` (posterior probability) and ``good``.

    The votes of all rows are counted; then every row is given the posterior of its votes. Without
    ``keep_text`` the result has no column text, and the features are written once and read twice;
    with it they are computed twice, as texts are larger than features. A null or empty text has no
    words and gets drop votes from its length. Repeated rows count as often as they stand. An empty
    table gives an empty table.
    """
    votes = rules()
    given = features(docs)
    if not keep_text:
        given = written(given.drop("text"), new_folder(docs.sparkSession, "quality"), "features")
    voted = given.withColumn("__votes", F.concat_ws(",", *(v.cast("string") for v in votes.values())))
    table = given.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).count().toPandas()  # at most 3 ** rules rows
    patterns = table[list(votes)].to_numpy().astype(int).reshape(-1, len(votes))
    post, _ = fit(patterns, table["count"].to_numpy().astype(float))
    rows = [(",".join(map(str, p)), float(q)) for p, q in zip(patterns, post, strict=True)]
    known = F.broadcast(docs.sparkSession.createDataFrame(rows, "__votes string, quality double"))  # bounded as above
    return voted.drop("quality", "good").join(known, "__votes", "left").drop("__votes").withColumn("good", F.col("quality") >= least)
