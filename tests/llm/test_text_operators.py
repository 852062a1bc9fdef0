"""Near duplicates, repeated passages, decontamination, quality, language and mixing against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, kernels as K, langid, linededup, minhash, mixing, quality
from tests_llm_prose import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def grams(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


# kernels


def test_hashes_are_those_of_the_words():
    import pyarrow as pa

    texts = ["a b  a", "", None, "\tx\x0by ", "a", "é ü é", "a" * 3_000_000 + " b"]
    seen, n = {}, 0
    for i, j, data, offsets in K.chunks(pa.array(texts)):
        h, at = K.words(data, offsets)
        for t in range(i, j):
            own = [int(x) for x in h[at[t - i] : at[t - i + 1]]]
            assert len(own) == len(words(texts[t]))
            for w, x in zip(words(texts[t]), own):
                assert seen.setdefault(w, x) == x
            n += 1
    assert n == len(texts) and len(set(seen.values())) == len(seen)
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    assert (K.unmix(K.mix(x)) == x).all()


def test_hashes_of_patterned_words_differ():
    import pyarrow as pa

    word = "a"
    for _ in range(12):  # a polynomial modulo 2**64 gives this word and its complement the same hash
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    (_, _, data, offsets), = K.chunks(pa.array([f"{word} {other} {word}"]))
    h, _ = K.words(data, offsets)
    assert h[0] == h[2] != h[1]
    tokens = np.array([ord(c) for c in word], np.uint64), np.array([ord(c) for c in other], np.uint64)
    assert K.rolling(tokens[0], len(word)) != K.rolling(tokens[1], len(word))


def test_windows_have_the_hash_of_their_words():
    g = np.random.default_rng(3)
    few = g.integers(0, 3, 4000).astype(np.uint64)
    for n in (1, 2, 5, 8, 13):
        seen = {}
        for i, h in enumerate(K.rolling(few, n)):
            assert seen.setdefault(tuple(few[i : i + n]), h) == h
        assert len(set(seen.values())) == len(seen) and i == len(few) - n


# 10


def test_band_plan_reaches_its_recall():
    for recall in (0.9, 0.99, 0.999):
        bands, rows = minhash.band_plan(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 400


def brute_classes(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    sets = {t: grams(t) for t in keys}
    parent = {t: t for t in keys}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    links = Counter()
    for a, b in itertools.combinations(keys, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    lowest = {}
    for t in keys:
        ids = [i for i in texts[t] if i is not None]
        lowest[root(t)] = min([x for x in (lowest.get(root(t)), *ids) if x is not None], default=None)
    return sorted(((i, lowest[root(t or "")], links[t or ""], len(texts[t or ""])) for i, t in rows), key=str)


@pytest.mark.parametrize("block", [2, 128])
def test_near_duplicates(spark, corpus, block):
    g = random.Random(4)
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    base = prose(20, 100).split()
    for i in range(40):  # a loose group: every copy with up to four changed words
        copy = list(base)
        for _ in range(g.randrange(5)):
            copy[g.randrange(100)] = f"z{g.randrange(1000)}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(200, "und und und " * 300), (201, "so so " * 50 + prose(21, 5)), (202, "so so " * 400 + prose(21, 5))]  # few different n-grams, often repeated
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy_key", F.lit(1))
    got = minhash.near_duplicates(docs, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_classes(rows)


def test_one_row_of_each_class_stays(spark):
    a, b, near = prose(1, 90), prose(2, 90), prose(1, 90).split()
    near[40] = "changed"
    rows = [(5, a, "x"), (5, a, "y"), (7, b, "x"), (7, a, "x"), (None, a, "x"), (None, prose(3, 90), "x"), (None, prose(3, 90), "x"), (8, " ".join(near), "x"), (9, None, "x"), (10, "", "x"), (None, prose(4, 60), "x")]
    got = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, rep string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(5, a), (7, b), (None, prose(3, 90)), (9, None), (None, prose(4, 60))], key=str)


def test_planted_pairs_are_found(spark):
    """Pairs of texts at 0.8 to 0.85: nine in ten at least, by comparing all pairs."""
    g, rows = np.random.default_rng(5), []
    for i in range(300):
        base = prose(1000 + i, 150, 5000).split()
        other = list(base)
        for at in g.choice(140, 3, replace=False):
            other[at] = "other"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    at_least = [i for i in range(300) if len(grams(rows[2 * i][1]) & grams(rows[2 * i + 1][1])) >= 0.8 * len(grams(rows[2 * i][1]) | grams(rows[2 * i + 1][1]))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(at_least) > 100 and sum(got[2 * i + 1] == 2 * i for i in at_least) >= 0.99 * len(at_least)


def test_near_duplicates_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).collect() == []


# 8


def repeated(rows, run=50):
    """Per document the words inside windows of ``run`` words that stand earlier."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        w = words(t)
        for p in range(len(w) - run + 1):
            k = tuple(w[p : p + run])
            if k in seen:
                out.setdefault(i, set()).update(range(p, p + run))
            else:
                seen[k] = 1
    return out


def test_repeated_passages_go(corpus):
    docs = corpus.dropDuplicates(["doc_id", "text"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, texts = repeated(rows), dict(rows)
    got = linededup.drop_repeated(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"lang", "_key", "removed"}
    for r in got:
        gone = {x for s in r.removed for x in range(s.first, s.last)}
        assert gone == want.get(r.doc_id, set()), r.doc_id
        assert words(r.text) == [w for k, w in enumerate(words(texts[r.doc_id])) if k not in gone]
        if not gone:
            assert r.text == texts[r.doc_id]
    digest = {r.doc_id: r.n_removed for r in linededup.repeated_runs(docs).collect()}
    assert digest == {r.doc_id: r.n_removed for r in got}
    assert digest[4] == 60 and digest[1] == 120 and digest[3] == 0


def brute_repeats(spark, rows):
    """Removed words by document, here and by plain Python."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {x for s in r.removed for x in range(s.first, s.last)} for r in linededup.repeated_runs(docs).collect()}
    want = repeated(rows)
    return {k: v for k, v in got.items() if v}, want


def test_passages_whose_phrases_stand_earlier_go(spark):
    passage = prose(32, 60, 5000).split()
    # earlier documents hold every fingerprint, but no 50 words
    rows = [(i, f"{prose(100 + i, 20)} {' '.join(passage[i % 12 : i % 12 + 49])} {prose(200 + i, 20)}") for i in range(48)]  # Z
    rows += [(50, f"{prose(35, 9)} {' '.join(passage)} {prose(36, 30)}"), (51, f"{prose(37, 70)} {' '.join(passage)} {prose(38, 7)}")]  # A and B
    got, want = brute_repeats(spark, rows)
    assert want == {51: set(range(70, 130))} and got == want


def test_passages_whose_phrases_stand_earlier_in_the_same_text_go(spark):
    passage = prose(39, 60, 5000).split()
    own = " ".join(passage[:40]) + " x y " + " ".join(passage[20:])
    rows = [(1, f"{prose(43, 11)} {' '.join(passage)}"), (2, f"{own} {prose(44, 15)} {' '.join(passage)} {prose(45, 5)}")]
    got, want = brute_repeats(spark, rows)
    assert len(want[2]) == 60 and got == want


def test_repeats_of_random_cuts(spark):
    g = random.Random(7)
    sources = [prose(46 + i, 300, 3000).split() for i in range(3)] + [("a b c " * 60).split()]
    rows = []
    for i in range(60):
        w = []
        for _ in range(g.randrange(1, 6)):
            s = g.choice(sources)
            at, n = g.randrange(len(s)), g.randrange(5, 120)
            w += s[at : at + n] + prose(g.randrange(10**6), g.randrange(4), 3000).split()
        for _ in range(g.randrange(3)):
            w[g.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w)))
    got, want = brute_repeats(spark, rows)
    assert len(want) > 30 and got == want


def test_repeated_lines_go(spark):
    """Runs of three lines, against a search for every window of three lines."""
    g, rows = random.Random(9), []
    lines = [prose(700 + i, 12) for i in range(40)]
    for i in range(50):
        at, n = g.randrange(36), g.randrange(1, 9)
        own = lines[at : at + n] + [prose(g.randrange(10**6), 5) for _ in range(g.randrange(3))] + lines[g.randrange(38) :][:3]
        rows.append((i, "\n".join(g.choice(["", " ", "\t"]) + x + g.choice(["", "  ", "\n"]) for x in own)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "one line")]
    seen, want = set(), {}
    for i, t in rows:
        own = [x.strip() for x in (t or "").split("\n") if x.strip()]
        for p in range(len(own) - 2):
            k = tuple(own[p : p + 3])
            if k in seen:
                want.setdefault(i, set()).update(range(p, p + 3))
            seen.add(k)
    got = linededup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"), run=3, gram=2, unit="line").collect()
    texts = dict(rows)
    assert len(want) > 20
    for r in got:
        own = [x.strip() for x in (texts[r.doc_id] or "").split("\n") if x.strip()]
        gone = {x for s in r.removed for x in range(s.first, s.last)}
        assert gone == want.get(r.doc_id, set()) and r.n_units == len(own)
        assert [x.strip() for x in (r.text or "").split("\n") if x.strip()] == [x for k, x in enumerate(own) if k not in gone]


def test_line_feed_stays_between_lines(spark):
    p = prose(31, 55)
    docs = spark.createDataFrame([(1, p), (2, f"first line\n{p}\nlast line"), (3, f"head {p}\ntail")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.drop_repeated(docs).collect()}
    assert got[2] == "first line\nlast line" and got[3] == "head\ntail"


def test_repeats_of_nothing(nothing):
    assert linededup.drop_repeated(nothing).collect() == [] and linededup.repeated_runs(nothing).collect() == []


# 5


def test_masks_see_all_pairs_of_substitutions():
    for wrong in itertools.chain(itertools.combinations(range(13), 2), itertools.combinations(range(13), 1), [()]):
        assert any(all(o + i not in wrong for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for o in range(13 - len(m) + 1))


def test_decontamination(spark, corpus):
    items = [prose(40, 30, 5000), prose(41, 13, 5000), prose(42, 9, 5000), "too short", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("seed", F.lit(1))
    long = items[0].split()
    swapped = list(long[5:18])
    swapped[3], swapped[9] = "other", "words"
    broken = list(long[:13])
    for i in (1, 5, 9):
        broken[i] = f"n{i}"
    planted = {
        200: prose(50, 20) + " " + items[0].upper() + "! " + prose(51, 5), 201: " ".join(swapped), 202: "x " + items[1] + " y", 203: items[2] + " " + prose(52, 30), 204: " ".join(broken), 205: " ".join(long[:12]), 206: "too short",
        207: prose(53, 30_000) + ", ".join(["", *long]),
    }
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(list(planted.items()), "doc_id long, text string")).withColumn("tokens", F.lit(0))
    want = {(200, 0, 13), (201, 0, 11), (202, 1, 13), (203, 2, 9), (207, 0, 13)}  # not 206: an item of two tokens tells nothing
    for limit in (2_000_000, 3):  # broadcast, and by a shuffle
        got = decontam.contaminated(docs, bench, broadcast_bytes=limit).collect()
        assert {(r.doc_id, r.item_id, r.n_equal) for r in got} - {(205, 0, 12)} == want
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()}
    assert kept >= {0, 5, 6, 204, 206, None} and not kept & {200, 201, 202, 203, 207}


def test_parts_of_short_items_see_all_allowed_substitutions():
    for n in range(1, 13):
        allowed = n - int(np.ceil(n * 0.8 - 1e-9))
        for wrong in itertools.combinations(range(n), allowed):
            assert any(not set(wrong) & set(range(a, a + k)) for a, k in decontam.short_parts(n, 0.8))


def test_short_items_are_found(spark):
    items = {n: [f"i{n}t{k}" for k in range(n)] for n in range(1, 13)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    rows, want = [], set()
    for n, w in items.items():
        allowed = n - int(np.ceil(n * 0.8 - 1e-9))
        for wrong in itertools.chain.from_iterable(itertools.combinations(range(n), m) for m in range(allowed + 2) if m <= n):
            text = " ".join("other" if i in wrong else x for i, x in enumerate(w))
            for before, after in (("", ""), ("two words ", " three more words")):
                rows.append((len(rows), before + text + after))
                if len(wrong) <= allowed and n >= decontam.LEAST:  # a shorter item matches nothing
                    want.add((len(rows) - 1, n, n - len(wrong)))
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.n_equal) for r in got} == want


def test_only_texts_with_items_go(spark):
    item, clean = prose(1, 20), prose(2, 50)
    rows = [(None, clean), (None, f"{clean} {item}"), (3, clean), (3, f"{item} {clean}"), (4, f"{item} {clean}"), (5, None)]
    kept = decontam.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, clean), (3, clean), (5, None)], key=str)


def test_the_shortest_items_match_themselves_alone(spark):
    docs = spark.createDataFrame([(1, "Alpha, beta! gamma"), (2, "beta alpha"), (3, "delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "delta"), (3, ""), (4, "gamma delta")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, least=1).collect()) == [(1, 1), (3, 2)]
    assert decontam.contaminated(docs, items, least=3).count() == 0
    assert decontam.contaminated(docs, items).count() == 0 and decontam.drop_contaminated(docs, items).count() == 3


def test_one_token_over_and_over(spark):
    """Places of an item that look alike are one place; broadcast and shuffle give the same rows, copies and hot seeds included."""
    rows = [(1, "go " * 3000), (2, "go " * 3000), (3, "stop " * 12 + "go " * 12), (4, prose(60, 500)), (5, "a b c d " * 400), (None, "go " * 20), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "go " * 2000), (2, "a b c d " * 300), (3, prose(60, 40)), (3, prose(60, 40)), (None, prose(60, 20)), (7, None)], "item_id long, text string")
    found = [sorted(map(tuple, decontam.contaminated(docs, items, broadcast_bytes=limit).collect()), key=str) for limit in (1 << 25, 1)]
    assert found[0] == found[1]
    assert {r[:4] for r in found[0]} == {(1, 1, 13, 13), (2, 1, 13, 13), (3, 1, 12, 13), (4, 3, 13, 13), (4, None, 13, 13), (5, 2, 13, 13), (None, 1, 13, 13)}
    assert all(r[4:] == (0, 0) for r in found[0] if r[0] in (1, 2, 4, 5, None))


def test_columns_with_the_names_that_operators_use(spark, corpus):
    taken = ["text_key", "row_key", "Row_Size", "row_pieces", "row_round", "RUN_DOC", "run_tag", "run_cut", "_row_key", "text_hash", "seed", "mark"]
    docs = corpus.select("doc_id", "text", "source", *(F.lit(f"{c} of it").alias(c) for c in taken))
    item = spark.createDataFrame([(1, prose(2, 60), "x")], "item_id long, text string, text_key string")
    mixed = mixing.taken_texts(docs, mixing.mix(docs))
    for out, plain in (
        (decontam.drop_contaminated(docs, item), decontam.drop_contaminated(corpus, item)),
        (minhash.drop_near_duplicates(docs), minhash.drop_near_duplicates(corpus)),
        (linededup.drop_repeated(docs).drop("n_units", "n_removed", "removed"), linededup.drop_repeated(corpus)),
        (mixed, mixing.taken_texts(corpus, mixing.mix(corpus))),
    ):
        assert out.columns == docs.columns
        got = out.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in plain.collect())
        assert all(r[c] == f"{c} of it" for r in got for c in taken)


def test_decontamination_of_nothing(spark, corpus, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(corpus, empty).collect() == []
    assert decontam.contaminated(nothing, empty).collect() == []
    assert decontam.contaminated(corpus, empty, broadcast_bytes=-1).collect() == decontam.contaminated(nothing, empty, broadcast_bytes=-1).collect() == []


# 4


def plain_features(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    marked = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_quality_features(spark, corpus):
    odd = spark.createDataFrame([(300, "a b c a b c\na b c\n\n \na b c\n", None, None, 0), (301, "# é|ü <x>\r\n# é|ü <x>\r", None, None, 0)], corpus.schema)
    rows = quality.features(corpus.unionByName(odd).withColumn("n_words", F.lit("x"))).collect()
    assert len(rows) == corpus.count() + 2
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_features(r.text)


def test_quality_model_finds_the_bad(spark):
    g = random.Random(6)
    good = [(i, prose(i, 150)) for i in range(120)]
    bad = [(1000 + i, " ".join(f"{w}$$$" for w in prose(i, g.randrange(80, 200)).split())) for i in range(12)]
    got = {r.doc_id: r.good for r in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def test_quality_of_nothing(nothing):
    assert quality.judge(nothing).collect() == []
    post, _ = quality.fit(np.zeros((0, 3), int), np.zeros(0))
    assert len(post) == 0


# 9


def language(seed, n, letters):
    g = random.Random(seed)
    return " ".join("".join(g.choice(letters) for _ in range(g.randrange(2, 7))) for _ in range(n))


def test_codewords():
    for n in range(0, 40):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
    code = langid.codewords(30)
    assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= 8


def test_languages(spark):
    alphabets = {"aa": "abcdeé", "bb": "bcdfgh", "cc": "efghiü", "dd": "ghijkl", "ee": "acegik", "ff": "bdfhjl"}
    rows = [(i, language(i, 40, alphabets[k]), k) for i, k in enumerate(list(alphabets) * 20)]
    train, test = rows[:60], rows[60:]
    schema = "doc_id long, text string, lang string"
    model = langid.train(spark.createDataFrame(train + [(1, None, "aa"), (2, "x", None)], schema))
    assert model.languages == sorted(alphabets)
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "aa"), (1003, "c", None), (1004, language(5, 40_000, alphabets["ff"]), "ff")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(test + odd, schema).withColumn("score", F.lit("x")), model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in test) >= 0.95 * len(test)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004].lang_pred == "ff"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_of_nothing(nothing, corpus):
    model = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(corpus, model).collect()} == {"und"}
    assert langid.identify(nothing, model).collect() == []


# 6


def test_targets():
    t = mixing.targets([100, 100, 100], [5, 2, 1], 450)
    assert t.tolist() == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 10], [1, 1], 1000).tolist() == [20, 20]
    assert mixing.targets([0, 10], [5, 1], 15).tolist() == [0, 15]


def test_shard_counts_use_up_the_quotas():
    quotas = np.array([1000, 0, 37, 400])
    rows = mixing.shard_counts(quotas, 100, 3)
    for s, q in enumerate(quotas):
        own = sorted((first, n) for _, x, first, n in rows if x == s)
        assert sum(n for _, n in own) == q and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    assert rows == mixing.shard_counts(quotas, 100, 3)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9))).collect()]
        assert sorted(got) == list(range(n))


def test_mix(spark, corpus):
    more = spark.createDataFrame([(500 + i, prose(60 + i, 300), "en", ["a", "b", "c", "d"][i % 4], 0) for i in range(40)], corpus.schema)
    docs = corpus.unionByName(more)
    m = mixing.mix(docs, block=16)
    rows = m.documents.collect()
    assert len(rows) == docs.count()
    assert all(r["size"] == len(words(t)) for r, t in zip(sorted(rows, key=lambda r: (str(r.doc_id), r["size"])), [x.text for x in sorted(docs.collect(), key=lambda r: (str(r.doc_id), len(words(r.text))))]))
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r["size"]
        assert r.taken <= 2 * r["size"]
    assert sum(s[2] for s in by.values()) == pytest.approx(min(1.5, 2) * sum(s[1] for s in by.values()))
    assert all(abs(t - aim) <= 40 and size == n for t, n, aim, size in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, block=16).documents.collect()))


def test_dealing_in_groups_uses_up_the_quotas(spark):
    quotas = np.array([100_000, 0, 37, 40_000])
    for most in (4, 1 << 18):
        rows = mixing.dealt(spark, quotas, 1000, 3, most).collect()
        assert max(r.shard for r in rows) == 140 and sorted(rows) == sorted(mixing.dealt(spark, quotas, 1000, 3, most).collect())
        for s, q in enumerate(quotas):
            own = sorted((r["first"], r.n) for r in rows if r.source_no == s)
            assert sum(n for _, n in own) == q and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        sizes = Counter()
        for r in rows:
            sizes[r.shard] += r.n
        assert sorted(sizes.values())[1:] == [1000] * 140


def test_taken_texts_hold_the_words_taken(spark, corpus):
    docs = corpus.unionByName(corpus).withColumn("n_chars", F.length("text"))  # every row twice or more
    m = mixing.mix(docs, block=16, bucket_rows=3)
    taken, got, texts = Counter(), Counter(), defaultdict(set)
    for r in m.documents.collect():
        taken[r.doc_id, r.source] += r.taken
    for r in docs.collect():
        texts[r.doc_id] |= set(words(r.text))
    for r in mixing.taken_texts(docs, m).collect():
        got[r.doc_id, r.source] += len(words(r.text))
        assert r.n_chars == len(r.text) and set(words(r.text)) <= texts[r.doc_id]
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_mix_of_nothing(nothing):
    m = mixing.mix(nothing)
    assert m.documents.collect() == [] and m.slots.collect() == []
