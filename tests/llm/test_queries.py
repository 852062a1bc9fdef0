"""The registered queries over small tables, against what their contracts say, in plain Python."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests_llm_prose import prose
from tidemark.llm.queries import END_ID, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    """A folder of tables and their rows; documents have repeated rows, null ids, null and empty texts."""
    folder = tmp_path_factory.mktemp("tables")
    docs = corpus.drop("_key")
    more = [(900 + i, prose(400 + i, 130) + (" #" * (60 * (i % 3 == 0))), ["en", "de"][i % 2], ["a", "b", "c", "d", None][i % 5]) for i in range(40)]
    more += [(990, prose(1, 120) + " " + prose(999, 20, 3000), "en", "a")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(folder / "documents.parquet"))
    html = [None, "", "same", "same", "<p>é</p>" * 50, "other", "same"]
    urls = ["http://www.Example.com/en/x", "https://a.net/es/1?x", None, "no scheme", "http://casino-win.org/", "http://sub.example.com/en/#t", "http://b.net/fr?z"]
    pages = [(i, u, h) for i, (u, h) in enumerate(zip(urls, html))] + [(None, "http://x.com", "same")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    spark.createDataFrame([(1, prose(999, 20, 3000)), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()], pages


def run(spark, tables, prefix):
    name = next(n for n in __spark_entry__.queries() if n.startswith(prefix))
    return __spark_entry__.queries()[name](spark, tables[0]).collect()


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def as_counts(rows):
    return Counter(map(str, rows))


def test_pages_as_records(spark, tables):
    got = run(spark, tables, "op1_")
    payloads = [(i, (h or "").encode()) for i, _, h in tables[2]]
    top = {}
    for i, b in payloads:
        top[b] = max(top.get(b, -1), -1 if i is None else i)
    want = [(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top[b] else "revisit", None if i == top[b] else top[b]) for i, b in payloads]
    assert as_counts((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == as_counts(want)


def test_urls_are_judged_by_rules_first(spark, tables):
    got = {r.page_id: r for r in run(spark, tables, "op2_")}
    assert len(got) == len(tables[2])
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("net/es/", "block") and (got[5].rule, got[5].verdict) == ("example.com/en/", "block")
    assert got[6].path == "/fr" and got[6].rule is None  # the rule's path ends with a slash
    assert (got[2].host, got[2].path, got[3].host, got[3].rule) == ("", "", "", None) and got[4].verdict == "block"


def test_token_ids_in_order(spark, tables):
    from tokenizers import Tokenizer

    tool, got = Tokenizer.from_file(tokenizer_path()), run(spark, tables, "op3_")
    assert len(got) == len(tables[1])
    digests = defaultdict(list)
    for i, t, _, _ in tables[1]:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, END_ID]
        digests[i].append((len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    mine = defaultdict(list)
    for r in got:
        mine[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in digests.items()}
    ordered, at = sorted(got, key=lambda r: r.start), 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)


def test_quality_base_columns(spark, tables):
    got = run(spark, tables, "op4_")
    want = []
    for i, t, _, _ in tables[1]:
        w = words(t)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        marked = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked), failed))
    assert as_counts((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == as_counts(want)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_contaminated_documents(spark, tables):
    assert {(r.doc_id, r.item_id) for r in run(spark, tables, "op5_")} == {(990, 1)}


def test_mixed_words(spark, tables):
    got = run(spark, tables, "op6_")
    sizes = Counter()
    for i, t, _, s in tables[1]:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    total, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    while open_:
        share = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        target.update({s: 2.0 * sizes[s] for s in over} if over else share)
        total -= sum(2.0 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    assert as_counts((r.doc_id, r["size"]) for r in got) == as_counts((i, len(words(t))) for i, t, _, _ in tables[1])
    taken = Counter()
    by_target = Counter((sizes[s], round(v, 3)) for s, v in target.items())  # sources may be alike
    for r in got:
        assert (r.source_size, round(r.target, 3)) in by_target and r.taken <= 2 * r["size"]
        taken[r.source_size, round(r.target, 3)] += r.taken
    assert not {k: n for k, n in taken.items() if abs(n - k[1] * by_target[k]) > 2 * 128 * by_target[k]}
    assert as_counts(got) == as_counts(run(spark, tables, "op6_"))


def test_language_model_columns(spark, tables):
    got = run(spark, tables, "op7_")
    tokens = lambda t: [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(t)), None]
    uni = Counter(x for i, t, _, _ in tables[1] if fold(i, 7) != 2 for x in tokens(t))
    n, v = sum(uni.values()), len(uni)
    want = [(i, fold(i, 7) == 2, len(tokens(t)), sum(x in uni for x in tokens(t)), n, round(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t, _, _ in tables[1]]
    assert as_counts((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == as_counts(want)
    assert all(r.score < 0 for r in got)


def test_line_dedup_cuts_texts(spark, tables):
    got = run(spark, tables, "op8_")
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in tables[1])
    whole = defaultdict(set)
    for i, t, _, _ in tables[1]:
        whole[i].add((len(words(t)), None if t is None else hashlib.md5(t.encode()).hexdigest()))
    for r in got:
        assert r.n_removed == sum(x["last"] - x["first"] for x in r.removed) <= r.n_words
        assert ((r.n_words, r.text_digest) in whole[r.doc_id]) == (r.n_removed == 0)
    assert {r.doc_id for r in got if r.n_removed} >= {4, 990}


def test_language_columns(spark, tables):
    got = run(spark, tables, "op9_")
    langs = {x for i, t, x, _ in tables[1] if x is not None and fold(i, 3) != 1}
    lettered = {i: re.search(r"[^\W\d_]", t or "") is not None for i, t, _, _ in tables[1]}
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, fold(i, 3) == 1) for i, *_ in tables[1])
    assert all((r.lang_pred in langs) if lettered[r.doc_id] else (r.lang_pred == "und") for r in got) and all(0 <= r.score <= 1 for r in got)


def test_classes_of_documents(spark, tables):
    got = run(spark, tables, "op10_")
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in tables[1])
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[1] == classes[2] == classes[0] == 0 and classes[8] == classes[7] == 7 and classes[900] == 900
