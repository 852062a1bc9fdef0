"""Archives, token files, the language model, URL filters and the pipeline against plain Python."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import kneser_ney, tokenbin, urlfilter, warc
from tidemark.llm.queries import URL_RULES, tokenizer_path
from tidemark.llm.scratch import new_folder, open_folder
from tests_llm_prose import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/ x", "same"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "é\r\n\r\n<p>" * 5000), (6, "http://e/", "alone"), (7, "http://f/", "same"), (6, "http://e/", "alone")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_sha", F.lit(1))


def test_archives_round_trip(pages):
    got = warc.archive_digests(pages).collect()
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    top = defaultdict(int)
    for i, h in html.items():
        top[h] = max(top[h], i)
    assert len(got) == 8
    for r in got:
        h = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if top[h] == r.page_id else ("revisit", top[h]))


def test_index_selects_records(spark, pages):
    folder = new_folder(spark, "warc-test")
    index = warc.write_warc(pages, folder)
    some = index.where("page_id in (3, 5, 7)")
    for gap, most in ((0, 1 << 23), (1 << 16, 64)):
        got = {r.page_id: r for r in warc.read_warc(some, folder, most_gap=gap, most_bytes=most).collect()}
        assert set(got) == {3, 5, 7} and bytes(got[5].payload) == ("é\r\n\r\n<p>" * 5000).encode() and bytes(got[7].payload) == b"same"
    assert warc.byte_ranges(index).agg(F.sum(F.size("records"))).first()[0] == 8
    files, path = open_folder(folder)
    first = index.orderBy("file", "offset").first()
    raw = files.open_input_file(f"{path}/{first.file}").read_at(first.length, first.offset)
    assert zlib.decompress(raw, 31).startswith(b"WARC/1.1\r\n")


def test_archives_of_nothing(spark, pages):
    assert warc.archive_digests(pages.where("false")).collect() == []


# 3


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_words_encode_like_whole_texts():
    import pyarrow as pa

    from tidemark.llm import kernels as K

    texts = ["", " ", "a", " a", "a ", "a  b", "a \nb c", "x\n y z", "don't 's it's 12 a1b", "<|endoftext|> hi <|endoftext|>", "a <|endoftext|>b c", "é ü\u00a0x y", "a\tb c\n\nd e ", "\n", "\u3000wide \u3000x y\u3000 z", "one\x1c two three", "“q” said ‘so’ … and", "word " * 50, prose(1, 500)]
    tool = tokenbin.WordEncoder(tokenizer_path(), most=100)
    for _ in range(3):
        for i, j, data, offsets in K.chunks(pa.array(texts)):
            ids, n = tool(data, offsets)
            cut = [0, *n.cumsum().tolist()]
            assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == reference(texts[i:j])


def test_token_files(corpus):
    docs = corpus.where("doc_id is not null")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    got = tokenbin.token_digests(docs, tokenizer_path(), 2).orderBy("start").collect()
    at = 0
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, ids in zip(got, reference([t for _, t in rows])):
        raw = struct.pack(f"<{len(ids) + 1}I", *ids, 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, zlib.crc32(raw))
        at += len(ids) + 1


def test_readers_unpack_only_what_they_need(spark, corpus):
    folder = new_folder(spark, "tokens-test")
    index = tokenbin.write_tokens(corpus, folder, tokenizer_path(), 2, frame_tokens=64, file_tokens=2000)
    r = index.where("doc_id = 12").first()
    files, path = open_folder(folder)
    reader = tokenbin.FrameReader(files.open_input_file(f"{path}/{r.file}"))
    raw = reader.ids(r.place, r.n_tokens)
    assert len(raw) == 4 * r.n_tokens and reader.frames_read <= r.n_tokens // 64 + 2
    some = tokenbin.read_tokens(index.where("doc_id in (3, 9)"), folder).collect()
    assert {x.doc_id for x in some} == {3, 9} and all(len(x.ids) == 4 * x.n_tokens for x in some)
    import zstandard

    whole = files.open_input_file(f"{path}/{r.file}").read()
    assert len(zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()) % 4 == 0  # a plain zstandard file, too
    bad = bytearray(whole)
    bad[10] ^= 1
    import pyarrow as pa

    with pytest.raises(Exception):
        tokenbin.FrameReader(pa.BufferReader(bytes(bad))).ids(0, 10)


def test_token_files_of_nothing(nothing):
    assert tokenbin.token_digests(nothing, tokenizer_path(), 2).collect() == []


# 7


def plain_model(token_lists, order):
    """Counts of single tokens and p(context, token), by the formulas, with tuples as n-grams."""
    uni, counts = Counter(), {m: Counter() for m in range(1, order + 1)}
    for w in token_lists:
        uni.update(w)
        row = ["<s>"] * (order - 1) + w
        counts[order].update(tuple(row[i : i + order]) for i in range(len(w)))
    for m in range(order, 1, -1):
        for g, n in counts[m].items():
            counts[m - 1][g[1:]] += n if g[1] == "<s>" else 1
    d, ctx = {}, {m: defaultdict(lambda: [0, 0, 0, 0]) for m in counts}
    for m, c in counts.items():
        d[m] = [0, *kneser_ney.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))]
        for g, n in c.items():
            ctx[m][g[:-1]][0] += n
            ctx[m][g[:-1]][min(n, 3)] += 1

    def p(context, token, m=order):
        context = tuple(context)[len(context) - m + 1 :]
        low = p(context[1:], token, m - 1) if m > 1 else 1 / (len(uni) + 1)
        if context not in ctx[m]:
            return low
        x, n = ctx[m][context], counts[m][(*context, token)]
        return max(n - d[m][min(n, 3)], 0) / x[0] + sum(d[m][k] * x[k] for k in (1, 2, 3)) / x[0] * low

    return uni, p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, corpus, order):
    more = spark.createDataFrame([(600 + i, prose(80 + i, 150, 20).upper(), "en", "a", 0) for i in range(30)], corpus.schema)
    docs = corpus.unionByName(more).withColumn("score", F.lit(0))
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    tokens = lambda t: [*(w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))), None]
    uni, p = plain_model([tokens(r.text) for r in docs.where(~held).collect()], order)
    n, v = sum(uni.values()), len(uni)
    model = kneser_ney.train(docs.where(~held), order, per_shard=64)
    assert (model.total, model.distinct) == (n, v) and model.bits > 1
    for r in kneser_ney.score(docs, model).collect():
        w = tokens(r.text)
        row = ["<s>"] * (order - 1) + w
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in uni for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(row[i : i + order - 1], x)) for i, x in enumerate(w)))
    some = [["w1x", "w2x", "w3x"], ["w3x", "w1x", None], ["<s>", "<s>", "<s>"], ["<s>", "<s>", "w1x"], ["never seen", "w1x", "w2x"]]
    for context in some:
        context = context[4 - order :]
        assert sum(p(context, b) for b in uni) + p(context, "never seen") == pytest.approx(1)


def test_language_model_of_nothing(nothing, corpus):
    model = kneser_ney.train(nothing)
    assert model.total == 0
    assert {r.n_known for r in kneser_ney.score(corpus, model).collect()} == {0}
    assert kneser_ney.score(nothing, model).collect() == []


# 2


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Shop.COM/en/?q#f", "https://example.com/en/1", "https://www.example.com/en/1", "https://m.www.example.com/en/", "https://example.com/de/1", "http://notexample.com/en/", "http://a.net/es/x", "http://net/fr/", "http://a.net/fr", "http://a.net?x=/fr/", "http://best-casino.top/casino/buy-now/77", "http://É.com/\nx", "a://b://c/d", "http://x.org/articles/" + "9" * 5000]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(0))
    trained = urlfilter.train(urlfilter.labelled_urls(spark))
    got = {r.page_id: r for r in urlfilter.judge(rows, URL_RULES, trained).collect()}
    for i, u in enumerate(urls):
        host, path = plain_url(u)
        fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path) == (host, path), u
        assert got[i].rule == (max(fit)[1] if fit else None), u
        assert got[i].verdict == (max(fit)[2] if fit else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert got[14].verdict == "block" and got[17].verdict == "allow"


def test_url_model_on_sites_it_has_not_seen(spark):
    labelled = urlfilter.labelled_urls(spark).withColumn("held", F.pmod(F.xxhash64("site"), F.lit(5)) == 0)
    got = urlfilter.judge(labelled.where("held"), [], urlfilter.train(labelled.where("not held"))).groupBy("label", "verdict").count().collect()
    n = {(r.label, r.verdict): r["count"] for r in got}
    assert n[1.0, "block"] >= 0.8 * (n[1.0, "block"] + n.get((1.0, "allow"), 0))
    assert n[1.0, "block"] >= 0.95 * (n[1.0, "block"] + n.get((0.0, "block"), 0))


# pipeline


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline as C

    (tmp_path / "d").mkdir()
    docs = corpus.where("doc_id is not null").drop("_key").dropDuplicates(["doc_id", "text"])
    more = spark.createDataFrame([(700 + i, prose(100 + i, 120), "en", ["a", "b"][i % 2]) for i in range(20)] + [(800, prose(200, 40, 3000) + " " + prose(300, 30, 5000), "en", "a")], docs.schema)
    docs = docs.unionByName(more).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    docs.write.parquet(str(tmp_path / "d/documents.parquet"))
    spark.createDataFrame([(1, prose(300, 30, 5000))], "item_id long, text string").write.parquet(str(tmp_path / "d/benchmark.parquet"))
    sf, now, kept = str(tmp_path / "d"), spark.read.parquet(str(tmp_path / "d/documents.parquet")), []
    columns = now.columns
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
        assert k == 4 or now.columns == columns, name
    assert not kept[0] & {5, 6, 10}  # no letters
    assert kept[0] >= {0, 3, 4, 12} and not kept[1] & {1, 2} and 0 in kept[1]
    assert 800 in kept[1] and 800 not in kept[2] and kept[2] == kept[1] - {800}
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert now.agg(F.sum("n_tokens")).first()[0] == now.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
    assert C.run(spark, sf).select("doc_id", "n_tokens", "ids_crc32").exceptAll(now.select("doc_id", "n_tokens", "ids_crc32")).count() == 0


def test_registered_queries():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
