"""Byte-level BPE against the merge rule by brute force and against a library with the same ranks."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P

from tidemark.llm import bpe

RANKS = "byte_bpe_multi_50k.tiktoken"
ALPHABET = [" ", "  ", "\n", "\t", "a", "b", "é", "'s", "'ll", "1", "٣", "中", "　", "\x1c", "\x85", "!", "՘", "Ᲊ", "\U000143fa", "\U00011de0", "👍🏽", "the", "xyz", ".", "\r\n", "​", "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path(RANKS), "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.Coder(ranks, P.PATTERN)


def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def by_hand(piece: bytes, ranks) -> list[int]:
    """Merge the leftmost pair of least rank until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def made(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_merges_are_those_of_the_rule(ranks, coder):
    rnd = random.Random(3)
    few = {bytes([i]): i for i in range(256)}  # a vocabulary in which ties and chains of merges are common
    for t in (b"aa", b"ab", b"ba", b"aab", b"aaa", b"abab", b"bb", b"abb", b"aaaa", b"babab"):
        few[t] = len(few)
    small = bpe.Coder(few, P.PATTERN)
    for n in (1, 2, 3, 5, 8, 13, 31, 64):
        pieces = [bytes(rnd.choice(b"ab") for _ in range(n)) for _ in range(60)]
        want = [[few[p] for p in [piece]] if piece in few else by_hand(piece, few) for piece in pieces]
        assert [np.frombuffer(x, "<i4").tolist() for x in small.merged_short(pieces)] == [by_hand_from_bytes(p, few) for p in pieces]
        assert [bpe.merged_long(p, few) for p in pieces] == [by_hand_from_bytes(p, few) for p in pieces]
        assert [small.encode([p.decode()])[0].tolist() for p in pieces] == want
    words = [w.encode() for w in ("eauouonière", "straße", "überzahlung", "中文字符")]
    assert [np.frombuffer(coder.merged_short([w])[0], "<i4").tolist() for w in words] == [by_hand_from_bytes(w, ranks) for w in words]


def by_hand_from_bytes(piece: bytes, ranks) -> list[int]:
    """As by_hand, from single bytes on even if the piece is a token."""
    return by_hand(piece, {k: v for k, v in ranks.items() if k != piece or len(k) == 1}) if piece in ranks and not _reached(piece, ranks) else by_hand(piece, ranks)


def _reached(piece: bytes, ranks) -> bool:
    """Whether the merges of a token's bytes end in that token."""
    less = {k: v for k, v in ranks.items() if k != piece or len(k) == 1}
    left = by_hand(piece, less)
    return len(left) == 2


def test_texts_as_the_library_encodes_them(ranks, coder):
    texts = [*made(3000, 1), "", " ", "a" * 3000, "\n" * 3000 + "x", " " * 1000, "ab " * 10 + " ", "   the", "é" * 301, "one  two \n three\n", "x" * 65 + " " + "é" * 40]
    encode = library(ranks)
    got = coder.encode(texts)
    assert [x.tolist() for x in got] == [encode(t) for t in texts]
    assert [coder.decode(x) for x in got] == [t.encode() for t in texts]
    again = bpe.Coder(ranks, P.PATTERN)  # other company, other memory: the same ids
    assert [again.encode([t])[0].tolist() for t in texts[-200:]] == [x.tolist() for x in got[-200:]]


def test_classes_of_characters(ranks):
    """Each code point is a letter, a number or white space as for the library."""
    import tiktoken

    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    split = bpe.Coder(ranks, P.PATTERN).split
    for lead in ("a", "1", "\t"):
        own = {bytes([i]): i for i in range(256)}
        for c in points:
            own.setdefault((lead + c).encode(), len(own))
        encode = tiktoken.Encoding(f"class {ord(lead)}", pat_str=P.PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary
        assert [c for c in points if (len(encode(lead + c)) == 1) != (len(split(lead + c)) == 1)] == []


def test_table(spark, ranks):
    texts = ["the  cat", None, "", "the  cat", "é" * 300_000, *made(50, 2)]
    rows = [(i if i != 2 else None, t, "x", 1.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded double")
    vocabulary = P.path(RANKS)
    ids = bpe.encode(docs, vocabulary, P.PATTERN)
    assert ids.columns == ["doc_id", "text", "decoded", "ids"]
    got = bpe.decode(ids, vocabulary).collect()
    encode = library(ranks)
    for r in got:
        t = r.text or ""
        assert bytes(r.decoded) == t.encode()
        if len(t) < 1000:
            assert r.ids == encode(t)
    digests = {r.doc_id: r for r in bpe.digests(docs, vocabulary, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        if len(t or "") < 1000:
            want = encode(t or "")
            r = digests[i if i != 2 else None]
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digests(docs.limit(0), vocabulary, P.PATTERN).count() == 0
    none = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), vocabulary).collect()
    assert [bytes(r.decoded) for r in none] == [b"", b""]


def test_vocabularies_without_all_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.read_ranks(b"YQ== 0\n")
