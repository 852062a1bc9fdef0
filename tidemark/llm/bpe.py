"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

A text is split by a pattern; each piece that is a token is that token, every other one starts as
its single bytes, and the neighbours whose union has the lowest rank are merged, the leftmost among
equals, until no union is a token. The pairs of a piece lie in a segment tree over its byte
positions: a leaf holds rank and position of the pair that starts there, a node the least of its
children, the root the next merge. A merge changes three leaves: the pair that starts at the merged
token, the one that ends at it, and the dead position of the right half; each is carried up in
logarithmic time. Short pieces are merged many at a time, one row of a matrix of trees each; a long
piece has a tree of its own.

Between single spaces a text is split as its parts are, each with its space, as no piece holds a
space behind its first character unless it is white space as a whole. So the ids of these parts are
remembered by each worker, up to a bound, and texts with other white space at a part's border are
split whole.
"""

from __future__ import annotations

import base64
import unicodedata
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.kernels import tidied

#: Letters and numbers that Unicode 16.0 has and 15.1 lacks, as ranges of code points.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

#: Pieces up to so many bytes are merged side by side.
SHORT = 64
#: A worker remembers the ids of so many parts, of so many characters each at most.
MOST_PARTS, LONGEST_PART = 500_000, 64
#: Texts are taken together up to so many characters.
CHARS = 2_000_000

NONE = np.iinfo(np.int64).max


def unicode_16(pattern: str) -> str:
    """The pattern with \\p{L} and \\p{N} as Unicode 16.0 has them, for the regex module, whose tables are newer."""
    import regex

    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, added in (("L", LETTERS_16), ("N", NUMBERS_16)):
        late = [c for c in regex.findall(rf"\p{{{kind}}}", everything) if unicodedata.category(c)[0] != kind and not any(a <= ord(c) <= b for a, b in added)]
        runs: list[list[int]] = []
        for x in map(ord, late):
            if runs and x == runs[-1][1] + 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        if runs:
            without = "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in runs)
            own = rf"[\p{{{kind}}}--[{without}]]"
            inside = rf"\p{{{kind}}}"
            # outside of a class the property stands alone, inside of a negated one the late ones are let in
            pattern = pattern.replace(rf"[^\s\p{{L}}\p{{N}}]", "\0").replace(inside, own).replace("\0", r"[^\s\p{L}\p{N}]")
    letters = own_class(pattern, "L")
    numbers = own_class(pattern, "N")
    return "(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]")


def own_class(pattern: str, kind: str) -> str:
    """The class that stands for a property in a pattern."""
    at = pattern.find(rf"[\p{{{kind}}}--[")
    return rf"\p{{{kind}}}" if at < 0 else pattern[at : pattern.index("]]", at) + 2]


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("a vocabulary of bytes needs all 256 of them")
    return ranks


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece of any length: a segment tree in a list, bytes of segments by their ends."""
    n = len(piece)
    width = 1 << max(n - 1, 1).bit_length()
    shift = width.bit_length() - 1
    none = 1 << 62
    tree = [none] * (2 * width)
    end = list(range(1, n + 1))  # of the segment that starts at i
    before = list(range(-1, n - 1))  # start of the segment before
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << shift | i
    for j in range(width - 1, 0, -1):
        a, b = tree[2 * j], tree[2 * j + 1]
        tree[j] = a if a < b else b

    def put(i: int, value: int) -> None:
        j = width + i
        tree[j] = value
        while j > 1:
            other = tree[j ^ 1]
            j >>= 1
            least = value if value < other else other
            if tree[j] == least:
                return
            tree[j] = value = least

    while tree[1] < none:
        i = tree[1] & width - 1
        j = end[i]
        k = end[j]
        end[i] = k
        put(j, none)
        if k < n:
            before[k] = i
            rank = ranks.get(piece[i : end[k]])
        else:
            rank = None
        put(i, none if rank is None else rank << shift | i)
        h = before[i]
        if h >= 0:
            rank = ranks.get(piece[h:k])
            put(h, none if rank is None else rank << shift | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Coder:
    """Encodes and decodes texts by a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(unicode_16(pattern)).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.known: dict[str, bytes] = {}  # ids of a part with a space before it, four bytes each
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)])
        # rank of the union of two tokens, by the pair's number
        self.base = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.unions = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def _union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's union; NONE where it is no token."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        want = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.unions[at], NONE)

    def merged_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, four bytes each, of pieces of up to SHORT bytes: a row of each array is a piece, a column a byte position."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        width = 1 << int(max(lengths.max() - 1, 1)).bit_length()
        shift = width.bit_length() - 1
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = self.byte_ids[data]
        after = np.tile(np.arange(1, width + 1), (n, 1))  # start of the next segment; from the piece's end on there is none
        before = np.tile(np.arange(-1, width), (n, 1))[:, : width + 1]
        tree = np.full((n, 2 * width), NONE)
        rank = self._union(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        ok = (np.arange(1, width)[None] < lengths[:, None]) & (rank != NONE)
        tree[:, width:-1] = np.where(ok, rank << shift | np.arange(width - 1)[None], NONE)
        level = width
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = width + at
            tree[row, node] = value
            while node.size and node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def fresh(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """The leaf of the pair of segments that start at left and right."""
            there = right < lengths[row]
            found = self._union(token[row, left], token[row, np.minimum(right, width - 1)])
            put(row, left, np.where(there & (found != NONE), np.where(found != NONE, found, 0) << shift | left, NONE))

        live = np.flatnonzero(tree[:, 1] != NONE)
        while live.size:
            top = tree[live, 1]
            i = top & width - 1
            j = after[live, i]
            k = after[live, j]
            token[live, i] = top >> shift
            token[live, j] = -1
            after[live, i] = k
            before[live, np.minimum(k, width)] = i
            put(live, j, np.full(len(live), NONE))
            fresh(live, i, k)
            h = before[live, i]
            some = np.flatnonzero(h >= 0)
            fresh(live[some], h[some], i[some])
            live = live[tree[live, 1] != NONE]
        token[np.arange(width)[None] >= lengths[:, None]] = -1
        flat = token[token >= 0].astype("<i4").tobytes()
        ends = (4 * np.cumsum((token >= 0).sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _coded(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of each piece, four bytes each."""
        ids: dict[str, bytes] = {}
        short: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8")
            own = self.ranks.get(raw)
            if own is not None:
                ids[p] = own.to_bytes(4, "little")
            elif len(raw) > SHORT:
                ids[p] = np.array(merged_long(raw, self.ranks), "<i4").tobytes()
            else:
                group = short.setdefault((len(raw) - 1).bit_length(), ([], []))
                group[0].append(p)
                group[1].append(raw)
        for names, raws in short.values():
            for at in range(0, len(raws), 8192):
                ids.update(zip(names[at : at + 8192], self.merged_short(raws[at : at + 8192])))
        return ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are split whole."""
        parts = [self.split(t) for t in texts]
        ids = self._coded(set(chain.from_iterable(parts)))
        return [b"".join(map(ids.__getitem__, part)) for part in parts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [t.split(" ") for t in texts]  # the first part has no space before it, every other one has
        wanted = set(chain.from_iterable(c[1:] for c in cut)).difference(self.known)
        if len(self.known) + len(wanted) > MOST_PARTS:
            self.known.clear()
            wanted = set(chain.from_iterable(c[1:] for c in cut))
        words, mixed = [], []
        for x in wanted:
            if x.isalpha():
                words.append(x)
            elif x and not x[0].isspace() and not x[-1].isspace():  # else it does not stand alone
                mixed.append(x)
        ids = self._coded({" " + x for x in words})
        known = self.known
        known.update((x, ids[" " + x]) for x in words)
        known.update(zip(mixed, self._whole([" " + x for x in mixed])))
        heads = self._whole([c[0] if len(c) == 1 or not c[0][-1:].isspace() else "" for c in cut])
        out: list[bytes | None] = []
        for head, c in zip(heads, cut):
            try:
                if len(c) > 1 and (not c[0] or c[0][-1].isspace()):
                    raise KeyError
                out.append(head + b"".join(map(known.__getitem__, c[1:])))
            except KeyError:
                out.append(None)
        left = [i for i, x in enumerate(out) if x is None]
        for at, got in zip(left, self._whole([texts[i] for i in left])):
            out[at] = got
        for x in [x for x in wanted if len(x) > LONGEST_PART]:
            known.pop(x, None)
        return [np.frombuffer(x, "<i4") for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_coders: dict[int, Coder] = {}


def _coder(raw: bytes, pattern: str) -> Coder:
    """The coder of this worker for a vocabulary; one is kept."""
    key = hash((raw, pattern))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(read_ranks(raw), pattern)
    return _coders[key]


def _stretches(sizes: list[int]):
    """(from, to) of runs of up to CHARS characters, one text at least."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > CHARS:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` plus ids (array of int): the tokens of its text, without special tokens.

    ``vocabulary`` is a path on the driver, of a file with base64 and rank in each line, and goes to
    the workers as it is. A null or empty text has no ids, in an empty array; whole texts are
    encoded, of any length; repeated rows are encoded alike; an empty table stays empty. A column
    named ids is replaced, other names are free.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    read_ranks(raw)  # fails here rather than in tasks
    shared = docs.sparkSession.sparkContext.broadcast(raw)  # bounded: one vocabulary
    given = docs.drop("ids")
    names = [*given.columns, "ids"]

    def run(batches):
        import pyarrow as pa

        coder = _coder(shared.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in _stretches([len(t) for t in texts]):
                ids = coder.encode(texts[i:j])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, column], names)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema)
    return given.mapInArrow(tidied(run), f"{fields}ids array<int>")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``tokens`` plus decoded (binary): the bytes of its ids; of null ids or none, no bytes.

    An id that the vocabulary lacks ends the job. A column named decoded is replaced.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    shared = tokens.sparkSession.sparkContext.broadcast(raw)
    given = tokens.drop("decoded")
    names = [*given.columns, "decoded"]

    def run(batches):
        import pyarrow as pa

        tokens_of = {i: t for t, i in read_ranks(shared.value).items()}.__getitem__
        for batch in batches:
            ids = batch.column("ids")
            sizes = [len(x) if x.is_valid else 0 for x in ids]
            for i, j in _stretches(sizes):
                decoded = [b"".join(map(tokens_of, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in ids.slice(i, j - i)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(decoded, pa.binary())], names)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema)
    return given.mapInArrow(tidied(run), f"{fields}decoded binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids of each text and of the bytes that they decode to."""
    ids = encode(docs.select("doc_id", "text"), vocabulary, pattern).drop("text")
    both = decode(ids, vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
