"""Hard negatives by dual-tree search for inner products.

Vectors are floored to whole numbers, so scores are exact. A ball tree splits all rows: its upper
part is fitted to a bounded sample and deals the rows to leaves; a leaf's rows (in chunks by hash
where they are many) go through a task that splits them further into blocks of bounded size, each
with its centre and radius. The anchors, a stated query set, are dealt to groups by the same tree.

A search lays a group's tree of anchors beside a slab's tree of blocks. Of two nodes with centres a,
c and radii r, s every inner product lies within a.c +- (|a| s + |c| r + r s); whatever that interval
cannot reach for any anchor below the node is passed over at once, for all of them, and pairs of
leaves are scored exactly. The same test on whole slabs decides which are sent to a group. What an
anchor still needs is bounded from the start by the scores of the sample's rows, all of which are
rows of the table.

The first search finds each anchor's best rows of its own label; they set, per positive, the
interval in which negatives may score; the second finds the best rows of other labels within it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.scratch import new_folder, written

#: Rows of the sample that fits the upper tree and bounds the searches (a top list by hash: 16,384 vectors reach the driver).
SAMPLE = 16_384
#: Rows of a block, of a slab (a chunk of a leaf), anchors of a group, anchors of a leaf of a group's tree.
BLOCK, SLAB, GROUP, ANCHOR_LEAF = 512, 65_536, 8192, 32
#: Slabs there are at least, so that a cluster has tasks, leaves at most, and parts of the slabs to which teams are sent.
LEAST_SLABS, MOST_LEAVES, PARTS = 64, 4096, 64
#: Over every score.
NEVER = 2**62


def pack(m: np.ndarray) -> tuple[bytes, str]:
    """A matrix of whole numbers in the smallest type that holds it."""
    top = int(np.abs(m).max()) if m.size else 0
    kind = next(k for k, most in (("<i2", 2**15 - 1), ("<i4", 2**31 - 1), ("<i8", 2**64)) if top <= most)
    return np.ascontiguousarray(m.astype(kind)).tobytes(), kind


def unpack(raw: bytes, kind: str, n: int) -> np.ndarray:
    m = np.frombuffer(raw, kind).astype(np.int64)
    return m.reshape(n, -1) if n else m.reshape(0, 0)


def wide(m: np.ndarray, dim: int) -> np.ndarray:
    """With zeros for the components that shorter vectors lack."""
    return m if m.shape[1] == dim else np.hstack([m, np.zeros((len(m), dim - m.shape[1]), m.dtype)])


def matrix(column) -> np.ndarray:
    """Rows of an Arrow column of lists, filled up with zeros."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    m = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    m[np.arange(m.shape[1])[None] < sizes[:, None]] = lists.flatten().to_numpy()
    return m


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles where no sum can leave their whole numbers, else in 64-bit integers (which wrap)."""
    most = (float(np.abs(a).max()) if a.size else 0.0) * (float(np.abs(b).max()) if b.size else 0.0) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


@dataclass
class Tree:
    """Splits by hyperplanes: node i has the children 2 i + 1 and 2 i + 2; leaves are numbered from the left."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaf(self, m: np.ndarray, depth: int | None = None) -> np.ndarray:
        at = np.zeros(len(m), np.int64)
        x = wide(m, self.planes.shape[1])[:, : self.planes.shape[1]].astype(float) if self.depth else m
        for _ in range(self.depth if depth is None else depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.planes[at]) > self.cuts[at])
        return at - ((1 << (self.depth if depth is None else depth)) - 1)


def split(m: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction in which the rows lie apart, and their median in it: from the row farthest from the mean to the one farthest from that."""
    one = m[np.argmax(((m - m.mean(0)) ** 2).sum(1))]
    two = m[np.argmax(((m - one) ** 2).sum(1))]
    plane = (two - one).astype(float)
    return plane, float(np.median(m @ plane))


def fit_tree(sample: np.ndarray, depth: int) -> Tree:
    n = (1 << depth) - 1
    planes, cuts = np.zeros((n, sample.shape[1])), np.zeros(n)
    members = {0: np.arange(len(sample))}
    x = sample.astype(float)
    for i in range(n):
        own = members.pop(i, np.zeros(0, np.int64))
        if len(own) > 1:
            planes[i], cuts[i] = split(x[own])
        right = x[own] @ planes[i] > cuts[i]
        members[2 * i + 1], members[2 * i + 2] = own[~right], own[right]
    return Tree(planes, cuts, depth)


def pieces(m: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in parts of up to ``size`` that lie together, by splits at medians; equal rows are cut anyhow."""
    todo, out = [np.arange(len(m))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        plane, _ = split(m[own].astype(float))
        order = np.argsort(m[own] @ plane, kind="stable")
        half = len(own) // 2
        todo += [own[order[half:]], own[order[:half]]]
    return out


def ball(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre, and a radius that surely holds all rows."""
    x = m.astype(float)
    centre = x.mean(0) if len(x) else np.zeros(m.shape[1])
    return centre, float(np.sqrt(((x - centre) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-6 if len(x) else 0.0


class Balls:
    """A binary tree of balls over leaves in order; node 1 is the root, the children of i are 2 i and 2 i + 1."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray):
        n = len(radii)
        self.width = 1 << max(n - 1, 0).bit_length()
        self.centres, self.radii = np.zeros((2 * self.width, centres.shape[1])), np.full(2 * self.width, -1.0)  # -1: nothing below
        self.centres[self.width : self.width + n], self.radii[self.width : self.width + n] = centres, radii
        for i in range(self.width - 1, 0, -1):
            a, b = 2 * i, 2 * i + 1
            if self.radii[b] < 0:
                self.centres[i], self.radii[i] = self.centres[a], self.radii[a]
                continue
            c = (self.centres[a] + self.centres[b]) / 2
            self.centres[i] = c
            self.radii[i] = max(np.sqrt(((c - self.centres[x]) ** 2).sum()) + self.radii[x] for x in (a, b)) * (1 + 1e-9)
        self.norms = np.sqrt((self.centres**2).sum(1))


def interval(centre: np.ndarray, radius: float, other: np.ndarray, reach: float) -> tuple[float, float]:
    """Between what the inner products of two balls' rows lie, with room for rounding."""
    mid = float(centre @ other)
    width = float(np.sqrt(centre @ centre)) * reach + float(np.sqrt(other @ other)) * radius + radius * reach
    width += 1 + 1e-9 * (abs(mid) + width)
    return mid - width, mid + width


def search(anchors: Balls, blocks: Balls, floor: np.ndarray, ceiling: np.ndarray, score) -> None:
    """Walks over pairs of nodes, the higher end of the interval first.

    ``floor``: what each leaf of anchors still needs, read anew at each pair, as ``score(anchor leaf,
    block)`` may raise it; ``ceiling``: what it takes at most.
    """
    todo = [(1, 1)]
    lows, highs = np.full(2 * anchors.width, np.inf), np.full(2 * anchors.width, -np.inf)

    def refresh() -> None:
        lows[anchors.width : anchors.width + len(floor)] = floor
        highs[anchors.width : anchors.width + len(ceiling)] = ceiling
        for i in range(anchors.width - 1, 0, -1):
            lows[i], highs[i] = min(lows[2 * i], lows[2 * i + 1]), max(highs[2 * i], highs[2 * i + 1])

    refresh()
    while todo:
        a, c = todo.pop()
        if anchors.radii[a] < 0 or blocks.radii[c] < 0:
            continue
        low, high = interval(anchors.centres[a], anchors.radii[a], blocks.centres[c], blocks.radii[c])
        if high < lows[a] or low > highs[a]:
            continue
        if a >= anchors.width and c >= blocks.width:
            leaf = a - anchors.width
            before = floor[leaf]
            score(leaf, c - blocks.width)
            if floor[leaf] > before:  # its ancestors' floors may rise
                i = a
                lows[i] = floor[leaf]
                while i > 1:
                    i >>= 1
                    lows[i] = min(lows[2 * i], lows[2 * i + 1])
            continue
        if c >= blocks.width or a < anchors.width and anchors.radii[a] > blocks.radii[c]:
            below = [(2 * a, c), (2 * a + 1, c)]
        else:
            below = [(a, 2 * c), (a, 2 * c + 1)]
        todo += sorted(below, key=lambda p: float(anchors.centres[p[0]] @ blocks.centres[p[1]]))  # the nearer one is popped first


# tables -----------------------------------------------------------------------------------------


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and q, the floored components, of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    r = rows.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    return r.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("q"))


def single(rows: DataFrame) -> DataFrame:
    """Of rows that share a vec_id the one with the smallest label and vector."""
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.*")


@dataclass
class Index:
    """Blocks of all rows (a table), the upper tree, and the sample."""

    blocks: DataFrame
    slabs: DataFrame
    tree: Tree
    sample: tuple  # ids, labels, matrix
    rows: DataFrame
    dim: int


def index(rows: DataFrame, folder: str, sample: int = SAMPLE, block: int = BLOCK, slab: int = SLAB, least_slabs: int = LEAST_SLABS) -> Index:
    """Deals all ``rows`` (vec_id, label, q; one per vec_id) to blocks. Every row stands in one block."""
    rows = written(rows, folder, "rows")
    spark = rows.sparkSession
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim")).first()
    n, dim = facts["n"], max(1, facts["dim"] or 0)  # empty vectors are zeros
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    ids, labels = got.column("vec_id").to_numpy(), got.column("label").to_numpy()
    m = wide(matrix(got.column("q")), dim)
    leaves = min(MOST_LEAVES, max(least_slabs, n // slab))
    depth = max(0, min(leaves - 1, len(ids) // 4).bit_length())
    tree = fit_tree(m, depth)
    shared = spark.sparkContext.broadcast(tree)  # bounded: MOST_LEAVES planes

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            own = wide(matrix(batch.column("q")), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf(own) if len(own) else [], pa.int64())], ["vec_id", "label", "q", "leaf"])

    dealt = written(rows.mapInArrow(deal, "vec_id long, label long, q array<long>, leaf long"), folder, "dealt")
    counts = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / slab).alias("_chunks"))  # a row per leaf, MOST_LEAVES at most
    chunk = F.pmod(F.xxhash64("vec_id"), "_chunks")
    ready = dealt.join(F.broadcast(counts), "leaf").withColumn("slab", F.col("leaf") * (1 << 40) + chunk).select("slab", "vec_id", "label", "q")

    def build(table):
        import pyarrow as pa

        own = wide(matrix(table.column("q")), dim)
        number, kinds = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        centre, radius = ball(own)
        out = []
        for at, part in enumerate(pieces(own, block)):
            part = np.sort(part)
            raw, kind = pack(own[part])
            c, r = ball(own[part])
            out.append({"slab": table.column("slab")[0].as_py(), "block": at, "n": len(part), "ids": number[part].astype("<i8").tobytes(), "labels": kinds[part].astype("<i8").tobytes(), "kind": kind, "vectors": raw, "centre": c.tolist(), "radius": r, "slab_centre": centre.tolist() if at == 0 else None, "slab_radius": radius})
        return pa.Table.from_pylist(out, schema=pa.schema([("slab", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("slab_centre", pa.list_(pa.float64())), ("slab_radius", pa.float64())]))

    blocks = ready.groupBy("slab").applyInArrow(build, "slab long, block long, n long, ids binary, labels binary, kind string, vectors binary, centre array<double>, radius double, slab_centre array<double>, slab_radius double")
    blocks = written(blocks, folder, "blocks")
    slabs = blocks.where("block = 0").select("slab", "slab_centre", "slab_radius")
    return Index(blocks, slabs, tree, (ids, labels, m), rows, dim)


def top(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` of each key by score, ties by vec_id, with rank; Spark cuts to n before and after its shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_within(index: Index, anchors: DataFrame, folder: str, n: int, own_label: bool, group: int = GROUP) -> DataFrame:
    """(anchor_id, window, vec_id, score): of each slab the candidates for the first ``n`` rows in each of an anchor's windows.

    ``anchors``: vec_id, label, q and windows, an array of (window, low, high): whole scores from low
    to high count, of rows with the anchor's label (``own_label``) or any other. The rows left are
    those that may be among the first n of all; ``top`` picks these.
    """
    dim = index.dim
    sample = index.rows.sparkSession.sparkContext.broadcast((index.tree, index.sample))
    n_anchors = anchors.count()
    depth = min(index.tree.depth, max(0, -(-n_anchors // group) - 1).bit_length())

    def start(batches):
        """The group, and what the sample's rows already reach in each window."""
        import pyarrow as pa

        tree, (ids, labels, m) = sample.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = wide(matrix(batch.column("q").slice(at, 256)), dim)
                part = batch.slice(at, 256).to_pylist()
                score = products(own, m) if len(m) else np.zeros((len(part), 0), np.int64)
                at_leaf = tree.leaf(own, depth)
                out = []
                for i, r in enumerate(part):
                    fits = (labels == r["label"]) == own_label
                    fits &= ids != r["vec_id"]
                    got = np.sort(score[i][fits])[::-1]
                    windows = []
                    for w in r["windows"]:
                        inside = got[(got >= w["low"]) & (got <= w["high"])]
                        windows.append({"window": w["window"], "low": max(w["low"], int(inside[n - 1])) if len(inside) >= n else w["low"], "high": w["high"]})
                    out.append({"team": int(at_leaf[i]), "vec_id": r["vec_id"], "label": r["label"], "q": r["q"], "windows": windows})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("team", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("q", pa.list_(pa.int64())), ("windows", pa.list_(pa.struct([("window", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])))]))

    started = written(anchors.select("vec_id", "label", "q", "windows").mapInArrow(start, "team long, vec_id long, label long, q array<long>, windows array<struct<window long, low long, high long>>"), folder, "anchors")
    chunks = started.groupBy("team").agg(F.ceil(F.count("*") / group).alias("_chunks"))
    teams = started.join(F.broadcast(chunks), "team").withColumn("team", F.col("team") * (1 << 20) + F.pmod(F.xxhash64("vec_id"), "_chunks")).drop("_chunks")
    lowest = F.array_min(F.transform("windows", lambda w: w["low"]))
    highest = F.array_max(F.transform("windows", lambda w: w["high"]))
    # what the teams of anchors span: the box of their vectors, as centre and radius
    flat = teams.select("team", lowest.alias("low"), highest.alias("high"), F.posexplode(F.when(F.size("q") > 0, F.col("q")).otherwise(F.array(F.lit(0).cast("long")))).alias("i", "x")).groupBy("team", "i").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("m"))
    boxes = flat.groupBy("team").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a", "b"))), lambda s: F.struct(((s["a"] + s["b"]) / 2).alias("c"), ((s["b"] - s["a"]) / 2).alias("h"))).alias("box"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("m").alias("m"), F.min("m").alias("least"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    norm = lambda xs, f: F.sqrt(add(F.transform(xs, lambda x: f(x) * f(x))))
    # the teams of the query set, one row each, are sent to all parts of the slabs; pairs out of reach go
    parted = index.slabs.select("slab", F.col("slab_centre").alias("centre"), F.col("slab_radius").alias("radius"), F.pmod(F.xxhash64("slab"), F.lit(PARTS)).alias("part"))
    pairs = parted.join(boxes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), "part")
    dot = add(F.zip_with("box", "centre", lambda b, c: F.coalesce(b["c"], F.lit(0.0)) * F.coalesce(c, F.lit(0.0))))
    reach = norm("box", lambda b: b["c"]) * F.col("radius") + norm("centre", lambda c: c) * norm("box", lambda b: b["h"]) + F.col("radius") * norm("box", lambda b: b["h"])
    reach = (reach + F.abs(dot)) * 1e-9 + reach + 1
    # shorter vectors count as filled with zeros, which a box of their own components alone may miss
    whole = (F.size("box") == dim) & (F.col("m") == F.col("least"))
    pairs = pairs.where(~whole | (dot + reach >= F.col("low")) & (dot - reach <= F.col("high")))
    pairs = written(pairs.select("slab", "team"), folder, "pairs")

    def both(left, right):
        import pyarrow as pa

        schema = pa.schema([("anchor_id", pa.int64()), ("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        m, own = wide(matrix(left.column("q")), dim), left.select(["vec_id", "label", "windows"]).to_pylist()
        parts = right.select(["n", "ids", "labels", "kind", "vectors", "centre", "radius", "block"]).to_pylist()
        if not own or not parts:
            return schema.empty_table()
        return pa.table(_slab(own, m, sorted(parts, key=lambda p: p["block"]), dim, n, own_label), schema=schema)

    there = teams.join(pairs, "team").select("slab", "team", "vec_id", "label", "q", "windows")
    here = index.blocks.join(pairs, "slab").select(*(F.col(c).alias(c) for c in ("slab", "team")), "block", "n", "ids", "labels", "kind", "vectors", "centre", "radius")
    return there.groupBy("slab", "team").cogroup(here.groupBy("slab", "team")).applyInArrow(both, "anchor_id long, window long, vec_id long, score long")


def _slab(own: list[dict], m: np.ndarray, parts: list[dict], dim: int, n: int, own_label: bool) -> dict[str, np.ndarray]:
    """A group of anchors against a slab's blocks."""
    order = pieces(m, ANCHOR_LEAF)
    balls = [ball(m[p]) for p in order]
    anchors = Balls(np.array([c for c, _ in balls]), np.array([r for _, r in balls]))
    blocks = Balls(np.array([p["centre"] for p in parts]), np.array([p["radius"] for p in parts]))
    ids = [np.frombuffer(p["ids"], "<i8") for p in parts]
    labels = [np.frombuffer(p["labels"], "<i8") for p in parts]
    vectors = [wide(unpack(p["vectors"], p["kind"], p["n"]), dim) for p in parts]
    low = [np.array([w["low"] for w in r["windows"]], np.int64) for r in own]
    high = [np.array([w["high"] for w in r["windows"]], np.int64) for r in own]
    held: list[list[list[tuple[int, int]]]] = [[[] for _ in r["windows"]] for r in own]  # (-score, vec_id), n at most
    label, number = np.array([r["label"] for r in own]), np.array([r["vec_id"] for r in own])
    lowest = np.array([int(x.min()) if len(x) else NEVER for x in low])
    highest = np.array([int(x.max()) if len(x) else -NEVER for x in high])

    floor = np.array([lowest[p].min() for p in order], float)
    ceiling = np.array([highest[p].max() for p in order], float)

    def score(leaf: int, block: int) -> None:
        group = order[leaf]
        got = products(m[group], vectors[block])
        fits = (labels[block][None] == label[group, None]) == own_label
        fits &= (ids[block][None] != number[group, None]) & (got >= lowest[group, None]) & (got <= highest[group, None])
        for g in np.flatnonzero(fits.any(1)):
            i, at = int(group[g]), np.flatnonzero(fits[g])
            s, v = got[g, at], ids[block][at]
            for k in range(len(low[i])):
                inside = (s >= low[i][k]) & (s <= high[i][k])
                if inside.any():
                    some = np.lexsort((v[inside], -s[inside]))[:n]
                    best = held[i][k] = sorted(held[i][k] + [(-int(a), int(b)) for a, b in zip(s[inside][some], v[inside][some])])[:n]
                    if len(best) == n:
                        low[i][k] = max(low[i][k], -best[-1][0])
            lowest[i] = low[i].min()
        floor[leaf] = lowest[group].min()

    search(anchors, blocks, floor, ceiling, score)
    out = [(own[i]["vec_id"], own[i]["windows"][k]["window"], v, -s) for i, windows in enumerate(held) for k, best in enumerate(windows) for s, v in best]
    table = np.array(out, np.int64).reshape(-1, 4)
    return {name: table[:, k] for k, name in enumerate(("anchor_id", "window", "vec_id", "score"))}


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, folder: str | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: vec_id, label and q (whole components), see ``usable``; ``anchor`` says which are
    anchors. Per anchor the ``positives`` best rows of its label, by score, ties by smaller vec_id;
    per positive the ``negatives`` best rows of another label that score between ``least`` and
    ``most`` hundredths of it. Rows of one vec_id count once, as the one with the smallest label and
    vector. Vectors of different lengths are filled up with zeros. Other columns are ignored; an
    empty table gives none; equal vectors, zero vectors and labels of one row are fine.
    """
    folder = folder or new_folder(rows.sparkSession, "negatives")
    ready = index(single(rows.select("vec_id", "label", "q")), folder)
    anchors = ready.rows.where(anchor)
    every = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(-NEVER).cast("long").alias("low"), F.lit(NEVER).cast("long").alias("high")))
    found = top(best_within(ready, anchors.withColumn("windows", every), f"{folder}/1", positives, True), ["anchor_id"], positives)
    found = written(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), folder, "positives")
    # whole scores s with least * p <= 100 s <= most * p
    low, high = F.ceil(F.col("positive_score") * F.lit(least).cast("decimal(3,0)") / 100), F.floor(F.col("positive_score") * F.lit(most).cast("decimal(3,0)") / 100)
    spans = found.select("anchor_id", F.struct(F.col("positive_id").alias("window"), low.cast("long").alias("low"), high.cast("long").alias("high")).alias("w")).where("w.low <= w.high")
    spans = spans.groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))  # up to ``positives``
    asked = anchors.join(spans, anchors["vec_id"] == spans["anchor_id"]).drop("anchor_id")
    hard = top(best_within(ready, asked, f"{folder}/2", negatives, False), ["anchor_id", "window"], negatives)
    named = hard.select("anchor_id", F.col("window").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
