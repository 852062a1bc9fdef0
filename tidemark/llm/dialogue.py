"""Repair of conversations whose turns do not alternate, by the cheapest edits.

The rows of a conversation, in order, and the states of a small grammar of roles span a graph: a row
is kept, given another role or deleted, and empty rows are inserted anywhere, each edit an arc with
a cost and a letter. Forward costs (from the start to a node) and backward costs (from a node to an
accepted end) tell the arcs on cheapest paths: those whose forward cost, own cost and backward cost
add up to the least total. Among these, a walk from the start takes the least letter at each step,
with the set of all nodes that the letters so far lead to.

A conversation may be longer than a task should hold. Rows equal in turn, role and text are counted;
what is left is cut into blocks by turn (and, where many texts share a turn, by their digests). Each
block is reduced to the least costs from each state to each other; these are chained forwards and
backwards over the blocks; then each block is walked by itself. Texts stay out of this: the graph
needs their faults and digests only, and they are joined to the edits at the end.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.scratch import new_folder, written
from tidemark.operators.scan import chained, each, fields, same

#: Roles that can be given or inserted; the grammar knows them by their initials.
GIVEN = ("user", "assistant")
#: State -> initial -> next state, for an optional system turn and pairs of user and assistant; nothing at all is fine too.
TURNS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 60
#: Turns per block, and rows of a block from which on it is cut by turn and digest.
TURNS_PER_BLOCK, MANY_ROWS = 512, 4096
BLANKS = " \t\n\x0b\x0c\r"


class Graph:
    """The arcs of a row, and walks over a block's rows (initial, forced, truncated)."""

    def __init__(self, turns=TURNS, ends=ENDS):
        self.turns, self.n = turns, len(turns)
        self.inserts = [[(t[r[0]], r) for r in GIVEN if r[0] in t] for t in turns]
        if any(len(x) > 1 for x in self.inserts):
            raise ValueError("two roles can be given in one state: letters would not tell the edits")
        # least costs by insertions alone
        self.closure = [[FAR] * self.n for _ in turns]
        for q in range(self.n):
            at, cost = q, 0
            while cost < self.closure[q][at]:
                self.closure[q][at] = cost
                if not self.inserts[at]:
                    break
                at, cost = self.inserts[at][0][0], cost + INSERT
        self.to_end = [min(self.closure[q][e] for e in ends) for q in range(self.n)]
        self.kinds: dict[tuple, list[list[tuple]]] = {}

    def arcs(self, row: tuple) -> list[list[tuple]]:
        """Per state the arcs (letter, cost, next state, role) of a row, without insertions; role '' keeps the own one, None deletes."""
        if row not in self.kinds:
            initial, forced, truncated = row
            out = []
            for q, t in enumerate(self.turns):
                own = [("D", DELETE, q, None)]
                if not forced:
                    extra = TRUNCATED if truncated else 0
                    own += [("K", KEEP + extra, t[initial], "")] if initial in t else []
                    own += [("R", REROLE + extra, to, role) for to, role in self.inserts[q]]
                out.append(own)
            self.kinds[row] = out
        return self.kinds[row]

    def inserted(self, cost: list[int]) -> list[int]:
        """Forward costs of a node's states with the insertions there."""
        return [min(cost[p] + self.closure[p][q] for p in range(self.n)) for q in range(self.n)]

    def over(self, rows: list[tuple], cost: list[int]) -> list[int]:
        """Forward costs behind the last row, from those before the first."""
        for row in rows:
            here, cost = self.inserted(cost), [FAR] * self.n
            for q, own in enumerate(self.arcs(row)):
                for _, w, to, _ in own:
                    if here[q] + w < cost[to]:
                        cost[to] = here[q] + w
        return cost

    def matrix(self, rows: list[tuple]) -> list[list[int]]:
        return [self.over(rows, [0 if p == q else FAR for p in range(self.n)]) for q in range(self.n)]

    def back(self, rows: list[tuple], after: list[int]) -> list[list[int]]:
        """Backward costs before each row and behind the last one."""
        costs = [after]
        for row in reversed(rows):
            straight = [min(w + costs[-1][to] for _, w, to, _ in own) for own in self.arcs(row)]
            costs.append([min(self.closure[q][p] + straight[p] for p in range(self.n)) for q in range(self.n)])
        return costs[::-1]

    def walk(self, rows: list[tuple], before: list[int], after: list[int], entry: int, last: bool) -> tuple[int, list[tuple], list[str]]:
        """From a state before the first row: the state behind the last, per row (inserted roles, letter, role), and the roles inserted at the end."""
        behind = self.back(rows, after)
        total = min(f + b for f, b in zip(before, behind[0]))
        frontier, ahead, out = {entry}, before, []
        for i in range(len(rows) + 1):
            here = self.inserted(ahead)
            roles: list[str] = []
            while True:
                tight = []
                for q in frontier:
                    if i < len(rows) or last:
                        tight += [("I", to, role) for to, role in self.inserts[q] if here[q] + INSERT + behind[i][to] == total]
                    if i < len(rows):
                        tight += [(letter, to, role) for letter, w, to, role in self.arcs(rows[i])[q] if here[q] + w + behind[i + 1][to] == total]
                if not tight:  # behind the last row
                    return min(frontier), out, roles
                letter = min(tight)[0]
                chosen = [(to, role) for x, to, role in tight if x == letter]
                frontier = {to for to, _ in chosen}
                if letter != "I":
                    out.append((roles, letter, chosen[0][1]))
                    break
                roles.append(chosen[0][1])
            ahead = self.over(rows[i : i + 1], ahead)
        raise AssertionError("unreachable")


def clean(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, with one space for a null role or text."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations as a faulty collection would leave them, by the checksum of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3
    repeats it, 4 gives it to the user; the rest stays. Null roles and texts become one space.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = clean(conversations).withColumn("_kind", F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).where("_kind <> 0")
    kind = F.col("_kind")
    r = r.withColumn("text", F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    r = r.withColumn("role", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")))
    return r.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def row_key() -> Column:
    """Tells rows of a turn apart by role and text, and orders them."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))


KEYS = ["conv_id"]
ROW = "before array<string>, letter string, given string, copies long"


class Edits:
    """The edits of a table of conversations, as tables; see ``repair``."""

    def __init__(self, conversations: DataFrame, folder: str):
        self.rows = clean(conversations).withColumn("key", row_key())
        blank = F.rtrim("text", F.lit(BLANKS)) == ""
        stops = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
        light = self.rows.select("conv_id", "turn", "key", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~stops).alias("truncated"))
        # of equal rows one, with their number; added up before the shuffle
        light = light.groupBy("conv_id", "turn", "key").agg(F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.count("*").alias("n"))
        light = written(light, folder, "rows")
        place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
        again = light.groupBy("conv_id", "key").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        both = same(light, again, ["conv_id", "key"], "left").withColumn("seen", F.coalesce(place != F.col("_first"), F.lit(False))).drop("_first")
        # blocks in the order of turn (null first) and key
        both = both.withColumn("part", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BLOCK), F.lit(-FAR)))
        many = both.groupBy("conv_id", "part").count().where(F.col("count") > MANY_ROWS).select("conv_id", "part", F.lit(True).alias("_many"))
        cut = same(both, many, ["conv_id", "part"], "left")
        cut = cut.withColumns({"sub": F.when(F.col("_many"), F.col("turn")), "hex": F.when(F.col("_many"), F.substring("key", 1, 2)).otherwise(F.lit(""))})
        own = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "key", "initial", "blank", "seen", "truncated", "n")))
        self.blocks = written(cut.groupBy("conv_id", "part", "sub", "hex").agg(own.alias("rows")), folder, "blocks")
        self.order = ["part", "sub", "hex"]
        self.ids = [*KEYS, *self.order]
        self.walked = written(self._walked(), folder, "walked")

    @staticmethod
    def steps(row: dict) -> list[tuple]:
        """The rows of a block as the graph takes them: the first of equal ones, the others are deleted whatever comes."""
        return [(r["initial"], r["blank"] or r["seen"], r["truncated"]) for r in row["rows"]]

    def _walked(self) -> DataFrame:
        graph, head = Graph(), fields(self.blocks, *self.ids)
        ids, steps = self.ids, self.steps
        named = lambda row: {k: row[k] for k in ids}
        costs = each(self.blocks, head + "m array<array<long>>", lambda row: [{**named(row), "m": graph.matrix(steps(row))}], 256)

        def forth(row, state):
            before = [0, *[FAR] * (graph.n - 1)] if state is None else state
            return {"before": before, "first": state is None}, [min(FAR, *(before[p] + row["m"][p][q] for p in range(graph.n))) for q in range(graph.n)]

        def back(row, state):
            after = graph.to_end if state is None else state
            return {"after": after, "last": state is None}, [min(FAR, *(row["m"][q][p] + after[p] for p in range(graph.n))) for q in range(graph.n)]

        def exits(row):
            """For each state before the block that lies on a cheapest path: the state behind it, and the number of rows that stay or come in."""
            behind = graph.back(steps(row), row["after"])[0]
            total = min(f + b for f, b in zip(row["before"], behind))
            out = []
            for q in range(graph.n):
                ok = row["before"][q] + behind[q] == total and not row["last"]
                to, edits, tail = graph.walk(steps(row), row["before"], row["after"], q, False) if ok else (0, [], [])
                out.append({"to": to, "out": sum(len(i) + (role is not None) for i, _, role in edits) + len(tail)})
            return [{**named(row), "exits": out}]

        def enter(row, state):
            q, place = (0, 0) if state is None else state
            return {"entry": q, "place": place}, (row["exits"][q]["to"], place + row["exits"][q]["out"])

        costs = written(costs, new_folder(self.blocks.sparkSession, "costs"), "m")
        around = same(chained(costs, KEYS, self.order, forth, head + "before array<long>, first boolean"), chained(costs, KEYS, self.order, back, head + "after array<long>, last boolean", backwards=True), ids)
        known = same(self.blocks, around, ids)
        entries = chained(each(known, head + "exits array<struct<to int, out long>>", exits, 256), KEYS, self.order, enter, head + "entry int, place long")

        def walk(row):
            rows = row["rows"]
            _, edits, tail = graph.walk(steps(row), row["before"], row["after"], row["entry"], row["last"])
            behind = graph.back(steps(row), row["after"])[0]
            blank = seen = truncated = illegal = 0
            audit, place, out, prev = [], row["place"], [], None
            for r, (roles, letter, given) in zip(rows, edits):
                n, i = r["n"], r["initial"]
                blank += n if r["blank"] else 0
                seen += 0 if r["blank"] else n - 1 + r["seen"]
                truncated += r["truncated"] and not r["blank"] and not r["seen"]
                illegal += (prev is not None and prev + i not in ("su", "ua", "au")) + (n - 1)  # a role never follows itself
                prev = i
                audit.append("I" * len(roles) + letter + "D" * (n - 1))
                at = place + len(roles)
                out.append({"turn": r["turn"], "key": r["key"], "inserted": roles, "letter": letter, "given": given, "place": at, "copies": n})
                place = at + (given is not None)
            turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
            return [{
                **named(row), "edits": out, "tail": tail, "end": place, "audit": "".join(audit) + "I" * len(tail), "blank": blank, "seen": seen, "truncated": truncated, "illegal": illegal,
                "head": rows[0]["initial"], "foot": rows[-1]["initial"], "cost": min(f + b for f, b in zip(row["before"], behind)) + DELETE * sum(r["n"] - 1 for r in rows),
                "turns": len(turns), "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "more": DELETE * sum(r["n"] - 1 for r in rows),
            }]

        found = head + "edits array<struct<turn long, key string, inserted array<string>, letter string, given string, place long, copies long>>, tail array<string>, `end` long, audit string, blank long, seen long, truncated long, illegal long, head string, foot string, cost long, turns long, low long, high long, more long"
        return each(same(known, entries, ids), found, walk, 256)

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): a row per conversation that has rows."""

        def add(row, state):
            """Facts of the blocks so far; those of the last row of a conversation are of all its blocks."""
            s = state or {"gaps_of": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "more": 0, "foot": None, "turns": 0, "low": None, "high": None}
            t = dict(s)
            for mine, own in (("blank", "blank"), ("duplicate", "seen"), ("truncated", "truncated"), ("illegal", "illegal"), ("more", "more")):
                t[mine] += row[own]
            t["illegal"] += s["foot"] is not None and s["foot"] + row["head"] not in ("su", "ua", "au")
            t["turns"] += row["turns"] - (row["turns"] > 0 and s["high"] is not None and s["high"] == row["low"])
            t["foot"], t["low"], t["high"] = row["foot"], s["low"] if s["low"] is not None else row["low"], row["high"] if row["high"] is not None else s["high"]
            gaps = 0 if t["low"] is None else t["high"] - t["low"] + 1 - t["turns"]
            return {"gaps": gaps, **{k: t[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": row["cost"] - row["more"] + t["more"]}, t

        facts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        head = fields(self.blocks, *self.ids)
        light = self.walked.select(*self.ids, "seen", "blank", "truncated", "illegal", "more", "head", "foot", "turns", "low", "high", "cost")
        sums = chained(light, KEYS, self.order, add, head + ", ".join(f"{f} long" for f in facts))
        order = F.struct("part", F.col("sub").isNotNull().alias("some"), "sub", "hex")
        ends = sums.groupBy("conv_id").agg(F.max_by(F.struct(*facts), order).alias("f")).select("conv_id", "f.*")
        audits = self.walked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "audit"))).alias("_a")).select("conv_id", F.array_join(F.transform("_a", lambda a: a["audit"]), "").alias("audit"))
        return same(ends, audits, KEYS)

    def repaired(self) -> DataFrame:
        """(conv_id, place, role, text, turn, edit): the rows after all edits, by place from 0; edit is keep, rerole or insert."""
        e = self.walked.select("conv_id", F.inline("edits"))
        stay = e.where("given is not null").select("conv_id", "turn", "key", "place", "given")
        texts = self.rows.groupBy("conv_id", "turn", "key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
        kept = same(texts, stay, ["conv_id", "turn", "key"]).select("conv_id", "place", F.when(F.col("given") == "", F.col("role")).otherwise(F.col("given")).alias("role"), "text", "turn", F.when(F.col("given") == "", "keep").otherwise("rerole").alias("edit"))
        new = lambda r, at: r.select("conv_id", F.posexplode("inserted").alias("_i", "role"), at.alias("_at")).select("conv_id", (F.col("_at") + F.col("_i")).alias("place"), "role", F.lit("").alias("text"), F.lit(None).cast("long").alias("turn"), F.lit("insert").alias("edit"))
        between = new(e, F.col("place") - F.size("inserted"))
        at_end = new(self.walked.where(F.size("tail") > 0).select("conv_id", F.col("tail").alias("inserted"), "end"), F.col("end"))
        return kept.unionByName(between).unionByName(at_end)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (conv_id, place, role, text, turn, edit) and the report of each conversation.

    ``conversations``: conv_id, turn, role and text; other columns are ignored. Null roles and texts
    count as one space; rows without a conv_id are one conversation; null turns come first. Rows of
    one turn are taken in the order of a digest of role and text. A role with another initial than
    the grammar's, or none, can only be changed or go. Texts of any length pass through Spark only.
    A conversation without rows has no report.
    """
    edits = Edits(conversations, new_folder(conversations.sparkSession, "dialogue"))
    return edits.repaired(), edits.report()


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of ``role:text`` of the repaired rows, a line feed between two; the rows pass as a sorted stream, none is held."""
    kind = fields(repaired, "conv_id")

    def run(batches):
        import pyarrow as pa

        conv, sha = None, None
        for batch in batches:
            out = []
            for c, line in zip(batch.column("conv_id").to_pylist(), batch.column("line")):
                if sha is None or c != conv:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.as_py().encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], batch.schema.field("conv_id").type), pa.array([h for _, h in out], pa.string())], ["conv_id", "repaired_sha256"])
            kind_of = batch.schema.field("conv_id").type
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind_of), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    lines = repaired.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place").mapInArrow(run, kind + "repaired_sha256 string")


NOTHING = hashlib.sha256(b"").hexdigest()


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """A row per conv_id of ``conversations``: faults, costs, edits and the digest of the repaired rows after ``damaged``."""
    repaired, report = repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    facts = same(same(every, report, KEYS, "left"), digests(repaired), KEYS, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return facts.withColumns({**zero, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(NOTHING))})
