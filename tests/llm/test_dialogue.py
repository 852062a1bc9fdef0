"""Repair of conversations against trying out all edits, and whole conversations against blocks of them."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import dialogue as D

LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def tried_out(rows):
    """(cost, audit, repaired): all edits of a few rows (role, text, forced, truncated), the cheapest with the least letters."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    names = {"u": "user", "a": "assistant"}
    choices = []
    for role, text, forced, cut in rows:
        own = [("D", 3, None)]
        if not forced:
            own += [("K", cut, (role, text)), ("R", 2 + cut, ("user", text)), ("R", 2 + cut, ("assistant", text))]
        choices.append(own)
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 2 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            out, audit = [], ""
            for i, e in enumerate([*edits, None]):
                out += [(names[c], "") for c in put[i]]
                audit += "I" * len(put[i])
                if e:
                    audit += e[0]
                    out += [e[2]] if e[2] else []
            if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = min(best or (cost, audit, out), (cost, audit, out))
    return best


def faults(rows):
    """Rows (role, text) with what the faults make of them, and their numbers."""
    seen, out, n = set(), [], [0, 0, 0]
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            n[kind] += 1
        out.append((role, text, kind in (0, 1), int(kind == 2)))
    return out, n


def expected(rows):
    """The report of one conversation's ordered rows (turn, role, text)."""
    marked, (blank, again, cut) = faults([r[1:] for r in rows])
    cost, audit, out = tried_out(marked)
    turns = [t for t, _, _ in rows if t is not None]
    first = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": blank, "duplicate": again, "truncated": cut,
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def ordered(rows):
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(clean, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def made(seed, n, most=3):
    rnd = random.Random(seed)
    out = {}
    for c in range(n):
        out[c] = [(rnd.choice([None, 0, 0, 1, 2, 3, 7]), rnd.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "sudo"]), rnd.choice(["Yes.", "No!", "half", "", " \n", None, "a b. ", "é?\t"])) for _ in range(rnd.randint(1, most))]
    return out


def reported(conversations):
    repaired, report = D.repair(conversations)
    both = D.same(report, D.digests(repaired), ["conv_id"], "left")
    return {r.conv_id: {k: v if v is not None else D.NOTHING for k, v in r.asDict().items() if k != "conv_id"} for r in both.collect()}


def test_cheapest_edits_are_found(spark):
    convs = made(1, 120)
    convs[None] = convs.pop(0)
    table = spark.createDataFrame([(c, *r, "x") for c, rows in convs.items() for r in rows], SCHEMA + ", place string")
    got = reported(table)
    assert got == {c: expected(ordered(rows)) for c, rows in convs.items()}


def test_blocks_change_nothing(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for c in range(4):
        for t in range(60):
            for _ in range(rnd.choice([0, 1, 1, 1, 2, 5 if t % 20 == 0 else 1])):
                rows.append((c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", "assistant", "system"]), f"text {rnd.randrange(40)}{rnd.choice(['.', '', '!'])}"))
    rows += [(9, 1, "user", "again.")] * 50
    table = spark.createDataFrame(rows, SCHEMA)
    whole = reported(table)
    monkeypatch.setattr(D, "TURNS_PER_BLOCK", 7)
    monkeypatch.setattr(D, "MANY_ROWS", 6)
    assert reported(table) == whole
    assert whole[9]["audit"] == "K" + "D" * 49 + "I" and whole[9]["duplicate"] == 49 and whole[9]["illegal"] == 49 and whole[9]["cost"] == 149
    repaired, _ = D.repair(table)
    by = defaultdict(list)
    for r in repaired.collect():
        by[r.conv_id].append((r.place, r.role, r.text, r.edit))
    for c, out in by.items():
        out.sort()
        assert [p for p, *_ in out] == list(range(len(out)))
        assert LEGAL.fullmatch("".join(r[0] for _, r, _, _ in out))
        assert "".join({"keep": "K", "rerole": "R", "insert": "I"}[e] for *_, e in out) == whole[c]["audit"].replace("D", "")


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in (("assistant", "So. It! is?"), (None, None))]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            want += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    key = lambda r: tuple(map(str, r))
    got = [tuple(r) for r in D.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_every_conversation_has_a_row(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    there = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    table = spark.createDataFrame([(gone, 0, "user", "A."), (there, 0, "assistant", "é" * 2_000_000 + ".")], SCHEMA)
    got = {r.conv_id: r for r in D.damage_and_repair(table).collect()}
    assert (got[gone].cost, got[gone].audit, got[gone].repaired_sha256) == (0, "", D.NOTHING)
    assert got[there].audit == "IK" and got[there].repaired_sha256 == hashlib.sha256(("user:\nassistant:" + "é" * 2_000_000 + ".").encode()).hexdigest()
    assert D.damage_and_repair(table.limit(0)).count() == 0


def test_grammars_whose_letters_do_not_tell_the_edits_are_refused():
    with pytest.raises(ValueError):
        D.Graph(turns=({"u": 1, "a": 1}, {}), ends=(1,))
