"""DuckDB counterparts of the queries that SQL can express as a whole."""

from __future__ import annotations

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
MARK = "chr(1)"  # between the letters and the lines of a path; sorts before every letter


def _longer(weight: str, letters: str, lines: str, path: str) -> str:
    """A path (nine digits of cost, letters, mark, lines) with an edit before it."""
    return f"(lpad(CAST({weight} + CAST(left({path}, 9) AS INT) AS VARCHAR), 9, '0') || {letters} || substr({path}, 10, instr({path}, {MARK}) - 9) || {lines} || substr({path}, instr({path}, {MARK}) + 1))"


def dialogue() -> str:
    """Edits from the last row to the first: per state the least of cost, letters and lines as one text."""
    line = lambda role: f"'{role}:' || chr(10)"
    put = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keep = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
    own = "role || ':' || text || chr(10)"
    straight = []
    for q in range(4):
        options = [_longer("3", "'D'", "''", f"p{q}")]
        options += [f"CASE WHEN NOT forced AND left(role, 1) = '{i}' THEN {_longer('extra', chr(39) + 'K' + chr(39), own, f'p{to}')} END" for i, to in keep[q]]
        role, to = put[q]
        options.append(f"CASE WHEN NOT forced THEN {_longer('2 + extra', chr(39) + 'R' + chr(39), f'{chr(39)}{role}:{chr(39)} || text || chr(10)', f'p{to}')} END")
        straight.append(f"least({', '.join(options)}) AS s{q}")
    closed, ends = [], []
    for q in range(4):
        options, state, lines = [], q, "''"
        for j in range(3):
            options.append(_longer(str(2 * j), f"'{'I' * j}'", lines, f"s{state}"))
            role, state = put[state]
            lines += f" || {line(role)}"
        closed.append(f"least({', '.join(options)}) AS p{q}")
    ends = [f"'000000000' || {MARK}", f"'000000004II' || {MARK} || {line('user')} || {line('assistant')}", f"'000000002I' || {MARK} || {line('assistant')}", f"'000000000' || {MARK}"]
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    return f"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, {crc} % 20 AS kind FROM src),
dmg AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE kind <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dmg),
fault AS (SELECT *, rtrim(text, {SPACES}) = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, right(rtrim(text, {SPACES}), 1) NOT IN ('.', '!', '?') AS cut, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM pos),
ready AS (SELECT *, blank OR seen AS forced, CASE WHEN cut THEN 1 ELSE 0 END AS extra FROM fault),
back AS (SELECT DISTINCT conv_id, n + 1 AS i, {", ".join(f"{e} AS p{q}" for q, e in enumerate(ends))} FROM ready
UNION ALL SELECT conv_id, i, {", ".join(closed)} FROM (SELECT r.conv_id, r.i, {", ".join(straight)} FROM back b JOIN ready r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1) x),
facts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate, count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM ready GROUP BY 1),
best AS (SELECT conv_id, CAST(left(p0, 9) AS BIGINT) AS cost, substr(p0, 10, instr(p0, {MARK}) - 10) AS audit, substr(p0, instr(p0, {MARK}) + 1) AS lines FROM back WHERE i = 1)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(left(b.lines, length(b.lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""


def negatives() -> str:
    """Every anchor beside every row."""
    return """WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, q) = 1),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS "rank", vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY "rank" <= 3"""
