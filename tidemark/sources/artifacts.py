"""Small result tables as documents at the edge: JSON, LaTeX and fixed-width text."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def small_rows(rows: DataFrame) -> list[dict]:
    """The rows of a small table; an error beyond MOST_ROWS."""
    got = rows.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows: write a table instead")
    return [r.asDict(recursive=True) for r in got]


def plain(value):
    """JSON types; numbers that are not finite become null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def nested(rows: Sequence[dict], keys: Sequence[str]) -> dict:
    """Rows as a tree by their keys; the other columns are the leaves."""
    out: dict = {}
    for r in rows:
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(r[k]), {})
        at[str(r[keys[-1]])] = {k: v for k, v in r.items() if k not in keys}
    return out


def payload(parts: dict[str, tuple[DataFrame, Sequence[str]]]) -> str:
    """A JSON document of several small tables, each as a tree by its keys."""
    return json.dumps(plain({name: nested(small_rows(df), keys) for name, (df, keys) in parts.items()}), indent=1, sort_keys=True)


def flattened(document: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(path, value as JSON) of every leaf."""
    if isinstance(document, dict) and document:
        return [x for k, v in document.items() for x in flattened(v, f"{prefix}/{k}")]
    if isinstance(document, list) and document:
        return [x for i, v in enumerate(document) for x in flattened(v, f"{prefix}/{i}")]
    return [(prefix, json.dumps(document))]


def latex(rows: DataFrame, columns: Sequence[str], digits: int = 2, by: Sequence[str] = ()) -> str:
    """A LaTeX tabular of a small table."""
    show = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = small_rows(rows.orderBy(*by) if by else rows)
    lines = [" & ".join(show(r[c]) for c in columns) + r" \\" for r in body]
    return "\n".join([r"\begin{tabular}{" + "l" + "r" * (len(columns) - 1) + "}", r"\toprule", " & ".join(c.replace("_", r"\_") for c in columns) + r" \\", r"\midrule", *lines, r"\bottomrule", r"\end{tabular}"]) + "\n"


def sheet(rows: DataFrame, columns: Sequence[str], digits: int = 4) -> str:
    """Fixed-width text of a small table."""
    show = lambda v: "-" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    table = [list(columns), *([show(r[c]) for c in columns] for r in small_rows(rows))]
    width = [max(len(r[i]) for r in table) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in table) + "\n"
