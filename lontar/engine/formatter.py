"""Results for people: values as text, tables with borders, JSON."""

from __future__ import annotations

import datetime as dt
import json
import unicodedata
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from typing import Any


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[list[Any]]
    kinds: list[str] | None = None

    def __str__(self) -> str:
        return table(self)


def time_text(ns: int) -> str:
    s, rest = divmod(ns, 10**9)
    tail = f".{rest:09}".rstrip("0").rstrip(".")
    return f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}{tail}"


def value_text(v: Any, kind: str | None = None) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if kind == "W":
        return time_text(v)
    if kind == "U":
        return f"{v:.2f}"
    if isinstance(v, Fraction):
        den = v.denominator
        for p in (2, 5):
            while den % p == 0:
                den //= p
        places = next((k for k in range(19) if 10**k % v.denominator == 0), None) if den == 1 else None
        if places is None:
            return f"{v.numerator}/{v.denominator}"
        return value_text(Decimal(v.numerator * 10**places // v.denominator).scaleb(-places))
    if isinstance(v, Decimal):
        text = f"{v:f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(v, dt.datetime):
        return f"{v:%Y-%m-%d %H:%M:%S}.{v.microsecond // 1000:03}"
    return str(v)


def width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


_ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _cell(text: str, most: int) -> str:
    text = "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if unicodedata.category(c) == "Cc" else c) for c in text)
    if width(text) <= most:
        return text
    while width(text) > most - 1:
        text = text[:-1]
    return text + "…"


def table(r: QueryResult, most: int = 80) -> str:
    """An ASCII table and the number of rows."""
    kinds = r.kinds or [None] * len(r.columns)
    cells = [[_cell(c, most) for c in r.columns]] + [[_cell(value_text(v, k), most) for v, k in zip(row, kinds)] for row in r.rows]
    widths = [max(width(row[i]) for row in cells) for i in range(len(r.columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    lines = ["|" + "|".join(f" {c}{' ' * (w - width(c))} " for c, w in zip(row, widths)) + "|" for row in cells]
    return "\n".join([rule, lines[0], rule, *lines[1:], rule, "", f"{len(r.rows)} baris."])


def to_json(r: QueryResult) -> str:
    """Columns and rows; exact numbers are tagged so that none is rounded."""
    kinds = r.kinds or [None] * len(r.columns)

    def tag(v: Any, kind: str | None) -> Any:
        if kind == "U" and v is not None:
            return {"type": "money", "value": value_text(v, kind)}
        if isinstance(v, Decimal):
            return {"type": "decimal", "value": value_text(v)}
        if isinstance(v, Fraction):
            return {"type": "exact", "value": value_text(v)}
        return v if v is None or isinstance(v, (bool, int, float, str)) and kind != "W" else value_text(v, kind)

    return json.dumps({"columns": r.columns, "rows": [[tag(v, k) for v, k in zip(row, kinds)] for row in r.rows], "row_count": len(r.rows)}, ensure_ascii=False)
