"""Kinds of values, their Spark types, and what text and values they accept."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass, replace
from decimal import Decimal
from fractions import Fraction
from typing import Any

from lontar.errors import constraint, syntax, type_error

#: Kinds that columns can have. W is the time of day in nanoseconds, which no Spark type holds, as a long.
SPARK = {"I": "bigint", "D": "decimal(38,18)", "U": "decimal(38,2)", "F": "double", "B": "boolean", "C": "string", "T": "date", "W": "bigint", "TW": "timestamp_ntz"}
EXACT = ("I", "D", "U", "NUMBER")
NUMERIC = (*EXACT, "F")
MOST_COLUMNS, MOST_NAME, MOST_TEXT = 1024, 128, 1_000_000
_NAME = re.compile(r"[^\W\d]\w*\Z")


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    max_length: int = 255
    unique: bool = False
    primary: bool = False
    nullable: bool = True
    auto: bool = False


def check_name(name: str) -> str:
    if len(name) > MOST_NAME or not _NAME.match(name):
        raise syntax(f"not a name: {name!r}")
    return name


def column_definition(text: str) -> ColumnDef:
    """`Name = KIND(flag & flag)`; flags: P primary, N unique, Null, Not Null, and a length for C."""
    name, eq, rest = text.partition("=")
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", rest, re.S)
    if not eq or not m:
        raise syntax(f"not a column definition: {text!r}")
    out = ColumnDef(check_name(name.strip()), m[1].upper())
    if out.kind not in SPARK:
        raise type_error(f"no such kind: {m[1]}")
    seen = set()
    for flag in [" ".join(f.split()).upper() for f in m[2].split("&")] if m[2] is not None else []:
        what = "length" if flag.isdigit() else flag
        if what in seen:
            raise syntax(f"{flag} is repeated in {text!r}")
        seen.add(what)
        if what == "length" and out.kind == "C" and 1 <= int(flag) <= MOST_TEXT:
            out = replace(out, max_length=int(flag))
        elif flag == "P":
            out = replace(out, primary=True, nullable=False)
        elif flag == "N":
            out = replace(out, unique=True)
        elif flag == "NOT NULL":
            out = replace(out, nullable=False)
        elif flag != "NULL":
            raise syntax(f"no such flag for {out.kind}: {flag}")
    if "NULL" in seen and seen & {"P", "NOT NULL"}:
        raise syntax(f"a primary key or NOT NULL column cannot be NULL: {text!r}")
    return out


def _decimal(text: str) -> Decimal:
    if not re.fullmatch(r"[+-]?[0-9]+(\.[0-9]*)?|[+-]?\.[0-9]+", text):
        raise type_error(f"not a number: {text!r}")
    return Decimal(text)


def whole(x: Decimal | Fraction | int, places: int, most: int) -> int:
    """The value in units of 10^-places, if it is a whole number of them."""
    f = Fraction(x) * 10**places
    if f.denominator != 1 or abs(f) >= most:
        raise type_error(f"{x} does not fit exactly")
    return int(f)


def from_text(c: ColumnDef, text: str) -> Any:
    """The value that a column of this kind takes from text."""
    t = text.strip()
    k = c.kind
    try:
        if k == "C":
            return from_value(c, text)
        if k in "IDU":
            return from_value(c, _decimal(t))
        if k == "F":
            return from_value(c, float(t))
        if k == "B":
            return {"true": True, "benar": True, "false": False, "salah": False}[t.lower()]
        if k == "T":
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", t):
                raise ValueError
            return dt.date.fromisoformat(t)
        if k == "W":
            m = re.fullmatch(r"(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?", t)
            h, mi, s = (int(m[i]) for i in (1, 2, 3))
            if h > 23 or mi > 59 or s > 59:
                raise ValueError
            return ((h * 60 + mi) * 60 + s) * 10**9 + int((m[4] or "0").ljust(9, "0"))
        m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(\.\d{1,3})?", t)
        return dt.datetime.fromisoformat(f"{m[1]} {m[2]}{(m[3] or '.000').ljust(4, '0')}")
    except (ValueError, KeyError, TypeError) as e:
        raise type_error(f"{c.name} ({k}) does not take {text!r}") from e


def from_value(c: ColumnDef, v: Any) -> Any:
    """A Python value as one of the column's kind; never rounded."""
    if v is None:
        return None
    k = c.kind
    if k in "IDUF" and isinstance(v, bool):
        raise type_error(f"{c.name} takes no Boolean")
    if k == "I" and isinstance(v, (int, Decimal, Fraction)):
        n = whole(v, 0, 1 << 64)
        if not -(1 << 63) <= n < 1 << 63:
            raise type_error(f"{c.name}: {v} is beyond 64 bits")
        return n
    if k in "DU" and isinstance(v, (int, Decimal, Fraction)):
        places = 18 if k == "D" else 2
        return Decimal(whole(v, places, 10**38)).scaleb(-places)
    if k == "F" and isinstance(v, (int, float, Decimal, Fraction)):
        if not math.isfinite(float(v)):
            raise type_error(f"{c.name} takes finite numbers only")
        return float(v)
    if k == "C" and isinstance(v, str):
        if len(v) > c.max_length:
            raise constraint(f"{c.name} holds {c.max_length} characters at most")
        return v
    if k == "W" and isinstance(v, int) and 0 <= v < 86_400 * 10**9:
        return v
    if isinstance(v, {"B": bool, "T": dt.date, "TW": dt.datetime}.get(k, ())) and not (k == "T" and isinstance(v, dt.datetime)):
        return v
    raise type_error(f"{c.name} ({k}) does not take {v!r}")


def field_value(c: ColumnDef, field: str) -> Any:
    """A field of an INSERT: empty or null is NULL, double quotes hold text literally."""
    if field.startswith('"') and field.endswith('"') and len(field) > 1:
        return from_text(c, field[1:-1].replace('""', '"'))
    return None if field == "" or field.lower() == "null" else from_text(c, field)
