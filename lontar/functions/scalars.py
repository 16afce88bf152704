"""Row expressions of the relational API, as Spark columns. NULL goes through all of them as in SQL."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lontar.errors import type_error


def col(value: Any) -> Column:
    """A column stays; a string names a column; anything else is a literal."""
    if isinstance(value, Column):
        return value
    return F.col(f"`{value}`") if isinstance(value, str) else F.lit(value)


_COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def sqlcmp(op: str, a: Any, b: Any) -> Column:
    """eq, ne, lt, le, gt, ge."""
    if op not in _COMPARE:
        raise type_error(f"no such comparison: {op}")
    return _COMPARE[op](col(a), col(b))


def sqlnot(a: Column) -> Column:
    return ~a


def sqland(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def sqlor(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def sqlin(value: Any, options: Iterable[Any]) -> Column:
    """NULL if nothing matches and the value or an option is NULL; false for an empty list."""
    options = list(options)
    return col(value).isin(options) if options else F.lit(False)


@dataclass(frozen=True)
class SqlLike:
    """A LIKE pattern. The escape may stand before any character; at the end it is an error."""

    pattern: str
    escape: str | None = "\\"

    def normal(self) -> str:
        """The same pattern with escapes (always a backslash) only where Spark allows them: before %, _ and itself."""
        out, i = [], 0
        while i < len(self.pattern):
            c = self.pattern[i]
            if self.escape and c == self.escape:
                i += 1
                if i == len(self.pattern):
                    raise type_error("a LIKE pattern ends with its escape")
                c = self.pattern[i]
                out.append("\\" + c if c in "%_\\" else c)
            else:
                out.append("\\\\" if c == "\\" else c)
            i += 1
        return "".join(out)


def sqllike(value: Any, pattern: str | SqlLike, escape: str | None = "\\") -> Column:
    like = pattern if isinstance(pattern, SqlLike) else SqlLike(pattern, escape)
    return F.like(col(value), F.lit(like.normal()), F.lit("\\"))


def _exact(value: Any, scale: int) -> Column:
    return col(value).cast(f"decimal({38 if scale else 20},{scale})")


def radd(a: Any, b: Any, scale: int = 0) -> Column:
    """Exact sum of values with at most `scale` decimals; 64-bit overflow cannot occur."""
    return _exact(a, scale) + _exact(b, scale)


def rsub(a: Any, b: Any, scale: int = 0) -> Column:
    return _exact(a, scale) - _exact(b, scale)


def rmul(a: Any, b: Any, scale: int = 0) -> Column:
    """Exact product of values with at most `scale` decimals and 18 digits."""
    return col(a).cast(f"decimal(18,{scale})") * col(b).cast(f"decimal(18,{scale})")


def rdiv(a: Any, b: Any) -> Column:
    """Quotient as a double; division by zero is an error."""
    return col(a).cast("double") / col(b).cast("double")


def hdiv(a: Any, b: Any) -> Column:
    """Quotient as a double, NULL for a zero divisor."""
    return F.when(col(b) != 0, col(a).cast("double") / col(b).cast("double"))


def cents(value: Any) -> Column:
    """Hundredths of a double as a long."""
    return F.round(col(value) * 100).cast("long")
