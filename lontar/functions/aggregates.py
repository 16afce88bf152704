"""Aggregates of the relational API. A selector is a column's name or an expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lontar.functions.scalars import col


@dataclass(frozen=True)
class Agg:
    make: Callable[[], Column]


def Count(selector: Any = None) -> Agg:  # noqa: N802
    """Rows, or values that are not NULL."""
    return Agg(lambda: F.count(F.lit(1) if selector is None else col(selector)))


def Countif(condition: Any) -> Agg:  # noqa: N802
    return Agg(lambda: F.count_if(col(condition)))


def Sum(selector: Any) -> Agg:  # noqa: N802
    """NULL over no values. Overflow of a long is an error; ExactSum has no such limit."""
    return Agg(lambda: F.sum(col(selector)))


def ExactSum(selector: Any) -> Agg:  # noqa: N802
    return Agg(lambda: F.sum(col(selector).cast("decimal(38,0)")))


def Avg(selector: Any) -> Agg:  # noqa: N802
    """Sum and count, divided last, as a double."""
    return Agg(lambda: F.sum(col(selector)).cast("double") / F.count(col(selector)))


def Min(selector: Any) -> Agg:  # noqa: N802
    return Agg(lambda: F.min(col(selector)))


def Max(selector: Any) -> Agg:  # noqa: N802
    return Agg(lambda: F.max(col(selector)))


def CountDistinct(selector: Any) -> Agg:  # noqa: N802
    return Agg(lambda: F.count_distinct(col(selector)))
