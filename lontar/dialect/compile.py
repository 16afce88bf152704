"""Analyzer and compiler of queries: a syntax tree becomes one DataFrame.

Kinds are inferred before anything runs, and stricter than Spark's coercions. Exact numbers stay exact:
an exact expression is a decimal numerator and, after a division, a decimal denominator; comparisons
multiply crosswise, and a ratio becomes a double (or a pair, for `collect`) only in the result.
Decimal arithmetic is analysed with spark.sql.decimalOperations.allowPrecisionLoss=false: what does not
fit in 38 digits is an error, nothing is rounded.

Row order is metadata: hidden columns that the result is sorted by only when it is read in order or limited.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.dialect import nodes as n
from lontar.engine.kinds import EXACT, NUMERIC
from lontar.errors import general, type_error
from lontar.operators.rel import Key, hidden, rising

AGGREGATES = ("count", "countif", "sum", "avg", "min", "max")
MOST_VIEWS = 64


@dataclass(frozen=True)
class Bound:
    """A column in scope and the name it has in the DataFrame."""

    source: str
    name: str
    kind: str
    column: str


@dataclass(frozen=True)
class Val:
    """A typed expression: value, or value / per for ratios."""

    kind: str
    value: Column
    per: Column | None = None

    def double(self) -> Column:
        return self.value.cast("double") if self.per is None else self.value.cast("double") / self.per.cast("double")


@dataclass
class Source:
    df: DataFrame
    schema: list[Bound]
    order: list[Key] = field(default_factory=list)


@dataclass
class Result:
    """labels, kinds, and the columns that hold the values (and denominators)."""

    df: DataFrame
    labels: list[str]
    kinds: list[str]
    columns: list[str]
    pers: list[str | None]
    order: list[Key]

    def frame(self, ordered: bool = False) -> DataFrame:
        """The result as a DataFrame; ratios are doubles."""
        df = self.df.orderBy(*[k.column() for k in self.order]) if ordered and self.order else self.df
        return df.select(*[(F.col(c) if p is None else F.col(c).cast("double") / F.col(p).cast("double")).alias(label) for c, p, label in zip(self.columns, self.pers, self.labels)])


#: Gives the source of a table or view: (name, names of views being read) -> Source.
Resolver = Callable[[str, tuple[str, ...]], Source]


@contextmanager
def exact_decimals(spark: SparkSession):
    """Expressions made inside keep all decimals or fail."""
    key = "spark.sql.decimalOperations.allowPrecisionLoss"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def resolve(schema: list[Bound], ref: n.Ref) -> Bound:
    found = [b for b in schema if b.name == ref.name and ref.source in (None, b.source)]
    if len(found) != 1:
        name = f"{ref.source}.{ref.name}" if ref.source else ref.name
        raise general(f"column {name} {'is ambiguous' if found else 'not found'}")
    return found[0]


def contains_aggregate(e: Any) -> bool:
    return isinstance(e, n.Call) or any(contains_aggregate(getattr(e, k)) for k in ("left", "right", "arg") if hasattr(e, k))


def _exact(v: Val) -> Column:
    return v.value.cast("decimal(20,0)") if v.kind == "I" else v.value


def _times(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a * b


def literal(value: Any) -> Val:
    if value is None:
        return Val("NULL", F.lit(None))
    if isinstance(value, bool):
        return Val("B", F.lit(value))
    if isinstance(value, int):
        return Val("I", F.lit(value).cast("bigint"))
    if isinstance(value, Decimal):
        return Val("NUMBER", F.lit(value))
    return Val("C", F.lit(value))


class Expressions:
    """Turns expressions into typed columns. `aggregate` gives the value of a call, or None where calls are not allowed."""

    def __init__(self, schema: list[Bound], aggregate: Callable[[n.Call], Val] | None = None, grouped: dict[Bound, str] | None = None):
        self.schema, self.aggregate, self.grouped = schema, aggregate, grouped

    def __call__(self, e: Any) -> Val:
        if isinstance(e, n.Lit):
            return literal(e.value)
        if isinstance(e, n.Ref):
            b = resolve(self.schema, e)
            if self.grouped is not None and b not in self.grouped:
                raise general(f"{e.name} is neither grouped nor in an aggregate")
            return Val(b.kind, F.col(b.column if self.grouped is None else self.grouped[b]))
        if isinstance(e, n.Star):
            raise general("* does not belong here")
        if isinstance(e, n.Unary):
            return self.arithmetic(e.op, literal(0), self(e.arg))
        if isinstance(e, n.Call):
            check_call(e)
            if self.aggregate is None:
                raise general("an aggregate does not belong here")
            return self.aggregate(e)
        if e.op in ("and", "or"):
            a, b = self(e.left), self(e.right)
            if any(v.kind not in ("B", "NULL") for v in (a, b)):
                raise type_error("&: and O: take Booleans")
            x, y = a.value.cast("boolean"), b.value.cast("boolean")
            return Val("B", x & y if e.op == "and" else x | y)
        a, b = self(e.left), self(e.right)
        return self.arithmetic(e.op, a, b) if e.op in ("add", "sub", "mul", "div") else self.compare(e.op, a, b)

    @staticmethod
    def arithmetic(op: str, a: Val, b: Val) -> Val:
        if any(v.kind not in (*NUMERIC, "NULL") for v in (a, b)):
            raise type_error("arithmetic takes numbers")
        if "NULL" in (a.kind, b.kind):
            kind = next((v.kind for v in (a, b) if v.kind != "NULL"), "NULL")
            return Val("F" if kind == "F" else "NUMBER", F.lit(None).cast("double" if kind == "F" else "decimal(38,0)"))
        if "F" in (a.kind, b.kind):
            x, y = a.double(), b.double()
            zero = F.raise_error(F.lit("Type Error: division by zero")).cast("double")
            made = {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: F.when(y == 0, zero).otherwise(x / y)}[op]()
            infinite = (F.abs(made) == float("inf")) | F.isnan(made)
            return Val("F", F.when(infinite, F.raise_error(F.lit("Type Error: the result is not finite")).cast("double")).otherwise(made))
        x, y = _exact(a), _exact(b)
        if op in ("add", "sub"):
            left, right = _times(x, b.per), _times(y, a.per)
            return Val("NUMBER", left + right if op == "add" else left - right, _times(a.per, b.per))
        if op == "mul":
            return Val("NUMBER", x * y, _times(a.per, b.per))
        top, bottom = _times(x, b.per), _times(y, a.per)
        checked = F.when(bottom == 0, F.raise_error(F.lit("Type Error: division by zero")).cast("decimal(38,0)")).otherwise(F.abs(bottom))
        return Val("NUMBER", F.when(bottom < 0, -top).otherwise(top), checked)

    @staticmethod
    def compare(op: str, a: Val, b: Val) -> Val:
        if "NULL" not in (a.kind, b.kind) and a.kind != b.kind and not (a.kind in NUMERIC and b.kind in NUMERIC):
            raise type_error(f"{a.kind} and {b.kind} cannot be compared")
        if "NULL" in (a.kind, b.kind):
            return Val("B", F.lit(None).cast("boolean"))
        if "F" in (a.kind, b.kind):
            x, y = a.double(), b.double()
        elif a.kind in EXACT and b.kind in EXACT and (a.per is not None or b.per is not None):
            x, y = _times(_exact(a), b.per), _times(_exact(b), a.per)
        else:
            x, y = a.value, b.value
        return Val("B", {"eq": x == y, "gt": x > y, "lt": x < y, "ge": x >= y, "le": x <= y}[op])


def check_call(e: n.Call) -> None:
    if e.name == "integral":
        raise general("Integral is reserved and not available yet")
    if e.name not in AGGREGATES:
        raise general(f"no such function: {e.name}")
    if isinstance(e.arg, n.Star) and e.name != "count":
        raise general("* belongs to Count only")
    if not isinstance(e.arg, n.Star) and contains_aggregate(e.arg):
        raise general("aggregates cannot be nested")


def _join_pairs(e: Any) -> list[tuple[n.Ref, n.Ref]]:
    if isinstance(e, n.Binary) and e.op == "and":
        return _join_pairs(e.left) + _join_pairs(e.right)
    if isinstance(e, n.Binary) and e.op == "eq" and isinstance(e.left, n.Ref) and isinstance(e.right, n.Ref):
        return [(e.left, e.right)]
    raise general("a join condition is equalities of columns, linked by &:")


def _sources(q: n.Select, find: Resolver, stack: tuple[str, ...]) -> Source:
    if len(set(q.sources)) != len(q.sources):
        raise general("a source is repeated")
    if len(q.sources) > 1 and q.join is None:
        raise general("several sources need Gabung Dengan")
    if len(q.sources) == 1:
        if q.join is not None:
            raise general("a single source takes no Gabung Dengan")
        return find(q.sources[0], stack)
    found = [find(name, stack) for name in q.sources]
    schema = [b for s in found for b in s.schema]
    pairs = [(resolve(schema, a), resolve(schema, b)) for a, b in _join_pairs(q.join)]
    for a, b in pairs:
        if a.source == b.source:
            raise general("a join condition links two different sources")
        if a.kind != b.kind and not (a.kind in NUMERIC and b.kind in NUMERIC):
            raise type_error(f"{a.name} and {b.name} cannot be compared")
    if {s for a, b in pairs for s in (a.source, b.source)} != set(q.sources):
        raise general("every source must be linked")
    # Connected sources first, in the order written; Catalyst picks the order that runs.
    out, have, left, waiting = found[0], {q.sources[0]}, list(zip(q.sources[1:], found[1:])), pairs
    while left:
        at = next((i for i, (name, _) in enumerate(left) if any({a.source, b.source} <= have | {name} and name in (a.source, b.source) for a, b in waiting)), None)
        if at is None:
            raise general("every source must be linked")
        name, s = left.pop(at)
        have.add(name)
        now = [p for p in waiting if p[0].source in have and p[1].source in have]
        waiting = [p for p in waiting if p not in now]
        condition = None
        for a, b in now:
            one = Expressions.compare("eq", Val(a.kind, F.col(a.column)), Val(b.kind, F.col(b.column))).value
            condition = one if condition is None else condition & one
        out = Source(out.df.join(s.df, condition), [*out.schema, *s.schema], [*out.order, *s.order])
    return Source(out.df, schema, out.order)


def _expand(q: n.Select, schema: list[Bound]) -> list[n.Item]:
    out = []
    for item in q.items:
        if isinstance(item.expr, n.Star):
            out += [n.Item(n.Ref(b.source, b.name), b.name if len(q.sources) == 1 else f"{b.source}.{b.name}") for b in schema]
        else:
            out.append(item)
    return out


class Aggregates:
    """Collects the aggregates of a grouped query and gives their values after the grouping."""

    def __init__(self, schema: list[Bound]):
        self.rows, self.made, self.known = Expressions(schema), [], {}

    def _add(self, c: Column) -> Column:
        name = hidden()
        self.made.append(c.alias(name))
        return F.col(name)

    def __call__(self, e: n.Call) -> Val:
        if e not in self.known:
            self.known[e] = self._value(e)
        return self.known[e]

    def _value(self, e: n.Call) -> Val:
        if isinstance(e.arg, n.Star):
            return Val("I", self._add(F.count(F.lit(1))))
        v = self.rows(e.arg)
        if e.name == "count":
            return Val("I", self._add(F.count(v.value)))
        if e.name == "countif":
            if v.kind not in ("B", "NULL"):
                raise type_error("Countif takes a Boolean")
            return Val("I", self._add(F.count_if(v.value.cast("boolean"))))
        if e.name in ("min", "max"):
            f = F.min if e.name == "min" else F.max
            return Val("F", self._add(f(v.double()))) if v.per is not None else Val(v.kind, self._add(f(v.value)))
        if v.kind not in (*NUMERIC, "NULL"):
            raise type_error(f"{e.name.capitalize()} takes numbers")
        if v.kind == "F" or v.per is not None:  # a sum of ratios has no exact form of fixed width
            total = self._add(F.sum(v.double()))
            return Val("F", total if e.name == "sum" else total / self._add(F.count(v.value)))
        x = v.value.cast("decimal(38,0)") if v.kind in ("I", "NULL") else v.value
        total = self._add(F.sum(x))
        if e.name == "sum":
            return Val("NUMBER", total)
        count = self._add(F.count(x)).cast("decimal(20,0)")
        return Val("NUMBER", total, F.when(count != 0, count))


def compile_select(q: n.Select, find: Resolver, stack: tuple[str, ...] = ()) -> Result:
    """The plan of a query; its caller holds `exact_decimals`."""
    src = _sources(q, find, stack)
    rows = Expressions(src.schema)
    df, order = src.df, src.order
    if q.where is not None:
        where = rows(q.where)
        if where.kind not in ("B", "NULL"):
            raise type_error("a condition is Boolean")
        df = df.filter(where.value.cast("boolean"))
    items = _expand(q, src.schema)
    grouped = bool(q.groups) or any(contains_aggregate(i.expr) for i in items)
    if grouped:
        keys: list[Bound] = []
        for g in q.groups:
            if not isinstance(g, n.Ref):
                raise general("Grup Dari takes columns")
            b = resolve(src.schema, g)
            if b in keys:
                raise general(f"{b.name} is grouped twice")
            keys.append(b)
        aggregates = Aggregates(src.schema)
        value = Expressions(src.schema, aggregates, {b: b.column for b in keys})
        values, sorts = [value(i.expr) for i in items], [(value(o.expr), o.descending) for o in q.order]
        made = list(aggregates.made)
        if keys and order:
            first, kinds = hidden(), {f.name: f.dataType for f in df.schema.fields}
            made.append(F.min(F.struct(*[x for k in order for x in rising(k, kinds[k.name])])).alias(first))
            order = [Key(first)]
        else:
            order = []
        df = df.groupBy(*[F.col(b.column) for b in keys]).agg(*made) if made else df.select(*[F.col(b.column) for b in keys]).distinct()
    else:
        if any(contains_aggregate(o.expr) for o in q.order):
            raise general("an aggregate does not belong here")
        values, sorts = [rows(i.expr) for i in items], [(rows(o.expr), o.descending) for o in q.order]
    sort_keys = [(Key(hidden(), not down, not down), v.double() if v.per is not None else v.value) for v, down in sorts]
    columns, pers = [hidden() for _ in values], [hidden() if v.per is not None else None for v in values]
    picked = [v.value.alias(c) for v, c in zip(values, columns)] + [v.per.alias(p) for v, p in zip(values, pers) if p]
    df = df.select(*picked, *[c.alias(k.name) for k, c in sort_keys], *[F.col(k.name) for k in order])
    order = [*(k for k, _ in sort_keys), *order]
    if q.limit is not None:
        df = (df.orderBy(*[k.column() for k in order]) if order else df).limit(q.limit)
    return Result(df, [i.label for i in items], [v.kind for v in values], columns, pers, order)


def as_source(name: str, r: Result) -> Source:
    """A view's result as a source; ratios become doubles."""
    df, schema = r.df, []
    for label, kind, c, p in zip(r.labels, r.kinds, r.columns, r.pers):
        new = hidden()
        df = df.withColumn(new, F.col(c) if p is None else F.col(c).cast("double") / F.col(p).cast("double"))
        schema.append(Bound(name, label, kind if p is None else "F", new))
    return Source(df.drop(*r.columns, *[p for p in r.pers if p]), schema, r.order)
