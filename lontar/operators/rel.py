"""The relational API: a lazy relation over a DataFrame, with the order of its rows as metadata.

Operators only build the plan; Catalyst chooses how to run it. Order costs nothing until it is
asked for: it is a list of sort keys in hidden columns, which filters and projections carry along, joins
append (left-major), groups reduce to their first row, and `ordered`, `rlimit` and `rdistinct` apply.
A relation made with ordered=False has no order, and its plans carry no hidden columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lontar.errors import general, type_error
from lontar.functions.aggregates import Agg
from lontar.functions.scalars import col

_fresh = itertools.count()


def hidden() -> str:
    return f"__ord{next(_fresh)}"


@dataclass(frozen=True)
class Key:
    """A sort key in a hidden column."""

    name: str
    ascending: bool = True
    nulls_last: bool = True

    def column(self) -> Column:
        c = F.col(self.name)
        if self.ascending:
            return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()
        return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    columns: tuple[str, ...]
    order: tuple[Key, ...] = field(default=())

    def __getitem__(self, name: str) -> Column:
        if name not in self.columns:
            raise general(f"no such column: {name}")
        return F.col(f"`{name}`")

    def _hidden(self) -> list[Column]:
        return [F.col(k.name) for k in self.order]

    def frame(self) -> DataFrame:
        """The visible columns, in no particular order of rows."""
        return self.df.select(*[self[c].alias(c) for c in self.columns])

    def ordered(self) -> DataFrame:
        """The visible columns, in the order of the relation."""
        df = self.df.orderBy(*[k.column() for k in self.order]) if self.order else self.df
        return df.select(*[self[c].alias(c) for c in self.columns])

    def collect(self) -> list[tuple]:
        return [tuple(r) for r in self.ordered().collect()]


def relation(df: DataFrame, columns: Sequence[str] | None = None, prefix: str = "", ordered: bool = False, by: str | None = None) -> Rel:
    """A scan. `by` names a column with the order; else ordered=True numbers the rows as they are read."""
    names = list(df.columns if columns is None else columns)
    picked = [F.col(f"`{c}`").alias(prefix + c) for c in names]
    keys: tuple[Key, ...] = ()
    if ordered or by:
        keys = (Key(hidden()),)
        picked.append((F.col(by) if by else F.monotonically_increasing_id()).alias(keys[0].name))
    return Rel(df.select(*picked), tuple(prefix + c for c in names), keys)


def rel_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[Any]], schema: str | T.StructType | None = None) -> Rel:
    """A relation of given rows."""
    if len(set(columns)) != len(columns):
        raise general("column names repeat")
    if any(len(r) != len(columns) for r in rows):
        raise general("a row has not as many values as there are columns")
    name = hidden()
    if schema is None:
        schema = ", ".join(f"`{c}` {_infer([r[i] for r in rows])}" for i, c in enumerate(columns))
    struct = T.StructType([*(schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)), T.StructField(name, T.LongType(), False)])
    return Rel(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], struct), tuple(columns), (Key(name),))


def _infer(values: list[Any]) -> str:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return "string"
    if len(kinds) > 1:
        raise type_error(f"a column mixes {sorted(k.__name__ for k in kinds)}")
    return {"int": "bigint", "str": "string", "bool": "boolean", "float": "double", "Decimal": "decimal(38,18)", "date": "date", "datetime": "timestamp_ntz"}[kinds.pop().__name__]


def _boolean(t: Rel, predicate: Column | Callable[[Rel], Column]) -> Column:
    p = predicate(t) if callable(predicate) and not isinstance(predicate, Column) else predicate
    kind = t.df.select(p.alias("p")).schema[0].dataType
    if not isinstance(kind, (T.BooleanType, T.NullType)):
        raise type_error("a predicate is not Boolean")
    return p.cast("boolean")


def rfilter(t: Rel, predicate: Column | Callable[[Rel], Column]) -> Rel:
    return Rel(t.df.filter(_boolean(t, predicate)), t.columns, t.order)


def rmap(t: Rel, columns: Sequence[str] | Mapping[str, Any], f: Callable[[Rel], Sequence[Any]] | None = None) -> Rel:
    """New columns from expressions: a mapping, or names and a function that gives the expressions."""
    made = dict(columns) if isinstance(columns, Mapping) else dict(zip(columns, f(t), strict=True))
    return Rel(t.df.select(*[col(e).alias(n) for n, e in made.items()], *t._hidden()), tuple(made), t.order)


def rproject(t: Rel, columns: Sequence[str]) -> Rel:
    if len(set(columns)) != len(columns):
        raise general("column names repeat")
    return Rel(t.df.select(*[t[c].alias(c) for c in columns], *t._hidden()), tuple(columns), t.order)


def rrename(t: Rel, names: Mapping[str, str]) -> Rel:
    for old in names:
        t[old]
    new = [names.get(c, c) for c in t.columns]
    if len(set(new)) != len(new):
        raise general("column names repeat")
    return Rel(t.df.select(*[t[c].alias(n) for c, n in zip(t.columns, new)], *t._hidden()), tuple(new), t.order)


KINDS = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}


def hashjoin(left: Rel, right: Rel, on: Mapping[str, str] | Sequence[tuple[str, str]] = (), kind: str = "inner", predicate: Column | Callable[[Rel], Column] | None = None) -> Rel:
    """Equi-join on pairs of columns; without pairs a Cartesian product.

    `predicate` belongs to the join condition, so a left join keeps rows that fail it, and sees the columns of
    both sides under their result names. A right column whose name is taken gets the suffix _right, repeated as needed.
    """
    if kind not in KINDS:
        raise general(f"no such join: {kind}")
    pairs = list(on.items() if isinstance(on, Mapping) else on)
    names: dict[str, str] = {}
    taken = set(left.columns)
    for c in right.columns:
        new = c
        while new in taken:
            new += "_right"
        taken.add(new)
        names[c] = new
    # Hidden names are new as well, so a relation can be joined with itself.
    keys = tuple(Key(hidden(), k.ascending, k.nulls_last) for k in right.order)
    r = right.df.select(*[right[c].alias(names[c]) for c in right.columns], *[F.col(k.name).alias(n.name) for k, n in zip(right.order, keys)])
    both = Rel(left.df, (*left.columns, *names.values()), (*left.order, *keys))
    condition = None
    for a, b in pairs:
        right[b]
        left_type, right_type = (isinstance(x.df.select(x[c]).schema[0].dataType, T.NumericType) for x, c in ((left, a), (right, b)))
        if left_type != right_type and "void" not in (dict(left.df.dtypes)[a], dict(right.df.dtypes)[b]):
            raise type_error(f"join columns {a} and {b} have different kinds")
        one = F.col(f"`{a}`") == F.col(f"`{names[b]}`")
        condition = one if condition is None else condition & one
    if predicate is not None:
        p = predicate(both) if callable(predicate) and not isinstance(predicate, Column) else predicate
        condition = p if condition is None else condition & p
    if condition is None:
        condition = F.lit(True)
    joined = left.df.join(r, condition, KINDS[kind])
    if kind in ("semi", "anti"):
        return Rel(joined, left.columns, left.order)
    return Rel(joined, both.columns, both.order)


def rising(k: Key, kind: T.DataType) -> list[Column]:
    """Columns whose ascending order is that of the key, so that the first row of a group is a plain minimum."""
    x = F.col(k.name)
    null = x.isNull() if k.nulls_last else x.isNotNull()
    if k.ascending:
        return [null, x]
    if isinstance(kind, T.BooleanType):
        return [null, ~x]
    if isinstance(kind, T.IntegralType):
        return [null, -x.cast("decimal(20,0)")]
    if isinstance(kind, T.DecimalType):
        return [null, -x]
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # NaN is above all numbers
        return [null, ~F.isnan(x), -x]
    # Byte by byte downwards; the mark at the end, above all digits, puts a longer text before its beginning.
    text = x if isinstance(kind, (T.StringType, T.BinaryType)) else x.cast("string")
    return [null, F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))]


def groupby(t: Rel, keys: Sequence[str], aggregates: Mapping[str, Agg]) -> Rel:
    """Groups in order of their first row. NULL keys form a group. No keys: one row."""
    if len({*keys, *aggregates}) != len(keys) + len(aggregates):
        raise general("column names repeat")
    if not keys:
        return Rel(t.df.agg(*[a.make().alias(n) for n, a in aggregates.items()]), tuple(aggregates))
    df, order = t.df, t.order
    kinds = {f.name: f.dataType for f in df.schema.fields}
    first = [F.min(F.struct(*[x for k in order for x in rising(k, kinds[k.name])])).alias(hidden())] if order else []
    made = [a.make().alias(n) for n, a in aggregates.items()] + first
    grouped = df.groupBy(*[t[k] for k in keys])
    out = grouped.agg(*made) if made else df.select(*[t[k] for k in keys]).distinct()
    return Rel(out, (*keys, *aggregates), (Key(out.columns[-1]),) if order else ())


def raggregate(t: Rel, aggregate: Agg) -> Any:
    """The value of one aggregate over all rows; runs the plan."""
    return t.df.agg(aggregate.make().alias("x")).first()[0]


def scalar(t: Rel, name: str, aggregate: Agg) -> Rel:
    """The same as a relation of one row and one column, to be joined without running it."""
    return Rel(t.df.agg(aggregate.make().alias(name)), (name,))


def rsort(t: Rel, keys: Sequence[tuple[Any, str]], nulls: str | Sequence[str] = "last") -> Rel:
    """Stable sort by (column or expression, "asc" or "desc"); NULLs "last" or "first", for all keys or each."""
    where = [nulls] * len(keys) if isinstance(nulls, str) else list(nulls)
    if len(where) != len(keys) or any(d not in ("asc", "desc") for _, d in keys) or any(n not in ("first", "last") for n in where):
        raise general("bad sort keys")
    made = [(Key(hidden(), d == "asc", n == "last"), col(c)) for (c, d), n in zip(keys, where)]
    df = t.df.select("*", *[c.alias(k.name) for k, c in made])
    return Rel(df, t.columns, (*(k for k, _ in made), *t.order))


def rlimit(t: Rel, n: int, offset: int = 0) -> Rel:
    if n < 0 or offset < 0:
        raise general("limit and offset must not be negative")
    df = t.df.orderBy(*[k.column() for k in t.order]) if t.order else t.df
    return Rel((df.offset(offset) if offset else df).limit(n), t.columns, t.order)


def rdistinct(t: Rel, columns: Sequence[str] | None = None) -> Rel:
    """The first row of each key (all columns, or those given)."""
    keys = list(t.columns if columns is None else columns)
    if not t.order:
        return Rel(t.df.dropDuplicates(keys), t.columns)
    name = hidden()
    first = Window.partitionBy(*[t[k] for k in keys]).orderBy(*[k.column() for k in t.order])
    df = t.df.withColumn(name, F.row_number().over(first)).filter(F.col(name) == 1).drop(name)
    return Rel(df, t.columns, t.order)


def runion(a: Rel, b: Rel, all: bool = True) -> Rel:  # noqa: A002
    """By position, with the names of the first; all=False leaves the first of equal rows."""
    if len(a.columns) != len(b.columns):
        raise general("the relations differ in width")
    right = b.df.select(*[b[c].alias(n) for c, n in zip(b.columns, a.columns)], *b._hidden())
    if not (a.order or b.order):
        out = Rel(a.frame().union(right), a.columns)
        return out if all else Rel(out.df.distinct(), a.columns)
    branch = hidden()
    df = a.df.select(*[a[c].alias(c) for c in a.columns], *a._hidden(), F.lit(0).alias(branch)).unionByName(right.withColumn(branch, F.lit(1)), allowMissingColumns=True)
    out = Rel(df, a.columns, (Key(branch), *a.order, *b.order))
    return out if all else rdistinct(out)
