"""Syntax trees of the dialect, and their text."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from lontar.engine.kinds import ColumnDef


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Ref:
    source: str | None
    name: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Call:
    name: str
    arg: Any


@dataclass(frozen=True)
class Item:
    expr: Any
    label: str


@dataclass(frozen=True)
class Order:
    expr: Any
    descending: bool


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    sources: tuple[str, ...]
    join: Any = None
    where: Any = None
    groups: tuple[Any, ...] = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Explain:
    query: Select


@dataclass(frozen=True)
class CreateDatabase:
    name: str


@dataclass(frozen=True)
class UseDatabase:
    name: str


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Update:
    """sets: (column, expression or None, its text)."""

    table: str
    sets: tuple[tuple[str, Any, str], ...]
    where: Any = None


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: ColumnDef


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any = None


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class CreateView:
    name: str
    query: Select


@dataclass(frozen=True)
class Transaction:
    action: str


MARK = {"add": "+", "sub": "-", "mul": "*", "div": "/", "eq": "=", "gt": ">", "lt": "<", "ge": ">=", "le": "<=", "and": "&:", "or": "O:"}
POWER = {"or": 4, "and": 5, "eq": 10, "gt": 10, "lt": 10, "ge": 10, "le": 10, "add": 20, "sub": 20, "mul": 30, "div": 30}


def expr_text(e: Any, above: int = 0) -> str:
    if isinstance(e, Lit):
        if e.value is None:
            return "NULL"
        if isinstance(e.value, bool):
            return "true" if e.value else "false"
        return '"' + e.value.replace('"', '""') + '"' if isinstance(e.value, str) else f"{e.value:f}" if not isinstance(e.value, int) else str(e.value)
    if isinstance(e, Ref):
        return f"{e.source}.{e.name}" if e.source else e.name
    if isinstance(e, Star):
        return "*"
    if isinstance(e, Call):
        return f"{e.name.capitalize()}({expr_text(e.arg)})"
    if isinstance(e, Unary):
        return f"{MARK[e.op]}{expr_text(e.arg, 40)}"
    p = POWER[e.op]
    out = f"{expr_text(e.left, p)} {MARK[e.op]} {expr_text(e.right, p + 1)}"
    return f"({out})" if p < above else out


def select_text(q: Select) -> str:
    """A statement that parses to the same query."""
    block = lambda text: "'" + text.replace("'", "''") + "'"
    out = ["Pilih", block(" & ".join(i.label if not isinstance(i.expr, Star) else "*" for i in q.items)), "Dari", block(" &&& ".join(q.sources))]
    if q.join is not None:
        out += ["Gabung Dengan", block(expr_text(q.join))]
    if q.where is not None:
        out += ["Dengan", block(expr_text(q.where))]
    if q.groups:
        out += ["Grup Dari", block(" & ".join(map(expr_text, q.groups)))]
    if q.order:
        out += ["M:", block(" & ".join(f"{expr_text(o.expr)} {'Bawah' if o.descending else 'Atas'}" for o in q.order))]
    if q.limit is not None:
        out.append(f"Limit({q.limit})")
    return " ".join([*out, "-:"])
