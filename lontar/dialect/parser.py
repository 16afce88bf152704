"""Parser of the dialect: text to syntax trees."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal
from typing import Any

from lontar.dialect import nodes as n
from lontar.dialect.lexer import Token, split_fields, tokenize
from lontar.engine.kinds import check_name, column_definition
from lontar.errors import EngineError, syntax

DEPTH = 128
_BINARY = {"or": "or", "and": "and", "eq": "eq", "gt": "gt", "lt": "lt", "ge": "ge", "le": "le", "plus": "add", "minus": "sub", "star": "mul", "slash": "div"}
_WORDS = {"null": None, "true": True, "benar": True, "false": False, "salah": False}


class Stream:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.i = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def take(self, kind: str, what: str = "") -> Token:
        t = self.now
        if t.kind != kind:
            raise syntax(f"expected {what or kind} at {t.at}, found {t.text or 'the end'!r}")
        self.i += 1
        return t

    def word(self, *options: str) -> str | None:
        """Take one of these keywords if it comes next."""
        if self.now.kind == "word" and self.now.text.lower() in options:
            self.i += 1
            return self.tokens[self.i - 1].text.lower()
        return None

    def need(self, option: str) -> None:
        if not self.word(option):
            raise syntax(f"expected {option} at {self.now.at}, found {self.now.text or 'the end'!r}")


def parse_expression(text: str) -> Any:
    s = Stream(tokenize(text))
    out = _expression(s, 0, 0)
    if s.now.kind != "end":
        raise syntax(f"unexpected {s.now.text!r} in {text!r}")
    _measure(out, 1)
    return out


def _measure(e: Any, depth: int) -> None:
    """A tree that is too deep is refused, whichever way it leans."""
    if depth > DEPTH:
        raise syntax(f"an expression is deeper than {DEPTH}")
    for part in (getattr(e, k, None) for k in ("left", "right", "arg")):
        if part is not None:
            _measure(part, depth + 1)


def _expression(s: Stream, least: int, depth: int) -> Any:
    if depth > DEPTH:
        raise syntax(f"an expression is deeper than {DEPTH}")
    left = _primary(s, depth)
    while (op := _BINARY.get(s.now.kind)) and (power := n.POWER[op]) >= max(least, 1):
        s.i += 1
        right = _expression(s, power + 1, depth + 1)
        left = n.Binary(op, left, right)
    return left


def _primary(s: Stream, depth: int) -> Any:
    t = s.now
    s.i += 1
    if t.kind == "number":
        return n.Lit(Decimal(t.text)) if "." in t.text or len(t.text) > 19 or int(t.text) >= 1 << 63 else n.Lit(int(t.text))
    if t.kind == "text":
        return n.Lit(t.text)
    if t.kind in ("plus", "minus"):
        return n.Unary("add" if t.kind == "plus" else "sub", _expression(s, 40, depth + 1))
    if t.kind == "star":
        return n.Star()
    if t.kind == "lparen":
        inner = _expression(s, 0, depth + 1)
        s.take("rparen", ")")
        return inner
    if t.kind == "word":
        if s.now.kind == "lparen":
            s.i += 1
            arg = _expression(s, 0, depth + 1)
            s.take("rparen", ")")
            return n.Call(t.text.lower(), arg)
        if s.now.kind == "dot":
            s.i += 1
            return n.Ref(t.text, s.take("word", "a column").text)
        if t.text.lower() in _WORDS:
            return n.Lit(_WORDS[t.text.lower()])
        return n.Ref(None, t.text)
    raise syntax(f"unexpected {t.text or 'end'!r} in an expression")


def _order(text: str) -> n.Order:
    parts = text.split()
    if len(parts) < 2 or parts[-1].lower() not in ("atas", "bawah"):
        raise syntax(f"a sort key needs Atas or Bawah: {text!r}")
    return n.Order(parse_expression(text[: text.rindex(parts[-1])]), parts[-1].lower() == "bawah")


def _select(s: Stream) -> n.Select:
    items = tuple(n.Item(parse_expression(f), f) for f in split_fields(s.take("block", "columns").text, (1, 2)))
    q = n.Select(items, ())
    seen = set()

    def once(name: str) -> None:
        if name in seen:
            raise syntax(f"{name} is repeated")
        seen.add(name)

    while s.now.kind != "endstmt":
        if s.word("dari"):
            once("Dari")
            q = replace(q, sources=tuple(check_name(x) for x in split_fields(s.take("block", "tables").text, (3,))))
        elif s.word("gabung"):
            once("Gabung Dengan")
            s.need("dengan")
            q = replace(q, join=parse_expression(s.take("block", "a join condition").text))
        elif s.word("dengan"):
            once("Dengan")
            q = replace(q, where=parse_expression(s.take("block", "a condition").text))
        elif s.word("grup"):
            once("Grup Dari")
            s.need("dari")
            q = replace(q, groups=tuple(parse_expression(f) for f in split_fields(s.take("block", "columns").text, (1, 2))))
        elif s.now.kind == "order":
            once("M:")
            s.i += 1
            q = replace(q, order=tuple(_order(f) for f in split_fields(s.take("block", "sort keys").text)))
        elif s.word("limit"):
            once("Limit")
            s.take("lparen", "(")
            number = s.take("number", "a number").text
            if not number.isdigit():
                raise syntax("a limit is a whole number")
            s.take("rparen", ")")
            q = replace(q, limit=int(number))
        else:
            raise syntax(f"unexpected {s.now.text or 'end'!r} in a query")
    if not q.sources:
        raise syntax("a query needs Dari")
    return q


def _create(s: Stream) -> Any:
    if not s.word("tabel"):
        return n.CreateDatabase(s.take("block", "a name").text)
    name = check_name(s.take("block", "a table").text)
    s.need("isi")
    names = split_fields(s.take("block", "columns").text)
    s.need("dengan")
    columns = [column_definition(f) for f in split_fields(s.take("block", "definitions").text)]
    if [c.name for c in columns] != names:
        raise syntax("definitions must name the same columns in the same order")
    while s.now.kind == "word" and s.now.text.lower().startswith("auto_"):
        auto = s.now.text[5:]
        s.i += 1
        if not auto:
            s.take("lparen", "(")
            auto = s.take("word", "a column").text
            s.take("rparen", ")")
        if auto not in names:
            raise syntax(f"no such column for Auto_: {auto}")
        columns = [replace(c, auto=True) if c.name == auto else c for c in columns]
    return n.CreateTable(name, tuple(columns))


def _sets(text: str) -> tuple[tuple[str, Any, str], ...]:
    out = []
    for f in split_fields(text):
        name, eq, right = f.partition("=")
        if not eq:
            raise syntax(f"not an assignment: {f!r}")
        try:
            expr = parse_expression(right)
        except EngineError:  # free text for a text column; the analyzer decides
            expr = None
        out.append((check_name(name.strip()), expr, right.strip()))
    return tuple(out)


def parse(text: str) -> Any:
    """One statement with its terminator."""
    s = Stream(tokenize(text))
    out = _statement(s)
    s.take("endstmt", "-:")
    if s.now.kind != "end":
        raise syntax("one statement at a time")
    return out


def _where(s: Stream) -> Any:
    return parse_expression(s.take("block", "a condition").text) if s.word("dengan") else None


def _statement(s: Stream) -> Any:
    if s.word("explain"):
        s.need("pilih")
        return n.Explain(_select(s))
    if s.word("buat"):
        return _create(s)
    if s.word("pilih"):
        after = s.tokens[s.i + 1] if s.i + 1 < len(s.tokens) else s.now
        return n.UseDatabase(s.take("block", "a name").text) if after.kind == "endstmt" else _select(s)
    if s.word("isi"):
        s.need("tabel")
        table, rows = s.take("block", "a table").text, []
        while s.now.kind == "block":
            rows.append(tuple(split_fields(s.take("block").text, data=True)))
        if not rows:
            raise syntax("no rows")
        return n.Insert(table, tuple(rows))
    if s.word("tampilkan"):
        return n.Select((n.Item(n.Star(), "*"),), (s.take("block", "a table").text,))
    if s.word("tabel_upt"):
        table = s.take("block", "a table").text
        if s.now.kind == "plus":
            s.i += 1
            s.need("kolom")
            name = s.take("block", "a column").text
            s.need("dengan")
            column = column_definition(s.take("block", "a definition").text)
            if column.name != name:
                raise syntax("the definition names another column")
            return n.AddColumn(table, column)
        s.need("isi")
        return n.Update(table, _sets(s.take("block", "assignments").text), _where(s))
    if s.word("kolom_rmv"):
        table, dot, column = s.take("block", "table.column").text.partition(".")
        if not dot:
            raise syntax("expected table.column")
        return n.DropColumn(check_name(table), check_name(column))
    if s.word("baris_rmv"):
        return n.Delete(s.take("block", "a table").text, _where(s))
    if s.word("tabel_rmv"):
        return n.DropTable(s.take("block", "a table").text)
    if s.word("lihat"):
        name = check_name(s.take("block", "a view").text)
        s.need("pilih")
        return n.CreateView(name, _select(s))
    if action := s.word("transaksi", "gabungkan", "kembalikan"):
        return n.Transaction({"transaksi": "begin", "gabungkan": "commit", "kembalikan": "rollback"}[action])
    raise syntax(f"unknown statement: {s.now.text or 'nothing'!r}")
