"""The dialect from text to result: trees and values made by rule, and statements held against small models in Python."""

import datetime as dt
import itertools
import os
import random
from decimal import Decimal
from fractions import Fraction

import pytest

from lontar.dialect import nodes as n
from lontar.dialect.lexer import split_fields, split_statements, tokenize
from lontar.dialect.parser import parse, parse_expression
from lontar.engine.catalog import Database
from lontar.engine.formatter import QueryResult, table, to_json, value_text
from lontar.engine.kinds import SPARK, column_definition, field_value, from_text
from lontar.engine.session import Session
from lontar.errors import EngineError


@pytest.fixture
def port(spark, tmp_path):
    out = Session(spark, str(tmp_path))
    out.execute("Buat 'pelabuhan' -:")
    return out


def refused(session, *texts, category=None):
    for text in texts:
        with pytest.raises(EngineError) as e:
            session.execute(text)
        assert category is None or e.value.category == category, text


# --- text and trees

COLUMNS = ("berat", "muatan", "tiba", "dermaga_3")


def tree(r, depth):
    """A random expression that the grammar can write."""
    if depth == 0 or r.random() < 0.2:
        return r.choice([n.Lit(r.randint(0, 10**6)), n.Lit(Decimal(r.randint(1, 999)) / 8), n.Lit(r.choice(["", "dua kata", 'kutip " dua', "a & b", "it's"])), n.Lit(None), n.Lit(True), n.Lit(False), n.Ref(None, r.choice(COLUMNS)), n.Ref("kapal", r.choice(COLUMNS))])
    kind = r.random()
    if kind < 0.7:
        return n.Binary(r.choice(["or", "and", "eq", "gt", "lt", "ge", "le", "add", "sub", "mul", "div"]), tree(r, depth - 1), tree(r, depth - 1))
    if kind < 0.85:
        return n.Unary(r.choice(["add", "sub"]), tree(r, depth - 1))
    return n.Call(r.choice(["sum", "avg", "min", "max", "count", "countif"]), tree(r, depth - 1))


def test_trees_survive_their_text():
    r = random.Random(11)
    for _ in range(500):
        e = tree(r, r.randint(0, 5))
        assert parse_expression(n.expr_text(e)) == e, n.expr_text(e)
    for _ in range(200):
        exprs = [tree(r, 2) for _ in range(r.randint(1, 3))]
        several = r.random() < 0.5
        q = n.Select(tuple(n.Item(e, n.expr_text(e)) for e in exprs), ("kapal", "dermaga") if several else ("kapal",), n.Binary("eq", n.Ref("kapal", "a"), n.Ref("dermaga", "b")) if several else None, tree(r, 3) if r.random() < 0.5 else None, tuple(n.Ref(None, c) for c in r.sample(COLUMNS, r.randint(0, 2))), tuple(n.Order(tree(r, 1), r.random() < 0.5) for _ in range(r.randint(0, 2))), r.choice([None, 0, 7]))
        assert parse(n.select_text(q)) == q, n.select_text(q)


def test_precedence_follows_the_table():
    """Without parentheses, of two operators the one with the greater power holds its operands; equal ones lean left."""
    marks = {"or": "O:", "and": "&:", "eq": "=", "gt": ">", "lt": "<", "ge": ">=", "le": "<=", "add": "+", "sub": "-", "mul": "*", "div": "/"}
    a, b, c = (n.Ref(None, x) for x in "xyz")
    for (f, mf), (g, mg) in itertools.product(marks.items(), repeat=2):
        want = n.Binary(f, a, n.Binary(g, b, c)) if n.POWER[g] > n.POWER[f] else n.Binary(g, n.Binary(f, a, b), c)
        assert parse_expression(f"x {mf} y {mg} z") == want
    assert [n.POWER[x] for x in ("or", "and", "eq", "add", "mul")] == sorted({n.POWER[x] for x in marks})


VALID = [
    "Buat 'gudang' -:", "Pilih 'gudang' -:", "Buat Tabel 'peti' Isi 'no & isi' Dengan 'no = I(P) & isi = C(30)' Auto_no -:", "Isi Tabel 'peti' 'teh' 'kopi' -:", "Tampilkan 'peti' -:",
    "Pilih 'no && isi' Dari 'peti &&& gudang' Gabung Dengan 'peti.no = gudang.no' Dengan 'no > 2' Grup Dari 'no' M: 'no Bawah' Limit(4) -:", "Tabel_Upt 'peti' Isi 'isi = \"gula\"' Dengan 'no = 1' -:", "Tabel_Upt 'peti' + Kolom 'asal' Dengan 'asal = C' -:",
    "Kolom_Rmv 'peti.isi' -:", "Baris_Rmv 'peti' Dengan 'no = 1' -:", "Tabel_Rmv 'peti' -:", "Lihat 'semua' Pilih '*' Dari 'peti' -:", "Transaksi -:", "Gabungkan -:", "Kembalikan -:", "EXPLAIN Pilih '*' Dari 'peti' -:",
]


def test_statements_and_what_is_missing():
    """Every statement parses in any case and spacing, and not without its end or one of its parts; rows of an insert after the first may go."""
    optional = []
    for text in VALID:
        whole = parse(text)
        if "Auto_" not in text:  # the name of a column follows
            outside = "".join(p.swapcase() if i % 2 == 0 else f"'{p}'" for i, p in enumerate(text.split("'")))
            assert parse(outside.replace(" ", " \n\t ", 1) + " # tail") == whole
        for bad in (text[:-2], text + " " + text, "-: " + text, "zzz " + text):
            with pytest.raises(EngineError):
                parse(bad)
        tokens = tokenize(text)[:-1]
        for i, t in enumerate(tokens):
            if t.kind == "block":
                try:
                    parse(text[: t.at] + text[tokens[i + 1].at :])
                    optional.append((text.split()[0], t.text))
                except EngineError:
                    pass
    # Of an insert a row may go, and the table's name, for which the first row then stands.
    assert set(optional) == {("Isi", "peti"), ("Isi", "teh"), ("Isi", "kopi")}


def test_tokens_and_separators():
    marks = ["&", "&&", "&&&", "&:", "-:", ">=", "<=", ">", "<", "=", "(", ")", "+", "*", "/"]
    r = random.Random(5)
    for _ in range(100):
        some = r.choices(marks, k=6)
        assert [t.text for t in tokenize(" ".join(some))[:-1]] == some
    for body in ("", "it's", "a''b", "''", '"'):
        assert tokenize("'" + body.replace("'", "''") + "'")[0].text == body
        assert tokenize('"' + body.replace('"', '""') + '"')[0].text == body
    for bad in ("'no end", '"no end', "&" * 4, "$", "a ? b"):
        with pytest.raises(EngineError):
            tokenize(bad)
    parts = ["x", "C(5&Not Null)", '"p & q"', "y &: z"]
    for width in (1, 2, 3):
        assert split_fields(f" {'&' * width} ".join(parts), (width,)) == parts
        with pytest.raises(EngineError):
            split_fields(f"a {'&' * width} b", tuple({1, 2, 3} - {width}))
    whole, rest = split_statements("".join(f"{t} # note -: here\n" for t in VALID) + "Pilih 'open")
    assert [parse(t) for t in whole] == [parse(t) for t in VALID] and rest.strip() == "Pilih 'open"


def test_depth_is_bounded():
    for k in (40, 120):
        parse_expression("(" * k + "1" + ")" * k)
        parse_expression("1" + " + 1" * k)
    for k in (200, 5000):
        for deep in ("1" + " + 1" * k, "- " * k + "1"):
            with pytest.raises(EngineError):
                parse_expression(deep)


# --- kinds

EDGE = {  # by kind: (text, value) taken, and texts refused
    "I": ([(str(v), v) for v in (0, -1, 2**63 - 1, -(2**63))] + [("12.000", 12)], [str(2**63), str(-(2**63) - 1), "0.5", "1e3", "satu", ""]),
    "D": ([("0." + "0" * 17 + "7", Decimal(7).scaleb(-18)), ("-3", Decimal(-3)), (".5", Decimal("0.5"))], ["0." + "0" * 18 + "7", "1" * 21, "x"]),
    "U": ([("12.34", Decimal("12.34")), ("-0.10", Decimal("-0.10")), ("5", Decimal(5))], ["0.001", "1,5", "9" * 37]),
    "F": ([("1e-3", 0.001), ("-2.5", -2.5)], ["nan", "inf", "-inf", "1e999", "besar"]),
    "B": ([("TRUE", True), ("benar", True), ("False", False), ("salah", False)], ["1", "ya", "t"]),
    "C": ([("  padded ", "  padded "), ("é" * 255, "é" * 255)], ["é" * 256]),
    "T": ([("2024-02-29", dt.date(2024, 2, 29)), ("0001-01-01", dt.date(1, 1, 1))], ["2023-02-29", "2024-13-01", "24-01-01", "2024-1-1"]),
    "W": ([("00:00:00", 0), ("23:59:59.999999999", 86_400 * 10**9 - 1), ("7:05:00", 25_500 * 10**9)], ["24:00:00", "12:60:00", "12:00:60", "12:00", "12:00:00.1234567890"]),
    "TW": ([("2024-02-29 12:00:00.5", dt.datetime(2024, 2, 29, 12, 0, 0, 500000)), ("1999-12-31T23:59:59", dt.datetime(1999, 12, 31, 23, 59, 59))], ["2023-02-29 00:00:00", "2024-01-01", "2024-01-01 25:00:00"]),
}


@pytest.mark.parametrize("kind", sorted(SPARK))
def test_values_of_a_kind(kind):
    c = column_definition(f"nilai = {kind.lower()}")
    assert (c.name, c.kind, c.nullable, c.unique, c.primary) == ("nilai", kind, True, False, False)
    for text, value in EDGE[kind][0]:
        got = from_text(c, text)
        assert got == value and type(got) is type(value)
        assert field_value(c, f'"{text}"') == value and field_value(c, "") is None and field_value(c, "nUlL") is None
    for text in EDGE[kind][1]:
        with pytest.raises(EngineError):
            from_text(c, text)


def test_flags_of_definitions():
    """Any set of flags without a repeat or a contradiction is taken, in any order."""
    flags = ["P", "N", "Null", "Not Null", "9"]
    for k in range(4):
        for some in itertools.permutations(flags, k):
            text = f"x = C({'&'.join(some)})" if some else "x = C"
            clash = "Null" in some and bool({"P", "Not Null"} & set(some))
            if clash:
                with pytest.raises(EngineError):
                    column_definition(text)
            else:
                c = column_definition(text)
                assert (c.primary, c.unique, c.nullable, c.max_length) == ("P" in some, "N" in some, not {"P", "Not Null"} & set(some), 9 if "9" in some else 255)
    for bad in ["x = C(" + "&".join([f, f]) + ")" for f in flags] + ["x = I(9)", "x = Q", "x I", "= I", "x = C(0)", "x = C(P", "1x = I"]:
        with pytest.raises(EngineError):
            column_definition(bad)


# --- queries against a model: rows as dicts, exact numbers as fractions, NULL as None

SHIPS = [{"no": i + 1, "berat": w, "isi": c, "dok": d, "siap": b} for i, (w, c, d, b) in enumerate([(Decimal("12.50"), 3, "utara", True), (None, 7, "utara", False), (Decimal("0.25"), None, "selatan", None), (Decimal("-4.00"), 7, None, True), (Decimal("12.50"), 0, "timur", False), (Decimal("99.75"), -2, "selatan", True), (None, None, None, None), (Decimal("3.10"), 3, "utara", False)])]


def field(v):
    return "NULL" if v is None else '"' + v.replace('"', '""') + '"' if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


@pytest.fixture
def ships(port):
    port.execute("Buat Tabel 'kapal' Isi 'no & berat & isi & dok & siap' Dengan 'no = I(P) & berat = U & isi = I & dok = C(12) & siap = B' -:")
    port.execute("Isi Tabel 'kapal' " + " ".join("'" + " & ".join(field(v) for v in row.values()).replace("'", "''") + "'" for row in SHIPS) + " -:")
    return port


def value(e, row):
    """The model of an expression over one row: three-valued logic, exact arithmetic."""
    if isinstance(e, n.Lit):
        return Fraction(e.value) if isinstance(e.value, (int, Decimal)) and not isinstance(e.value, bool) else e.value
    if isinstance(e, n.Ref):
        v = row[e.name]
        return Fraction(v) if isinstance(v, (int, Decimal)) and not isinstance(v, bool) else v
    if isinstance(e, n.Unary):
        v = value(e.arg, row)
        return None if v is None else -v if e.op == "sub" else v
    a, b = value(e.left, row), value(e.right, row)
    if e.op in ("and", "or"):
        strong = e.op == "or"
        return strong if strong in (a, b) else None if None in (a, b) else not strong
    if a is None or b is None:
        return None
    return {"eq": lambda: a == b, "gt": lambda: a > b, "lt": lambda: a < b, "ge": lambda: a >= b, "le": lambda: a <= b, "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: a / b}[e.op]()


def number(r, depth):
    if depth == 0:
        return r.choice([n.Ref(None, "berat"), n.Ref(None, "isi"), n.Ref(None, "no"), n.Lit(r.randint(0, 9)), n.Lit(Decimal("0.75"))])
    op = r.choice(["add", "sub", "mul", "div"])
    return n.Binary(op, number(r, depth - 1), n.Lit(r.randint(1, 7)) if op == "div" else number(r, depth - 1))


def truth(r, depth):
    if depth == 0:
        return r.choice([lambda: n.Ref(None, "siap"), lambda: n.Binary(r.choice(["eq", "gt", "lt", "ge", "le"]), number(r, 1), number(r, 1)), lambda: n.Binary(r.choice(["eq", "lt"]), n.Ref(None, "dok"), n.Lit(r.choice(["utara", "timur"]))), lambda: n.Binary("eq", n.Ref(None, "isi"), n.Lit(None))])()
    return n.Binary(r.choice(["and", "or"]), truth(r, depth - 1), truth(r, depth - 1))


def plain(v):
    return Fraction(v) if isinstance(v, (int, Decimal, Fraction)) and not isinstance(v, bool) else v


def test_expressions_against_the_model(ships):
    r = random.Random(21)
    exprs = [number(r, r.randint(1, 2)) for _ in range(25)] + [truth(r, r.randint(0, 2)) for _ in range(25)]
    got = ships.execute(f"Pilih '{' & '.join(n.expr_text(e) for e in exprs)}' Dari 'kapal' -:".replace("''", "'")).rows
    for row, values in zip(SHIPS, got, strict=True):
        for e, v in zip(exprs, values, strict=True):
            assert plain(v) == value(e, row), (n.expr_text(e), row, v)
    for _ in range(6):
        where = truth(r, 2)
        got = ships.execute(f"Pilih 'no' Dari 'kapal' Dengan '{n.expr_text(where)}' -:").rows
        assert [v for v, in got] == [row["no"] for row in SHIPS if value(where, row) is True], n.expr_text(where)


def test_order_against_the_model(ships):
    """Stable, NULL last upwards and first downwards."""
    for keys in itertools.chain(itertools.product(["berat", "isi", "dok"], ["Atas", "Bawah"]), [("dok", "Bawah", "berat", "Atas"), ("isi", "Atas", "dok", "Bawah", "berat", "Bawah")]):
        rows = list(SHIPS)
        pairs = list(zip(keys[::2], keys[1::2]))
        for name, way in reversed(pairs):
            held = [x for x in rows if x[name] is not None]
            held.sort(key=lambda x: x[name], reverse=way == "Bawah") if way == "Atas" else held.sort(key=lambda x: [x[name]], reverse=True)
            none = [x for x in rows if x[name] is None]
            rows = held + none if way == "Atas" else none + held
        got = ships.execute(f"Pilih 'no' Dari 'kapal' M: '{' & '.join(f'{a} {b}' for a, b in pairs)}' Limit(6) -:").rows
        assert [v for v, in got] == [x["no"] for x in rows][:6], keys


@pytest.mark.parametrize("key", ["dok", "isi", "siap"])
def test_groups_against_the_model(ships, key):
    """Groups in order of their first row; the same from a view that is sorted downwards."""
    ships.execute("Lihat 'turun' Pilih '*' Dari 'kapal' M: 'berat Bawah & dok Bawah & siap Bawah' -:")
    down = [row for row, in [(x,) for x in ships.execute("Tampilkan 'turun' -:").rows]]
    for source, rows in (("kapal", SHIPS), ("turun", [dict(zip(SHIPS[0], x)) for x in down])):
        want = {}
        for row in rows:
            want.setdefault(row[key], []).append(row)
        out = []
        for k, held in want.items():
            w, c = [Fraction(x["berat"]) for x in held if x["berat"] is not None], [x["isi"] for x in held if x["isi"] is not None]
            out.append([plain(k), len(held), len(c), sum(x["siap"] is True for x in held), sum(w) if w else None, sum(w) / len(w) if w else None, min(c, default=None), max(w, default=None), 2 * sum(c) + len(held) if c else None])
        got = ships.execute(f"Pilih '{key} & Count(*) & Count(isi) & Countif(siap) & Sum(berat) & Avg(berat) & Min(isi) & Max(berat) & 2 * Sum(isi) + Count(*)' Dari '{source}' Grup Dari '{key}' -:").rows
        assert [[plain(v) for v in x] for x in got] == out
    assert ships.execute("Pilih 'Count(*) & Sum(isi) & Avg(isi) & Countif(siap)' Dari 'kapal' Dengan 'no > 100' -:").rows == [[0, None, None, 0]]


def test_joins_against_nested_loops(ships):
    ships.execute("Buat Tabel 'dermaga' Isi 'nama & dalam' Dengan 'nama = C & dalam = D' -:")
    ships.execute("Buat Tabel 'awak' Isi 'kapal_no & orang' Dengan 'kapal_no = D & orang = C' -:")
    docks, crew = [("utara", 3), ("selatan", 7), ("utara", 9), (None, 1), ("barat", 2)], [(1, "ani"), (1, "budi"), (3, "citra"), (8, "dodi"), (None, "eka"), (42, "fani")]
    ships.execute("Isi Tabel 'dermaga' " + " ".join(f"'{field(a)} & {b}'" for a, b in docks) + " -:")
    ships.execute("Isi Tabel 'awak' " + " ".join(f"'{field(a)} & {field(b)}'" for a, b in crew) + " -:")
    two = ships.execute("Pilih 'kapal.no && dermaga.dalam' Dari 'kapal &&& dermaga' Gabung Dengan 'kapal.dok = dermaga.nama' -:").rows
    assert two == [[x["no"], d] for x in SHIPS for name, d in docks if x["dok"] is not None and x["dok"] == name]
    three = "Pilih 'awak.orang && dermaga.dalam' Dari 'kapal &&& dermaga &&& awak' Gabung Dengan 'kapal.dok = dermaga.nama &: awak.kapal_no = kapal.no' Dengan 'dermaga.dalam < 9' -:"
    assert ships.execute(three).rows == [[p, d] for x in SHIPS for name, d in docks for k, p in crew if x["dok"] == name is not None and k == x["no"] and d < 9]
    bad = ["kapal.no > dermaga.dalam", "kapal.no = kapal.isi", "kapal.dok = dermaga.dalam", "kapal.siap = dermaga.nama", "kapal.no = awak.kapal_no"]
    refused(ships, *(f"Pilih '*' Dari 'kapal &&& dermaga' Gabung Dengan '{x}' -:" for x in bad), "Pilih '*' Dari 'kapal &&& dermaga' -:", "Pilih '*' Dari 'kapal &&& kapal' Gabung Dengan 'kapal.no = kapal.no' -:")
    plan = [x for x, in ships.execute("EXPLAIN " + three).rows]
    assert plan[0].startswith("Query: ") and {"Scan kapal (rows=8)", "Scan dermaga (rows=5)", "Scan awak (rows=6)"} <= set(plan) and sum("Hash Join" in x for x in plan) == 2 and any(x.startswith("Join order: ") for x in plan)


def test_queries_that_make_no_sense(ships):
    """A wrong kind, name, or place of an aggregate is found before anything runs."""
    words, numbers = ["dok", '"x"'], ["no", "berat", "1.5"]
    wrong = [f"{w} {op} {x}" for w in words for x in numbers for op in ("+", "*", "=", "<")] + [f"{x} &: siap" for x in words + numbers] + ["hilang", "kapal.hilang", "lain.no", "Sum(Sum(no))", "Sum(dok)", "Countif(no)", "Sum(*)", "Max()", "Median(no)", "Integral(no)", "siap + 1"]
    refused(ships, *(f"Pilih '{x}' Dari 'kapal' -:" for x in wrong))
    refused(ships, *(f"Pilih 'no' Dari 'kapal' {x} -:" for x in ("Dengan 'no'", "Dengan 'Sum(no) > 1'", "M: 'Max(no) Atas'", "Grup Dari 'isi'", "Grup Dari 'no & no'", "Grup Dari 'no + 1'")), "Pilih 'no & Sum(isi)' Dari 'kapal' -:", "Tampilkan 'hilang' -:")
    with pytest.raises(Exception, match="division by zero"):
        ships.execute("Pilih 'no / (isi - isi)' Dari 'kapal' -:")


def test_zero_has_no_sign(port):
    port.execute("Buat Tabel 'nol' Isi 'a' Dengan 'a = F' -:")
    port.execute("Isi Tabel 'nol' '-0.0' '0' '-0' -:")
    assert port.execute("Pilih 'Count(*)' Dari 'nol' Grup Dari 'a' -:").rows == [[3]] and port.execute("Pilih 'Count(*)' Dari 'nol' Dengan 'a = 0' -:").rows == [[3]]


# --- changes against a model


def test_changes_against_the_model(port):
    """A random run of inserts, updates and deletes; what breaks a rule changes nothing."""
    port.execute("Buat Tabel 'peti' Isi 'no & kode & berat' Dengan 'no = I(P) & kode = C(4&N) & berat = U(Not Null)' Auto_no -:")
    r, model, counter = random.Random(31), [], 1
    for step in range(16):
        act = r.choice(["insert", "insert", "update", "delete"]) if step > 2 else "insert"
        if act == "insert":
            new = [(r.choice([None, f"k{r.randint(0, 12)}"]), Decimal(r.randint(0, 400)) / 4) for _ in range(r.randint(1, 3))]
            codes = [c for c, _ in new if c] + [m["kode"] for m in model if m["kode"]]
            text = "Isi Tabel 'peti' " + " ".join(f"'{field(c)} & {w}'" for c, w in new) + " -:"
            if len(set(codes)) < len(codes):
                refused(port, text, category="Constraint Error")
                continue
            port.execute(text)
            for c, w in new:
                model.append({"no": counter, "kode": c, "berat": w})
                counter += 1
        elif act == "update":
            low, add = r.randint(0, counter), Decimal(r.randint(1, 8)) / 4
            assert port.execute(f"Tabel_Upt 'peti' Isi 'berat = berat * 2 + {add}' Dengan 'no >= {low}' -:").rows[0][1] == sum(m["no"] >= low for m in model)
            for m in model:
                if m["no"] >= low:
                    m["berat"] = m["berat"] * 2 + add
        else:
            gone = r.randint(0, counter)
            port.execute(f"Baris_Rmv 'peti' Dengan 'no = {gone} O: berat > 5000' -:")
            model = [m for m in model if not (m["no"] == gone or m["berat"] > 5000)]
    want = [[m["no"], m["kode"], m["berat"]] for m in model]
    assert port.execute("Tampilkan 'peti' -:").rows == want and len(want) > 4
    before = port.manifest.csn
    some, other = want[0][0], want[1][0]
    refused(port, f"Tabel_Upt 'peti' Isi 'no = {some}' Dengan 'no = {other}' -:", "Tabel_Upt 'peti' Isi 'berat = NULL' -:", "Tabel_Upt 'peti' Isi 'berat = 0.001' -:", "Tabel_Upt 'peti' Isi 'berat = berat / 7' -:", "Tabel_Upt 'peti' Isi 'kode = \"panjang\"' -:", "Tabel_Upt 'peti' Isi 'berat = 1 & berat = 2' -:", "Tabel_Upt 'peti' Isi 'hilang = 1' -:", "Isi Tabel 'peti' 'k99' -:", "Isi Tabel 'peti' '1 & k99 & 2' -:", "Isi Tabel 'peti' 'k98 & 1' 'k97 & NULL' -:")
    assert port.manifest.csn == before and port.execute("Tampilkan 'peti' -:").rows == want
    port.execute(f"Tabel_Upt 'peti' Isi 'no = 500' Dengan 'no = {other}' -:")
    port.execute("Isi Tabel 'peti' 'zz & 1' -:")
    assert port.execute("Tampilkan 'peti' -:").rows[-1][0] == 501  # the counter moved past the greatest
    port.execute("Baris_Rmv 'peti' -:")
    assert port.execute("Tampilkan 'peti' -:").rows == []


def test_definitions(ships):
    ships.execute("Tabel_Upt 'kapal' + Kolom 'bendera' Dengan 'bendera = C(3)' -:")
    assert {x[-1] for x in ships.execute("Tampilkan 'kapal' -:").rows} == {None}
    ships.execute("Tabel_Upt 'kapal' Isi 'bendera = IDN' Dengan 'no < 4' -:")
    ships.execute("Kolom_Rmv 'kapal.bendera' -:")
    ships.execute("Tabel_Upt 'kapal' + Kolom 'bendera' Dengan 'bendera = C(3)' -:")
    assert {x[-1] for x in ships.execute("Tampilkan 'kapal' -:").rows} == {None}  # the dropped values are not found again
    ships.execute("Lihat 'ringan' Pilih 'no & dok' Dari 'kapal' Dengan 'berat < 10' M: 'no Bawah' -:")
    ships.execute("Lihat 'utara' Pilih 'no' Dari 'ringan' Dengan 'dok = \"utara\"' -:")
    light = [x["no"] for x in reversed(SHIPS) if x["berat"] is not None and x["berat"] < 10]
    assert [v for v, _ in ships.execute("Tampilkan 'ringan' -:").rows] == light and ships.execute("Tampilkan 'utara' -:").rows == [[k] for k in light if SHIPS[k - 1]["dok"] == "utara"]
    refused(ships, "Tabel_Rmv 'kapal' -:", "Kolom_Rmv 'kapal.dok' -:", "Kolom_Rmv 'kapal.no' -:", "Kolom_Rmv 'kapal.hilang' -:", "Lihat 'ringan' Pilih 'no' Dari 'kapal' -:", "Lihat 'kembar' Pilih 'no & no' Dari 'kapal' -:", "Tabel_Upt 'kapal' + Kolom 'wajib' Dengan 'wajib = I(Not Null)' -:", "Tabel_Upt 'kapal' + Kolom 'dok' Dengan 'dok = C' -:")
    refused(ships, "Buat 'pelabuhan' -:", "Pilih 'entah' -:", "Buat 'a/b' -:", "Buat 'nul' -:", "Buat Tabel 'x' Isi 'a' Dengan 'a = C' Auto_a -:", "Buat Tabel 'x' Isi 'a' Dengan 'a = I' Auto_b -:", "Buat Tabel 'x' Isi 'a & a' Dengan 'a = I & a = I' -:", "Buat Tabel 'kapal' Isi 'a' Dengan 'a = I' -:")
    assert ships.execute("Pilih 'pelabuhan.db' -:").rows[0][1] == 0


def test_keys_of_several_columns(port):
    port.execute("Buat Tabel 'jadwal' Isi 'hari & dok & kapal' Dengan 'hari = T(P) & dok = C(P) & kapal = I(N)' -:")
    port.execute("Isi Tabel 'jadwal' '2024-05-01 & utara & 1' '2024-05-01 & timur & NULL' '2024-05-02 & utara & NULL' -:")
    refused(port, "Isi Tabel 'jadwal' '2024-05-02 & utara & 7' -:", "Isi Tabel 'jadwal' '2024-05-03 & utara & 1' -:", "Isi Tabel 'jadwal' 'NULL & utara & 8' -:", category="Constraint Error")
    first = dt.date(2024, 5, 1)
    assert port.lookup("jadwal", (first, "utara")) == {"hari": first, "dok": "utara", "kapal": 1} and port.lookup("jadwal", (first, "barat")) is None
    assert port.update_key("jadwal", (first, "timur"), {"kapal": 2}) and not port.update_key("jadwal", (first, "barat"), {"kapal": 3})
    assert port.update_key("jadwal", (first, "utara"), lambda old: {"kapal": old["kapal"] + 10}) and port.delete_key("jadwal", (dt.date(2024, 5, 2), "utara")) and not port.delete_key("jadwal", (dt.date(2024, 5, 2), "utara"))
    assert port.execute("Tampilkan 'jadwal' -:").rows == [[first, "utara", 11], [first, "timur", 2]]


def test_bulk_and_scans(port, spark):
    port.execute("Buat Tabel 'ukur' Isi 'no & nilai' Dengan 'no = I(P) & nilai = U' -:")
    assert port.bulk_insert("ukur", ({"no": i, "nilai": i if i % 2 else None} for i in range(10, 0, -1))) == 10
    for bad in ([{"no": 50}, {"no": 50}], [{"no": 3}], [{"no": 60, "lain": 1}], [{"nilai": 1}], [{"no": "x"}]):
        with pytest.raises(EngineError):
            port.bulk_insert("ukur", bad)
    assert port.bulk_insert("ukur", spark.range(100, 104).selectExpr("id as no", "cast(id as int) as nilai")) == 4
    with pytest.raises(EngineError):
        port.bulk_insert("ukur", spark.range(103, 105).selectExpr("id as no", "cast(null as int) as nilai"))
    with pytest.raises(EngineError):
        port.bulk_insert("ukur", spark.createDataFrame([(200, 1), (200, 2)], "no long, nilai int"))
    order = [*range(10, 0, -1), *range(100, 104)]
    assert [x.no for x in port.scan_rows("ukur", ["no"]).collect()] == order
    for batch in (1, 4, 100):
        got = list(port.stream("ukur", ["no"], batch=batch))
        assert [v for b in got for v, in b] == order and all(len(b) == batch for b in got[:-1])
    assert next(iter(port.stream("ukur", ["no"], batch=3))) == [(10,), (9,), (8,)]
    assert {x.column_name: (x.rows, x.nulls, x.ndv) for x in port.table_stats("ukur").collect()} == {"no": (14, 0, 14), "nilai": (14, 5, 9)}


def test_bulk_delete(port, spark):
    port.execute("Buat Tabel 'jadwal' Isi 'hari & isi & dok' Dengan 'hari = T(P) & isi = U & dok = I(P)' -:")
    days = [dt.date(2024, 5, 1 + i) for i in range(6)]
    rows = [[day, None if k == 2 else Decimal(k), k] for k in (3, 1, 2) for day in days]
    port.bulk_insert("jadwal", [dict(zip(("hari", "isi", "dok"), x)) for x in rows[:9]])
    port.bulk_insert("jadwal", [dict(zip(("hari", "isi", "dok"), x)) for x in rows[9:]])
    port.execute("Buat Tabel 'bebas' Isi 'no' Dengan 'no = I' -:")
    shown = lambda: port.execute("Tampilkan 'jadwal' -:").rows
    before = port.manifest.csn
    for table, bad in (("bebas", "1L as no"), ("jadwal", "1 as dok"), ("jadwal", "date'2024-05-01' as hari, '1' as dok"), ("jadwal", "date'2024-05-01' as hari, 1.0D as dok"), ("jadwal", "timestamp_ntz'2024-05-01 00:00:00' as hari, 1L as dok")):
        with pytest.raises(EngineError):
            port.bulk_delete(table, spark.range(1).selectExpr(*bad.split(", ")))
    frame = lambda keys: spark.createDataFrame(keys, "dok int, hari date, lain string")
    assert port.bulk_delete("jadwal", frame([])) == port.bulk_delete("jadwal", frame([(9, days[0], "x"), (None, days[0], "x"), (1, None, "x")])) == 0
    assert port.manifest.csn == before and shown() == rows  # nothing found, nothing committed or left behind
    assert len(os.listdir(os.path.join(port.db.folder, "jadwal"))) == len(port.manifest.table("jadwal").paths) == 2
    port.begin()
    assert port.bulk_delete("jadwal", frame([(1, days[0], "x")])) == 1 and len(shown()) == 17
    port.rollback()
    assert shown() == rows
    gone = [(k, day, "x") for k, day in itertools.product((1, 2), days[:4])]
    assert port.bulk_delete("jadwal", frame([*gone, *gone, (7, days[1], "x")])) == 8  # keys may be repeated
    want = [x for x in rows if (x[2], x[0], "x") not in gone]
    assert shown() == want and port.manifest.table("jadwal").rows == len(want) and port.manifest.csn == before + 1
    own = port.scan_rows("jadwal")  # keys read from the table itself
    assert port.bulk_delete("jadwal", own.filter("dok = 3")) == 6 and shown() == [x for x in want if x[2] != 3]
    assert port.bulk_delete("jadwal", own) == len(want) - 6 and shown() == [] and port.bulk_delete("jadwal", own) == 0


def test_transactions(ships, spark):
    other = Session(spark, ships.root)
    other.execute("Pilih 'pelabuhan' -:")
    weight = lambda s, k: s.lookup("kapal", k)["isi"]
    ships.execute("Transaksi -:")
    refused(ships, "Transaksi -:", "Buat 'baru' -:")
    ships.execute("Tabel_Upt 'kapal' Isi 'isi = 70' Dengan 'no = 1' -:")
    refused(ships, "Isi Tabel 'kapal' '1 & 1 & 1 & a & true' -:")  # the statement alone is undone
    assert (weight(ships, 1), weight(other, 1)) == (70, 3)
    ships.execute("Gabungkan -:")
    assert weight(other, 1) == 70
    ships.execute("Transaksi -:")
    ships.execute("Baris_Rmv 'kapal' -:")
    ships.execute("Kembalikan -:")
    assert len(ships.execute("Tampilkan 'kapal' -:").rows) == len(SHIPS)
    refused(ships, "Gabungkan -:", "Kembalikan -:")
    for s in (ships, other):
        s.execute("Transaksi -:")
        total = s.execute("Pilih 'Sum(isi)' Dari 'kapal' -:").rows[0][0]
        s.execute(f"Tabel_Upt 'kapal' Isi 'isi = {total}' Dengan 'no = {2 if s is ships else 3}' -:")
    ships.execute("Gabungkan -:")
    refused(other, "Gabungkan -:", category="Transaction Conflict")
    tried = []

    def add(s):
        tried.append(weight(s, 4))
        if len(tried) == 1:  # another one commits in between
            other.execute("Tabel_Upt 'kapal' Isi 'isi = isi + 1' Dengan 'no = 4' -:")
        return s.update_key("kapal", 4, {"isi": tried[-1] + 100})

    assert ships.with_transaction(add) and tried == [7, 8] and weight(other, 4) == 108


def test_versions(port, spark, tmp_path):
    port.execute("Buat Tabel 'log' Isi 'no' Dengan 'no = I' -:")
    seen = {}
    for k in range(4):
        port.execute(f"Isi Tabel 'log' '{k}' -:")
        seen[port.manifest.csn] = [[i] for i in range(k + 1)]
    held = Session(spark, port.root)
    held.execute("Pilih 'pelabuhan' -:")
    held.begin()
    port.db.compact("log")
    assert len(port.manifest.table("log").paths) == 1 and port.execute("Tampilkan 'log' -:").rows == [[0], [1], [2], [3]]
    target = str(tmp_path / "salinan" / "pelabuhan")
    port.db.backup(target)
    assert Database.verify_backup(target)
    copy = Session(spark, str(tmp_path / "salinan"))
    copy.execute("Pilih 'pelabuhan' -:")
    assert copy.execute("Tampilkan 'log' -:").rows == [[0], [1], [2], [3]]
    assert port.db.version_at(dt.datetime.now(dt.timezone.utc)) == port.manifest.csn
    for csn, rows in list(seen.items())[:2]:
        port.db.restore_at(csn)
        assert port.execute("Tampilkan 'log' -:").rows == rows
    port.db.vacuum()
    assert held.execute("Tampilkan 'log' -:").rows == [[0], [1], [2], [3]]  # a snapshot that is open keeps its files
    held.rollback()
    assert port.db.vacuum() >= 2 and port.execute("Tampilkan 'log' -:").rows == [[0], [1]]
    assert port.monitor(".tables").rows == [["log", "table"]] and ["pelabuhan"] in port.monitor(".databases").rows
    reader = Session(spark, port.root, role="reader")
    reader.execute("Pilih 'pelabuhan' -:")
    refused(reader, "Isi Tabel 'log' '9' -:", "Tabel_Rmv 'log' -:")


# --- results as text


def test_result_as_text():
    wide = QueryResult(["no", "nama"], [[1, "baris\ndua"], [Fraction(7, 4), None], [Fraction(2, 7), "y" * 60]])
    text = table(wide, 12)
    assert "1.75" in text and "2/7" in text and "baris\\ndua" in text and "…" in text and text.endswith("3 baris.")
    for width in (1, 5, 9):
        lines = table(QueryResult(["k"], [["z" * width]])).split("\n")[:4]
        assert len({len(x) for x in lines}) == 1
    assert value_text(Decimal("2.50"), "U") == "2.50" and value_text(Decimal("-7.2500")) == "-7.25" and '"type": "exact"' in to_json(wide)


def test_script(port):
    done, rest = port.script("Buat Tabel 'a' Isi 'x' Dengan 'x = I' -: # komentar -: di sini\nIsi Tabel 'a' '5' '6' -: Pilih 'Sum(x)' Dari 'a' -: Tampilkan")
    assert [len(d.rows) for d in done] == [1, 1, 1] and done[2].rows == [[11]] and rest.strip() == "Tampilkan"
