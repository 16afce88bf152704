"""The relational API: operators against expected rows and a nested-loop version."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lontar.errors import EngineError
from lontar.functions.aggregates import Avg, Count, CountDistinct, Countif, ExactSum, Max, Min, Sum
from lontar.functions.scalars import SqlLike, hdiv, radd, rdiv, rmul, rsub, sqlcmp, sqlin, sqllike, sqlnot
from lontar.operators.rel import groupby, hashjoin, raggregate, rdistinct, rel_table, relation, rfilter, rlimit, rmap, rproject, rrename, rsort, runion


def one(spark, *exprs):
    return list(spark.range(1).select(*exprs).first())


def test_null_logic(spark):
    null = F.lit(None).cast("int")
    assert one(spark, sqlcmp("eq", null, F.lit(1)), sqlnot(sqlcmp("eq", null, F.lit(1))), sqlcmp("ne", F.lit(1), F.lit(2)), sqlcmp("le", F.lit(1), F.lit(1))) == [None, None, True, True]
    assert one(spark, sqlin(F.lit(1), [1, None]), sqlin(F.lit(2), [1, None]), sqlin(null, [1]), sqlin(F.lit(2), []), sqlin(null, [])) == [True, None, None, False, False]


def test_like(spark):
    s = F.lit
    assert one(spark, sqllike(s("a\nb"), "a_b"), sqllike(s("a%b"), "a\\%b"), sqllike(s("axb"), "a\\%b"), sqllike(s("axb"), SqlLike("a!xb", "!")), sqllike(s("猫犬"), "猫_"), sqllike(s(""), "%"), sqllike(s("a\\b"), SqlLike("a\\b", None))) == [True, True, False, True, True, True, True]
    with pytest.raises(EngineError):
        sqllike(s("a"), "a\\")


def test_arithmetic(spark):
    big = F.lit(2**63 - 1)
    assert one(spark, radd(big, F.lit(1)), rsub(F.lit(-(2**63)), F.lit(1)), rmul(F.lit(3), F.lit(4)), rdiv(F.lit(7), F.lit(2)), hdiv(F.lit(1), F.lit(0))) == [2**63, -(2**63) - 1, 12, 3.5, None]
    assert one(spark, radd(F.lit(Decimal("0.1")), F.lit(Decimal("0.2")), 1))[0] == Decimal("0.3")
    with pytest.raises(Exception, match="(?i)zero"):
        one(spark, rdiv(F.lit(1), F.lit(0)))


def sides(spark):
    left = rel_table(spark, ["id", "value"], [(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, value string")
    right = rel_table(spark, ["id", "value"], [(1, 10), (1, 20), (3, 30), (None, 40)], "id int, value int")
    return left, right


def test_joins(spark):
    left, right = sides(spark)
    j = lambda kind="inner", **k: hashjoin(left, right, {"id": "id"}, kind, **k)
    assert j().columns == ("id", "value", "id_right", "value_right")
    assert j().collect() == [(1, "a", 1, 10), (1, "a", 1, 20), (1, "b", 1, 10), (1, "b", 1, 20)]
    assert len(j("left").collect()) == 6 and j("left").collect()[-1] == (None, "d", None, None)
    assert [r[1] for r in j("semi").collect()] == ["a", "b"]
    assert [r[1] for r in j("anti").collect()] == ["c", "d"]
    assert len(hashjoin(left, right).collect()) == 16
    assert len(hashjoin(left, right, predicate=lambda t: t["value_right"] > 20).collect()) == 8
    assert j("left", predicate=F.col("value_right") > 10).collect()[:2] == [(1, "a", 1, 20), (1, "b", 1, 20)]
    assert [r[1] for r in j("anti", predicate=F.col("value_right") > 20).collect()] == ["a", "b", "c", "d"]
    again = hashjoin(j(), right, {"id": "id"})
    assert again.columns[-2:] == ("id_right_right", "value_right_right")
    with pytest.raises(EngineError):
        hashjoin(left, right, {"id": "id"}, "full")
    with pytest.raises(EngineError):
        hashjoin(left, right, {"value": "id"})


@pytest.mark.parametrize("kind", ["inner", "left", "semi", "anti"])
def test_joins_against_nested_loops(spark, kind):
    for trial in range(36):
        ls = [(None if (i * 7 + trial) % 5 == 0 else (i * 3 + trial) % 6, "xy"[(i + trial) % 2], i) for i in range(trial % 9)]
        rs = [(None if (i * 5 + trial) % 7 == 0 else (i * 2 + trial) % 5, "xy"[(i * trial) % 2], i) for i in range((trial * 3) % 11)]
        fits = lambda a, b: a[0] is not None and a[0] == b[0] and a[1] == b[1] and (a[2] + b[2]) % 3 != 0
        expected = []
        for a in ls:
            hits = [b for b in rs if fits(a, b)]
            if kind == "semi":
                expected += [a] if hits else []
            elif kind == "anti":
                expected += [] if hits else [a]
            else:
                expected += [a + b for b in hits] or ([a + (None,) * 3] if kind == "left" else [])
        left = rel_table(spark, ["key", "part", "li"], ls, "key int, part string, li int")
        right = rel_table(spark, ["key", "part", "ri"], rs, "key int, part string, ri int")
        got = hashjoin(left, right, [("key", "key"), ("part", "part")], kind, (F.col("li") + F.col("ri")) % 3 != 0).collect()
        assert got == expected, (trial, kind)


def test_groups(spark):
    t = rel_table(spark, ["g", "v"], [("a", 100), ("a", 200), ("a", None), (None, 400), (None, None)], "g string, v long")
    made = {"n": Count(), "k": Count("v"), "s": Sum("v"), "m": Avg("v"), "lo": Min("v"), "hi": Max("v"), "d": CountDistinct("v"), "c": Countif(F.col("v") > 100), "x": Sum(F.col("v") * 2)}
    assert groupby(t, ["g"], made).collect() == [("a", 3, 2, 300, 150.0, 100, 200, 2, 1, 600), (None, 2, 1, 400, 400.0, 400, 400, 1, 1, 800)]
    empty = rfilter(t, F.col("v") < 0)
    assert groupby(empty, ["g"], made).collect() == []
    assert groupby(empty, [], {"n": Count(), "s": Sum("v")}).collect() == [(0, None)]
    assert raggregate(t, Sum("v")) == 700 and raggregate(empty, Max("v")) is None
    assert groupby(t, ["g"], {}).collect() == [("a",), (None,)]
    assert raggregate(rel_table(spark, ["v"], [(2**62,), (2**62,)], "v long"), ExactSum("v")) == 2**63
    # Groups come in the order of their first row, also after a descending sort.
    assert [r[0] for r in groupby(rsort(t, [("v", "desc")]), ["g"], {"n": Count()}).collect()] == [None, "a"]
    with pytest.raises(EngineError):
        groupby(t, ["g"], {"g": Count()})


def test_sort_limit_distinct_union(spark):
    t = rel_table(spark, ["a", "b"], [(1, 3), (2, 2), (1, 2), (None, 9), (1, 2)], "a int, b int")
    assert rsort(t, [("a", "asc")]).collect() == [(1, 3), (1, 2), (1, 2), (2, 2), (None, 9)]
    assert rsort(t, [("a", "desc"), ("b", "asc")]).collect() == [(2, 2), (1, 2), (1, 2), (1, 3), (None, 9)]
    assert rsort(t, [("a", "desc")], "first").collect()[0] == (None, 9)
    assert rlimit(t, 2).collect() == [(1, 3), (2, 2)]
    assert rlimit(rsort(t, [("b", "asc")]), 2, offset=1).collect() == [(1, 2), (1, 2)]
    assert rlimit(t, 0).collect() == []
    assert rdistinct(t).collect() == [(1, 3), (2, 2), (1, 2), (None, 9)]
    assert rdistinct(t, ["a"]).collect() == [(1, 3), (2, 2), (None, 9)]
    u = rrename(t, {"a": "x", "b": "y"})
    assert len(runion(t, u).collect()) == 10 and runion(t, u).columns == ("a", "b")
    assert runion(t, u, all=False).collect() == rdistinct(t).collect()
    for bad in (lambda: rlimit(t, -1), lambda: rsort(t, [("a", "up")]), lambda: runion(t, rproject(t, ["a"])), lambda: rproject(t, ["zz"]), lambda: rrename(t, {"a": "b"}), lambda: rfilter(t, F.col("a"))):
        with pytest.raises(EngineError):
            bad()


def test_scan_and_map(spark, folder):
    n = relation(spark.read.parquet(f"{folder}/nation.parquet"), ["n_nationkey", "n_name"], prefix="x_")
    assert n.columns == ("x_n_nationkey", "x_n_name") and n.frame().count() == 25
    m = rmap(n, ["k", "twice"], lambda t: [t["x_n_nationkey"], t["x_n_nationkey"] * 2])
    assert sorted(m.collect())[3] == (3, 6)
    with pytest.raises(EngineError):
        rel_table(spark, ["a", "a"], [])
    with pytest.raises(EngineError):
        rel_table(spark, ["a"], [(1, 2)])
    mixed = rel_table(spark, ["d", "t"], [(dt.date(2026, 1, 2), True), (None, None)])
    assert mixed.collect() == [(dt.date(2026, 1, 2), True), (None, None)]


def test_plans_push_down(spark, folder):
    """Filters and columns reach the scan; a pruned column is not read."""
    from lontar.plans.analytic import QUERIES

    plan = QUERIES["q06"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "l_orderkey" not in scan


def test_files(spark, tmp_path):
    from lontar.sources.tables import read_tbl, read_tsv, write_tsv

    (tmp_path / "x.tbl").write_text("1|ab c|12.34|\n2||0.10|\n")
    got = read_tbl(spark, str(tmp_path / "x.tbl"), "k long, s string, m long", {"m": 2}).collect()
    assert [tuple(r) for r in got] == [(1, "ab c", 1234), (2, None, 10)]
    (tmp_path / "bad.tbl").write_text("1|ab c|12.345|\n")
    with pytest.raises(Exception, match="more decimals"):
        read_tbl(spark, str(tmp_path / "bad.tbl"), "k long, s string, m long", {"m": 2}).collect()
    df = spark.createDataFrame([(1, "a\tb\n\\t"), (2, None), (None, "\\N")], "k long, s string")
    write_tsv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_tsv(spark, str(tmp_path / "out"), "k long, s string").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
