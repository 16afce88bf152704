"""Twenty-two analytical queries over the star schema, as relational plans, and their SQL.

Money is counted in cents and rates in percent, as integers, so sums are exact. The schema lacks
supply costs and some dates; they are derived: a line's commit date is 60 days after its order,
its receipt as many days after shipping as its line number; a part's supply by a supplier is what their lines say.
Every sum and year is a long, ratios are doubles divided last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lontar.functions.aggregates import Avg, Count, CountDistinct, Max, Min, Sum
from lontar.functions.scalars import cents, hdiv, sqlin, sqllike, sqlnot
from lontar.operators.rel import Rel, groupby, hashjoin, relation, rfilter, rlimit, rmap, rproject, rrename, rsort, scalar
from lontar.sources.tables import parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

c = F.col


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str, *columns: str) -> Rel:
        return relation(parquet(self.spark, self.folder, name), columns)


def line(t: Tables, *extra: str) -> Rel:
    """Lines in integers, with what else is asked for."""
    base = {"l_extendedprice": ("ce", cents), "l_discount": ("cd", cents), "l_tax": ("ct", cents), "l_quantity": ("q", lambda x: c(x).cast("long"))}
    names = {n: (src, f) for src, (n, f) in base.items()}
    cols = [names[e][0] if e in names else e for e in extra]
    return rmap(t("lineitem", *dict.fromkeys(cols)), {e: names[e][1](names[e][0]) if e in names else c(e) for e in extra})


def supply(t: Tables, parts: Rel | None = None, suppliers: Rel | None = None) -> Rel:
    """What each supplier offers of each part; only of these parts (p_partkey) and suppliers (s_suppkey), before lines are grouped."""
    lines = line(t, "l_partkey", "l_suppkey", "q", "ce")
    if parts is not None:
        lines = hashjoin(lines, parts, {"l_partkey": "p_partkey"}, "semi")
    if suppliers is not None:
        lines = hashjoin(lines, suppliers, {"l_suppkey": "s_suppkey"}, "semi")
    lines = rmap(lines, {"ps_partkey": c("l_partkey"), "ps_suppkey": c("l_suppkey"), "q": c("q"), "unit": F.expr("ce div q")})
    return groupby(lines, ["ps_partkey", "ps_suppkey"], {"aq": Sum("q"), "sc": Min("unit")})


def revenue() -> Column:
    return c("ce") * (F.lit(100) - c("cd"))


def year(name: str) -> Column:
    return F.year(name).cast("long")


def day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def between(name: str, low: str, high: str) -> Column:
    return (c(name) >= day(low)) & (c(name) < day(high))


_LI = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, o_custkey, o_orderdate, o_orderpriority, o_orderstatus,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS ce, CAST(round(l_discount * 100) AS BIGINT) AS cd, CAST(round(l_tax * 100) AS BIGINT) AS ct, CAST(l_quantity AS BIGINT) AS q,
  o_orderdate + INTERVAL 60 DAY AS cdate, l_shipdate + l_linenumber * INTERVAL 1 DAY AS rdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_PS = "ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(q) AS BIGINT) AS aq, min(ce // q) AS sc FROM li GROUP BY ALL)"


def query(sql: str, with_: tuple[str, ...] = (_LI,)):
    def add(f: Callable[[Tables], Rel]) -> Callable[[Tables], Rel]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder)).frame()
        ORACLE[f.__name__] = ("WITH " + ", ".join(with_) + "\n" if with_ else "") + sql
        return f

    return add


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(q) AS BIGINT) AS sum_qty, CAST(sum(ce) AS BIGINT) AS sum_base, CAST(sum(ce * (100 - cd)) AS BIGINT) AS sum_disc,
  CAST(sum(ce * (100 - cd) * (100 + ct)) AS BIGINT) AS sum_charge, sum(q)::DOUBLE / count(q) AS avg_qty, sum(ce)::DOUBLE / count(ce) AS avg_price, sum(cd)::DOUBLE / count(cd) AS avg_disc, count(*) AS n
FROM li WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q01(t: Tables) -> Rel:
    lines = rfilter(line(t, "l_returnflag", "l_linestatus", "l_shipdate", "q", "ce", "cd", "ct"), c("l_shipdate") <= day("1998-09-02"))
    return groupby(lines, ["l_returnflag", "l_linestatus"], {"sum_qty": Sum("q"), "sum_base": Sum("ce"), "sum_disc": Sum(revenue()), "sum_charge": Sum(revenue() * (100 + c("ct"))), "avg_qty": Avg("q"), "avg_price": Avg("ce"), "avg_disc": Avg("cd"), "n": Count()})


@query("""SELECT s_acctbal, s_name, n_name, ps_partkey, ps_suppkey, sc FROM (
  SELECT CAST(round(s_acctbal * 100) AS BIGINT) AS s_acctbal, s_name, n_name, ps_partkey, ps_suppkey, sc, min(sc) OVER (PARTITION BY ps_partkey) AS least
  FROM ps JOIN part ON ps_partkey = p_partkey JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE p_size <= 15 AND p_type LIKE '%PROMO' AND r_name = 'EUROPE') WHERE sc = least
ORDER BY s_acctbal DESC, n_name, s_name, ps_partkey, ps_suppkey LIMIT 100""", (_LI, _PS))
def q02(t: Tables) -> Rel:
    part = rproject(rfilter(t("part", "p_partkey", "p_size", "p_type"), (c("p_size") <= 15) & c("p_type").endswith("PROMO")), ["p_partkey"])
    europe = hashjoin(t("nation", "n_nationkey", "n_name", "n_regionkey"), rfilter(t("region", "r_regionkey", "r_name"), c("r_name") == "EUROPE"), {"n_regionkey": "r_regionkey"})
    supplier = hashjoin(t("supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal"), europe, {"s_nationkey": "n_nationkey"})
    priced = supply(t, part, supplier)
    least = Window.partitionBy("ps_partkey")  # the group above is dealt by part and supplier; this one exchange reads its few rows once
    cheap = rfilter(rmap(priced, {"ps_partkey": c("ps_partkey"), "ps_suppkey": c("ps_suppkey"), "sc": c("sc"), "least": F.min("sc").over(least)}), c("sc") == c("least"))
    best = rmap(hashjoin(cheap, supplier, {"ps_suppkey": "s_suppkey"}), {"s_acctbal": cents("s_acctbal"), "s_name": c("s_name"), "n_name": c("n_name"), "ps_partkey": c("ps_partkey"), "ps_suppkey": c("ps_suppkey"), "sc": c("sc")})
    return rlimit(rsort(best, [("s_acctbal", "desc"), ("n_name", "asc"), ("s_name", "asc"), ("ps_partkey", "asc"), ("ps_suppkey", "asc")]), 100)


@query("""SELECT l_orderkey, o_orderdate, CAST(sum(ce * (100 - cd)) AS BIGINT) AS revenue FROM li JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY ALL ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def q03(t: Tables) -> Rel:
    customer = rproject(rfilter(t("customer", "c_custkey", "c_mktsegment"), c("c_mktsegment") == "BUILDING"), ["c_custkey"])
    orders = hashjoin(rfilter(t("orders", "o_orderkey", "o_custkey", "o_orderdate"), c("o_orderdate") < day("1998-03-15")), customer, {"o_custkey": "c_custkey"}, "semi")
    lines = rfilter(line(t, "l_orderkey", "l_shipdate", "ce", "cd"), c("l_shipdate") > day("1998-03-15"))
    out = groupby(hashjoin(lines, orders, {"l_orderkey": "o_orderkey"}), ["l_orderkey", "o_orderdate"], {"revenue": Sum(revenue())})
    return rlimit(rsort(out, [("revenue", "desc"), ("o_orderdate", "asc"), ("l_orderkey", "asc")]), 10)


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
AND EXISTS (SELECT 1 FROM li WHERE l_orderkey = o_orderkey AND cdate < rdate) GROUP BY ALL""")
def q04(t: Tables) -> Rel:
    orders = rfilter(t("orders", "o_orderkey", "o_orderdate", "o_orderpriority"), between("o_orderdate", "1997-07-01", "1997-10-01"))
    # The commit date follows from the order's own date, so the lines need no other join.
    late = hashjoin(orders, line(t, "l_orderkey", "l_linenumber", "l_shipdate"), {"o_orderkey": "l_orderkey"}, "semi", F.expr("o_orderdate + interval 60 day < l_shipdate + make_dt_interval(l_linenumber)"))
    return groupby(late, ["o_orderpriority"], {"n": Count()})


@query("""SELECT n_name, CAST(sum(ce * (100 - cd)) AS BIGINT) AS revenue FROM li JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL""")
def q05(t: Tables) -> Rel:
    asia = hashjoin(t("nation", "n_nationkey", "n_name", "n_regionkey"), rfilter(t("region", "r_regionkey", "r_name"), c("r_name") == "ASIA"), {"n_regionkey": "r_regionkey"})
    supplier = hashjoin(t("supplier", "s_suppkey", "s_nationkey"), asia, {"s_nationkey": "n_nationkey"})
    lines = hashjoin(line(t, "l_orderkey", "l_suppkey", "ce", "cd"), supplier, {"l_suppkey": "s_suppkey"})
    orders = hashjoin(t("orders", "o_orderkey", "o_custkey"), t("customer", "c_custkey", "c_nationkey"), {"o_custkey": "c_custkey"})
    return groupby(hashjoin(lines, orders, {"l_orderkey": "o_orderkey", "s_nationkey": "c_nationkey"}), ["n_name"], {"revenue": Sum(revenue())})


@query("SELECT CAST(sum(ce * cd) AS BIGINT) AS revenue FROM li WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND cd BETWEEN 5 AND 7 AND q < 24")
def q06(t: Tables) -> Rel:
    lines = rfilter(line(t, "l_shipdate", "ce", "cd", "q"), between("l_shipdate", "1996-01-01", "1997-01-01") & c("cd").between(5, 7) & (c("q") < 24))
    return groupby(lines, [], {"revenue": Sum(c("ce") * c("cd"))})


@query("""SELECT s_nationkey, c_nationkey, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(sum(ce * (100 - cd)) AS BIGINT) AS revenue FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
WHERE s_nationkey IN (15, 19) AND c_nationkey IN (15, 19) AND s_nationkey <> c_nationkey GROUP BY ALL""")
def q07(t: Tables) -> Rel:
    supplier = rfilter(t("supplier", "s_suppkey", "s_nationkey"), sqlin("s_nationkey", [15, 19]))
    customer = rfilter(t("customer", "c_custkey", "c_nationkey"), sqlin("c_nationkey", [15, 19]))
    orders = hashjoin(t("orders", "o_orderkey", "o_custkey"), customer, {"o_custkey": "c_custkey"})
    lines = hashjoin(line(t, "l_orderkey", "l_suppkey", "l_shipdate", "ce", "cd"), supplier, {"l_suppkey": "s_suppkey"})
    both = hashjoin(lines, orders, {"l_orderkey": "o_orderkey"}, predicate=c("s_nationkey") != c("c_nationkey"))
    return groupby(rmap(both, {"s_nationkey": c("s_nationkey"), "c_nationkey": c("c_nationkey"), "y": year("l_shipdate"), "rev": revenue()}), ["s_nationkey", "c_nationkey", "y"], {"revenue": Sum("rev")})


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(CASE WHEN s_nationkey = 15 THEN ce * (100 - cd) ELSE 0 END) AS BIGINT)::DOUBLE / CAST(sum(ce * (100 - cd)) AS BIGINT)::DOUBLE AS share
FROM li JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' GROUP BY 1""")
def q08(t: Tables) -> Rel:
    part = rfilter(t("part", "p_partkey", "p_type"), c("p_type") == "ECONOMY")
    america = hashjoin(t("nation", "n_nationkey", "n_regionkey"), rfilter(t("region", "r_regionkey", "r_name"), c("r_name") == "AMERICA"), {"n_regionkey": "r_regionkey"}, "semi")
    customer = hashjoin(t("customer", "c_custkey", "c_nationkey"), america, {"c_nationkey": "n_nationkey"}, "semi")
    orders = hashjoin(t("orders", "o_orderkey", "o_custkey", "o_orderdate"), customer, {"o_custkey": "c_custkey"}, "semi")
    lines = hashjoin(hashjoin(line(t, "l_orderkey", "l_partkey", "l_suppkey", "ce", "cd"), part, {"l_partkey": "p_partkey"}, "semi"), t("supplier", "s_suppkey", "s_nationkey"), {"l_suppkey": "s_suppkey"})
    rows = rmap(hashjoin(lines, orders, {"l_orderkey": "o_orderkey"}), {"y": year("o_orderdate"), "rev": revenue(), "own": F.when(c("s_nationkey") == 15, revenue()).otherwise(0)})
    return rmap(groupby(rows, ["y"], {"own": Sum("own"), "rev": Sum("rev")}), {"y": c("y"), "share": hdiv("own", "rev")})


@query("""SELECT s_nationkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(ce * (100 - cd) - 100 * sc * q) AS BIGINT) AS profit
FROM li JOIN part ON l_partkey = p_partkey JOIN ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_name LIKE '%plate%' GROUP BY ALL""", (_LI, _PS))
def q09(t: Tables) -> Rel:
    part = rfilter(t("part", "p_partkey", "p_name"), sqllike("p_name", "%plate%"))
    lines = hashjoin(line(t, "l_orderkey", "l_partkey", "l_suppkey", "ce", "cd", "q"), part, {"l_partkey": "p_partkey"}, "semi")
    costed = hashjoin(hashjoin(lines, supply(t, part), {"l_partkey": "ps_partkey", "l_suppkey": "ps_suppkey"}), t("supplier", "s_suppkey", "s_nationkey"), {"l_suppkey": "s_suppkey"})
    rows = rmap(hashjoin(costed, t("orders", "o_orderkey", "o_orderdate"), {"l_orderkey": "o_orderkey"}), {"s_nationkey": c("s_nationkey"), "y": year("o_orderdate"), "p": revenue() - 100 * c("sc") * c("q")})
    return groupby(rows, ["s_nationkey", "y"], {"profit": Sum("p")})


@query("""SELECT c_custkey, c_name, CAST(round(c_acctbal * 100) AS BIGINT) AS acctbal, n_name, CAST(sum(ce * (100 - cd)) AS BIGINT) AS revenue FROM li JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""")
def q10(t: Tables) -> Rel:
    orders = rfilter(t("orders", "o_orderkey", "o_custkey", "o_orderdate"), between("o_orderdate", "1997-10-01", "1998-01-01"))
    lines = rfilter(line(t, "l_orderkey", "l_returnflag", "ce", "cd"), c("l_returnflag") == "R")
    by_customer = groupby(hashjoin(lines, orders, {"l_orderkey": "o_orderkey"}), ["o_custkey"], {"revenue": Sum(revenue())})
    named = hashjoin(hashjoin(by_customer, t("customer", "c_custkey", "c_name", "c_acctbal", "c_nationkey"), {"o_custkey": "c_custkey"}), t("nation", "n_nationkey", "n_name"), {"c_nationkey": "n_nationkey"})
    out = rmap(named, {"c_custkey": c("c_custkey"), "c_name": c("c_name"), "acctbal": cents("c_acctbal"), "n_name": c("n_name"), "revenue": c("revenue")})
    return rlimit(rsort(out, [("revenue", "desc"), ("c_custkey", "asc")]), 20)


@query("""SELECT ps_partkey, value FROM (SELECT ps_partkey, CAST(sum(sc * aq) AS BIGINT) AS value, CAST(sum(sum(sc * aq)) OVER () AS BIGINT) AS total
  FROM ps JOIN supplier ON ps_suppkey = s_suppkey WHERE s_nationkey IN (15, 19) GROUP BY ps_partkey) WHERE value * 1000 > total""", (_LI, _PS))
def q11(t: Tables) -> Rel:
    supplier = rfilter(t("supplier", "s_suppkey", "s_nationkey"), sqlin("s_nationkey", [15, 19]))
    value = groupby(supply(t, suppliers=supplier), ["ps_partkey"], {"value": Sum(c("sc") * c("aq"))})
    return rproject(hashjoin(value, scalar(value, "total", Sum("value")), predicate=c("value") * 1000 > c("total")), ["ps_partkey", "value"])


@query("""SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low
FROM li WHERE cdate < rdate AND l_shipdate < cdate GROUP BY ALL""")
def q12(t: Tables) -> Rel:
    both = hashjoin(line(t, "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"), t("orders", "o_orderkey", "o_orderdate", "o_orderpriority"), {"l_orderkey": "o_orderkey"}, predicate=F.expr("o_orderdate + interval 60 day < l_shipdate + make_dt_interval(l_linenumber) and l_shipdate < o_orderdate + interval 60 day"))
    urgent = sqlin("o_orderpriority", ["1-URGENT", "2-HIGH"])
    return groupby(both, ["l_returnflag"], {"high": Sum(F.when(urgent, 1).otherwise(0)), "low": Sum(F.when(urgent, 0).otherwise(1))})


@query("""SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) GROUP BY n""", ())
def q13(t: Tables) -> Rel:
    orders = rproject(rfilter(t("orders", "o_orderkey", "o_custkey", "o_orderpriority"), sqlnot(sqllike("o_orderpriority", "%URGENT%"))), ["o_orderkey", "o_custkey"])
    each = groupby(hashjoin(t("customer", "c_custkey"), orders, {"c_custkey": "o_custkey"}, "left"), ["c_custkey"], {"n": Count("o_orderkey")})
    return groupby(each, ["n"], {"customers": Count()})


@query("""SELECT 100 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN ce * (100 - cd) ELSE 0 END) AS BIGINT)::DOUBLE / CAST(sum(ce * (100 - cd)) AS BIGINT)::DOUBLE AS promo
FROM li JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""")
def q14(t: Tables) -> Rel:
    lines = rfilter(line(t, "l_partkey", "l_shipdate", "ce", "cd"), between("l_shipdate", "1997-09-01", "1997-10-01"))
    both = hashjoin(lines, t("part", "p_partkey", "p_type"), {"l_partkey": "p_partkey"})
    sums = groupby(both, [], {"promo": Sum(F.when(c("p_type").startswith("PROMO"), revenue()).otherwise(0)), "rev": Sum(revenue())})
    return rmap(sums, {"promo": F.lit(100) * c("promo").cast("double") / c("rev").cast("double")})


@query("""SELECT s_suppkey, s_name, total FROM (SELECT l_suppkey, CAST(sum(ce * (100 - cd)) AS BIGINT) AS total, max(CAST(sum(ce * (100 - cd)) AS BIGINT)) OVER () AS most FROM li
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey) JOIN supplier ON l_suppkey = s_suppkey WHERE total = most""")
def q15(t: Tables) -> Rel:
    lines = rfilter(line(t, "l_suppkey", "l_shipdate", "ce", "cd"), between("l_shipdate", "1996-01-01", "1996-04-01"))
    totals = groupby(lines, ["l_suppkey"], {"total": Sum(revenue())})
    best = hashjoin(totals, scalar(totals, "most", Max("total")), {"total": "most"})
    return rproject(hashjoin(best, t("supplier", "s_suppkey", "s_name"), {"l_suppkey": "s_suppkey"}), ["s_suppkey", "s_name", "total"])


@query("""SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS suppliers FROM ps JOIN part ON ps_partkey = p_partkey WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (1, 5, 9, 14, 23, 36, 45, 49)
AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""", (_LI, _PS))
def q16(t: Tables) -> Rel:
    part = rfilter(t("part", "p_partkey", "p_brand", "p_type", "p_size"), (c("p_brand") != "Brand#5") & sqlnot(sqllike("p_type", "MEDIUM%")) & sqlin("p_size", [1, 5, 9, 14, 23, 36, 45, 49]))
    bad = rfilter(t("supplier", "s_suppkey", "s_acctbal"), c("s_acctbal") < 0)
    lines = hashjoin(hashjoin(line(t, "l_partkey", "l_suppkey"), part, {"l_partkey": "p_partkey"}), bad, {"l_suppkey": "s_suppkey"}, "anti")
    offers = rrename(lines, {"l_suppkey": "ps_suppkey"})
    return groupby(offers, ["p_brand", "p_type", "p_size"], {"suppliers": CountDistinct("ps_suppkey")})


@query("""SELECT CAST(sum(ce) AS BIGINT)::DOUBLE / 7 AS yearly FROM li JOIN part ON l_partkey = p_partkey JOIN (SELECT l_partkey AS k, CAST(sum(q) AS BIGINT) AS total, count(*) AS n FROM li GROUP BY 1) ON l_partkey = k
WHERE p_brand = 'Brand#13' AND q * 5 * n < total""")
def q17(t: Tables) -> Rel:
    part = rfilter(t("part", "p_partkey", "p_brand"), c("p_brand") == "Brand#13")
    lines = hashjoin(line(t, "l_partkey", "q", "ce"), part, {"l_partkey": "p_partkey"}, "semi")
    each = rrename(groupby(lines, ["l_partkey"], {"total": Sum("q"), "n": Count()}), {"l_partkey": "k"})
    few = hashjoin(lines, each, {"l_partkey": "k"}, predicate=c("q") * 5 * c("n") < c("total"))
    return rmap(groupby(few, [], {"s": Sum("ce")}), {"yearly": c("s").cast("double") / 7})


@query("""SELECT c_name, c_custkey, o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS price, total FROM (SELECT l_orderkey, CAST(sum(q) AS BIGINT) AS total FROM li GROUP BY 1 HAVING sum(q) > 250)
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey ORDER BY price DESC, o_orderdate, o_orderkey LIMIT 100""")
def q18(t: Tables) -> Rel:
    large = rfilter(groupby(line(t, "l_orderkey", "q"), ["l_orderkey"], {"total": Sum("q")}), c("total") > 250)
    orders = hashjoin(large, t("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), {"l_orderkey": "o_orderkey"})
    named = hashjoin(orders, t("customer", "c_custkey", "c_name"), {"o_custkey": "c_custkey"})
    out = rmap(named, {"c_name": c("c_name"), "c_custkey": c("c_custkey"), "o_orderkey": c("o_orderkey"), "o_orderdate": c("o_orderdate"), "price": cents("o_totalprice"), "total": c("total")})
    return rlimit(rsort(out, [("price", "desc"), ("o_orderdate", "asc"), ("o_orderkey", "asc")]), 100)


@query("""SELECT CAST(sum(ce * (100 - cd)) AS BIGINT) AS revenue FROM li JOIN part ON l_partkey = p_partkey
WHERE (p_brand = 'Brand#12' AND q BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 25) OR (p_brand = 'Brand#23' AND q BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#13' AND q BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 35)""")
def q19(t: Tables) -> Rel:
    band = lambda brand, low, high, size: (c("p_brand") == brand) & c("q").between(low, high) & c("p_size").between(1, size)
    any_band = band("Brand#12", 1, 11, 25) | band("Brand#23", 10, 20, 30) | band("Brand#13", 20, 30, 35)
    both = hashjoin(line(t, "l_partkey", "q", "ce", "cd"), t("part", "p_partkey", "p_brand", "p_size"), {"l_partkey": "p_partkey"}, predicate=any_band)
    return groupby(both, [], {"revenue": Sum(revenue())})


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT ps_suppkey FROM ps JOIN (SELECT l_partkey, l_suppkey, CAST(sum(q) AS BIGINT) AS used FROM li WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL)
  ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey WHERE 2 * aq > used AND ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%'))""", (_LI, _PS))
def q20(t: Tables) -> Rel:
    red = rfilter(t("part", "p_partkey", "p_name"), c("p_name").startswith("red"))
    lines = rfilter(line(t, "l_partkey", "l_suppkey", "l_shipdate", "q"), between("l_shipdate", "1996-01-01", "1997-01-01"))
    used = groupby(hashjoin(lines, red, {"l_partkey": "p_partkey"}, "semi"), ["l_partkey", "l_suppkey"], {"used": Sum("q")})
    offers = hashjoin(supply(t, red), used, {"ps_partkey": "l_partkey", "ps_suppkey": "l_suppkey"}, predicate=2 * c("aq") > c("used"))
    return hashjoin(t("supplier", "s_suppkey", "s_name"), offers, {"s_suppkey": "ps_suppkey"}, "semi")


@query("""SELECT s_name, count(*) AS waits FROM li a JOIN supplier ON a.l_suppkey = s_suppkey WHERE o_orderstatus = 'F' AND rdate > cdate
AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM li b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.rdate > b.cdate) GROUP BY ALL ORDER BY waits DESC, s_name LIMIT 100""")
def q21(t: Tables) -> Rel:
    orders = rfilter(t("orders", "o_orderkey", "o_orderdate", "o_orderstatus"), c("o_orderstatus") == "F")
    both = hashjoin(line(t, "l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey"), orders, {"l_orderkey": "o_orderkey"})
    late = F.expr("o_orderdate + interval 60 day < l_shipdate + make_dt_interval(l_linenumber)")
    rows = rmap(both, {"l_orderkey": c("l_orderkey"), "supplier": c("l_suppkey"), "late": F.when(late, c("l_suppkey"))})
    # One group of an order answers both conditions: several suppliers, and just one among the late lines, whose lines all wait.
    each = groupby(rows, ["l_orderkey"], {"low": Min("supplier"), "high": Max("supplier"), "first": Min("late"), "last": Max("late"), "n": Count("late")})
    blamed = rfilter(each, (c("low") != c("high")) & (c("first") == c("last")))
    out = groupby(hashjoin(blamed, t("supplier", "s_suppkey", "s_name"), {"first": "s_suppkey"}), ["s_name"], {"waits": Sum("n")})
    return rlimit(rsort(out, [("waits", "desc"), ("s_name", "asc")]), 100)


@query("""SELECT substr(c_mktsegment, 1, 2) AS code, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS total FROM customer, (SELECT CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS k FROM customer WHERE c_acctbal > 0)
WHERE CAST(round(c_acctbal * 100) AS BIGINT) * k > s AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1999-01-01') GROUP BY ALL""", ())
def q22(t: Tables) -> Rel:
    customer = rmap(t("customer", "c_custkey", "c_mktsegment", "c_acctbal"), {"c_custkey": c("c_custkey"), "code": F.substring("c_mktsegment", 1, 2), "bal": cents("c_acctbal")})
    mean = groupby(rfilter(customer, c("bal") > 0), [], {"s": Sum("bal"), "k": Count()})
    rich = hashjoin(customer, mean, predicate=c("bal") * c("k") > c("s"))
    orders = rfilter(t("orders", "o_custkey", "o_orderstatus", "o_orderdate"), (c("o_orderstatus") == "F") & (c("o_orderdate") >= day("1999-01-01")))
    return groupby(hashjoin(rich, orders, {"c_custkey": "o_custkey"}, "anti"), ["code"], {"n": Count(), "total": Sum("bal")})
