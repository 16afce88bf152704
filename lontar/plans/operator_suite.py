"""One query for each operator of the relational API and the dialect, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.engine.catalog import statistics
from lontar.engine.session import Session
from lontar.functions import aggregates as a
from lontar.functions import scalars as x
from lontar.operators.rel import Rel, groupby, hashjoin, rdistinct, rel_table, rfilter, rlimit, rmap, rproject, rrename, rsort, runion, scalar
from lontar.plans.analytic import Tables
from lontar.plans.stored_suite import database
from lontar.sources.tables import parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

c = F.col


def query(sql: str):
    def add(f: Callable[[Tables], Rel | DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = f(Tables(spark, folder))
            return out.frame() if isinstance(out, Rel) else out

        QUERIES[f.__name__], ORACLE[f.__name__] = run, sql
        return f

    return add


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS rev, -CAST(l_quantity AS BIGINT) AS neg FROM lineitem")
def op_project_expr(t):
    return rmap(t("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"), {"l_orderkey": c("l_orderkey"), "l_linenumber": c("l_linenumber"), "rev": x.cents("l_extendedprice") * (100 - x.cents("l_discount")), "neg": -c("l_quantity").cast("long")})


@query("SELECT o_orderkey FROM orders WHERE (nullif(o_orderstatus, 'P') = 'F' OR o_totalprice > 100000) AND NOT (nullif(o_orderstatus, 'O') = 'F' AND o_totalprice > 200000)")
def op_filter_3vl(t):
    status = lambda v: F.nullif(c("o_orderstatus"), F.lit(v))
    keep = x.sqland(x.sqlor(x.sqlcmp("eq", status("P"), F.lit("F")), x.sqlcmp("gt", "o_totalprice", 100000.0)), x.sqlnot(x.sqland(x.sqlcmp("eq", status("O"), F.lit("F")), x.sqlcmp("gt", "o_totalprice", 200000.0))))
    return rproject(rfilter(t("orders", "o_orderkey", "o_orderstatus", "o_totalprice"), keep), ["o_orderkey"])


@query("SELECT p_partkey, p_size IN (1, 2, NULL) AS hit, NOT (p_size IN (1, 2, NULL)) AS miss FROM part")
def op_in_null(t):
    hit = x.sqlin("p_size", [1, 2, None])
    return rmap(t("part", "p_partkey", "p_size"), {"p_partkey": c("p_partkey"), "hit": hit, "miss": x.sqlnot(hit)})


@query("SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%1_' AND replace(c_name, '#', '%') LIKE '%!%%7%' ESCAPE '!'")
def op_like_escape(t):
    rows = rmap(t("customer", "c_custkey", "c_name"), {"c_custkey": c("c_custkey"), "c_name": c("c_name"), "alt": F.replace("c_name", F.lit("#"), F.lit("%"))})
    return rproject(rfilter(rows, x.sqllike("c_name", "Customer#%1_") & x.sqllike("alt", x.SqlLike("%!%%!7%", "!"))), ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'low' END AS band, CAST(year(o_orderdate) AS BIGINT) AS y, substr(o_orderpriority, 1, 1) AS p FROM orders")
def op_case(t):
    band = F.when(c("o_totalprice") > 150000, "high").when(c("o_orderstatus") == "F", "done").otherwise("low")
    return rmap(t("orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority"), {"o_orderkey": c("o_orderkey"), "band": band, "y": F.year("o_orderdate").cast("long"), "p": F.substring("o_orderpriority", 1, 1)})


@query("SELECT s_suppkey, s_acctbal_cents, CAST(s_acctbal_cents AS DOUBLE) / s_suppkey AS per_key FROM (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS s_acctbal_cents FROM supplier) WHERE s_suppkey <> 0")
def op_divide(t):
    rows = rmap(rfilter(t("supplier", "s_suppkey", "s_acctbal"), c("s_suppkey") != 0), {"s_suppkey": c("s_suppkey"), "s_acctbal_cents": x.cents("s_acctbal")})
    return rmap(rows, {"s_suppkey": c("s_suppkey"), "s_acctbal_cents": c("s_acctbal_cents"), "per_key": x.rdiv("s_acctbal_cents", "s_suppkey")})


@query("SELECT CAST(9223372036854775807 AS HUGEINT)::VARCHAR AS most, (CAST(9223372036854775807 AS HUGEINT) + r_regionkey)::VARCHAR AS sum, (CAST(9223372036854775807 AS HUGEINT) * 2 - r_regionkey)::VARCHAR AS twice FROM region")
def op_exact_overflow(t):
    most = F.lit(9223372036854775807)
    twice = x.rsub(x.radd(most, most), "r_regionkey")
    return rmap(t("region", "r_regionkey"), {"most": most.cast("string"), "sum": x.radd(most, "r_regionkey").cast("string"), "twice": twice.cast("string")})


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def op_join_inner(t):
    return rproject(hashjoin(t("nation", "n_name", "n_regionkey"), t("region", "r_regionkey", "r_name"), {"n_regionkey": "r_regionkey"}), ["n_name", "r_name"])


@query("""SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY ALL""")
def op_join_compound(t):
    b = rfilter(t("lineitem", "l_orderkey", "l_linenumber", "l_quantity"), c("l_quantity") > 25)
    both = hashjoin(t("lineitem", "l_orderkey", "l_linenumber"), b, {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"})
    return groupby(both, ["l_orderkey", "l_linenumber"], {"n": a.Count()})


@query("SELECT c_custkey, count(o_orderkey) AS n, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 30 GROUP BY c_custkey")
def op_join_left_residual(t):
    both = hashjoin(t("customer", "c_custkey", "c_acctbal"), t("orders", "o_orderkey", "o_custkey", "o_totalprice"), {"c_custkey": "o_custkey"}, "left", c("o_totalprice") > c("c_acctbal") * 30)
    return groupby(both, ["c_custkey"], {"n": a.Count("o_orderkey"), "last": a.Max("o_orderkey")})


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def op_join_semi(t):
    return rproject(hashjoin(t("orders", "o_orderkey"), rfilter(t("lineitem", "l_orderkey", "l_quantity"), c("l_quantity") > 45), {"o_orderkey": "l_orderkey"}, "semi"), ["o_orderkey"])


@query("SELECT k FROM (SELECT o_orderkey AS id, nullif(o_orderkey, 1) AS k FROM orders) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k)")
def op_join_anti(t):
    rows = rmap(t("orders", "o_orderkey"), {"k": F.nullif(c("o_orderkey"), F.lit(1))})
    return hashjoin(rows, t("lineitem", "l_orderkey"), {"k": "l_orderkey"}, "anti")


@query("SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a, region b WHERE a.n_nationkey % 5 < b.r_regionkey")
def op_join_cartesian_theta(t):
    both = hashjoin(t("nation", "n_nationkey"), t("region", "r_regionkey"), predicate=c("n_nationkey") % 5 < c("r_regionkey"))
    return rrename(both, {"n_nationkey": "x", "r_regionkey": "y"})


@query("SELECT a.n_nationkey, a.n_regionkey, b.n_nationkey AS n_nationkey_right, b.n_regionkey AS n_regionkey_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def op_join_collision_rename(t):
    n = t("nation", "n_nationkey", "n_regionkey")
    return hashjoin(n, n, {"n_regionkey": "n_regionkey"}, predicate=c("n_nationkey") < c("n_nationkey_right"))


@query("SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def op_multi_join3(t):
    both = hashjoin(hashjoin(t("customer", "c_nationkey"), t("nation", "n_nationkey", "n_regionkey"), {"c_nationkey": "n_nationkey"}), t("region", "r_regionkey", "r_name"), {"n_regionkey": "r_regionkey"})
    return groupby(both, ["r_name"], {"customers": a.Count()})


@query("""SELECT l_returnflag, count(*) AS n, count(nullif(l_linenumber, 1)) AS n_not_first, count(*) FILTER (l_quantity > 25) AS large, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_linestatus) AS low, sum(CAST(l_quantity AS BIGINT))::DOUBLE / count(*) AS mean FROM lineitem GROUP BY ALL""")
def op_group_aggregates(t):
    rows = t("lineitem", "l_returnflag", "l_linenumber", "l_quantity", "l_shipdate", "l_linestatus")
    return groupby(rows, ["l_returnflag"], {"n": a.Count(), "n_not_first": a.Count(F.nullif(c("l_linenumber"), F.lit(1))), "large": a.Countif(c("l_quantity") > 25), "first_ship": a.Min("l_shipdate"), "last_ship": a.Max("l_shipdate"), "low": a.Min("l_linestatus"), "mean": a.Avg(c("l_quantity").cast("long"))})


@query("SELECT nullif(o_orderstatus, 'P') AS k, count(*) AS n FROM orders GROUP BY 1")
def op_group_null_key(t):
    return groupby(rmap(t("orders", "o_orderstatus"), {"k": F.nullif(c("o_orderstatus"), F.lit("P"))}), ["k"], {"n": a.Count()})


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def op_group_no_aggregate(t):
    return groupby(t("lineitem", "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"], {})


@query("SELECT o_orderpriority, count(*) FILTER (o_totalprice > 150000) AS n FROM orders GROUP BY 1")
def op_countif(t):
    return groupby(t("orders", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], {"n": a.Countif(c("o_totalprice") > 150000)})


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def op_count_distinct(t):
    return groupby(t("lineitem", "l_suppkey", "l_partkey"), ["l_suppkey"], {"parts": a.CountDistinct("l_partkey")})


@query("SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, min(l_shipdate) AS d, sum(CAST(l_quantity AS BIGINT))::DOUBLE / nullif(count(*), 0) AS m FROM lineitem WHERE l_quantity < 0")
def op_scalar_agg_empty(t):
    rows = rfilter(t("lineitem", "l_quantity", "l_shipdate"), c("l_quantity") < 0)
    sums = groupby(rows, [], {"n": a.Count(), "s": a.Sum(c("l_quantity").cast("long")), "d": a.Min("l_shipdate"), "k": a.Count("l_quantity")})
    return rmap(sums, {"n": c("n"), "s": c("s"), "d": c("d"), "m": x.hdiv("s", "k")})


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1 HAVING sum(CAST(l_quantity AS BIGINT)) > 200")
def op_having(t):
    return rfilter(groupby(t("lineitem", "l_orderkey", "l_quantity"), ["l_orderkey"], {"q": a.Sum(c("l_quantity").cast("long"))}), c("q") > 200)


@query("SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1 ORDER BY q DESC, l_suppkey LIMIT 7")
def op_agg_order(t):
    return rlimit(rsort(groupby(t("lineitem", "l_suppkey", "l_quantity"), ["l_suppkey"], {"q": a.Sum(c("l_quantity").cast("long"))}), [("q", "desc"), ("l_suppkey", "asc")]), 7)


@query("SELECT o_orderkey, k FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS k FROM orders) ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 20")
def op_sort_nulls(t):
    rows = rmap(t("orders", "o_orderkey", "o_orderstatus"), {"o_orderkey": c("o_orderkey"), "k": F.nullif(c("o_orderstatus"), F.lit("O"))})
    return rlimit(rsort(rows, [("k", "desc"), ("o_orderkey", "asc")], ["first", "last"]), 20)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 15")
def op_limit_offset(t):
    return rproject(rlimit(rsort(t("customer", "c_custkey", "c_name", "c_acctbal"), [("c_acctbal", "desc"), ("c_custkey", "asc")]), 10, offset=15), ["c_custkey", "c_name"])


@query("SELECT DISTINCT p_brand, p_type FROM part")
def op_distinct(t):
    return rdistinct(t("part", "p_brand", "p_type"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def op_distinct_on_first(t):
    return rdistinct(rsort(t("orders", "o_custkey", "o_orderkey", "o_orderdate"), [("o_orderdate", "asc"), ("o_orderkey", "asc")]), ["o_custkey"])


@query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def op_union_all(t):
    return runion(rrename(t("supplier", "s_nationkey"), {"s_nationkey": "k"}), t("customer", "c_nationkey"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def op_union_set(t):
    return runion(rrename(t("supplier", "s_nationkey"), {"s_nationkey": "k"}), t("customer", "c_nationkey"), all=False)


@query("SELECT o_orderkey FROM orders, (SELECT sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS s, count(*) AS n FROM orders) WHERE CAST(round(o_totalprice * 100) AS BIGINT) * n > s")
def op_scalar_threshold(t):
    rows = rmap(t("orders", "o_orderkey", "o_totalprice"), {"o_orderkey": c("o_orderkey"), "cents": x.cents("o_totalprice")})
    both = hashjoin(hashjoin(rows, scalar(rows, "s", a.Sum("cents"))), scalar(rows, "n", a.Count()), predicate=c("cents") * c("n") > c("s"))
    return rproject(both, ["o_orderkey"])


@query("SELECT x, y FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) v(x, y)")
def op_values(t):
    return rel_table(t.spark, ["x", "y"], [(1, "a"), (2, None), (None, "c")], "x int, y string")


@query("""SELECT 'c_nationkey' AS column_name, count(*) AS rows, count(*) FILTER (c_nationkey IS NULL) AS nulls, count(DISTINCT c_nationkey) AS ndv, min(c_nationkey)::VARCHAR AS least, max(c_nationkey)::VARCHAR AS greatest FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (c_mktsegment IS NULL), count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer""")
def op_stats(t):
    return statistics(t("customer", "c_nationkey", "c_mktsegment").frame(), ["c_nationkey", "c_mktsegment"])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts FROM events GROUP BY 1")
def op_events_by_type(t):
    return groupby(t("events", "event_type", "user_id", "ts"), ["event_type"], {"n": a.Count(), "users": a.CountDistinct("user_id"), "first_ts": a.Min("ts")})


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def op_events_top_users(t):
    clicks = rfilter(t("events", "user_id", "event_type"), c("event_type") == "click")
    return rlimit(rsort(groupby(clicks, ["user_id"], {"n": a.Count()}), [("n", "desc"), ("user_id", "asc")]), 10)


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE text LIKE '%password%' OR text LIKE '%token%' GROUP BY 1")
def op_documents_like(t):
    return groupby(rfilter(t("documents", "lang", "text", "n_chars"), x.sqllike("text", "%password%") | x.sqllike("text", "%token%")), ["lang"], {"n": a.Count(), "chars": a.Sum("n_chars")})


# --- the same core reached from query text


def session(t: Tables, *tables: str) -> Session:
    """A session over the files, without a database of its own."""
    s = Session(t.spark, "")
    for name in tables:
        df = parquet(t.spark, t.folder, name)
        s.register(name, df.select(*[F.col(k).cast("bigint") if d == "int" else F.col(k) for k, d in df.dtypes]))
    return s


def dialect(name: str, tables: tuple[str, ...], text: str, sql: str, names: tuple[str, ...], casts: dict[str, str] | None = None) -> None:
    """Register a query text. Its labels are its expressions, so `names` gives the columns plain names; exact sums become longs."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = session(Tables(spark, folder), *tables).query(text).toDF(*names)
        return df.select(*[F.col(n).cast((casts or {}).get(n, dict(df.dtypes)[n])).alias(n) for n in names])

    QUERIES[name], ORACLE[name] = run, sql


dialect("dialect_filter_project", ("part",), "Pilih 'p_partkey & p_size * 2 + 1' Dari 'part' Dengan 'p_size >= 10 &: (p_type = \"PROMO\" O: p_brand = \"Brand#13\")' -:",
        "SELECT p_partkey, CAST(p_size AS BIGINT) * 2 + 1 AS v FROM part WHERE p_size >= 10 AND (p_type = 'PROMO' OR p_brand = 'Brand#13')", ("p_partkey", "v"), {"v": "long"})
dialect("dialect_group", ("orders",), "Pilih 'o_orderstatus & Count(*) & Countif(o_custkey > 100) & Sum(o_custkey) & Avg(o_custkey) & Min(o_orderdate) & Max(o_orderpriority)' Dari 'orders' Grup Dari 'o_orderstatus' -:",
        "SELECT o_orderstatus AS s, count(*) AS n, count(*) FILTER (o_custkey > 100) AS k, CAST(sum(o_custkey) AS BIGINT) AS total, sum(o_custkey)::DOUBLE / count(*) AS mean, min(o_orderdate) AS first_date, max(o_orderpriority) AS p FROM orders GROUP BY 1",
        ("s", "n", "k", "total", "mean", "first_date", "p"), {"total": "long"})
dialect("dialect_join3", ("customer", "nation", "region"), "Pilih 'customer.c_name && region.r_name' Dari 'customer &&& nation &&& region' Gabung Dengan 'customer.c_nationkey = nation.n_nationkey &: nation.n_regionkey = region.r_regionkey' Dengan 'region.r_name = \"ASIA\"' -:",
        "SELECT c_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", ("c_name", "r_name"))
dialect("dialect_order_limit", ("supplier",), "Pilih 's_suppkey & s_name' Dari 'supplier' M: 's_acctbal Bawah & s_suppkey Atas' Limit(9) -:",
        "SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 9", ("s_suppkey", "s_name"))
dialect("dialect_group_order", ("lineitem",), "Pilih 'l_suppkey & Sum(l_linenumber) / Count(*)' Dari 'lineitem' Grup Dari 'l_suppkey' M: 'Count(*) Bawah & l_suppkey Atas' Limit(5) -:",
        "SELECT l_suppkey, sum(l_linenumber)::DOUBLE / count(*) AS mean FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 5", ("l_suppkey", "mean"))
dialect("dialect_null_compare", ("nation",), "Pilih 'n_nationkey' Dari 'nation' Dengan 'n_nationkey = NULL O: n_nationkey > 20' -:", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_nationkey = NULL OR n_nationkey > 20", ("n_nationkey",))
dialect("dialect_exact_ratio", ("supplier",), "Pilih 's_suppkey' Dari 'supplier' Dengan '(s_suppkey + 1) / 3 > s_nationkey / 2' -:", "SELECT s_suppkey FROM supplier WHERE (s_suppkey + 1) * 2 > s_nationkey * 3", ("s_suppkey",))


@query("SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_nationkey > 5 AND n_regionkey < 3")
def op_view_nested(t):
    """A view on a view, over tables that the engine stores itself."""
    with database(t.spark) as s:
        s.execute("Buat Tabel 'nation' Isi 'n_nationkey & n_name & n_regionkey' Dengan 'n_nationkey = I(P) & n_name = C(25) & n_regionkey = I' -:")
        s.bulk_insert("nation", t("nation", "n_nationkey", "n_name", "n_regionkey").frame())
        s.execute("Lihat 'later' Pilih 'n_name & n_regionkey' Dari 'nation' Dengan 'n_nationkey > 5' -:")
        s.execute("Lihat 'low' Pilih 'n_name & n_regionkey' Dari 'later' Dengan 'n_regionkey < 3' -:")
        found = s.execute("Tampilkan 'low' -:")
        return t.spark.createDataFrame(found.rows, "n_name string, n_regionkey long")
