"""One query for each statement and keyed operation over tables that the engine stores, with its SQL.

Each makes a database of its own in the shared folder, fills it from the standard tables, changes it and returns what it then holds.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.engine.formatter import to_json
from lontar.engine.session import Session
from lontar.errors import EngineError, storage
from lontar.sources.tables import parquet, read_tbl, read_tsv, write_tsv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def shared_path(spark: SparkSession) -> str:
    """A path that driver and executors share: spark.checkpoint.dir if that is a file path; a temporary folder only where it is unset and all run on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    if named.startswith(("file:///", "/")):
        return named.removeprefix("file://")
    if named or not spark.sparkContext.master.startswith("local"):
        raise storage("stored tables need spark.checkpoint.dir on a file system that driver and executors share")
    return tempfile.gettempdir()


@contextmanager
def database(spark: SparkSession) -> Iterator[Session]:
    """A session with a new database, deleted at the end."""
    root = os.path.join(shared_path(spark), f"stored-{uuid.uuid4().hex}")
    os.makedirs(root)
    s = Session(spark, root)
    try:
        s.execute("Buat 'demo' -:")
        yield s
    finally:
        shutil.rmtree(root, ignore_errors=True)


def _file(spark: SparkSession) -> str:
    return f"file://{shared_path(spark)}/files-{uuid.uuid4().hex}"


def stored(schema: str, sql: str):
    """Register a function of a session with the tables supplier and nation that gives a DataFrame, or rows of the driver.

    A DataFrame is written beside the database before that is deleted, so its rows never meet in the driver and may be any number.
    """

    def add(f: Callable[[Session], DataFrame | list]) -> Callable[[Session], DataFrame | list]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            with database(spark) as s:
                s.execute("Buat Tabel 'supplier' Isi 's_suppkey & s_name & s_nationkey' Dengan 's_suppkey = I(P) & s_name = C(40) & s_nationkey = I' -:")
                s.bulk_insert("supplier", parquet(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey"))
                s.execute("Buat Tabel 'nation' Isi 'n_nationkey & n_name & n_regionkey' Dengan 'n_nationkey = I(P) & n_name = C(25&N) & n_regionkey = I' -:")
                rows = parquet(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
                s.bulk_insert("nation", (r.asDict() for r in rows))
                out = f(s)
                if not isinstance(out, DataFrame):
                    return spark.createDataFrame([tuple(r) for r in out], schema)
                path = _file(spark)
                out.to(T._parse_datatype_string(schema)).write.parquet(path)
                return spark.read.schema(schema).parquet(path)

        QUERIES[f.__name__], ORACLE[f.__name__] = run, sql
        return f

    return add


def _all(s: Session, table: str) -> DataFrame:
    return s.query(f"Tampilkan '{table}' -:")


_SUPPLIER = "s_suppkey long, s_name string, s_nationkey long"
_PLAIN = "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier"


@stored("no long, name string", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) AS no, n_name AS name FROM nation WHERE n_regionkey = 1")
def op_insert_auto(s):
    s.execute("Buat Tabel 'copy' Isi 'no & name' Dengan 'no = I(P) & name = C(25)' Auto_no -:")
    names = s.execute("Pilih 'n_name' Dari 'nation' Dengan 'n_regionkey = 1' M: 'n_nationkey Bawah' -:").rows
    s.execute("Isi Tabel 'copy' " + " ".join("'\"" + x.replace('"', '""').replace("'", "''") + "\"'" for x, in names) + " -:")
    return _all(s, "copy")


@stored(_SUPPLIER, "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE WHEN s_nationkey > 12 AND s_suppkey > 10 THEN 'moved' ELSE s_name END AS s_name, CAST(CASE WHEN s_nationkey > 12 AND s_suppkey > 10 THEN s_nationkey * 2 + s_suppkey ELSE s_nationkey END AS BIGINT) AS s_nationkey FROM supplier")
def op_update(s):
    s.execute("Tabel_Upt 'supplier' Isi 's_name = moved & s_nationkey = s_nationkey * 2 + s_suppkey' Dengan 's_nationkey > 12 &: s_suppkey > 10' -:")
    return _all(s, "supplier")


@stored(_SUPPLIER, _PLAIN + " WHERE NOT (s_nationkey < 8 OR s_suppkey = 3)")
def op_delete(s):
    s.execute("Baris_Rmv 'supplier' Dengan 's_nationkey < 8 O: s_suppkey = 3' -:")
    return _all(s, "supplier")


@stored(_SUPPLIER + ", zone string", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CASE WHEN s_nationkey <= 12 THEN 'west' END AS zone FROM supplier")
def op_add_column(s):
    s.execute("Tabel_Upt 'supplier' + Kolom 'zone' Dengan 'zone = C(4)' -:")
    s.execute("Tabel_Upt 'supplier' Isi 'zone = \"west\"' Dengan 's_nationkey <= 12' -:")
    return _all(s, "supplier")


@stored("s_suppkey long, s_name string", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(NULL AS VARCHAR) AS s_name FROM supplier")
def op_drop_column(s):
    s.script("Kolom_Rmv 'supplier.s_nationkey' -: Kolom_Rmv 'supplier.s_name' -: Tabel_Upt 'supplier' + Kolom 's_name' Dengan 's_name = C' -:")
    return _all(s, "supplier")


@stored("name string, kind string", "SELECT * FROM (VALUES ('supplier', 'table'), ('far', 'view')) v(name, kind)")
def op_drop_table(s):
    s.script("Lihat 'far' Pilih 's_name' Dari 'supplier' Dengan 's_nationkey > 20' -: Tabel_Rmv 'nation' -:")
    return s.monitor(".tables").rows


@stored(_SUPPLIER, _PLAIN + " WHERE s_suppkey > 5 UNION ALL SELECT 0, 'first', NULL")
def op_transaction(s):
    s.script("Transaksi -: Baris_Rmv 'supplier' -: Isi Tabel 'supplier' '1 & lost & 1' -: Kembalikan -:")
    s.script("Transaksi -: Baris_Rmv 'supplier' Dengan 's_suppkey <= 5' -: Isi Tabel 'supplier' '0 & first & NULL' -: Gabungkan -:")
    return _all(s, "supplier")


@stored("n_nationkey long, n_regionkey long, conflicts long", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(CASE n_nationkey WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE n_regionkey END AS BIGINT) AS n_regionkey, CAST(1 AS BIGINT) AS conflicts FROM nation")
def op_transaction_conflict(s):
    """Two transactions that read and write one table: the second is refused and run again."""
    other, tries = Session(s.spark, s.root), []
    other.execute("Pilih 'demo' -:")

    def change(t: Session) -> None:
        tries.append(1)
        if len(tries) == 1:
            other.update_key("nation", 1, {"n_regionkey": 100})
        t.update_key("nation", 2, {"n_regionkey": 200})

    s.with_transaction(change)
    return _all(s, "nation").select("n_nationkey", "n_regionkey", F.lit(len(tries) - 1).alias("conflicts"))


@stored("place long, s_suppkey long", "SELECT row_number() OVER (ORDER BY s_suppkey >= 0 DESC, s_suppkey) - 1 AS place, CAST(s_suppkey AS BIGINT) AS s_suppkey FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT -1 UNION ALL SELECT -2) ORDER BY 1")
def op_scan_rows(s):
    """Insertion order: the rows added last come last."""
    s.execute("Isi Tabel 'supplier' '-2 & b & 1' -:")
    s.execute("Isi Tabel 'supplier' '-1 & a & 1' -:")
    return [(i, r.s_suppkey) for i, r in enumerate(s.scan_rows("supplier", ["s_suppkey"]).collect())]


@stored("batch long, rows long, total long", "SELECT (s_suppkey - low) // 7 AS batch, count(*) AS rows, CAST(sum(s_suppkey) AS BIGINT) AS total FROM (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS k, s_suppkey FROM supplier) JOIN (SELECT min(s_suppkey) AS low FROM supplier) ON true WHERE (s_suppkey - low) // 7 < 5 GROUP BY 1")
def op_stream(s):
    """Batches in insertion order, given up after five."""
    out = []
    for i, rows in enumerate(s.stream("supplier", ["s_suppkey"], batch=7)):
        if i == 5:
            break
        out.append((i, len(rows), sum(k for k, in rows)))
    return out


@stored("n_nationkey long, n_name string, found boolean", "SELECT k AS n_nationkey, n_name, n_name IS NOT NULL AS found FROM (SELECT CAST(unnest([0, 7, 24, 25, -1]) AS BIGINT) AS k) LEFT JOIN nation ON n_nationkey = k")
def op_lookup(s):
    out = [(k, s.lookup("nation", k)) for k in (0, 7, 24, 25, -1)]
    return [(k, r["n_name"] if r else None, r is not None) for k, r in out]


@stored("n_nationkey long, n_name string, n_regionkey long", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS n_name, CAST(CASE WHEN n_nationkey = 4 THEN n_regionkey + 10 ELSE n_regionkey END AS BIGINT) AS n_regionkey FROM nation WHERE n_nationkey <> 5")
def op_update_delete_key(s):
    done = [s.update_key("nation", 3, {"n_name": "renamed"}), s.update_key("nation", 4, lambda old: {"n_regionkey": old["n_regionkey"] + 10}), s.delete_key("nation", 5), s.delete_key("nation", 5), s.update_key("nation", 77, {"n_name": "x"})]
    assert done == [True, True, True, False, False]
    return _all(s, "nation")


@stored("attempt string, refused boolean", """SELECT * FROM (VALUES ('primary key repeated', true), ('unique name repeated', true), ('null key', true), ('text too long', true), ('bulk with one bad row', true),
  ('frame with an old key', true), ('update to one key', true), ('new key', false)) v(attempt, refused)""")
def op_constraints(s):
    frame = s.spark.range(1).selectExpr("cast(0 as bigint) as n_nationkey", "'zero' as n_name", "1 as n_regionkey")
    attempts = {
        "primary key repeated": lambda: s.execute("Isi Tabel 'nation' '3 & new & 1' -:"), "unique name repeated": lambda: s.execute(f"Isi Tabel 'nation' '90 & {s.lookup('nation', 1)['n_name']} & 1' -:"), "null key": lambda: s.execute("Isi Tabel 'nation' 'NULL & n & 1' -:"),
        "text too long": lambda: s.execute(f"Isi Tabel 'nation' '91 & {'x' * 26} & 1' -:"), "bulk with one bad row": lambda: s.bulk_insert("nation", [{"n_nationkey": 92, "n_name": "a"}, {"n_nationkey": 92, "n_name": "b"}]), "frame with an old key": lambda: s.bulk_insert("nation", frame),
        "update to one key": lambda: s.execute("Tabel_Upt 'nation' Isi 'n_nationkey = 1' -:"), "new key": lambda: s.execute("Isi Tabel 'nation' '93 & fine & 1' -:"),
    }
    out = []
    for name, attempt in attempts.items():
        try:
            attempt()
            out.append((name, False))
        except EngineError:
            out.append((name, True))
    return out


@stored(_SUPPLIER, _PLAIN + " WHERE s_suppkey % 2 = 0")
def op_restore_version(s):
    """Compaction and clean-up leave the rows; an older version becomes the head again.

    The odd keys go by a statement and then in four parts, however many there are, so the table is rewritten as often on any input.
    """
    s.script("Baris_Rmv 'supplier' Dengan 's_nationkey < 3' -: Baris_Rmv 'supplier' -:")
    s.db.restore_at(s.manifest.csn - 2)
    odd = s.query("Pilih 's_suppkey' Dari 'supplier' -:").filter("s_suppkey % 2 <> 0")
    if first := odd.orderBy("s_suppkey").limit(2).collect():
        s.execute("Baris_Rmv 'supplier' Dengan '" + " O: ".join(f"s_suppkey = {k}" for k, in first) + "' -:")
    for part in (1, 3, 5, 7):
        s.bulk_delete("supplier", odd.filter(F.pmod("s_suppkey", F.lit(8)) == part))
    s.db.compact("supplier")
    s.db.vacuum()
    return _all(s, "supplier")


@stored("line string", "SELECT unnest(['Scan supplier (rows=' || (SELECT count(*) FROM supplier) || ')', 'Scan nation (rows=' || (SELECT count(*) FROM nation) || ')', 'Filter: nation.n_regionkey = 1', 'Limit: 3']) AS line")
def op_explain(s):
    lines = s.execute("EXPLAIN Pilih 'supplier.s_name' Dari 'supplier &&& nation' Gabung Dengan 'supplier.s_nationkey = nation.n_nationkey' Dengan 'nation.n_regionkey = 1' Limit(3) -:").rows
    return [r for r in lines if r[0].startswith(("Scan", "Filter", "Limit"))]


@stored("n_name string, n_regionkey long", "SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_regionkey IN (0, 2)")
def op_json(s):
    import json

    found = json.loads(to_json(s.execute("Pilih 'n_name & n_regionkey' Dari 'nation' Dengan 'n_regionkey = 0 O: n_regionkey = 2' -:")))
    return [tuple(v["value"] if isinstance(v, dict) else v for v in r) for r in found["rows"]]


def op_tbl(spark: SparkSession, folder: str) -> DataFrame:
    """Delimited text with a mark at the end of each line; decimals become exact cents."""
    path = _file(spark)
    lines = parquet(spark, folder, "supplier").select(F.concat_ws("|", "s_suppkey", "s_name", F.format_string("%.2f", "s_acctbal"), F.lit("")).alias("value"))
    lines.write.text(path)
    return read_tbl(spark, path, "s_suppkey long, s_name string, s_acctbal long", {"s_acctbal": 2})


def op_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """Tabs, line breaks, backslashes and NULL come back as they were."""
    path = _file(spark)
    odd = F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit("\t\\n\n"))).when(F.col("n_nationkey") % 4 == 1, F.col("n_name"))
    write_tsv(parquet(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), odd.alias("odd")), path)
    return read_tsv(spark, path, "n_nationkey long, odd string")


QUERIES |= {"op_tbl": op_tbl, "op_tsv": op_tsv}
ORACLE |= {
    "op_tbl": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(round(s_acctbal * 100) AS BIGINT) AS s_acctbal FROM supplier",
    "op_tsv": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_name || chr(9) || '\\n' || chr(10) WHEN n_nationkey % 4 = 1 THEN n_name END AS odd FROM nation",
}
