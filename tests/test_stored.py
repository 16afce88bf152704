"""Queries over stored tables on inputs of several sizes, held against their SQL."""

import shutil
from collections import Counter

import duckdb
import pytest

from lontar.engine.catalog import Database
from lontar.plans.stored_suite import ORACLE, QUERIES


@pytest.fixture
def suppliers(spark, folder, tmp_path):
    """Makes a folder with the suppliers of a query of (s_suppkey, s_name, s_nationkey)."""

    def make(rows):
        out = str(tmp_path / "in")
        shutil.rmtree(out, ignore_errors=True)
        rows.selectExpr("cast(s_suppkey as bigint) as s_suppkey", "s_name", "cast(s_nationkey as int) as s_nationkey").write.parquet(f"{out}/supplier.parquet")
        shutil.copyfile(f"{folder}/nation.parquet", f"{out}/nation.parquet")
        return out

    return make


def numbered(spark, keys):
    return keys.selectExpr("s_suppkey", "concat('Supplier ', s_suppkey) as s_name", "pmod(s_suppkey * 7, 25) as s_nationkey")


def holds(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{folder}/supplier.parquet/*.parquet'")
    con.execute(f"create view nation as select * from '{folder}/nation.parquet'")
    got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
    assert Counter(got) == Counter(con.execute(ORACLE[name]).fetchall())
    return len(got)


def test_restore_version_rewrites_as_often_on_any_input(spark, suppliers, monkeypatch):
    written, write = [], Database.write
    monkeypatch.setattr(Database, "write", lambda self, df, table: written.append(table) or write(self, df, table))
    counts = set()
    for rows in (60, 600):
        written.clear()
        holds(spark, "op_restore_version", suppliers(numbered(spark, spark.range(rows).toDF("s_suppkey"))))
        counts.add(len(written))
    assert len(counts) == 1


@pytest.mark.parametrize("keys", [[], [2, 4], [7], [-3, -2, -1, 0, 5]], ids=str)
def test_restore_version_on_few_keys(spark, suppliers, keys):
    holds(spark, "op_restore_version", suppliers(numbered(spark, spark.createDataFrame([(k,) for k in keys], "s_suppkey long"))))


@pytest.mark.parametrize("name", ["op_restore_version", "op_update", "op_delete", "op_add_column", "op_drop_column", "op_transaction"])
def test_results_may_be_larger_than_a_statement_fetches(spark, suppliers, name):
    assert holds(spark, name, suppliers(numbered(spark, spark.range(210_000).toDF("s_suppkey")))) > 100_000
