"""What the corpus operators share: table access, the shared folder, gapless ranks."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let texts travel to Python in batches of some megabytes: fewer rows than Spark's default, which a setting of the session's own outranks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset and all run on one machine (tests) a temporary folder is set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lontar-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table written in the shared folder.

    Unlike a checkpoint it also has its true size, so that a plan that is built round by round on earlier results can broadcast what is
    small, and does not multiply sizes estimated in every round before.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that `settle` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_unread(spark: SparkSession) -> None:
    """Let the driver notice which shuffles and checkpoints nothing refers to any more, and delete their files; it would else do so at some later time."""
    gc.collect()
    spark._jvm.System.gc()


def in_few(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """df, of at most so many rows, in as many tasks as they need; more than there are stay as they are.

    A round over a few rows would otherwise write files for every shuffle partition.
    """
    return df.coalesce(max(1, -(-rows // per_task)))


def uniform_cell(key: Column, bits: int = 32) -> Column:
    """The first `bits` bits of an md5 hex string as a long."""
    return F.conv(F.substring(key, 1, bits // 4), 16, 10).cast("long")


def gapless_rank(df: DataFrame, group: list[str], cell: str, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group from 0, ordered by (cell, order), without bringing a group into one task.

    `cell` is a long column that cuts a group into ordered ranges. Rows are numbered within
    (group, cell); the sizes of the cells, one row each, are summed up before them. A group
    that holds a third of the table thus costs as many tasks as it has cells.
    """
    keys = [*group, cell]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    for k in keys:
        starts = starts.withColumnRenamed(k, f"__{k}")
    rows = df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = [rows[k].eqNullSafe(starts[f"__{k}"]) for k in keys]
    hit = on[0]
    for c in on[1:]:
        hit = hit & c
    return rows.join(starts, hit).withColumn(out, F.col("__start") + F.col("__row") - 1).drop("__start", "__row", *(f"__{k}" for k in keys))
