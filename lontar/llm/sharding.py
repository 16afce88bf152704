"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Within each source the rows are ranked in a seeded random order. A row of rank r among the n
of its source stands at the fraction (r + u) / n, where u in [0, 1) is drawn for each source so that sources
of one size do not fall on the same places; rows of all sources are merged by it, and the merged
order is cut into equal runs. Each run then holds every source in its share of the whole, to
within a few rows, and the runs' row counts differ by one at most (law `rows`).

No source is brought into one task: ranks come from counts of ranges of the order (see
`common.gapless_rank`), so a source with a third of all rows costs as many tasks as its size asks for.
The text is read once, for its size and CRC, and is never shuffled.

A null source is a source of its own. A null text has size 8 and the CRC of nothing. Rows with
equal or null ids are told apart by size and CRC; rows alike in all of these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm.common import gapless_rank, materialise

#: Ranges that the order is cut into: one for so many rows, but no more than MOST_CELLS in all.
ROWS_PER_CELL = 2048
MOST_CELLS = 65536


def shuffle_key(seed: str, id_col: Column) -> Column:
    """60 bits of the md5 of seed and id: a seeded random order that any engine can repeat."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def cells_for(rows: int) -> int:
    """A power of two, so that a range is a prefix of the key's bits."""
    return 1 << min(MOST_CELLS.bit_length() - 1, max(0, (rows // ROWS_PER_CELL).bit_length()))


def assign(docs: DataFrame, shards: int, seed: str = "interleave", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, size, text_crc32, source, position in the merged order, shard and slot in the shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            shuffle_key(seed, F.col(id_col)).alias("__key"),
        )
    )
    total = light.count()
    cells = cells_for(total)
    ties = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    in_source = light.withColumn("__cell", F.shiftright("__key", 60 - (cells.bit_length() - 1)))
    ranked = gapless_rank(in_source, ["source"], "__cell", [F.col("__key"), *ties], "__rank").drop("__cell")
    of_source = light.groupBy(F.col("source").alias("__source")).agg(F.count(F.lit(1)).alias("__of"))
    ranked = ranked.join(of_source, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:source:"), F.coalesce("source", F.lit("null")))), 1, 2), 16, 10).cast("long")
    ranked = ranked.withColumn("__part", 256 * F.col("__rank") + phase)
    ranked = ranked.withColumn("__cell", F.expr(f"(__part * {cells}) div (256 * __of)"))
    ranked = materialise(ranked.withColumn("__at", F.col("__part").cast("double") / (256 * F.col("__of")).cast("double")).drop("__part"))
    placed = gapless_rank(ranked, [], "__cell", [F.col("__at"), F.col("source"), F.col("__key"), *ties], "position")
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}")
    start = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - start).select("doc_id", "size", "text_crc32", "source", "position", "shard", "slot")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows as Parquet, a folder for each shard, in slot order. Ids must be unique and not null."""
    where = assigned.select(F.col("doc_id").alias("__id"), "shard", "slot")
    rows = docs.join(where, docs[id_col] == where["__id"]).drop("__id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
