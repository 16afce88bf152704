"""Sources and sinks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.errors import storage, type_error


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tbl(spark: SparkSession, path: str, schema: str, scaled: dict[str, int] | None = None) -> DataFrame:
    """Pipe-delimited text with a delimiter at the end of each line.

    `scaled` names columns written as decimals that become exact integers of 10^-scale; a value
    with more decimals than that is an error, found when the row is read.
    """
    scaled = scaled or {}
    struct = T._parse_datatype_string(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in struct] + [T.StructField("__end", T.StringType())])
    raw = spark.read.csv(path, schema=text, sep="|", quote="", mode="FAILFAST")
    out = []
    for f in struct:
        c = F.col(f.name)
        if f.name in scaled:
            wide = c.cast("decimal(38,18)") * F.lit(10 ** scaled[f.name]).cast("decimal(10,0)")
            lost = F.raise_error(F.concat(F.lit(f"{f.name} has more decimals than its scale: "), c))
            out.append(F.when(wide == F.floor(wide), wide.cast("long")).otherwise(F.when(c.isNotNull(), lost.cast("long"))).alias(f.name))
        else:
            out.append(c.cast(f.dataType).alias(f.name))
    return raw.select(*out)


def write_tsv(df: DataFrame, path: str) -> None:
    r"""Tab-separated text; NULL is \N. A text that holds a tab or a line break is written with escapes."""
    def field(f: T.StructField):
        c = F.col(f"`{f.name}`").cast("string")
        if isinstance(f.dataType, T.StringType):
            for raw, name in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                c = F.replace(c, F.lit(raw), F.lit(name))
        return F.coalesce(c, F.lit("\\N"))

    df.select(F.concat_ws("\t", *[field(f) for f in df.schema]).alias("value")).write.text(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_tsv has written."""
    struct = T._parse_datatype_string(schema)
    parts = F.split("value", "\t", -1)
    out = []
    for i, f in enumerate(struct):
        c = parts[i]
        plain = F.when(c != "\\N", c)
        if isinstance(f.dataType, T.StringType):
            plain = F.replace(plain, F.lit("\\\\"), F.lit("\0"))
            for raw, name in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                plain = F.replace(plain, F.lit(name), F.lit(raw))
            plain = F.replace(plain, F.lit("\0"), F.lit("\\"))
        out.append(plain.cast(f.dataType).alias(f.name))
    return spark.read.text(path).select(*out)


def check_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise storage(f"missing columns: {', '.join(missing)}")
    if len(set(names)) != len(names):
        raise type_error("column names repeat")
    return df.select(*names)
