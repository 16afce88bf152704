"""Versioned tables: immutable Parquet data and a log of JSON manifests.

A database is a folder. `_log/<csn>.json` lists, for each commit sequence number, every
table's columns, data folders and counters and every view's text. Data folders are never changed; a commit adds one
manifest by exclusive creation, so the first of two committers wins and the other sees the new head. Rows carry
their insertion order in the column ORD.

The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

import copy
import datetime as dt
import hashlib
import json
import os
import shutil
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.engine.kinds import SPARK, ColumnDef
from lontar.errors import general, storage

ORD = "__ord"
#: Names that some file systems reserve.
RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}


@dataclass
class Table:
    """version: the commit that last changed it; next_ord, next_auto: counters; rows: how many, if known.

    Each path holds later rows (by ORD) than the paths before it.
    """

    columns: list[ColumnDef]
    paths: list[str] = field(default_factory=list)
    version: int = 0
    next_ord: int = 0
    next_auto: dict[str, int] = field(default_factory=dict)
    rows: int | None = 0

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise general(f"column {name} not found")

    @property
    def primary(self) -> list[str]:
        return [c.name for c in self.columns if c.primary]

    def keys(self) -> list[tuple[str, list[str]]]:
        """(what, columns) of every uniqueness constraint."""
        return ([("Primary Key", self.primary)] if self.primary else []) + [("Unique", [c.name]) for c in self.columns if c.unique]


@dataclass
class Manifest:
    csn: int = 0
    schema_epoch: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)

    def copy(self) -> Manifest:
        return copy.deepcopy(self)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise general(f"table {name} not found")
        return self.tables[name]

    def to_json(self) -> str:
        return json.dumps({"csn": self.csn, "schema_epoch": self.schema_epoch, "tables": {k: asdict(t) for k, t in self.tables.items()}, "views": self.views, "time": dt.datetime.now(dt.timezone.utc).isoformat()}, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Manifest:
        try:
            d = json.loads(text)
            tables = {k: Table(**{"rows": None, **t, "columns": [ColumnDef(**c) for c in t["columns"]]}) for k, t in d["tables"].items()}
            return Manifest(d["csn"], d["schema_epoch"], tables, d["views"])
        except (ValueError, KeyError, TypeError) as e:
            raise storage("not a manifest") from e


class Database:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log, self.held = spark, folder, os.path.join(folder, "_log"), os.path.join(folder, "_held")

    @staticmethod
    def check_name(name: str) -> str:
        if not name or not all(c.isalnum() or c in "_-" for c in name) or name.lower() in RESERVED:
            raise general(f"not a database name: {name!r}")
        return name

    def create(self) -> None:
        if os.path.exists(self.folder):
            raise general("the database exists already")
        os.makedirs(self.log)
        self._publish(Manifest())

    def open(self) -> Manifest:
        if not os.path.isdir(self.folder):
            raise general("no such database")
        if not os.path.isdir(self.log):
            raise storage("not a database folder")
        return self.head()

    def versions(self) -> list[int]:
        return sorted(int(f[:-5]) for f in os.listdir(self.log) if f.endswith(".json"))

    def at(self, csn: int) -> Manifest:
        try:
            with open(os.path.join(self.log, f"{csn:020}.json"), encoding="utf-8") as f:
                return Manifest.from_json(f.read())
        except FileNotFoundError:
            raise storage(f"no version {csn}") from None

    def head(self) -> Manifest:
        return self.at(self.versions()[-1])

    def _publish(self, m: Manifest) -> bool:
        """Write the manifest for its csn, whole or not at all; False if that csn is taken."""
        target, part = os.path.join(self.log, f"{m.csn:020}.json"), os.path.join(self.log, f".{uuid.uuid4().hex}")
        with open(part, "x", encoding="utf-8") as f:
            f.write(m.to_json())
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, target)  # fails if the target exists
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)

    def new_path(self, table: str) -> str:
        return os.path.join(self.folder, table, f"v-{uuid.uuid4().hex}")

    def read(self, t: Table) -> DataFrame:
        """The rows of a table, with ORD."""
        schema = ", ".join([*(f"`{c.name}` {SPARK[c.kind]}" for c in t.columns), f"{ORD} bigint"])
        return self.spark.read.schema(schema).parquet(*t.paths) if t.paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, table: str) -> str:
        path = self.new_path(table)
        df.write.parquet(path)
        return path

    def commit(self, base: Manifest, staged: Manifest, reads: set[str], writes: set[str], ddl: bool) -> Manifest | None:
        """Publish the tables in `writes` on top of the head; None if what was read or written has changed since `base`."""
        while True:
            head = self.head()
            if head.csn != base.csn:
                if (ddl or reads) and head.schema_epoch != base.schema_epoch:
                    return None
                version = lambda m, name: m.tables[name].version if name in m.tables else None
                if any(version(head, name) != version(base, name) for name in reads | writes):
                    return None
            new = head.copy()
            new.csn = head.csn + 1
            for name in writes:
                if name in staged.tables:
                    new.tables[name] = copy.deepcopy(staged.tables[name])
                    new.tables[name].version = new.csn
                else:
                    new.tables.pop(name, None)
            if ddl:
                new.views, new.schema_epoch = dict(staged.views), head.schema_epoch + 1
            if self._publish(new):
                return new

    def hold(self, csn: int) -> str:
        """Tell others that a snapshot of this version is open; the file to be given to `release`."""
        os.makedirs(self.held, exist_ok=True)
        path = os.path.join(self.held, f"{csn:020}-{uuid.uuid4().hex}")
        with open(path, "x", encoding="utf-8"):
            pass
        return path

    @staticmethod
    def release(path: str) -> None:
        if os.path.exists(path):
            os.unlink(path)

    def snapshots(self, most_hours: float) -> set[int]:
        """The versions of open snapshots; files of sessions that died are passed over once they are old."""
        names = os.listdir(self.held) if os.path.isdir(self.held) else []
        young = dt.datetime.now().timestamp() - 3600 * most_hours
        return {int(f.split("-")[0]) for f in names if os.path.getmtime(os.path.join(self.held, f)) >= young}

    def vacuum(self, keep: int = 1, most_hours: float = 24) -> int:
        """Drop all but the last `keep` versions and those of open snapshots, and data that only they used; the number of folders deleted.

        A snapshot that is open for more than `most_hours` counts as left behind. Data folders of less than an hour that no version
        names stay: a transaction may be about to publish them.
        """
        versions = self.versions()
        open_ = self.snapshots(most_hours)
        kept = [v for i, v in enumerate(versions) if i >= len(versions) - keep or v in open_]
        old = sorted(set(versions) - set(kept))
        named = {os.path.abspath(p) for v in versions for t in self.at(v).tables.values() for p in t.paths}
        used = {os.path.abspath(p) for v in kept for t in self.at(v).tables.values() for p in t.paths}
        for v in old:
            os.unlink(os.path.join(self.log, f"{v:020}.json"))
        gone = 0
        for name in os.listdir(self.folder):
            place = os.path.join(self.folder, name)
            for d in os.listdir(place) if not name.startswith("_") and os.path.isdir(place) else []:
                at = os.path.abspath(os.path.join(place, d))
                fresh = at not in named and os.path.getmtime(at) > dt.datetime.now().timestamp() - 3600
                if at not in used and not fresh:
                    shutil.rmtree(os.path.join(place, d))
                    gone += 1
        return gone

    def size(self, t: Table) -> int:
        """Bytes of a table's files."""
        return sum(os.path.getsize(os.path.join(d, f)) for p in t.paths for d, _, files in os.walk(p) for f in files)

    def checkpoint(self, most: int = 8) -> int:
        """Compact every table of more than `most` folders, so manifests do not grow with each commit; how many there were."""
        names = [k for k, t in self.head().tables.items() if len(t.paths) > most]
        for k in names:
            self.compact(k)
        return len(names)

    def compact(self, table: str, file_bytes: int = 128 << 20) -> Manifest:
        """Rewrite a table's many small files as some of about `file_bytes`, each a range of the insertion order."""
        base = self.head()
        staged = base.copy()
        t = staged.table(table)
        files = max(1, -(-self.size(t) // file_bytes))
        rows = self.read(t)
        t.paths = [self.write(rows.repartitionByRange(files, ORD).sortWithinPartitions(ORD) if files > 1 else rows.coalesce(1), table)]
        done = self.commit(base, staged, set(), {table}, False)
        if done is None:
            raise storage("the table has changed meanwhile")
        return done

    def backup(self, target: str) -> dict[str, str]:
        """Copy the head version and its data; a checksum of every file, kept beside them."""
        m = self.head().copy()
        os.makedirs(os.path.join(target, "_log"))
        for name, t in m.tables.items():
            new = []
            for p in t.paths:
                new.append(os.path.join(target, name, os.path.basename(p)))
                shutil.copytree(p, new[-1])
            t.paths = new
        Database(self.spark, target)._publish(m)
        sums = {}
        for d, _, files in os.walk(target):
            for f in files:
                with open(os.path.join(d, f), "rb") as h:
                    sums[os.path.relpath(os.path.join(d, f), target)] = hashlib.sha256(h.read()).hexdigest()
        with open(os.path.join(target, "SHA256.json"), "w", encoding="utf-8") as h:
            json.dump(sums, h, indent=1)
        return sums

    @staticmethod
    def verify_backup(target: str) -> bool:
        with open(os.path.join(target, "SHA256.json"), encoding="utf-8") as h:
            sums = json.load(h)
        for name, digest in sums.items():
            path = os.path.join(target, name)
            if not os.path.exists(path):
                return False
            with open(path, "rb") as h:
                if hashlib.sha256(h.read()).hexdigest() != digest:
                    return False
        return True

    def version_at(self, moment: dt.datetime) -> int:
        """The last version committed at or before a moment (with a time zone)."""
        for csn in reversed(self.versions()):
            with open(os.path.join(self.log, f"{csn:020}.json"), encoding="utf-8") as f:
                if dt.datetime.fromisoformat(json.load(f)["time"]) <= moment:
                    return csn
        raise storage("no version is that old")

    def restore_at(self, csn: int) -> Manifest:
        """Make an older version the head again, as a new commit."""
        old, head = self.at(csn), self.head()
        old.csn, old.schema_epoch = head.csn + 1, head.schema_epoch + 1
        for t in old.tables.values():
            t.version = old.csn
        if not self._publish(old):
            raise storage("another commit came first")
        return old


def statistics(df: DataFrame, columns: list[str], rsd: float | None = None) -> DataFrame:
    """(column_name, rows, nulls, ndv, least, greatest) in one pass; least and greatest as text. `rsd` estimates ndv instead of counting."""
    parts = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        ndv = F.count_distinct(x) if rsd is None else F.approx_count_distinct(x, rsd)
        parts += [F.count_if(x.isNull()).alias(f"n{i}"), ndv.alias(f"d{i}"), F.min(x).cast("string").alias(f"l{i}"), F.max(x).cast("string").alias(f"g{i}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    entries = [F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("ndv"), F.col(f"l{i}").alias("least"), F.col(f"g{i}").alias("greatest")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*entries)))


def literal_rows(spark: SparkSession, t: Table, rows: list[list[Any]]) -> DataFrame:
    schema = ", ".join([*(f"`{c.name}` {SPARK[c.kind]}" for c in t.columns), f"{ORD} bigint"])
    return spark.createDataFrame([(*r, t.next_ord + i) for i, r in enumerate(rows)], schema)
