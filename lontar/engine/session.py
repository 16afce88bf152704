"""Sessions: statements, transactions, and keyed access over a folder of databases."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager

from decimal import Decimal
from fractions import Fraction
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.dialect import nodes as n
from lontar.dialect.compile import Bound, Expressions, Result, Source, Val, as_source, compile_select, contains_aggregate, exact_decimals
from lontar.dialect.lexer import split_statements
from lontar.dialect.parser import parse
from lontar.engine.catalog import ORD, Database, Manifest, Table, literal_rows, statistics
from lontar.engine.formatter import QueryResult
from lontar.engine.kinds import MOST_COLUMNS, NUMERIC, SPARK, ColumnDef, check_name, field_value, from_text, from_value
from lontar.errors import CONFLICT, EngineError, conflict, constraint, general, type_error
from lontar.operators.rel import Key, Rel, hidden, relation

READS = (n.Select, n.Explain)


class Session:
    def __init__(self, spark: SparkSession, root: str, role: str = "admin", most_rows: int = 100_000):
        """role: admin, or reader, which may only query. most_rows: the rows that a result may have."""
        self.spark, self.root, self.role, self.most_rows = spark, root, role, most_rows
        self.db: Database | None = None
        self.base: Manifest | None = None
        self.staged: Manifest | None = None
        self._held: str | None = None
        self.reads: set[str] = set()
        self.writes: set[str] = set()
        self.ddl = False
        self.external: dict[str, tuple[DataFrame, list[ColumnDef]]] = {}

    # --- statements

    def execute(self, text: str) -> QueryResult:
        """Run one statement and fetch its result."""
        return self._run(parse(text))

    def script(self, text: str) -> tuple[list[QueryResult], str]:
        """Run statements up to the first error; their results and what is left of the text."""
        parts, rest = split_statements(text)
        return [self.execute(p) for p in parts], rest

    def query(self, text: str, ordered: bool = False) -> DataFrame:
        """The DataFrame of a query, not run."""
        q = parse(text)
        if not isinstance(q, n.Select):
            raise general("not a query")
        return self.compile(q).frame(ordered)

    def compile(self, q: n.Select) -> Result:
        with exact_decimals(self.spark):
            return compile_select(q, self._source)

    def _run(self, s: Any) -> QueryResult:
        if self.role != "admin" and not isinstance(s, (*READS, n.UseDatabase)):
            raise general("a reader may only query")
        if isinstance(s, n.Select):
            return self._fetch(self.compile(s))
        if isinstance(s, n.Explain):
            from lontar.dialect.explain import explain

            return QueryResult(["Plan"], [[line] for line in explain(self, s.query)])
        if isinstance(s, (n.CreateDatabase, n.UseDatabase)):
            if self.staged is not None:
                raise general("not inside a transaction")
            return self._database(s)
        if isinstance(s, n.Transaction):
            {"begin": self.begin, "commit": self.commit, "rollback": self.rollback}[s.action]()
            return self._status({"begin": "Transaction begun", "commit": "Committed", "rollback": "Rolled back"}[s.action], 0)
        return self._change(lambda: self._status(*_STATEMENTS[type(s)](self, s)))

    @staticmethod
    def _status(message: str, rows: int) -> QueryResult:
        return QueryResult(["Status", "Baris"], [[message, rows]])

    def _fetch(self, r: Result) -> QueryResult:
        """Collect a result, with ratios as exact fractions."""
        df = r.df.orderBy(*[k.column() for k in r.order]) if r.order else r.df
        rows = df.select(*r.columns, *[p for p in r.pers if p]).limit(self.most_rows + 1).collect()
        if len(rows) > self.most_rows:
            raise general(f"the result has more than {self.most_rows} rows")
        out = []
        for row in rows:
            values = []
            for c, p, kind in zip(r.columns, r.pers, r.kinds):
                v = row[c]
                if p is not None:
                    v = None if v is None or row[p] is None else Fraction(v) / Fraction(row[p])
                    v = int(v) if v is not None and v.denominator == 1 else v
                elif isinstance(v, Decimal) and kind != "U":
                    v = int(v) if v == v.to_integral_value() else v.normalize()
                values.append(v)
            out.append(values)
        return QueryResult(r.labels, out, r.kinds)

    # --- databases and snapshots

    def _database(self, s: Any) -> QueryResult:
        name = s.name
        if isinstance(s, n.UseDatabase) and not os.path.isdir(os.path.join(self.root, name)):
            name = os.path.splitext(name)[0]
        db = Database(self.spark, os.path.join(self.root, Database.check_name(name)))
        if isinstance(s, n.CreateDatabase):
            db.create()
        else:
            db.open()
        self.db = db
        return self._status(f"Database {name}", 0)

    def _open(self) -> Database:
        if self.db is None:
            raise general("no database is in use")
        return self.db

    @property
    def manifest(self) -> Manifest:
        """What this session sees: its transaction's state, or the head."""
        return self.staged if self.staged is not None else self._open().head()

    def register(self, name: str, df: DataFrame, kinds: Mapping[str, str] | None = None) -> None:
        """Make a DataFrame readable as a table. Kinds are inferred from its types."""
        named = {"bigint": "I", "int": "I", "smallint": "I", "tinyint": "I", "double": "F", "float": "F", "boolean": "B", "string": "C", "date": "T", "timestamp_ntz": "TW"}
        columns = []
        for c, t in df.dtypes:
            kind = (kinds or {}).get(c) or ("D" if t.startswith("decimal") else named.get(t))
            if kind is None:
                raise type_error(f"no kind for {c} of type {t}")
            columns.append(ColumnDef(c, kind))
        self.external[check_name(name)] = (df, columns)

    def _source(self, name: str, stack: tuple[str, ...] = ()) -> Source:
        """A table or view as a source of a query."""
        if name in self.external:
            df, columns = self.external[name]
            names = [hidden() for _ in columns]
            picked = [F.col(f"`{c.name}`").cast(SPARK[c.kind]).alias(h) if c.kind != "D" else F.col(f"`{c.name}`").alias(h) for c, h in zip(columns, names)]
            return Source(df.select(*picked), [Bound(name, c.name, c.kind, h) for c, h in zip(columns, names)])
        m = self.manifest
        if name in m.views:
            if name in stack or len(stack) >= 64:
                raise general(f"view {name} depends on itself or on too many views")
            return as_source(name, compile_select(parse(m.views[name]), self._source, (*stack, name)))
        t = m.table(name)
        self.reads.add(name)
        names, order = [hidden() for _ in t.columns], hidden()
        df = self._open().read(t).select(*[F.col(f"`{c.name}`").alias(h) for c, h in zip(t.columns, names)], F.col(ORD).alias(order))
        return Source(df, [Bound(name, c.name, c.kind, h) for c, h in zip(t.columns, names)], [Key(order)])

    # --- transactions

    def begin(self) -> None:
        if self.staged is not None:
            raise general("a transaction is open already")
        self.base = self._open().head()
        self._held = self.db.hold(self.base.csn)
        self.staged, self.reads, self.writes, self.ddl = self.base.copy(), set(), set(), False

    def _end(self) -> None:
        if self._held:
            self.db.release(self._held)
        self._held = None
        self.base = self.staged = None
        self.reads, self.writes, self.ddl = set(), set(), False

    def rollback(self) -> None:
        if self.staged is None:
            raise general("no transaction is open")
        self._end()

    def commit(self) -> None:
        if self.staged is None:
            raise general("no transaction is open")
        try:
            if (self.writes or self.ddl) and self._open().commit(self.base, self.staged, self.reads, self.writes, self.ddl) is None:
                raise conflict("a table that was read or written has been changed by another transaction")
        finally:
            self._end()

    @contextmanager
    def snapshot(self) -> Iterator[Session]:
        """All reads inside see one version."""
        if self.staged is not None:
            yield self
            return
        self.begin()
        try:
            yield self
        finally:
            if self.staged is not None:
                self._end()

    def with_transaction(self, f: Callable[[Session], Any], retries: int = 5) -> Any:
        """Run f in a transaction, again after a conflict."""
        for attempt in range(retries + 1):
            self.begin()
            try:
                out = f(self)
                self.commit()
                return out
            except EngineError as e:
                if self.staged is not None:
                    self._end()
                if e.category != CONFLICT or attempt == retries:
                    raise
                time.sleep(min(0.5, 0.01 * 2**attempt))
            except BaseException:
                if self.staged is not None:
                    self._end()
                raise

    def _change(self, f: Callable[[], Any]) -> Any:
        """A change in the open transaction, all or nothing; else in one of its own."""
        if self.staged is None:
            self._open()
            return self.with_transaction(lambda _: f())
        before = self.staged.copy(), set(self.writes), self.ddl
        try:
            return f()
        except BaseException:
            self.staged, self.writes, self.ddl = before
            raise

    # --- changes to tables

    def _put(self, name: str, df: DataFrame, validate: bool = True) -> None:
        """Replace a table's rows by df, written once and then checked."""
        t = self.staged.table(name)
        t.paths = [self.db.write(df, name)]
        if validate:
            self._validate(name, self.db.read(t))
        self.writes.add(name)

    def _validate(self, name: str, df: DataFrame) -> None:
        t = self.staged.table(name)
        strict = [c.name for c in t.columns if not c.nullable]
        if strict:
            bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in strict]).first()
            for c in strict:
                if bad[c]:
                    raise constraint(f"{c} must not be NULL")
        for what, columns in t.keys():
            held = df.select(*[F.col(f"`{c}`") for c in columns]).dropna()
            if not held.groupBy(*[f"`{c}`" for c in columns]).count().filter("count > 1").isEmpty():
                raise constraint(f"{what} ({', '.join(columns)}) must be unique")

    def _add(self, name: str, rows: list[list[Any]]) -> int:
        """Append rows of typed values, None in auto columns."""
        t = self.staged.table(name)
        autos = [i for i, c in enumerate(t.columns) if c.auto]
        for row in rows:
            for i in autos:
                if row[i] is None:
                    row[i] = t.next_auto.setdefault(t.columns[i].name, 1)
                t.next_auto[t.columns[i].name] = max(t.next_auto.get(t.columns[i].name, 1), row[i] + 1)
            for c, v in zip(t.columns, row):
                if v is None and not c.nullable:
                    raise constraint(f"{c.name} must not be NULL")
        if not rows:
            return 0
        at = {c.name: i for i, c in enumerate(t.columns)}
        new = literal_rows(self.spark, t, rows)
        for what, columns in t.keys():
            keys = [k for k in (tuple(row[at[c]] for c in columns) for row in rows) if None not in k]
            clash = len(set(keys)) != len(keys)
            if not clash and t.paths and keys:
                few = new.select(*[F.col(f"`{c}`") for c in columns]).dropna()
                clash = not self.db.read(t).join(few, columns, "left_semi").isEmpty()
            if clash:
                raise constraint(f"{what} ({', '.join(columns)}) must be unique")
        if t.keys() or autos:
            self.reads.add(name)
        t.paths = [*t.paths, self.db.write(new.coalesce(1), name)]
        t.next_ord += len(rows)
        t.rows = None if t.rows is None else t.rows + len(rows)
        self.writes.add(name)
        return len(rows)

    def _insert(self, s: n.Insert) -> tuple[str, int]:
        t = self.staged.table(s.table)
        given = [c for c in t.columns if not c.auto]
        rows = []
        for fields in s.rows:
            if len(fields) != len(given):
                raise general(f"{s.table} takes {len(given)} values, not {len(fields)}")
            values = iter([field_value(c, f) for c, f in zip(given, fields)])
            rows.append([None if c.auto else next(values) for c in t.columns])
        return "Inserted", self._add(s.table, rows)

    def _scope(self, name: str) -> tuple[Table, DataFrame, Expressions]:
        t = self.staged.table(name)
        self.reads.add(name)
        return t, self.db.read(t), Expressions([Bound(name, c.name, c.kind, f"`{c.name}`") for c in t.columns])

    def _condition(self, rows: Expressions, where: Any) -> Column:
        if where is None:
            return F.lit(True)
        v = rows(where)
        if v.kind not in ("B", "NULL"):
            raise type_error("a condition is Boolean")
        return F.coalesce(v.value.cast("boolean"), F.lit(False))

    def _update(self, s: n.Update) -> tuple[str, int]:
        with exact_decimals(self.spark):
            t, df, rows = self._scope(s.table)
            hit, new = self._condition(rows, s.where), {}
            for name, expr, text in s.sets:
                c = t.column(name)
                if name in new:
                    raise general(f"{name} is set twice")
                new[name] = assignment(c, expr, text, rows)
            count = df.filter(hit).count()
            if count == 0:
                return "Updated", 0
            out = df.select(*[(F.when(hit, new[c.name]).otherwise(F.col(f"`{c.name}`")) if c.name in new else F.col(f"`{c.name}`")).alias(c.name) for c in t.columns], ORD)
            try:
                self._put(s.table, out)
            except EngineError:
                raise
            except Exception as e:  # an error that the plan itself raises for a value
                raise type_error(_reason(e)) from e
        for c in t.columns:
            if c.auto and c.name in new:
                low, high = self.db.read(t).agg(F.min(c.name), F.max(c.name)).first()
                if low is not None and low < 1:
                    raise constraint(f"{c.name} must be 1 or more")
                t.next_auto[c.name] = max(t.next_auto.get(c.name, 1), (high or 0) + 1)
        return "Updated", count

    def _delete(self, s: n.Delete) -> tuple[str, int]:
        with exact_decimals(self.spark):
            t, df, rows = self._scope(s.table)
            hit = self._condition(rows, s.where)
            count = df.filter(hit).count()
            t.rows = None if t.rows is None else t.rows - count
            if s.where is None:
                t.paths = []
                self.writes.add(s.table)
            elif count:
                self._put(s.table, df.filter(~hit), validate=False)
        return "Deleted", count

    # --- definitions

    def _defined(self, *written: str) -> None:
        """After a change of definitions every view must still compile."""
        self.ddl = True
        self.writes.update(written)
        with exact_decimals(self.spark):
            for name in self.staged.views:
                self._source(name)

    def _free(self, name: str) -> None:
        check_name(name)
        if name in self.staged.tables or name in self.staged.views:
            raise general(f"{name} exists already")

    def _create_table(self, s: n.CreateTable) -> tuple[str, int]:
        self._free(s.name)
        if len({c.name for c in s.columns}) != len(s.columns) or len(s.columns) > MOST_COLUMNS:
            raise general("column names repeat, or there are too many")
        for c in s.columns:
            if c.auto and c.kind != "I":
                raise general("only I columns can be automatic")
        self.staged.tables[s.name] = Table(list(s.columns), next_auto={c.name: 1 for c in s.columns if c.auto})
        self._defined(s.name)
        return "Table created", 0

    def _add_column(self, s: n.AddColumn) -> tuple[str, int]:
        t = self.staged.table(s.table)
        if any(c.name == s.column.name for c in t.columns):
            raise general(f"{s.column.name} exists already")
        if not s.column.nullable and t.paths and not self.db.read(t).isEmpty():
            raise constraint("a NOT NULL column needs an empty table")
        t.columns = [*t.columns, s.column]  # older files lack it and read as NULL
        self.reads.add(s.table)
        self._defined(s.table)
        return "Column added", 0

    def _drop_column(self, s: n.DropColumn) -> tuple[str, int]:
        t = self.staged.table(s.table)
        c = t.column(s.column)
        if c.primary or len(t.columns) == 1:
            raise constraint("a primary key or the last column cannot go")
        # The files keep the dropped values, so a later column of that name must not find them: rewrite.
        t.columns = [x for x in t.columns if x.name != s.column]
        if t.paths:
            self._put(s.table, self.db.read(t), validate=False)
        self._defined(s.table)
        return "Column dropped", 0

    def _drop_table(self, s: n.DropTable) -> tuple[str, int]:
        self.staged.table(s.name)
        del self.staged.tables[s.name]
        self._defined(s.name)
        return "Table dropped", 0

    def _create_view(self, s: n.CreateView) -> tuple[str, int]:
        self._free(s.name)
        with exact_decimals(self.spark):
            labels = compile_select(s.query, self._source).labels
        if len(set(labels)) != len(labels):
            raise general("labels of a view must be unique")
        self.staged.views[s.name] = n.select_text(s.query)
        self._defined()
        return "View created", 0

    # --- keyed and bulk access

    def table_columns(self, name: str) -> list[ColumnDef]:
        return list(self.manifest.table(name).columns)

    def table_stats(self, name: str) -> DataFrame:
        t = self.manifest.table(name)
        return statistics(self._open().read(t), [c.name for c in t.columns])

    def scan_rows(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        """Rows in insertion order."""
        t = self.manifest.table(name)
        self.reads.add(name)
        names = [t.column(c).name for c in columns] if columns is not None else [c.name for c in t.columns]
        return self._open().read(t).orderBy(ORD).select(*[F.col(f"`{c}`") for c in names])

    def stream(self, name: str, columns: Iterable[str] | None = None, batch: int = 256) -> Iterator[list[tuple]]:
        """Rows in insertion order, in batches; the driver holds one partition at a time.

        Data folders follow each other in that order, so each is read and sorted when its turn comes, and a reader that stops early leaves the rest unread.
        """
        t = self.manifest.table(name)
        self.reads.add(name)
        names = [t.column(c).name for c in columns] if columns is not None else [c.name for c in t.columns]
        rows: list[tuple] = []
        for path in t.paths:
            part = self._open().read(Table(t.columns, [path])).orderBy(ORD).select(*[F.col(f"`{c}`") for c in names])
            for row in part.toLocalIterator(prefetchPartitions=False):
                rows.append(tuple(row))
                if len(rows) == batch:
                    yield rows
                    rows = []
        if rows:
            yield rows

    def relation(self, name: str, columns: Iterable[str] | None = None, prefix: str = "") -> Rel:
        t = self.manifest.table(name)
        self.reads.add(name)
        return relation(self._open().read(t), [c.name for c in t.columns] if columns is None else list(columns), prefix, by=ORD)

    def _key(self, name: str, key: Any) -> Column:
        t = self.manifest.table(name)
        if not t.primary:
            raise general(f"{name} has no primary key")
        values = key if isinstance(key, (tuple, list)) else (key,)
        if len(values) != len(t.primary):
            raise general("the key has not as many values as the primary key has columns")
        out = F.lit(True)
        for c, v in zip(t.primary, values):
            out = out & (F.col(f"`{c}`") == F.lit(from_value(t.column(c), v)))
        return out

    def lookup(self, name: str, key: Any) -> dict[str, Any] | None:
        """The row of a primary key. The filter reaches the Parquet scan, which skips by its statistics."""
        t = self.manifest.table(name)
        self.reads.add(name)
        row = self._open().read(t).filter(self._key(name, key)).drop(ORD).first()
        return row.asDict() if row else None

    def bulk_insert(self, name: str, rows: Iterable[Mapping[str, Any]] | DataFrame) -> int:
        """Append rows, all or none. A DataFrame is appended in place of a driver's rows: its columns must be the table's and the values of their kinds."""
        if isinstance(rows, DataFrame):
            return self._change(lambda: self._append(name, rows))

        def add() -> int:
            t = self.staged.table(name)
            known = {c.name for c in t.columns}
            typed = []
            for r in rows:
                if set(r) - known:
                    raise general(f"no such column: {', '.join(set(r) - known)}")
                typed.append([from_value(c, r.get(c.name)) for c in t.columns])
            return self._add(name, typed)

        return self._change(add)

    def _append(self, name: str, rows: DataFrame) -> int:
        t = self.staged.table(name)
        if any(c.auto for c in t.columns):
            raise general("automatic columns take no DataFrame")
        picked = []
        for c in t.columns:
            x = F.col(f"`{c.name}`")
            if c.kind == "C":
                x = F.when(F.length(x) > c.max_length, F.raise_error(F.lit(f"{c.name} holds {c.max_length} characters at most"))).otherwise(x)
            if c.kind == "F":
                x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit(f"{c.name} takes finite numbers only")).cast("double")).otherwise(x)
            picked.append(x.cast(SPARK[c.kind]).alias(c.name))
        # Ids grow in steps from task to task, so the order needs no shuffle; the counter moves past the greatest.
        path = self.db.write(rows.select(*picked, (F.lit(t.next_ord) + F.monotonically_increasing_id()).alias(ORD)), name)
        new = self.db.read(Table(t.columns, [path]))
        self._validate(name, new)
        for what, columns in t.keys():  # the old rows are valid already: the new keys are looked up among them
            keys = [F.col(f"`{c}`") for c in columns]
            if t.paths and not self.db.read(t).select(*keys).join(new.select(*keys).dropna(), columns, "left_semi").isEmpty():
                raise constraint(f"{what} ({', '.join(columns)}) must be unique")
        t.paths = [*t.paths, path]
        count, last = new.agg(F.count(F.lit(1)), F.max(ORD)).first()
        t.next_ord = max(t.next_ord, (last if last is not None else -1) + 1)
        t.rows = None if t.rows is None else t.rows + count
        self.reads.add(name)
        self.writes.add(name)
        return count

    def update_key(self, name: str, key: Any, change: Mapping[str, Any] | Callable[[dict[str, Any]], Mapping[str, Any]]) -> bool:
        """Change one row by its key: new values, or a function of the old row."""

        def run() -> bool:
            old = self.lookup(name, key)
            if old is None:
                return False
            t, hit = self.staged.table(name), self._key(name, key)
            new = {k: from_value(t.column(k), v) for k, v in dict(change(old) if callable(change) else change).items()}
            df = self.db.read(t)
            self._put(name, df.select(*[(F.when(hit, F.lit(new[c.name]).cast(SPARK[c.kind])).otherwise(F.col(f"`{c.name}`")) if c.name in new else F.col(f"`{c.name}`")).alias(c.name) for c in t.columns], ORD))
            return True

        return self._change(run)

    def delete_key(self, name: str, key: Any) -> bool:
        def run() -> bool:
            if self.lookup(name, key) is None:
                return False
            t = self.staged.table(name)
            self._put(name, self.db.read(t).filter(~self._key(name, key)), validate=False)
            t.rows = None if t.rows is None else t.rows - 1
            return True

        return self._change(run)

    def bulk_delete(self, name: str, keys: DataFrame) -> int:
        """Delete the rows whose primary keys a DataFrame holds, by one rewrite of the table; how many there were.

        Its columns must have the names and types of the key's (narrower integers will do); others are passed over.
        """

        def run() -> int:
            t = self.staged.table(name)
            if not t.primary:
                raise general(f"{name} has no primary key")
            given, picked = dict(keys.dtypes), []
            for c in t.primary:
                kind = SPARK[t.column(c).kind]
                if given.get(c) != kind and not (kind == "bigint" and given.get(c) in ("int", "smallint", "tinyint")):
                    raise type_error(f"{c} takes keys of type {kind}")
                picked.append(F.col(f"`{c}`").cast(kind).alias(c))
            self.reads.add(name)
            if not t.paths:
                return 0
            rows = self.db.read(t)
            left = rows.join(keys.select(*picked), t.primary, "left_anti").select(*[F.col(f"`{c.name}`") for c in t.columns], ORD)
            path = self.db.write(left, name)
            count = rows.count() - self.db.read(Table(t.columns, [path])).count()  # both from the files' footers
            if not count:
                shutil.rmtree(path)
                return 0
            t.paths = [path]
            t.rows = None if t.rows is None else t.rows - count
            self.writes.add(name)
            return count

        return self._change(run)

    def stats(self) -> dict[str, int]:
        m, db = self.manifest, self._open()
        return {"csn": m.csn, "versions": len(db.versions()), "tables": len(m.tables), "views": len(m.views), "folders": sum(len(t.paths) for t in m.tables.values())}

    def monitor(self, command: str) -> QueryResult:
        """.databases .tables .schema NAME .current .mvcc .checkpoint .vacuum .compact NAME .help"""
        word, _, arg = command.strip().partition(" ")
        if word == ".databases":
            return QueryResult(["Database"], [[d] for d in sorted(os.listdir(self.root)) if os.path.isdir(os.path.join(self.root, d, "_log"))])
        if word == ".tables":
            m = self.manifest
            return QueryResult(["Name", "Kind"], [[t, "table"] for t in sorted(m.tables)] + [[v, "view"] for v in sorted(m.views)])
        if word == ".schema":
            return QueryResult(["Column", "Kind", "Length", "Key", "Null"], [[c.name, c.kind, c.max_length if c.kind == "C" else None, "P" if c.primary else "N" if c.unique else "", c.nullable] for c in self.table_columns(arg)])
        if word == ".current":
            return QueryResult(["Database"], [[os.path.basename(self._open().folder)]])
        if word == ".mvcc":
            return QueryResult(["Name", "Value"], [[k, v] for k, v in self.stats().items()])
        if word in (".vacuum", ".compact", ".checkpoint") and self.role != "admin":
            raise general("a reader may only query")
        if word == ".checkpoint":
            return self._status("Checkpointed", self._open().checkpoint())
        if word == ".vacuum":
            return self._status("Vacuumed", self._open().vacuum())
        if word == ".compact":
            self._open().compact(arg)
            return self._status("Compacted", 0)
        return QueryResult(["Command"], [[c] for c in self.monitor.__doc__.split() if c.startswith(".")])


def _reason(e: Exception) -> str:
    text = str(e)
    return text.split("Type Error: ")[-1].split("\n")[0][:200] if "Type Error: " in text else text.split("\n")[0][:200]


def assignment(c: ColumnDef, expr: Any, text: str, rows: Expressions) -> Column:
    """The column of a new value; what does not fit exactly is an error when it runs."""
    if c.kind == "C" and (expr is None or (isinstance(expr, n.Ref) and expr.source is None and all(b.name != expr.name for b in rows.schema))):
        return F.lit(from_value(c, text))
    if expr is None:
        raise general(f"not an expression: {text!r}")
    if contains_aggregate(expr):
        raise general("an aggregate does not belong here")
    if isinstance(expr, n.Lit):
        if c.kind == "C" and expr.value is not None and not isinstance(expr.value, str):
            raise type_error(f"{c.name} takes text")
        if c.kind != "C" and isinstance(expr.value, str) and c.kind in NUMERIC:
            raise type_error(f"{c.name} takes numbers")
        value = from_text(c, expr.value) if isinstance(expr.value, str) and c.kind != "C" else from_value(c, expr.value)
        if value is None and not c.nullable:
            raise constraint(f"{c.name} must not be NULL")
        return F.lit(value).cast(SPARK[c.kind])
    v = rows(expr)
    if v.kind == "NULL":
        return F.lit(None).cast(SPARK[c.kind])
    if c.kind in NUMERIC and v.kind in NUMERIC:
        return _number(c, v)
    if c.kind != v.kind:
        raise type_error(f"{c.name} ({c.kind}) does not take {v.kind}")
    if c.kind == "C":
        return F.when(F.length(v.value) > c.max_length, F.raise_error(F.lit(f"Type Error: {c.name} holds {c.max_length} characters at most"))).otherwise(v.value)
    return v.value


def _number(c: ColumnDef, v: Val) -> Column:
    if c.kind == "F":
        return v.double()
    places = {"I": 0, "D": 18, "U": 2}[c.kind]
    target = SPARK[c.kind] if c.kind != "I" else "decimal(38,0)"
    wrong = F.raise_error(F.lit(f"Type Error: a value does not fit {c.name} exactly")).cast(target)
    if v.kind == "F":
        near = v.value.cast(f"decimal(38,{places})")
        return F.when(near.cast("double") == v.value, near.cast(target)).when(v.value.isNotNull(), wrong).cast(SPARK[c.kind])
    x = v.value.cast("decimal(20,0)") if v.kind == "I" else v.value
    if v.per is None:
        near = F.round(x, places)
        return F.when(near == x, near.cast(target)).when(x.isNotNull(), wrong).cast(SPARK[c.kind])
    units = x * F.lit(Decimal(10**places))
    rest = units % v.per
    exact = (units / v.per).cast("decimal(38,0)")
    return F.when(rest == 0, (exact.cast("decimal(38,0)") / F.lit(Decimal(10**places))).cast(target)).when(rest.isNotNull(), wrong).cast(SPARK[c.kind])


_STATEMENTS = {
    n.CreateTable: Session._create_table, n.Insert: Session._insert, n.Update: Session._update, n.Delete: Session._delete, n.AddColumn: Session._add_column,
    n.DropColumn: Session._drop_column, n.DropTable: Session._drop_table, n.CreateView: Session._create_view,
}
