"""The engine: SQL text, prepared statements, transactions, tables, rows, indexes, buckets and key-value pairs."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import ExistsError, MisuseError, NotFoundError, SchemaError, TooBigError
from .plans import syntax as X
from .plans.access import Range, Way, choose, narrow
from .plans.compiler import Compiler, Resolver, Source, resolve_select, run_select
from .plans.constants import evaluate
from .sources.store import Store, TableDef
from .types import SPARK, STATIC, ColumnDef, coerce, format_real, read_column, store_column

MAX_KEY_BYTES = 200
KV_COLUMNS = [ColumnDef("key", "text"), ColumnDef("value", "text")]


class Engine:
    """One handle on a store. ``promote``: whole-number arithmetic on columns gives REAL, exact where it fits."""

    def __init__(self, spark: SparkSession, root: str | None = None, promote: bool = False, break_lock: bool = False):
        self.spark, self.promote = spark, promote
        self.store = Store(spark, root or "file://" + tempfile.mkdtemp(prefix="sensorloom-"), break_lock)
        self.kv, self.series = KeyValue(self), SeriesApi(self)
        self.sql_changed = 0

    def close(self) -> None:
        self.store.close()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- transactions

    def begin(self, write: bool = True) -> None:
        self.store.begin(write)

    def commit(self) -> None:
        self.store.commit()

    def rollback(self) -> None:
        self.store.rollback()

    @contextmanager
    def transaction(self) -> Iterator[Engine]:
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    # -- SQL

    def sql(self, text: str, *params, ordered: bool = False) -> DataFrame | None:
        """Run the statements of ``text``; the rows of the last SELECT."""
        found = self.execute(text, *params, ordered=ordered)
        return found[-1] if found else None

    def execute(self, text: str, *params, ordered: bool = False) -> list[DataFrame]:
        """Run the statements of ``text``; the rows of each SELECT."""
        statements, n = X.parse(text)
        if n != len(params):
            raise MisuseError(f"{n} parameters, {len(params)} values")
        found = [self._run(s, list(params), ordered) for s in statements]
        return [x for x in found if x is not None]

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def explain(self, text: str) -> Row:
        return self.sql(text if text.lstrip()[:7].upper() == "EXPLAIN" else "EXPLAIN " + text).first()

    def _source(self, q: X.Select, params: list) -> tuple[Source, str, str]:
        """(what a SELECT reads, the way it gets there, the way in words)."""
        if q.table is None:
            return Source([], self.spark.range(1), []), "", ""
        if q.table.lower() == "kv" and q.table not in self.store.state["tables"]:
            return Source(KV_COLUMNS, self.kv.items(), ["key"]), "full scan", "kv"
        t = self.store.table(q.table)
        if len(t.columns) > X.MAX_COLUMNS:
            raise SchemaError("SQL reads tables of up to 16 columns")
        way, ranges, files = self._way(t, resolve_select(q, t.columns).where, params)
        told = f"{way.tell(t.name, ranges)}; {len(files)} of {len(t.entry['files'])} files"
        return Source(t.columns, self.store.rows(t, files), t.order), way.kind, told

    def _way(self, t: TableDef, where, params: list) -> tuple[Way, dict[str, Range], list[str]]:
        """(the way to the rows of a resolved WHERE, what it says of columns, the files left to be read)."""
        ranges = narrow(where, t.columns, params)
        way = choose(t, ranges)
        return way, ranges, self.store.files_on(t, way, ranges)

    def _run(self, s, params: list, ordered: bool) -> DataFrame | None:
        match s:
            case X.Select():
                return self._select(s, params, ordered)
            case X.CreateTable(name, columns, key, soft):
                if soft and name in self.store.state["tables"]:
                    return None
                self.store.statement(lambda: self.store.create_table(name, columns, key))
            case X.DropTable(name, soft):
                if soft and name not in self.store.names():
                    return None
                self.sql_changed = self.drop_table(name)
            case X.CreateIndex(name, table, columns, unique, soft):
                if soft and any(name in t["indexes"] for t in self.store.state["tables"].values()):
                    return None
                self.create_index(name, table, columns, unique)
            case X.DropIndex(name, soft):
                if not self.store.statement(lambda: self.store.drop_index(name)) and not soft:
                    raise SchemaError(f"no such index: {name}")
            case X.Insert():
                self.sql_changed = self._insert(s, params)
            case X.Update(table, sets, where):
                self.sql_changed = self.store.statement(lambda: self._update(table, sets, where, params))
            case X.Delete(table, where):
                self.sql_changed = self.store.statement(lambda: self._delete(table, where, params))
        return None

    def _select(self, q: X.Select, params: list, ordered: bool) -> DataFrame:
        source, kind, told = self._source(q, params)
        out = run_select(q, source, params, self.promote, ordered)  # checks the query, runs nothing
        if not q.explain:
            return out
        if q.table is None:
            raise MisuseError("EXPLAIN needs a table")
        return self.spark.createDataFrame([(kind, told)], "plan string, detail string")

    def _own_table(self, name: str) -> TableDef:
        t = self.store.table(name)
        if t.synced:
            raise MisuseError("devices alone write to this table")
        return t

    def _insert(self, s: X.Insert, params: list) -> int:
        if s.table.lower() == "kv" and s.table not in self.store.state["tables"]:
            names = [c.lower() for c in s.columns or ("key", "value")]
            if sorted(names) != ["key", "value"]:
                raise SchemaError("an INSERT names all columns")
            rows = [dict(zip(names, (evaluate(e, params) for e in row), strict=True)) for row in s.rows]
            self.kv.put_all([(r["key"], r["value"]) for r in rows])
            return len(rows)
        t = self._own_table(s.table)
        columns = t.columns
        if s.columns is not None:
            columns = [t.column(c) for c in s.columns]
            if len({c.name for c in columns}) != len(t.columns):
                raise SchemaError("an INSERT names all columns")
        rows = []
        for row in s.rows:
            if len(row) != len(columns):
                raise SchemaError("wrong number of values in a row")
            given = {c.name: coerce(c, evaluate(e, params)) for c, e in zip(columns, row, strict=True)}
            rows.append(tuple(given[c.name] for c in t.columns))
        return Table(self, s.table)._write(rows, "upsert" if s.replace else "insert")

    def _update(self, table: str, sets: list, where, params: list) -> int:
        t = self._own_table(table)
        r, c = Resolver(t.columns), Compiler(t.columns, params, self.promote)
        values = {}
        for name, e in sets:
            column = t.column(name)
            values[column.name] = store_column(column, *c.value(r.checked(e, False)))
        tree = r.checked(where, False) if where is not None else None
        cond = c.truth(tree) if tree is not None else F.lit(True)
        return self.store.update(t, values, cond, self._way(t, tree, params)[2])

    def _delete(self, table: str, where, params: list) -> int:
        t = self.store.table(table)
        if where is None:
            return self.store.delete(t, None)
        tree = Resolver(t.columns).checked(where, False)
        return self.store.delete(t, Compiler(t.columns, params, self.promote).truth(tree), self._way(t, tree, params)[2])

    # -- catalog

    def create_table(self, name: str, columns: Iterable[tuple[str, str]], key: Iterable[str] = ()) -> Table:
        self.store.statement(lambda: self.store.create_table(name, [ColumnDef(n, t) for n, t in columns], list(key)))
        return self.table(name)

    def drop_table(self, name: str) -> int:
        def run() -> int:
            t = self.store.table(name)
            if t.synced:
                raise MisuseError("devices fill this table: DELETE its rows instead")
            n = self.store.rows(t).count()
            del self.store.state["tables"][name]
            return n

        return self.store.statement(run)

    def create_index(self, name: str, table: str, columns: list[str], unique: bool = False) -> None:
        self.store.statement(lambda: self.store.create_index(name, table, columns, unique))

    def drop_index(self, name: str) -> None:
        if not self.store.statement(lambda: self.store.drop_index(name)):
            raise SchemaError(f"no such index: {name}")

    def tables(self) -> DataFrame:
        """(name, columns, key, kind, indexes) of each table."""
        rows = [(t.name, ",".join(f"{c.name}:{c.type}" for c in t.columns), "" if t.rowid else ",".join(t.key), "synced" if t.synced else "table", ",".join(sorted(t.indexes))) for t in map(self.store.table, sorted(self.store.state["tables"]))]
        return self.spark.createDataFrame(rows, "name string, columns string, key string, kind string, indexes string")

    def describe(self, name: str) -> TableDef:
        return self.store.table(name)

    def table(self, name: str) -> Table:
        self.store.table(name)
        return Table(self, name)

    def bucket(self, name: str, create: bool = True) -> Bucket:
        return Bucket(self, name, create)

    def info(self) -> dict:
        s = self.store.state
        return {"version": s["version"], "tables": len(s["tables"]), "buckets": len(s["buckets"]), "in_transaction": self.store.working is not None, "sql_changed": self.sql_changed}

    def check(self) -> list[str]:
        return self.store.check()


class Prepared:
    """One statement with ? parameters, parsed once."""

    def __init__(self, engine: Engine, text: str):
        statements, self.n_params = X.parse(text)
        if len(statements) != 1:
            raise MisuseError("prepare takes one statement")
        self.engine, self.statement = engine, statements[0]
        self.values: list = [None] * self.n_params
        self._rows: Iterator | None = None
        self.columns: list[str] = []
        if isinstance(self.statement, X.Select):  # checked with 0 for every parameter
            self.columns = engine._select(self.statement, [0] * self.n_params, False).columns

    def bind(self, index: int, value) -> Prepared:
        if not 1 <= index <= self.n_params:
            raise MisuseError("no such parameter")
        if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
            raise MisuseError("a parameter cannot be NaN or infinite")
        if isinstance(value, str) and len(value.encode()) > 255:
            raise TooBigError("a parameter's text has up to 255 bytes")
        self.values[index - 1] = value
        return self

    def run(self, *params) -> DataFrame | None:
        for i, v in enumerate(params, 1):
            self.bind(i, v)
        return self.engine._run(self.statement, self.values, True)

    def step(self) -> Row | None:
        """The next row, None at the end."""
        if self._rows is None:
            df = self.run()
            self._rows = iter(()) if df is None else df.toLocalIterator()
        return next(self._rows, None)

    def reset(self) -> None:
        self._rows = None


class Table:
    """Rows by DataFrames or tuples, beside SQL but through the same checks."""

    def __init__(self, engine: Engine, name: str):
        self.engine, self.name = engine, name

    @property
    def definition(self) -> TableDef:
        return self.engine.store.table(self.name)

    def df(self) -> DataFrame:
        """The rows as expressions see them."""
        t = self.definition
        return self._read(self.engine.store.rows(t))

    def _read(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[read_column(c).alias(c.name) for c in self.definition.columns])

    def _write(self, rows, mode: str) -> int:
        engine, store = self.engine, self.engine.store

        def run() -> int:
            t = engine._own_table(self.name)
            return getattr(store, mode)(t, self._frame(t, rows))

        return store.statement(run)

    def _frame(self, t: TableDef, rows) -> DataFrame:
        spark = self.engine.spark
        if not isinstance(rows, DataFrame):
            rows = [tuple(coerce(c, v) for c, v in zip(t.columns, row, strict=True)) for row in rows]
            schema = ", ".join([f"`{c.name}` {SPARK[c.type].simpleString()}" for c in t.columns] + ["_nth long"])
            out = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema).coalesce(1)
            return out
        kinds = {n: {"string": "text", "float": "real", "double": "real"}.get(k, "int") for n, k in rows.dtypes}
        lower = {n.lower(): n for n in rows.columns}
        cells, bad = [], F.lit(False)
        for c in t.columns:
            if c.name.lower() not in lower:
                raise SchemaError(f"no such column: {c.name}")
            own = lower[c.name.lower()]
            value = F.col(own).cast({"text": "string", "real": "double", "int": "bigint"}[kinds[own]])
            stored, wrong = store_column(c, value, kinds[own])
            cells.append(stored.alias(c.name))
            bad = bad | wrong
        wrong = rows.where(bad).limit(1).count()
        if wrong:
            raise SchemaError("a value is NULL, of the wrong type or out of its column's range")
        return rows.select(*cells)

    def insert(self, rows) -> int:
        return self._write(rows, "insert")

    def upsert(self, rows) -> int:
        return self._write(rows, "upsert")

    def delete(self, *key) -> bool:
        """Delete the row of a full key; whether there was one."""
        t = self.engine._own_table(self.name)
        if t.rowid or len(key) != len(t.key):
            raise MisuseError("the full primary key is needed")
        return self.engine.store.statement(lambda: self.engine.store.delete(self.engine._own_table(self.name), *self._match(t.key, key))) > 0

    def _match(self, names: list[str], values: tuple, index: str | None = None) -> tuple[Column, list[str]]:
        """(the rows whose leading columns have these values, the files that can hold some)."""
        t, out, ranges = self.definition, F.lit(True), {}
        if len(values) > len(names):
            raise MisuseError("more values than columns")
        for n, v in zip(names, values, strict=False):
            c = t.column(n)
            if (c.type == "text") != isinstance(v, str):
                raise SchemaError(f"column {n}: a value of another kind")
            out = out & (read_column(c) == F.lit(v))
            ranges.setdefault(c.name, Range()).add("=", v)
        way = Way("index lookup" if index else "range scan", [*ranges], index)
        return out, self.engine.store.files_on(t, way, ranges)

    def get(self, *key) -> Row | None:
        t = self.definition
        if t.rowid or len(key) != len(t.key):
            raise MisuseError("the full primary key is needed")
        match, files = self._match(t.key, key)
        return self._read(self.engine.store.rows(t, files).where(match)).first()

    def prefix(self, *values, reverse: bool = False, limit: int | None = None) -> DataFrame:
        """Rows whose key begins with ``values``, in key order."""
        return self._ordered(self.definition.key, [], values, reverse, limit)

    def last(self, *values) -> Row | None:
        """The last row whose key begins with ``values``."""
        return self.prefix(*values, reverse=True, limit=1).first()

    def _ordered(self, names: list[str], more: list[str], values: tuple, reverse: bool, limit: int | None, index: str | None = None) -> DataFrame:
        t = self.definition
        order = [*names, *(c for c in [*more, *t.order] if c not in names)]
        match, files = self._match(names, values, index)
        rows = self.engine.store.rows(t, files).where(match)
        rows = rows.orderBy(*[F.desc(c) if reverse else F.asc(c) for c in dict.fromkeys(order)])
        return self._read(rows if limit is None else rows.limit(limit))

    def next(self, *key) -> Row | None:
        """The first row whose full key comes after ``key``."""
        return self._beside(key, False)

    def prev(self, *key) -> Row | None:
        """The last row whose full key comes before ``key``."""
        return self._beside(key, True)

    def _beside(self, key: tuple, before: bool) -> Row | None:
        t, store = self.definition, self.engine.store
        if t.rowid or len(key) != len(t.key):
            raise MisuseError("the full primary key is needed")
        own, given = F.struct(*[read_column(t.column(k)).alias(k) for k in t.key]), F.struct(*[F.lit(v).alias(k) for k, v in zip(t.key, key, strict=True)])
        first = Range(high=key[0]) if before else Range(low=key[0])
        rows = store.rows(t, store.files_on(t, Way("range scan", ranged=t.key[0]), {t.key[0]: first})).where(own < given if before else own > given)
        return self._read(rows.orderBy(*[F.desc(k) if before else F.asc(k) for k in t.key]).limit(1)).first()

    def index(self, name: str) -> Index:
        if name not in self.definition.indexes:
            raise SchemaError(f"no such index: {name}")
        return Index(self, name)


class Index:
    def __init__(self, table: Table, name: str):
        self.table, self.name = table, name

    def prefix(self, *values, reverse: bool = False, limit: int | None = None) -> DataFrame:
        """Rows whose indexed values begin with ``values``, in index order, then key order."""
        t = self.table.definition
        return self.table._ordered(t.indexes[self.name]["columns"], t.key, values, reverse, limit, self.name)

    def last(self, *values) -> Row | None:
        return self.prefix(*values, reverse=True, limit=1).first()


class Bucket:
    """An ordered space of byte keys; the newest entry of a key counts. Entries are kept sorted by key."""

    SCHEMA = "k binary, v binary, txn long, n long, gone boolean"

    def __init__(self, engine: Engine, name: str, create: bool):
        self.engine, self.name, self.store = engine, name, engine.store
        if name not in self.store.state["buckets"]:
            if not create:
                raise NotFoundError(f"no such bucket: {name}")
            self.store.statement(lambda: self.store.state["buckets"].setdefault(name, {"files": [], "writes": 0}))

    def _add(self, entries: list[tuple[bytes, bytes | None]]) -> None:
        def run() -> None:
            b = self.store.state["buckets"][self.name]
            rows = [(bytearray(k), None if v is None else bytearray(v), self.store.state["version"] + 1, b["writes"] + i, v is None) for i, (k, v) in enumerate(entries)]
            b["writes"] += len(rows)
            folder = f"data/_bucket_{self.name}/{b['writes']}-{self.store.owner}"
            self.engine.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).sortWithinPartitions("k").write.mode("overwrite").parquet(f"{self.store.root}/{folder}")
            b["files"] = [*b["files"], f"{folder}/"]

        for k, _ in entries:
            if not k or len(k) > 1024:
                raise TooBigError("keys have 1 to 1,024 bytes")
        self.store.statement(run)

    def df(self, key: bytes | None = None) -> DataFrame:
        """(k, v) of the live keys, or of one key."""
        files = self.store.state["buckets"][self.name]["files"]
        spark = self.engine.spark
        rows = spark.read.schema(self.SCHEMA).parquet(*[f"{self.store.root}/{f}" for f in files]) if files else spark.createDataFrame([], self.SCHEMA)
        if key is not None:
            rows = rows.where(F.col("k") == F.lit(bytearray(key)))  # reaches the sorted files before the newest are found
        newest = rows.groupBy("k").agg(F.max_by(F.struct("v", "gone"), F.struct("txn", "n")).alias("e"))
        return newest.where(~F.col("e.gone")).select("k", F.col("e.v").alias("v"))

    def put(self, key: bytes, value: bytes) -> None:
        self._add([(key, value)])

    def put_all(self, entries: Iterable[tuple[bytes, bytes]]) -> None:
        self._add(list(entries))

    def get(self, key: bytes) -> bytes | None:
        r = self.df(key).first()
        return bytes(r["v"]) if r else None

    def delete(self, key: bytes) -> bool:
        if self.get(key) is None:
            return False
        self._add([(key, None)])
        return True

    def seek(self, key: bytes) -> tuple[bytes, bytes] | None:
        """The first entry whose key is ``key`` or comes after it."""
        return self._one(F.col("k") >= F.lit(bytearray(key)), False)

    def next(self, key: bytes) -> tuple[bytes, bytes] | None:
        """The first entry after ``key``."""
        return self._one(F.col("k") > F.lit(bytearray(key)), False)

    def prev(self, key: bytes) -> tuple[bytes, bytes] | None:
        """The last entry before ``key``."""
        return self._one(F.col("k") < F.lit(bytearray(key)), True)

    def last(self) -> tuple[bytes, bytes] | None:
        return self._one(F.lit(True), True)

    def _one(self, where: Column, reverse: bool) -> tuple[bytes, bytes] | None:
        r = self.df().where(where).orderBy(F.desc("k") if reverse else F.asc("k")).limit(1).first()
        return (bytes(r["k"]), bytes(r["v"])) if r else None

    def scan(self, start: bytes | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        """Entries from the first key >= ``start`` on; with ``reverse`` from the last key <= ``start`` down."""
        df = self.df()
        if start is not None:
            df = df.where(F.col("k") <= F.lit(bytearray(start)) if reverse else F.col("k") >= F.lit(bytearray(start)))
        df = df.orderBy(F.desc("k") if reverse else F.asc("k"))
        return df if limit is None else df.limit(limit)


class KeyValue:
    """Text keys of 1 to 200 bytes with text values; ``FROM kv`` reads them."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def _bucket(self) -> Bucket:
        return self.engine.bucket("_kv")

    def put(self, key: str, value) -> None:
        self.put_all([(key, value)])

    def put_all(self, pairs: Iterable[tuple[str, object]]) -> None:
        out = []
        for k, v in pairs:
            if not isinstance(k, str) or v is None:
                raise SchemaError("keys are text, values text or numbers")
            if not 1 <= len(k.encode()) <= MAX_KEY_BYTES:
                raise TooBigError("keys have 1 to 200 bytes")
            text = v if isinstance(v, str) else str(v) if isinstance(v, int) else format_real(v)
            if len(text.encode()) > 65_535:
                raise TooBigError("values have up to 65,535 bytes")
            out.append((k.encode(), text.encode()))
        self._bucket().put_all(out)

    def get(self, key: str) -> str | None:
        v = self._bucket().get(key.encode())
        return None if v is None else v.decode()

    def delete(self, key: str) -> bool:
        return self._bucket().delete(key.encode())

    def items(self) -> DataFrame:
        """(key, value) of the live keys."""
        if "_kv" not in self.engine.store.state["buckets"]:
            return self.engine.spark.createDataFrame([], "key string, value string")
        return self._bucket().df().select(F.col("k").cast("string").alias("key"), F.col("v").cast("string").alias("value"))


class SeriesApi:
    """Time series: tables without a key whose first column is their time."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def create(self, name: str, schema: str) -> None:
        """``schema``: "time:time, temp:float, ..."."""
        columns = parse_schema(schema)
        if name in self.engine.store.names():
            raise ExistsError(f"series exists: {name}")
        self.engine.store.statement(lambda: self.engine.store.create_table(name, columns, []))

    def append(self, name: str, rows) -> int:
        return self.engine.table(name).insert(rows)

    def scan(self, name: str, start: int, end: int) -> DataFrame:
        """Rows whose time lies in [start, end], in the order they came."""
        t = self.engine.describe(name)
        rows = self.engine.store.rows(t).where(F.col(t.columns[0].name).between(start, end)).orderBy("_txn", "_n")
        return self.engine.table(name)._read(rows)

    def window(self, name: str, column: str, since: int) -> Row:
        """count, min, max, sum, avg, first and last time of a numeric column over time >= since."""
        from .operators.timeseries import trailing_stats

        t = self.engine.describe(name)
        c = t.column(column)
        if STATIC[c.type] == "text":
            raise SchemaError(f"column {column} isn't numeric")
        rows = self.engine.store.rows(t).select(F.col(t.columns[0].name).alias("time"), read_column(c).cast("double").alias("value"), F.struct("_txn", "_n").alias("seq"))
        return trailing_stats(rows, "time", "value", since, "seq").first()

    def list(self) -> list[str]:
        tables = map(self.engine.store.table, sorted(self.engine.store.state["tables"]))
        return [t.name for t in tables if t.rowid and t.columns[0].type == "time"]


def parse_schema(text: str) -> list[ColumnDef]:
    """The columns of a schema text; the first, and only the first, is of type time."""
    columns = []
    for part in text.split(","):
        name, _, kind = part.strip().partition(":")
        if kind not in SPARK or not name.isidentifier() or len(name) > 23:
            raise SchemaError(f"cannot read the schema at {part.strip()}")
        columns.append(ColumnDef(name, kind))
    if len(text.encode()) > 255 or len(columns) > X.MAX_COLUMNS:
        raise SchemaError("a schema has up to 255 bytes and 16 columns")
    if columns[0].type != "time" or any(c.type == "time" for c in columns[1:]):
        raise SchemaError("the first column, and only it, must be time")
    if len({c.name.lower() for c in columns}) != len(columns):
        raise SchemaError("a column is named twice")
    return columns
