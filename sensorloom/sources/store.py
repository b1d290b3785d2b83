"""Tables as immutable Parquet files under one manifest a version.

A commit is one new manifest that names every table's files, so readers see all of a transaction or
nothing of it. Changes rewrite only the files that hold a changed row. Statements work on a copy of the
manifest: dropping the copy undoes them. Files that no manifest names are removed by ``vacuum``.

The manifest keeps each file's rows and its columns' least and greatest values, so reads and writes open only
files that can hold what they look for: a write compares its keys with the old files whose ranges they
fall in, and appended times meet none. An index is segments of entries (indexed values, key, file), sorted by
the indexed values, one for each write and merged when there are many; entries of files since replaced are
passed over. A lookup reads the entries that fit, then the data files they name.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from ..errors import BusyError, ExistsError, FailedError, MisuseError, SchemaError
from ..operators.compare import index_faults
from ..plans.access import Range, Way
from ..types import SPARK, ColumnDef
from .files import Files

MAX_INDEXES, MAX_DIRECT_COLUMNS = 8, 24
#: Hidden columns of tables without a key: the version that brought a row, and its place in it.
ROWID = ["_txn", "_n"]
#: Segments of an index before they are merged into one.
MAX_SEGMENTS = 16
EMPTY = {"version": 0, "tables": {}, "buckets": {}, "batches": {}}


class TableDef:
    """A view of one table's entry in the manifest."""

    def __init__(self, name: str, entry: dict):
        self.name, self.entry = name, entry
        self.columns = [ColumnDef(n, t) for n, t in entry["columns"]]
        self.key: list[str] = entry["key"]
        self.rowid: bool = entry["rowid"]
        self.synced: bool = entry["synced"]
        self.kv: bool = entry["kv"]
        self.indexes: dict[str, dict] = entry["indexes"]

    @property
    def schema(self) -> T.StructType:
        out = T.StructType([T.StructField(c.name, SPARK[c.type]) for c in self.columns])
        for h in ROWID * self.rowid:
            out = out.add(h, T.LongType())
        return out

    @property
    def order(self) -> list[str]:
        """Columns that put rows in scan order."""
        return self.key + ROWID * self.rowid

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SchemaError(f"no such column: {name}")


class Store:
    def __init__(self, spark: SparkSession, root: str, break_lock: bool = False):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.owner = uuid.uuid4().hex
        if break_lock:
            self.files.delete(f"{self.root}/_lock")
        if not self.files.write_new(f"{self.root}/_lock", self.owner.encode()):
            raise BusyError("another process has this store open")
        names = [n for n in self.files.names(f"{self.root}/_manifest") if n.endswith(".json")]
        self.committed = json.loads(self.files.read(f"{self.root}/_manifest/{names[-1]}")) if names else copy.deepcopy(EMPTY)
        self.working: dict | None = None
        self.read_only = self.failed = False

    def close(self) -> None:
        self.working = None
        if self.files.exists(f"{self.root}/_lock") and self.files.read(f"{self.root}/_lock").decode() == self.owner:
            self.files.delete(f"{self.root}/_lock")

    # -- transactions

    @property
    def state(self) -> dict:
        return self.working if self.working is not None else self.committed

    def begin(self, write: bool = True) -> None:
        if self.working is not None:
            raise MisuseError("finish the open transaction first")
        self.working, self.read_only, self.failed = copy.deepcopy(self.committed), not write, False

    def commit(self) -> None:
        if self.working is None:
            raise MisuseError("begin a transaction first")
        if self.failed:
            raise FailedError("an earlier commit of this transaction did not go through; roll it back")
        if self.working != self.committed:
            new = self.working | {"version": self.committed["version"] + 1}
            if not self.files.write_new(f"{self.root}/_manifest/{new['version']:012d}.json", json.dumps(new).encode()):
                self.failed = True
                raise BusyError("the store has moved on to a newer version")
            self.committed = new
        self.working = None

    def rollback(self) -> None:
        if self.working is None:
            raise MisuseError("begin a transaction first")
        self.working, self.failed = None, False

    def statement(self, run):
        """Run a change: in its own transaction, or as a savepoint of the open one."""
        if self.failed:
            raise FailedError("an earlier commit of this transaction did not go through; roll it back")
        if self.read_only and self.working is not None:
            raise MisuseError("this transaction was begun for reading")
        own = self.working is None
        if own:
            self.begin()
        before = copy.deepcopy(self.working)
        try:
            out = run()
        except BaseException:
            self.working = None if own else before
            raise
        if own:
            try:
                self.commit()
            except BaseException:
                self.working = None
                raise
        return out

    # -- catalog

    def names(self) -> set[str]:
        return {*self.state["tables"], *(i for t in self.state["tables"].values() for i in t["indexes"])}

    def table(self, name: str) -> TableDef:
        entry = self.state["tables"].get(name)
        if entry is None:
            if any(name in t["indexes"] for t in self.state["tables"].values()):
                raise MisuseError(f"{name} is an index")
            raise SchemaError(f"no such table: {name}")
        return TableDef(name, entry)

    def create_table(self, name: str, columns: list[ColumnDef], key: list[str], synced: bool = False, kv: bool = False) -> TableDef:
        if not columns:
            raise SchemaError("a table needs columns")
        if len(columns) > MAX_DIRECT_COLUMNS:
            raise SchemaError(f"tables have up to {MAX_DIRECT_COLUMNS} columns")
        if name in self.names():
            raise ExistsError(f"{name} already names a table or an index")
        known = {c.name for c in columns}
        for k in key:
            if k not in known:
                raise SchemaError(f"no such column: {k}")
        self.state["tables"][name] = {"columns": [[c.name, c.type] for c in columns], "key": key or [columns[0].name], "rowid": not key, "synced": synced, "kv": kv, "indexes": {}, "files": [], "stats": {}, "rows": 0}
        return self.table(name)

    def create_index(self, name: str, table: str, columns: list[str], unique: bool) -> None:
        t = self.table(table)
        if name in self.names():
            raise ExistsError(f"{name} already names a table or an index")
        if not 1 <= len(columns) <= 4:
            raise SchemaError("an index has 1 to 4 columns")
        if len(t.indexes) >= MAX_INDEXES:
            raise SchemaError(f"a table has up to {MAX_INDEXES} indexes")
        if unique and t.synced:
            raise MisuseError("UNIQUE cannot hold on a table that devices fill")
        own = [t.column(c).name for c in columns]
        if len({*own}) < len(own):
            raise SchemaError("an index lists each column once")
        if unique and self._repeated(self.rows(t), own):
            raise ExistsError(f"{name} cannot be UNIQUE: {table} repeats a value")
        t.indexes[name] = {"columns": own, "unique": unique, "segments": []}
        if t.entry["files"]:
            t.indexes[name]["segments"].append(self._segment(t, own, t.entry["files"]))

    def drop_index(self, name: str) -> bool:
        for t in self.state["tables"].values():
            if t["indexes"].pop(name, None):
                return True
        return False

    # -- rows

    def rows(self, t: TableDef, files: list[str] | None = None) -> DataFrame:
        files = t.entry["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], t.schema)
        return self.spark.read.schema(t.schema).parquet(*[f"{self.root}/{f}" for f in files])

    def write(self, t: TableDef, df: DataFrame) -> dict[str, list]:
        """Write rows as files sorted by key; what ``_measure`` says of them, by name under the root."""
        folder = f"data/{t.name}/{uuid.uuid4().hex}"
        df.select(*t.schema.names).repartitionByRange(*t.order).sortWithinPartitions(*t.order).write.parquet(f"{self.root}/{folder}")
        return self._measure(folder, t.schema, [c.name for c in t.columns])

    def _measure(self, folder: str, schema: T.StructType, columns: list[str]) -> dict[str, list]:
        """[rows, {column: [least, greatest]}] of each file of a folder; files without rows are left out."""
        ends = [F.array(F.min(c), F.max(c)).alias(f"c{i}") for i, c in enumerate(columns)]
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        found = rows.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("f").collect()  # a row a file
        return {f"{folder}/{r['f'].rsplit('/', 1)[1]}": [r["n"], {c: r[f"c{i}"] for i, c in enumerate(columns)}] for r in found}

    @staticmethod
    def _fitting(stats: dict[str, list], ranges: dict[str, Range]) -> list[str]:
        """The files that can hold a row within all ``ranges``."""
        return [f for f, (_, ends) in stats.items() if all(r.meets(*ends[c]) for c, r in ranges.items() if c in ends)]

    @staticmethod
    def _box(stats: dict[str, list], columns: list[str]) -> dict[str, Range]:
        """The least range of each column that holds all of some files."""
        return {c: Range(min(e[c][0] for _, e in stats.values()), max(e[c][1] for _, e in stats.values())) for c in columns} if stats else {}

    def _put(self, t: TableDef, gone: Iterable[str], new: dict[str, list]) -> None:
        """Take files out of a table and others in, its indexes along with it."""
        gone = {*gone}
        t.entry["files"] = [f for f in t.entry["files"] if f not in gone] + [*new]
        t.entry["stats"] = {f: x for f, x in t.entry["stats"].items() if f not in gone} | new
        for index in t.indexes.values():
            live = [x | {"covers": [f for f in x["covers"] if f not in gone], "stale": x["stale"] or not gone.isdisjoint(x["covers"])} for x in index["segments"]]
            live = [x for x in live if x["covers"]]
            if len(live) >= MAX_SEGMENTS:
                live = [self._segment(t, index["columns"], t.entry["files"])]
            elif new:
                live.append(self._segment(t, index["columns"], [*new]))
            index["segments"] = live

    # -- indexes

    def _entry_schema(self, t: TableDef, columns: list[str]) -> T.StructType:
        return T.StructType([t.schema[c] for c in dict.fromkeys([*columns, *t.order])]).add("_file", T.StringType())

    def _segment(self, t: TableDef, columns: list[str], files: list[str]) -> dict:
        """Write the index entries of some data files."""
        folder, schema = f"data/{t.name}/index-{uuid.uuid4().hex}", self._entry_schema(t, columns)
        tail = F.element_at(F.split(F.input_file_name(), "/"), -1)
        folder_of = F.element_at(F.split(F.input_file_name(), "/"), -2)
        rows = self.rows(t, files).select(*schema.names[:-1], F.concat(F.lit(f"data/{t.name}/"), folder_of, F.lit("/"), tail).alias("_file"))
        rows.repartitionByRange(*schema.names[:-1]).sortWithinPartitions(*schema.names[:-1]).write.parquet(f"{self.root}/{folder}")
        return {"files": self._measure(folder, schema, columns), "covers": [*files], "stale": False}

    def entries(self, t: TableDef, name: str, ranges: dict[str, Range] | None = None) -> DataFrame:
        """The live entries (indexed columns, key, _file) of an index, of values within ``ranges``."""
        index = t.indexes[name]
        schema, ranges = self._entry_schema(t, index["columns"]), {c: r for c, r in (ranges or {}).items() if c in index["columns"]}
        out = self.spark.createDataFrame([], schema)
        for x in index["segments"]:
            if files := self._fitting(x["files"], ranges):
                part = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files])
                out = out.unionByName(part.where(F.col("_file").isin(x["covers"])) if x["stale"] else part)
        for c, r in ranges.items():
            out = out.where(within(c, r))
        return out

    def files_on(self, t: TableDef, way: Way, ranges: dict[str, Range]) -> list[str]:
        """The data files that a way leaves to be read."""
        files = self._fitting(t.entry["stats"], ranges)
        if way.index is None or len(files) < 2:
            return files
        named = {r["_file"] for r in self.entries(t, way.index, ranges).select("_file").distinct().collect()}  # a row a file
        return [f for f in files if f in named]

    def index_faults(self, name: str) -> dict[str, dict[str, int]]:
        """For each index of a table how many entries have no row and how many rows no entry."""
        t = self.table(name)
        out = {}
        for i, index in t.indexes.items():
            both = [*dict.fromkeys([*index["columns"], *t.order])]
            found = index_faults(self.entries(t, i).select(*both), self.rows(t).select(*both), both)
            out[i] = {r["fault"]: r["n"] for r in found.collect()}  # two rows
        return out

    # -- changes

    def stamp(self, t: TableDef, df: DataFrame) -> DataFrame:
        """Give rows of a table without a key their hidden numbers, in their order."""
        if not t.rowid:
            return df
        return df.withColumns({"_txn": F.lit(self.state["version"] + 1).cast("long"), "_n": F.monotonically_increasing_id() + F.lit(t.entry["rows"])})

    @staticmethod
    def _repeated(df: DataFrame, columns: list[str]) -> bool:
        return bool(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count())

    def _refuse_repeats(self, t: TableDef, new: dict[str, list], key: bool = True, only: set[str] | None = None) -> None:
        """An error if a row of the files ``new``, already part of the table, shares its key or the values of a
        UNIQUE index with another. Reads the files and entries in whose ranges the new values fall."""
        if not new:
            return
        if key and not t.rowid and (only is None or {*t.key} & only):
            files = self._fitting(t.entry["stats"], self._box(new, t.key))
            if self._repeated(self.rows(t, files), t.key):
                raise ExistsError(f"{t.name} has two rows of one key")
        for name, index in t.indexes.items():
            if index["unique"] and (only is None or {*index["columns"]} & only):
                if self._repeated(self.entries(t, name, self._box(new, index["columns"])), index["columns"]):
                    raise ExistsError(f"UNIQUE index {name} has two rows of one value")

    def touched(self, t: TableDef, where: Column, files: list[str] | None = None) -> list[str]:
        """Those of ``files`` that hold a row for which ``where`` is true."""
        return self._holding(t, self.rows(t, files).where(where).select(F.input_file_name().alias("_f")))

    @staticmethod
    def _holding(t: TableDef, rows: DataFrame) -> list[str]:
        """The table's files that ``rows`` name in ``_f``."""
        tails = {"/".join(r["_f"].rsplit("/", 2)[-2:]) for r in rows.select("_f").distinct().collect()}  # a row a file
        return [f for f in t.entry["files"] if f.split("/", 2)[2] in tails]

    def append(self, t: TableDef, df: DataFrame) -> int:
        """Add rows whose keys are known to be new; reads nothing that is there."""
        new = self.write(t, self.stamp(t, df))
        n = sum(n for n, _ in new.values())
        self._put(t, [], new)
        t.entry["rows"] += n
        return n

    def insert(self, t: TableDef, df: DataFrame) -> int:
        """Add rows of new keys; refuses known keys, keys given twice and values of UNIQUE indexes there are."""
        before = {*t.entry["files"]}
        n = self.append(t, df)
        self._refuse_repeats(t, {f: x for f, x in t.entry["stats"].items() if f not in before})
        return n

    def upsert(self, t: TableDef, df: DataFrame, check: bool = True) -> int:
        """Add rows, each replacing the row of its key; of a key given twice the later row stays."""
        if t.rowid:
            return self.insert(t, df)
        if check:
            others = [c.name for c in t.columns if c.name not in t.key]
            order = "_nth" if "_nth" in df.columns else None
            df = df if order else df.withColumn("_nth", F.monotonically_increasing_id())
            if others:
                last = F.max_by(F.struct(*others), "_nth").alias("_r")
                df = df.groupBy(*t.key).agg(last).select(*t.key, *[F.col(f"_r.{c}").alias(c) for c in others])
            else:
                df = df.select(*t.key).distinct()
        new = self.write(t, df)
        hit, rest = self._without(t, self.rows(t, [*new]).select(*t.key), self._box(new, t.key))
        self._put(t, hit, rest | new)
        if check:
            self._refuse_repeats(t, new, key=False)
        return sum(n for n, _ in new.values())

    def _without(self, t: TableDef, keys: DataFrame, box: dict[str, Range]) -> tuple[list[str], dict[str, list]]:
        """(files that hold a row of ``keys``, what is left of them); only files that meet ``box`` are read."""
        files = self._fitting(t.entry["stats"], box) if box else []
        if not files:
            return [], {}
        hit = self._holding(t, self.rows(t, files).withColumn("_f", F.input_file_name()).join(keys, t.key, "left_semi").select("_f")) if len(files) > 1 else files
        return hit, self.write(t, self.rows(t, hit).join(keys, t.key, "left_anti")) if hit else {}

    def delete_keys(self, t: TableDef, keys: DataFrame) -> int:
        keys = keys.select(*t.key).distinct()
        ends = keys.agg(*[F.array(F.min(k), F.max(k)).alias(k) for k in t.key]).first()
        if ends[t.key[0]][0] is None:
            return 0
        hit, rest = self._without(t, keys, {k: Range(*ends[k]) for k in t.key})
        before = sum(t.entry["stats"][f][0] for f in hit)
        self._put(t, hit, rest)
        return before - sum(n for n, _ in rest.values())

    def delete(self, t: TableDef, where: Column | None, files: list[str] | None = None) -> int:
        if where is None:
            n = sum(n for n, _ in t.entry["stats"].values())
            self._put(t, t.entry["files"], {})
            return n
        where = F.coalesce(where, F.lit(False))
        hit = self.touched(t, where, files)
        rest = self.write(t, self.rows(t, hit).where(~where)) if hit else {}
        n = sum(t.entry["stats"][f][0] for f in hit) - sum(n for n, _ in rest.values())
        self._put(t, hit, rest)
        return n

    def update(self, t: TableDef, values: dict[str, tuple[Column, Column]], where: Column, files: list[str] | None = None) -> int:
        """Set columns to values (what is stored, whether it may not be) in the rows of ``where``; right sides
        see the old row. Keys and UNIQUE values are checked over the whole result, at the end."""
        where = F.coalesce(where, F.lit(False))
        bad = F.lit(False)
        for _, b in values.values():
            bad = bad | F.coalesce(b, F.lit(True))
        n, wrong = self.rows(t, files).where(where).agg(F.count(F.lit(1)), F.sum(bad.cast("int"))).first()
        if wrong:
            raise SchemaError(f"{wrong} rows would end up with values that do not fit")
        if not n:
            return 0
        hit = self.touched(t, where, files)
        rows = self.rows(t, hit)
        changed = rows.select(*[F.when(where, values[c][0]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in t.schema.names])
        new = self.write(t, changed)
        self._put(t, hit, new)
        self._refuse_repeats(t, new, only={*values})
        return n

    def vacuum(self) -> int:
        """Delete data files that the committed manifest doesn't name, and older manifests; the number deleted."""
        if self.working is not None:
            raise MisuseError("finish the open transaction first")
        named = {f.rsplit("/", 1)[0] for t in self.committed["tables"].values() for f in [*t["files"], *(f for i in t["indexes"].values() for x in i["segments"] for f in x["files"])]} | {f.rsplit("/", 1)[0] for b in self.committed["buckets"].values() for f in b["files"]}
        n = 0
        for top in self.files.names(f"{self.root}/data"):
            for folder in self.files.names(f"{self.root}/data/{top}"):
                if f"data/{top}/{folder}" not in named:
                    n += self.files.delete(f"{self.root}/data/{top}/{folder}")
        for name in self.files.names(f"{self.root}/_manifest")[:-1]:
            n += self.files.delete(f"{self.root}/_manifest/{name}")
        return n

    def compact(self, name: str) -> None:
        """Write a table's rows anew, sorted by key over all files."""

        def run():
            t = self.table(name)
            if t.entry["files"]:
                self._put(t, t.entry["files"], self.write(t, self.rows(t)))

        self.statement(run)

    def check(self) -> list[str]:
        """Logical faults of all tables: missing files, NULLs, repeated keys or UNIQUE values."""
        found = []
        for name in self.state["tables"]:
            t = self.table(name)
            wanted: dict[str, set[str]] = {}
            for f in [*t.entry["files"], *(f for i in t.indexes.values() for x in i["segments"] for f in x["files"])]:
                wanted.setdefault(f.rsplit("/", 1)[0], set()).add(f.rsplit("/", 1)[1])
            if gone := [f"{folder}/{n}" for folder, names in wanted.items() for n in sorted(names - {*self.files.names(f"{self.root}/{folder}")})]:
                found += [f"{name}: file {f} is missing" for f in gone]
                continue
            rows = self.rows(t)
            counted = rows.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in t.schema.names]).first().asDict()
            if counted.pop("_rows") != sum(n for n, _ in t.entry["stats"].values()):
                found.append(f"{name}: its files hold other numbers of rows than the manifest says")
            found += [f"{name}: {n} NULLs in {c}" for c, n in counted.items() if n]
            for columns in [t.order if t.rowid else t.key] + [i["columns"] for i in t.indexes.values() if i["unique"]]:
                if self._repeated(rows, columns):
                    found.append(f"{name}: repeated values in {', '.join(columns)}")
            found += [f"{name}: index {i} has {n} times an {fault}" for i, faults in self.index_faults(name).items() for fault, n in faults.items() if n]
        return found


def within(column: str, r: Range) -> Column:
    out = F.lit(True)
    if r.low is not None:
        out = out & (F.col(column) >= F.lit(r.low))
    if r.high is not None:
        out = out & (F.col(column) <= F.lit(r.high))
    return out if r.values is None else out & F.col(column).isin(*r.values)
