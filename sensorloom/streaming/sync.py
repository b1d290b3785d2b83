"""Ingestion of device batches, each record exactly once, with gap detection.

Batches are rows (device, after_seq, payload). ``accept`` decides per device, in the order of
(after_seq, arrival), which records are new: a batch past the device's position is a GAP and changes
nothing, records at or before it are skipped, damage ends a batch but keeps what came before. It runs as
a cogroup of batches and positions, so devices spread over the cluster; only verdicts and decoded
records leave it. ``Gateway.apply`` routes the records to tables and stores the positions in the same
commit; ``Gateway.stream`` does that for each micro-batch, and a micro-batch that is replayed after a
failure is known by its number and skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CorruptError, GapError, SchemaError
from ..session import Engine, parse_schema
from ..sources.recordlog import DEL, PUT, ROW, SERIES_KEY, decode, unpack_row
from ..types import SPARK, ColumnDef

BATCH = "device long, after_seq long, payload binary"
#: what: record, verdict. Records: seq, kind, key, value, series. Verdicts: status OK, GAP or CORRUPT, seq the position.
OUT = "device long, what string, status string, seq long, kind int, key binary, value binary, series int"
POSITIONS, SERIES = "_positions", "_series"


def accept(batches: DataFrame, positions: DataFrame) -> DataFrame:
    """Records to apply and a verdict for each batch, as rows of ``OUT``; ``positions`` is (device, last_seq)."""

    def run(key, new: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        last = int(at["last_seq"].max()) if len(at) else 0
        out = []
        order = [c for c in ("after_seq", "arrival") if c in new.columns]
        for after, payload in new.sort_values(order, kind="stable")[["after_seq", "payload"]].itertuples(index=False):
            if after > last:
                out.append((key[0], "verdict", "GAP", last, 0, None, None, 0))
                continue
            status = "OK"
            try:
                for r in decode(bytes(payload)):
                    if r.seq > last:
                        out.append((key[0], "record", "", r.seq, r.kind, r.key, r.value, r.series))
                        last = r.seq
            except CorruptError:
                status = "CORRUPT"
            out.append((key[0], "verdict", status, last, 0, None, None, 0))
        return pd.DataFrame(out, columns=["device", "what", "status", "seq", "kind", "key", "value", "series"])

    return batches.groupBy("device").cogroup(positions.groupBy("device")).applyInPandas(run, OUT)


class Gateway:
    """Synced tables of an engine: one a series name, keyed (device, time, seq), and ``kv`` keyed (device, key)."""

    def __init__(self, engine: Engine):
        self.engine, self.store, self.spark = engine, engine.store, engine.spark

    def _system(self, name: str, columns: list[tuple[str, str]], key: list[str]):
        if name not in self.store.state["tables"]:
            self.store.create_table(name, [ColumnDef(n, t) for n, t in columns], key, synced=True)
        return self.store.table(name)

    def positions(self) -> DataFrame:
        """(device, last_seq) of all devices."""
        if POSITIONS not in self.store.state["tables"]:
            return self.spark.createDataFrame([], "device long, last_seq long")
        return self.store.rows(self.store.table(POSITIONS))

    def position(self, device: int) -> int:
        r = self.positions().where(F.col("device") == device).first()
        return r["last_seq"] if r else 0

    def apply(self, device: int, after_seq: int, payload: bytes) -> int:
        """Apply one batch; the device's position. GapError and CorruptError carry it as ``last_seq``."""
        df = self.spark.createDataFrame([(device, after_seq, bytearray(payload))], BATCH)
        verdict = self.apply_all(df).first()
        if verdict["status"] != "OK":
            error = GapError if verdict["status"] == "GAP" else CorruptError
            e = error("records are missing before this batch; resend after last_seq" if verdict["status"] == "GAP" else "a record of the batch is broken; those up to last_seq are stored")
            e.last_seq = verdict["seq"]
            raise e
        return verdict["seq"]

    def apply_all(self, batches: DataFrame, batch_id: tuple[str, int] | None = None) -> DataFrame:
        """Apply batches (device, after_seq, payload[, arrival]) in one commit; (device, status, seq) of each.

        A row of an unknown series or a series whose layout differs from its table refuses everything. What
        ``accept`` decides is written once, in the store's own folders, and read from there.
        """
        inbox = f"{self.store.root}/data/_inbox/{uuid.uuid4().hex}"

        def run() -> bool:
            if batch_id is not None:
                if self.store.state["batches"].get(batch_id[0], -1) >= batch_id[1]:
                    return False
                self.store.state["batches"][batch_id[0]] = batch_id[1]
            accept(batches, self.positions()).write.parquet(inbox)
            self._route(self.spark.read.schema(OUT).parquet(inbox).where("what = 'record'"))
            return True

        if not self.store.statement(run):
            return self.spark.createDataFrame([], "device long, status string, seq long")
        return self.spark.read.schema(OUT).parquet(inbox).where("what = 'verdict'").select("device", "status", "seq")

    def _route(self, records: DataFrame) -> None:
        # which kinds of records there are: three numbers
        named = F.col("key").startswith(F.lit(bytearray(SERIES_KEY)))
        own = F.col("key").startswith(F.lit(bytearray(b"\x01")))
        some = lambda c: F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False))
        defines, rows, pairs = records.agg(some((F.col("kind") == PUT) & named), some(F.col("kind") == ROW), some(F.col("kind").isin(PUT, DEL) & ~own)).first()
        if defines:
            self._define(records.where((F.col("kind") == PUT) & named))
        if rows:
            self._rows(records.where(F.col("kind") == ROW).select("device", "seq", "series", "value"))
        if pairs:
            self._pairs(records.where(F.col("kind").isin(PUT, DEL) & ~own))
        moved = records.groupBy("device").agg(F.max("seq").alias("last_seq"))
        if defines or rows or pairs:
            t = self._system(POSITIONS, [("device", "long"), ("last_seq", "long")], ["device"])
            self.store.upsert(t, moved, check=False)

    def _define(self, definitions: DataFrame) -> None:
        """All definitions of a batch of batches: a table for each new name, one write of who calls it by which number."""
        byte = lambda i: F.conv(F.hex(F.substring("value", i, 1)), 16, 10).cast("int")
        text = lambda c, i: F.decode(F.expr(f"substring({c}, {i})"), "UTF-8")
        told = definitions.select("device", "seq", (byte(1) + 256 * byte(2)).alias("series"), text("key", 3).alias("name"), text("value", 3).alias("layout"))
        layouts: dict[str, list] = {}
        for r in told.select("name", "layout").distinct().collect():  # a row a series name, if devices agree
            layouts.setdefault(r["name"], []).append(parse_schema(r["layout"]))
        for name, found in layouts.items():
            for own in found:
                self._table_of(name, own)
        t = self._system(SERIES, [("device", "long"), ("series", "int"), ("name", "text")], ["device", "series"])
        newest = told.groupBy("device", "series").agg(F.max_by("name", "seq").alias("name"))
        self.store.upsert(t, newest, check=False)

    def _table_of(self, name: str, own: list[ColumnDef]) -> None:
        if {c.name.lower() for c in own} & {"device", "seq"} or len(name) > 31:
            raise SchemaError(f"series {name} needs a shorter name, or columns other than device and seq")
        columns = [ColumnDef("device", "long"), ColumnDef("seq", "long"), *own]
        if name not in self.store.state["tables"]:
            self.store.create_table(name, columns, ["device", own[0].name, "seq"], synced=True)
            return
        t = self.store.table(name)
        if not t.synced or t.kv or [(c.name.lower(), c.type) for c in t.columns] != [(c.name.lower(), c.type) for c in columns]:
            raise SchemaError(f"series {name} is defined with two layouts")

    def _rows(self, rows: DataFrame) -> None:
        if SERIES not in self.store.state["tables"]:
            raise SchemaError("rows came before any definition of their series")
        named = rows.join(self.store.rows(self.store.table(SERIES)), ["device", "series"], "left")
        names = [r["name"] for r in named.select("name").distinct().collect()]  # a row a series
        if None in names:
            raise SchemaError("rows came before the definition of their series")
        for name in names:
            t = self.store.table(name)
            own = t.columns[2:]

            def unpack(batches: Iterator[pd.DataFrame], own=own, names=t.schema.names) -> Iterator[pd.DataFrame]:
                for b in batches:
                    cells = [unpack_row(own, bytes(v)) for v in b["value"]]
                    yield pd.DataFrame([(d, s, *c) for d, s, c in zip(b["device"], b["seq"], cells, strict=True)], columns=names)

            schema = ", ".join(f"`{c.name}` {SPARK[c.type].simpleString()}" for c in t.columns)
            df = named.where(F.col("name") == name).select("device", "seq", "value").mapInPandas(unpack, schema)
            self.store.append(t, df)  # sequence numbers are new, so are the keys: nothing stored is read

    def _pairs(self, pairs: DataFrame) -> None:
        name = "kv"
        if name not in self.store.state["tables"]:
            self.store.create_table(name, [ColumnDef("device", "long"), ColumnDef("key", "text"), ColumnDef("value", "text")], ["device", "key"], synced=True, kv=True)
        t = self.store.table(name)
        if not t.kv:
            raise SchemaError("kv is needed for the pairs of devices, but is another table")
        newest = pairs.groupBy("device", "key").agg(F.max_by(F.struct("kind", "value"), "seq").alias("e"))
        newest = newest.select("device", F.col("key").cast("string").alias("key"), F.col("e.kind").alias("kind"), F.col("e.value").cast("string").alias("value"))
        self.store.delete_keys(t, newest.where(F.col("kind") == DEL).select("device", "key"))
        self.store.upsert(t, newest.where(F.col("kind") == PUT).select("device", "key", "value"), check=False)

    def stream(self, batches: DataFrame, checkpoint: str, name: str = "sync", available_now: bool = True):
        """A streaming query that applies micro-batches of (device, after_seq, payload[, arrival])."""
        writer = batches.writeStream.foreachBatch(lambda df, i: self.apply_all(df, (name, i)) and None).option("checkpointLocation", checkpoint).queryName(name)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


class Replica:
    """One device's records applied in order, repeats skipped; no gap detection."""

    def __init__(self, gateway: Gateway, device: int = 0):
        self.gateway, self.device = gateway, device

    def apply(self, payload: bytes) -> int:
        return self.gateway.apply(self.device, self.gateway.position(self.device), payload)
