"""Counts and checksums of tables and folders, and what changed between two of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """60 bits of the md5 of a row's JSON, NULLs included."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum): a sum of row hashes, whatever the order."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_hash(df.columns)), F.lit(0)).cast("string").alias("checksum"))


#: Rows in order are the digits of a number in this base, modulo a prime of 127 bits; so parts can be joined.
_PRIME, _BASE = (1 << 127) - 1, 0x3C6EF372FE94F82BA54FF53A5F1D36F1


def ordered_checksum(df: DataFrame, order: list[str]) -> tuple[int, str]:
    """(rows, checksum) in an order, ties by content: the same however the rows are dealt to tasks.

    Each range of the order is folded as it streams by, in constant memory, and gives one row.
    """
    row = F.unhex(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))
    ranged = df.select(*order, row.alias("_h")).repartitionByRange(*order, "_h").sortWithinPartitions(*order, "_h")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for b in batches:
            for h in b.column(0).to_pylist():
                total = (total * _BASE + int.from_bytes(h, "big")) % _PRIME
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([f"{total:x}"])], ["n", "total"])

    numbered = ranged.select("_h").mapInArrow(fold, "n long, total string").select(F.spark_partition_id().alias("p"), "n", "total")
    rows, total = 0, 0
    for r in sorted(numbered.collect()):  # a row a task
        rows, total = rows + r["n"], (total * pow(_BASE, r["n"], _PRIME) + int(r["total"], 16)) % _PRIME
    return rows, hashlib.sha256(f"{rows}:{total:x}".encode()).hexdigest()


def folder_items(files: DataFrame) -> DataFrame:
    """(item, rows, checksum) of files (path, type "f"/"d", size, sha): a row for each top folder or file.

    A digest covers the lines type, path, size, sha in path order. If everything lies under one folder,
    items are the level below it. Of a path given twice the later one counts (``nth``, if there).
    """
    if "nth" in files.columns:
        files = files.groupBy("path").agg(F.max_by(F.struct("type", "size", "sha"), "nth").alias("e")).select("path", "e.*")
    top = F.split("path", "/", 2)[0]
    tops = files.agg(F.min(top).alias("low"), F.max(top).alias("high"), F.max(F.col("path").contains("/").cast("int")).alias("deep")).first()
    level = 2 if tops["low"] is not None and tops["low"] == tops["high"] and tops["deep"] else 1
    if level == 2:
        files = files.where(F.col("path").contains("/") | (F.col("type") != "d"))
    item = F.array_join(F.slice(F.split("path", "/"), 1, level), "/")
    line = F.concat_ws("\t", "type", "path", F.col("size").cast("string"), "sha")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row an item; its lines come in order and are hashed as they pass."""
        item, n, digest = None, 0, None
        out: list[tuple[str, int, str]] = []
        for b in batches:
            for i, kind, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if digest is None or i != item:
                    if digest is not None:
                        out.append((item, n, digest.hexdigest()))
                    item, n, digest = i, 0, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode())
                n += kind != "d"
        if digest is not None:
            out.append((item, n, digest.hexdigest()))
        cells = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int64(), pa.string()), strict=True)], ["item", "rows", "checksum"])

    sorted_ = files.select(item.alias("item"), "path", "type", line.alias("line")).repartition("item").sortWithinPartitions("item", "path")
    return sorted_.select("item", "type", "line").mapInArrow(fold, "item string, rows long, checksum string")


def changes(current: DataFrame, base: DataFrame, max_shrink: float = 5.0) -> DataFrame:
    """(item, rows, previous, change) of a full outer match by item; change: same, changed, new, gone or shrank.

    Both have (item, rows, checksum). An item shrank when its rows fell under (1 - max_shrink / 100) of before.
    """
    c = current.select("item", F.col("rows").alias("rows"), F.col("checksum").alias("_now"), F.lit(True).alias("_here"))
    b = base.select("item", F.col("rows").alias("previous"), F.col("checksum").alias("_then"), F.lit(True).alias("_there"))
    change = (
        F.when(F.col("_here").isNull(), "gone").when(F.col("_there").isNull(), "new")
        .when((F.col("previous") > 0) & (F.col("rows") < F.col("previous") * (1 - max_shrink / 100)), "shrank")
        .when(F.col("_now") == F.col("_then"), "same").otherwise("changed")
    )
    return c.join(b, "item", "full_outer").select("item", "rows", "previous", change.alias("change"))


def verdict(changed: DataFrame) -> DataFrame:
    """One row (verdict, alerts, items): ALERT when an item is gone or shrank, or nothing is there."""
    bad = F.sum(F.col("change").isin("gone", "shrank").cast("long"))
    here = F.sum((F.col("change") != "gone").cast("long"))
    out = changed.agg(F.coalesce(bad, F.lit(0)).alias("alerts"), F.coalesce(here, F.lit(0)).alias("items"))
    return out.select(F.when((F.col("alerts") > 0) | (F.col("items") == 0), "ALERT").otherwise("PASSED").alias("verdict"), "alerts", "items")


def index_faults(index: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """(fault, n): entries without a row, rows without an entry, and the difference of the counts."""
    lost, bare = index.join(table, key, "left_anti"), table.join(index, key, "left_anti")
    one = lambda df, name: df.agg(F.lit(name).alias("fault"), F.count(F.lit(1)).alias("n"))
    return one(lost, "entry without a row").unionByName(one(bare, "row without an entry"))
