"""Readers of backups: SQLite files, tar archives and folders, each as an inventory (item, rows, checksum).

The work on one backup file is one task; many backups are many tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import shutil
import sqlite3
import tarfile
import tempfile
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptError
from ..operators.compare import folder_items

#: Bytes read at a time.
STEP = 1 << 20
ENTRIES = "path string, type string, size long, sha string, nth long"


def guess_kind(head: bytes) -> str:
    """The kind of a backup from its first bytes."""
    if head.startswith(b"SQLite format 3\0"):
        return "sqlite"
    if head.startswith(b"\x1f\x8b"):
        return "gzip"
    if head.startswith(b"PGDMP"):
        return "postgresql"
    if len(head) >= 262 and head[257:262] == b"ustar":
        return "tar"
    text = head[:2048].decode("latin-1")
    if "PostgreSQL database dump" in text:
        return "postgresql"
    if "MySQL dump" in text or "MariaDB dump" in text:
        return "mysql"
    return "unknown"


def inflate_head(data: bytes) -> bytes:
    """What the first bytes of a gzip file hold."""
    try:
        return zlib.decompressobj(31).decompress(data, 65536)
    except zlib.error as e:
        raise CorruptError(f"damaged gzip data: {e}") from None


def whole_pages(path: str) -> None:
    """CorruptError unless a SQLite file is as long as its header says: the integrity check forgives a part of a page."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(100)
    if len(head) < 100:
        raise CorruptError("damaged SQLite file: no header")
    page = int.from_bytes(head[16:18], "big")
    page = 65536 if page == 1 else page  # fixed values of the format
    if page < 512 or page & (page - 1):
        raise CorruptError(f"damaged SQLite file: pages of {page} bytes")
    pages = int.from_bytes(head[28:32], "big") if head[24:28] == head[92:96] else 0  # otherwise written by old versions
    if size % page or pages and size != pages * page:
        raise CorruptError(f"damaged SQLite file: {size} bytes, but {pages or 'whole'} pages of {page}")


def sqlite_items(path: str) -> list[tuple[str, int, str]]:
    """(table, rows, SHA-256 over the rows in key order) of a SQLite file that passes its integrity check."""
    whole_pages(path)
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        if (said := db.execute("PRAGMA integrity_check").fetchone()[0]) != "ok":
            raise CorruptError(f"damaged SQLite file: {said}")
        out = []
        for name, sql in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            quoted = '"' + name.replace('"', '""') + '"'
            keyed = "WITHOUT ROWID" in (sql or "").upper()
            digest, n = hashlib.sha256(), 0
            for row in db.execute(f"SELECT {'' if keyed else 'rowid, '}* FROM {quoted}" + ("" if keyed else " ORDER BY rowid")):
                raw = repr(row).encode()
                digest.update(len(raw).to_bytes(4, "big") + raw)
                n += 1
            out.append((name, n, digest.hexdigest()))
        return out
    except sqlite3.DatabaseError as e:
        raise CorruptError(f"damaged SQLite file: {e}") from None
    finally:
        db.close()


def safe_path(path: str) -> str:
    """A relative path without ``..``; CorruptError for any other."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or ".." in parts:
        raise CorruptError(f"unsafe path in the archive: {path}")
    return "/".join(parts)


def tar_entries(stream: BinaryIO) -> Iterator[tuple[str, str, int, str, int]]:
    """(path, type, size, sha, place) of an archive's entries (ustar, GNU, pax), read once from front to end."""
    try:
        with tarfile.open(fileobj=stream, mode="r|") as tar:
            for i, m in enumerate(tar):
                if not (path := safe_path(m.name)):
                    continue
                if m.isdir():
                    yield path, "d", 0, "", i
                elif m.isreg():
                    digest, n, body = hashlib.sha256(), 0, tar.extractfile(m)
                    while some := body.read(STEP):
                        digest.update(some)
                        n += len(some)
                    if n != m.size:
                        raise CorruptError("the archive is cut short")
                    yield path, "f", m.size, digest.hexdigest(), i
                else:
                    yield path, "l", 0, hashlib.sha256((m.linkname or "").encode()).hexdigest(), i
        while stream.read(STEP):  # so that a gzip file's own checksum is met
            pass
    except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
        raise CorruptError(f"damaged archive: {e}") from None


def opened(content: bytes) -> BinaryIO:
    """What a file holds, unzipped as it is read."""
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if guess_kind(content[:4096]) == "gzip" else raw


def archive_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a tar or tar.gz file, and one of all bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                entries = tar_entries(opened(content))
                while some := list(islice(entries, 10_000)):
                    yield pd.DataFrame(some, columns=["path", "type", "size", "sha", "nth"])

    return _with_total(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ENTRIES))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """Items of a folder's files, and one of all bytes."""
    root = path.rstrip("/").removeprefix("file://") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = F.substring_index("path", root, -1)
    return _with_total(files.select(own.alias("path"), F.lit("f").alias("type"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha"), F.lit(0).cast("long").alias("nth")))


def _with_total(entries: DataFrame) -> DataFrame:
    entries = entries.persist()
    total = entries.where("type = 'f'").agg(F.lit("(total bytes)").alias("item"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows"), F.lit("").alias("checksum"))
    return folder_items(entries).unionByName(total)


def sqlite_file(spark: SparkSession, path: str) -> DataFrame:
    """Items of a SQLite file, gzipped or not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:  # read back by this task alone
                    try:
                        shutil.copyfileobj(opened(content), f, STEP)
                    except (OSError, EOFError, zlib.error) as e:
                        raise CorruptError(f"damaged gzip data: {e}") from None
                    f.flush()
                    yield pd.DataFrame(sqlite_items(f.name), columns=["item", "rows", "checksum"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "item string, rows long, checksum string")


def tables(frames: dict[str, DataFrame]) -> DataFrame:
    """Items of DataFrames by name."""
    from ..operators.compare import checksum

    out = None
    for name, df in frames.items():
        one = checksum(df).select(F.lit(name).alias("item"), "rows", "checksum")
        out = one if out is None else out.unionByName(one)
    return out


def read_head(path: str, n: int = 4096) -> bytes:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return b""
    with open(path, "rb") as f:
        return f.read(n)
