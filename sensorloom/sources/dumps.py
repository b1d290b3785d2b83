"""Rows of text dumps (COPY blocks and INSERT statements), counted and summed without a server.

The file is read by Spark's line reader, so a plain one is split over tasks and a gzipped one streams through
one; nothing is held but a line. A task can't know whether its part begins inside a COPY block. So it folds
its lines to sections, cut at the lines that end a block, and counts its first section both ways: as rows all
through, and as rows from the section's first COPY line on. A section is one row, so what reaches the driver
grows with the dump's tables and the parts of its file, and the driver picks for each the count that holds.

Checksums are sums of hashes of the rows' text, whatever their order. Defined results: a block without an end
and a dump without its closing line are damaged; a client command outside the blocks, other than those that
choose the database or restrict the client, is refused; so is an INSERT that goes on in the next line, since its rows
can't be told from text. What lies outside the blocks is read by lines: a function's body with a line that looks
like the start of a block is taken for one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptError

# Fixed values of the dump formats.
BLOCK_END = "\\."
COPY_LINE = re.compile(r'COPY\s+((?:"(?:[^"]|"")*"|[^\s("]+)+)\s*(?:\(.*\)\s*)?FROM\s+stdin\s*;\s*$', re.I)
INSERT_LINE = re.compile(r'INSERT\s+(?:IGNORE\s+)?INTO\s+((?:"(?:[^"]|"")*"|`(?:[^`]|``)*`|[^\s("`]+)+)', re.I)
CREATE_LINE = re.compile(r'CREATE\s+(?:UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?((?:"(?:[^"]|"")*"|`(?:[^`]|``)*`|[^\s("`]+)+)', re.I)
ALLOWED = ("\\connect ", "\\restrict ", "\\unrestrict ")
CLOSING = ("-- PostgreSQL database dump complete", "-- PostgreSQL database cluster dump complete", "-- Dump completed")

#: Whole texts and what else matters in the rows of an INSERT; a quote alone opens a text that isn't closed.
_ESCAPED = re.compile(r"""'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*"|['"();]""", re.S)
_PLAIN = re.compile(r"""'[^']*'|"[^"]*"|['"();]""")
_VALUES = re.compile(r"""\"[^"]*"|`[^`]*`|\bVALUES\b""", re.I)

#: A section of a part: ``item`` the table of its first COPY line, and counts from there on and of all its lines.
#: Rows with ``what`` "insert", "table", "bad" or "closing" lie outside blocks, if the section doesn't begin in one.
SECTION = "at long, section long, what string, item string, rows long, sum string, all_rows long, all_sum string"
_MODULUS = 1 << 64


def plain_name(name: str) -> str:
    """A table's name without its quotes; a dot inside quotes stays."""
    return re.sub(r'"((?:[^"]|"")*)"|`((?:[^`]|``)*)`', lambda m: m[1].replace('""', '"') if m[1] is not None else m[2].replace("``", "`"), name)


def row_sum(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def tuples(line: str, at: int, backslash: bool) -> list[str] | None:
    """The texts in brackets after VALUES, from ``at``; None where the statement doesn't end in this line.

    ``backslash``: whether one escapes the next character of a text, as it does in dumps with backquoted names.
    """
    out, depth, start = [], 0, 0
    for m in (_ESCAPED if backslash else _PLAIN).finditer(line, at):
        c = m[0]
        if c in "'\"":
            return None  # a text that isn't closed
        if c == "(":
            depth += 1
            if depth == 1:
                start = m.end()
        elif c == ")":
            depth -= 1
            if depth == 0:
                out.append(line[start : m.start()])
        elif c == ";" and depth == 0:
            return out
    return None


def _values_at(line: str, at: int) -> int:
    """Where the rows of an INSERT begin: after VALUES, which may follow a list of columns."""
    return next((m.end() for m in _VALUES.finditer(line, at) if m[0].upper() == "VALUES"), len(line))


class _Part:
    """The fold of one part of a file."""

    def __init__(self, at: int):
        self.at, self.section, self.out = at, 0, []
        self._open()

    def _open(self) -> None:
        self.item, self.rows, self.sum, self.all_rows, self.all_sum = None, 0, 0, 0, 0
        self.outside: dict[tuple[str, str], list[int]] = {}

    def _close(self, what: str) -> None:
        for (kind, item), (n, total) in self.outside.items():
            self.out.append((self.at, self.section, kind, item, n, str(total), 0, "0"))
        self.out.append((self.at, self.section, what, self.item, self.rows, str(self.sum), self.all_rows, str(self.all_sum)))
        self.section += 1
        self._open()

    def _note(self, kind: str, item: str, n: int = 0, total: int = 0) -> None:
        seen = self.outside.setdefault((kind, item), [0, 0])
        seen[0] += n
        seen[1] = (seen[1] + total) % _MODULUS

    def line(self, text: str) -> None:
        if text.rstrip("\r") == BLOCK_END:
            self._close("block")
            return
        if self.item is not None or self.section == 0:  # later sections of a part begin outside
            h = row_sum(text)
            self.all_rows, self.all_sum = self.all_rows + 1, (self.all_sum + h) % _MODULUS
            if self.item is not None:
                self.rows, self.sum = self.rows + 1, (self.sum + h) % _MODULUS
                return
        if m := COPY_LINE.match(text):
            self.item = plain_name(m[1])
        elif m := INSERT_LINE.match(text):
            found = tuples(text, _values_at(text, m.end()), "`" in m[1])
            if found is None:
                self._note("bad", "an INSERT goes on in the next line")
            else:
                self._note("insert", plain_name(m[1]), len(found), sum(map(row_sum, found)))
        elif m := CREATE_LINE.match(text):
            self._note("table", plain_name(m[1]))
        elif text.startswith(CLOSING):
            self._note("closing", "")
        elif text.startswith("\\") and not text.startswith(ALLOWED):
            self._note("bad", "a command for the client: " + text.split(None, 1)[0][:40])

    def end(self) -> list[tuple]:
        self._close("rest")
        return self.out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = None

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        names = ["at", "section", "what", "item", "rows", "sum", "all_rows", "all_sum"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for b in batches:
        for at, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if part is None or at != part.at:
                if part is not None:
                    yield rows(part.end())
                part = _Part(at)
            part.line(text)
    if part is not None:
        yield rows(part.end())


def sections(spark: SparkSession, path: str) -> DataFrame:
    """The sections of all parts of the dump at ``path``, as rows of ``SECTION``."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_block_start").alias("at"), "value").mapInArrow(_fold, SECTION)


def dump_items(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(table, rows, checksum) of a text dump, tables without rows too; CorruptError where it is damaged or refused."""
    parts: dict[int, dict[int, list]] = {}
    try:
        found = sections(spark, path).collect()  # some rows a table and part of the file
    except PySparkException as e:
        if any(x in str(e) for x in ("ZipException", "EOFException", "ZlibDecompressor", "not a gzip file")):
            raise CorruptError("damaged gzip data") from None
        raise
    for r in found:
        parts.setdefault(r["at"], {}).setdefault(r["section"], []).append(r)
    counts: dict[str, list[int]] = {}
    inside, closed = None, False

    def add(item: str, n: int = 0, total: int | str = 0) -> None:
        seen = counts.setdefault(item, [0, 0])
        seen[0] += n
        seen[1] = (seen[1] + int(total)) % _MODULUS

    for at in sorted(parts):
        for section in sorted(parts[at]):
            block = next(r for r in parts[at][section] if r["what"] in ("block", "rest"))
            if inside is not None:  # the part begins in a block: all lines up to its end are rows
                add(inside, block["all_rows"], block["all_sum"])
            else:
                for r in parts[at][section]:
                    if r["what"] == "bad":
                        raise CorruptError(f"not readable without a server: {r['item']}")
                    if r["what"] in ("insert", "table"):
                        add(r["item"], r["rows"], r["sum"])
                    closed = closed or r["what"] == "closing"
                if block["item"] is not None:
                    add(block["item"], block["rows"], block["sum"])
                    inside = block["item"]
            if block["what"] == "block":
                if inside is None:
                    raise CorruptError("the dump ends a block of rows that it never began")
                inside = None
    if inside is not None or not closed:
        raise CorruptError("the dump is cut short")
    return [(item, n, f"{total:016x}") for item, (n, total) in sorted(counts.items())]


def dump_file(spark: SparkSession, path: str) -> DataFrame:
    """Items of a text dump, gzipped or not."""
    return spark.createDataFrame(dump_items(spark, path), "item string, rows long, checksum string")
