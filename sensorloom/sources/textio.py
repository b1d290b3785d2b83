"""Text export and import: lines ``series name "schema"``, ``kv "key" "value"`` and ``row name values``.

Series come by creation, keys in byte order, rows oldest first. Quoted text escapes quote, backslash, line
feed, carriage return and tab, and writes other control characters as two hexadecimal digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EngineError, ExistsError, SchemaError, SyntaxSqlError
from ..functions.scalar import print_real
from ..session import Engine, parse_schema

HEADER = "# sensorloom text export v1"
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_PLAIN = {"\\": "\\", '"': '"', "n": "\n", "r": "\r", "t": "\t"}
_TOKEN = re.compile(r'[ \t]*(?:"((?:[^"\\]|\\.)*)"|([^ \t"]+))')


def quote(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else c) for c in text) + '"'


def unquote(body: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1], 16)) if m[1] else _PLAIN[m[2]] if m[2] in _PLAIN else _bad()

    def _bad():
        raise SyntaxSqlError("unknown escape")

    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|(.))", one, body)


def quote_column(c: Column) -> Column:
    for plain, escaped in _ESCAPES.items():
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    for i in [*range(32), 127]:
        if chr(i) not in _ESCAPES:
            c = F.replace(c, F.lit(chr(i)), F.lit(f"\\x{i:02x}"))
    return F.concat(F.lit('"'), c, F.lit('"'))


def lines(engine: Engine) -> DataFrame:
    """(part, line) of the export, in order of part, and of ``_txn``, ``_n`` inside it: distributed rows."""
    spark = engine.spark
    names = engine.series.list()
    head = [HEADER] + [f"series {n} {quote(','.join(f'{c.name}:{c.type}' for c in engine.describe(n).columns))}" for n in names]
    out = spark.createDataFrame([(0, "", 0, i, h) for i, h in enumerate(head)], "part int, key string, txn long, n long, line string")
    kv = engine.kv.items().select(F.lit(1).alias("part"), "key", F.lit(0).cast("long").alias("txn"), F.lit(0).cast("long").alias("n"), F.concat(F.lit("kv "), quote_column(F.col("key")), F.lit(" "), quote_column(F.col("value"))).alias("line"))
    out = out.unionByName(kv)
    for i, name in enumerate(names):
        t = engine.describe(name)
        cells = [quote_column(F.col(c.name)) if c.type == "text" else print_real(F.col(c.name)) if c.type in ("float", "real") else F.col(c.name).cast("string") for c in t.columns]
        rows = engine.store.rows(t).select(F.lit(2 + i).alias("part"), F.lit("").alias("key"), F.col("_txn").alias("txn"), F.col("_n").alias("n"), F.concat_ws(" ", F.lit(f"row {name}"), *cells).alias("line"))
        out = out.unionByName(rows)
    return out


def export(engine: Engine) -> Iterator[str]:
    """The lines of the export, one partition at a time."""
    for r in lines(engine).orderBy("part", "key", "txn", "n").select("line").toLocalIterator():
        yield r["line"]


def export_to(engine: Engine, path: str) -> None:
    """The export as a folder of text files in order."""
    lines(engine).repartitionByRange("part", "key", "txn", "n").sortWithinPartitions("part", "key", "txn", "n").select("line").write.text(path)


def _tokens(line: str) -> list[tuple[bool, str]]:
    out, at = [], 0
    while at < len(line.rstrip(" \t")):
        m = _TOKEN.match(line, at)
        if not m:
            raise SyntaxSqlError("a quote is not closed")
        out.append((m[1] is not None, unquote(m[1]) if m[1] is not None else m[2]))
        at = m.end()
    return out


def _number(kind: str, quoted: bool, text: str):
    try:
        if quoted:
            raise ValueError
        return float(text) if kind in ("float", "real") else int(text)
    except ValueError:
        raise SyntaxSqlError("bad number") from None


def import_(engine: Engine, text: Iterable[str]) -> int:
    """Read lines; the number of rows and pairs. Errors name the line; what came before it stays."""
    pairs: list[tuple[str, str]] = []
    rows: dict[str, list[tuple]] = {}
    n = at = 0

    def flush() -> None:
        if pairs:
            engine.kv.put_all(pairs)
        for name, held in rows.items():
            engine.series.append(name, held)
        pairs.clear()
        rows.clear()

    try:
        for at, line in enumerate(text, 1):  # noqa: B007
            line = line.rstrip("\n").removesuffix("\r")
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            word, *rest = _tokens(line)
            match word[1].lower():
                case "series":
                    if len(rest) != 2 or rest[0][0] or not rest[1][0]:
                        raise SyntaxSqlError('expected series name "schema"')
                    name, schema = rest[0][1], rest[1][1]
                    try:
                        engine.series.create(name, schema)
                    except ExistsError:
                        if engine.describe(name).columns != parse_schema(schema):
                            raise SchemaError("series exists with a different schema") from None
                case "kv":
                    if len(rest) != 2 or not (rest[0][0] and rest[1][0]):
                        raise SyntaxSqlError('expected kv "key" "value"')
                    pairs.append((rest[0][1], rest[1][1]))
                    n += 1
                case "row":
                    if not rest or rest[0][1] not in engine.store.state["tables"]:
                        raise SchemaError("row for an unknown series")
                    columns = engine.describe(rest[0][1]).columns
                    if len(rest) - 1 > len(columns):
                        raise SchemaError("too many values for this series")
                    if len(rest) - 1 < len(columns):
                        raise SyntaxSqlError("expected a number")
                    cells = []
                    for c, (quoted, v) in zip(columns, rest[1:], strict=True):
                        if c.type == "text" and not quoted:
                            raise SyntaxSqlError("expected a quoted text value")
                        cells.append(v if c.type == "text" else _number(c.type, quoted, v))
                    rows.setdefault(rest[0][1], []).append(tuple(cells))
                    n += 1
                case _:
                    raise SyntaxSqlError("expected series, kv or row")
            if len(pairs) + sum(map(len, rows.values())) >= 50_000:
                flush()
    except EngineError as e:
        flush()
        raise type(e)(f"line {at}: {e}") from None
    flush()
    return n


class TextSource(DataSource):
    """``spark.read.format("sensortext").load(path)``: (line, kind, name, cells) of exported files, a task a file."""

    @classmethod
    def name(cls) -> str:
        return "sensortext"

    def schema(self) -> str:
        return "line long, kind string, name string, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _TextReader(self.options["path"])


class _TextReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(f"{self.path}/part-*")) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(p) for p in found]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            for i, line in enumerate(f, 1):
                line = line.rstrip("\r\n")
                if line.strip() and not line.lstrip().startswith("#"):
                    (_, word), *rest = _tokens(line)
                    named = word.lower() in ("series", "row")
                    yield i, word.lower(), rest[0][1] if named and rest else None, [v for _, v in rest[named:]]
