"""A shell over a store: SQL statements and dot-commands, one a line."""

from __future__ import annotations

import argparse
import shlex
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError, MisuseError
from .session import Engine
from .sources import textio
from .streaming.sync import Gateway
from .types import format_real


def cell(v) -> str:
    return "NULL" if v is None else format_real(v) if isinstance(v, float) else str(v)


def printed(df: DataFrame) -> Iterator[str]:
    yield "|".join(df.columns)
    for r in df.toLocalIterator():
        yield "|".join(map(cell, r))


def values(words: list[str]) -> list:
    out = []
    for w in words:
        try:
            out.append(int(w))
        except ValueError:
            try:
                out.append(float(w))
            except ValueError:
                out.append(w)
    return out


def command(engine: Engine, line: str) -> Iterator[str]:
    """The lines that a dot-command prints."""
    name, *args = shlex.split(line)
    match name, args:
        case ".tables", []:
            yield from (r["name"] for r in engine.tables().orderBy("name").toLocalIterator())
        case ".schema", rest:
            for r in engine.tables().orderBy("name").toLocalIterator():
                if not rest or r["name"] == rest[0]:
                    yield f"{r['name']} ({r['columns']}) key ({r['key']})" + (f" indexes ({r['indexes']})" if r["indexes"] else "")
        case ".info", []:
            yield from (f"{k}: {v}" for k, v in engine.info().items())
        case ".check", []:
            yield from engine.check() or ["ok"]
        case ".begin" | ".commit" | ".rollback", []:
            getattr(engine, name[1:])()
        case ".get", [bucket, key]:
            v = engine.bucket(bucket, create=False).get(key.encode())
            yield "NULL" if v is None else v.decode("utf-8", "replace")
        case ".put", [bucket, key, value]:
            engine.bucket(bucket).put(key.encode(), value.encode())
        case ".del", [bucket, key]:
            yield "deleted" if engine.bucket(bucket, create=False).delete(key.encode()) else "no such key"
        case ".keys", [bucket, *start]:
            for r in engine.bucket(bucket, create=False).scan(start[0].encode() if start else None).toLocalIterator():
                yield bytes(r["k"]).decode("utf-8", "replace")
        case ".row", ["get", table, *key]:
            r = engine.table(table).get(*values(key))
            yield "no such row" if r is None else "|".join(map(cell, r))
        case ".row", ["put" | "insert" as how, table, *row]:
            getattr(engine.table(table), "upsert" if how == "put" else "insert")([tuple(values(row))])
        case ".row", ["del", table, *key]:
            yield "deleted" if engine.table(table).delete(*values(key)) else "no such row"
        case ".drop", [table]:
            engine.drop_table(table)
        case ".state", [device]:
            yield str(Gateway(engine).position(int(device)))
        case ".sync", [device, after, path]:
            with open(path, "rb") as f:
                yield str(Gateway(engine).apply(int(device), int(after), f.read()))
        case ".export", [path]:
            with open(path, "w", encoding="utf-8") as f:
                f.writelines(x + "\n" for x in textio.export(engine))
        case ".import", [path]:
            with open(path, encoding="utf-8") as f:
                yield f"{textio.import_(engine, f)} rows"
        case _:
            raise MisuseError(f"unknown command: {line}")


def run_line(engine: Engine, line: str) -> Iterator[str]:
    try:
        if line.startswith("."):
            yield from command(engine, line)
        else:
            for df in engine.execute(line, ordered=True):
                yield from printed(df)
    except EngineError as e:
        yield f"error {e.code} {e.name}: {e}"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root", help="folder of the store")
    p.add_argument("line", nargs="*", help="statements or commands; without any, lines of standard input")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sensorloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with Engine(spark, a.root) as engine:
        for line in a.line or map(str.strip, sys.stdin):
            for out in run_line(engine, line) if line else ():
                print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
