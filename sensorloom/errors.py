"""Errors with the names and codes that callers of the query language know."""

from __future__ import annotations


class EngineError(Exception):
    """Base class; ``name`` and ``code`` tell what went wrong."""

    name, code = "ERROR", -1


def _kind(name: str, code: int) -> type[EngineError]:
    return type(name.title().replace("_", "") + "Error", (EngineError,), {"name": name, "code": code, "__doc__": f"{name} ({code})."})


# The names and codes of the query language.
IoError = _kind("IOERR", -2)
CorruptError = _kind("CORRUPT", -3)
FullError = _kind("FULL", -4)
MemoryLimitError = _kind("NOMEM", -5)
TooBigError = _kind("TOOBIG", -6)
MisuseError = _kind("MISUSE", -7)
SyntaxSqlError = _kind("SYNTAX", -8)
SchemaError = _kind("SCHEMA", -9)
ExistsError = _kind("EXISTS", -10)
BusyError = _kind("BUSY", -21)
FailedError = _kind("FAILED", -22)
ShortError = _kind("SHORT", -23)
GapError = _kind("GAP", -24)
NotFoundError = _kind("NOTFOUND", 1)
