"""Column types of tables: their SQL names, Spark types and what a written value must satisfy."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from .errors import SchemaError, TooBigError

#: The names a column's type may have in SQL.
SQL_NAMES = {"TIME": "time", "TIMESTAMP": "time", "INT": "int", "SMALLINT": "int", "TINYINT": "int", "INTEGER": "long", "BIGINT": "long", "LONG": "long", "FLOAT": "float", "REAL": "real", "DOUBLE": "real", "TEXT": "text", "VARCHAR": "text", "CHAR": "text"}
#: FLOAT is kept as the shortest decimal of its 32 bits, in a DOUBLE: filters on it reach the files as they are.
SPARK = {"time": T.LongType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.DoubleType(), "real": T.DoubleType(), "text": T.StringType()}
#: The static type of a column in expressions.
STATIC = {"time": "int", "int": "int", "long": "int", "float": "real", "real": "real", "text": "text"}
INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1
MAX_TEXT = 255
#: Reals beyond this aren't truncated to whole numbers.
TRUNCATE_LIMIT = 9.2e18


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str


def shortest(value: float) -> float:
    """A stored 32-bit float as the shortest decimal that reads back to it."""
    if not math.isfinite(value):
        return value
    as32 = struct.unpack("f", struct.pack("f", value))[0]
    for digits in range(6, 10):
        text = f"{value:.{digits}g}"
        if struct.unpack("f", struct.pack("f", float(text)))[0] == as32:
            return float(text)
    return value


def format_real(value: float) -> str:
    """Text that reads back to the same value; short when the value is exactly a float; whole reals keep .0."""
    if not math.isfinite(value):
        return "nan" if math.isnan(value) else "inf" if value > 0 else "-inf"
    if abs(value) <= 3.4e38 and struct.unpack("f", struct.pack("f", value))[0] == value:
        text = next((t for d in range(6, 10) if struct.pack("f", float(t := f"{value:.{d}g}")) == struct.pack("f", value)), f"{value:.9g}")
    else:
        text = f"{value:.15g}"
        if float(text) != value:
            text = f"{value:.17g}"
    return text if any(c in text for c in ".en") else text + ".0"


def coerce(column: ColumnDef, value):
    """``value`` as the column stores it, or an error: no NULLs, no conversion between numbers and text."""
    t = column.type
    if value is None:
        raise SchemaError(f"column {column.name} cannot be NULL")
    if t == "text":
        if not isinstance(value, str):
            raise SchemaError(f"column {column.name} takes text")
        if len(value.encode()) > MAX_TEXT:
            raise TooBigError(f"column {column.name}: text of over {MAX_TEXT} bytes")
        return value
    if isinstance(value, str):
        raise SchemaError(f"column {column.name} takes a number")
    if t in ("float", "real"):
        value = float(value)
        if math.isnan(value):
            raise SchemaError(f"column {column.name} cannot be NaN")
        return shortest(struct.unpack("f", struct.pack("f", value))[0]) if t == "float" and abs(value) <= 3.4e38 else value
    if isinstance(value, float):
        if not abs(value) < TRUNCATE_LIMIT:
            raise SchemaError(f"column {column.name}: number out of range")
        value = math.trunc(value)
    low, high = (-(1 << 31), (1 << 31) - 1) if t == "int" else (INT64_MIN, INT64_MAX)
    if not low <= value <= high:
        raise SchemaError(f"column {column.name}: number out of range")
    return int(value)


def read_column(column: ColumnDef, source: Column | None = None) -> Column:
    """A stored column as expressions see it: whole numbers as LONG, reals as DOUBLE."""
    c = F.col(column.name) if source is None else source
    return c.cast({"int": "bigint", "real": "double", "text": "string"}[STATIC[column.type]])


def store_column(column: ColumnDef, value: Column, static: str) -> tuple[Column, Column]:
    """(what is stored, whether the value may not be stored) of a computed column of a static type."""
    bad = value.isNull()
    if column.type == "text":
        return (value, bad | (F.octet_length(value) > MAX_TEXT)) if static == "text" else (F.lit(None).cast("string"), F.lit(True))
    if static in ("text", "null"):
        return F.lit(None).cast(SPARK[column.type]), F.lit(True)
    if column.type in ("float", "real"):
        bad = bad | F.isnan(value.cast("double"))
        return (value.cast("float").cast("string").cast("double") if column.type == "float" else value.cast("double")), bad
    whole = value
    if static == "real":
        bad = bad | ~(F.abs(value) < TRUNCATE_LIMIT)
        whole = F.when(F.abs(value) < TRUNCATE_LIMIT, value).cast("bigint")
    if column.type == "int":
        fits = whole.between(-(1 << 31), (1 << 31) - 1)
        return F.when(fits, whole).cast("int"), bad | ~fits
    return whole.cast("bigint"), bad
