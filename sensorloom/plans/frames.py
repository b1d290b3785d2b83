"""SELECT over DataFrames by name, without a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MisuseError, SchemaError
from ..types import ColumnDef
from .compiler import Source, run_select
from .syntax import Select, parse

_TYPES = {"string": "text", "double": "real", "float": "real", "int": "int", "smallint": "int", "tinyint": "int"}


def source(df: DataFrame, order: list[str] | None = None) -> Source:
    """A DataFrame as a table: its columns' types from its schema, its scan order by ``order``. Floats are read
    as their shortest decimal."""
    names = df.dtypes
    df = df.withColumns({n: F.col(n).cast("string").cast("double") for n, t in names if t == "float"}) if any(t == "float" for _, t in names) else df
    return Source([ColumnDef(n, _TYPES.get(t, "long")) for n, t in df.dtypes], df, order or [])


def select(text: str, *params, promote: bool = False, ordered: bool = False, **frames: Source | DataFrame) -> DataFrame:
    """The rows of one SELECT whose table is one of ``frames``."""
    statements, n = parse(text)
    if len(statements) != 1 or not isinstance(statements[0], Select) or statements[0].explain:
        raise MisuseError("one SELECT is needed")
    q = statements[0]
    if n != len(params):
        raise MisuseError(f"{n} parameters, {len(params)} values")
    if q.table is None:
        some = next(iter(frames.values()))
        spark = (some.df if isinstance(some, Source) else some).sparkSession
        own = Source([], spark.range(1), [])
    elif q.table in frames:
        own = frames[q.table] if isinstance(frames[q.table], Source) else source(frames[q.table])
    else:
        raise SchemaError(f"no such table: {q.table}")
    return run_select(q, own, list(params), promote, ordered)


