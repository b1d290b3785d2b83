"""From a syntax tree to Columns: alias scoping, static types and the language's value rules.

Every column has a static type and stored rows hold no NULL, so an expression is INT, REAL, TEXT, truth
(an INT made of a boolean) or NULL at analysis time and becomes one plain Column for Catalyst.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError, SyntaxSqlError
from ..functions import scalar as S
from ..types import STATIC, ColumnDef, read_column
from .constants import evaluate
from .syntax import (AGGREGATES, COMPARISONS, MAX_DEPTH, MAX_NODES, Between, Bin, Col, Fn, IsNull, Item, Like, Lit, Logic, Name, Neg, Node, Not, Param, Select, depth_and_size, is_constant, walk)

SPARK_NAME = {"int": "bigint", "real": "double", "text": "string", "null": "bigint", "bool": "boolean"}


@dataclass
class Source:
    """What a query reads: columns in order, the rows, and Columns that put the rows in scan order."""

    columns: list[ColumnDef]
    df: DataFrame
    order: list[str]


def has_aggregate(e: Node) -> bool:
    return any(isinstance(x, Fn) and x.name in AGGREGATES for x in walk(e))


class Resolver:
    """Replaces names: columns first, then aliases of items already resolved."""

    def __init__(self, columns: list[ColumnDef]):
        self.columns, self.aliases = columns, {}

    def resolve(self, e: Node, aggregates: bool, inside: bool = False) -> Node:
        if isinstance(e, Name):
            for i, c in enumerate(self.columns):
                if c.name.lower() == e.name.lower():
                    return Col(i, src=e.src)
            hit = self.aliases.get(e.name.lower()) if not inside else None
            if hit is None:
                raise SchemaError(f"no such column: {e.name}")
            if not aggregates and has_aggregate(hit):
                raise SyntaxSqlError("an aggregate cannot stand here")
            return hit
        if isinstance(e, Fn) and e.name in AGGREGATES:
            if not aggregates or inside:
                raise SyntaxSqlError("an aggregate cannot stand here")
            inside = True
        out = copy.copy(e)
        for k, v in e.__dict__.items():
            if isinstance(v, Node):
                setattr(out, k, self.resolve(v, aggregates, inside))
            elif isinstance(v, list):
                setattr(out, k, [self.resolve(x, aggregates, inside) if isinstance(x, Node) else x for x in v])
        return out

    def checked(self, e: Node, aggregates: bool) -> Node:
        e = self.resolve(e, aggregates)
        depth, size = depth_and_size(e)
        if depth > MAX_DEPTH or size > MAX_NODES:
            raise SyntaxSqlError("aliases make this expression too large")
        return e


@dataclass
class Resolved:
    """A SELECT after name resolution."""

    names: list[str]
    items: list[Node]
    where: Node | None
    group: list[Node]
    having: Node | None
    order: list[tuple[Node, bool]]


def resolve_select(q: Select, columns: list[ColumnDef]) -> Resolved:
    """In WHERE and HAVING a column wins over an alias, in GROUP BY and ORDER BY the alias wins."""
    if q.star and q.table is None:
        raise SyntaxSqlError("* needs FROM")
    items = [Item(Name(c.name, src=c.name)) for c in columns] if q.star else q.items
    r, done = Resolver(columns), []
    for item in items:
        e = r.checked(item.expr, True)
        done.append(e)
        if item.alias:
            r.aliases.setdefault(item.alias.lower(), e)

    def term(e: Node, aggregates: bool) -> Node:
        if isinstance(e, Lit) and isinstance(e.value, int) and 1 <= e.value <= len(items):
            return done[e.value - 1]
        if isinstance(e, Name):
            for item, node in zip(items, done, strict=True):
                if item.alias and item.alias.lower() == e.name.lower():
                    return node
        return r.checked(e, aggregates)

    group = [term(e, True) for e in q.group]
    if any(map(has_aggregate, group)):
        raise SyntaxSqlError("no aggregate in GROUP BY")
    order = [(term(e, True), desc) for e, desc in q.order]
    where = r.checked(q.where, False) if q.where is not None else None
    having = r.checked(q.having, True) if q.having is not None else None
    if having is not None and not group and not any(map(has_aggregate, [*done, having])):
        raise SyntaxSqlError("HAVING without groups or an aggregate")
    names = [i.alias or (columns[n.index].name if isinstance(n, Col) else i.expr.src) for i, n in zip(items, done, strict=True)]
    return Resolved(names, done, where, group, having, order)


def literal(v) -> tuple[Column, str]:
    if v is None:
        return F.lit(None).cast("bigint"), "null"
    if isinstance(v, str):
        return F.lit(v), "text"
    return (F.lit(v), "real") if isinstance(v, float) else (F.lit(v).cast("bigint"), "int")


class Compiler:
    """``known``: columns that stand for whole subtrees, as (tree, Column, static type)."""

    def __init__(self, columns: list[ColumnDef], params: list | None = None, promote: bool = False, known: list | None = None, cells: dict[int, Column] | None = None):
        self.columns, self.params, self.promote, self.known, self.cells = columns, params, promote, known or [], cells or {}

    def value(self, e: Node) -> tuple[Column, str]:
        """(Column, static type), truth as 0 and 1."""
        c, t = self.compile(e)
        return (c.cast("bigint"), "int") if t == "bool" else (c, t)

    def truth(self, e: Node) -> Column:
        """Three-valued truth: nonzero numbers are true, text isn't."""
        c, t = self.compile(e)
        if t == "bool":
            return c
        if t == "null":
            return F.lit(None).cast("boolean")
        if t == "text":
            return F.when(c.isNotNull(), F.lit(False))
        return c != 0

    def compile(self, e: Node) -> tuple[Column, str]:
        for tree, c, t in self.known:
            if tree == e:
                return c, t
        if is_constant(e):
            return literal(evaluate(e, self.params))
        match e:
            case Col(index):
                d = self.columns[index]
                return self.cells.get(index, read_column(d)), STATIC[d.type]
            case Neg(a):
                c, t = self.value(a)
                if t in ("text", "null"):
                    return literal(None)
                return S.negate(c, t, self.promote), "real" if self.promote else t
            case Not(a):
                return ~self.truth(a), "bool"
            case Logic(op, a, b):
                x, y = self.truth(a), self.truth(b)
                return (x & y if op == "AND" else x | y), "bool"
            case IsNull(a, negated):
                c, _ = self.value(a)
                return (c.isNotNull() if negated else c.isNull()), "bool"
            case Between(a, low, high, negated):
                (x, tx), (y, ty), (z, tz) = self.value(a), self.value(low), self.value(high)
                some_null = x.isNull() | y.isNull() | z.isNull()
                inside = self.compare(">=", x, tx, y, ty) & self.compare("<=", x, tx, z, tz)
                return F.when(~some_null, ~inside if negated else inside), "bool"
            case Like(a, pattern, negated):
                (x, tx), (y, ty) = self.value(a), self.value(pattern)
                if tx != "text" or ty != "text":
                    return F.lit(None).cast("boolean"), "bool"
                c = S.like(x, y)
                return (~c if negated else c), "bool"
            case Bin(op, a, b) if op in COMPARISONS:
                return self.compare(op, *self.value(a), *self.value(b)), "bool"
            case Bin(op, a, b):
                return self.arithmetic(op, *self.value(a), *self.value(b))
            case Fn(name, args):
                return self.function(name, [self.value(x) for x in args])
        raise SchemaError(f"cannot compile {e.src}")

    def compare(self, op: str, a: Column, ta: str, b: Column, tb: str) -> Column:
        if "null" in (ta, tb):
            return F.lit(None).cast("boolean")
        if (ta == "text") != (tb == "text"):  # numbers come before text
            c = 1 if ta == "text" else -1
            fixed = {"=": False, "<>": True, "<": c < 0, "<=": c < 0, ">": c > 0, ">=": c > 0}[op]
            return F.when(a.isNotNull() & b.isNotNull(), F.lit(fixed))
        return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()

    def arithmetic(self, op: str, a: Column, ta: str, b: Column, tb: str) -> tuple[Column, str]:
        if {ta, tb} & {"text", "null"}:
            return literal(None)
        if ta == tb == "int":
            if op == "%":
                return S.modulo_whole(a, b), "int"
            c = S.divide_whole(a, b, self.promote) if op == "/" else {"+": S.add, "-": S.subtract, "*": S.multiply}[op](a, b, self.promote)
            return c, "real" if self.promote else "int"
        a, b = a.cast("double"), b.cast("double")
        if op == "/":
            return S.divide_real(a, b), "real"
        if op == "%":
            return S.modulo_real(a, b), "real"
        return {"+": a + b, "-": a - b, "*": a * b}[op], "real"

    def function(self, name: str, args: list[tuple[Column, str]]) -> tuple[Column, str]:
        c, t = args[0]
        if name in ("ABS", "ROUND") and any(x in ("text", "null") for _, x in args):
            return literal(None)
        if name == "ABS":
            return S.absolute(c, t, self.promote), "real" if self.promote else t
        if name == "ROUND":
            return S.round_half_away(c, args[1][0] if len(args) > 1 else 0), "real"
        if name == "LENGTH":
            return (literal(None)) if t == "null" else (S.byte_length(c, t), "int")
        if t != "text":
            return c, t
        return (S.lower_ascii(c) if name == "LOWER" else S.upper_ascii(c)), "text"

    def aggregate(self, fn: Fn) -> tuple[Column, str]:
        if fn.star:
            return F.count(F.lit(1)), "int"
        c, t = self.value(fn.args[0])
        if fn.name == "COUNT":
            return F.count(c), "int"
        if fn.name in ("SUM", "AVG") and t in ("text", "null"):
            return F.max(F.lit(None).cast("bigint")), "null"
        if fn.name == "SUM":
            return (S.sum_promoting(c), "real") if t == "int" and self.promote else (F.sum(c), t)
        if fn.name == "AVG":
            return F.avg(c.cast("double")), "real"
        return (F.min if fn.name == "MIN" else F.max)(c), t


def run_select(q: Select, source: Source, params: list | None = None, promote: bool = False, ordered: bool = False) -> DataFrame:
    """The rows of a SELECT. ``ordered`` keeps scan order where the query names none."""
    r = resolve_select(q, source.columns)
    df, c = source.df, Compiler(source.columns, params, promote)
    if r.where is not None:
        df = df.where(c.truth(r.where))
    if r.group or any(map(has_aggregate, [*r.items, *([r.having] if r.having is not None else []), *(e for e, _ in r.order)])):
        df, c, scan = _grouped(r, source, df, c, ordered)
        if r.having is not None:
            df = df.where(c.truth(r.having))
    else:
        scan = [F.col(x) for x in source.order]
    keys = [(c.value(e)[0], desc) for e, desc in r.order if not is_constant(e)]
    by = [k.desc_nulls_last() if desc else k.asc_nulls_first() for k, desc in keys]
    if ordered or (q.limit is not None and not by):
        by += scan
    if by:
        df = df.orderBy(*by)
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.select(*[c.value(e)[0].alias(n) for n, e in zip(r.names, r.items, strict=True)])


def _grouped(r: Resolved, source: Source, df: DataFrame, c: Compiler, ordered: bool) -> tuple[DataFrame, Compiler, list[Column]]:
    """Groups and aggregates; columns beside them come from each group's first row in scan order."""
    outside: list[Node] = [*r.items, *([r.having] if r.having is not None else []), *(e for e, _ in r.order)]
    known, groups, aggs = [], [], []
    for i, g in enumerate(r.group):
        if not is_constant(g):
            col, t = c.value(g)
            groups.append(col.alias(f"_g{i}"))
            known.append((g, F.col(f"_g{i}"), t))
    bare: set[int] = set()

    def gather(e: Node) -> None:
        if any(tree == e for tree, _, _ in known):
            return
        if isinstance(e, Fn) and e.name in AGGREGATES:
            col, t = c.aggregate(e)
            known.append((e, F.col(f"_a{len(aggs)}"), t))
            aggs.append(col.alias(f"_a{len(aggs)}"))
        elif isinstance(e, Col):
            bare.add(e.index)
        else:
            for x in e.children():
                gather(x)

    for e in outside:
        gather(e)
    first = F.struct(*[F.col(x) for x in source.order]) if source.order else F.monotonically_increasing_id()
    cells = {}
    for i in sorted(bare):
        aggs.append(F.min_by(read_column(source.columns[i]), first).alias(f"_b{i}"))
        cells[i] = F.col(f"_b{i}")
    scan = []
    if ordered and source.order:
        aggs.append(F.min(first).alias("_first"))
        scan = [F.col("_first")]
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("_n")]
    out = df.groupBy(*groups).agg(*aggs) if groups or r.group else df.agg(*aggs)
    if r.group and not groups:  # only constants: one group, if there is a row
        out = df.groupBy(F.lit(1).alias("_one")).agg(*aggs)
    return out, Compiler(source.columns, c.params, c.promote, known, cells), scan
