"""From a WHERE to the files a statement reads: what it says of single columns, the ways to use that, the best way.

``narrow`` turns the parts that must all hold into one ``Range`` a column. ``ways`` offers each order that the
store keeps rows or index entries in, with how far its columns are pinned down; ``choose`` takes the way that
pins most. The store then reads the files the way leaves, and EXPLAIN tells the same way and their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from ..errors import EngineError
from ..types import STATIC, TRUNCATE_LIMIT, ColumnDef, coerce
from .constants import evaluate
from .syntax import Between, Bin, Col, Logic, Node, is_constant

#: Values that one list of alternatives may have.
MOST_VALUES = 64
#: A comparison as seen from its other side.
TURNED = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass
class Range:
    """What a column's values must lie in; ``listed`` counts the alternatives a list was given with."""

    low: object = None
    high: object = None
    values: frozenset | None = None
    listed: int = 0

    @property
    def pinned(self) -> bool:
        return self.values is not None and not self.listed

    @property
    def bounded(self) -> bool:
        return self.low is not None or self.high is not None

    def meets(self, low, high) -> bool:
        """Whether a file whose values lie from ``low`` to ``high`` can hold one."""
        if self.low is not None and high < self.low or self.high is not None and low > self.high:
            return False
        return self.values is None or any(low <= v <= high for v in self.values)

    def add(self, op: str, value) -> None:
        if op == "=":
            self.values = frozenset([value]) if self.values is None or self.listed else self.values & {value}
            self.listed = 0
        elif op in (">", ">="):
            self.low = value if self.low is None else max(self.low, value)
        elif op in ("<", "<="):
            self.high = value if self.high is None else min(self.high, value)


@dataclass
class Way:
    """One way to the rows: through the key's order or an index, by leading columns pinned, then a range or list."""

    kind: str
    pinned: list[str] = field(default_factory=list)
    index: str | None = None
    ranged: str | None = None
    listed: str | None = None

    @property
    def worth(self) -> tuple[int, int]:
        """Columns that are pinned, a list as one, then whether a range follows."""
        return len(self.pinned) + (self.listed is not None), int(self.ranged is not None)

    def tell(self, table: str, ranges: dict[str, Range]) -> str:
        parts = [table]
        if self.index:
            parts.append(f"index {self.index}")
        if self.pinned:
            parts.append("fixed: " + " ".join(self.pinned))
        if self.ranged:
            parts.append(f"range on {self.ranged}")
        if self.listed:
            parts.append(f"list on {self.listed} ({ranges[self.listed].listed} values)")
        return ", ".join(parts)


def _constant(column: ColumnDef, e: Node, params) -> object:
    """The value of a constant that the column's values can be compared with in storage order, else None."""
    if not is_constant(e):
        return None
    v = evaluate(e, params)
    if v is None or isinstance(v, str) != (column.type == "text") or v != v:
        return None
    if isinstance(v, float) and STATIC[column.type] == "int" and not abs(v) < TRUNCATE_LIMIT:
        return None
    try:
        coerce(column, v)  # a value the column can't store narrows nothing
    except EngineError:
        return None
    return v


def _sides(e: Bin) -> tuple[Col, str, Node] | None:
    """(column, comparison, other side) of a comparison of a column with something else."""
    if e.op in TURNED and isinstance(e.a, Col) != isinstance(e.b, Col):
        return (e.a, e.op, e.b) if isinstance(e.a, Col) else (e.b, TURNED[e.op], e.a)
    return None


def _conjuncts(e: Node | None) -> Iterator[Node]:
    if isinstance(e, Logic) and e.op == "AND":
        yield from _conjuncts(e.a)
        yield from _conjuncts(e.b)
    elif e is not None:
        yield e


def _alternatives(e: Node) -> Iterator[Node]:
    if isinstance(e, Logic) and e.op == "OR":
        yield from _alternatives(e.a)
        yield from _alternatives(e.b)
    else:
        yield e


def narrow(where: Node | None, columns: list[ColumnDef], params=None) -> dict[str, Range]:
    """The ranges of the columns that ``where`` says something of."""
    out: dict[str, Range] = {}
    lists: list[tuple[str, list]] = []
    for e in _conjuncts(where):
        if isinstance(e, Logic) and e.op == "OR":
            found = [_sides(x) if isinstance(x, Bin) and x.op == "=" else None for x in _alternatives(e)]
            if None in found or len({c.index for c, *_ in found}) > 1 or len(found) > MOST_VALUES:
                continue
            column = columns[found[0][0].index]
            values = [_constant(column, x, params) for *_, x in found]
            if None not in values:
                lists.append((column.name, values))
            continue
        if isinstance(e, Between):
            facts = [(e.a, ">=", e.low), (e.a, "<=", e.high)] if not e.negated and isinstance(e.a, Col) else []
        else:
            facts = [s] if isinstance(e, Bin) and (s := _sides(e)) else []
        for col, op, other in facts:
            column = columns[col.index]
            if (v := _constant(column, other, params)) is not None:
                out.setdefault(column.name, Range()).add(op, v)
    for name, values in lists:
        r = out.setdefault(name, Range())
        if r.values is None:
            r.values, r.listed = frozenset(values), len(values)
    return out


def ways(t, ranges: dict[str, Range]) -> Iterator[Way]:
    """The ways to a table's rows, the plainest first."""
    free = Range()

    def lead(names: list[str]) -> tuple[list[str], str | None]:
        n = 0
        while n < len(names) and ranges.get(names[n], free).pinned:
            n += 1
        return names[:n], names[n] if n < len(names) else None

    yield Way("full scan")
    pinned, after = lead(t.key)
    if after is None and not t.rowid:
        yield Way("point lookup", pinned)
        return
    r = ranges.get(after, free) if after else free
    if r.listed:
        yield Way("key list", pinned, listed=after)
    elif pinned or r.bounded:
        yield Way("range scan", pinned, ranged=after if r.bounded else None)
    elif t.synced and not t.kv and len(t.key) > 1 and (r := ranges.get(t.key[1], free)) and (r.bounded or r.pinned):
        yield Way("range per device", ranged=t.key[1])
    for name, index in t.indexes.items():
        pinned, after = lead(index["columns"])
        ranged = after if after and ranges.get(after, free).bounded else None
        if pinned or ranged:
            yield Way("index range" if after else "index lookup", pinned, name, ranged)


def choose(t, ranges: dict[str, Range]) -> Way:
    """The way that pins most; of equals the first, so that an index has to be better than the key's order."""
    return max(ways(t, ranges), key=lambda w: w.worth)
