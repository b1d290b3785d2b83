"""Exact evaluation of expressions without columns: 64-bit whole numbers that turn real on overflow."""

from __future__ import annotations

import math
import re

from ..errors import MisuseError
from ..types import INT64_MAX, INT64_MIN, format_real
from .syntax import Between, Bin, Fn, IsNull, Like, Lit, Logic, Neg, Node, Not, Param

Value = int | float | str | None


def _whole(x: int) -> int | float:
    return x if INT64_MIN <= x <= INT64_MAX else float(x)


def compare(a: Value, b: Value) -> int:
    """The total order of values that aren't NULL: numbers before text, NaN equal to all numbers."""
    if isinstance(a, str) != isinstance(b, str):
        return 1 if isinstance(a, str) else -1
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    elif isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
    return (a > b) - (a < b)


def truth(v: Value) -> bool:
    return not isinstance(v, str) and v is not None and v != 0


def _logic(v: Value) -> bool | None:
    return None if v is None else truth(v)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return None
    if isinstance(a, int) and isinstance(b, int):
        if op in "+-*":
            return _whole({"+": a + b, "-": a - b, "*": a * b}[op])
        if b == 0:
            return None
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return _whole(q) if op == "/" else a - q * b
    a, b = float(a), float(b)
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    if b == 0:
        return None
    q = a / b
    if op == "/":
        return q
    return a - math.trunc(q) * b if abs(q) < 9e18 else None


def round_half_away(x: Value, digits: Value = 0) -> Value:
    if x is None or digits is None or isinstance(x, str) or isinstance(digits, str):
        return None
    n = int(max(0, min(15, digits)))
    x = float(x)
    y = x * 10.0**n
    if not math.isfinite(y) or abs(y) >= 9e15:
        return x
    return math.trunc(y - 0.5 if y < 0 else y + 0.5) / 10.0**n


def like(a: Value, pattern: Value) -> bool | None:
    if not isinstance(a, str) or not isinstance(pattern, str):
        return None
    regex = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern)
    return re.fullmatch(regex, a, re.S | re.I | re.A) is not None


def call(name: str, args: list[Value]) -> Value:
    x = args[0]
    number = isinstance(x, (int, float))
    if name == "ABS":
        return (_whole(abs(x)) if isinstance(x, int) else abs(x)) if number else None
    if name == "ROUND":
        return round_half_away(*args)
    if name == "LENGTH":
        return None if x is None else len((x if isinstance(x, str) else str(x) if isinstance(x, int) else format_real(x)).encode())
    if not isinstance(x, str):
        return x
    return "".join(c.lower() if name == "LOWER" and c.isascii() else c.upper() if name == "UPPER" and c.isascii() else c for c in x)


def evaluate(e: Node, params: list[Value] | None = None) -> Value:
    ev = lambda x: evaluate(x, params)
    flag = lambda x: None if x is None else int(x)
    match e:
        case Lit(value):
            return value
        case Param(index):
            if params is None or index >= len(params):
                raise MisuseError("a parameter has no value")
            return params[index]
        case Neg(a):
            v = ev(a)
            return None if v is None or isinstance(v, str) else _whole(-v) if isinstance(v, int) else -v
        case Not(a):
            v = _logic(ev(a))
            return None if v is None else int(not v)
        case Logic(op, a, b):
            x = _logic(ev(a))
            if x is not None and x == (op == "OR"):
                return int(x)
            y = _logic(ev(b))
            if y is not None and y == (op == "OR"):
                return int(y)
            return None if x is None or y is None else int(y)
        case IsNull(a, negated):
            return int((ev(a) is None) != negated)
        case Between(a, low, high, negated):
            v = [ev(a), ev(low), ev(high)]
            return None if None in v else int((compare(v[0], v[1]) >= 0 and compare(v[0], v[2]) <= 0) != negated)
        case Like(a, pattern, negated):
            v = like(ev(a), ev(pattern))
            return None if v is None else int(v != negated)
        case Bin(op, a, b) if op in "+-*/%":
            return arithmetic(op, ev(a), ev(b))
        case Bin(op, a, b):
            x, y = ev(a), ev(b)
            if x is None or y is None:
                return None
            c = compare(x, y)
            return flag({"=": c == 0, "<>": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op])
        case Fn(name, args):
            return call(name, [ev(x) for x in args])
    raise MisuseError("not a constant")
