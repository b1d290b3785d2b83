"""The language's scalar rules as Column helpers, usable with any DataFrame.

Whole numbers are LONG and reals DOUBLE. With ``promote=True`` whole-number arithmetic gives a DOUBLE that
holds the value where 64 bits overflow; without it ANSI mode raises there, never a silent NULL.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = string.ascii_lowercase, string.ascii_uppercase


def add(a: Column, b: Column, promote: bool = False) -> Column:
    return _whole(a, b, "+", promote)


def subtract(a: Column, b: Column, promote: bool = False) -> Column:
    return _whole(a, b, "-", promote)


def multiply(a: Column, b: Column, promote: bool = False) -> Column:
    return _whole(a, b, "*", promote)


def _whole(a: Column, b: Column, op: str, promote: bool) -> Column:
    plain = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op]
    if not promote:
        return plain(a, b)
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    return F.coalesce(tried.cast("double"), plain(a.cast("double"), b.cast("double")))


def divide_whole(a: Column, b: Column, promote: bool = False) -> Column:
    """Truncated toward zero; NULL for a zero divisor."""
    low = F.lit(-(1 << 63))
    # b is shielded from zero, and the one quotient that overflows from being computed
    over = (a == low) & (b == -1)
    out = F.call_function("div", F.when(over & F.lit(promote), F.lit(0)).otherwise(a), F.nullif(b, F.lit(0).cast("bigint")))
    return F.when(over, F.lit(2.0**63)).otherwise(out.cast("double")) if promote else out


def divide_real(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo_whole(a: Column, b: Column) -> Column:
    """Sign of the dividend; NULL for a zero divisor."""
    return F.try_mod(a, b)


def modulo_real(a: Column, b: Column) -> Column:
    """a - trunc(a / b) * b; NULL for a zero divisor or a quotient of 9e18 or more."""
    a, b = a.cast("double"), b.cast("double")
    q = F.try_divide(a, b)
    return F.when(F.abs(q) < 9e18, a - q.cast("bigint").cast("double") * b)


def negate(a: Column, static: str, promote: bool = False) -> Column:
    if static == "real" or not promote:
        return -a
    return F.coalesce(F.try_subtract(F.lit(0).cast("bigint"), a).cast("double"), -a.cast("double"))


def absolute(a: Column, static: str, promote: bool = False) -> Column:
    if static == "real":
        return F.abs(a)
    if not promote:
        return F.abs(a)
    low = a == F.lit(-(1 << 63))
    return F.when(low, F.lit(2.0**63)).otherwise(F.abs(F.when(~low, a)).cast("double"))


def round_half_away(x: Column, digits: Column | int = 0) -> Column:
    """trunc(x * 10^n +- 0.5) / 10^n in binary, n from 0 to 15; values too large for it stay as they are."""
    x = x.cast("double")
    n = F.lit(digits) if isinstance(digits, int) else digits
    p = F.pow(F.lit(10.0), F.least(F.greatest(n.cast("double"), F.lit(0.0)), F.lit(15.0)).cast("int").cast("double"))
    y = x * p
    small = F.abs(y) < 9e15
    moved = F.when(y < 0, y - 0.5).otherwise(y + 0.5)
    return F.when(x.isNull() | n.isNull(), F.lit(None).cast("double")).when(small, F.when(small, moved).cast("bigint").cast("double") / p).otherwise(x)


def byte_length(a: Column, static: str) -> Column:
    """Bytes of a text, or of a number as it is printed."""
    if static == "text":
        return F.octet_length(a).cast("bigint")
    if static == "int":
        return F.octet_length(a.cast("string")).cast("bigint")
    return F.octet_length(print_real(a)).cast("bigint")


def print_real(a: Column) -> Column:
    """A real as printed: the shortest digits that read back, an exponent below 1e-4 or beyond the precision."""
    a = a.cast("double")
    is_float = a == a.cast("float").cast("double")
    java = F.when(is_float, a.cast("float").cast("string")).otherwise(a.cast("string"))
    bare = F.regexp_replace(F.regexp_replace(java, r"E.*$", ""), r"\.0$", "")
    digits = F.regexp_replace(F.regexp_replace(F.replace(F.replace(bare, F.lit(".")), F.lit("-")), "^0+", ""), "0+$", "")
    n = F.greatest(F.lit(1), F.length(digits))
    power = F.when(a == 0, 0).otherwise(F.floor(F.log10(F.abs(a)))).cast("int")
    precision = F.when(is_float, F.greatest(F.lit(6), n)).otherwise(F.when(n <= 15, 15).otherwise(17))
    sign = F.when(a < 0, "-").otherwise("")
    mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), digits.substr(F.lit(2), n)))
    far = F.concat(sign, mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    whole = F.concat(F.floor(F.abs(a)).cast("string"), F.lit(".0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    near = F.concat(sign, F.when(F.abs(a) == F.floor(F.abs(a)), whole).when(power < 0, small).otherwise(F.replace(java, F.lit("-"))))
    return F.when(F.isnan(a) | (F.abs(a) == float("inf")), F.lower(F.regexp_replace(java, "inity", ""))).when((a != 0) & ((power < -4) | (power >= precision)), far).otherwise(near)


def lower_ascii(a: Column) -> Column:
    return F.translate(a, UPPER, LOWER)


def upper_ascii(a: Column) -> Column:
    return F.translate(a, LOWER, UPPER)


def like(a: Column, pattern: Column) -> Column:
    """% any run, _ one character, ASCII case-insensitive, no escape character."""
    return F.like(lower_ascii(a), F.replace(lower_ascii(pattern), F.lit("\\"), F.lit("\\\\")))


def between(a: Column, low: Column, high: Column) -> Column:
    """NULL as soon as one operand is, also under NOT."""
    return F.when(a.isNull() | low.isNull() | high.isNull(), F.lit(None).cast("boolean")).otherwise((a >= low) & (a <= high))


def bucket(time: Column, width: int) -> Column:
    """The time's interval of ``width`` units: time / width truncated toward zero."""
    return divide_whole(time.cast("bigint"), F.lit(width).cast("bigint"))


def sum_promoting(a: Column) -> Column:
    """A sum of whole numbers as DOUBLE: exact while 64 bits hold it, the sum of reals beyond."""
    return F.coalesce(F.try_sum(a).cast("double"), F.sum(a.cast("double")))
