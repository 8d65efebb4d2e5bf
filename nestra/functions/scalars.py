"""Scalar functions with IEEE division, floor division, wrapping bytes and NaN unequal to itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def eq(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def ne(a: Column, b: Column) -> Column:
    return ~eq(a, b)


def divide(a: Column, b: Column) -> Column:
    """IEEE: x/0 is an infinity with the sign of x, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)


def recip(a: Column) -> Column:
    return divide(F.lit(1.0), a)


def floor_mod(a: Column, b: Column) -> Column:
    """The sign is that of the divisor."""
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def floor_div(a: Column, b: Column) -> Column:
    """Exact for all integers: division in whole numbers, which cuts off towards zero, with a correction."""
    cut = F.call_function("div", a, b)
    return F.when((a % b != 0) & ((a < 0) != (b < 0)), cut - 1).otherwise(cut).cast("bigint")


def log(a: Column) -> Column:
    return F.when(a == 0, -INF).when(a < 0, NAN).otherwise(F.log(a))


def log_base(base: Column, a: Column) -> Column:
    return divide(log(a), log(base))


def isqrt(a: Column) -> Column:
    return F.floor(F.sqrt(a))


def byte(a: Column) -> Column:
    """Modulo 256 in a smallint."""
    return F.pmod(a.cast("bigint"), F.lit(256)).cast("smallint")


def byte_negate(a: Column) -> Column:
    return byte(-a.cast("bigint"))


def truncate(a: Column) -> Column:
    return a.cast("bigint")


def round_even(a: Column) -> Column:
    return F.rint(a).cast("bigint")


def ordering(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0).cast("tinyint")


def from_bool(a: Column) -> Column:
    return a.cast("int")


def to_bool(a: Column) -> Column:
    return a != 0


# --- comparisons; NaN compares as false, where Spark has it equal to itself and above everything


def _ordered(a: Column, b: Column) -> Column:
    return ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def lt(a: Column, b: Column) -> Column:
    return (a < b) & _ordered(a, b)


def le(a: Column, b: Column) -> Column:
    return (a <= b) & _ordered(a, b)


def gt(a: Column, b: Column) -> Column:
    return lt(b, a)


def ge(a: Column, b: Column) -> Column:
    return le(b, a)


def minimum(a: Column, b: Column) -> Column:
    """``a`` if it is at most ``b``, else ``b``, also if ``a`` is NaN."""
    return F.when(le(a, b), a).otherwise(b)


def maximum(a: Column, b: Column) -> Column:
    return F.when(le(a, b), b).otherwise(a)


def is_lt(o: Column) -> Column:
    return o == -1


def is_eq(o: Column) -> Column:
    return o == 0


def is_gt(o: Column) -> Column:
    return o == 1


# --- 64-bit integers that wrap, whether the session raises on overflow or not


def wrap(a: Column) -> Column:
    """A decimal integer modulo 2**64, as a signed long."""
    whole = F.lit(str(1 << 64)).cast("decimal(20,0)")
    r = F.pmod(a.cast("decimal(38,0)"), whole)
    return F.when(r >= F.lit(str(1 << 63)).cast("decimal(20,0)"), r - whole).otherwise(r).cast("bigint")


def _wide(a: Column) -> Column:
    return a.cast("bigint").cast("decimal(19,0)")


def add(a: Column, b: Column) -> Column:
    return wrap(_wide(a) + _wide(b))


def subtract(a: Column, b: Column) -> Column:
    return wrap(_wide(a) - _wide(b))


def multiply(a: Column, b: Column) -> Column:
    return wrap(_wide(a) * _wide(b))


def negate(a: Column) -> Column:
    """The least integer is its own negative."""
    return wrap(-_wide(a))


def absolute(a: Column) -> Column:
    return F.when(a < 0, negate(a)).otherwise(a.cast("bigint"))


# --- bytes and single floats


def byte_add(a: Column, b: Column) -> Column:
    return byte(a.cast("bigint") + b.cast("bigint"))


def byte_subtract(a: Column, b: Column) -> Column:
    return byte(a.cast("bigint") - b.cast("bigint"))


def byte_multiply(a: Column, b: Column) -> Column:
    return byte(a.cast("bigint") * b.cast("bigint"))


def byte_of(a: Column) -> Column:
    """An integer as a byte."""
    return byte(a)


def to_int(a: Column) -> Column:
    return a.cast("bigint")


def from_int(a: Column, kind: str = "double") -> Column:
    return byte(a) if kind == "byte" else a.cast(kind)


def ceiling(a: Column) -> Column:
    return F.ceil(a).cast("bigint")


def floor(a: Column) -> Column:
    return F.floor(a).cast("bigint")


# --- reals: what Spark leaves null outside the domain is NaN

PI = 3.141592653589793  # fixed value


def pi() -> Column:
    return F.lit(PI)


def _real(f):
    return lambda a: F.coalesce(f(a.cast("double")), F.when(a.isNotNull(), F.lit(NAN)))


sqrt, exp = _real(F.sqrt), _real(F.exp)
sin, cos, tan, asin, acos, atan = map(_real, (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan))
sinh, cosh, tanh, asinh, acosh, atanh = map(_real, (F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


# --- truth values and tuples


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def not_(a: Column) -> Column:
    return ~a


def otherwise() -> Column:
    return F.lit(True)


def tup(*parts: Column) -> Column:
    """A tuple of two to five (or more) parts: _1, _2, ..."""
    return F.struct(*(p.alias(f"_{i}") for i, p in enumerate(parts, 1)))
