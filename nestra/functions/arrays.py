"""Functions of ARRAY columns: the nested operators for segments that fit in a row. They need no shuffle.

Ranges that descend are empty, zips truncate, indices start at 0, and an index out of range is null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F


def singleton(x: Column) -> Column:
    return F.array(x)


def replicate(n: Column, x: Column) -> Column:
    return F.array_repeat(x, n.cast("int"))


def replicate_each(xs: Column, counts: Column) -> Column:
    return F.flatten(zip_with(lambda x, n: F.array_repeat(x, n.cast("int")), xs, counts))


def append(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)


def concat(xss: Column) -> Column:
    return F.flatten(xss)


def length(xs: Column) -> Column:
    return F.size(xs).cast("bigint")


def index(xs: Column, i: Column) -> Column:
    return F.get(xs, i.cast("int"))


def slice_array(xs: Column, start: Column, n: Column) -> Column:
    return F.slice(xs, start.cast("int") + 1, n.cast("int"))


def drop(xs: Column, n: Column) -> Column:
    return F.slice(xs, n.cast("int") + 1, F.greatest(F.lit(0), F.size(xs) - n.cast("int")))


def enum_from_to(a: Column, b: Column) -> Column:
    return F.when(b >= a, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))


def map_array(f: Callable[[Column], Column], xs: Column) -> Column:
    return F.transform(xs, f)


def _cut(xs: Column, ys: Column) -> tuple[Column, Column]:
    n = F.least(F.size(xs), F.size(ys))
    return F.slice(xs, 1, n), F.slice(ys, 1, n)


def zip_with(f: Callable[[Column, Column], Column], xs: Column, ys: Column) -> Column:
    return F.zip_with(*_cut(xs, ys), f)


def zip_arrays(xs: Column, ys: Column) -> Column:
    return zip_with(lambda x, y: F.struct(x.alias("_1"), y.alias("_2")), xs, ys)


def unzip(pairs: Column) -> tuple[Column, Column]:
    return F.transform(pairs, lambda p: p["_1"]), F.transform(pairs, lambda p: p["_2"])


def cross_map(xs: Column, f: Callable[[Column], Column]) -> Column:
    """Every x with every element of f(x)."""
    return F.flatten(F.transform(xs, lambda x: F.transform(f(x), lambda y: F.struct(x.alias("_1"), y.alias("_2")))))


def concat_map(f: Callable[[Column], Column], xs: Column) -> Column:
    return F.flatten(F.transform(xs, f))


def filter_array(p: Callable[[Column], Column], xs: Column) -> Column:
    return F.filter(xs, p)


def pack(xs: Column, flags: Column) -> Column:
    return F.filter(xs, lambda x, i: F.coalesce(F.get(flags, i), F.lit(False)))


def pick(xs: Column, value) -> Column:
    return F.transform(xs, lambda x: x == F.lit(value))


def combine(flags: Column, xs: Column, ys: Column) -> Column:
    """True takes the next of ``xs``, False of ``ys``."""
    trues = lambda i: F.size(F.filter(F.slice(flags, 1, i), lambda f: f))
    return F.transform(flags, lambda f, i: F.when(f, F.get(xs, trues(i))).otherwise(F.get(ys, i - trues(i))))


def interleave(xs: Column, ys: Column) -> Column:
    n = F.when(F.size(xs) > F.size(ys), 2 * F.size(ys) + 1).otherwise(2 * F.size(xs))
    return F.transform(_upto(n), lambda i: F.when(i % 2 == 0, F.get(xs, F.floor(i / 2).cast("int"))).otherwise(F.get(ys, F.floor(i / 2).cast("int"))))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def update(xs: Column, pairs: Column) -> Column:
    """``pairs`` of (ix, v); the last for an index wins."""
    of = lambda i: F.filter(pairs, lambda p: p["ix"] == i)
    return F.transform(xs, lambda x, i: F.when(F.size(of(i)) > 0, F.element_at(of(i), -1)["v"]).otherwise(x))


def bpermute(xs: Column, ix: Column) -> Column:
    return F.transform(ix, lambda i: F.get(xs, i.cast("int")))


def indexed(xs: Column) -> Column:
    return F.transform(xs, lambda x, i: F.struct(i.cast("bigint").alias("ix"), x.alias("v")))


def reverse(xs: Column) -> Column:
    return F.reverse(xs)


def fold(f: Callable[[Column, Column], Column], zero: Column, xs: Column) -> Column:
    return F.aggregate(xs, zero, f)


def fold1(f: Callable[[Column, Column], Column], xs: Column) -> Column:
    first = F.when(F.size(xs) == 0, F.raise_error(F.lit("fold1 of an empty array"))).otherwise(F.get(xs, F.lit(0)))
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), first, f)


def folds(f: Callable[[Column, Column], Column], zero: Column, xss: Column) -> Column:
    return F.transform(xss, lambda xs: F.aggregate(xs, zero, f))


def scan(f: Callable[[Column, Column], Column], zero: Column, xs: Column) -> Column:
    """Exclusive, of the same length."""
    step = lambda a, x: F.struct(F.concat(a["out"], F.array(a["at"])).alias("out"), f(a["at"], x).alias("at"))
    return F.aggregate(xs, F.struct(F.slice(F.array(zero), 1, 0).alias("out"), zero.alias("at")), step, lambda a: a["out"])


def scan_inclusive(f: Callable[[Column, Column], Column], xs: Column) -> Column:
    """Running folds from the first element on."""
    step = lambda out, x: F.concat(out, F.array(F.when(F.size(out) == 0, x).otherwise(f(F.get(out, F.size(out) - 1), x))))
    return F.aggregate(xs, F.slice(xs, 1, 0), step)


def fold_right(f: Callable[[Column, Column], Column], zero: Column, xs: Column) -> Column:
    """``f(x, rest)`` from the last element back."""
    return F.aggregate(F.reverse(xs), zero, lambda a, x: f(x, a))


def sum_array(xs: Column, zero=0.0) -> Column:
    return F.aggregate(xs, F.lit(zero), lambda a, x: a + x)


def min_index(xs: Column) -> Column:
    return (F.array_position(xs, F.array_min(xs)) - 1).cast("bigint")


def max_index(xs: Column) -> Column:
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("bigint")


def and_array(xs: Column) -> Column:
    return F.forall(xs, lambda x: x)


def or_array(xs: Column) -> Column:
    return F.exists(xs, lambda x: x)


def take(n: Column, xs: Column) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(n.cast("int"), F.lit(0)))


def contains(xs: Column, value) -> Column:
    return F.exists(xs, lambda x: x == value)


def lookup(key: Column, pairs: Column) -> Column:
    """The value of the first of ``pairs`` (k, v) with this key, else null."""
    return F.get(F.filter(pairs, lambda p: p["k"] == key), F.lit(0))["v"]


def cross(xs: Column, ys: Column) -> Column:
    """All pairs (a, b); the first index varies fastest."""
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("a"), y.alias("b")))))


def index_of(p: Callable[[Column], Column], xs: Column) -> Column:
    """Positions of the matches."""
    return F.transform(F.filter(indexed(xs), lambda e: p(e["v"])), lambda e: e["ix"])


def search(text: Column, pattern: str) -> Column:
    """0-based starts of all occurrences, overlapping ones too."""
    if not pattern:
        return _upto(F.char_length(text) + 1)
    quoted = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    # one pass cuts the text before each occurrence; a piece starts where the lengths before it end
    sizes = F.transform(F.split(text, f"(?={quoted})"), lambda p: F.char_length(p).cast("long"))
    empty = F.array().cast("array<bigint>")
    ends = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("ends")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["ends"], F.array(s["at"] + n)).alias("ends")),
        lambda s: s["ends"],
    )
    first = F.when(text.startswith(pattern), F.array(F.lit(0).cast("long"))).otherwise(empty)
    return F.concat(first, F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


# --- directed folds and scans: the function need not be associative


def fold_left1(f: Callable[[Column, Column], Column], xs: Column) -> Column:
    return fold1(f, xs)


def fold_right1(f: Callable[[Column, Column], Column], xs: Column) -> Column:
    """``f(x, rest)`` from the last element back, which is the start."""
    return fold1(lambda a, x: f(x, a), F.reverse(xs))


def scan_left(f: Callable[[Column, Column], Column], zero: Column, xs: Column) -> Column:
    """Element i holds the fold of all before it: exclusive, of the same length."""
    return scan(f, zero, xs)


def scan_left1(f: Callable[[Column, Column], Column], xs: Column) -> Column:
    return scan_inclusive(f, xs)


def scan_right(f: Callable[[Column, Column], Column], zero: Column, xs: Column) -> Column:
    """Element i holds the fold of all behind it."""
    return F.reverse(scan(lambda a, x: f(x, a), zero, F.reverse(xs)))


def scan_right1(f: Callable[[Column, Column], Column], xs: Column) -> Column:
    return F.reverse(scan_inclusive(lambda a, x: f(x, a), F.reverse(xs)))


# --- prefixes, emptiness, permutations, wider zips


def is_empty(xs: Column) -> Column:
    return F.size(xs) == 0


def split_at(n: Column, xs: Column) -> tuple[Column, Column]:
    return take(n, xs), drop(xs, F.greatest(n.cast("int"), F.lit(0)))


def _prefix(p: Callable[[Column], Column], xs: Column) -> Column:
    """Number of elements before the first that fails."""
    return F.coalesce(F.get(index_of(lambda x: ~F.coalesce(p(x), F.lit(False)), xs), F.lit(0)), F.size(xs).cast("bigint"))


def span(p: Callable[[Column], Column], xs: Column) -> tuple[Column, Column]:
    return split_at(_prefix(p, xs), xs)


def take_while(p: Callable[[Column], Column], xs: Column) -> Column:
    return span(p, xs)[0]


def drop_while(p: Callable[[Column], Column], xs: Column) -> Column:
    return span(p, xs)[1]


def product_array(xs: Column, times: Callable[[Column, Column], Column] = lambda a, x: a * x, one=1.0) -> Column:
    return F.aggregate(xs, F.lit(one), times)


def maximum(xs: Column) -> Column:
    return F.array_max(xs)


def minimum(xs: Column) -> Column:
    return F.array_min(xs)


def enum_from_then_to(a: Column, then: Column, to: Column) -> Column:
    """a, then, ... up to ``to``, or down to it; empty if ``to`` lies on the other side."""
    step = then - a
    some = F.when(step > 0, to >= a).when(step < 0, to <= a).otherwise(F.lit(False))
    return F.when(some, F.sequence(a, F.when(some, to).otherwise(a), F.when(some, step).otherwise(F.lit(1).cast("bigint")))).otherwise(F.array().cast("array<bigint>"))


def permute_default(ix: Column, xs: Column, default: Column) -> Column:
    """``default`` with xs[i] at position ix[i]; the last write wins."""
    return update(default, zip_with(lambda i, x: F.struct(i.alias("ix"), x.alias("v")), ix, xs))


def permute(ix: Column, xs: Column) -> Column:
    """``ix`` is a permutation."""
    return permute_default(ix, xs, xs)


def zip_many(*arrays: Column) -> Column:
    """Structs _1, _2, ... up to the shortest array."""
    n = F.least(*map(F.size, arrays))
    return F.transform(_upto(n), lambda i: F.struct(*(F.get(xs, i).alias(f"_{k}") for k, xs in enumerate(arrays, 1))))


def unzip_many(tuples: Column, n: int) -> tuple[Column, ...]:
    return tuple(F.transform(tuples, partial(_part, f"_{k}")) for k in range(1, n + 1))


def _part(name: str, t: Column) -> Column:
    return t[name]


def zip_with_many(f: Callable[..., Column], *arrays: Column) -> Column:
    n = F.least(*map(F.size, arrays))
    return F.transform(_upto(n), lambda i: f(*(F.get(xs, i) for xs in arrays)))
