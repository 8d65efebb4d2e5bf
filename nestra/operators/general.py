"""Folds and scans with any associative function, in the order of positions, and the directed ones.

An array is cut into chunks of ``CHUNK`` elements; a chunk folds or scans its elements in one row, the chunks' totals
are an array again, and so on until one chunk is left: no task holds more than a chunk, and the function need not be
commutative. ``zero`` is neutral for the function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

CHUNK = 256
Combine = Callable[[Column, Column], Column]


def _chunks(xs: DataFrame, chunk: int, *by: str) -> DataFrame:
    """(by, pos, vs): runs of ``chunk`` values, numbered."""
    kept = xs.groupBy(*by, F.floor(F.col("pos") / chunk).cast("long").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_vs"))
    return kept.select(*by, F.col("_c").alias("pos"), F.transform("_vs", lambda e: e["v"]).alias("vs"))


def _zero(xs: DataFrame, zero) -> Column:
    return F.lit(zero).cast(xs.schema["v"].dataType)


def fold_s(f: Combine, zero, elems: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(seg, pos, v) to (seg, v) of the segments that have elements."""
    z = _zero(elems, zero)
    while True:
        cut = _chunks(elems, chunk, "seg")
        elems = cut.select("seg", "pos", A.fold(f, z, F.col("vs")).alias("v"))
        if not elems.where("pos > 0").limit(1).count():
            return elems.select("seg", "v")


def fold(f: Combine, zero, xs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row; ``zero`` for the empty array."""
    one = fold_s(f, zero, xs.withColumn("seg", F.lit(0)), chunk)
    return one.agg(F.coalesce(F.max(F.struct("v")), F.struct(_zero(xs, zero).alias("v")))["v"].alias("v"))


def fold1_maybe(f: Combine, xs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row: the fold without a neutral element, null for the empty array."""
    while True:
        xs = _chunks(xs, chunk).select("pos", A.fold1(f, F.col("vs")).alias("v"))
        if not xs.where("pos > 0").limit(1).count():
            return xs.agg(F.max(F.struct("v"))["v"].alias("v"))


def scan(f: Combine, zero, xs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Exclusive scan: element i holds the fold of all before it."""
    z = _zero(xs, zero)
    cut = _chunks(xs, chunk)
    totals = cut.select("pos", A.fold(f, z, F.col("vs")).alias("v"))
    local = cut.select(F.col("pos").alias("_c"), F.posexplode(A.scan(f, z, F.col("vs"))).alias("_i", "_v"))
    if totals.where("pos > 0").limit(1).count():
        before = scan(f, zero, totals, chunk).select(F.col("pos").alias("_c"), F.col("v").alias("_before"))
        local = local.join(before, "_c").withColumn("_v", f(F.col("_before"), F.col("_v")))
    return local.select((F.col("_c") * chunk + F.col("_i")).alias("pos"), F.col("_v").alias("v"))


def scan_inclusive(f: Combine, zero, xs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Element i holds the fold up to and with itself."""
    before = scan(f, zero, xs, chunk).withColumnRenamed("v", "_before")
    return before.join(xs, "pos").select("pos", f(F.col("_before"), F.col("v")).alias("v"))


def scan_result(f: Combine, zero, xs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The exclusive scan and the fold of everything."""
    return scan(f, zero, xs, chunk), fold(f, zero, xs, chunk)


def carry(f: Combine, zero, chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """Chunks (seg, pos, v) where a flagged chunk (seg, carries) hands its last element on: it leaves the chunk and is
    combined with the first element of the next chunk that has any; what is handed on from the last is in chunk -1.

    A run of flagged chunks of one element hands a combined value on; the runs are folded by segment.
    """
    sizes = flags.join(chunks.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.max_by("v", "pos").alias("last")), "seg", "left")
    sizes = sizes.select("seg", "carries", F.coalesce("n", F.lit(0)).alias("n"), "last")
    z = _zero(chunks, zero)
    # a state is (does it reset what came before, value): associative, so chunks' states are scanned
    gives = F.when((F.col("n") > 0) & F.col("carries"), F.col("last")).otherwise(z)
    resets = (F.col("n") > 1) | ((F.col("n") > 0) & ~F.col("carries"))
    states = sizes.select(F.col("seg").alias("pos"), F.struct(resets.alias("r"), gives.alias("v")).alias("v"))
    after = lambda a, b: F.struct((a["r"] | b["r"]).alias("r"), F.when(b["r"], b["v"]).otherwise(f(a["v"], b["v"])).alias("v"))
    kind = states.schema["v"].dataType
    start = F.struct(F.lit(False).alias("r"), z.alias("v")).cast(kind)
    into = _scan_with(after, start, states)
    held = chunks.join(sizes.select("seg", "carries", "n"), "seg").join(into.select(F.col("pos").alias("seg"), F.col("v.v").alias("_in")), "seg")
    first = F.col("pos") == 0
    kept = held.where(~F.col("carries") | (F.col("pos") < F.col("n") - 1))
    kept = kept.select("seg", "pos", F.when(first, f(F.col("_in"), F.col("v"))).otherwise(F.col("v")).alias("v"))
    rest = _fold_with(after, start, states).select(F.lit(-1).cast("long").alias("seg"), F.lit(0).cast("long").alias("pos"), F.col("v.v").alias("v"))
    return kept.unionByName(rest)


def _scan_with(f: Combine, zero: Column, xs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    cut = _chunks(xs, chunk)
    totals = cut.select("pos", A.fold(f, zero, F.col("vs")).alias("v"))
    local = cut.select(F.col("pos").alias("_c"), F.posexplode(A.scan(f, zero, F.col("vs"))).alias("_i", "_v"))
    if totals.where("pos > 0").limit(1).count():
        before = _scan_with(f, zero, totals, chunk).select(F.col("pos").alias("_c"), F.col("v").alias("_before"))
        local = local.join(before, "_c").withColumn("_v", f(F.col("_before"), F.col("_v")))
    return local.select((F.col("_c") * chunk + F.col("_i")).alias("pos"), F.col("_v").alias("v"))


def _fold_with(f: Combine, zero: Column, xs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    while True:
        xs = _chunks(xs, chunk).select("pos", A.fold(f, zero, F.col("vs")).alias("v"))
        if not xs.where("pos > 0").limit(1).count():
            return xs.select("v")


def maximum_by(key: Callable[[Column], Column], xs: DataFrame) -> DataFrame:
    """The element with the largest key, the last of equals; no row for the empty array."""
    return xs.agg(F.max_by(F.struct("v"), F.struct(key(F.col("v")).alias("k"), "pos"))["v"].alias("v"), F.count(F.lit(1)).alias("_n")).where("_n > 0").select("v")


def minimum_by(key: Callable[[Column], Column], xs: DataFrame) -> DataFrame:
    """The element with the smallest key, the first of equals."""
    return xs.agg(F.min_by(F.struct("v"), F.struct(key(F.col("v")).alias("k"), "pos"))["v"].alias("v"), F.count(F.lit(1)).alias("_n")).where("_n > 0").select("v")


def span(p: Callable[[Column], Column], xs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The longest prefix whose elements match, and the rest."""
    from .flat import drop_while, take_while

    return take_while(p, xs), drop_while(p, xs)


def split_at(xs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    from .flat import drop, extract

    return extract(xs, 0, max(n, 0)), drop(xs, max(n, 0))


def permute_default(xs: DataFrame, ix: DataFrame, default: DataFrame) -> DataFrame:
    """``default`` with xs[i] at position ix[i]; the last write wins."""
    from .flat import update, zip_arrays

    return update(default, zip_arrays(xs, ix).select("pos", F.col("v2").alias("ix"), F.col("v1").alias("v")))


def is_empty(xs: DataFrame) -> DataFrame:
    return xs.limit(1).agg((F.count(F.lit(1)) == 0).alias("v"))


def normal_form(xs: DataFrame) -> DataFrame:
    """Evaluates every element; returns the array."""
    xs.write.format("noop").mode("overwrite").save()
    return xs
