"""Flat arrays: DataFrames (pos BIGINT, v). Positions are dense from 0; every operator keeps them so.

Zips truncate to the shorter array, folds of the empty array give the neutral element, scans are exclusive, and
of several writes to one position the last wins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.positions import exclusive_extreme, exclusive_sum, rebase

# --- constructors and enumerations


def empty(spark: SparkSession, kind: str = "bigint") -> DataFrame:
    return spark.createDataFrame([], f"pos bigint, v {kind}")


def generate(spark: SparkSession, n: int, f: Callable[[Column], Column]) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), f(F.col("id")).alias("v"))


def replicate(spark: SparkSession, n: int, value) -> DataFrame:
    return generate(spark, n, lambda _: F.lit(value))


def from_list(spark: SparkSession, values: Sequence, kind: str = "bigint") -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"pos bigint, v {kind}")


def to_list(xs: DataFrame) -> list:
    return [r["v"] for r in xs.orderBy("pos").collect()]


def enum_from_to(spark: SparkSession, a: int, b: int) -> DataFrame:
    """a..b, both included; empty if b < a."""
    return enum_from_step_len(spark, a, 1, max(0, b - a + 1))


def enum_from_then_to(spark: SparkSession, a: int, then: int, to: int) -> DataFrame:
    step = then - a
    n = 0 if step == 0 and to < a else (to - a) // step + 1 if step else 1
    return enum_from_step_len(spark, a, step, max(0, n))


def enum_from_step_len(spark: SparkSession, start: int, step: int, n: int) -> DataFrame:
    return generate(spark, n, lambda i: F.lit(start) + i * step)


def enum_from_step_len_each(triples: DataFrame) -> DataFrame:
    """(pos, start, step, len) to one range per row, concatenated."""
    rows = exclusive_sum(triples, F.col("len"), "_at").where("len > 0")
    return rows.select(F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("_i", "_k"), "_at", "start", "step").select(
        (F.col("_at") + F.col("_i")).alias("pos"), (F.col("start") + F.col("_k") * F.col("step")).alias("v")
    )


def enum_from_to_each(pairs: DataFrame) -> DataFrame:
    """(pos, a, b) to the inclusive ranges a..b, concatenated; descending pairs are empty."""
    return enum_from_step_len_each(pairs.select("pos", F.col("a").alias("start"), F.lit(1).alias("step"), F.greatest(F.lit(0), F.col("b") - F.col("a") + 1).alias("len")))


def randoms(spark: SparkSession, n: int, seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """n uniform values in [low, high), the same for a seed however the work is divided."""
    bits = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), i), 11) / float(1 << 53)
    return generate(spark, n, lambda i: F.lit(low) + bits(i) * (high - low))


# --- replication and concatenation


def replicate_each(xs: DataFrame, counts: DataFrame) -> DataFrame:
    """Element i as often as counts says (0 drops it)."""
    rows = exclusive_sum(zip_arrays(xs, counts), F.col("v2"), "_at").where("v2 > 0")
    return rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("v2") - 1)).alias("_k"), "_at", "v1").select((F.col("_at") + F.col("_k")).alias("pos"), F.col("v1").alias("v"))


def replicate_regular(xs: DataFrame, n: int) -> DataFrame:
    """Every element n times."""
    return xs.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k"), "pos", "v").select((F.col("pos") * n + F.col("_k")).alias("pos"), "v") if n > 0 else xs.limit(0)


def repeat(xs: DataFrame, n: int) -> DataFrame:
    """The whole array n times."""
    if n <= 0:
        return xs.limit(0)
    size = xs.agg(F.count(F.lit(1)).alias("_n"))
    times = xs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return times.crossJoin(F.broadcast(size)).select((F.col("_k") * F.col("_n") + F.col("pos")).alias("pos"), "v")


def append(xs: DataFrame, ys: DataFrame) -> DataFrame:
    size = xs.agg(F.count(F.lit(1)).alias("_n"))
    return xs.select("pos", "v").unionByName(ys.crossJoin(F.broadcast(size)).select((F.col("pos") + F.col("_n")).alias("pos"), "v"))


def interleave(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """x0 y0 x1 y1 ... until an element is missing."""
    size = F.broadcast(xs.agg(F.count(F.lit(1)).alias("_a")).crossJoin(ys.agg(F.count(F.lit(1)).alias("_b"))))
    left = xs.crossJoin(size).where("pos <= _b").select((F.col("pos") * 2).alias("pos"), "v")
    return left.unionByName(ys.crossJoin(size).where("pos < _a").select((F.col("pos") * 2 + 1).alias("pos"), "v"))


# --- projections, gather and scatter


def length(xs: DataFrame) -> DataFrame:
    return xs.agg(F.count(F.lit(1)).alias("v"))


def index(xs: DataFrame, i: int) -> DataFrame:
    """One row with the element, none if there is no such position."""
    return xs.where(F.col("pos") == i).select("v")


def indexed(xs: DataFrame) -> DataFrame:
    return xs.select("pos", F.struct(F.col("pos").alias("ix"), "v").alias("v"))


def extract(xs: DataFrame, start: int, n: int) -> DataFrame:
    return xs.where((F.col("pos") >= start) & (F.col("pos") < start + n)).select((F.col("pos") - start).alias("pos"), "v")


def drop(xs: DataFrame, n: int) -> DataFrame:
    return xs.where(F.col("pos") >= n).select((F.col("pos") - n).alias("pos"), "v")


def take_while(p: Callable[[Column], Column], xs: DataFrame) -> DataFrame:
    """The elements before the first that fails."""
    return _split_where(p, xs).where("_first is null or pos < _first").select("pos", "v")


def drop_while(p: Callable[[Column], Column], xs: DataFrame) -> DataFrame:
    """From the first element that fails on."""
    return _split_where(p, xs).where("pos >= _first").select((F.col("pos") - F.col("_first")).alias("pos"), "v")


def _split_where(p: Callable[[Column], Column], xs: DataFrame) -> DataFrame:
    first = xs.where(~F.coalesce(p(F.col("v")), F.lit(False))).agg(F.min("pos").alias("_first"))
    return xs.crossJoin(F.broadcast(first))


def reverse(xs: DataFrame) -> DataFrame:
    last = F.broadcast(xs.agg((F.count(F.lit(1)) - 1).alias("_last")))
    return xs.crossJoin(last).select((F.col("_last") - F.col("pos")).alias("pos"), "v")


def bpermute(xs: DataFrame, ix: DataFrame) -> DataFrame:
    """Gather: result[i] = xs[ix[i]]. AQE picks the side to broadcast by size."""
    return ix.select("pos", F.col("v").alias("_ix")).join(xs.select(F.col("pos").alias("_ix"), "v"), "_ix").select("pos", "v")


def mbpermute(f: Callable[[Column], Column], xs: DataFrame, ix: DataFrame) -> DataFrame:
    return bpermute(xs, ix).select("pos", f(F.col("v")).alias("v"))


def permute(xs: DataFrame, ix: DataFrame) -> DataFrame:
    """Scatter: result[ix[i]] = xs[i]; the last write wins, positions never written are absent."""
    return zip_arrays(xs, ix).groupBy(F.col("v2").alias("pos")).agg(F.max_by("v1", "pos").alias("v"))


def update(xs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` is (pos, ix, v); the last pair for an index wins."""
    last = pairs.groupBy("ix").agg(F.max_by(F.struct("v"), "pos").alias("_new"))
    hit = xs.join(last, F.col("pos") == F.col("ix"), "left")
    return hit.select("pos", F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col("v")).alias("v"))


def bpermute_default(spark: SparkSession, n: int, f: Callable[[Column], Column], pairs: DataFrame) -> DataFrame:
    """f(i) for all i below n, overwritten by ``pairs`` (pos, ix, v)."""
    return update(generate(spark, n, f), pairs)


def zip_arrays(*arrays: DataFrame) -> DataFrame:
    """(pos, v1, v2, ...) up to the shortest array: equi-joins on the position."""
    named = [xs.select("pos", F.col("v").alias(f"v{i}")) for i, xs in enumerate(arrays, 1)]
    return reduce(lambda a, b: a.join(b, "pos"), named)


def unzip(pairs: DataFrame, *fields: str) -> tuple[DataFrame, ...]:
    return tuple(pairs.select("pos", F.col(f"v.{f}").alias("v")) for f in fields)


def fsts(pairs: DataFrame) -> DataFrame:
    return pairs.select("pos", F.col(f"v.{pairs.schema['v'].dataType.names[0]}").alias("v"))


def snds(pairs: DataFrame) -> DataFrame:
    return pairs.select("pos", F.col(f"v.{pairs.schema['v'].dataType.names[1]}").alias("v"))


# --- maps, filters and merges


def map_array(f: Callable[[Column], Column], xs: DataFrame) -> DataFrame:
    return xs.select("pos", f(F.col("v")).alias("v"))


def zip_with(f: Callable[..., Column], *arrays: DataFrame) -> DataFrame:
    return zip_arrays(*arrays).select("pos", f(*(F.col(f"v{i}") for i in range(1, len(arrays) + 1))).alias("v"))


def filter_array(p: Callable[[Column], Column], xs: DataFrame) -> DataFrame:
    return rebase(xs.where(p(F.col("v")))).select("pos", "v")


def pack(xs: DataFrame, flags: DataFrame) -> DataFrame:
    return rebase(zip_arrays(xs, flags).where("v2")).select("pos", F.col("v1").alias("v"))


def pack_by_tag(xs: DataFrame, tags: DataFrame, tag: int) -> DataFrame:
    return rebase(zip_arrays(xs, tags).where(F.col("v2") == tag)).select("pos", F.col("v1").alias("v"))


def pick(xs: DataFrame, value) -> DataFrame:
    return xs.select("pos", (F.col("v") == F.lit(value)).alias("v"))


def selector(tags: DataFrame) -> DataFrame:
    """(pos, tag, src_ix): for each position its source array and the index there."""
    both = exclusive_sum(tags.select("pos", F.col("v").cast("int").alias("tag")), F.col("tag").cast("long"), "_ones")
    return both.select("pos", "tag", F.when(F.col("tag") == 1, F.col("_ones")).otherwise(F.col("pos") - F.col("_ones")).alias("src_ix"))


def selector_counts(sel: DataFrame) -> DataFrame:
    return sel.agg(F.count_if(F.col("tag") == 0).alias("elements_0"), F.count_if(F.col("tag") == 1).alias("elements_1"))


def combine2(tags: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Tag 0 takes the next element of ``xs``, tag 1 of ``ys``."""
    both = xs.select(F.lit(0).alias("tag"), F.col("pos").alias("src_ix"), "v").unionByName(ys.select(F.lit(1).alias("tag"), F.col("pos").alias("src_ix"), "v"))
    return selector(tags).join(both, ["tag", "src_ix"]).select("pos", "v")


def combine(flags: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """True takes the next element of ``xs``, False of ``ys``."""
    return combine2(flags.select("pos", (~F.col("v")).cast("int").alias("v")), xs, ys)


# --- folds and scans


def fold(agg: Callable[[Column], Column], zero, xs: DataFrame) -> DataFrame:
    """``agg`` is an aggregate of an associative function; the empty array gives ``zero``."""
    return xs.agg(F.coalesce(agg(F.col("v")), F.lit(zero)).alias("v"))


def fold1(agg: Callable[[Column], Column], xs: DataFrame) -> DataFrame:
    """No neutral element: an empty array is an error when the result is read."""
    return xs.agg(F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("fold1 of an empty array"))).otherwise(agg(F.col("v"))).alias("v"))


def fold_regular(agg: Callable[[Column], Column], n: int, xs: DataFrame) -> DataFrame:
    """Each complete run of n elements; an incomplete tail is dropped."""
    runs = xs.groupBy(F.floor(F.col("pos") / n).alias("pos")).agg(agg(F.col("v")).alias("v"), F.count(F.lit(1)).alias("_n"))
    return runs.where(F.col("_n") == n).select("pos", "v")


def sum_array(xs: DataFrame) -> DataFrame:
    return fold(F.sum, 0, xs)


def product_array(xs: DataFrame) -> DataFrame:
    """Integers wrap at 64 bits; reals are multiplied as they are."""
    from ..functions.scalars import multiply
    from . import general

    if isinstance(xs.schema["v"].dataType, T.IntegralType):
        return general.fold(multiply, 1, xs.select("pos", F.col("v").cast("bigint").alias("v")))
    return fold(F.product, 1.0, xs)


def count_equal(xs: DataFrame, value) -> DataFrame:
    return xs.agg(F.count_if(F.col("v") == F.lit(value)).alias("v"))


def and_array(xs: DataFrame) -> DataFrame:
    return fold(F.bool_and, True, xs)


def or_array(xs: DataFrame) -> DataFrame:
    return fold(F.bool_or, False, xs)


def min_index(xs: DataFrame) -> DataFrame:
    """Position of the smallest element, the first of equals."""
    return xs.agg(F.min_by("pos", F.struct("v", "pos")).alias("v"))


def max_index(xs: DataFrame) -> DataFrame:
    return xs.agg(F.max_by("pos", F.struct("v", -F.col("pos"))).alias("v"))


def scan_sum(xs: DataFrame) -> DataFrame:
    """Exclusive prefix sums, in two phases."""
    return exclusive_sum(xs, F.col("v"), "_s").select("pos", F.col("_s").alias("v"))


def scan_max(xs: DataFrame, zero) -> DataFrame:
    return exclusive_extreme(xs, F.col("v"), "_s", zero).select("pos", F.col("_s").alias("v"))


def scan_inclusive_sum(xs: DataFrame) -> DataFrame:
    return exclusive_sum(xs, F.col("v"), "_s").select("pos", (F.col("_s") + F.col("v")).alias("v"))


def scan_total(xs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exclusive scan and its final value."""
    return scan_sum(xs), sum_array(xs)
