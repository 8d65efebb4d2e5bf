"""Segmented arrays: ``segs`` (seg, len) with every segment, also the empty ones, and ``elems`` (seg, pos, v).

A descriptor is contiguous (seg, len, start), scattered (plus source) or virtual: a bridge (vseg, pseg) over physical
segments. Virtual segments share: what is folded is folded once per physical segment and joined out afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.positions import CHUNK, exclusive_sum, rebase_segments


@dataclass
class Nested:
    """``contiguous`` and ``manifest`` say at plan time that no bridge is needed."""

    segs: DataFrame
    elems: DataFrame
    contiguous: bool = True
    manifest: bool = True


def from_table(segments: DataFrame, seg: str, elements: DataFrame, key: str, value: Column, *order: Column) -> Nested:
    """Segments and their elements from two tables; elements are numbered by ``order``."""
    elems = rebase_segments(elements.select(F.col(key).alias("seg"), value.alias("v"), F.struct(*order).alias("_order")), "seg", "_order").drop("_order")
    segs = segments.select(F.col(seg).alias("seg")).join(elems.groupBy("seg").agg(F.count(F.lit(1)).alias("len")), "seg", "left")
    return Nested(segs.select("seg", F.coalesce("len", F.lit(0)).alias("len")), elems)


def nest(xs: Nested) -> DataFrame:
    """(seg, v ARRAY): one row per segment."""
    of = xs.elems.groupBy("seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("v"))
    return xs.segs.select("seg").join(of, "seg", "left").select("seg", F.coalesce("v", F.array().cast(of.schema["v"].dataType)).alias("v"))


def unnest(rows: DataFrame) -> Nested:
    """(seg, v ARRAY) to segments and elements."""
    return Nested(rows.select("seg", F.size("v").cast("long").alias("len")), rows.select("seg", F.posexplode("v").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long")))


def invalid(xs: Nested) -> DataFrame:
    """Rows that break an invariant; none for a valid array."""
    have = xs.elems.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    both = xs.segs.join(have, "seg", "full")
    wrong = (F.coalesce("len", F.lit(-1)) != F.coalesce("n", F.lit(0))) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1)
    return both.where(wrong).select("seg")


def concat(xs: Nested) -> DataFrame:
    """One level flatter: (pos, v) in the order of segments."""
    at = exclusive_sum(xs.segs, F.col("len"), "_at", "seg").select("seg", "_at")
    return xs.elems.join(at, "seg").select((F.col("_at") + F.col("pos")).alias("pos"), "v")


def unconcat(xs: Nested, flat: DataFrame) -> Nested:
    """The nesting of ``xs`` on other flat data: positions are looked up by equality, not by range."""
    at = exclusive_sum(xs.segs, F.col("len"), "_at", "seg").where("len > 0")
    places = at.select("seg", "_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("pos"))
    flat = flat.select(F.col("pos").alias("_p"), "v")
    return Nested(xs.segs, places.join(flat, F.col("_at") + F.col("pos") == F.col("_p")).select("seg", "pos", "v"))


# --- folds


def fold_s(agg: Callable[[Column], Column], zero, xs: Nested) -> DataFrame:
    """One result per segment, ``zero`` for the empty ones."""
    of = xs.elems.groupBy("seg").agg(agg(F.col("v")).alias("v"))
    return xs.segs.select("seg").join(of, "seg", "left").select("seg", F.coalesce("v", F.lit(zero)).alias("v"))


def fold1_s(agg: Callable[[Column], Column], xs: Nested) -> DataFrame:
    """Of the segments that have elements."""
    return xs.elems.groupBy("seg").agg(agg(F.col("v")).alias("v"))


def sum_s(xs: Nested) -> DataFrame:
    return fold_s(F.sum, 0, xs)


def count_s(xs: Nested, value) -> DataFrame:
    return fold_s(lambda v: F.count_if(v == F.lit(value)), 0, xs)


def product_s(xs: Nested) -> DataFrame:
    """Integers wrap at 64 bits; reals are multiplied as they are."""
    from ..functions.scalars import multiply
    from . import general

    if isinstance(xs.elems.schema["v"].dataType, T.IntegralType):
        of = general.fold_s(multiply, 1, xs.elems.select("seg", "pos", F.col("v").cast("bigint").alias("v")))
        return xs.segs.select("seg").join(of, "seg", "left").select("seg", F.coalesce("v", F.lit(1).cast("bigint")).alias("v"))
    return fold_s(F.product, 1.0, xs)


def and_s(xs: Nested) -> DataFrame:
    return fold_s(F.bool_and, True, xs)


def or_s(xs: Nested) -> DataFrame:
    return fold_s(F.bool_or, False, xs)


def max_s(xs: Nested) -> DataFrame:
    return fold1_s(F.max, xs)


def min_s(xs: Nested) -> DataFrame:
    return fold1_s(F.min, xs)


def min_index_s(xs: Nested) -> DataFrame:
    return xs.elems.groupBy("seg").agg(F.min_by("pos", F.struct("v", "pos")).alias("v"))


def max_index_s(xs: Nested) -> DataFrame:
    return xs.elems.groupBy("seg").agg(F.max_by("pos", F.struct("v", -F.col("pos"))).alias("v"))


def scan_s(xs: Nested, chunk: int = CHUNK) -> DataFrame:
    """Exclusive prefix sums in each segment: in chunks of positions first, so that a long segment is not one task's,
    then over the chunks' sums, which only segments of several chunks have."""
    before = lambda order, *by: F.sum("v").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    held = xs.elems.select("seg", "pos", "v", F.floor(F.col("pos") / chunk).alias("_chunk"))
    per = held.groupBy("seg", "_chunk").agg(F.sum("v").alias("v")).select("seg", "_chunk", before("_chunk", "seg").alias("_offset")).where("_chunk > 0")
    local = held.withColumn("_local", F.coalesce(before("pos", "seg", "_chunk"), F.lit(0)))
    return local.join(per, ["seg", "_chunk"], "left").select("seg", "pos", (F.col("_local") + F.coalesce("_offset", F.lit(0))).alias("v"))


# --- segment-wise operators


def replicate_s(xs: DataFrame, segs: DataFrame) -> Nested:
    """Value i of (seg, v) for every element of segment i."""
    rows = segs.where("len > 0").join(xs, "seg").select("seg", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("pos"))
    return Nested(segs, rows.select("seg", "pos", "v"))


def indices_s(segs: DataFrame) -> DataFrame:
    rows = segs.where("len > 0").select("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("pos"))
    return rows.select("seg", "pos", F.col("pos").alias("v"))


def append_s(xs: Nested, ys: Nested) -> Nested:
    lens = xs.segs.select("seg", F.col("len").alias("_n"))
    right = ys.elems.join(lens, "seg").select("seg", (F.col("pos") + F.col("_n")).alias("pos"), "v")
    return Nested(plus_segd(xs.segs, ys.segs), xs.elems.unionByName(right))


def appends(xs: Nested, ys: Nested) -> Nested:
    """The segments of ``ys`` after those of ``xs``; segs of both are numbered from 0."""
    n = F.broadcast(xs.segs.agg(F.count(F.lit(1)).alias("_n")))
    after = lambda rows: rows.crossJoin(n).withColumn("seg", F.col("seg") + F.col("_n")).drop("_n")
    return Nested(xs.segs.unionByName(after(ys.segs)), xs.elems.unionByName(after(ys.elems)))


def pack_s(p: Callable[[Column], Column], xs: Nested) -> Nested:
    """Matches of each segment; segments stay, also when nothing matches."""
    kept = rebase_segments(xs.elems.where(p(F.col("v"))))
    lens = kept.groupBy("seg").agg(F.count(F.lit(1)).alias("len"))
    return Nested(xs.segs.select("seg").join(lens, "seg", "left").select("seg", F.coalesce("len", F.lit(0)).alias("len")), kept)


def index_s(xs: Nested, ix: DataFrame) -> DataFrame:
    """Element ix of each segment ((seg, ix) rows); segments that are too short have none."""
    return xs.elems.join(ix, (xs.elems["seg"] == ix["seg"]) & (F.col("pos") == F.col("ix"))).select(ix["seg"], "v")


def slice_s(xs: Nested, slices: DataFrame) -> Nested:
    """(seg, from, n): the slice of each segment."""
    of = xs.elems.join(slices, "seg").where("pos >= `from` and pos < `from` + n").select("seg", (F.col("pos") - F.col("from")).alias("pos"), "v")
    lens = xs.segs.join(slices, "seg").select("seg", F.greatest(F.lit(0), F.least(F.col("n"), F.col("len") - F.col("from"))).alias("len"))
    return Nested(lens, of)


def combine_s(tags: DataFrame, xs: Nested, ys: Nested) -> Nested:
    """Whole segments merged: tag 0 takes the next segment of ``xs``, tag 1 of ``ys``; segs are numbered from 0."""
    from .flat import selector

    sel = selector(tags)
    segs = xs.segs.select(F.lit(0).alias("tag"), F.col("seg").alias("src_ix"), "len").unionByName(ys.segs.select(F.lit(1).alias("tag"), F.col("seg").alias("src_ix"), "len"))
    elems = xs.elems.select(F.lit(0).alias("tag"), F.col("seg").alias("src_ix"), F.col("pos").alias("p"), "v").unionByName(ys.elems.select(F.lit(1).alias("tag"), F.col("seg").alias("src_ix"), F.col("pos").alias("p"), "v"))
    return Nested(sel.join(segs, ["tag", "src_ix"]).select(F.col("pos").alias("seg"), "len"), sel.join(elems, ["tag", "src_ix"]).select(F.col("pos").alias("seg"), F.col("p").alias("pos"), "v"))


# --- descriptors


def lengths_to_segd(lengths: DataFrame) -> DataFrame:
    """(seg, len) to (seg, len, start)."""
    return exclusive_sum(lengths.select("seg", "len"), F.col("len"), "start", "seg").select("seg", "len", "start")


def singleton_segd(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(0, n, 0)], "seg bigint, len bigint, start bigint")


def invalid_segd(segd: DataFrame) -> DataFrame:
    right = lengths_to_segd(segd).select("seg", F.col("start").alias("_start"))
    return segd.join(right, "seg").where("start <> _start or len < 0").select("seg")


def elements_segd(segd: DataFrame) -> DataFrame:
    return segd.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("v"))


def plus_segd(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("seg", F.col("len").alias("_a")).join(b.select("seg", F.col("len").alias("_b")), "seg").select("seg", (F.col("_a") + F.col("_b")).alias("len"))


def promote(segd: DataFrame) -> DataFrame:
    """Contiguous to scattered: one source."""
    return segd.select("seg", "len", "start", F.lit(0).cast("long").alias("source"))


def append_ssegd(a: DataFrame, sources: int, b: DataFrame) -> DataFrame:
    """Segments and sources of ``b`` are numbered after those of ``a``."""
    n = F.broadcast(a.agg(F.count(F.lit(1)).alias("_n")))
    return a.select("seg", "len", "start", "source").unionByName(b.crossJoin(n).select((F.col("seg") + F.col("_n")).alias("seg"), "len", "start", (F.col("source") + sources).alias("source")))


def extracts(ssegd: DataFrame, data: DataFrame) -> Nested:
    """Slices of several sources ((source, pos, v) rows): places are spelled out and joined by equality."""
    places = ssegd.where("len > 0").select("seg", "source", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("_k"))
    got = places.join(data, (places["source"] == data["source"]) & (F.col("start") + F.col("_k") == F.col("pos")))
    return Nested(ssegd.select("seg", "len"), got.select("seg", F.col("_k").alias("pos"), "v"))


def fold_ss(agg: Callable[[Column], Column], zero, ssegd: DataFrame, data: DataFrame) -> DataFrame:
    """One result per scattered segment of ``data`` ((source, pos, v) rows), ``zero`` for the empty ones."""
    return fold_s(agg, zero, extracts(ssegd, data))


def count_ss(ssegd: DataFrame, data: DataFrame, value) -> DataFrame:
    """How many elements of each scattered segment equal ``value``."""
    return fold_ss(lambda v: F.count_if(v == F.lit(value)), 0, ssegd, data)


def fold1_ss(agg: Callable[[Column], Column], ssegd: DataFrame, data: DataFrame) -> DataFrame:
    return fold1_s(agg, extracts(ssegd, data))


def get_segment(descriptor: DataFrame, i: int, of: str = "seg") -> DataFrame:
    """The row of one segment."""
    return descriptor.where(F.col(of) == i)


def replicated(spark: SparkSession, n: int) -> DataFrame:
    """A bridge of n virtual segments that share physical segment 0."""
    return spark.range(n).select(F.col("id").alias("vseg"), F.lit(0).cast("long").alias("pseg"))


def invalid_vsegd(bridge: DataFrame, psegs: DataFrame) -> DataFrame:
    """Virtual segments without a physical one, and physical ones that none refers to."""
    lost = bridge.join(psegs, bridge["pseg"] == psegs["seg"], "left_anti").select("vseg")
    return lost.unionByName(psegs.join(bridge, bridge["pseg"] == psegs["seg"], "left_anti").select(F.col("seg").alias("vseg")))


def cull(bridge: DataFrame, psegs: DataFrame) -> DataFrame:
    return psegs.join(bridge, psegs["seg"] == bridge["pseg"], "left_semi")


def lengths_vsegd(bridge: DataFrame, psegs: DataFrame) -> DataFrame:
    return bridge.join(psegs, bridge["pseg"] == psegs["seg"]).select(F.col("vseg").alias("seg"), "len")


def update_vsegs(bridge: DataFrame, f: Callable[[Column], Column], psegs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewritten physical ids, and the physical segments that are still reached."""
    new = bridge.select("vseg", f(F.col("pseg")).alias("pseg"))
    return new, cull(new, psegs)


def append_vsegd(a: DataFrame, a_psegs: int, b: DataFrame) -> DataFrame:
    n = F.broadcast(a.agg(F.count(F.lit(1)).alias("_n")))
    return a.select("vseg", "pseg").unionByName(b.crossJoin(n).select((F.col("vseg") + F.col("_n")).alias("vseg"), (F.col("pseg") + a_psegs).alias("pseg")))


def combine2_vsegd(tags: DataFrame, a: DataFrame, a_psegs: int, b: DataFrame) -> DataFrame:
    """Bridges merged: tag 0 takes the next virtual segment of ``a``, tag 1 of ``b``, whose physical ones follow."""
    from .flat import selector

    both = a.select(F.lit(0).alias("tag"), F.col("vseg").alias("src_ix"), "pseg")
    both = both.unionByName(b.select(F.lit(1).alias("tag"), F.col("vseg").alias("src_ix"), (F.col("pseg") + a_psegs).alias("pseg")))
    return selector(tags).join(both, ["tag", "src_ix"]).select(F.col("pos").alias("vseg"), "pseg")


def fold_vs(agg: Callable[[Column], Column], zero, bridge: DataFrame, xs: Nested) -> DataFrame:
    """Folds each physical segment once and joins the results out to the virtual ones."""
    if xs.manifest and bridge is None:
        return fold_s(agg, zero, xs)
    per = fold_s(agg, zero, xs)
    return bridge.join(per, bridge["pseg"] == per["seg"]).select(F.col("vseg").alias("seg"), "v")


def demote(bridge: DataFrame, xs: Nested) -> Nested:
    """Sharing spelled out."""
    segs = bridge.join(xs.segs, bridge["pseg"] == xs.segs["seg"]).select(F.col("vseg").alias("seg"), "len")
    return Nested(segs, bridge.join(xs.elems, bridge["pseg"] == xs.elems["seg"]).select(F.col("vseg").alias("seg"), "pos", "v"))


def fold1_vs(agg: Callable[[Column], Column], bridge: DataFrame, xs: Nested) -> DataFrame:
    """Of the virtual segments that have elements; each physical one is folded once."""
    per = fold1_s(agg, xs)
    return bridge.join(per, bridge["pseg"] == per["seg"]).select(F.col("vseg").alias("seg"), "v")


def index_vs(bridge: DataFrame, xs: Nested, at: DataFrame) -> DataFrame:
    """(pos, vseg, ix) to (pos, v): element ix of a virtual segment, without spelling the sharing out."""
    places = at.join(bridge, "vseg").select(at["pos"].alias("_to"), F.col("pseg").alias("seg"), F.col("ix").alias("pos"))
    return places.join(xs.elems, ["seg", "pos"]).select(F.col("_to").alias("pos"), "v")


def append_vs(x_bridge: DataFrame, xs: Nested, y_bridge: DataFrame, ys: Nested) -> Nested:
    """Segment-wise append of virtual segments."""
    return append_s(demote(x_bridge, xs), demote(y_bridge, ys))
