"""Segment descriptors as tables: contiguous (seg, len, start), scattered (with source) and virtual ones, which are a
bridge (vseg, pseg) over a scattered one. Constructors, checks, accessors and conversions.

Segments are numbered densely from 0. ``contiguous`` and ``manifest`` are known when a plan is built and save joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.positions import exclusive_sum, rebase
from . import segments

_SEGD = "seg bigint, len bigint, start bigint"


def _one(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(value.alias("v"))


# --- contiguous


def segd(lengths: DataFrame, starts: DataFrame) -> DataFrame:
    """Of two arrays (pos, v)."""
    return lengths.select(F.col("pos").alias("seg"), F.col("v").alias("len")).join(starts.select(F.col("pos").alias("seg"), F.col("v").alias("start")), "seg")


def empty_segd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _SEGD)


def length_segd(d: DataFrame) -> DataFrame:
    """Number of segments."""
    return _one(d, F.count(F.lit(1)))


def lengths_segd(d: DataFrame) -> DataFrame:
    return d.select(F.col("seg").alias("pos"), F.col("len").alias("v"))


def starts_segd(d: DataFrame) -> DataFrame:
    return d.select(F.col("seg").alias("pos"), F.col("start").alias("v"))


def valid_segd(d: DataFrame) -> DataFrame:
    """One row: no length is negative and starts are the sums of the lengths before."""
    return segments.invalid_segd(d).limit(1).agg((F.count(F.lit(1)) == 0).alias("v"))


# --- scattered


@dataclass
class Scattered:
    rows: DataFrame  # seg, len, start, source
    contiguous: bool = False


def ssegd(starts: DataFrame, sources: DataFrame, d: DataFrame) -> Scattered:
    """Starts and sources (pos, v) with the lengths of a contiguous descriptor; segments may overlap."""
    of = lambda xs, name: xs.select(F.col("pos").alias("seg"), F.col("v").alias(name))
    return Scattered(d.select("seg", "len").join(of(starts, "start"), "seg").join(of(sources, "source"), "seg"))


def empty_ssegd(spark: SparkSession) -> Scattered:
    return Scattered(spark.createDataFrame([], _SEGD + ", source bigint"), True)


def singleton_ssegd(spark: SparkSession, n: int) -> Scattered:
    return promote_segd(segments.singleton_segd(spark, n))


def promote_segd(d: DataFrame) -> Scattered:
    return Scattered(segments.promote(d), True)


def valid_ssegd(s: Scattered, sizes: DataFrame) -> DataFrame:
    """One row: every segment lies within its source; ``sizes`` is (source, n)."""
    lost = s.rows.join(sizes, "source", "left").where("n is null or start < 0 or len < 0 or start + len > n")
    return lost.limit(1).agg((F.count(F.lit(1)) == 0).alias("v"))


def is_contiguous_ssegd(s: Scattered) -> bool:
    return s.contiguous


def length_ssegd(s: Scattered) -> DataFrame:
    return length_segd(s.rows)


def lengths_ssegd(s: Scattered) -> DataFrame:
    return lengths_segd(s.rows)


def indices_ssegd(s: Scattered) -> DataFrame:
    """Where each segment would begin if they stood one after another."""
    return exclusive_sum(s.rows.select("seg", "len"), F.col("len"), "v", "seg").select(F.col("seg").alias("pos"), "v")


def starts_ssegd(s: Scattered) -> DataFrame:
    return starts_segd(s.rows)


def sources_ssegd(s: Scattered) -> DataFrame:
    return s.rows.select(F.col("seg").alias("pos"), F.col("source").alias("v"))


# --- virtual


@dataclass
class Virtual:
    bridge: DataFrame  # vseg, pseg
    physical: Scattered
    manifest: bool = False  # every virtual segment is its own physical one

    @property
    def contiguous(self) -> bool:
        return self.manifest and self.physical.contiguous


def vsegd(ids: DataFrame, s: Scattered) -> Virtual:
    return Virtual(ids.select(F.col("pos").alias("vseg"), F.col("v").alias("pseg")), s)


def empty_vsegd(spark: SparkSession) -> Virtual:
    return promote_ssegd(empty_ssegd(spark))


def singleton_vsegd(spark: SparkSession, n: int) -> Virtual:
    return promote_ssegd(singleton_ssegd(spark, n))


def replicated_vsegd(spark: SparkSession, n: int, length: int) -> Virtual:
    """One physical segment of ``length`` elements, shared n times."""
    return Virtual(segments.replicated(spark, n), singleton_ssegd(spark, length))


def promote_ssegd(s: Scattered) -> Virtual:
    return Virtual(s.rows.select(F.col("seg").alias("vseg"), F.col("seg").alias("pseg")), s, True)


def promote_segd_to_vsegd(d: DataFrame) -> Virtual:
    return promote_ssegd(promote_segd(d))


def valid_vsegd(v: Virtual) -> DataFrame:
    """One row: every virtual segment has a physical one and every physical one is reached."""
    return segments.invalid_vsegd(v.bridge, v.physical.rows).limit(1).agg((F.count(F.lit(1)) == 0).alias("v"))


def is_manifest_vsegd(v: Virtual) -> bool:
    return v.manifest


def is_contiguous_vsegd(v: Virtual) -> bool:
    return v.contiguous


def length_vsegd(v: Virtual) -> DataFrame:
    return _one(v.bridge, F.count(F.lit(1)))


def vsegids_redundant(v: Virtual) -> DataFrame:
    """Physical ids as they stand, over a physical descriptor that may have segments nobody refers to."""
    return v.bridge.select(F.col("vseg").alias("pos"), F.col("pseg").alias("v"))


def ssegd_redundant(v: Virtual) -> Scattered:
    return v.physical


def culled(v: Virtual) -> Virtual:
    """Without the physical segments that nobody refers to; the others are numbered anew, in their order."""
    if v.manifest:
        return v
    used = segments.cull(v.bridge, v.physical.rows)
    new = rebase(used.select(F.col("seg").alias("pos"), F.col("seg").alias("_old"))).select(F.col("pos").alias("_new"), "_old")
    rows = used.join(new, F.col("seg") == F.col("_old")).select(F.col("_new").alias("seg"), "len", "start", "source")
    bridge = v.bridge.join(new, F.col("pseg") == F.col("_old")).select("vseg", F.col("_new").alias("pseg"))
    return Virtual(bridge, Scattered(rows, False))


def vsegids(v: Virtual) -> DataFrame:
    return vsegids_redundant(culled(v))


def ssegd_of(v: Virtual) -> Scattered:
    return culled(v).physical


def lengths_vsegd(v: Virtual) -> DataFrame:
    return segments.lengths_vsegd(v.bridge, v.physical.rows).select(F.col("seg").alias("pos"), F.col("len").alias("v"))


def update_vsegs(v: Virtual, f: Callable[[Column], Column]) -> Virtual:
    """Rewritten physical ids; what is no longer reached is culled."""
    return culled(update_vsegs_reachable(v, f))


def update_vsegs_reachable(v: Virtual, f: Callable[[Column], Column]) -> Virtual:
    """The same where all physical segments are known to stay reached: nothing is culled."""
    return Virtual(v.bridge.select("vseg", f(F.col("pseg")).alias("pseg")), v.physical)


def demote_to_ssegd(v: Virtual) -> Scattered:
    """Sharing spelled out in the descriptor; no element moves."""
    if v.manifest:
        return v.physical
    rows = v.bridge.join(v.physical.rows, F.col("pseg") == F.col("seg")).select(F.col("vseg").alias("seg"), "len", "start", "source")
    return Scattered(rows)


def demote_to_segd(v: Virtual) -> DataFrame:
    """Lengths and starts of the segments as they stand one after another once copied."""
    return segments.lengths_to_segd(demote_to_ssegd(v).rows.select("seg", "len"))


def selector_parts(tags: DataFrame, parts: int) -> DataFrame:
    """A two-way merge cut into ``parts`` runs of nearly equal length: (part, first_0, first_1, elements_0,
    elements_1), where each run begins in either source and how many it takes of each."""
    n = F.broadcast(tags.agg(F.count(F.lit(1)).alias("_n")))
    at = tags.crossJoin(n).select(F.least(F.floor(F.col("pos") * parts / F.greatest(F.col("_n"), F.lit(1))), F.lit(parts - 1)).cast("long").alias("part"), "v")
    of = at.groupBy("part").agg(F.count_if(F.col("v") == 0).alias("elements_0"), F.count_if(F.col("v") == 1).alias("elements_1"))
    whole = tags.sparkSession.range(parts).toDF("part").join(of, "part", "left").fillna(0)
    first = exclusive_sum(exclusive_sum(whole, F.col("elements_0"), "first_0", "part"), F.col("elements_1"), "first_1", "part")
    return first.select("part", "first_0", "first_1", "elements_0", "elements_1")
