"""Collections of arrays: ``arrays`` (source, n) with every array, also the empty ones, and ``data`` (source, pos, v).

The scattered descriptors refer to such collections by source; arrays are numbered densely from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Collection:
    arrays: DataFrame
    data: DataFrame


def empties(spark: SparkSession, n: int, kind: str = "bigint") -> Collection:
    """n empty arrays."""
    return Collection(spark.range(n).select(F.col("id").alias("source"), F.lit(0).cast("long").alias("n")), spark.createDataFrame([], f"source bigint, pos bigint, v {kind}"))


def singletons(xs: DataFrame) -> Collection:
    """One array, of the elements of ``xs``."""
    size = xs.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("source"), "n")
    return Collection(size, xs.select(F.lit(0).cast("long").alias("source"), "pos", "v"))


def number(c: Collection) -> DataFrame:
    return c.arrays.agg(F.count(F.lit(1)).alias("v"))


def array_of(c: Collection, i: int) -> DataFrame:
    """The i-th array."""
    return c.data.where(F.col("source") == i).select("pos", "v")


def element_of(c: Collection, i: int, at: int) -> DataFrame:
    return c.data.where((F.col("source") == i) & (F.col("pos") == at)).select("v")


def append(a: Collection, b: Collection) -> Collection:
    """The arrays of ``b`` after those of ``a``."""
    n = F.broadcast(a.arrays.agg(F.count(F.lit(1)).alias("_n")))
    after = lambda rows: rows.crossJoin(n).withColumn("source", F.col("source") + F.col("_n")).drop("_n")
    return Collection(a.arrays.unionByName(after(b.arrays)), a.data.unionByName(after(b.data)))


def from_vectors(rows: DataFrame) -> Collection:
    """(source, v ARRAY) to a collection."""
    data = rows.select("source", F.posexplode("v").alias("pos", "v"))
    return Collection(rows.select("source", F.size("v").cast("long").alias("n")), data.select("source", F.col("pos").cast("long").alias("pos"), "v"))


def to_vectors(c: Collection) -> DataFrame:
    """(source, v ARRAY), a row per array: for arrays that fit in one."""
    of = c.data.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("v"))
    return c.arrays.select("source").join(of, "source", "left").select("source", F.coalesce("v", F.array().cast(of.schema["v"].dataType)).alias("v"))


def map_collection(f, c: Collection) -> Collection:
    return Collection(c.arrays, c.data.select("source", "pos", f(F.col("v")).alias("v")))
