"""Dense positions and global prefix scans without a one-task window.

Both work in two phases: within chunks of consecutive positions, and over one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in one chunk. n elements give n / CHUNK rows in the second phase.
CHUNK = 1 << 16


def _before(order: str, *by: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def offsets(df: DataFrame, total: Column, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """(chunk, offset): the sum of ``total`` over all chunks before."""
    per = df.groupBy(F.floor(F.col(pos) / chunk).alias("_chunk")).agg(total.alias("_total"))
    # one row per chunk: this window is small whatever the array's length
    return per.select("_chunk", F.coalesce(F.sum("_total").over(_before("_chunk")), F.lit(0)).alias("_offset"))


def exclusive_sum(df: DataFrame, value: Column, name: str, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Adds the sum of ``value`` over all smaller positions (0 at the first)."""
    held = df.withColumn("_value", value).withColumn("_chunk", F.floor(F.col(pos) / chunk))
    local = F.coalesce(F.sum("_value").over(_before(pos, "_chunk")), F.lit(0))
    out = held.withColumn("_local", local).join(offsets(held, F.sum("_value"), pos, chunk), "_chunk")
    return out.withColumn(name, F.col("_offset") + F.col("_local")).drop("_chunk", "_value", "_local", "_offset")


def exclusive_extreme(df: DataFrame, value: Column, name: str, zero, largest: bool = True, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """The same with maximum or minimum, starting from ``zero``."""
    agg, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    held = df.withColumn("_value", value).withColumn("_chunk", F.floor(F.col(pos) / chunk))
    per = held.groupBy("_chunk").agg(agg("_value").alias("_total"))
    per = per.select("_chunk", agg("_total").over(_before("_chunk")).alias("_offset"))
    out = held.withColumn("_local", agg("_value").over(_before(pos, "_chunk"))).join(per, "_chunk")
    return out.withColumn(name, pick(F.lit(zero), "_local", "_offset")).drop("_chunk", "_value", "_local", "_offset")


def rebase(df: DataFrame, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Positions made dense again after rows were dropped; their order stays."""
    return exclusive_sum(df, F.lit(1), "_dense", pos, chunk).drop(pos).withColumnRenamed("_dense", pos)


def rebase_segments(df: DataFrame, seg: str = "seg", *order: str) -> DataFrame:
    """Positions within segments from the order of ``order`` (default: pos)."""
    w = Window.partitionBy(seg).orderBy(*(order or ("pos",)))
    return df.withColumn("pos", F.row_number().over(w).cast("long") - 1)
