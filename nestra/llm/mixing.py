"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the total; a source may give at most ``max_epochs`` times its
size, and the excess goes to the others by weight until none is above. Targets come from repeated sums over the
table of sources: an iteration sends two numbers to the driver, whatever the number of sources.

A target is taken as whole repetitions of all documents and one fractional repetition: documents in a seeded
random order until the remaining words are used up, the last one in part. Where they are used up is found by
descent: the order is a hash, and sums by the hash's next two digits tell which of 256 slices holds the place, which
is cut in 256 again, until it has few rows. No task sorts more than that of a source.

Cases: null texts have size 0 and are never taken. A null source is a source of its own, the last in order. A
source of size 0 has target 0. If all sources are at their caps the targets are the caps. Repeated rows are
rows of their own. Extra columns are kept by ``mix`` and ignored by ``plan``; if the documents have a column that
``mix`` adds, the new one is mix_epoch_2 or mix_words_2 (and so on). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, small, stored

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, "mix-1"
#: Rows of one source that are put in order directly.
SLICE_ROWS = 256


def _words(text: Column) -> Column:
    blank = "".join(chr(b) for b in range(9, 14))
    return F.filter(F.split(F.translate(text, blank, " " * len(blank)), " ", -1), lambda w: w != "")


def size(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(_words(text))).cast("long")


def order_key(doc_id: Column, seed: str = SEED) -> Column:
    """Eight hex digits of a seeded hash."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8)


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). Weights repeat over the sources in code point order."""
    ranked = stored(_ranked(sources, weights, max_epochs))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # the level of the water only rises, and so does the number of capped sources
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        n, caps, open_weight = ranked.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (share * total - caps) / open_weight
    at_cap = F.lit(not open_weight) | (F.col("weight") * F.lit(level) >= F.col("cap"))
    target = F.when(at_cap, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def _ranked(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Adds weight and cap. Ranks come from a range-partitioned sort and the partitions' counts, not from one task."""
    ordered = sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source")
    ordered = stored(ordered.withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, so this window is bounded by their number
    starts = ordered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    return ordered.join(F.broadcast(starts), "part").select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))


def cuts(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per source of ``sized`` (source, key, id, size): __source, source_size, target, ``whole`` repetitions, and
    the place in the random order where the fractional one ends: all rows before (cut_key, cut_id, cut_size) are
    taken, rows at it give ``cut_words`` words each, rows after it none. Without a fractional one the cut is null."""
    by_source = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = targets(by_source, weights, share, max_epochs)
    has = F.col("source_size") > 0
    aims = aims.withColumn("whole", F.when(has, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = stored(aims.withColumn("rest", F.when(has, F.round(F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(0).cast("long")).withColumnRenamed("source", "__source"))
    before = lambda of: F.coalesce(F.sum(of).over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossing = (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("sum"))
    of_source = F.col("source").eqNullSafe(F.col("__source"))
    at, digits = aims.select("__source", F.lit("").alias("__at"), "rest"), 0
    while True:
        near = sized.join(small(at), of_source & (F.substring("key", 1, digits) == F.col("__at") if digits else F.lit(True)))
        if digits == 8:
            break
        digits += 2
        slices = near.groupBy("source", F.substring("key", 1, digits).alias("at")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"))
        found = slices.withColumn("before", before("sum")).where(crossing)
        found = stored(found.select(F.col("source").alias("__source"), F.col("at").alias("__at"), (F.col("rest") - F.col("before")).alias("rest"), "rows"))
        most = found.agg(F.max("rows")).first()[0] or 0
        at = found.drop("rows")
        if most <= slice_rows:
            near = sized.join(small(at), of_source & (F.substring("key", 1, digits) == F.col("__at")))
            break
    tied = near.groupBy("source", F.struct("key", "id", "size").alias("at")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
    cut = tied.withColumn("before", before("sum")).where(crossing)
    cut = cut.select(F.col("source").alias("__cut_source"), F.col("at.key").alias("cut_key"), F.col("at.id").alias("cut_id"), F.col("at.size").alias("cut_size"), F.floor((F.col("rest") - F.col("before")) / F.col("n")).alias("cut_words"))
    return aims.join(small(stored(cut)), F.col("__source").eqNullSafe(F.col("__cut_source")), "left").drop("__cut_source", "rest")


def _keys(documents: DataFrame, seed: str) -> dict[str, Column]:
    lowest = F.lit(-(1 << 63))
    return {"source": F.col("source"), "key": order_key(F.col("doc_id"), seed), "id": F.coalesce(F.col("doc_id").cast("long"), lowest), "size": size(F.col("text"))}


def plan(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    # sizes are measured once: both the totals and the plan read the stored table
    sized = stored(documents.select("doc_id", *(c.alias(n) for n, c in _keys(documents, seed).items())))
    of = small(stored(cuts(sized, weights, share, max_epochs, slice_rows)))
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("__source")))
    part = _part(F.struct(*(F.col(c) for c in _PLACE)), F.struct(*(F.col(f"cut_{c}").alias(c) for c in _PLACE)), F.col("cut_words"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


_PLACE = ("key", "id", "size")


def _part(here: Column, cut: Column, words: Column) -> Column:
    """Words that the fractional repetition takes of a row at ``here``; ``cut`` is where it ends."""
    return F.when(cut["key"].isNull(), F.lit(0)).when(here < cut, here["size"]).when(here == cut, words).otherwise(0)


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The mixture itself: the documents' columns, a row per repetition, then ``mix_epoch`` (from 1) and
    ``mix_words`` (words of this row). Texts are measured once and not shuffled.

    The document in which a source's words run out yields its first words, joined by blanks, in that repetition; ``n_chars``, if
    there, follows. Documents that the mix does not take have no row.
    """
    epoch, words, place, of = free_names(documents.columns, "mix_epoch", "mix_words", "place", "of")
    keys = _keys(documents, seed)
    rows = stored(documents.withColumn(place, F.struct(*(keys[c].alias(c) for c in _PLACE))))
    ends = cuts(rows.select("source", *(F.col(place)[c].alias(c) for c in _PLACE)), weights, share, max_epochs, slice_rows)
    ends = stored(ends.select(F.struct("__source", "whole", F.struct(*(F.col(f"cut_{c}").alias(c) for c in _PLACE)).alias("cut"), "cut_words").alias(of)))
    rows = rows.join(small(ends), F.col("source").eqNullSafe(F.col(of)["__source"])).where(F.col(place)["size"] > 0)
    size, whole = F.col(place)["size"], F.col(of)["whole"]
    part = _part(F.col(place), F.col(of)["cut"], F.col(of)["cut_words"]).cast("long")
    epochs = whole + (part > 0).cast("long")
    rows = rows.withColumn(epoch, F.explode(F.when(epochs > 0, F.sequence(F.lit(1).cast("long"), epochs))))
    full = (F.col(epoch) <= whole) | (part == size)
    first = F.array_join(F.slice(_words(F.col("text")), 1, F.greatest(part, F.lit(0)).cast("int")), " ")
    changed = {"text": F.when(full, F.col("text")).otherwise(first), words: F.when(full, size).otherwise(part)}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(full, F.col("n_chars")).otherwise(F.char_length(first).cast(documents.schema["n_chars"].dataType))
    return rows.withColumns(changed).select(*documents.columns, epoch, words)
