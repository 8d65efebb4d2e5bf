"""Whole array programs as plans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import flat, segments
from .scratch import release, small, stored

_stored, _release = stored, release


def dot_product(xs: DataFrame, ys: DataFrame) -> DataFrame:
    return flat.sum_array(flat.zip_with(lambda x, y: x * y, xs, ys))


def sum_of_squares(xs: DataFrame) -> DataFrame:
    return flat.sum_array(flat.map_array(lambda x: x * x, xs))


def evens(xs: DataFrame) -> DataFrame:
    return flat.filter_array(lambda x: F.pmod(x, F.lit(2)) == 0, xs)


def smvm(rows: DataFrame, nz: DataFrame, vec: DataFrame) -> DataFrame:
    """Sparse matrix (segs; seg, col, val) times vector (pos, v): gather, multiply, sum by row, empty rows 0."""
    prod = nz.join(vec, nz["col"] == vec["pos"]).groupBy("seg").agg(F.sum(F.col("val") * F.col("v")).alias("v"))
    return rows.select("seg").join(prod, "seg", "left").select("seg", F.coalesce("v", F.lit(0.0)).alias("v"))


#: Rows or columns of a matrix in one block, inner indices in one block, products of blocks in a task.
ACROSS, INNER, PRODUCTS = 1024, 512, 4
#: Entries of a product that are handed on together.
BATCH = 1 << 16


def matmul(a: DataFrame, b: DataFrame, across: int = ACROSS, inner: int = INNER) -> DataFrame:
    """(i, j, v) times (i, j, v); entries of one place add up, null is no entry, and a place without a term has no row.

    Rows, columns and inner indices are dealt to blocks by hash, and blocks of whole or of real numbers multiplied as
    dense matrices; whole numbers stay exact, and a sum beyond 64 bits is an error. Other numbers are joined.
    """
    left, right = a.select("i", F.col("j").alias("k"), "v"), b.select(F.col("i").alias("q"), F.col("j").alias("c"), F.col("v").alias("w"))
    left, right = left.where("k is not null and v is not null"), right.where("q is not null and w is not null")
    kinds = {left.schema["v"].dataType.typeName(), right.schema["w"].dataType.typeName()}
    whole = kinds <= {"byte", "short", "integer", "long"}
    if not (whole or kinds <= {"float", "double"}) or left.schema["k"].dataType != right.schema["q"].dataType:
        return left.join(right, F.col("k") == F.col("q")).groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    number = "long" if whole else "double"
    left = stored(left.groupBy("i", "k").agg(F.sum(F.col("v").cast(number)).alias("v")))
    right = stored(right.groupBy("q", "c").agg(F.sum(F.col("w").cast(number)).alias("w")))
    rows, columns, depth = (max(1, -(-df.select(c).distinct().count() // size)) for df, c, size in ((left, "i", across), (right, "c", across), (left, "k", inner)))

    def packed(df: DataFrame, outer: str, n: int, name: str, shared: str) -> DataFrame:
        """A row a block, with its entries in three arrays."""
        dealt = df.withColumn(name, F.pmod(F.xxhash64(outer), F.lit(n))).withColumn("_k", F.pmod(F.xxhash64(shared), F.lit(depth)))
        blocks = dealt.groupBy(name, "_k").agg(F.collect_list(F.struct(*df.columns)).alias("_p"))
        return stored(blocks.select("_k", *(F.col(f"_p.{c}").alias(c) for c in df.columns)))

    met = packed(left, "i", rows, "_r", "k").join(packed(right, "c", columns, "_c", "q"), "_k").drop("_k")
    # a number of tasks of its own: blocks are small, and their products large
    met = met.repartition(max(a.sparkSession.sparkContext.defaultParallelism, -(-rows * columns * depth // PRODUCTS)))
    out = left.select("i").crossJoin(right.select(F.col("c").alias("j"))).crossJoin(left.select("v")).schema
    terms = met.mapInArrow(_products, out)
    return terms if depth == 1 else terms.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            yield from _product(*(batch.column(x)[n].values for x in range(6)))


def _numbered(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    found = names.dictionary_encode(null_encoding="encode")
    return found.dictionary, found.indices.to_numpy()


def _product(i: pa.Array, k: pa.Array, v: pa.Array, q: pa.Array, c: pa.Array, w: pa.Array) -> Iterator[pa.RecordBatch]:
    """One block (i, k, v) times another (q, c, w), whose places stand once each."""
    (i, row), (c, column), (inside, both) = _numbered(i), _numbered(c), _numbered(pa.concat_arrays([k, q]))
    k, q = both[: len(k)], both[len(k) :]
    v, w = v.to_numpy(), w.to_numpy()
    kind = v.dtype
    if kind == np.int64:
        most = [max(-int(x.min()), int(x.max())) for x in (v, w)]
        bound = most[0] * most[1] * len(inside)
        kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object

    def filled(shape: tuple[int, int], x: np.ndarray, y: np.ndarray, values, kind) -> np.ndarray:
        m = np.zeros(shape, kind)
        m[x, y] = values
        return m

    shapes = (len(i), len(inside)), (len(inside), len(c))
    left, right = filled(shapes[0], row, k, v, kind), filled(shapes[1], q, column, w, kind)
    here, there = filled(shapes[0], row, k, 1, np.float32), filled(shapes[1], q, column, 1, np.float32)
    if v.dtype == np.int64 or (np.isfinite(v).all() and np.isfinite(w).all()):
        times = lambda s: left[s] @ right
    else:  # a missing entry is no term, though zero times infinity were one

        def times(s: slice) -> np.ndarray:
            total = np.zeros((len(left[s]), len(c)))
            for m in range(len(inside)):
                at = np.ix_(here[s, m] > 0, there[m] > 0)
                total[at] += np.outer(left[s, m][here[s, m] > 0], right[m][there[m] > 0])
            return total

    for first in range(0, len(i), step := max(1, BATCH // len(c))):
        s = slice(first, first + step)
        with np.errstate(all="ignore"):
            block = times(s)
        x, y = np.nonzero(here[s] @ there)
        values = block[x, y]
        values = pa.array(values.tolist() if kind is object else values.astype(v.dtype, copy=False), pa.from_numpy_dtype(v.dtype))
        yield pa.RecordBatch.from_arrays([i.take(pa.array(x + first)), c.take(pa.array(y)), values], names=["i", "j", "v"])


def primes(spark, n: int) -> DataFrame:
    """Primes up to n: the multiples of every number up to the root are spelled out and removed."""
    root = int(n**0.5)
    step = F.sequence(F.col("id") * F.col("id"), F.lit(n).cast("long"), F.col("id"))
    composite = spark.range(2, root + 1).select(F.explode(step).alias("v")).distinct()
    return spark.range(2, n + 1).select(F.col("id").alias("v")).join(composite, "v", "left_anti")


def rank(xs: segments.Nested) -> DataFrame:
    """Number of smaller elements in the segment."""
    return xs.elems.select("seg", "pos", (F.rank().over(Window.partitionBy("seg").orderBy("v")) - 1).cast("bigint").alias("v"))


#: Copies of one value that are spelled out in one row.
COPIES = 1 << 16


def _placed(xs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, v, len): the different values and their numbers in ranges of values, and (part, n, at): each range's
    elements and those in the ranges before."""
    counts = xs.groupBy("v").agg(F.count(F.lit(1)).alias("len"))
    ranged = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    per = ranged.groupBy("part").agg(F.sum("len").alias("n"))
    # one row per range, so this window is bounded by their number
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return ranged, stored(per.select("part", "n", F.coalesce(before, F.lit(0)).alias("at")))


def _starts(ranged: DataFrame, per: DataFrame) -> DataFrame:
    """(v, len, start): where the copies of each value begin in the sorted array."""
    local = F.coalesce(F.sum("len").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_local", local).join(F.broadcast(per), "part").select("v", "len", (F.col("at") + F.col("_local")).alias("start"))


def sort_array(xs: DataFrame) -> DataFrame:
    """(pos, v) in ascending order: a range-partitioned sort; equal values are counted before they are placed, and
    spelled out in runs of ``COPIES``."""
    starts = _starts(*_placed(xs))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / COPIES)))
    runs = starts.select("v", "len", "start", run.alias("_r")).withColumn("_r", F.col("_r") * COPIES)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("len") - F.col("_r"), F.lit(COPIES)) - 1))
    return runs.select("v", (F.col("start") + F.col("_r")).alias("_s"), k.alias("_k")).select((F.col("_s") + F.col("_k")).alias("pos"), "v")


def kth_smallest(xs: DataFrame, k: int) -> DataFrame:
    """One row, or none if there are not as many: only the range that holds the place is put in order."""
    ranged, per = _placed(xs)
    per = per.where((F.col("at") <= k) & (k < F.col("at") + F.col("n")))
    inside = _starts(ranged.join(F.broadcast(per.select("part")), "part", "left_semi"), per)
    return inside.where((F.col("start") <= k) & (k < F.col("start") + F.col("len"))).select("v")


def median(xs: DataFrame) -> DataFrame:
    """The element at half the length of the sorted order."""
    return kth_smallest(xs, xs.count() // 2)


#: Segments of at most FEW different places are searched directly; in others a square of the grid should hold about FULL.
FEW, FULL, FINEST = 128, 16, 20


def nearest(points: DataFrame, cell: str = "cell", few: int = FEW) -> DataFrame:
    """(cell, id, x, y): for each point the nearest one elsewhere in its cell, the smallest id of equals.

    Points at the same place do not count as near; if all are at one place, its smallest id is returned. Places are
    told apart first, so copies cost nothing. A segment of many places is searched on a grid: a place looks into the
    nine squares around it and is settled if its nearest is within a square's side; the rest looks again on squares
    twice as wide.
    """
    key, few = ["_c", "_x", "_y"], max(few, 1)
    spots = _stored(points.groupBy(F.col(cell).alias("_c"), F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min("id").alias("_id")))
    extent = F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y"))
    boxes = _stored(spots.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), extent.alias("_e")))
    found = _closest(spots.join(boxes.where(F.col("_n") <= few).select("_c"), "_c", "left_semi"), spots, ["_c"]).select(*key, "_near._near")
    most = boxes.agg(F.max("_n")).first()[0] or 0
    if most > few:
        scaled = spots.join(boxes.where(F.col("_n") > few), "_c")
        scaled = _stored(scaled.select(*key, "_id", "_e", ((F.col("_x") - F.col("_x0")) / F.col("_e")).alias("_u"), ((F.col("_y") - F.col("_y0")) / F.col("_e")).alias("_w")))
        squares = lambda k: (F.least(F.floor(F.col(c) * k), F.lit(k - 1)).alias(g) for c, g in (("_u", "_gx"), ("_w", "_gy")))
        level = min(FINEST, max(0, (most // FULL).bit_length() // 2))
        while level < FINEST and scaled.select("_c", *squares(1 << level)).groupBy("_c", "_gx", "_gy").count().agg(F.max("count")).first()[0] > FULL:
            level += 1
        left = scaled
        for j in range(level, -1, -1):
            near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
            around = left.select(*key, "_e", *squares(1 << j)).withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near))
            around = around.select(*key, "_e", (F.col("_gx") + F.col("_i")).alias("_gx"), (F.col("_gy") + F.col("_j")).alias("_gy"))
            best = _closest(around, scaled.select(*key, "_id", *squares(1 << j)), ["_c", "_gx", "_gy"], "_e")
            # the margin covers the rounding of the squares' borders
            best = _stored(best.where(F.lit(j == 0) | (F.col("_near._d") < F.pow(F.col("_e") / (1 << j), F.lit(2.0)) * (1 - 1e-8))).select(*key, "_near._near"))
            found = found.unionByName(best)
            if not j:
                break
            left = _stored(left.join(best, key, "left_anti"))
            if not left.limit(1).count():
                break
    named = spots.join(found, key, "left").select(*key, F.coalesce("_near", "_id").alias("near"))
    same = (F.col(cell) == F.col("_c")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    return points.join(named, same).select(cell, "id", "near")


def _closest(places: DataFrame, others: DataFrame, on: list[str], *carried: str) -> DataFrame:
    """For each place the least (_d, _near) of other places that agree in ``on``."""
    others = others.select(*on, F.col("_x").alias("_ox"), F.col("_y").alias("_oy"), F.col("_id").alias("_near"))
    pairs = places.join(others, on).where("_x <> _ox or _y <> _oy")
    d2 = (F.col("_x") - F.col("_ox")) ** 2 + (F.col("_y") - F.col("_oy")) ** 2
    return pairs.groupBy("_c", "_x", "_y", *carried).agg(F.min(F.struct(d2.alias("_d"), "_near")).alias("_near"))


#: Places of a cell in one block; a step of gravity takes two blocks, in tiles that stay in a core's cache.
BLOCK, TILE = 4096, (64, 512)


def gravity(bodies: DataFrame, cell: str = "cell", softening: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(cell, id, x, y, mass): summed acceleration by all bodies of the cell; an id stands once in a cell, and a body
    alone there has no row.

    Bodies at one place pull others together and each other not at all. The places of a cell are dealt to blocks, and
    each two blocks meet once: what one does to the other tells what the other does to it.
    """
    key, real = [cell, "_x", "_y"], bodies.where(F.col("id").isNotNull() & F.col(cell).isNotNull())
    real = real.select(cell, "id", F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), F.col("mass").cast("double").alias("_m"))
    places = real.where("_x is not null and _y is not null").groupBy(*key).agg(F.coalesce(F.sum("_m"), F.lit(0.0)).alias("_m"))
    many = places.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    dealt = places.join(many, cell).withColumn("_i", F.pmod(F.xxhash64("_x", "_y"), F.col("_n")))
    packed = dealt.groupBy(cell, "_n", "_i").agg(F.collect_list(F.struct("_x", "_y", "_m")).alias("_p"))
    packed = stored(packed.select(cell, "_n", "_i", *(F.col(f"_p.{c}").alias(c) for c in ("_x", "_y", "_m"))))
    steps = packed.agg(F.sum(F.col("_n") - F.col("_i"))).first()[0] or 0
    one = packed.withColumn("_j", F.explode(F.sequence(F.col("_i"), F.col("_n") - 1)))
    other = packed.select(cell, F.col("_i").alias("_j"), *(F.col(c).alias(f"_{c}") for c in ("_x", "_y", "_m")))
    met = one.join(other, [cell, "_j"]).select(cell, (F.col("_i") == F.col("_j")).alias("_same"), "_x", "_y", "_m", "__x", "__y", "__m")
    # few steps a task: they take long, and their arrays come in one batch
    met = met.repartition(max(bodies.sparkSession.sparkContext.defaultParallelism, -(-steps // 16)))
    kinds = met.select(cell, *(F.lit(0.0).alias(c) for c in ("_x", "_y", "ax", "ay"))).schema
    pulls = met.mapInArrow(partial(_pulls, softening), kinds).groupBy(*key).agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))
    together = real.groupBy(cell).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(cell)
    return real.join(together, cell).join(pulls, key, "left").select(cell, "id", "ax", "ay")


def _pulls(softening: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per step the places of the one block, and of the other, with what the two do to each other."""
    for batch in batches:
        for k in range(batch.num_rows):
            x, y, m, u, v, w = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in range(2, 8))
            there, back = _meet(x, y, m, u, v, w, softening)
            sides = [(x, y, *there)] if batch.column(1)[k].as_py() else [(x, y, *there), (u, v, *back)]
            for side in sides:
                names = pa.repeat(batch.column(0)[k], len(side[0]))
                yield pa.RecordBatch.from_arrays([names, *(pa.array(c, pa.float64()) for c in side)], names=[batch.schema.names[0], "_x", "_y", "ax", "ay"])


def _meet(x, y, m, u, v, w, softening: float) -> tuple[np.ndarray, np.ndarray]:
    """Accelerations of the places (x, y) with masses m by those at (u, v) with masses w, and the other way round."""
    there, back = np.zeros((2, len(x))), np.zeros((2, len(u)))
    with np.errstate(all="ignore"):
        for i in range(0, len(x), TILE[0]):
            a = slice(i, i + TILE[0])
            for j in range(0, len(u), TILE[1]):
                b = slice(j, j + TILE[1])
                dx, dy = u[None, b] - x[a, None], v[None, b] - y[a, None]
                r, root = dx * dx, dy * dy
                r += root
                r += softening
                np.sqrt(r, out=root)
                r *= root
                # at one place nothing pulls, with no softening either
                np.divide(1.0, r, out=r, **({} if softening > 0 else {"where": r != 0}))
                dx *= r
                dy *= r
                there[0, a] += dx @ w[b]
                there[1, a] += dy @ w[b]
                back[0, b] -= m[a] @ dx
                back[1, b] -= m[a] @ dy
    return there, back


#: Points outside one line that a task takes together.
TOGETHER = 4096


def quickhull(points: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(seg, id, x, y) to the hull's (seg, id, x, y) of each segment.

    A level splits every open line by its farthest point; points inside are dropped, so each level shuffles what
    is left. Once no line has more than ``together`` points outside, each is finished in one go by a chain of turns.
    Of points at one place the smallest id counts.
    """
    points = points.groupBy("seg", "x", "y").agg(F.min("id").alias("id"))
    p = F.struct("x", "y", "id")
    ends = points.groupBy("seg").agg(F.min(p).alias("a"), F.max(p).alias("b"))
    hull = [ends.select("seg", "a.*"), ends.where("a.x <> b.x or a.y <> b.y").select("seg", "b.*")]
    lines = ends.select("seg", "a", "b").unionByName(ends.select("seg", F.col("b").alias("a"), F.col("a").alias("b")))

    def side(a: str, b: str) -> Column:
        c = F.col
        return (c(f"{b}.x") - c(f"{a}.x")) * (c("y") - c(f"{a}.y")) - (c(f"{b}.y") - c(f"{a}.y")) * (c("x") - c(f"{a}.x"))

    open_ = stored(points.join(lines, "seg").withColumn("d", side("a", "b")).where("d > 0"))
    while most := open_.groupBy("seg", "a", "b").count().agg(F.max("count")).first()[0]:
        if most <= together:
            kinds = open_.select("seg", "x", "y", "id").schema
            hull.append(open_.groupBy("seg", "a", "b").applyInArrow(_chain, kinds))
            break
        far = stored(open_.groupBy("seg", "a", "b").agg(F.max_by(p, F.struct("d", "x", "y")).alias("c")))
        hull.append(far.select("seg", "c.*"))
        split = open_.join(far, ["seg", "a", "b"])
        left = split.withColumn("d", side("a", "c")).where("d > 0").select("seg", "x", "y", "id", "a", F.col("c").alias("b"), "d")
        right = split.withColumn("d", side("c", "b")).where("d > 0").select("seg", "x", "y", "id", F.col("c").alias("a"), "b", "d")
        fewer = stored(left.unionByName(right))
        release(open_)
        open_ = fewer
    out = hull[0]
    for h in hull[1:]:
        out = out.unionByName(h.select("seg", "x", "y", "id"))
    return out.select("seg", "id", "x", "y").distinct()


def _chain(outside: pa.Table) -> pa.Table:
    """The hull's points among those left of a line, without its ends: seen along the line they all turn right."""
    a, b = outside["a"][0].as_py(), outside["b"][0].as_py()
    start, end = (a["x"], a["y"]), (b["x"], b["y"])
    rows = sorted(zip(outside["x"].to_pylist(), outside["y"].to_pylist(), range(outside.num_rows)), reverse=start > end)
    chain: list[tuple] = [(*start, -1)]
    for q in [*rows, (*end, -1)]:
        while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) >= (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]):
            chain.pop()
        chain.append(q)
    return outside.take([i for _, _, i in chain if i >= 0]).select(["seg", "x", "y", "id"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) to (node, root), the smallest node of each component.

    A round contracts the graph: every node points to the smallest of its neighbours and itself, pointers are
    followed until they end, and links move to where they ended, until none joins two nodes. Links are merged before
    they are sent anywhere, so a hub is summed up by the tasks that hold its links.
    """
    live = stored(edges.selectExpr("least(src, dst) a", "greatest(src, dst) b").where("a is not null and b is not null").distinct())
    names = stored(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().select("node", F.col("node").alias("root")))
    live = live.where("a <> b")
    while live.limit(1).count():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).union(live.select("b", "a"))
        up = stored(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("up")))
        while True:
            to = small(up.select(F.col("node").alias("_n"), F.col("up").alias("_u")))
            jumped = stored(up.join(to, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_u", "up").alias("up"), (F.col("_u") < F.col("up")).alias("moved")))
            release(up)
            up = jumped
            if not up.where("moved").limit(1).count():
                break
        to = small(up.select(F.col("node").alias("_n"), F.col("up").alias("_u")))
        named = stored(names.join(to, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_u", "root").alias("root")))
        ends = lambda c: to.select(F.col("_n").alias(c), F.col("_u").alias(f"_{c}"))
        moved = live.join(ends("a"), "a").join(ends("b"), "b").where("_a <> _b")
        fewer = stored(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        release(names, live, up)
        names, live = named, fewer
    return names


def ray_cast(rays: DataFrame, triangles: DataFrame) -> DataFrame:
    """Vertical rays (ray, x, y) against triangles (tri, ax, ay, az, bx, by, bz, cx, cy, cz): the lowest one hit by
    each ray.

    Rays and triangles meet in the squares of a grid. A square is about four mean triangles wide, and at least as
    wide that the largest triangle lies in 65 by 65 squares.
    """
    low, high = {c: f"least(a{c}, b{c}, c{c})" for c in "xy"}, {c: f"greatest(a{c}, b{c}, c{c})" for c in "xy"}
    wide = F.greatest(*(F.expr(f"{high[c]} - {low[c]}") for c in "xy"))
    mean, most = triangles.agg(F.avg(wide), F.max(wide)).first()
    side = max(4 * (mean or 0.0), (most or 0.0) / 64) or 1.0
    cells = lambda c: F.explode(F.sequence(F.floor(F.expr(low[c]) / side), F.floor(F.expr(high[c]) / side)))
    spread = triangles.withColumn("_gx", cells("x")).withColumn("_gy", cells("y"))
    area = "((bx-ax)*(cy-ay)-(cx-ax)*(by-ay))"
    u, v = f"(((x-ax)*(cy-ay)-(cx-ax)*(y-ay))/{area})", f"(((bx-ax)*(y-ay)-(x-ax)*(by-ay))/{area})"
    inside = F.expr(f"if({area} <> 0, {u} >= 0 and {v} >= 0 and {u} + {v} <= 1, false)")
    z = F.expr(f"az + {u}*(bz-az) + {v}*(cz-az)")
    met = rays.withColumn("_gx", F.floor(F.col("x") / side)).withColumn("_gy", F.floor(F.col("y") / side)).join(spread, ["_gx", "_gy"])
    return met.where(inside).groupBy("ray").agg(F.min_by("tri", F.struct(z, "tri")).alias("tri"))


#: Fixed value: the constant with which the rotated tree is drawn.
TREE_PI = 3.1415926535


def rotation(spark: SparkSession, depth: int, time: float) -> DataFrame:
    """(pos, x, y): four rotated trees, a node before its children.

    A node of height h has h children of height h - 1. Going down, a node takes along the angle and the point of its
    parent, and its position follows from the sizes of the subtrees before it: a level is one explode, no shuffle.
    """
    sizes = [1]
    for h in range(1, depth + 1):
        sizes.append(1 + h * sizes[-1])
    level = spark.range(4).select((F.col("id") * sizes[depth]).alias("pos"), (F.col("id") * TREE_PI / 2).alias("phase"), *(F.lit(0.0).alias(c) for c in ("angle", "x", "y")))
    levels = []
    for h in range(depth, -1, -1):
        level = level.withColumn("angle", F.col("angle") + F.col("phase") + F.lit(h / 20 * time))
        level = level.withColumns({"x": F.col("x") - h * F.sin("angle"), "y": F.col("y") + h * F.cos("angle")})
        levels.append(level.select("pos", "x", "y"))
        if h:
            child = level.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
            at = F.col("pos") + 1 + (F.col("k") - 1) * sizes[h - 1]
            level = child.select(at.alias("pos"), (F.col("k") / h * 2 * TREE_PI - TREE_PI).alias("phase"), "angle", "x", "y")
    out = levels[0]
    for nodes in levels[1:]:
        out = out.unionByName(nodes)
    return out
