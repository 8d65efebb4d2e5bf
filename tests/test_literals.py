"""Literal arrays with their expected results, and the edge cases that Spark treats differently by default."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestra.functions import arrays as A
from nestra.functions import scalars as S
from nestra.operators import flat, segments
from nestra.plans import programs
from nestra.plans.positions import exclusive_sum, rebase
from nestra.sources import binary


def lists(df):
    return flat.to_list(df)


# The small arrays of this test and what the operators make of them are documented examples.
def test_flat_literals(spark):
    of = lambda xs, kind="bigint": flat.from_list(spark, xs, kind)
    assert lists(flat.extract(of([23, 42, 93, 50, 27]), 1, 3)) == [42, 93, 50]
    assert lists(flat.bpermute(of([50, 60, 20, 30]), of([0, 3, 2]))) == [50, 30, 20]
    assert lists(flat.pack_by_tag(of([12, 24, 42, 93]), of([1, 0, 0, 1]), 0)) == [24, 42]
    assert lists(flat.pick(of([4, 5, 3, 6, 5, 2, 5]), 5)) == [False, True, False, False, True, False, True]
    flags = of([True, False, False, True, True, False], "boolean")
    assert lists(flat.combine(flags, of([1, 2, 3]), of([4, 5, 6]))) == [1, 4, 5, 2, 3, 6]
    assert lists(flat.combine2(of([0, 1, 1, 0, 0, 1]), of([1, 2, 3]), of([4, 5, 6]))) == [1, 4, 5, 2, 3, 6]
    for x, y, z in (([1, 2, 3], [4, 5, 6], [1, 4, 2, 5, 3, 6]), ([2, 3], [10, 20, 30], [2, 10, 3, 20]), ([2, 3, 4], [10, 20], [2, 10, 3, 20, 4])):
        assert lists(flat.interleave(of(x), of(y))) == z
        xs, ys = (F.array(*map(F.lit, v)) for v in (x, y))
        assert spark.range(1).select(A.interleave(xs, ys)).first()[0] == z
    assert lists(flat.update(of([1, 2, 3]), spark.createDataFrame([(0, 1, 7), (1, 1, 9)], "pos bigint, ix bigint, v bigint"))) == [1, 9, 3]
    assert lists(flat.scan_sum(of([3, 1, 2]))) == [0, 3, 4]
    assert lists(flat.zip_with(lambda a, b: a + b, of([1, 2, 3]), of([10, 20]))) == [11, 22]
    assert lists(flat.min_index(of([2, 1, 1]).withColumn("pos", F.col("pos")).transform(lambda d: d)).withColumn("pos", F.lit(0))) == [1]
    assert flat.to_list(flat.enum_from_to(spark, 5, 3)) == []
    with pytest.raises(Exception):
        flat.fold1(F.max, flat.empty(spark)).collect()


def test_two_phase_scan_agrees_for_any_chunk(spark):
    values = [int(v) for v in np.random.default_rng(1).integers(-9, 9, 100)]
    xs = flat.from_list(spark, values)
    for chunk in (1, 7, 100, 1000):
        got = [r["s"] for r in exclusive_sum(xs, F.col("v"), "s", chunk=chunk).orderBy("pos").collect()]
        assert got == [sum(values[:i]) for i in range(100)]
        assert lists(rebase(xs.where("v > 0"), chunk=chunk)) == [v for v in values if v > 0]


def test_segments_with_empty_ones(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [3, 4, 5]), (3, [])], "seg bigint, v array<bigint>")
    xs = segments.unnest(rows)
    assert sorted(map(tuple, segments.nest(xs).collect())) == [(0, [1, 2]), (1, []), (2, [3, 4, 5]), (3, [])]
    assert sorted(map(tuple, segments.sum_s(xs).collect())) == [(0, 3), (1, 0), (2, 12), (3, 0)]
    assert lists(segments.concat(xs)) == [1, 2, 3, 4, 5]
    assert segments.invalid(xs).count() == 0
    assert sorted(map(tuple, segments.nest(segments.unconcat(xs, segments.concat(xs))).collect())) == sorted(map(tuple, rows.collect()))
    lens = spark.createDataFrame(list(enumerate([2, 3, 1, 2])), "seg bigint, len bigint")
    assert [r["start"] for r in segments.lengths_to_segd(lens).orderBy("seg").collect()] == [0, 2, 5, 6]
    tags = flat.from_list(spark, [0, 0, 1, 0, 1, 1])
    nest = lambda vs: segments.unnest(spark.createDataFrame(list(enumerate(vs)), "seg bigint, v array<bigint>"))
    got = segments.combine_s(tags, nest([[10, 20], [30], [40, 50, 60]]), nest([[11], [22, 33], [44, 55, 66]]))
    assert lists(segments.concat(got)) == [10, 20, 30, 11, 40, 50, 60, 22, 33, 44, 55, 66]
    shared = segments.replicated(spark, 3)
    assert [r["v"] for r in segments.fold_vs(F.sum, 0, shared, xs).collect()] == [3, 3, 3]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(S.floor_div(F.lit(-7), F.lit(2))) == -4 and value(S.floor_mod(F.lit(7), F.lit(-2))) == -1
    assert value(S.divide(F.lit(1.0), F.lit(0.0))) == float("inf")
    assert value(S.log(F.lit(0.0))) == float("-inf")
    assert value(S.eq(F.lit(float("nan")), F.lit(float("nan")))) is False
    assert value(S.round_even(F.lit(2.5))) == 2 and value(S.byte(F.lit(300))) == 44
    assert value(A.search(F.lit("bob"), "b")) == [0, 2]


def test_programs(spark):
    xs = flat.from_list(spark, [0.5, 0.1, 0.5, 0.9], "double")
    assert lists(programs.sort_array(xs)) == [0.1, 0.5, 0.5, 0.9]
    square = [(0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (1, 3)])]
    hull = programs.quickhull(spark.createDataFrame(square, "seg bigint, id bigint, x double, y double"))
    assert sorted(r["id"] for r in hull.collect()) == [0, 1, 2, 3]
    chain = programs.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src bigint, dst bigint"))
    assert {tuple(r) for r in chain.collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_binary_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(binary.encode(np.arange(5)))
    assert [r["v"] for r in binary.read_array(spark, f"file://{tmp_path}/a").orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    parts = [np.array(binary.MAGIC).tobytes(), *map(binary.encode, (np.array([2, 0, 1]), np.array([0, 2, 1]), np.array([1.0, 2.0, 3.0]), np.array([1.0, 10.0, 100.0])))]
    (tmp_path / "m").write_bytes(b"".join(parts))
    rows, nz, vec = binary.read_sparse_matrix(spark, f"file://{tmp_path}/m")
    assert [r["v"] for r in programs.smvm(rows, nz, vec).orderBy("seg").collect()] == [201.0, 0.0, 30.0]
    x = 1234
    want = []
    for _ in range(5):
        x = x * 16807 % (2**31 - 1)
        want.append(x / (2**31 - 1))
    assert np.allclose(binary.lehmer(5, 1234), want)


def test_virtual_segments_share(spark):
    xs = segments.unnest(spark.createDataFrame([(0, [5, 7]), (1, []), (2, [9])], "seg bigint, v array<bigint>"))
    bridge = spark.createDataFrame([(0, 2), (1, 0), (2, 0), (3, 1)], "vseg bigint, pseg bigint")
    assert dict(segments.fold1_vs(F.sum, bridge, xs).collect()) == {0: 9, 1: 12, 2: 12}
    at = spark.createDataFrame([(0, 2, 1), (1, 1, 1), (2, 0, 0), (3, 3, 0)], "pos bigint, vseg bigint, ix bigint")
    assert dict(segments.index_vs(bridge, xs, at).collect()) == {0: 7, 1: 7, 2: 9}
    both = segments.nest(segments.append_vs(bridge, xs, bridge, xs))
    assert dict(both.collect()) == {0: [9, 9], 1: [5, 7, 5, 7], 2: [5, 7, 5, 7], 3: []}
    assert dict(segments.nest(segments.appends(xs, xs)).collect()) == {0: [5, 7], 1: [], 2: [9], 3: [5, 7], 4: [], 5: [9]}
    tags = flat.from_list(spark, [1, 0, 0, 1, 0, 1, 1, 0])
    merged = segments.combine2_vsegd(tags, bridge, 3, bridge)
    assert [r.pseg for r in merged.orderBy("vseg").collect()] == [5, 2, 0, 3, 0, 3, 4, 1]
    assert segments.get_segment(bridge, 9, "vseg").collect() == []


def test_folds_of_empty_segments(spark):
    xs = segments.unnest(spark.createDataFrame([(0, []), (1, [True, False])], "seg bigint, v array<boolean>"))
    assert dict(segments.and_s(xs).collect()) == {0: True, 1: False}
    assert dict(segments.or_s(xs).collect()) == {0: False, 1: True}
    of = lambda c: spark.range(1).select(c).first()[0]
    empty = F.array().cast("array<bigint>")
    assert of(A.scan_inclusive(lambda a, x: a + x, empty)) == []
    assert of(A.take(F.lit(-2), F.array(F.lit(1)))) == [] and of(A.take(F.lit(9), F.array(F.lit(1)))) == [1]
    assert of(A.cross(empty, F.array(F.lit(1)))) == []


def test_rotated_trees(spark):
    """Four trees at right angles; a node of height h has h children as far from it as they are high."""
    for depth in (0, 1, 2, 4):
        sizes = [1]
        for h in range(1, depth + 1):
            sizes.append(1 + h * sizes[-1])
        at = {r.pos: complex(r.x, r.y) for r in programs.rotation(spark, depth, 1.3).collect()}
        assert sorted(at) == list(range(4 * sizes[depth]))
        roots = [at[i * sizes[depth]] for i in range(4)]
        assert np.allclose(np.abs(roots), depth)
        assert depth == 0 or np.allclose([roots[i + 1] / roots[i] for i in range(3)], 1j, atol=1e-9)

        def below(pos, h):
            for k in range(h):
                child = pos + 1 + k * sizes[h - 1]
                assert np.isclose(abs(at[child] - at[pos]), h - 1)
                below(child, h - 1)

        for i in range(4):
            below(i * sizes[depth], depth)


def test_flat_prefixes(spark):
    xs = flat.from_list(spark, [1, 2, 9, 3])
    assert lists(flat.take_while(lambda v: v < 5, xs)) == [1, 2] and lists(flat.drop_while(lambda v: v < 5, xs)) == [9, 3]
    assert lists(flat.take_while(lambda v: v < 50, xs)) == [1, 2, 9, 3] and lists(flat.drop_while(lambda v: v < 50, xs)) == []
    assert lists(flat.reverse(xs)) == [3, 9, 2, 1] and lists(flat.reverse(flat.empty(spark))) == []


def test_written_array_reads_back(spark, tmp_path):
    xs = flat.from_list(spark, list(range(1000, 0, -1))).repartition(5)
    assert binary.write_array(xs, f"file://{tmp_path}/w") == 1000
    assert [r["v"] for r in binary.read_array(spark, f"file://{tmp_path}/w").orderBy("pos").collect()] == list(range(1000, 0, -1))
    assert binary.write_array(flat.empty(spark), f"file://{tmp_path}/e") == 0
    assert binary.read_array(spark, f"file://{tmp_path}/e").count() == 0


def test_graph_files(spark, tmp_path):
    edges = [(0, 1), (1, 2), (4, 3), (0, 1)]
    assert binary.write_graph(spark.createDataFrame(edges, "src bigint, dst bigint"), 6, f"file://{tmp_path}/g") == 4
    assert (tmp_path / "g").read_bytes()[:24] == np.array([6, 4, 4]).tobytes()
    counts, read = binary.read_graph(spark, f"file://{tmp_path}/g")
    assert tuple(counts.first()) == (6, 4) and sorted(map(tuple, read.collect())) == sorted(edges)


@pytest.mark.parametrize("few", [0, 1000])
def test_nearest_places(spark, few):
    rng = np.random.default_rng(3)
    rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (250, 2)) ** 3)]
    rows += [(0, 300 + i, 1000.0, float(i // 2)) for i in range(8)] + [(1, 400 + i, float(i % 12), float(i // 12)) for i in range(144)]
    rows += [(2, 600, 1.0, 1.0), (2, 601, 1.0, 1.0), (3, 700, 5.0, 5.0)]
    want = {}
    for c, i, x, y in rows:
        far = [((x - u) ** 2 + (y - w) ** 2, k) for d, k, u, w in rows if d == c and (u, w) != (x, y)]
        want[i] = min(far)[1] if far else min(k for d, k, _, _ in rows if d == c)
    got = programs.nearest(spark.createDataFrame(rows, "cell bigint, id bigint, x double, y double"), few=few)
    assert {r.id: r.near for r in got.collect()} == want
