"""General folds and scans, trees, rays, sorting and components beside plain Python."""

import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestra.functions import closures as C
from nestra.functions import scalars as S
from nestra.operators import collections, descriptors, flat, general, segments
from nestra.plans import programs, trees


def lists(df):
    return flat.to_list(df)


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_any_function_in_any_chunks(spark, chunk):
    words = ["".join(random.Random(i).choices("abc", k=i % 4)) for i in range(40)]
    xs = flat.from_list(spark, words, "string")
    join = lambda a, b: F.concat(a, b)  # noqa: E731  associative, not commutative
    assert lists(general.scan(join, "", xs, chunk)) == ["".join(words[:i]) for i in range(40)]
    assert lists(general.scan_inclusive(join, "", xs, chunk)) == ["".join(words[: i + 1]) for i in range(40)]
    assert general.fold(join, "", xs, chunk).collect() == [("".join(words),)]
    assert general.fold1_maybe(join, xs, chunk).collect() == [("".join(words),)]
    empty = flat.empty(spark, "string")
    assert general.fold(join, "", empty, chunk).collect() == [("",)] and lists(general.scan(join, "", empty, chunk)) == []
    assert general.fold1_maybe(join, empty, chunk).collect() == [(None,)]
    segs = spark.createDataFrame([(i % 3, i // 3, w) for i, w in enumerate(words)], "seg bigint, pos bigint, v string")
    assert dict(general.fold_s(join, "", segs, chunk).collect()) == {k: "".join(words[k::3]) for k in range(3)}


def plain_carry(chunks, flags):
    held, out = 0, []
    for chunk, carries in zip(chunks, flags):
        chunk = list(chunk)
        if chunk:
            chunk[0] += held
            held = chunk.pop() if carries else 0
        out.append(chunk)
    return out, held


def test_carry(spark):
    r = random.Random(2)
    for _ in range(3):
        chunks = [[r.randint(1, 99) for _ in range(r.choice([0, 1, 1, 2, 4]))] for _ in range(12)]
        flags = [r.random() < 0.6 for _ in chunks]
        rows = spark.createDataFrame([(s, p, v) for s, c in enumerate(chunks) for p, v in enumerate(c)], "seg bigint, pos bigint, v bigint")
        told = spark.createDataFrame(list(enumerate(flags)), "seg bigint, carries boolean")
        want, rest = plain_carry(chunks, flags)
        got = sorted(map(tuple, general.carry(lambda a, b: a + b, 0, rows, told).collect()))
        assert got == sorted([(-1, 0, rest)] + [(s, p, v) for s, c in enumerate(want) for p, v in enumerate(c)])


def test_products_wrap(spark):
    values = [3037000501, 3037000501, -7, 2**62 + 1, 5] * 60
    want = (reduce(lambda a, b: a * b, values) + 2**63) % 2**64 - 2**63
    assert flat.product_array(flat.from_list(spark, values)).collect() == [(want,)]
    assert flat.product_array(flat.from_list(spark, [0.5, 4.0], "double")).collect() == [(2.0,)]
    xs = segments.unnest(spark.createDataFrame([(0, values), (1, [])], "seg bigint, v array<bigint>"))
    assert dict(segments.product_s(xs).collect()) == {0: want, 1: 1}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.floor_div(F.lit(9007199254740993), F.lit(1))) == 9007199254740993
    assert one(S.negate(F.lit(-(2**63)))) == -(2**63)
    assert one(S.multiply(F.lit(3037000501), F.lit(3037000501))) == (3037000501**2 + 2**63) % 2**64 - 2**63


@pytest.mark.parametrize("copies", [2, 1 << 16])
def test_sort_and_selection(spark, monkeypatch, copies):
    monkeypatch.setattr(programs, "COPIES", copies)
    r = random.Random(4)
    values = [r.choice([1.5, 2.5, r.random()]) for _ in range(300)] + [7.0] * 50
    xs = flat.from_list(spark, values, "double")
    assert lists(programs.sort_array(xs)) == sorted(values)
    for k in (0, 17, 349):
        assert programs.kth_smallest(xs, k).collect() == [(sorted(values)[k],)]
    assert programs.kth_smallest(xs, 350).collect() == [] and programs.median(xs).collect() == [(sorted(values)[175],)]
    assert lists(programs.sort_array(flat.empty(spark))) == []


def test_components_of_random_links(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000, 1000)] + [(5000 + i, 5001 + i) for i in range(70)] + [(9000, 9000 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = programs.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert dict(got.collect()) == root
    assert programs.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def gravity(bodies, box, epsilon):
    """The definition, body by body: a box's centroid acts on bodies farther away than its shorter side."""

    def build(left, low, right, up, inside, depth=0):
        mass = sum(m for *_, m in inside)
        node = {"x": sum(m * x for x, _, m in inside) / mass, "y": sum(m * y for _, y, m in inside) / mass, "m": mass, "s": min(right - left, up - low), "below": []}
        if len(inside) > 1 and depth < 40:
            mx, my = (left + right) / 2, (low + up) / 2
            for l, b, r, t in ((left, low, mx, my), (left, my, mx, up), (mx, my, right, up), (mx, low, right, my)):
                part = [p for p in inside if l < p[0] <= r and b < p[1] <= t]
                if part:
                    node["below"].append(build(l, b, r, t, part, depth + 1))
        return node

    def pull(x, y, node):
        dx, dy = x - node["x"], y - node["y"]
        if not node["below"] or node["s"] < math.hypot(dx, dy):
            r2 = dx * dx + dy * dy + epsilon * epsilon
            return (node["m"] / r2 * dx / math.sqrt(r2), node["m"] / r2 * dy / math.sqrt(r2))
        parts = [pull(x, y, n) for n in node["below"]]
        return (sum(p[0] for p in parts), sum(p[1] for p in parts))

    tree = build(*box, [b[1:] for b in bodies])
    return {i: pull(x, y, tree) for i, x, y, _ in bodies}


def test_barnes_hut(spark):
    r = random.Random(3)
    bodies = [(i, r.uniform(0.1, 10), r.uniform(0.1, 10) ** 2 / 10, r.uniform(1, 3)) for i in range(60)]
    got = {x["id"]: (x["ax"], x["ay"]) for x in trees.barnes_hut(spark.createDataFrame(bodies, "id bigint, x double, y double, mass double"), (0.0, 0.0, 10.0, 10.0), 0.3).collect()}
    want = gravity(bodies, (0.0, 0.0, 10.0, 10.0), 0.3)
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_tree_recursion(spark):
    xs = flat.from_list(spark, list(range(100, 116)))
    assert lists(trees.tree_reverse(xs)) == list(range(115, 99, -1))
    assert lists(trees.tree_lookup(xs, flat.from_list(spark, [3, 3, 0, 15]))) == [103, 103, 100, 115]
    with pytest.raises(ValueError):
        trees.tree_reverse(flat.from_list(spark, [1, 2, 3]))


@pytest.mark.parametrize("most", [1_000_000, 4])
def test_rays_in_space(spark, most):
    rng = np.random.default_rng(5)
    tri, rays = rng.normal(0, 3, (25, 3, 3)), rng.normal(0, 2, (60, 2, 3))
    want = {}
    for i, (o, p) in enumerate(rays):
        hits = []
        for k, (a, b, c) in enumerate(tri):
            try:
                u, v, t = np.linalg.solve(np.stack([b - a, c - a, o - p], axis=1), o - a)
            except np.linalg.LinAlgError:
                continue
            if u >= 0 and v >= 0 and u + v <= 1 and t >= 0:
                hits.append((t, k))
        if hits:
            want[i] = min(hits)
    t = spark.createDataFrame([(k, *map(float, x.ravel())) for k, x in enumerate(tri)], "tri bigint, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    r = spark.createDataFrame([(i, *map(float, x.ravel())) for i, x in enumerate(rays)], "ray bigint, " + ", ".join(f"{k}{c} double" for k in "op" for c in "xyz"))
    got = {x["ray"]: (x["at"], x["tri"]) for x in trees.pluecker(r, t, most).collect()}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and math.isclose(got[i][0], want[i][0], rel_tol=1e-9) for i in want)


def test_vertical_rays(spark):
    rng = np.random.default_rng(7)
    tri = rng.normal(0, 1, (40, 3, 3))
    tri[0] *= 400  # one covers everything
    rays = rng.normal(0, 2, (80, 2))
    want = {}
    for i, (x, y) in enumerate(rays):
        hits = []
        for k, (a, b, c) in enumerate(tri):
            u, v = np.linalg.solve(np.stack([(b - a)[:2], (c - a)[:2]], axis=1), np.array([x, y]) - a[:2])
            if u >= 0 and v >= 0 and u + v <= 1:
                hits.append((a[2] + u * (b - a)[2] + v * (c - a)[2], k))
        if hits:
            want[i] = min(hits)[1]
    t = spark.createDataFrame([(k, *map(float, x.ravel())) for k, x in enumerate(tri)], "tri bigint, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    r = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rays)], "ray bigint, x double, y double")
    assert dict(programs.ray_cast(r, t).collect()) == want


def test_closures(spark):
    f = C.closure(3)(lambda a, b, c: a * 100 + b * 10 + c)
    assert spark.range(1).select(f(1)(2)(3), f(1, 2)(3), f(1)(2, 3)).first() == (123, 123, 123)
    assert lists(f(4).lifted(flat.from_list(spark, [1, 2, 3]), flat.from_list(spark, [7, 8]))) == [417, 428]
    with pytest.raises(TypeError):
        f(1, 2, 3, 4)


def test_descriptors_of_nothing(spark):
    v = descriptors.empty_vsegd(spark)
    assert descriptors.length_vsegd(v).collect() == [(0,)] and descriptors.valid_vsegd(v).collect() == [(True,)] and v.contiguous
    assert descriptors.valid_segd(descriptors.empty_segd(spark)).collect() == [(True,)]
    wrong = spark.createDataFrame([(0, 2, 0), (1, 3, 5)], "seg bigint, len bigint, start bigint")
    assert descriptors.valid_segd(wrong).collect() == [(False,)]
    shared = descriptors.replicated_vsegd(spark, 3, 4)
    assert [r["len"] for r in descriptors.demote_to_ssegd(shared).rows.collect()] == [4, 4, 4]
    assert lists(descriptors.lengths_vsegd(shared)) == [4, 4, 4]
    assert collections.to_vectors(collections.empties(spark, 2)).count() == 2


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_segments_are_scanned_in_chunks(spark, chunk):
    values = [[3, 1, 4, 1, 5, 9, 2], [], [6], [5, 3, 5, 8]]
    xs = segments.unnest(spark.createDataFrame(list(enumerate(values)), "seg bigint, v array<bigint>"))
    want = sorted((s, p, sum(v[:p])) for s, v in enumerate(values) for p in range(len(v)))
    assert sorted(map(tuple, segments.scan_s(xs, chunk).collect())) == want
