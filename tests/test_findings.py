"""What a reviewer found on odd inputs and larger tables, in small."""

import duckdb
import numpy as np
import pytest

from nestra.plans import programs, trees
from nestra.queries import ORACLE, QUERIES


def wanted(name, d, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return sorted(c.execute(ORACLE[name]).fetchall())


def test_rays_through_edges(spark, tmp_path):
    """A hundred triangles have edges that rays go through; ten have none."""
    spark.range(100).selectExpr("id s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(357).selectExpr("id event_id", "id % 21 user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r["ray"], round(r["at"], 6)) for r in QUERIES["pluecker"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(ray, round(at, 6)) for ray, at in wanted("pluecker", tmp_path, "supplier", "events")]


def test_edges_belong_to_a_triangle_from_one_side(spark):
    corners = "tri bigint, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz")
    a, b, c = (0.0, 0.0, 1.0), (2.0, 0.0, 1.0), (0.0, 2.0, 1.0)
    rays = [(0, 0.5, 0.5), (1, 0.5, 0.0), (2, 1.0, 1.0), (3, 1.5, 1.0)]
    r = spark.createDataFrame([(i, 0.0, 0.0, 0.0, x, y, 1.0) for i, x, y in rays], "ray bigint, " + ", ".join(f"{k}{c} double" for k in "op" for c in "xyz"))
    seen = []
    for t in (spark.createDataFrame([(0, *p)], corners) for p in (a + b + c, a + c + b)):
        seen.append(sorted(x["ray"] for x in trees.pluecker(r, t).collect()))
        assert [x["ray"] for x in trees.pluecker(r, t, margin=1e-9).collect()] == [0]
    assert sorted(seen) == [[0], [0, 1, 2]]


def test_combine_of_more_than_a_million_of_each(spark, tmp_path):
    spark.range(2_100_000, numPartitions=2).selectExpr("id event_id", "id % 2 user_id").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["combine"](spark, str(tmp_path))
    assert out.selectExpr("count(*)", "sum(v)", "max(v)", "min(v)").first() == (2_100_000, 0, 1_050_000, -1_050_000)


def test_search_up_to_the_end_that_the_sql_sets(spark, tmp_path):
    texts = ["the", "", None, "to the", "the then the", "the lathe.", "\U0001f600 the the", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["string_search"](spark, str(tmp_path)).collect())) == wanted("string_search", tmp_path, "documents")


def test_same_rays_and_triangles_meet_once(spark):
    """A million rays of seven lines and four hundred thousand triangles of three: 21 pairs, not 4e11."""
    r = spark.range(1_000_000).selectExpr("id ray", "0.0D ox", "0.0D oy", "0.0D oz", "(id % 7) / 10D px", "0.1D py", "1.0D pz")
    t = spark.range(400_000).selectExpr("id tri", "-2.0D ax", "-1.0D ay", "1.0D + id % 3 az", "9.0D bx", "-1.0D by", "1.0D + id % 3 bz", "-2.0D cx", "9.0D cy", "1.0D + id % 3 cz")
    got = trees.pluecker(r, t).selectExpr("count(*)", "count(distinct ray)", "max(tri)", "min(at)", "max(at)").first()
    assert got == (1_000_000, 1_000_000, 0, 1.0, 1.0)


def test_gravity_of_a_crowded_cell(spark):
    """Three thousand bodies of one cell, copies of places and lone bodies, whatever the blocks."""
    rng = np.random.default_rng(11)
    x, y, m = rng.integers(0, 40, 3000).astype(float), rng.normal(0, 30, 3000).round(), rng.uniform(1, 2, 3000)
    dx, dy = x[None] - x[:, None], y[None] - y[:, None]
    f = m[None] / (dx * dx + dy * dy + 1.0) ** 1.5
    want = {i: (a, b) for i, (a, b) in enumerate(zip((f * dx).sum(1), (f * dy).sum(1)))}
    rows = [("a", i, float(x[i]), float(y[i]), float(m[i])) for i in range(3000)]
    more = [("b", 1, 1.0, 1.0, 1.0), (None, 2, 1.0, 1.0, 1.0), ("c", 1, 2.0, 2.0, 3.0), ("c", 2, 2.0, 2.0, 3.0)]
    bodies = spark.createDataFrame(rows + more, "cell string, id bigint, x double, y double, mass double")
    for block in (500, 4096):
        got = {(r["cell"], r["id"]): (r["ax"], r["ay"]) for r in programs.gravity(bodies, block=block).collect()}
        assert got.pop(("c", 1)) == got.pop(("c", 2)) == (0.0, 0.0) and len(got) == 3000
        assert all(np.allclose(got["a", i], want[i], rtol=1e-9, atol=1e-12) for i in want)


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(12,2)"])
def test_sparse_product_in_blocks(spark, kind):
    """Repeated and missing entries, zeros, a nameless row, and large numbers, in blocks of every size."""
    rng = np.random.default_rng(4)
    big = 1 << 28 if kind == "bigint" else 9
    a, b = ([(int(i) if i else None, int(j), int(v)) for i, j, v in zip(rng.integers(0, n, 150), rng.integers(1, m, 150), rng.integers(-big, big, 150))] for n, m in ((23, 30), (30, 17)))
    want = {}
    for i, k, v in a:
        for q, j, w in b:
            if k == q:
                want[i, j] = want.get((i, j), 0) + v * w
    frames = [spark.createDataFrame(x, "i bigint, j bigint, v bigint").selectExpr("i", "j", f"cast(v as {kind}) v") for x in (a, b)]
    for across, inner in ((1024, 512), (5, 4)):
        assert {(r["i"], r["j"]): int(r["v"]) for r in programs.matmul(*frames, across, inner).collect()} == want


def test_product_that_needs_exact_or_missing_terms(spark):
    one = lambda *rows, kind="bigint": spark.createDataFrame(list(rows), f"i bigint, j bigint, v {kind}")
    assert [r["v"] for r in programs.matmul(one((0, 0, 3 << 40), (0, 1, 1)), one((0, 0, 1 << 21), (1, 0, 1))).collect()] == [(3 << 61) + 1]
    with pytest.raises(Exception):
        programs.matmul(one((0, 0, 1 << 40)), one((0, 0, 1 << 40))).collect()
    inf = float("inf")
    got = programs.matmul(one((0, 0, inf), (1, 1, 2.0), kind="double"), one((0, 0, 1.0), (1, 1, inf), (1, 0, 3.0), kind="double")).collect()
    assert {(r["i"], r["j"]): r["v"] for r in got} == {(0, 0): inf, (1, 1): inf, (1, 0): 6.0}
    assert programs.matmul(one(), one()).count() == 0
