"""More queries, registered with those of :mod:`nestra.queries`: files, scalars, general folds and scans, descriptors,
collections, closures and user types, and the other programs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import closures as C
from .functions import scalars as S
from .operators import collections, descriptors, flat, general, segments
from .plans import programs, trees
from .plans.scratch import new_path
from .queries import _EDGES, _POINTS, C_, E_, L_, ORACLE, V_, cents, events, integers, kinds, lines, on_vectors, on_whole_vectors, points, prices, query, table, vectors
from .sources import binary

# --- files and lists


@query(C_)
def binary_array(spark, d):
    """Written as one array file and read back."""
    path = new_path(spark)
    binary.write_array(cents(spark, d), path)
    return binary.read_array(spark, path).select("pos", "v")


@query(E_)
def binary_reals(spark, d):
    path = new_path(spark)
    binary.write_array(events(spark, d), path, "float64")
    return binary.read_array(spark, path, "float64").select("pos", "v")


@query("SELECT c_custkey AS src, c_nationkey::BIGINT AS dst, (SELECT count(*) FROM customer) AS edges FROM customer")
def graph_file(spark, d):
    path = new_path(spark)
    binary.write_graph(table(spark, d, "customer").selectExpr("c_custkey src", "cast(c_nationkey as bigint) dst"), 25, path)
    counts, edges = binary.read_graph(spark, path)
    return edges.crossJoin(F.broadcast(counts.select("edges")))


@query(f"WITH {L_} SELECT el.seg, round(sum(el.v * p_retailprice), 4) AS v FROM el JOIN part ON p_partkey = el.pos GROUP BY 1 UNION ALL SELECT seg, 0.0 FROM sl WHERE len = 0")
def sparse_matrix_file(spark, d):
    """Orders as rows, places of lines as columns: written, read, and multiplied with the prices."""
    xs, path = lines(spark, d), new_path(spark)
    nz = xs.elems.select("seg", "pos", F.col("pos").alias("col"), F.col("v").cast("double").alias("val"))
    binary.write_sparse_matrix(xs.segs, nz, prices(spark, d), path)
    rows, nz, vec = binary.read_sparse_matrix(spark, path)
    return programs.smvm(rows, nz, vec).select("seg", F.round("v", 4).alias("v"))


@query("SELECT i AS pos, [5, 3, 8, 1][i + 1]::BIGINT AS v FROM range(4) t(i)")
def lists(spark, d):
    """From a list to an array, back to a list and to an array again."""
    return flat.from_list(spark, flat.to_list(flat.from_list(spark, [5, 3, 8, 1])))


_LEHMER = "WITH RECURSIVE r(i, x) AS (SELECT 0, 1234 * 16807::BIGINT % 2147483647 UNION ALL SELECT i + 1, x * 16807 % 2147483647 FROM r WHERE i < {n})"


@query(_LEHMER.format(n=999) + " SELECT i::BIGINT AS pos, x::DOUBLE / 2147483647::DOUBLE * 10.0::DOUBLE AS v FROM r")
def randoms_lehmer(spark, d):
    return binary.lehmer_array(spark, 1000, 1234, 0.0, 10.0)


_CLOUD = _LEHMER.replace("1234 *", "{seed} *")


@query(_CLOUD.format(seed=42742, n=399) + " SELECT a.i::BIGINT AS pos, round(a.x::DOUBLE / 2147483647 * 100, 6) AS x, round(b.x::DOUBLE / 2147483647 * 100, 6) AS y FROM r a JOIN r b ON b.i = a.i + 200")
def points_uniform(spark, d):
    return binary.points_uniform(spark, 200, 0.0, 100.0).select("pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "WITH RECURSIVE r(i, x, a) AS (SELECT 0, 42742 * 16807::BIGINT % 2147483647, 43976 * 16807::BIGINT % 2147483647 UNION ALL SELECT i + 1, x * 16807 % 2147483647, a * 16807 % 2147483647 FROM r WHERE i < 39),"
    " c AS (SELECT * FROM (VALUES (0, 250.0, 250.0, 200.0), (1, 100.0, 100.0, 80.0), (2, 150.0, 300.0, 30.0), (3, 500.0, 120.0, 30.0), (4, 300.0, 200.0, 150.0)) t(k, ox, oy, m))"
    " SELECT (k * 40 + i)::BIGINT AS pos, round(ox::DOUBLE + m::DOUBLE * sqrt(x::DOUBLE / 2147483647) * cos(-pi() + 2 * pi() * (a::DOUBLE / 2147483647)), 6) AS x,"
    " round(oy::DOUBLE + m::DOUBLE * sqrt(x::DOUBLE / 2147483647) * sin(-pi() + 2 * pi() * (a::DOUBLE / 2147483647)), 6) AS y FROM r, c"
)
def points_combo(spark, d):
    return binary.points_combo(spark, 200).select("pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# --- scalar functions

_REALS = "'nan', 'inf', '-inf', '0', '-1.5', '1.5', '2.5', '-2.5', '0.5', '3', '100.25'"


def reals(spark) -> DataFrame:
    return spark.createDataFrame([(float(x.strip(" '")),) for x in _REALS.split(",")], "v double")


def _pairs(values: DataFrame) -> DataFrame:
    return values.withColumnRenamed("v", "a").crossJoin(values.withColumnRenamed("v", "b"))


_R = f"n AS (SELECT CAST(unnest([{_REALS}]) AS DOUBLE) AS v), g AS (SELECT x.v AS a, y.v AS b, NOT isnan(x.v) AND NOT isnan(y.v) AS o FROM n x, n y)"


def _said(c: Column) -> Column:
    """A real as text, as infinities and NaN are told apart by no number."""
    return F.when(F.isnan(c), "nan").when(c == S.INF, "inf").when(c == -S.INF, "-inf").otherwise((F.round(c, 6) + F.lit(0.0)).cast("string"))


def _sql_said(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END ELSE CAST(round({x}, 6) + 0.0::DOUBLE AS VARCHAR) END"


@query(
    f"WITH {_R} SELECT {_sql_said('a')} AS a, {_sql_said('b')} AS b, o AND a = b AS eq, NOT (o AND a = b) AS ne, o AND a < b AS lt, o AND a <= b AS le, o AND a > b AS gt, o AND a >= b AS ge,"
    f" {_sql_said('CASE WHEN o AND a <= b THEN a ELSE b END')} AS low, {_sql_said('CASE WHEN o AND a <= b THEN b ELSE a END')} AS high FROM g"
)
def scalar_comparisons(spark, d):
    a, b = F.col("a"), F.col("b")
    of = {"eq": S.eq, "ne": S.ne, "lt": S.lt, "le": S.le, "gt": S.gt, "ge": S.ge}
    return _pairs(reals(spark)).select(_said(a).alias("a"), _said(b).alias("b"), *(f(a, b).alias(n) for n, f in of.items()), _said(S.minimum(a, b)).alias("low"), _said(S.maximum(a, b)).alias("high"))


_WRAP = "CAST(CASE WHEN {x} % {m} < -{h} THEN {x} % {m} + {m} WHEN {x} % {m} >= {h} THEN {x} % {m} - {m} ELSE {x} % {m} END AS BIGINT)"


def _sql_wrap(x: str) -> str:
    return _WRAP.format(x=f"({x})", m="18446744073709551616::HUGEINT", h="9223372036854775808::HUGEINT")


@query(
    f"WITH n AS (SELECT unnest([{_EDGES}]::BIGINT[])::HUGEINT AS v), g AS (SELECT x.v AS a, y.v AS b FROM n x, n y) SELECT a::BIGINT AS a, b::BIGINT AS b, {_sql_wrap('a + b')} AS plus, {_sql_wrap('a - b')} AS minus, {_sql_wrap('a * b')} AS times FROM g"
)
def scalar_wrapping(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(integers(spark)).select("a", "b", S.add(a, b).alias("plus"), S.subtract(a, b).alias("minus"), S.multiply(a, b).alias("times"))


@query(f"WITH n AS (SELECT unnest([{_EDGES}]::BIGINT[])::HUGEINT AS v) SELECT v::BIGINT AS v, {_sql_wrap('-v')} AS negative, {_sql_wrap('abs(v)')} AS magnitude, CASE WHEN v >= 0 THEN CAST(floor(sqrt(v::DOUBLE)) AS BIGINT) END AS root FROM n")
def scalar_signs(spark, d):
    v = F.col("v")
    return integers(spark).select("v", S.negate(v).alias("negative"), S.absolute(v).alias("magnitude"), F.when(v >= 0, S.isqrt(F.when(v >= 0, v))).alias("root"))


@query(
    f"WITH {_R} SELECT {_sql_said('a')} AS a, {_sql_said('b')} AS b, {_sql_said('CASE WHEN b <> 0 OR isnan(b) THEN a / b WHEN a = 0 OR isnan(a) THEN CAST(chr(110) || chr(97) || chr(110) AS DOUBLE) WHEN a > 0 THEN CAST(chr(105) || chr(110) || chr(102) AS DOUBLE) ELSE -CAST(chr(105) || chr(110) || chr(102) AS DOUBLE) END')} AS r FROM g"
)
def scalar_division(spark, d):
    """With infinities, NaN and division by zero."""
    a, b = F.col("a"), F.col("b")
    return _pairs(reals(spark)).select(_said(a).alias("a"), _said(b).alias("b"), _said(S.divide(a, b)).alias("r"))


@query("SELECT i::BIGINT AS i, round(1 / x, 9) AS r FROM (SELECT i, i / 4.0::DOUBLE AS x FROM range(1, 41) t(i))")
def scalar_recip(spark, d):
    return spark.range(1, 41).select(F.col("id").alias("i"), F.round(S.recip(F.col("id") / 4.0), 9).alias("r"))


@query(
    "SELECT i::BIGINT AS i, round(sqrt(abs(x)), 9) AS sqrt, round(exp(x), 6) AS exp, round(sin(x), 9) + 0.0 AS sin, round(cos(x), 9) + 0.0 AS cos, round(tan(x), 6) + 0.0 AS tan, round(asin(x / 10), 9) + 0.0 AS asin,"
    " round(acos(x / 10), 9) AS acos, round(atan(x), 9) + 0.0 AS atan, round(sinh(x), 6) + 0.0 AS sinh, round(cosh(x), 6) AS cosh, round(tanh(x), 9) + 0.0 AS tanh, round(asinh(x), 9) + 0.0 AS asinh,"
    " round(acosh(1 + abs(x)), 9) AS acosh, round(atanh(x / 20), 9) + 0.0 AS atanh, round(pi(), 12) AS pi FROM (SELECT i, (i - 20) / 2.0::DOUBLE AS x FROM range(41) t(i))"
)
def scalar_reals_of_one(spark, d):
    x, z = (F.col("id") - 20) / F.lit(2.0), F.lit(0.0)
    r = lambda c, k=9: F.round(c, k) + z
    return spark.range(41).select(
        F.col("id").alias("i"), r(S.sqrt(F.abs(x))).alias("sqrt"), r(S.exp(x), 6).alias("exp"), r(S.sin(x)).alias("sin"), r(S.cos(x)).alias("cos"), r(S.tan(x), 6).alias("tan"), r(S.asin(x / 10)).alias("asin"),
        r(S.acos(x / 10)).alias("acos"), r(S.atan(x)).alias("atan"), r(S.sinh(x), 6).alias("sinh"), r(S.cosh(x), 6).alias("cosh"), r(S.tanh(x)).alias("tanh"), r(S.asinh(x)).alias("asinh"),
        r(S.acosh(1 + F.abs(x))).alias("acosh"), r(S.atanh(x / 20)).alias("atanh"), r(S.pi(), 12).alias("pi"),
    )


@query("SELECT i::BIGINT AS i, j::BIGINT AS j, round(pow(i / 2.0::DOUBLE, j / 2.0::DOUBLE), 6) AS p, round(ln(j / 2.0::DOUBLE) / ln(i::DOUBLE), 9) + 0.0 AS l FROM range(2, 12) t(i), range(1, 12) u(j)")
def scalar_powers(spark, d):
    i, j = F.col("i"), F.col("j")
    grid = spark.range(2, 12).toDF("i").crossJoin(spark.range(1, 12).toDF("j"))
    return grid.select("i", "j", F.round(S.power(i / 2.0, j / 2.0), 6).alias("p"), (F.round(S.log_base(i, j / 2.0), 9) + F.lit(0.0)).alias("l"))


@query("SELECT x, CAST(trunc(x) AS BIGINT) AS t, CAST(round_even(x, 0) AS BIGINT) AS r, CAST(ceil(x) AS BIGINT) AS c, CAST(floor(x) AS BIGINT) AS f FROM (SELECT (i - 20) / 4.0::DOUBLE AS x FROM range(41) t(i))")
def scalar_rounding(spark, d):
    x = F.col("x")
    return spark.range(41).select(((F.col("id") - 20) / F.lit(4.0)).alias("x")).select("x", S.truncate(x).alias("t"), S.round_even(x).alias("r"), S.ceiling(x).alias("c"), S.floor(x).alias("f"))


@query(
    "SELECT a::BIGINT AS a, b::BIGINT AS b, CAST((a + b) % 256 AS SMALLINT) AS plus, CAST((a - b + 256) % 256 AS SMALLINT) AS minus, CAST((a * b) % 256 AS SMALLINT) AS times, CAST((256 - a) % 256 AS SMALLINT) AS negative, a::BIGINT AS whole"
    " FROM range(0, 256, 5) t(a), range(0, 256, 17) u(b)"
)
def scalar_bytes(spark, d):
    a, b = F.col("a"), F.col("b")
    x, y = S.byte_of(a), S.byte_of(b)
    grid = spark.range(0, 256, 5).toDF("a").crossJoin(spark.range(0, 256, 17).toDF("b"))
    return grid.select("a", "b", S.byte_add(x, y).alias("plus"), S.byte_subtract(x, y).alias("minus"), S.byte_multiply(x, y).alias("times"), S.byte_negate(x).alias("negative"), S.to_int(x).alias("whole"))


@query("SELECT i::BIGINT AS i, CAST(i AS DOUBLE) AS d, CAST(CAST(i AS FLOAT) / 3::FLOAT AS DOUBLE) AS f, CAST(((i % 256) + 256) % 256 AS SMALLINT) AS b FROM range(-400, 400, 7) t(i)")
def scalar_conversions(spark, d):
    i = F.col("id")
    single = (S.from_int(i, "float") / F.lit(3).cast("float")).cast("float")
    return spark.range(-400, 400, 7).select(i.alias("i"), S.from_int(i).alias("d"), single.cast("double").alias("f"), S.from_int(i, "byte").alias("b"))


@query(
    "SELECT p::BIGINT AS p, q::BIGINT AS q, (p > 0 AND q > 0) AS both, (p > 0 OR q > 0) AS either, NOT p > 0 AS neither, true AS other, CAST(p > 0 AS INT) AS number, q <> 0 AS truth, p < q AS lt, p = q AS eq, p > q AS gt"
    " FROM range(2) t(p), range(2) u(q)"
)
def scalar_truth(spark, d):
    p, q = F.col("p") > 0, F.col("q") > 0
    o = S.ordering(F.col("p"), F.col("q"))
    grid = spark.range(2).toDF("p").crossJoin(spark.range(2).toDF("q"))
    return grid.select(
        "p", "q", S.and_(p, q).alias("both"), S.or_(p, q).alias("either"), S.not_(p).alias("neither"), S.otherwise().alias("other"), S.from_bool(p).alias("number"), S.to_bool(F.col("q")).alias("truth"),
        S.is_lt(o).alias("lt"), S.is_eq(o).alias("eq"), S.is_gt(o).alias("gt"),
    )


@query("SELECT event_id AS pos, event_id + user_id AS two, event_id + user_id + 3 AS three, event_id + user_id + 7 AS four, event_id + user_id + 12 AS five FROM events")
def scalar_tuples(spark, d):
    parts = [F.col("event_id"), F.col("user_id"), F.lit(3), F.lit(4), F.lit(5)]
    tuples = table(spark, d, "events").select("event_id", *(S.tup(*parts[:n]).alias(f"t{n}") for n in (2, 3, 4, 5)))
    of = lambda n: sum((F.col(f"t{n}._{i}") for i in range(2, n + 1)), F.col(f"t{n}._1"))
    return tuples.select(F.col("event_id").alias("pos"), *(of(n).alias(name) for n, name in ((2, "two"), (3, "three"), (4, "four"), (5, "five"))))


@query("SELECT event_id AS pos, (1 - CAST(user_id % 2 <> 0 AS INT))::INT AS v FROM events")
def bool_round_trip(spark, d):
    """Numbers to truth values, negated, and back."""
    return flat.map_array(lambda v: S.from_bool(S.not_(S.to_bool(v))), kinds(spark, d))


# --- flat arrays


@query("SELECT event_id AS pos, value AS a, user_id AS b, event_id AS c FROM events")
def unzip3(spark, d):
    triples = table(spark, d, "events").selectExpr("event_id pos", "struct(value a, user_id b, event_id c) v")
    return flat.zip_arrays(*flat.unzip(triples, "a", "b", "c")).selectExpr("pos", "v1 a", "v2 b", "v3 c")


def _zip_with(n: int) -> None:
    def run(spark, d):
        return flat.zip_with(lambda *v: sum(x * i for i, x in enumerate(v, 1)), *[cents(spark, d)] * (n - 1), kinds(spark, d))

    run.__name__ = f"zip_with_{n}"
    query(f"SELECT event_id AS pos, CAST(round(value * 100) AS BIGINT) * {n * (n - 1) // 2} + user_id % 2 * {n} AS v FROM events")(run)


for _n in (3, 4, 5, 6, 7):
    _zip_with(_n)


def _zip(n: int) -> None:
    def run(spark, d):
        return flat.zip_arrays(*(events(spark, d, f"event_id * {i}") for i in range(1, n)), prices(spark, d))

    run.__name__ = f"zip{n}"
    query(f"SELECT event_id AS pos, {', '.join(f'event_id * {i} AS v{i}' for i in range(1, n))}, p_retailprice AS v{n} FROM events JOIN part ON p_partkey = event_id")(run)


def _unzip(n: int) -> None:
    names = [f"f{i}" for i in range(1, n + 1)]

    def run(spark, d):
        tuples = events(spark, d, f"struct({', '.join(f'event_id * {i} f{i}' for i in range(1, n + 1))})")
        return flat.zip_arrays(*reversed(flat.unzip(tuples, *names)))

    run.__name__ = f"unzip{n}"
    query(f"SELECT event_id AS pos, {', '.join(f'event_id * {n + 1 - i} AS v{i}' for i in range(1, n + 1))} FROM events")(run)


for _n in (4, 5):
    _zip(_n)
    _unzip(_n)

# an affine map x -> a x + b modulo 1009: composition is associative and not commutative
_MAP = "struct(cast(1 + user_id % 1008 as bigint) a, cast(event_id % 1009 as bigint) b)"
_AFTER = lambda f, g: F.struct((f["a"] * g["a"] % 1009).alias("a"), ((f["b"] * g["a"] + g["b"]) % 1009).alias("b"))
_MAPS = "WITH RECURSIVE m AS (SELECT event_id, 1 + user_id % 1008 AS a, event_id % 1009 AS b FROM events), c(i, a, b) AS (SELECT 0::BIGINT, 1::BIGINT, 0::BIGINT UNION ALL SELECT i + 1, c.a * m.a % 1009, (c.b * m.a + m.b) % 1009 FROM c JOIN m ON m.event_id = i)"


def _named(spark, zero=(1, 0)) -> Column:
    return F.struct(F.lit(zero[0]).cast("bigint").alias("a"), F.lit(zero[1]).cast("bigint").alias("b"))


@query(_MAPS + " SELECT i AS pos, a, b FROM c WHERE i < (SELECT count(*) FROM events)")
def scan_any(spark, d):
    """Any associative function: here the composition of affine maps, whose order matters."""
    return general._scan_with(_AFTER, _named(spark), events(spark, d, _MAP)).select("pos", "v.a", "v.b")


@query(_MAPS + " SELECT a, b FROM c WHERE i = (SELECT count(*) FROM events)")
def fold_any(spark, d):
    return general._fold_with(_AFTER, _named(spark), events(spark, d, _MAP)).select("v.a", "v.b")


@query(f"WITH e AS ({C_}) SELECT pos, greatest(max(v) OVER (ORDER BY pos), 0) AS v FROM e")
def scan_any_inclusive(spark, d):
    return general.scan_inclusive(lambda a, b: F.greatest(a, b), 0, cents(spark, d))


@query(f"WITH e AS ({C_}), s AS (SELECT sum(v)::BIGINT AS total FROM e) SELECT pos, coalesce(sum(v) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS v, total FROM e, s")
def scan_result(spark, d):
    before, total = general.scan_result(lambda a, b: a + b, 0, cents(spark, d))
    return before.crossJoin(F.broadcast(total.withColumnRenamed("v", "total")))


@query(f"SELECT max(v) AS some, CAST(NULL AS BIGINT) AS none FROM ({C_})")
def fold1_maybe(spark, d):
    some = general.fold1_maybe(lambda a, b: F.greatest(a, b), cents(spark, d)).withColumnRenamed("v", "some")
    return some.crossJoin(general.fold1_maybe(lambda a, b: F.greatest(a, b), flat.empty(spark)).withColumnRenamed("v", "none"))


_PRODUCT = "WITH RECURSIVE m AS (SELECT event_id, ({v})::HUGEINT AS v FROM events), c(i, p) AS (SELECT 0::BIGINT, 1::HUGEINT UNION ALL SELECT i + 1, {wrap} FROM c JOIN m ON m.event_id = i)"


@query(_PRODUCT.format(v="2 * user_id + 1", wrap=_sql_wrap("p * v") + "::HUGEINT") + " SELECT p::BIGINT AS v FROM c WHERE i = (SELECT count(*) FROM events)")
def product_wraps(spark, d):
    """The product of the odd numbers of all events, modulo 2 ** 64."""
    return flat.product_array(events(spark, d, "2 * user_id + 1"))


@query(f"WITH e AS ({C_}) SELECT (SELECT v FROM e ORDER BY v % 1000 DESC, pos DESC LIMIT 1) AS high, (SELECT v FROM e ORDER BY v % 1000, pos LIMIT 1) AS low")
def extreme_by(spark, d):
    c, key = cents(spark, d), lambda v: v % 1000
    return general.maximum_by(key, c).withColumnRenamed("v", "high").crossJoin(general.minimum_by(key, c).withColumnRenamed("v", "low"))


@query(f"WITH e AS ({C_}), f AS (SELECT coalesce(min(pos), (SELECT count(*) FROM e)) AS first FROM e WHERE v > 5000) SELECT CAST(pos >= first AS INT) AS part, CASE WHEN pos >= first THEN pos - first ELSE pos END AS pos, v FROM e, f")
def span(spark, d):
    left, right = general.span(lambda v: v <= 5000, cents(spark, d))
    return left.select(F.lit(0).alias("part"), "pos", "v").unionByName(right.select(F.lit(1).alias("part"), "pos", "v"))


@query(f"SELECT CAST(pos >= 77 AS INT) AS part, CASE WHEN pos >= 77 THEN pos - 77 ELSE pos END AS pos, v FROM ({C_})")
def split_at(spark, d):
    left, right = general.split_at(cents(spark, d), 77)
    return left.select(F.lit(0).alias("part"), "pos", "v").unionByName(right.select(F.lit(1).alias("part"), "pos", "v"))


@query("WITH w AS (SELECT user_id % 50 AS ix, arg_max(value, event_id) AS nv FROM events GROUP BY 1) SELECT p_partkey AS pos, coalesce(nv, p_retailprice) AS v FROM part LEFT JOIN w ON ix = p_partkey")
def permute_default(spark, d):
    return general.permute_default(events(spark, d), events(spark, d, "user_id % 50"), prices(spark, d))


@query("SELECT (SELECT count(*) FROM events) = 0 AS some, true AS none")
def is_empty(spark, d):
    return general.is_empty(events(spark, d)).withColumnRenamed("v", "some").crossJoin(general.is_empty(flat.empty(spark)).withColumnRenamed("v", "none"))


@query(E_)
def normal_form(spark, d):
    return general.normal_form(events(spark, d))


@query("SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 90::BIGINT), (1, 1, 20), (3, 0, 60), (-1, 0, 0)) w(seg, pos, v)")
def carry(spark, d):
    """Chunks [80], [10, 20], [50], [10] of which the first and the third hand on their last element."""
    chunks = spark.createDataFrame([(0, 0, 80), (1, 0, 10), (1, 1, 20), (2, 0, 50), (3, 0, 10)], "seg bigint, pos bigint, v bigint")
    flags = spark.createDataFrame([(0, True), (1, False), (2, True), (3, False)], "seg bigint, carries boolean")
    return general.carry(lambda a, b: a + b, 0, chunks, flags)


@query(
    "WITH t AS (SELECT event_id, user_id % 2 AS g, least(event_id * 6 // (SELECT count(*) FROM events), 5) AS part FROM events), c AS (SELECT part, count(*) FILTER (WHERE g = 0) AS e0, count(*) FILTER (WHERE g = 1) AS e1 FROM t GROUP BY 1)"
    " SELECT part::BIGINT AS part, (sum(e0) OVER w - e0)::BIGINT AS first_0, (sum(e1) OVER w - e1)::BIGINT AS first_1, e0 AS elements_0, e1 AS elements_1 FROM c WINDOW w AS (ORDER BY part)"
)
def selector_parts(spark, d):
    return descriptors.selector_parts(kinds(spark, d), 6)


# --- descriptors


def flags(spark, **values) -> DataFrame:
    """One row of plan-time facts."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def beside(*rows: tuple[str, DataFrame]) -> DataFrame:
    """One-row results as columns."""
    out = None
    for name, df in rows:
        one = df.withColumnRenamed("v", name)
        out = one if out is None else out.crossJoin(one)
    return out


def contiguous(spark, d) -> DataFrame:
    return segments.lengths_to_segd(lines(spark, d).segs)


@query(f"WITH {L_} SELECT (SELECT count(*) FROM sl) AS length, (SELECT count(*) FROM el) AS elements, true AS valid, 0::BIGINT AS empty, 1::BIGINT AS one, 7::BIGINT AS in_one")
def segd_sizes(spark, d):
    s, one = contiguous(spark, d), segments.singleton_segd(spark, 7)
    return beside(("length", descriptors.length_segd(s)), ("elements", segments.elements_segd(s)), ("valid", descriptors.valid_segd(s)), ("empty", descriptors.length_segd(descriptors.empty_segd(spark))), ("one", descriptors.length_segd(one)), ("in_one", segments.elements_segd(one)))


@query(f"WITH {L_} SELECT seg, len, (sum(len) OVER (ORDER BY seg) - len)::BIGINT AS start FROM sl")
def segd_of_arrays(spark, d):
    s = contiguous(spark, d)
    return descriptors.segd(descriptors.lengths_segd(s), descriptors.starts_segd(s))


def scattered(spark, d) -> descriptors.Scattered:
    """Slices of two sources, some of them over one another."""
    p = table(spark, d, "part")
    of = lambda e: p.selectExpr("p_partkey pos", f"{e} v")
    lengths = p.selectExpr("p_partkey seg", "p_partkey % 4 len", "0L start")
    return descriptors.ssegd(of("p_partkey * 3"), of("p_partkey % 2"), lengths)


_SS = "SELECT p_partkey AS seg, p_partkey % 4 AS len, p_partkey * 3 AS start, p_partkey % 2 AS source FROM part"


@query(_SS)
def ssegd(spark, d):
    return scattered(spark, d).rows


@query(f"WITH s AS ({_SS}) SELECT seg AS pos, len, (sum(len) OVER (ORDER BY seg) - len)::BIGINT AS ix, start, source FROM s")
def ssegd_columns(spark, d):
    s = scattered(spark, d)
    parts = {"len": descriptors.lengths_ssegd, "ix": descriptors.indices_ssegd, "start": descriptors.starts_ssegd, "source": descriptors.sources_ssegd}
    out = None
    for name, f in parts.items():
        one = f(s).withColumnRenamed("v", name)
        out = one if out is None else out.join(one, "pos")
    return out


@query("SELECT (SELECT count(*) FROM part) AS length, (SELECT max(p_partkey * 3 + p_partkey % 4) FROM part) <= (SELECT count(*) FROM events) AS valid, 0::BIGINT AS empty, 1::BIGINT AS one, false AS scattered, true AS promoted, true AS none")
def ssegd_sizes(spark, d):
    s, n = scattered(spark, d), table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))
    sizes = n.select(F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("source"), "n")
    told = flags(spark, scattered=descriptors.is_contiguous_ssegd(s), promoted=descriptors.is_contiguous_ssegd(descriptors.promote_segd(contiguous(spark, d))), none=descriptors.is_contiguous_ssegd(descriptors.empty_ssegd(spark)))
    rows = [("length", descriptors.length_ssegd(s)), ("valid", descriptors.valid_ssegd(s, sizes)), ("empty", descriptors.length_ssegd(descriptors.empty_ssegd(spark))), ("one", descriptors.length_ssegd(descriptors.singleton_ssegd(spark, 9)))]
    return beside(*rows).crossJoin(told)


@query(f"WITH s AS ({_SS}) SELECT seg, count(*) FILTER (WHERE value > 50) AS v FROM (SELECT s.seg, value FROM s LEFT JOIN events ON event_id >= start AND event_id < start + len) GROUP BY 1")
def count_ss(spark, d):
    data = table(spark, d, "events").selectExpr("explode(array(0L, 1L)) source", "event_id pos", "value > 50 v")
    return segments.count_ss(scattered(spark, d).rows, data, True)


@query(f"WITH {L_} SELECT seg, len, (sum(len) OVER (ORDER BY seg) - len)::BIGINT AS start, 0::BIGINT AS source FROM sl")
def promote_segd(spark, d):
    return descriptors.promote_segd(contiguous(spark, d)).rows


def virtual(spark, d) -> descriptors.Virtual:
    """Every event refers to one of the first parts; the other parts are reached by none."""
    return descriptors.vsegd(table(spark, d, "events").selectExpr("event_id pos", "event_id % 7 * 3 v"), scattered(spark, d))


_CULLED = f"s AS ({_SS}), u AS (SELECT DISTINCT event_id % 7 * 3 AS p FROM events), w AS (SELECT s.*, row_number() OVER (ORDER BY seg) - 1 AS i FROM s JOIN u ON u.p = s.seg)"


@query(f"WITH {_CULLED} SELECT event_id AS pos, i AS v, event_id % 7 * 3 AS redundant, len FROM events JOIN w ON w.seg = event_id % 7 * 3")
def vsegd_columns(spark, d):
    v = virtual(spark, d)
    ids = descriptors.vsegids(v).join(descriptors.vsegids_redundant(v).withColumnRenamed("v", "redundant"), "pos")
    return ids.join(descriptors.lengths_vsegd(v).withColumnRenamed("v", "len"), "pos")


@query(f"WITH {_CULLED} SELECT i AS seg, len, start, source, false AS redundant FROM w UNION ALL SELECT seg, len, start, source, true FROM s")
def vsegd_physical(spark, d):
    v = virtual(spark, d)
    culled, whole = descriptors.ssegd_of(v).rows.select("seg", "len", "start", "source"), descriptors.ssegd_redundant(v).rows.select("seg", "len", "start", "source")
    return culled.withColumn("redundant", F.lit(False)).unionByName(whole.withColumn("redundant", F.lit(True)))


@query("SELECT (SELECT count(*) FROM events) AS length, false AS valid, true AS culled, 0::BIGINT AS empty, 1::BIGINT AS one, 5::BIGINT AS copies, true AS shared, true AS identity, false AS manifest, true AS promoted, false AS scattered, true AS contiguous")
def vsegd_sizes(spark, d):
    v, promoted, both = virtual(spark, d), descriptors.promote_ssegd(scattered(spark, d)), descriptors.promote_segd_to_vsegd(contiguous(spark, d))
    copies = descriptors.replicated_vsegd(spark, 5, 3)
    rows = [
        ("length", descriptors.length_vsegd(v)), ("valid", descriptors.valid_vsegd(v)), ("culled", descriptors.valid_vsegd(descriptors.culled(v))), ("empty", descriptors.length_vsegd(descriptors.empty_vsegd(spark))),
        ("one", descriptors.length_vsegd(descriptors.singleton_vsegd(spark, 4))), ("copies", descriptors.length_vsegd(copies)), ("shared", descriptors.valid_vsegd(copies)), ("identity", descriptors.valid_vsegd(promoted)),
    ]
    told = flags(spark, manifest=descriptors.is_manifest_vsegd(v), promoted=descriptors.is_manifest_vsegd(promoted), scattered=descriptors.is_contiguous_vsegd(promoted), contiguous=descriptors.is_contiguous_vsegd(both))
    return beside(*rows).crossJoin(told)


@query("SELECT event_id AS vseg, event_id % 7 * 3 + 1 AS pseg, false AS culled FROM events UNION ALL SELECT event_id, event_id % 7, true FROM events")
def vsegd_updates(spark, d):
    """Rewritten ids over all physical segments, and over those still reached, which are numbered anew."""
    v, f = virtual(spark, d), lambda p: p + 1
    whole, fewer = descriptors.update_vsegs_reachable(v, f).bridge, descriptors.update_vsegs(v, f).bridge
    return whole.withColumn("culled", F.lit(False)).unionByName(fewer.withColumn("culled", F.lit(True)))


@query("SELECT event_id AS seg, event_id % 7 * 3 % 4 AS len, event_id % 7 * 9 AS start, event_id % 7 * 3 % 2 AS source, (sum(event_id % 7 * 3 % 4) OVER (ORDER BY event_id) - event_id % 7 * 3 % 4)::BIGINT AS at FROM events")
def vsegd_demoted(spark, d):
    v = virtual(spark, d)
    return descriptors.demote_to_ssegd(v).rows.join(descriptors.demote_to_segd(v).select("seg", F.col("start").alias("at")), "seg")


# --- collections of arrays


def collection(spark, d) -> collections.Collection:
    return collections.from_vectors(vectors(spark, d).select(F.col("vec_id").alias("source"), F.slice("e", F.lit(1), (F.col("vec_id") % 65).cast("int")).alias("v")))


_COLLECTION = "SELECT vec_id AS source, p - 1 AS pos, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(p) WHERE p <= vec_id % 65"


@query(_COLLECTION)
def collection_data(spark, d):
    return collection(spark, d).data


@query(f"WITH {V_} SELECT vec_id AS source, list_transform(e[1:vec_id % 65], lambda x: x * 2) AS v FROM v")
def collection_vectors(spark, d):
    """Arrays of 0 to 64 elements, mapped and made vectors again."""
    return collections.to_vectors(collections.map_collection(lambda x: x * 2, collection(spark, d)))


@query("SELECT (SELECT count(*) FROM embeddings) AS arrays, 3::BIGINT AS empties, 1::BIGINT AS one, (SELECT count(*) FROM events) AS elements, (SELECT CAST(embedding[5] AS DOUBLE) FROM embeddings WHERE vec_id = 64) AS element")
def collection_sizes(spark, d):
    c, one = collection(spark, d), collections.singletons(events(spark, d))
    return beside(("arrays", collections.number(c)), ("empties", collections.number(collections.empties(spark, 3))), ("one", collections.number(one)), ("elements", flat.length(collections.array_of(one, 0))), ("element", collections.element_of(c, 64, 4)))


@query("SELECT p - 1 AS pos, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(p) WHERE vec_id = 40 AND p <= 40")
def collection_array(spark, d):
    return collections.array_of(collection(spark, d), 40)


@query(f"WITH c AS ({_COLLECTION}), n AS (SELECT count(*) AS n FROM embeddings) SELECT source, pos, v FROM c UNION ALL SELECT source + n + 2, pos, v FROM c, n")
def collection_append(spark, d):
    c = collection(spark, d)
    return collections.append(collections.append(c, collections.empties(spark, 2, "double")), c).data


# --- nested arrays in rows

on_vectors("array_singleton", "[e[1]]", lambda e: A.singleton(F.get(e, F.lit(0))))
on_vectors("array_is_empty", "len(e[1:vec_id % 3]) = 0", lambda e: A.is_empty(A.take(F.col("vec_id") % 3, e)))
on_vectors("array_fold_left1", "round(list_reduce(e, lambda a, x: a - x), 6) + 0.0", lambda e: F.round(A.fold_left1(lambda a, x: a - x, e), 6) + F.lit(0.0))
on_vectors("array_fold_right1", "round(list_reduce(list_reverse(e), lambda a, x: x - a), 6) + 0.0", lambda e: F.round(A.fold_right1(lambda x, a: x - a, e), 6) + F.lit(0.0))
on_vectors("array_scan_left", "list_transform(range(64), lambda i: round(1.0 - coalesce(list_sum(e[1:i]), 0.0), 6) + 0.0)", lambda e: _rounded(A.scan_left(lambda a, x: a - x, F.lit(1.0), e)))
on_vectors("array_scan_left1", "list_transform(range(1, 65), lambda i: round(2 * e[1] - list_sum(e[1:i]), 6) + 0.0)", lambda e: _rounded(A.scan_left1(lambda a, x: a - x, e)))
on_vectors("array_scan_right", "list_transform(range(1, 65), lambda i: round(coalesce(list_sum(e[i + 1:]), 0.0) + 1.0, 6) + 0.0)", lambda e: _rounded(A.scan_right(lambda x, a: x + a, F.lit(1.0), e)))
on_vectors("array_scan_right1", "list_transform(range(1, 65), lambda i: round(list_sum(e[i:]), 6) + 0.0)", lambda e: _rounded(A.scan_right1(lambda x, a: x + a, e)))
on_vectors("array_split_at", "list_concat(e[vec_id % 64 + 1:], e[1:vec_id % 64])", lambda e: A.append(*reversed(A.split_at(F.col("vec_id") % 64, e))))
on_vectors("array_take_while", "e[1:coalesce(list_position(list_transform(e, lambda x: x >= 0.2), true) - 1, 64)]", lambda e: A.take_while(lambda x: x < 0.2, e))
on_vectors("array_drop_while", "e[coalesce(list_position(list_transform(e, lambda x: x >= 0.2), true), 65):]", lambda e: A.drop_while(lambda x: x < 0.2, e))
on_vectors("array_product", "round(list_product(list_transform(e, lambda x: 1 + x / 10)), 6)", lambda e: F.round(A.product_array(A.map_array(lambda x: 1 + x / 10, e)), 6))
on_vectors("array_extremes", "[list_max(e), list_min(e)]", lambda e: F.array(A.maximum(e), A.minimum(e)))
on_vectors("array_enum_then", "CASE WHEN vec_id % 2 = 0 THEN range(0, vec_id % 30 + 1, 3) ELSE range(20, vec_id % 30 - 1, -4) END", lambda e: F.when(F.col("vec_id") % 2 == 0, A.enum_from_then_to(_long(0), _long(3), F.col("vec_id") % 30)).otherwise(A.enum_from_then_to(_long(20), _long(16), F.col("vec_id") % 30)))
on_vectors("array_permute", "list_transform(range(64), lambda i: e[(i + 61) % 64 + 1])", lambda e: A.permute(F.transform(e, lambda x, i: (i + 3) % 64), e))
on_vectors("array_permute_default", "list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 AND i < 32 THEN -e[i // 2 + 1] ELSE e[i + 1] END)", lambda e: A.permute_default(F.transform(F.slice(e, 1, 16), lambda x, i: i * 2), A.map_array(lambda x: -x, F.slice(e, 1, 16)), e))
on_vectors("array_indexed", "list_sum(list_transform(range(64), lambda i: CASE WHEN e[i + 1] > 0 THEN i ELSE 0 END))::BIGINT", lambda e: A.fold(lambda a, p: a + F.when(p["v"] > 0, p["ix"]).otherwise(0), _long(0), A.indexed(e)))
on_whole_vectors("array_unzip", "list_concat(e[33:], e[1:32])", lambda e, a, b: A.append(*reversed(A.unzip(A.zip_arrays(a, b)))))
on_whole_vectors("array_zip_with_3", "list_transform(range(1, 33), lambda i: e[i] + e[i + 32] * e[i])", lambda e, a, b: A.zip_with_many(lambda x, y, z: x + y * z, a, b, e))
on_whole_vectors("array_zip_with_4", "list_transform(range(1, 33), lambda i: e[i] + e[i + 32] * e[i] - 1)", lambda e, a, b: A.zip_with_many(lambda x, y, z, w: x + y * z - w, a, b, e, F.array_repeat(F.lit(1.0), 50)))
on_whole_vectors("array_zip3", "list_transform(range(1, 33), lambda i: e[i] - e[i + 32] + e[i])", lambda e, a, b: A.map_array(lambda t: t["_1"] - t["_2"] + t["_3"], A.zip_many(a, b, e)))
on_whole_vectors("array_zip4", "list_transform(range(1, 33), lambda i: e[i + 32] - e[i])", lambda e, a, b: A.map_array(lambda t: t["_4"] - t["_1"], A.zip_many(a, e, a, b)))
on_whole_vectors("array_unzip3", "list_concat(list_concat(e[1:32], e[1:32]), e[33:])", lambda e, a, b: F.concat(*(A.unzip_many(A.zip_many(b, e, a), 3)[i] for i in (2, 1, 0))))
on_whole_vectors("array_unzip4", "list_concat(e[33:], e[1:32])", lambda e, a, b: F.concat(*(A.unzip_many(A.zip_many(a, e, a, b), 4)[i] for i in (3, 0))))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _rounded(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.round(x, 6) + F.lit(0.0))


# --- closures and user types


@query("SELECT event_id AS pos, value * 3 + user_id + 7 AS v FROM events")
def closure_lifted(spark, d):
    """A function of four arguments that holds two of them, applied to arrays."""
    f = C.closure(4)(lambda k, c, x, y: x * k + y + c)
    return f(3)(7).lifted(events(spark, d), events(spark, d, "user_id"))


@query("SELECT event_id AS pos, sqrt(abs(value)) + event_id AS v FROM events")
def scalar_kernels(spark, d):
    return C.scalar_zip_with(lambda x, y: x + y, C.scalar_map(lambda x: S.sqrt(F.abs(x)), events(spark, d)), events(spark, d, "event_id"))


@query("SELECT event_id AS pos, round(CASE user_id % 3 WHEN 0 THEN value * value * 3 WHEN 1 THEN value * event_id ELSE 0 END, 6) AS v FROM events")
def user_types(spark, d):
    """Shapes of three kinds (a radius, two sides, nothing) as a sum of products, and a function by cases."""
    e = table(spark, d, "events")
    shape = C.variant(F.col("user_id") % 3, {"circle": F.col("value"), "box": C.product(a=F.col("value"), b=F.col("event_id")), "none": F.lit(True)})
    area = C.match(F.col("shape"), {"circle": lambda r: r * r * 3, "box": lambda s: s["a"] * s["b"], "none": lambda _: F.lit(0.0)})
    return e.select(F.col("event_id").alias("pos"), shape.alias("shape")).select("pos", F.round(area, 6).alias("v"))


# --- programs


def _concats(spark) -> dict[str, Column]:
    longs = lambda *xs: F.array(*map(_long, xs)) if xs else F.array().cast("array<bigint>")
    two = F.array(longs(0, 1, 2, 3), longs(4, 5), longs(), longs(6, 7, 8), longs(9))
    three = F.array(F.array(longs(0)), F.array(longs(1), longs(2, 3)), F.array(longs(4, 5)), F.array().cast("array<array<bigint>>"), F.array(longs(6, 7), longs(8)), F.array(longs()), F.array(longs(9)))
    plus = partial(A.map_array, lambda x: x + 1)
    return {
        "two": A.concat(two), "three": A.concat(A.concat(three)), "inside": A.concat(A.map_array(A.concat, three)), "mapped": A.concat(A.map_array(plus, F.array(longs(1, 2), longs(3, 4)))), "nested": A.concat(A.map_array(plus, two)),
    }


@query("SELECT range(10) AS two, range(10) AS three, range(10) AS inside, [2, 3, 4, 5]::BIGINT[] AS mapped, range(1, 11) AS nested")
def concat_programs(spark, d):
    """Arrays of arrays, of depth two and three, flattened from the outside and from the inside, and mapped before."""
    return spark.range(1).select(*(c.alias(n) for n, c in _concats(spark).items()))


@query("SELECT event_id AS pos, v FROM (SELECT 511 - event_id AS event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE event_id < 512)")
def tree_reverse(spark, d):
    """Of an array whose length is a power of two, as the recursion needs."""
    return trees.tree_reverse(flat.extract(cents(spark, d), 0, 512))


@query("SELECT event_id AS pos, p_retailprice AS v FROM events JOIN part ON p_partkey = user_id % 100 WHERE event_id < 512")
def tree_lookup(spark, d):
    return trees.tree_lookup(prices(spark, d), flat.extract(events(spark, d, "user_id % 100"), 0, 512))


@query()
def barnes_hut(spark, d):
    """All customers as bodies of mass one in one box; tested against a plain recursion."""
    bodies = points(spark, d).select("id", "x", "y", F.lit(1.0).alias("mass"))
    return trees.barnes_hut(bodies, (-2000.0, -2000.0, 12000.0, 12000.0)).select("id", F.round("ax", 9).alias("ax"), F.round("ay", 9).alias("ay"))


_TRI = "SELECT s_suppkey AS tri, s_suppkey % 7 - 3.0::DOUBLE AS ax, s_suppkey % 5 - 2.0::DOUBLE AS ay, 5.0::DOUBLE + s_suppkey % 11 AS az FROM supplier"


@query(
    f"""WITH t AS (SELECT *, ax + 2 AS bx, ay AS byy, az + 1 AS bz, ax AS cx, ay + 2 AS cy, az + 0.5 AS cz FROM ({_TRI})), r AS (SELECT event_id AS ray, (user_id % 21 - 10) / 10.0::DOUBLE AS px, (event_id % 17 - 8) / 10.0::DOUBLE AS py, 1.0::DOUBLE AS pz FROM events),
    n AS (SELECT *, (byy - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (byy - ay) * (cx - ax) AS nz FROM t),
    h AS (SELECT *, (nx * ax + ny * ay + nz * az) / nullif(nx * px + ny * py + nz * pz, 0) AS k FROM r, n),
    b AS (SELECT *, ((k * px - ax) * (cy - ay) - (cx - ax) * (k * py - ay)) / ((bx - ax) * (cy - ay) - (cx - ax) * (byy - ay)) AS u, ((bx - ax) * (k * py - ay) - (k * px - ax) * (byy - ay)) / ((bx - ax) * (cy - ay) - (cx - ax) * (byy - ay)) AS w FROM h)
    SELECT ray, round(min(k), 6) AS at FROM b WHERE k >= 0 AND u > 1e-9 AND w > 1e-9 AND u + w < 1 - 1e-9 GROUP BY 1"""
)
def pluecker(spark, d):
    """Rays from the origin through the points of a screen; the SQL intersects planes and checks coordinates in the
    triangle. Rays through an edge, which more triangles have, miss the triangle."""
    t = table(spark, d, "supplier").selectExpr("s_suppkey tri", "s_suppkey % 7 - 3.0D ax", "s_suppkey % 5 - 2.0D ay", "5.0D + s_suppkey % 11 az")
    t = t.selectExpr("*", "ax + 2 bx", "ay by", "az + 1 bz", "ax cx", "ay + 2 cy", "az + 0.5D cz")
    rays = table(spark, d, "events").selectExpr("event_id ray", "0.0D ox", "0.0D oy", "0.0D oz", "(user_id % 21 - 10) / 10.0D px", "(event_id % 17 - 8) / 10.0D py", "1.0D pz")
    return trees.pluecker(rays, t, margin=1e-9).select("ray", F.round("at", 6).alias("at"))
