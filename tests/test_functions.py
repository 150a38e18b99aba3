import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import expressions as ex
from tidemark.functions import similarity as sim
from tidemark.functions.decay import duration_seconds, edge_weight, fade, transform
from tidemark.functions.geo import haversine_km
from tidemark.functions.hashing import bucket, fnv1a32
from tidemark.functions.normalise import combine, normalise


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first()["v"]


def test_metrics(one):
    a, b, none = (F.array(*[F.lit(x) for x in v]) for v in (["x", "y"], ["y", "z"], ["q"]))
    empty = F.expr("cast(array() as array<string>)")
    null = F.lit(None)
    assert value(one, sim.jaccard(a, b)) == pytest.approx(1 / 3)
    assert value(one, sim.jaccard(a, none)) == 0
    assert value(one, sim.jaccard(empty, empty)) == 0
    assert value(one, sim.jaccard(a, null.cast("array<string>"))) is None
    assert value(one, sim.equals(F.lit("a"), F.lit("a"))) == 1
    assert value(one, sim.equals(F.lit("a"), null.cast("string"))) is None
    assert value(one, sim.log_ratio(F.lit(10.0), F.lit(1.0))) == pytest.approx(0)
    assert value(one, sim.log_ratio(F.lit(0.0), F.lit(1.0))) is None
    assert value(one, sim.closeness(F.lit(2.0), F.lit(4.0), F.lit(0.0), F.lit(10.0))) == pytest.approx(0.8)
    assert value(one, sim.closeness(F.lit(2.0), F.lit(2.0), F.lit(2.0), F.lit(2.0))) == 1
    v, w, z = (F.array(*[F.lit(float(x)) for x in u]) for u in ([1, 0], [1, 1], [0, 0]))
    assert value(one, sim.cosine(v, w)) == pytest.approx(math.sqrt(0.5))
    assert value(one, sim.cosine(v, z)) == 0
    assert value(one, sim.cosine(v, F.array(F.lit(1.0)))) is None
    assert value(one, sim.weighted_mean([(F.lit(1.0), 1.0), (null.cast("double"), 5.0), (F.lit(0.0), 3.0)])) == pytest.approx(0.25)
    assert value(one, sim.weighted_mean([(null.cast("double"), 1.0)])) == 0
    assert value(one, sim.cosine_group([F.lit(1.0), F.lit(5.0)], [F.lit(1.0), F.lit(5.0)], [(F.lit(0.0), F.lit(2.0)), (F.lit(5.0), F.lit(5.0))])) == pytest.approx(1)


def test_distances(one):
    km = lambda *p: value(one, haversine_km(*[F.lit(float(x)) for x in p]))
    assert km(47.01, 28.86, 44.43, 26.10) == pytest.approx(358, abs=3)
    assert km(0, 179.5, 0, -179.5) == pytest.approx(111, abs=1)
    assert value(one, haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))) is None


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % (1 << 32)
    return h


def test_buckets(spark):
    words = ["", "a", "user1", "héllo", "holdout\0user1"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fnv1a32(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in rows} == {w: fnv(w) for w in words}
    users = spark.range(20000).select(bucket("s", F.col("id").cast("string")).alias("b")).groupBy((F.col("b") / 1000).cast("int")).count().collect()
    assert len(users) == 10 and all(1700 < r["count"] < 2300 for r in users)


def test_fading(one):
    now, then = F.lit("2024-01-11").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    assert value(one, fade(then, now, 10 * 86400.0)) == pytest.approx(0.5)
    assert value(one, fade(now, then, 10 * 86400.0)) == pytest.approx(2)
    assert value(one, fade(now, then, 10 * 86400.0, clamp=True)) == 1
    assert duration_seconds("1.5h") == 5400 and duration_seconds("1y") == 365 * 86400
    with pytest.raises(ValueError):
        duration_seconds("5 days")
    assert value(one, transform(F.lit(-3.0), "log1p")) == 0
    assert value(one, transform(F.lit(3.0), "(v - 3) / 2")) == 0
    assert value(one, edge_weight(F.lit(None).cast("double"), 2.0, True)) is None
    assert value(one, edge_weight(F.lit(None).cast("double"), 2.0, False)) == 2


def test_normalisers(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 6.0), (1, 4, None), (2, 1, 5.0), (2, 2, 5.0)], "request_id int, cand_pos int, raw double")
    got = {h: [r.v for r in rows.select("request_id", "cand_pos", normalise(F.col("raw"), h).alias("v")).orderBy("request_id", "cand_pos").collect()] for h in ("minmax", "rank", "none", "zscore")}
    assert got["minmax"] == [0, 0.5, 1, 0.5, 0.5, 0.5] == got["zscore"]
    assert got["rank"] == pytest.approx([1 / 3, 2 / 3, 1, 0.5, 0.5, 1])
    assert got["none"] == [2, 4, 6, 0.5, 5, 5]
    assert [spark.range(1).select(combine(F.lit(0.5), F.lit(0.9), a)).first()[0] for a in (0.0, 1.0, 0.5)] == pytest.approx([0.5, 0.9, 0.7])


def env():
    return {
        "title": ex.Typed(F.lit("Hello big world"), "string"), "tags": ex.Typed(F.array(F.lit("a"), F.lit("b")), "set"), "price": ex.Typed(F.lit(10.0), "number"),
        "none": ex.Typed(F.lit(None).cast("double"), "number"), "flag": ex.Typed(F.lit(None).cast("boolean"), "bool"),
    }


@pytest.mark.parametrize(
    "source, want",
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-2 * -3", 6), ("7 / 0", 0), ("none / 0", None), ("price > 5 && price < 20", True), ("len(title)", 15), ("words(title)", 3),
        ("len(tags)", 2), ("contains(tags, 'a')", True), ('contains(title, "big")', True), ("upper('a') + 'b'", "Ab"), ("round(2.5)", 3), ("round(-2.5)", -3), ("min(3, 1, 2)", 1),
        ("max(none, 1)", None), ("clamp(15, 0, 10)", 10), ("lerp(0, 4, 0.25)", 1), ("if(price > 5, 'x', 'y')", "x"), ("if(true, 1, none)", None), ("flag && false", None), ("flag || true", None),
        ("false && flag", False), ("true || flag", True), ("price == 'x'", False), ("missing == 1", None), ("price != missing", None), ("!(price > 5)", False), ("'a' < 'b'", True), ("sqrt(16)", 4),
    ],
)
def test_expressions(one, source, want):
    got = value(one, ex.compile_column(source, env()).column)
    assert got == (pytest.approx(want) if isinstance(want, (int, float)) and not isinstance(want, bool) else want)


@pytest.mark.parametrize("source", ["1 +", "(1", "foo(1)", "len(1, 2)", "1 && true", "'a' + 1", "1 ~ 2", "a b", "clamp(1)"])
def test_expression_errors(spark, source):
    with pytest.raises(ex.ExpressionError):
        ex.compile_column(source, {"a": ex.Typed(F.lit(1.0), "number")})


@settings(max_examples=20, deadline=None)
@given(st.floats(-100, 100), st.sampled_from(["x * 2 - 1", "clamp(x, 0, 1)", "lerp(0.15, 4, x)", "round(x) / 3", "max(x, -x)", "1 / x"]))
def test_the_two_numeric_compilers_agree(spark, x, source):
    got = spark.range(1).select(ex.compile_numeric(source, "x")(F.lit(x)).alias("v")).first()["v"]
    assert got == pytest.approx(ex.evaluate_number(source, "x", x), rel=1e-9, abs=1e-12)
