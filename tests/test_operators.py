import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates as cand
from tidemark.operators import constraints as con
from tidemark.operators import cooccurrence as co
from tidemark.operators import factors, rules, scoring
from tidemark.operators import signals as sig
from tidemark.operators import users as usr


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_top_is_positive_capped_and_tied_by_item(spark):
    scored = spark.createDataFrame([(1, 3, 1.0), (1, 2, 1.0), (1, 9, 0.0), (1, 5, 2.0), (1, 4, 3.0)], "request_id int, item int, value double")
    seeds = spark.createDataFrame([(1, 0, 4)], "request_id int, seed_pos int, item int")
    assert rows(cand.top(scored, seeds, 2), "src_rank", "item") == [(1, 5), (2, 2)]


def test_union_keeps_the_first_place(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "request_id int, item int, src_rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "request_id int, item int, src_rank int")
    assert rows(cand.union([a, b]), "cand_pos", "item") == [(1, 7), (2, 8), (3, 9)]


def test_co_occurrence_measures(spark):
    events = spark.createDataFrame([("g1", 1), ("g1", 2), ("g1", 2), ("g2", 1), ("g2", 2), ("g3", 1), ("g3", 3), (None, 1)], "g string, target int")
    members = co.memberships(events, "g")
    seeds = spark.createDataFrame([(1, 0, 1)], "request_id int, seed_pos int, item int")
    pairs = co.support(members, seeds)
    assert rows(pairs, "item", "both", "n_seed", "n_item", "groups") == [(2, 2, 3, 2, 3), (3, 1, 3, 1, 3)]
    for how, want in (("lift", [(2, 1.0), (3, 1.0)]), ("count", [(2, 2.0), (3, 1.0)]), ("jaccard", [(2, pytest.approx(2 / 3)), (3, pytest.approx(1 / 3))])):
        assert rows(co.seed_values(seeds, pairs, how), "item", "value") == want
    assert rows(co.seed_values(seeds, pairs, "count", 2), "item", "value") == [(2, 2.0), (3, 0.0)]


def test_neighbours_by_hand(spark):
    prof = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 1.0), ("c", 3, 1.0), ("d", 1, 2.0), ("d", 2, 2.0)], "user string, item int, w double")
    q = prof.where("user = 'a'").select(F.lit(1).alias("request_id"), F.col("user").alias("requester"), "item", "w")
    near = usr.neighbours(q, prof, 5)
    assert rows(near, "user", "sim") == [("b", pytest.approx(np.sqrt(0.5))), ("d", pytest.approx(1.0))]
    assert rows(usr.neighbours(q, prof, 5, 2), "user") == [("d",)]
    assert rows(usr.neighbour_items(near, prof), "item", "holders") == [(1, 2), (2, 1)]


def test_over_seed_and_unknowns(spark):
    c = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "request_id int, item int, cand_pos int")
    seeds = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "request_id int, seed_pos int, item int")
    pairs = spark.createDataFrame([(1, 0, 5, 0.2), (1, 1, 5, 0.6), (1, 0, 6, 0.4)], "request_id int, seed_pos int, item int, value double")
    assert rows(sig.over_seed(c, seeds, pairs, 0.5), "item", "raw") == [(5, pytest.approx(0.5)), (6, pytest.approx(0.3)), (7, 0.0)]
    assert rows(sig.over_seed(c, seeds, pairs, 0.5, unknown_spreads=True), "item", "raw") == [(5, pytest.approx(0.5)), (6, None), (7, None)]
    assert rows(sig.over_seed(c, seeds.limit(0), pairs, 0.5), "item", "raw") == [(5, 0.0), (6, 0.0), (7, 0.0)]


def test_constraints_keep_what_does_not_apply(spark):
    df = spark.createDataFrame([(1, 5.0, 10.0), (2, None, 10.0), (3, 50.0, 10.0), (4, 50.0, None)], "id int, x double, bound double")
    p = con.compare(F.col("x"), "lte", F.col("bound"))
    assert rows(df.where(p.require()), "id") == [(1,), (4,)]
    assert rows(df.where(p.exclude()), "id") == [(2,), (3,), (4,)]
    assert rows(df.where(p.guarded(F.lit(None).cast("boolean")).require()), "id") == [(1,), (2,), (3,), (4,)]


def test_score_is_the_sum_of_its_parts(spark):
    c = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "request_id int, item int, cand_pos int")
    a = c.select("request_id", "item", (F.col("item") * 2.0).alias("raw"))
    b = c.where("item <> 2").select("request_id", "item", (-F.col("item").cast("double")).alias("raw"))
    got = scoring.ordered(scoring.score(c, {"a": a, "b": b, "z": a}, {"a": 0.7, "b": 0.5, "z": 0.0}, {"b": "rank"}))
    for r in got.collect():
        assert r.score == pytest.approx(sum(r.parts.values())) and set(r.parts) == {"a", "b"}
    shown = scoring.answer(got, got.where("item = 5").select("request_id", "item"), 2)
    assert shown.count() == 2 and shown.where("item = 5").count() == 0


def test_reasons(spark):
    df = spark.createDataFrame([(1, {"a": 0.5, "b": 0.3, "c": -1.0}), (2, {"a": 0.5, "b": 0.1}), (3, {"c": -1.0})], "id int, parts map<string,double>")
    words = {"a": F.lit("A"), "b": F.lit("B"), "c": F.lit("C")}
    assert rows(df.select("id", scoring.reason(words).alias("r")), "id", "r") == [(1, "A · B"), (2, "A"), (3, None)]
    filled = scoring.filled(F.lit("by {who} in {where}"), {"who": F.lit("x")})
    assert df.select(filled.alias("f")).first().f is None


def test_quota():
    assert rules.quota_order(list("aaab"), 1, 2) == [0, 3, 1, 2]
    assert rules.quota_order(["a", None, "a", "a"], 1, 3) == [0, 1, 2, 3]
    assert rules.quota_order(list("aab"), 0, 5) == [0, 1, 2]


def test_quota_and_place_on_lists(spark):
    df = spark.createDataFrame([(1, i, i, "aaabab"[i - 1], 1.0 / i) for i in range(1, 7)], "request_id int, item int, rank int, kind string, score double")
    assert [r.item for r in rules.quota(df, "kind", 1, 2).orderBy("rank").collect()] == [1, 4, 2, 6, 3, 5]
    assert [r.item for r in rules.place(df, F.col("kind") == "b", [1, 4]).orderBy("rank").collect()] == [4, 1, 2, 6, 3, 5]
    assert [r.item for r in rules.pin(df, F.col("kind") == "b").orderBy("rank").collect()] == [4, 6, 1, 2, 3, 5]



def test_factors_satisfy_the_normal_equations(spark):
    p = factors.Params(factors=3, regularization=0.3, alpha=4.0, iterations=3)
    rng = np.random.default_rng(2)
    data = [(u, i, float(rng.integers(1, 4))) for u in range(12) for i in range(8) if (u < 6) == (i < 4) and rng.random() < 0.8]
    obs = spark.createDataFrame(data, "user long, item long, x double")
    losses = []
    users, items = factors.train(obs, p, lambda u, i: losses.append(factors.objective(obs, u, i, p)))
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    u = {r.id: np.array(r.vec) for r in users.collect()}
    v = {r.id: np.array(r.vec) for r in items.collect()}
    g = sum(np.outer(x, x) for x in u.values())
    for i, vec in v.items():
        seen = [(u[a], x) for a, b, x in data if b == i]
        left = g + sum(p.alpha * x * np.outer(b, b) for b, x in seen) + p.regularization * np.eye(3)
        assert left @ vec == pytest.approx(sum((1 + p.alpha * x) * b for b, x in seen), abs=1e-9)
    history = [(0, 2.0), (1, 0.5), (1, 0.5), (99, 1.0), (2, -1.0)]
    folded = factors.fold_in(spark.createDataFrame([(7, i, x) for i, x in history], "request_id long, item long, x double"), items, p).first()
    gi = sum(np.outer(x, x) for x in v.values())
    parts = factors.contributions(history, v, v[3], gi, p)
    assert np.array(folded.vec) @ v[3] == pytest.approx(sum(parts.values()), abs=1e-9)
    again = {r.id: r.vec for r in factors.train(obs, p)[1].collect()}
    assert all(np.allclose(again[i], v[i]) for i in v)


def test_two_tastes_separate(spark):
    rng = np.random.default_rng(1)
    data = [(u, int(i), 1.0) for u in range(40) for i in rng.permutation(10)[:6] + (10 if u >= 20 else 0)]
    _, items = factors.train(spark.createDataFrame(data, "user long, item long, x double"), factors.Params(factors=2, iterations=15))
    v = {r.id: np.array(r.vec) / np.linalg.norm(r.vec) for r in items.collect()}
    assert min(v[a] @ v[b] for a in range(10) for b in range(10)) > 0.95
    assert max(abs(v[a] @ v[b]) for a in range(10) for b in range(10, 20)) < 0.1
