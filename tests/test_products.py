"""Products of requests and items: spread over tasks, and no joins or shuffles by pairs."""

import os

import pytest

import __spark_entry__ as entry
from tests.test_queries import DIR, canonical, duck  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_sides(spark):
    """Joins that are broadcast only where a query says so."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def small_tasks(monkeypatch):
    from tidemark.queries import binding

    monkeypatch.setattr(binding, "TASK_ROWS", 100)


def test_flt_in_seed_joins_no_pairs(spark, no_small_sides, small_tasks):
    got = entry.engine.QUERIES["flt_in_seed"](spark, DIR)
    assert "LeftAnti" not in plan(got)
    assert got.rdd.getNumPartitions() > 1
    assert got.count() == 10 * 200 - 10 * 3


@pytest.mark.parametrize("name", ["flt_range", "flt_when_guard"])
def test_products_of_customers_are_dealt_out(spark, small_tasks, name):
    assert entry.engine.QUERIES[name](spark, DIR).rdd.getNumPartitions() > 1


def test_sig_attribute_value_is_dealt_out(spark, small_tasks):
    assert entry.engine.QUERIES["sig_attribute_value"](spark, DIR).rdd.getNumPartitions() > 1


def test_sig_attribute_value_keeps_no_item_for_all_requests(spark, small_tasks):
    steps = plan(entry.engine.QUERIES["sig_attribute_value"](spark, DIR))
    assert steps.index("Generate explode") < steps.index("Coalesce") < steps.index("BroadcastNestedLoopJoin")


@pytest.mark.parametrize("piece", [1, 3, 512])
def test_products_in_pieces_are_whole(spark, monkeypatch, small_tasks, piece):
    from tidemark.queries import binding

    monkeypatch.setattr(binding, "PIECE", piece)
    rows = spark.createDataFrame([(1, 2.5), (2, None), (None, 1.0), (1, 2.5)], "item long, x double")
    asked = spark.createDataFrame([(r,) for r in [*range(0, 800, 20), 0, -20]], "request_id long")
    want = rows.crossJoin(asked).select("request_id", "item", "x")
    key = lambda r: tuple((v is None, v) for v in r)
    got = binding.in_pieces(rows, asked)
    assert got.columns == want.columns
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str)
    assert binding.in_pieces(rows, asked.limit(0)).count() == 0 == binding.in_pieces(rows.limit(0), asked).count()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_sig_attribute_value_in_many_pieces_equals_sql(spark, duck, monkeypatch, small_tasks):
    from tidemark.queries import binding

    monkeypatch.setattr(binding, "PIECE", 3)
    got = entry.engine.QUERIES["sig_attribute_value"](spark, DIR).toPandas()
    assert canonical(got) == canonical(duck.sql(entry.engine.SQL["sig_attribute_value"]).df())


def test_seed_matches_meet_by_value_and_a_seed_without_one_keeps_all(spark):
    from tidemark.operators.constraints import seed_matches

    asked = spark.createDataFrame([(1,), (2,), (3,)], "request_id long")
    seeds = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 13)], "request_id long, item long")
    items = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a"), (13, None), (14, "c")], "item long, brand string")
    got = seed_matches(asked, seeds, items, "brand")
    every = [10, 11, 12, 13, 14]
    assert sorted((r["request_id"], r["item"]) for r in got.collect()) == [(1, 10), (1, 11), (1, 12)] + [(2, i) for i in every] + [(3, i) for i in every]


def test_flt_seed_ref_makes_no_pair_that_does_not_match(spark):
    assert "arrays_overlap" not in plan(entry.engine.QUERIES["flt_seed_ref"](spark, DIR))


def test_near_places_compares_a_place_once(spark):
    from tidemark.operators.constraints import near_places

    items = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 50.0, 0.0), (4, None, 0.0)], "item long, lat double, lon double")
    origins = spark.createDataFrame([(7, 1.0, 0.0), (8, 1.0, 0.0), (9, None, 0.0)], "request_id long, o_lat double, o_lon double")
    got = near_places(items, origins, 1000.0)
    assert sorted((r["request_id"], r["item"]) for r in got.collect()) == [(7, 1), (7, 2), (8, 1), (8, 2), (9, 1), (9, 2), (9, 3), (9, 4)]
    assert "BroadcastNestedLoopJoin" in plan(got) and plan(got).count("collect_list") >= 2


def test_lists_are_dealt_to_every_request_that_shares_them(spark):
    from tidemark.operators.scoring import dealt

    lists = spark.createDataFrame([(0, 5), (0, 6), (1, 7)], "request_id long, item long")
    asked = spark.createDataFrame([(20, 0), (40, 1), (60, 0)], "request_id long, list_id long")
    assert sorted((r["request_id"], r["item"]) for r in dealt(lists, asked).collect()) == [(20, 5), (20, 6), (40, 7), (60, 5), (60, 6)]


def test_answer_of_one_list_is_that_of_all_pairs(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import scoring

    scored = spark.createDataFrame([(i, float(i % 4)) for i in range(12)], "item long, score double")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "request_id long")
    out = spark.createDataFrame([(1, 3), (1, 7), (1, 11), (2, 0)], "request_id long, item long")
    keys = ["request_id", "item", "rank", "position"]
    whole = scoring.answer(scoring.ordered(scored.crossJoin(F.broadcast(asked))), out, 3)
    short = scoring.answer_of_one(scored, asked, out, 3)
    assert sorted(map(tuple, short.select(keys).collect())) == sorted(map(tuple, whole.select(keys).collect()))
    assert "CartesianProduct" not in plan(short) and "Range" not in plan(short)


#: Queries that score a list once for all requests that share it.
LISTED = [
    "explain_breakdown",
    "norm_minmax",
    "explain_reason",
    "norm_none",
    "rule_diversity",
    "norm_rank",
    "rule_boost",
    "rule_mix",
    "rule_pin",
    "rule_place",
    "score_sum",
    "rule_quota",
]


@pytest.mark.parametrize("name", LISTED)
def test_requests_that_share_a_list_are_scored_once(spark, name):
    assert "list_id" in plan(entry.engine.QUERIES[name](spark, DIR))


def test_user_neighbours_shuffle_pairs_once(spark, no_small_sides):
    from tidemark.operators import users

    profile = spark.createDataFrame([(u, i, 1.0 + u) for u in range(4) for i in range(u, u + 3)], "user long, item long, w double")
    queries = profile.selectExpr("user AS request_id", "user AS requester", "item", "w")
    near = users.neighbours(queries, profile)
    assert len(near.where("request_id = 0").collect()) == 2
    steps = plan(near)
    assert steps.count("REPARTITION_BY_COL") == 1
    assert "Exchange" not in steps[: steps.index("REPARTITION_BY_COL")].rsplit("Exchange", 1)[0]


def test_neighbours_items_without_ones_own(spark):
    from tidemark.operators import signals, users

    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25)], "request_id long, user long, sim double")
    profile = spark.createDataFrame([(1, 10, 1.0), (2, 10, 1.0), (2, 11, 2.0), (3, 11, 4.0), (3, 12, 1.0)], "user long, item long, w double")
    own = spark.createDataFrame([(1, 10), (9, 11)], "request_id long, item long")
    keys = ["request_id", "item", "weighted", "holders"]
    assert sorted(map(tuple, users.neighbour_items(near, profile, own).select(keys).collect())) == [(1, 11, 2.0, 2), (1, 12, 0.25, 1)]
    assert sorted(map(tuple, users.neighbour_items(near, profile).select(keys).collect())) == [(1, 10, 0.5, 1), (1, 11, 2.0, 2), (1, 12, 0.25, 1)]
    assert sorted(map(tuple, signals.held_share(near, profile, 2).collect())) == [(1, 10, 0.0), (1, 11, 2.0 / 0.75), (1, 12, 0.0)]


def test_candidate_pairs_are_item_pairs_of_the_candidates(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import candidates as cand

    items = spark.createDataFrame([(i, float(i)) for i in range(6)], "item long, x double")
    seeds = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, 5)], "request_id long, seed_pos int, item long")
    wanted = spark.createDataFrame([(1, 0), (1, 4), (2, 1)], "request_id long, item long")
    like = F.col("x") - F.col("s_x")
    want = cand.item_pairs(seeds, items, like).join(wanted, ["request_id", "item"]).select("request_id", "seed_pos", "item", "value")
    assert sorted(map(tuple, cand.candidate_pairs(wanted, seeds, items, like).collect())) == sorted(map(tuple, want.collect()))


def test_planner_items_compares_candidates_only(spark, monkeypatch):
    from tidemark.operators import candidates as cand

    monkeypatch.setattr(cand, "item_pairs", lambda *a, **k: pytest.fail("every item meets every seed"))
    entry.engine.QUERIES["planner_items"](spark, DIR)


def test_over_seed_everywhere_is_over_seed_of_all_pairs(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.signals import over_seed, over_seed_everywhere

    items = spark.createDataFrame([(i,) for i in range(5)], "item long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "request_id long")
    seeds = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 2)], "request_id long, seed_pos int, item long")
    pairs = spark.createDataFrame([(1, 0, 3, 2.0), (1, 1, 3, 1.0), (2, 0, 4, 5.0), (2, 0, 99, 1.0)], "request_id long, seed_pos int, item long, value double")
    want = over_seed(items.crossJoin(asked).withColumn("cand_pos", F.lit(0)), seeds, pairs, 0.5).select("request_id", "item", "raw")
    got = over_seed_everywhere(items, asked, seeds, pairs, 0.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sig_co_occurrence_count_joins_no_pairs_of_the_product(spark, no_small_sides, small_tasks):
    steps = plan(entry.engine.QUERIES["sig_co_occurrence_count"](spark, DIR))
    assert "LeftOuter" not in steps[: steps.index("BroadcastNestedLoopJoin")]


def test_seed_combine_shuffles_no_pairs(spark, no_small_sides, small_tasks):
    steps = plan(entry.engine.QUERIES["seed_combine"](spark, DIR))
    assert "Exchange" not in steps[: steps.index("BroadcastNestedLoopJoin")]


def test_seed_combine_makes_no_set_for_a_pair(spark):
    steps = plan(entry.engine.QUERIES["seed_combine"](spark, DIR))
    assert "array_union" not in steps and "array_intersect" not in steps and "bit_count" in steps


@pytest.mark.parametrize("most", [504, 3])
def test_jaccard_of_bits_is_that_of_the_sets(spark, monkeypatch, most):
    from pyspark.sql import functions as F

    from tidemark.functions import similarity as sim

    monkeypatch.setattr(sim, "BITS", most)
    monkeypatch.setattr(sim, "WIDE", 2)
    rows = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["c", "d", "e"]), (2, []), (3, None), (4, ["e"]), (5, [])], "k int, words array<string>")
    made, bits = sim.as_bits(rows, "words")
    assert len(bits) == (3 if most == 504 else 0)
    if bits:
        other = made.select(*[F.col(c).alias(f"s_{c}") for c in made.columns])
        both = made.crossJoin(other).select(sim.jaccard(F.col("words"), F.col("s_words")).alias("x"), sim.jaccard_of_bits([F.col(b) for b in bits], [F.col(f"s_{b}") for b in bits]).alias("y")).collect()
        assert len(both) == 36 and all(r["x"] == r["y"] for r in both)
    gap = spark.createDataFrame([(["a", None],)], "words array<string>")
    assert sim.as_bits(gap, "words")[1] == []


def test_scores_in_place_are_those_of_joined_signals(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import scoring

    rows = spark.createDataFrame([(r, i, i, None if (r + i) % 3 == 0 else float(i * r % 5), float(i % 4)) for r in (1, 2) for i in range(9)] + [(3, 1, 1, None, 2.0)], "request_id long, item long, cand_pos long, a double, b double")
    made = {"a": F.col("a"), "b": -F.col("b"), "c": F.col("a") + F.col("b"), "z": F.col("a")}
    weights, how = {"a": 0.5, "b": 0.3, "c": 0.2, "z": 0.0}, {"b": "rank", "c": "none"}
    signals = {s: rows.select("request_id", "item", x.alias("raw")) for s, x in made.items()}
    want = scoring.ordered(scoring.score(rows.select("request_id", "item", "cand_pos"), signals, weights, how))
    place = scoring.score_in_place(rows, made, weights, how)
    got = scoring.ordered(place.withColumn("parts", scoring.parts(["a", "b", "c"])))
    keys = ["request_id", "item", "score", "rank", "parts"]
    flat = lambda df: sorted((r["request_id"], r["item"], r["score"], r["rank"], sorted(r["parts"].items())) for r in df.select(keys).collect())
    assert flat(got) == flat(want)
    assert sorted(map(tuple, scoring.head(place, 2).select(keys[:4]).collect())) == sorted(map(tuple, got.where("rank <= 2").select(keys[:4]).collect()))
    assert sorted(r["score"] for r in scoring.score_in_place(rows, made, {"b": 1.0}, how).collect()) == sorted(r["score"] for r in scoring.score(rows, signals, {"b": 1.0}, how).collect())


#: Queries whose signals are columns of the candidate's row.
IN_PLACE = [
    "explain_reason",
    "rule_diversity",
    "rule_boost",
    "rule_mix",
    "rule_pin",
    "rule_place",
    "score_sum",
    "rule_quota",
]


@pytest.mark.parametrize("name", IN_PLACE)
def test_signals_of_the_row_are_not_joined(spark, monkeypatch, name):
    from tidemark.operators import scoring

    monkeypatch.setattr(scoring, "score", lambda *a, **k: pytest.fail("candidates are joined with their signals"))
    entry.engine.QUERIES[name](spark, DIR)


def test_norm_minmax_gathers_no_list(spark):
    assert "Window" not in plan(entry.engine.QUERIES["norm_minmax"](spark, DIR))


@pytest.mark.parametrize("name", ["norm_none", "norm_rank"])
def test_lists_are_dealt_out_by_item(spark, small_tasks, name):
    assert "hashpartitioning(item" in plan(entry.engine.QUERIES[name](spark, DIR))


def ranks(spark, rows, descending):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    whole = Window.partitionBy("request_id")
    order = F.desc_nulls_last("x") if descending else F.asc_nulls_last("x")
    want = rows.select("request_id", "item", F.when(F.col("x").isNotNull(), F.row_number().over(whole.orderBy(order, "item"))), F.count("x").over(whole))
    return sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_places_by_ranges_are_those_of_whole_lists(spark, ranges, descending):
    from pyspark.sql import functions as F

    from tidemark.operators.scoring import placed

    odd = [None, 0.0, -0.0, 0.0, 2.5, float("nan"), float("inf"), -3.0, 0.0]
    rows = spark.createDataFrame([(r, i * 3 + 7, odd[i * i % 9] if r == 1 else float(i * 37 % 101) if r == 2 else None) for r in (1, 2, 3) for i in range(200)], "request_id long, item long, x double")
    got = placed(rows, F.col("x"), ranges, 5, descending).select("request_id", "item", "place", "known")
    assert sorted(map(tuple, got.collect())) == ranks(spark, rows, descending)


#: Queries that order a whole list.
PLACED = ["norm_rank", "rule_boost"]


@pytest.mark.parametrize("name", PLACED)
def test_no_whole_list_is_ordered_in_one_task(spark, small_tasks, name):
    got = entry.engine.QUERIES[name](spark, DIR)
    orders = [line for line in plan(got).splitlines() if "row_number()" in line and "Window " in line]
    assert orders and all("__range" in line for line in orders)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", PLACED)
def test_lists_of_many_ranges_equal_sql(spark, duck, small_tasks, name):
    got = entry.engine.QUERIES[name](spark, DIR).toPandas()
    assert canonical(got) == canonical(duck.sql(entry.engine.SQL[name]).df())


#: Products that are written piece by piece.
PIECED = ["sig_attribute_value", "flt_in_seed", "flt_range", "flt_when_guard", "flt_seed_ref", "sig_co_occurrence_count", "norm_minmax", "norm_none", "norm_rank", "rule_boost", "rule_pin", "score_sum"]


@pytest.mark.parametrize("name", PIECED)
def test_products_are_written_piece_by_piece(spark, name):
    steps = [line for line in plan(entry.engine.QUERIES[name](spark, DIR)).splitlines() if "Sort [" in line]
    assert any("__piece" in line for line in steps)


@pytest.mark.parametrize("piece", [1, 2, 504])
def test_pieces_by_value_are_whole(spark, piece):
    from tidemark.operators.products import in_pieces

    rows = spark.createDataFrame([(1, "a", [7]), (2, "b", None), (3, None, None), (4, "a", [5, 6])], "item long, k string, own array<long>")
    asked = spark.createDataFrame([("a", r) for r in (5, 6, 7)] + [("b", 6), ("b", 6), ("c", 9), (None, 8)], "k string, request_id long")
    got = in_pieces(rows, asked, on=("k",), own="own", piece=piece)
    assert got.columns == ["request_id", "item", "k"]
    assert sorted(map(tuple, got.collect())) == [(5, 1, "a"), (6, 1, "a"), (6, 2, "b"), (6, 2, "b"), (7, 4, "a")]
    two = spark.createDataFrame([(1, None), (2, 0.5), (2, 0.5)], "shown long, x double")
    both = in_pieces(rows.select("item"), two, piece=piece)
    assert both.columns == ["shown", "x", "item"] and both.count() == 12 and both.where("x IS NULL").count() == 4
