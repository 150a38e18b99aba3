"""Signals: one raw number for each request and candidate, NULL for no information.

Each takes ``candidates(request_id, item, cand_pos, ...)`` joined with what it reads and
returns ``request_id, item, cand_pos, raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.decay import age_seconds, micros
from tidemark.functions.expressions import compile_column
from tidemark.functions.geo import haversine_km
from tidemark.functions.normalise import combine
from tidemark.operators.products import in_pieces
from tidemark.operators.users import neighbour_items
from tidemark.sources.checkpoints import cut

KEYS = ["request_id", "item", "cand_pos"]


def over_seed(candidates: DataFrame, seeds: DataFrame, pairs: DataFrame, share: float, unknown_spreads: bool = False) -> DataFrame:
    """Blend of mean and greatest of ``pairs(request_id, seed_pos, item, value)`` over the
    seed; a pair that is absent is 0 (or, if unknowns spread, makes the candidate
    unknown).  An empty seed gives 0."""
    sizes = seeds.groupBy("request_id").agg(F.count("*").alias("n"))
    met = pairs.groupBy("request_id", "item").agg(F.sum("value").alias("total"), F.max("value").alias("most"), F.count("value").alias("known"))
    rows = candidates.select(*KEYS).join(sizes, "request_id", "left").join(met, ["request_id", "item"], "left")
    total, most = F.coalesce("total", F.lit(0.0)), F.coalesce("most", F.lit(0.0))
    if not unknown_spreads:  # absent pairs are zeros that can be the greatest
        most = F.when(F.coalesce("known", F.lit(0)) < F.col("n"), F.greatest(most, F.lit(0.0))).otherwise(most)
    value = F.when(F.col("n").isNull(), 0.0).otherwise(combine(total / F.col("n"), most, share))
    if unknown_spreads:
        value = F.when(F.col("n").isNull() | (F.coalesce("known", F.lit(0)) == F.col("n")), value)
    return rows.select(*KEYS, value.alias("raw"))


def over_seed_everywhere(items: DataFrame, requests: DataFrame, seeds: DataFrame, pairs: DataFrame, share: float, tasks: int = 1) -> DataFrame:
    """``request_id, item, raw`` of ``over_seed`` with all items as candidates of every
    request: only what meets a seed is joined, every other pair is 0 and made in place."""
    met = pairs.select("request_id", "item").distinct().join(items.select("item"), "item", "left_semi").join(requests, "request_id", "left_semi")
    some = cut(over_seed(met.withColumn("cand_pos", F.lit(0)), seeds, pairs, share).select("request_id", "item", "raw"))  # read twice
    has = some.groupBy("item").agg(F.collect_list("request_id").alias("own"))
    rest = items.select("item").join(has, "item", "left").repartition(tasks)
    return some.unionByName(in_pieces(rest, requests.select("request_id"), own="own").select("request_id", "item", F.lit(0.0).alias("raw")))


def neighbour_share(candidates: DataFrame, near: DataFrame, items: DataFrame, min_neighbours: int = 1) -> DataFrame:
    """The neighbours' weights for an item as a share of their likeness; 0 unless enough
    of them hold it."""
    total = near.groupBy("request_id").agg(F.sum("sim").alias("all_sim"))
    rows = candidates.select(*KEYS).join(items, ["request_id", "item"], "left").join(total, "request_id", "left")
    value = F.when(F.col("holders") >= max(1, min_neighbours), F.try_divide("weighted", "all_sim"))
    return rows.select(*KEYS, F.coalesce(value, F.lit(0.0)).alias("raw"))


def held_share(near: DataFrame, profile: DataFrame, min_neighbours: int = 1) -> DataFrame:
    """``neighbour_share`` where the candidates are all that the neighbours hold."""
    total = near.withColumn("all_sim", F.sum("sim").over(Window.partitionBy("request_id")))
    held = neighbour_items(total, profile, carry=("all_sim",))
    value = F.when(F.col("holders") >= max(1, min_neighbours), F.try_divide("weighted", "all_sim"))
    return held.select("request_id", "item", F.coalesce(value, F.lit(0.0)).alias("raw"))


def attribute_target(candidates: DataFrame, x: Column, target: Column, lo: Column, hi: Column) -> DataFrame:
    """Nearness of an attribute to a target on the catalogue's range; missing is 0."""
    near = F.greatest(F.lit(0.0), 1 - F.abs(x - target) / F.nullif(hi - lo, F.lit(0.0)))
    return candidates.select(*KEYS, F.coalesce(near, F.lit(0.0)).alias("raw"))


def proximity(candidates: DataFrame, lat: Column, lon: Column, of_lat: Column, of_lon: Column, half_km: float = 10.0) -> DataFrame:
    """Halved every ``half_km``; 0 without a place or an origin."""
    value = F.pow(F.lit(2.0), -haversine_km(lat, lon, of_lat, of_lon) / half_km)
    return candidates.select(*KEYS, F.coalesce(value, F.lit(0.0)).alias("raw"))


def event_counts(events: DataFrame, now: Column, types: list[str] | None = None, window_seconds: float | None = None) -> DataFrame:
    """``item, n, people`` of the events since ``now - window``; later ones count too."""
    rows = events if types is None else events.where(F.col("type").isin(types))
    if window_seconds is not None:
        rows = rows.where(micros(F.col("ts")) >= micros(now) - F.lit(int(window_seconds * 1e6)))
    return rows.groupBy(F.col("target").alias("item")).agg(F.count("*").alias("n"), F.countDistinct("user").alias("people"))


def global_count(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``ln(1 + n)``."""
    return candidates.join(counts.select("item", "n"), "item", "left").select(*KEYS, F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("raw"))


def low_exposure(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``1 / sqrt(1 + n)`` over all events."""
    return candidates.join(counts.select("item", "n"), "item", "left").select(*KEYS, (1 / F.sqrt(1.0 + F.coalesce("n", F.lit(0)))).alias("raw"))


def age_decay(candidates: DataFrame, ts: Column, now: Column, half_life: float) -> DataFrame:
    """Halved every half-life since ``ts``; missing is 0, the future above 1."""
    if half_life <= 0:
        return candidates.select(*KEYS, F.lit(0.0).alias("raw"))
    return candidates.select(*KEYS, F.coalesce(F.pow(F.lit(2.0), -age_seconds(ts, now, False) / half_life), F.lit(0.0)).alias("raw"))


def context_match(candidates: DataFrame, members: Column, words: Column) -> DataFrame:
    """Share of the context's words that are in the item's set."""
    share = F.size(F.array_intersect(members, words)) / F.nullif(F.size(words).cast("double"), F.lit(0.0))
    return candidates.select(*KEYS, F.coalesce(share, F.lit(0.0)).alias("raw"))


def provided(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores sent with the request; missing ones are 0."""
    rows = candidates.join(scores, ["request_id", "item"], "left")
    return rows.select(*KEYS, F.coalesce("score", F.lit(0.0)).alias("raw"))


def trend(events: DataFrame, now: Column, window: float, baseline: float, ratio: float = 1.0, least: int = 1, people: bool = True) -> DataFrame:
    """``item, raw``: ``max(0, ln(pace / ratio))`` with pace ``(recent + 1) / (ordinary +
    1)``, once the recent count is ``least``.  Recent is the last ``window`` seconds,
    ordinary the ``baseline`` seconds before it, scaled to the window's length."""
    age = age_seconds(F.col("ts"), now, False)
    rows = events.withColumn("recent", age <= window).where(age <= window + baseline)
    count = (lambda c: F.countDistinct(F.when(c, F.col("user")))) if people else (lambda c: F.count_if(c))
    per = rows.groupBy(F.col("target").alias("item")).agg(count(F.col("recent")).alias("recent"), count(~F.col("recent")).alias("before"))
    pace = (F.col("recent") + 1.0) / (F.col("before") * (window / baseline) + 1.0)
    return per.select("item", F.when(F.col("recent") >= least, F.greatest(F.lit(0.0), F.ln(pace / ratio))).otherwise(0.0).alias("raw"))


def mutual_connections(edges: DataFrame) -> DataFrame:
    """``user, other, mutuals``: neighbours that two users share over ``edges(user,
    target)``, each unordered pair from both sides; direct neighbours count too."""
    both = edges.select(F.col("user").alias("a"), F.col("target").alias("m")).distinct()
    return both.join(both.select(F.col("a").alias("b"), "m"), "m").where("a <> b").groupBy(F.col("a").alias("user"), F.col("b").alias("other")).agg(F.count("*").alias("mutuals"))


def next_items(events: DataFrame, gap_seconds: float) -> DataFrame:
    """``item, following, n``: how often an item follows another in a session, sessions
    ending at a pause of more than ``gap_seconds``."""
    from pyspark.sql import Window

    order = Window.partitionBy("user").orderBy("ts", "seq", "target")
    steps = events.select("user", "target", "ts", "seq", F.lead("target").over(order).alias("following"), F.lead("ts").over(order).alias("then"))
    inside = (micros(F.col("then")) - micros(F.col("ts"))) / 1e6 <= gap_seconds
    return steps.where(inside & (F.col("target") != F.col("following"))).groupBy(F.col("target").alias("item"), "following").agg(F.count("*").alias("n"))


def recurrence(events: DataFrame, min_users: int = 1) -> DataFrame:
    """``item, usual_gap, users``: median seconds between a user's events on an item."""
    from pyspark.sql import Window

    order = Window.partitionBy("user", "target").orderBy("ts", "seq", "target")
    gaps = events.withColumn("gap", (micros(F.col("ts")) - micros(F.lag("ts").over(order))) / 1e6).where("gap > 0")
    per = gaps.groupBy(F.col("target").alias("item")).agg(F.percentile("gap", 0.5).alias("usual_gap"), F.countDistinct("user").alias("users"))
    return per.where(F.col("users") >= min_users)


def attribute_match(candidates: DataFrame, attr: Column, value: Column, attr_set: bool = False, value_set: bool = False) -> DataFrame:
    """1 if an attribute equals a value or shares a member with it, else 0; 0 if either is
    missing."""
    a, b = attr if attr_set else F.array(attr), value if value_set else F.array(value)
    return candidates.select(*KEYS, F.coalesce(F.arrays_overlap(a, b), F.lit(False)).cast("double").alias("raw"))


def attribute_value(candidates: DataFrame, x: Column) -> DataFrame:
    """The number itself; NULL if missing, which normalises to the middle."""
    return candidates.select(*KEYS, x.cast("double").alias("raw"))


def formula(candidates: DataFrame, source: str, env: dict) -> DataFrame:
    """An expression over the candidate's row; NULL where it reads something missing."""
    return candidates.select(*KEYS, compile_column(source, env).column.cast("double").alias("raw"))


def satiation(candidates: DataFrame, fulfilled: DataFrame, by: str) -> DataFrame:
    """``1 / (1 + n)`` with ``n`` the user's fulfilling events on items of the candidate's
    ``by`` value; 1 without a user or a value.  ``candidates`` has ``user`` and ``by``,
    ``fulfilled`` has ``user`` and ``by``; a row of counts for each user and value is joined."""
    done = fulfilled.where(F.col("user").isNotNull() & F.col(by).isNotNull()).groupBy("user", by).agg(F.count("*").alias("n"))
    return candidates.join(done, ["user", by], "left").select(*KEYS, (1 / (1.0 + F.coalesce("n", F.lit(0)))).alias("raw"))
