"""Pairwise metrics between every item and the seed items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import similarity as sim
from tidemark.operators import candidates as cand
from tidemark.queries import query
from tidemark.queries.binding import SQL_ITEMS, SQL_SCALES, SQL_SEEDS, items, requests, scales, seeds, table, tasks

A, B = F.col, lambda c: F.col(f"s_{c}")
#: Terms of content likeness and their weights.
TERMS = {"words": 0.5, "ptype": 0.2, "size": 0.15, "price": 0.15}

SQL_PAIRS = f"{SQL_ITEMS}, {SQL_SEEDS}, {SQL_SCALES}, fs AS (SELECT request_id AS item FROM req), p AS (SELECT s.item AS seed_item, i.item, i.words AS w1, s.words AS w2, i.ptype AS t1, s.ptype AS t2, i.size AS s1, s.size AS s2, i.price AS p1, s.price AS p2, sc.* FROM items i, (SELECT items.* FROM items JOIN fs USING (item)) s, sc)"
JACCARD = "len(list_intersect(w1, w2))::DOUBLE / len(list_distinct(list_concat(w1, w2)))"
CLOSE_SIZE = "greatest(0, 1 - abs(s1 - s2) / (hi_size - lo_size))"
CLOSE_PRICE = "greatest(0, 1 - abs(p1 - p2) / (hi_price - lo_price))"


def pairs(spark, d, value):
    """``seed_item, item, value`` for the requests' own items."""
    own = requests(spark, d).select("request_id", F.lit(0).alias("seed_pos"), F.col("request_id").alias("item"))
    ranged = items(spark, d).crossJoin(F.broadcast(scales(items(spark, d), ["size", "price"])))
    return cand.item_pairs(own, ranged, value).select(F.col("request_id").alias("seed_item"), "item", F.round("value", 6).alias("value"))


@query("sim_jaccard", f"{SQL_PAIRS} SELECT seed_item, item, round({JACCARD}, 6) AS value FROM p")
def sim_jaccard(spark, d):
    return pairs(spark, d, sim.jaccard(A("words"), B("words")))


@query("sim_equals", f"{SQL_PAIRS} SELECT seed_item, item, (t1 = t2)::INTEGER::DOUBLE AS value FROM p")
def sim_equals(spark, d):
    return pairs(spark, d, sim.equals(A("ptype"), B("ptype")))


@query("sim_log_ratio", f"{SQL_PAIRS} SELECT seed_item, item, round(greatest(0, 1 - abs(ln(p1) - ln(p2)) / ln(10.0)), 6) AS value FROM p")
def sim_log_ratio(spark, d):
    return pairs(spark, d, sim.log_ratio(A("price"), B("price")))


@query("sim_closeness", f"{SQL_PAIRS} SELECT seed_item, item, round({CLOSE_SIZE}, 6) AS value FROM p")
def sim_closeness(spark, d):
    return pairs(spark, d, sim.closeness(A("size"), B("size"), F.col("lo_size"), F.col("hi_size")))


@query("sim_cosine_group", f"""{SQL_PAIRS}, q AS (SELECT seed_item, item, (s1 - lo_size) / (hi_size - lo_size) AS a1, (s2 - lo_size) / (hi_size - lo_size) AS a2, (p1 - lo_price) / (hi_price - lo_price) AS b1, (p2 - lo_price) / (hi_price - lo_price) AS b2 FROM p)
SELECT seed_item, item, round(CASE WHEN (a1 * a1 + b1 * b1) * (a2 * a2 + b2 * b2) = 0 THEN 0 ELSE (a1 * a2 + b1 * b2) / (sqrt(a1 * a1 + b1 * b1) * sqrt(a2 * a2 + b2 * b2)) END, 6) AS value FROM q""")
def sim_cosine_group(spark, d):
    return pairs(spark, d, sim.cosine_group([A("size"), A("price")], [B("size"), B("price")], [(F.col("lo_size"), F.col("hi_size")), (F.col("lo_price"), F.col("hi_price"))]))


@query("sim_cosine_vector", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT s.vec_id AS seed_item, v.vec_id AS item, round(list_dot_product(v.e, s.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(s.e, s.e))), 6) AS value FROM v, v s WHERE s.vec_id % 20 = 0""")
def sim_cosine_vector(spark, d):
    # lengths are computed once for each vector, not for each pair
    v = table(spark, d, "embeddings").select("vec_id", "embedding").withColumn("len", sim.norm(F.col("embedding")))
    s = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("seed_item"), F.col("embedding").alias("s"), F.col("len").alias("s_len"))
    both = v.crossJoin(F.broadcast(s))
    size = F.col("len") * F.col("s_len")
    return both.select("seed_item", F.col("vec_id").alias("item"), F.round(F.when(size == 0, 0.0).otherwise(sim.dot(F.col("embedding"), F.col("s")) / F.nullif(size, F.lit(0.0))), 6).alias("value"))


def content(bits=()):
    """Weighted mean of the content terms between an item and a prefixed seed item; ``bits``
    name the words' where they are kept so."""
    words = sim.jaccard_of_bits([A(c) for c in bits], [B(c) for c in bits]) if bits else sim.jaccard(A("words"), B("words"))
    return sim.weighted_mean([
        (words, TERMS["words"]), (sim.equals(A("ptype"), B("ptype")), TERMS["ptype"]),
        (sim.closeness(A("size"), B("size"), F.col("lo_size"), F.col("hi_size")), TERMS["size"]), (sim.closeness(A("price"), B("price"), F.col("lo_price"), F.col("hi_price")), TERMS["price"]),
    ])


SQL_CONTENT = f"({JACCARD} * 0.5 + (t1 = t2)::INTEGER * 0.2 + {CLOSE_SIZE} * 0.15 + {CLOSE_PRICE} * 0.15) / 1.0"


@query("sim_weighted_terms", f"{SQL_PAIRS} SELECT seed_item, item, round({SQL_CONTENT}, 6) AS value FROM p")
def sim_weighted_terms(spark, d):
    return pairs(spark, d, content())


@query("sim_cross", f"""{SQL_ITEMS}, b AS (SELECT brand, list_sort(list_distinct(flatten(list(words)))) AS words FROM items GROUP BY brand)
SELECT b.brand, i.item, round(len(list_intersect(i.words, b.words))::DOUBLE / len(list_distinct(list_concat(i.words, b.words))), 6) AS value FROM items i, b""")
def sim_cross(spark, d):
    """Two entity types on a shared vocabulary: items and brands, by their words."""
    rows = items(spark, d)
    brands = rows.groupBy("brand").agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("b_words"))
    return rows.select("item", "words").crossJoin(F.broadcast(brands)).select("brand", "item", F.round(sim.jaccard(F.col("words"), F.col("b_words")), 6).alias("value"))


def seed_pairs(spark, d, value=None):
    """``request_id, seed_pos, item, value`` over the three seed items."""
    ranged = items(spark, d).crossJoin(F.broadcast(scales(items(spark, d), ["size", "price"])))
    return cand.item_pairs(seeds(spark, d), ranged, content() if value is None else value)


SQL_SEED_PAIRS = f"{SQL_ITEMS}, {SQL_SEEDS}, {SQL_SCALES}, p AS (SELECT z.request_id, z.seed_pos, i.item, i.words AS w1, s.words AS w2, i.ptype AS t1, s.ptype AS t2, i.size AS s1, s.size AS s2, i.price AS p1, s.price AS p2, sc.* FROM seeds z JOIN items s ON s.item = z.item, items i, sc), pv AS (SELECT request_id, seed_pos, item, {SQL_CONTENT} AS v FROM p)"


@query("seed_combine", f"{SQL_SEED_PAIRS} SELECT request_id, item, round(0.6 * avg(v) + 0.4 * max(v), 6) AS value FROM pv GROUP BY request_id, item")
def seed_combine(spark, d):
    from tidemark.functions.normalise import combine

    wanted = seeds(spark, d)
    found, bits = sim.as_bits(items(spark, d).select("item", "words", "ptype", "size", "price"), "words")
    ranged = found.crossJoin(F.broadcast(scales(found, ["size", "price"])))
    pairs = cand.item_pairs_in_place(wanted, ranged, content(bits), tasks(ranged.count() * wanted.count()))
    return pairs.groupBy("request_id", "item").agg(F.round(combine(F.avg("value"), F.max("value"), 0.4), 6).alias("value"))


@query("src_item_neighbors", f"""{SQL_SEED_PAIRS}, m AS (SELECT request_id, item, round(max(v), 9) AS value FROM pv GROUP BY request_id, item),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY value DESC, item) AS src_rank FROM m WHERE value > 0 AND (request_id, item) NOT IN (SELECT request_id, item FROM seeds))
SELECT request_id, item, round(value, 6) AS value, src_rank::INTEGER AS src_rank FROM r WHERE src_rank <= 200""")
def src_item_neighbors(spark, d):
    best = seed_pairs(spark, d).groupBy("request_id", "item").agg(F.round(F.max("value"), 9).alias("value"))
    return cand.top(best, seeds(spark, d)).select("request_id", "item", F.round("value", 6).alias("value"), "src_rank")
