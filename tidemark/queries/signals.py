"""Signals and candidate sources over all requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.decay import edge_weight, fade
from tidemark.operators import candidates as cand
from tidemark.operators import cooccurrence as co
from tidemark.operators import scoring
from tidemark.operators import signals as sig
from tidemark.operators import users as usr
from tidemark.queries import query
from tidemark.queries.binding import DAY, HALF_LIFE, SQL_AGE, SQL_EVENTS, SQL_ITEMS, SQL_NOW, SQL_SCALES, SQL_SEEDS, all_candidates, events, in_pieces, items, now, requests, scales, seeds, table, tasks
from tidemark.sources.checkpoints import cut

#: Weight of a purchase: the logarithm of its quantity, halved every year.
WINDOW = 200 * DAY


def purchase_weight(clamp: bool = False):
    value = F.when(F.col("type") == "purchase", edge_weight(F.col("value"), 1.0, True, "log1p"))
    return value * fade(F.col("ts"), now(), HALF_LIFE, clamp)


SQL_PROFILE = f"prof AS (SELECT usr, target AS item, sum(ln(1 + greatest(value, 0)) * power(2.0, -({SQL_AGE}) / (365 * 86400.0))) AS w FROM ev WHERE type = 'purchase' GROUP BY usr, target HAVING sum(1) > 0)"
SQL_DAMPED = "damp AS (SELECT usr, item, w / ln(2.0 + count(*) OVER (PARTITION BY item)) AS w FROM prof)"


def profile(spark, d):
    return usr.profiles(events(spark, d), items(spark, d), purchase_weight())


@query("taste_profiles", f"{SQL_EVENTS}, {SQL_PROFILE} SELECT usr AS user_id, item, round(w, 6) AS w FROM prof")
def taste_profiles(spark, d):
    return profile(spark, d).select(F.col("user").alias("user_id"), "item", F.round("w", 6).alias("w"))


@query("damp_popular", f"{SQL_EVENTS}, {SQL_PROFILE}, {SQL_DAMPED} SELECT usr AS user_id, item, round(w, 6) AS w FROM damp")
def damp_popular(spark, d):
    return usr.damped(profile(spark, d)).select(F.col("user").alias("user_id"), "item", F.round("w", 6).alias("w"))


@query("profile_size", f"{SQL_EVENTS} SELECT usr AS user_id, count(DISTINCT target)::BIGINT AS profile_size FROM ev WHERE type = 'purchase' GROUP BY usr")
def profile_size(spark, d):
    return usr.profile_sizes(events(spark, d), ["purchase"]).withColumnRenamed("user", "user_id")


@query("recent_items", f"""{SQL_EVENTS}, l AS (SELECT usr, target AS item, max(seq) AS seq FROM ev WHERE type = 'purchase' GROUP BY usr, target),
r AS (SELECT usr AS user_id, item, row_number() OVER (PARTITION BY usr ORDER BY seq DESC, item)::INTEGER AS pos FROM l) SELECT * FROM r WHERE pos <= 50""")
def recent_items(spark, d):
    return usr.recent_items(events(spark, d), ["purchase"]).withColumnRenamed("user", "user_id")


SQL_NEAR = """dots AS (SELECT a.usr AS request_id, b.usr, sum(a.w * b.w) AS dot, count(*) AS shared FROM damp a JOIN damp b ON a.item = b.item AND a.usr <> b.usr GROUP BY a.usr, b.usr),
len AS (SELECT usr, sqrt(sum(w * w)) AS l FROM damp GROUP BY usr), sims AS (SELECT d.request_id, d.usr, dot / (x.l * y.l) AS sim, shared FROM dots d JOIN len x ON x.usr = d.request_id JOIN len y ON y.usr = d.usr WHERE dot > 0 AND shared >= 1),
near AS (SELECT request_id, usr, sim, shared FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(sim, 9) DESC, usr) AS nth FROM sims) WHERE nth <= 50)"""


def near_users(spark, d):
    damped = cut(usr.damped(profile(spark, d)))  # read by every step below
    queries = damped.select(F.col("user").alias("request_id"), F.col("user").alias("requester"), "item", "w")
    return usr.neighbours(queries, damped), damped


@query("sim_users", f"{SQL_EVENTS}, {SQL_PROFILE}, {SQL_DAMPED}, {SQL_NEAR} SELECT request_id, usr AS user_id, round(sim, 6) AS sim, shared::BIGINT AS shared FROM near")
def sim_users(spark, d):
    return near_users(spark, d)[0].select("request_id", F.col("user").alias("user_id"), F.round("sim", 6).alias("sim"), "shared")


SQL_HELD = "held AS (SELECT n.request_id, p.item, sum(n.sim * p.w) AS weighted, count(*) AS holders FROM near n JOIN damp p ON p.usr = n.usr GROUP BY n.request_id, p.item)"


@query("src_user_neighbors", f"""{SQL_EVENTS}, {SQL_PROFILE}, {SQL_DAMPED}, {SQL_NEAR}, {SQL_HELD},
own AS (SELECT DISTINCT usr AS request_id, item FROM prof), r AS (SELECT request_id, item, round(weighted, 9) AS value, row_number() OVER (PARTITION BY request_id ORDER BY round(weighted, 9) DESC, item)::INTEGER AS src_rank FROM held ANTI JOIN own USING (request_id, item) WHERE weighted > 0)
SELECT request_id, item, round(value, 3) AS value, src_rank FROM r WHERE src_rank <= 200""")
def src_user_neighbors(spark, d):
    near, damped = near_users(spark, d)
    own = damped.select(F.col("user").alias("request_id"), "item")
    held = usr.neighbour_items(near, damped, own).select("request_id", "item", F.round("weighted", 9).alias("value"))
    return cand.top(held).select("request_id", "item", F.round("value", 3).alias("value"), "src_rank")


@query("sig_user_neighbors", f"""{SQL_EVENTS}, {SQL_PROFILE}, {SQL_DAMPED}, {SQL_NEAR}, {SQL_HELD}, t AS (SELECT request_id, sum(sim) AS all_sim FROM near GROUP BY request_id)
SELECT request_id, item, round(CASE WHEN holders >= 2 THEN weighted / all_sim ELSE 0 END, 6) AS raw FROM held JOIN t USING (request_id)""")
def sig_user_neighbors(spark, d):
    near, damped = near_users(spark, d)
    return sig.held_share(near, damped, 2).select("request_id", "item", F.round("raw", 6).alias("raw"))


SQL_CO = f"""{SQL_EVENTS}, {SQL_SEEDS}, mem AS (SELECT DISTINCT order_id AS g, target AS item FROM ev), n AS (SELECT item, count(*) AS n FROM mem GROUP BY item), g AS (SELECT count(DISTINCT g) AS groups FROM mem),
si AS (SELECT DISTINCT item FROM seeds), b AS (SELECT a.item AS seed_item, m.item, count(*) AS sup FROM mem a JOIN si ON si.item = a.item JOIN mem m ON m.g = a.g AND m.item <> a.item GROUP BY a.item, m.item),
co AS (SELECT b.seed_item, b.item, sup, x.n AS n_seed, y.n AS n_item, groups FROM b JOIN n x ON x.item = b.seed_item JOIN n y ON y.item = b.item, g)"""


def support(spark, d):
    return co.support(co.memberships(events(spark, d), "order_id"), seeds(spark, d))


@query("pair_support", f"{SQL_CO} SELECT seed_item, item, sup AS support, n_seed, n_item, groups FROM co")
def pair_support(spark, d):
    return support(spark, d).withColumnRenamed("both", "support")


def co_signal(how: str, formula: str):
    sql = f"""{SQL_CO}, z AS (SELECT request_id, count(*) AS k FROM seeds GROUP BY request_id), pv AS (SELECT s.request_id, co.item, CASE WHEN sup >= 1 THEN {formula} ELSE 0 END AS v FROM seeds s JOIN co ON co.seed_item = s.item)
    SELECT r.request_id, p.p_partkey AS item, round(coalesce(0.5 * sum(pv.v) / z.k + 0.5 * max(pv.v), 0), 6) AS raw FROM req r CROSS JOIN part p JOIN z USING (request_id) LEFT JOIN pv ON pv.request_id = r.request_id AND pv.item = p.p_partkey GROUP BY r.request_id, p.p_partkey, z.k"""

    @query(f"sig_co_occurrence_{how}", sql)
    def run(spark, d):
        pairs, asked, catalogue = cut(co.seed_values(seeds(spark, d), support(spark, d), how)), requests(spark, d), items(spark, d)
        made = sig.over_seed_everywhere(catalogue, asked, seeds(spark, d), pairs, 0.5, tasks(catalogue.count() * asked.count()))
        return made.select("request_id", "item", F.round("raw", 6).alias("raw"))

    return run


co_signal("lift", "sup * groups::DOUBLE / (n_seed * n_item)")
co_signal("count", "sup::DOUBLE")
co_signal("jaccard", "sup::DOUBLE / (n_seed + n_item - sup)")


@query("src_co_occurrence", f"""{SQL_CO}, m AS (SELECT s.request_id, co.item, round(max(sup * groups::DOUBLE / (n_seed * n_item)), 9) AS value FROM seeds s JOIN co ON co.seed_item = s.item GROUP BY s.request_id, co.item),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY value DESC, item)::INTEGER AS src_rank FROM m ANTI JOIN seeds USING (request_id, item) WHERE value > 0) SELECT request_id, item, round(value, 6) AS value, src_rank FROM r WHERE src_rank <= 200""")
def src_co_occurrence(spark, d):
    pairs = co.seed_values(seeds(spark, d), support(spark, d))
    best = pairs.groupBy("request_id", "item").agg(F.round(F.max("value"), 9).alias("value"))
    return cand.top(best, seeds(spark, d)).select("request_id", "item", F.round("value", 6).alias("value"), "src_rank")


@query("src_popular", f"""{SQL_EVENTS}, {SQL_SEEDS}, c AS (SELECT target AS item, count(*)::DOUBLE AS value FROM ev GROUP BY target), r AS (SELECT request_id, item, value, row_number() OVER (PARTITION BY request_id ORDER BY value DESC, item)::INTEGER AS src_rank FROM req CROSS JOIN c ANTI JOIN seeds USING (request_id, item)) SELECT * FROM r WHERE src_rank <= 200""")
def src_popular(spark, d):
    ranked = cand.popularity(events(spark, d), items(spark, d))
    return cand.for_requests(requests(spark, d), ranked, seeds(spark, d)).select("request_id", "item", "value", "src_rank")


@query("src_fresh", f"""{SQL_ITEMS}, {SQL_SEEDS}, r AS (SELECT request_id, item, epoch_us(created) / 1e6 AS value, row_number() OVER (PARTITION BY request_id ORDER BY created DESC, item)::INTEGER AS src_rank FROM req CROSS JOIN items ANTI JOIN seeds USING (request_id, item)) SELECT * FROM r WHERE src_rank <= 200""")
def src_fresh(spark, d):
    return cand.for_requests(requests(spark, d), cand.fresh(items(spark, d), "created"), seeds(spark, d)).select("request_id", "item", "value", "src_rank")


@query("src_all", f"{SQL_SEEDS} SELECT request_id, p_partkey AS item, r::INTEGER AS src_rank FROM req, (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part) WHERE r <= 2000")
def src_all(spark, d):
    return cand.everything(requests(spark, d), items(spark, d)).select("request_id", "item", "src_rank")


@query("src_union", f"""{SQL_EVENTS}, {SQL_ITEMS}, {SQL_SEEDS}, c AS (SELECT target AS item, count(*)::DOUBLE AS value FROM ev GROUP BY target),
a AS (SELECT request_id, item, 0 AS src_pos, row_number() OVER (PARTITION BY request_id ORDER BY value DESC, item) AS src_rank FROM req CROSS JOIN c ANTI JOIN seeds USING (request_id, item)),
b AS (SELECT request_id, item, 1 AS src_pos, row_number() OVER (PARTITION BY request_id ORDER BY created DESC, item) AS src_rank FROM req CROSS JOIN items ANTI JOIN seeds USING (request_id, item)),
u AS (SELECT request_id, item, min(src_pos * 1000 + src_rank) AS place FROM (SELECT * FROM a WHERE src_rank <= 200 UNION ALL SELECT * FROM b WHERE src_rank <= 200) GROUP BY request_id, item)
SELECT request_id, item, row_number() OVER (PARTITION BY request_id ORDER BY place)::INTEGER AS cand_pos FROM u""")
def src_union(spark, d):
    one = cand.for_requests(requests(spark, d), cand.popularity(events(spark, d), items(spark, d)), seeds(spark, d))
    two = cand.for_requests(requests(spark, d), cand.fresh(items(spark, d), "created"), seeds(spark, d))
    return cand.union([one, two]).select("request_id", "item", "cand_pos")


@query("sig_attribute_target", f"""{SQL_ITEMS}, {SQL_SEEDS}, {SQL_SCALES}, t AS (SELECT request_id, avg(price) AS target FROM seeds JOIN items USING (item) GROUP BY request_id)
SELECT request_id, item, round(greatest(0, 1 - abs(price - target) / (hi_price - lo_price)), 6) AS raw FROM items, t, sc""")
def sig_attribute_target(spark, d):
    rows = items(spark, d)
    means = seeds(spark, d).join(rows, "item").groupBy("request_id").agg(F.avg("price").alias("target"))
    found = all_candidates(spark, d).join(F.broadcast(means), "request_id").crossJoin(F.broadcast(scales(rows, ["price"])))
    return sig.attribute_target(found, F.col("price"), F.col("target"), F.col("lo_price"), F.col("hi_price")).select("request_id", "item", F.round("raw", 6).alias("raw"))


HAVERSINE = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query("sig_proximity", f"""{SQL_ITEMS}, {SQL_SEEDS} SELECT request_id, i.item, round(power(2.0, -({HAVERSINE.format(a='i.', b='o.')}) / 500.0), 6) AS raw FROM items i, req JOIN items o ON o.item = request_id""")
def sig_proximity(spark, d):
    origin = items(spark, d).select(F.col("item").alias("request_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    found = all_candidates(spark, d).join(F.broadcast(origin.where("request_id % 20 = 0")), "request_id")
    return sig.proximity(found, F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"), 500.0).select("request_id", "item", F.round("raw", 6).alias("raw"))


def one_request(spark, d):
    return items(spark, d).withColumns({"request_id": F.lit(1), "cand_pos": F.col("item")})


@query("sig_global_count", f"""{SQL_EVENTS}, c AS (SELECT target, count(*) AS n FROM ev WHERE type = 'purchase' AND ts >= {SQL_NOW} - INTERVAL 200 DAY GROUP BY target) SELECT p_partkey AS item, round(ln(1.0 + coalesce(n, 0)), 6) AS raw FROM part LEFT JOIN c ON target = p_partkey""")
def sig_global_count(spark, d):
    counts = sig.event_counts(events(spark, d), now(), ["purchase"], WINDOW)
    return sig.global_count(one_request(spark, d), counts).select("item", F.round("raw", 6).alias("raw"))


@query("event_people", f"{SQL_EVENTS} SELECT target AS item, count(*)::BIGINT AS n, count(DISTINCT usr)::BIGINT AS people FROM ev GROUP BY target")
def event_people(spark, d):
    return sig.event_counts(events(spark, d), now())


@query("sig_low_exposure", f"{SQL_EVENTS}, c AS (SELECT target, count(*) AS n FROM ev GROUP BY target) SELECT p_partkey AS item, round(1 / sqrt(1.0 + coalesce(n, 0)), 6) AS raw FROM part LEFT JOIN c ON target = p_partkey")
def sig_low_exposure(spark, d):
    return sig.low_exposure(one_request(spark, d), sig.event_counts(events(spark, d), now())).select("item", F.round("raw", 6).alias("raw"))


@query("sig_age_decay", f"{SQL_ITEMS} SELECT item, round(power(2.0, -((epoch_us({SQL_NOW}) - epoch_us(created)) / 1e6) / (180 * 86400.0)), 6) AS raw FROM items")
def sig_age_decay(spark, d):
    return sig.age_decay(one_request(spark, d), F.col("created"), now(), 180 * DAY).select("item", F.round("raw", 6).alias("raw"))


@query("sig_context_match", f"{SQL_ITEMS} SELECT item, round(len(list_intersect(words, ['red', 'small', 'steel', 'green', 'blue']))::DOUBLE / 5, 6) AS raw FROM items")
def sig_context_match(spark, d):
    words = F.array(*[F.lit(w) for w in ("red", "small", "steel", "green", "blue")])
    return sig.context_match(one_request(spark, d), F.col("words"), words).select("item", F.round("raw", 6).alias("raw"))


@query("sig_provided", "SELECT p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice / 1000, 6) ELSE 0 END AS raw FROM part")
def sig_provided(spark, d):
    sent = items(spark, d).where("item % 3 = 0").select(F.lit(1).alias("request_id"), "item", (F.col("price") / 1000).alias("score"))
    return sig.provided(one_request(spark, d), sent).select("item", F.round("raw", 6).alias("raw"))


@query("sig_item_neighbors", None)
def sig_item_neighbors(spark, d):
    from tidemark.queries.similarities import seed_pairs

    return sig.over_seed(all_candidates(spark, d), seeds(spark, d), seed_pairs(spark, d), 0.4).select("request_id", "item", F.round("raw", 6).alias("raw"))


def _register_item_neighbors():
    from tidemark.queries import SQL
    from tidemark.queries.similarities import SQL_SEED_PAIRS

    SQL["sig_item_neighbors"] = f"WITH {SQL_SEED_PAIRS} SELECT request_id, item, round(0.6 * avg(v) + 0.4 * max(v), 6) AS raw FROM pv GROUP BY request_id, item"


_register_item_neighbors()


@query("trend", f"""{SQL_EVENTS}, a AS (SELECT target, usr, ({SQL_AGE}) <= 100 * 86400.0 AS recent FROM ev WHERE ({SQL_AGE}) <= 500 * 86400.0),
c AS (SELECT target AS item, count(DISTINCT usr) FILTER (recent) AS r, count(DISTINCT usr) FILTER (NOT recent) AS b FROM a GROUP BY target)
SELECT item, round(CASE WHEN r >= 2 THEN greatest(0, ln((r + 1.0) / (b * (100.0 / 400.0) + 1.0) / 1.2)) ELSE 0 END, 6) AS raw FROM c""")
def trend(spark, d):
    return sig.trend(events(spark, d), now(), 100 * DAY, 400 * DAY, 1.2, 2).select("item", F.round("raw", 6).alias("raw"))


@query("own_history", f"{SQL_EVENTS}, {SQL_PROFILE} SELECT usr AS request_id, item, round(w / max(w) OVER (PARTITION BY usr), 6) AS raw FROM prof")
def own_history(spark, d):
    from pyspark.sql import Window

    return profile(spark, d).select(F.col("user").alias("request_id"), "item", F.round(F.col("w") / F.max("w").over(Window.partitionBy("user")), 6).alias("raw"))


@query("sequence_next", f"""{SQL_EVENTS}, s AS (SELECT usr, target, ts, lead(target) OVER w AS following, lead(ts) OVER w AS then_ts FROM ev WINDOW w AS (PARTITION BY usr ORDER BY ts, seq, target))
SELECT target AS item, following, count(*)::BIGINT AS n FROM s WHERE target <> following AND (epoch_us(then_ts) - epoch_us(ts)) / 1e6 <= 30 * 86400.0 GROUP BY target, following""")
def sequence_next(spark, d):
    return sig.next_items(events(spark, d), 30 * DAY)


@query("recurrence", f"""{SQL_EVENTS}, g AS (SELECT usr, target, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY usr, target ORDER BY ts, seq, target))) / 1e6 AS gap FROM ev)
SELECT target AS item, round(quantile_cont(gap, 0.5), 6) AS usual_gap, count(DISTINCT usr)::BIGINT AS users FROM g WHERE gap > 0 GROUP BY target""")
def recurrence(spark, d):
    return sig.recurrence(events(spark, d)).select("item", F.round("usual_gap", 6).alias("usual_gap"), "users")


@query("mutual_connections", """WITH e AS (SELECT DISTINCT o_custkey AS u, l_suppkey AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 45)
SELECT a.u AS user_id, b.u AS other, count(*)::BIGINT AS mutuals FROM e a JOIN e b ON a.m = b.m AND a.u <> b.u GROUP BY a.u, b.u""")
def mutual_connections(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    edges = lines.where("l_quantity >= 45").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("target"))
    return sig.mutual_connections(edges).withColumnRenamed("user", "user_id")


SQL_ALL = f"{SQL_ITEMS}, req AS (SELECT p_partkey AS request_id FROM part WHERE p_partkey % 20 = 0)"


@query("sig_attribute_match", f"{SQL_ALL}, x AS (SELECT request_id, words AS own FROM req JOIN items ON item = request_id) SELECT request_id, item, (len(list_intersect(words, own)) > 0)::INTEGER::DOUBLE AS raw FROM items CROSS JOIN x")
def sig_attribute_match(spark, d):
    """Whether a part shares a word of its name with the request's."""
    own = items(spark, d).select(F.col("item").alias("request_id"), F.col("words").alias("own"))
    rows = all_candidates(spark, d).join(own, "request_id")
    return sig.attribute_match(rows, F.col("words"), F.col("own"), True, True).select("request_id", "item", "raw")


@query("sig_attribute_value", f"{SQL_ALL} SELECT request_id, item, price AS raw FROM items CROSS JOIN req")
def sig_attribute_value(spark, d):
    rows = in_pieces(items(spark, d).select("item", "price"), requests(spark, d)).withColumn("cand_pos", F.col("item"))
    return sig.attribute_value(rows, F.col("price")).select("request_id", "item", "raw")


@query("sig_formula", f"{SQL_ALL} SELECT request_id, item, round(CASE WHEN size > 25 THEN sqrt(price) ELSE price / 100 + size END, 6) AS raw FROM items CROSS JOIN req")
def sig_formula(spark, d):
    from tidemark.functions.expressions import Typed

    env = {"$item.size": Typed(F.col("size"), "number"), "$item.price": Typed(F.col("price"), "number")}
    made = sig.formula(all_candidates(spark, d), "if($item.size > 25, sqrt($item.price), $item.price / 100 + $item.size)", env)
    return made.select("request_id", "item", F.round("raw", 6).alias("raw"))


@query("sig_satiation", f"""{SQL_EVENTS}, {SQL_ITEMS}, c AS (SELECT DISTINCT usr, target FROM ev WHERE usr % 20 = 0), f AS (SELECT usr, brand, count(*) AS n FROM ev JOIN items ON item = target WHERE type = 'purchase' GROUP BY usr, brand)
SELECT c.usr AS request_id, c.target AS item, round(1 / (1.0 + coalesce(n, 0)), 6) AS raw FROM c JOIN items ON item = target LEFT JOIN f ON f.usr = c.usr AND f.brand = items.brand""")
def sig_satiation(spark, d):
    """Parts that customers have touched, less wanted the more of the brand they bought."""
    brands = items(spark, d).select("item", "brand")
    done = events(spark, d).select("user", "type", F.col("target").alias("item")).join(brands, "item")
    rows = done.where("user % 20 = 0").select(F.col("user").alias("request_id"), "user", "item", "brand").distinct().withColumn("cand_pos", F.lit(1))
    return sig.satiation(rows, done.where("type = 'purchase'"), "brand").select("request_id", "item", F.round("raw", 6).alias("raw"))


SQL_HEAD = "r AS (SELECT q.request_id, v.item, v.value, row_number() OVER (PARTITION BY q.request_id ORDER BY v.value DESC, v.item)::INTEGER AS src_rank FROM req q CROSS JOIN v WHERE v.value > 0 AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.request_id = q.request_id AND s.item = v.item))"


@query("src_trend", f"""{SQL_EVENTS}, {SQL_SEEDS}, a AS (SELECT target, usr, ({SQL_AGE}) <= 100 * 86400.0 AS recent FROM ev WHERE ({SQL_AGE}) <= 500 * 86400.0),
c AS (SELECT target AS item, count(DISTINCT usr) FILTER (recent) AS n, count(DISTINCT usr) FILTER (NOT recent) AS b FROM a GROUP BY target),
v AS (SELECT item, round(CASE WHEN n >= 2 THEN greatest(0, ln((n + 1.0) / (b * (100.0 / 400.0) + 1.0) / 1.2)) ELSE 0 END, 9) AS value FROM c), {SQL_HEAD}
SELECT request_id, item, round(value, 6) AS value, src_rank FROM r WHERE src_rank <= 200""")
def src_trend(spark, d):
    rising = sig.trend(events(spark, d), now(), 100 * DAY, 400 * DAY, 1.2, 2).select("item", F.round("raw", 9).alias("value"))
    return cand.for_requests(requests(spark, d), rising, seeds(spark, d)).select("request_id", "item", F.round("value", 6).alias("value"), "src_rank")


@query("src_unexposed", f"""{SQL_EVENTS}, {SQL_SEEDS}, c AS (SELECT target AS item, count(*) AS n FROM ev GROUP BY target),
v AS (SELECT p_partkey AS item, round(1 / sqrt(1.0 + coalesce(n, 0)), 9) AS value FROM part LEFT JOIN c ON c.item = p_partkey), {SQL_HEAD}
SELECT request_id, item, round(value, 6) AS value, src_rank FROM r WHERE src_rank <= 200""")
def src_unexposed(spark, d):
    rare = cand.unexposed(events(spark, d), items(spark, d))
    return cand.for_requests(requests(spark, d), rare, seeds(spark, d)).select("request_id", "item", F.round("value", 6).alias("value"), "src_rank")


@query("explain_best_seeds", f"""{SQL_CO}, pv AS (SELECT s.request_id, s.seed_pos, co.item, sup * groups::DOUBLE / (n_seed * n_item) AS value FROM seeds s JOIN co ON co.seed_item = s.item),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id, item ORDER BY round(value, 9) DESC, seed_pos)::INTEGER AS nth FROM pv WHERE value > 0)
SELECT request_id, item, seed_pos, round(value, 6) AS value, nth FROM r WHERE nth <= 2""")
def explain_best_seeds(spark, d):
    pairs = co.seed_values(seeds(spark, d), support(spark, d))
    return scoring.best_seeds(pairs).select("request_id", "item", "seed_pos", F.round("value", 6).alias("value"), "nth")
