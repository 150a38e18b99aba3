"""Experiments, knobs and metrics over all customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import Typed
from tidemark.functions.hashing import bucket, fnv1a32
from tidemark.plans import tuning
from tidemark.queries import query
from tidemark.queries.binding import DAY, SQL_AGE, SQL_EVENTS, events, now, table

SQL_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, octet_length(encode({s})) + 1), lambda i: ('0x' || substr(hex(encode({s})), 2 * i - 1, 2))::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@query("bucket_fnv", f"SELECT c_custkey AS user_id, {SQL_FNV.format(s='c_name')} AS hash, {SQL_FNV.format(s='(chr(0) || c_name)')} % 10000 AS bucket FROM customer")
def bucket_fnv(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), fnv1a32(name).alias("hash"), bucket("", name).alias("bucket"))


@query("holdout", f"SELECT c_custkey AS user_id, {SQL_FNV.format(s=chr(39) + 'holdout' + chr(39) + ' || chr(0) || c_name')} % 10000 < 500 AS held_out FROM customer")
def holdout(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), tuning.holdout(F.col("c_name"), 0.05).alias("held_out"))


EXPERIMENTS = {"experiments": {
    "alpha": {"recommender": "home", "status": "running", "layer": "ranking", "traffic": 0.5, "variants": {"control": {"share": 0.5}, "b": {"share": 0.3}, "a": {"share": 0.2}}},
    "beta": {"recommender": "home", "status": "running", "layer": "ranking", "traffic": 0.3, "variants": {"control": {"share": 0.5}, "x": {"share": 0.5}}},
}}


@query("experiment_assign", f"""WITH b AS (SELECT c_custkey AS user_id, {SQL_FNV.format(s="'layer:ranking' || chr(0) || c_name")} % 10000 AS l, {SQL_FNV.format(s="'exp:alpha' || chr(0) || c_name")} % 10000 AS a, {SQL_FNV.format(s="'exp:beta' || chr(0) || c_name")} % 10000 AS e FROM customer)
SELECT user_id, CASE WHEN l < 5000 THEN 'alpha' WHEN l < 8000 THEN 'beta' END AS experiment, CASE WHEN l < 5000 THEN CASE WHEN a < 5000 THEN 'control' WHEN a < 7000 THEN 'a' ELSE 'b' END WHEN l < 8000 THEN CASE WHEN e < 5000 THEN 'control' ELSE 'x' END END AS variant FROM b""")
def experiment_assign(spark, d):
    name, variant = tuning.assignment(EXPERIMENTS, "home", F.col("c_name"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), name.alias("experiment"), variant.alias("variant"))


LAYERED = {"experiments": {
    "alpha": {"recommender": "home", "status": "running", "traffic": 0.4, "audience": {"when": "$user.segment == 'BUILDING'"}, "variants": {"control": {"share": 0.3}, "x": {"share": 0.3}, "y": {"share": 0.3}}},
    "beta": {"recommender": "home", "status": "running", "traffic": 0.4, "variants": {"control": {"share": 0.5}, "x": {"share": 0.5}}},
    "gamma": {"recommender": "home", "status": "running", "layer": "later", "unit": "request", "traffic": 0.5, "variants": {"control": {"share": 0.2}, "x": {"share": 0.8}}},
    "delta": {"recommender": "home", "status": "running", "layer": "early", "unit": "session", "variants": {"control": {"share": 1}}},
    "other": {"recommender": "top", "status": "running", "layer": "aaa", "variants": {"control": {"share": 1}}},
}}


@query("experiment_layers", f"""WITH b AS (SELECT c_custkey AS user_id, c_mktsegment AS segment, {SQL_FNV.format(s="'layer:default' || chr(0) || c_name")} % 10000 AS l, {SQL_FNV.format(s="'exp:alpha' || chr(0) || c_name")} % 10000 AS a, {SQL_FNV.format(s="'exp:beta' || chr(0) || c_name")} % 10000 AS e, {SQL_FNV.format(s="'layer:later' || chr(0) || ('r' || c_custkey)")} % 10000 AS r, {SQL_FNV.format(s="'exp:gamma' || chr(0) || ('r' || c_custkey)")} % 10000 AS g FROM customer),
x AS (SELECT *, CASE WHEN l < 4000 AND segment = 'BUILDING' THEN 'alpha' WHEN l >= 4000 AND l < 8000 THEN 'beta' WHEN r < 5000 THEN 'gamma' END AS experiment FROM b)
SELECT user_id, experiment, CASE experiment WHEN 'alpha' THEN CASE WHEN a < 3000 THEN 'control' WHEN a < 6000 THEN 'x' ELSE 'y' END WHEN 'beta' THEN CASE WHEN e < 5000 THEN 'control' ELSE 'x' END WHEN 'gamma' THEN CASE WHEN g < 2000 THEN 'control' ELSE 'x' END END AS variant FROM x""")
def experiment_layers(spark, d):
    """Layers by name, experiments without one in the layer "default", an audience, a unit
    that is the request, one that cannot be assigned, and shares that do not add up to 1."""
    name, variant = tuning.assignment(LAYERED, "home", F.col("c_name"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")), {"$user.segment": Typed(F.col("c_mktsegment"), "string")})
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), name.alias("experiment"), variant.alias("variant"))


@query("fallback_split", f"""{SQL_EVENTS}, p AS (SELECT usr, count(DISTINCT target) AS n FROM ev WHERE type = 'purchase' GROUP BY usr) SELECT c_custkey AS user_id, CASE WHEN coalesce(n, 0) < 30 THEN 'popular' ELSE 'home' END AS served FROM customer LEFT JOIN p ON usr = c_custkey""")
def fallback_split(spark, d):
    from tidemark.operators.users import profile_sizes

    sizes = profile_sizes(events(spark, d), ["purchase"])
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("user")).join(sizes, "user", "left").withColumn("profile_size", F.coalesce("profile_size", F.lit(0)).cast("double"))
    doc = {"recommenders": {"home": {"fallback": [{"when": "profile.size < 30", "use": "popular"}]}, "popular": {}}}
    served = tuning.fallback_column(doc, "home", {"profile.size": Typed(F.col("profile_size"), "number")})
    return rows.select(F.col("user").alias("user_id"), served.alias("served"))


@query("knob_resolve", """SELECT c_custkey AS user_id, round(x, 6) AS value, round(1 - x, 6) AS content, round(0.5 * x + 0.1, 6) AS popular FROM (SELECT c_custkey, least(greatest(c_acctbal / 5000, 0), 1) AS x FROM customer)""")
def knob_resolve(spark, d):
    """A saved knob value for each customer, clamped and mapped to two weights."""
    doc = {
        "signals": {"content": {"type": "item_neighbors"}, "popular": {"type": "global_count"}}, "recommenders": {"home": {}},
        "knobs": [{"id": "balance", "range": [0, 1], "default": 0.5, "maps": {"content": "1 - x", "signals.popular.weight": "0.5 * x + 0.1"}}],
    }
    values, mapped = tuning.knob_columns(doc, "home", {"balance": F.col("c_acctbal") / 5000})
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.round(values["balance"], 6).alias("value"), F.round(mapped["content"], 6).alias("content"), F.round(mapped["signals.popular.weight"], 6).alias("popular"))


@query("metric_ratio", "SELECT event_type AS type, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events WHERE event_type = 'view'), 6) AS per_view FROM events GROUP BY event_type")
def metric_ratio(spark, d):
    ev = table(spark, d, "events")
    shown = ev.where("event_type = 'view'").agg(F.count("*").alias("shown"))
    counts = ev.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(shown))
    return counts.select("type", "n", F.round(F.col("n") / F.col("shown"), 6).alias("per_view"))


@query("metric_returning", """WITH f AS (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id) SELECT count(*)::BIGINT AS users, count(*) FILTER (EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.user_id AND e.ts > f.first_ts AND epoch_us(e.ts) - epoch_us(f.first_ts) <= 7 * 86400000000))::BIGINT AS returned FROM f""")
def metric_returning(spark, d):
    """Users with an event in the seven days after their first."""
    from tidemark.functions.decay import micros

    ev = table(spark, d, "events").select("user_id", micros(F.col("ts")).alias("t"))
    first = ev.groupBy("user_id").agg(F.min("t").alias("first"))
    back = ev.join(first, "user_id").groupBy("user_id").agg(F.max(((F.col("t") > F.col("first")) & (F.col("t") - F.col("first") <= int(7 * DAY * 1e6))).cast("int")).alias("back"))
    return back.agg(F.count("*").alias("users"), F.sum("back").alias("returned"))


@query("metric_gini", """WITH c AS (SELECT l_partkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_partkey), r AS (SELECT n, row_number() OVER (ORDER BY n, l_partkey) AS i, count(*) OVER () AS m FROM c) SELECT round(sum((2 * i - m - 1) * n) / (max(m) * sum(n)), 6) AS gini, count(*)::BIGINT AS coverage FROM r""")
def metric_gini(spark, d):
    """Concentration of events over items: counts of equal size are taken together, so
    that only distinct counts are ordered."""
    from pyspark.sql import Window

    per = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.orderBy("n"))
    ranked = per.withColumn("last", upto).withColumn("ranks", F.col("k") * (2 * F.col("last") - F.col("k") + 1) / 2.0)
    total = ranked.agg(F.sum("k").alias("m"), F.sum(F.col("n") * F.col("k")).alias("s"), F.sum(F.col("ranks") * F.col("n")).alias("rn"))
    return total.select(F.round((2 * F.col("rn") - (F.col("m") + 1) * F.col("s")) / (F.col("m") * F.col("s")), 6).alias("gini"), F.col("m").alias("coverage"))


@query("eval_ndcg", f"""{SQL_EVENTS}, h AS (SELECT *, ({SQL_AGE}) <= 400 * 86400.0 AS test FROM ev WHERE type = 'purchase'), pop AS (SELECT target, count(*) AS n FROM h WHERE NOT test GROUP BY target),
top AS (SELECT target, row_number() OVER (ORDER BY n DESC, target) AS rank FROM pop QUALIFY rank <= 50), rel AS (SELECT DISTINCT usr, target FROM h WHERE test), u AS (SELECT usr, count(*) AS n FROM rel GROUP BY usr),
g AS (SELECT u.usr, u.n, count(t.target) AS hits, coalesce(sum(1 / log2(t.rank + 1)), 0) AS dcg FROM u LEFT JOIN rel USING (usr) LEFT JOIN top t ON t.target = rel.target GROUP BY u.usr, u.n)
SELECT usr AS user_id, round(hits / 50.0, 6) AS precision, round(hits::DOUBLE / n, 6) AS recall, round(dcg / list_sum(list_transform(range(1, least(n, 50) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g""")
def eval_ndcg(spark, d):
    """Offline evaluation split by time: the most bought items against what each customer
    bought later; precision, recall and NDCG at 50."""
    from tidemark.functions.decay import age_seconds

    rows = events(spark, d).where("type = 'purchase'").withColumn("test", age_seconds(F.col("ts"), now(), False) <= 400 * DAY)
    best = rows.where("not test").groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(50)
    from pyspark.sql import Window

    top = F.broadcast(best.select("target", F.row_number().over(Window.orderBy(F.desc("n"), "target")).alias("rank")))
    found = rows.where("test").select("user", "target").distinct().join(top, "target", "left")
    per = found.groupBy("user").agg(F.count("*").alias("n"), F.count("rank").alias("hits"), F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1.0)), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(50)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    return per.select(F.col("user").alias("user_id"), F.round(F.col("hits") / 50.0, 6).alias("precision"), F.round(F.col("hits") / F.col("n"), 6).alias("recall"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))
