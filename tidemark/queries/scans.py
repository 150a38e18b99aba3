"""Scans, counts, upserts, ingest and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import Typed, compile_column
from tidemark.queries import query
from tidemark.queries.binding import NOW_TEXT, SQL_EVENTS, SQL_ITEMS, events, items, table
from tidemark.sources import ingest, tables


@query("scan_counts", f"""{SQL_EVENTS} SELECT type, count(*)::BIGINT AS n FROM ev GROUP BY type
  UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'customer', count(*) FROM customer""")
def scan_counts(spark, d):
    kinds = tables.counts(events(spark, d), "type")
    whole = table(spark, d, "part").select(F.lit("part").alias("type")).unionByName(table(spark, d, "customer").select(F.lit("customer").alias("type")))
    return kinds.unionByName(tables.counts(whole, "type"))


@query("user_history", f"""{SQL_EVENTS} SELECT seq, type, target, value FROM ev WHERE usr = 7""")
def user_history(spark, d):
    return tables.user_history(events(spark, d), 7).select("seq", "type", "target", "value")


@query("entity_lookup", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42")
def entity_lookup(spark, d):
    return tables.entity(table(spark, d, "part"), "p_partkey", 42).select("p_partkey", "p_name", "p_brand")


@query("entity_multiget", """SELECT 1 AS request_id, t.pos::INTEGER AS pos, p_partkey, p_brand
  FROM (SELECT unnest([30, 4, 999999999, 17, 4]) AS k, unnest([0, 1, 2, 3, 4]) AS pos) t JOIN part ON p_partkey = t.k""")
def entity_multiget(spark, d):
    wanted = spark.range(1).select(F.lit(1).alias("request_id"), F.posexplode(F.array(*[F.lit(x).cast("long") for x in (30, 4, 999999999, 17, 4)])).alias("pos", "item"))
    return tables.entities_in_order(table(spark, d, "part"), "p_partkey", wanted).select("request_id", "pos", "p_partkey", "p_brand")


@query("interaction_scan", f"{SQL_EVENTS} SELECT seq, usr AS user_id, target FROM ev WHERE type IN ('return')")
def interaction_scan(spark, d):
    return tables.interactions(events(spark, d), ["return"]).select("seq", F.col("user").alias("user_id"), "target")


@query("upsert_dedupe", f"""{SQL_EVENTS} SELECT usr AS user_id, type, target, ts, min(seq) AS seq, max({{'s': seq, 'v': value}}).v AS value FROM ev GROUP BY usr, type, target, ts""")
def upsert_dedupe(spark, d):
    return tables.upsert_interactions(events(spark, d).select("user", "type", "target", "ts", "value", "seq"), ["user", "type", "target", "ts"]).withColumnRenamed("user", "user_id")


@query("upsert_entities", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS size FROM part""")
def upsert_entities(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.lit(0).alias("at"))
    new = old.where("id % 3 = 0").select("id", "size", F.explode(F.array(F.lit(1), F.lit(2))).alias("at")).withColumn("size", F.col("size") + 50 * F.col("at"))
    return tables.upsert_entities(old, new, ["id"], "at").select("id", "size")


@query("context_derive", """SELECT event_id, extract(hour FROM ts)::INTEGER AS hour, extract(isodow FROM ts)::INTEGER AS weekday, extract(month FROM ts)::INTEGER AS month FROM events""")
def context_derive(spark, d):
    return ingest.with_context(table(spark, d, "events"), "ts").select("event_id", "hour", "weekday", "month")


@query("display_name", """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 AND p_name <> '' THEN p_name WHEN p_partkey % 7 <> 0 AND p_brand <> '' THEN p_brand ELSE p_partkey::VARCHAR END AS shown FROM part""")
def display_name(spark, d):
    title = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).otherwise("")
    name = F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ingest.display_name(title, name, F.col("p_partkey")).alias("shown"))


@query("numeric_scales", f"{SQL_ITEMS} SELECT min(size) AS lo_size, max(size) AS hi_size, min(price) AS lo_price, max(price) AS hi_price FROM items")
def numeric_scales(spark, d):
    from tidemark.queries.binding import scales

    return scales(items(spark, d), ["size", "price"])


@query("computed_attrs", f"""{SQL_ITEMS} SELECT item, round(price / size, 6) AS unit_price, len(words)::DOUBLE AS n_words, upper(brand) || ' ' || ptype AS label,
  round(CASE WHEN price > 1000 THEN ln(1 + price) ELSE least(greatest(size, 5), 20) END, 6) AS blend, round(sign(price - 1000.5) * floor(abs(price - 1000.5) + 0.5), 6) AS off FROM items""")
def computed_attrs(spark, d):
    rows = items(spark, d)
    env = {"price": Typed(F.col("price"), "number"), "size": Typed(F.col("size"), "number"), "words": Typed(F.col("words"), "set"), "brand": Typed(F.col("brand"), "string"), "ptype": Typed(F.col("ptype"), "string")}
    get = lambda e: compile_column(e, env).column
    return rows.select("item", F.round(get("price / size"), 6).alias("unit_price"), get("len(words)").alias("n_words"), get("upper(brand) + ' ' + ptype").alias("label"), F.round(get("if(price > 1000, log1p(price), clamp(size, 5, 20))"), 6).alias("blend"), F.round(get("round(price - 1000.5)"), 6).alias("off"))


@query("text_functions", r"""SELECT doc_id, length(text)::DOUBLE AS chars, len(regexp_extract_all(text, '[^\s]+'))::DOUBLE AS n_words, lower(source) = source AS is_lower, contains(text, 'the') AS has_the FROM documents""")
def text_functions(spark, d):
    env = {"text": Typed(F.col("text"), "string"), "source": Typed(F.col("source"), "string")}
    get = lambda e: compile_column(e, env).column
    return table(spark, d, "documents").select("doc_id", get("len(text)").alias("chars"), get("words(text)").alias("n_words"), get("lower(source) == source").alias("is_lower"), get("contains(text, 'the')").alias("has_the"))


@query("expression_nulls", """SELECT p_partkey AS id, CASE WHEN a IS NULL THEN NULL WHEN NOT a THEN false ELSE b END AS both, CASE WHEN a IS NULL THEN NULL WHEN a THEN true ELSE b END AS either,
  CASE WHEN x IS NULL THEN NULL WHEN y = 0 THEN 0 ELSE x / y END AS ratio, CASE WHEN a IS NULL OR x IS NULL THEN NULL WHEN a THEN x ELSE y END AS pick, CASE WHEN x IS NULL THEN NULL ELSE greatest(x, y) END AS most
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size > 25 END AS a, p_partkey % 2 = 0 AS b, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS x, (p_partkey % 4)::DOUBLE AS y FROM part)""")
def expression_nulls(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("id"), F.when(k % 3 != 0, F.col("p_size") > 25).alias("a"), (k % 2 == 0).alias("b"), F.when(k % 5 != 0, F.col("p_size").cast("double")).alias("x"), (k % 4).cast("double").alias("y"))
    env = {c: Typed(F.col(c), t) for c, t in (("a", "bool"), ("b", "bool"), ("x", "number"), ("y", "number"))}
    get = lambda e: compile_column(e, env).column
    return rows.select("id", get("a && b").alias("both"), get("a || b").alias("either"), get("x / y").alias("ratio"), get("if(a, x, y)").alias("pick"), get("max(x, y)").alias("most"))


SPEC = ingest.EntitySpec("part", {"brand": ingest.Attribute("categorical"), "size": ingest.Attribute("int", low=1, high=40), "price": ingest.Attribute("float"), "tags": ingest.Attribute("set", optional=True)})


@query("ingest_rejects", """SELECT CASE WHEN p_partkey % 11 = 0 THEN 'widget' ELSE 'part' END AS entity, p_partkey::VARCHAR AS id,
  CASE WHEN p_partkey % 11 = 0 THEN 'unknown entity type widget' WHEN p_partkey % 13 = 0 THEN 'undeclared attribute colour' WHEN p_size > 40 THEN 'attribute size is not a valid int'
    WHEN p_partkey % 17 = 0 THEN 'attribute price is missing' END AS reject_reason FROM part
  WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_size > 40 OR p_partkey % 17 = 0""")
def ingest_rejects(spark, d):
    k = F.col("p_partkey")
    base = F.map_filter(F.create_map(F.lit("brand"), F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')), F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.when(k % 17 != 0, F.col("p_retailprice").cast("string")).otherwise("null"), F.lit("tags"), F.lit('["b","a","b"]'), F.lit("colour"), F.when(k % 13 == 0, F.lit('"red"'))), lambda n, v: v.isNotNull())
    rows = table(spark, d, "part").select(F.when(k % 11 == 0, "widget").otherwise("part").alias("entity"), k.cast("string").alias("id"), base.alias("attrs"))
    return ingest.validate_entities(rows, SPEC)[1].select("entity", "id", "reject_reason")


@query("ingest_entities", """SELECT p_partkey::VARCHAR AS id, p_brand AS brand, p_size::BIGINT AS size, p_retailprice AS price FROM part WHERE p_size <= 40""")
def ingest_entities(spark, d):
    attrs = F.create_map(F.lit("brand"), F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')), F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_retailprice").cast("string"))
    rows = table(spark, d, "part").select(F.lit("part").alias("entity"), F.col("p_partkey").cast("string").alias("id"), attrs.alias("attrs"))
    return ingest.validate_entities(rows, SPEC)[0].select("id", "brand", "size", "price")


@query("ingest_interactions", """SELECT user_id::VARCHAR AS "user", event_type AS type, coalesce(ts, TIMESTAMP '2001-08-02') AS ts, value, json_extract_string(props, '$.k') AS k FROM events WHERE event_type <> 'error' AND isfinite(value)""")
def ingest_interactions(spark, d):
    ev = table(spark, d, "events")
    kinds = {t: {"k": "int"} for t in ("click", "purchase", "signup", "view")}
    rows = ev.select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("type"), F.lit("t").alias("target"), F.col("value").cast("string").alias("value"), F.col("ts").cast("string").alias("ts"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("fields"))
    good, _ = ingest.validate_interactions(rows, kinds, F.lit(NOW_TEXT).cast("timestamp"))
    return good.select("user", "type", "ts", "value", F.element_at("fields", "k").alias("k"))
