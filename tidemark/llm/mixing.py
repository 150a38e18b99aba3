"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the exponential key ``-ln(u) / w`` from a hash of its id and its
quality weight; complete epochs of a source are taken first, and the rest of its word
budget goes to the documents of smallest key, by a running sum inside the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of one document that a mix may hold.
MAX_REPEATS = 3
#: Key buckets of one source; a running sum sorts one bucket, never a whole source.
KEY_BUCKETS = 1024
#: Quality weights of labelled documents; unlabelled ones weigh 1.
GOOD_WEIGHT, POOR_WEIGHT = 2.0, 0.5


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the id as text."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weights(labels: DataFrame) -> DataFrame:
    """``(doc_id, weight)`` from quality labels; ids labelled both ways count as good."""
    good = F.max("quality")
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.when(good == 1, GOOD_WEIGHT).otherwise(POOR_WEIGHT).alias("weight"))


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)``.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the total size;
    one whose share is above ``max_repeats`` times its size stops there and the excess
    goes to the others by weight.  In closed form: with sources by rising
    ``size / weight``, the first ``k`` are full for the least ``k`` at which the share of
    each unit of weight among the others leaves source ``k + 1`` below its limit.  Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stepped = weighed.withColumns({"total": F.sum("source_size").over(every).cast("double"), "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)), "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0))})
    level = stepped.withColumn("level", (F.col("total") - F.col("full")) / F.col("w_left"))
    held = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))
    final = level.withColumn("unit", F.min_by(held, F.when(held.isNotNull(), F.col("cap") / F.col("w"))).over(every))
    return final.select("source", "source_size", F.when(F.col("unit").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("unit") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, salt: str = "mix", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, copies, taken``.

    ``copies`` full copies of a document are taken: the complete epochs of its source
    (``target / source_size`` rounded down, at most ``max_repeats``) and one more while
    the running sum of sizes by rising key stays within the rest of the budget.  The
    document at which the sum crosses the budget is taken when that ends nearer to it.
    Null text has size 0; a null source is a source; a null doc_id draws the key of the
    text "null"; repeated rows count each, ties in key by id then size.
    ``weights(doc_id, weight)`` has unique ids; absent ones weigh 1.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    if weights is not None:
        rows = rows.join(weights.select("doc_id", "weight"), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    weight = F.coalesce("weight", F.lit(1.0))
    rows = rows.withColumn("key", -F.ln(uniform(F.col("doc_id"), salt)) / weight)
    # 1 - exp(-key) is the key's rank for weight 1: buckets of like size, in key order
    rows = rows.select("doc_id", "source", "size", "key", F.floor((1 - F.exp(-F.col("key"))) * KEY_BUCKETS).cast("int").alias("bucket"))
    targets = source_targets(rows, max_repeats)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(max_repeats))).otherwise(0)
    budget = F.when(epochs >= max_repeats, 0.0).otherwise(F.greatest(F.col("target") - epochs * F.col("source_size"), F.lit(0.0)))
    plan = targets.withColumns({"epochs": epochs.cast("long"), "budget": budget})
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ordered = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(ordered), F.lit(0)))
    known = offsets.join(plan, offsets["source"].eqNullSafe(plan["source"])).select(offsets["source"].alias("s"), offsets["bucket"].alias("b"), "before", "source_size", "target", "epochs", "budget")
    placed = rows.join(known, rows["source"].eqNullSafe(known["s"]) & (rows["bucket"] == known["b"]))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(inside)
    start = upto - F.col("size")
    more = (upto <= F.col("budget")) | ((start < F.col("budget")) & (upto - F.col("budget") < F.col("budget") - start))
    copies = F.col("epochs") + F.when(more & (F.col("epochs") < max_repeats), 1).otherwise(0)
    return placed.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix of the whole ``documents`` table, weighted by the quality labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(docs, quality_weights(labels)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 2.0 ELSE 0.5 END::DOUBLE AS weight FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  -ln((('0x' || substr(md5('mix' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / coalesce(w.weight, 1.0) AS key
  FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
o AS (SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total,
  sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left, coalesce(sum(source_size * 3.0::DOUBLE) OVER b, 0) AS full_before
  FROM s WINDOW b AS (ORDER BY source_size * 3.0::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT arg_min((total - full_before) / w_left, cap / w) AS unit FROM o WHERE cap / w >= (total - full_before) / w_left),
t AS (SELECT source, source_size, CASE WHEN unit IS NULL THEN cap ELSE least(cap, unit * w) END AS target FROM o, u),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-9), 3) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.*, source_size, target, epochs, CASE WHEN epochs >= 3 THEN 0 ELSE greatest(target - epochs * source_size, 0) END AS budget,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id ASC NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN epochs < 3 AND (upto <= budget OR (upto - size < budget AND upto - budget < budget - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
