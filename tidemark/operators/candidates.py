"""Candidate generators: the best items of each request by one measure, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.decay import micros

#: Items of one source and candidates of one request, at most.
SOURCE_CAP, CANDIDATE_CAP = 200, 2000


def top(scored: DataFrame, seeds: DataFrame | None = None, cap: int = SOURCE_CAP) -> DataFrame:
    """``request_id, item, value, src_rank``: the strictly positive values of
    ``scored(request_id, item, value)`` that are not in the seed, greatest first, ties by
    item, at most ``cap`` for each request."""
    rows = scored.where("value > 0")
    if seeds is not None:
        rows = rows.join(seeds.select("request_id", "item").distinct(), ["request_id", "item"], "left_anti")
    order = Window.partitionBy("request_id").orderBy(F.desc("value"), "item")
    return rows.withColumn("src_rank", F.row_number().over(order)).where(F.col("src_rank") <= cap)


def everything(requests: DataFrame, items: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """The first items by id for every request."""
    first = items.select("item").orderBy("item").limit(cap)
    ranked = first.withColumn("src_rank", F.row_number().over(Window.orderBy("item")))
    return requests.select("request_id").crossJoin(F.broadcast(ranked)).withColumn("value", F.lit(None).cast("double"))


def popularity(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """``item, value``: interactions of any kind with each item."""
    counted = interactions.groupBy(F.col("target").alias("item")).agg(F.count("*").cast("double").alias("value"))
    return counted.join(items.select("item"), "item", "left_semi")


def for_requests(requests: DataFrame, ranked: DataFrame, seeds: DataFrame, cap: int = SOURCE_CAP) -> DataFrame:
    """The best of one catalogue-wide ranking for each request, without its seed.

    At most ``cap`` plus a seed's size of the ranking can matter to a request, so only
    that head is joined with the requests.
    """
    most = seeds.groupBy("request_id").agg(F.countDistinct("item").alias("n")).agg(F.max("n")).first()[0] or 0
    head = ranked.where("value > 0").orderBy(F.desc("value"), "item").limit(cap + most)
    return top(requests.select("request_id").crossJoin(F.broadcast(head.select("item", "value"))), seeds, cap)


def fresh(items: DataFrame, created: str) -> DataFrame:
    """``item, value`` with the creation time in seconds as value."""
    return items.where(F.col(created).isNotNull()).select("item", (micros(F.col(created)) / 1e6).alias("value"))


def unexposed(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """``item, value`` with ``1 / sqrt(1 + n)`` for ``n`` interactions of any kind, so that
    what was shown least comes first."""
    counted = interactions.groupBy(F.col("target").alias("item")).agg(F.count("*").alias("n"))
    return items.select("item").join(counted, "item", "left").select("item", F.round(1 / F.sqrt(1.0 + F.coalesce("n", F.lit(0))), 9).alias("value"))


def union(sources: list[DataFrame], cap: int = CANDIDATE_CAP) -> DataFrame:
    """``request_id, item, cand_pos``: sources in order, an item at its first place."""
    rows = None
    for k, s in enumerate(sources):
        own = s.select("request_id", "item", F.lit(k).alias("src_pos"), "src_rank")
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("request_id", "item").agg(F.min(F.struct("src_pos", "src_rank")).alias("at"))
    order = Window.partitionBy("request_id").orderBy("at.src_pos", "at.src_rank")
    return first.withColumn("cand_pos", F.row_number().over(order)).where(F.col("cand_pos") <= cap).drop("at")


def item_pairs(seeds: DataFrame, items: DataFrame, likeness: Column, seed_prefix: str = "s_") -> DataFrame:
    """``request_id, seed_pos, item, value``: likeness of every item to every seed item.

    The distinct seed items, a stated query set, are broadcast against a scan of the
    catalogue; ``likeness`` names an item's columns and, prefixed, a seed's.
    """
    wanted = seeds.select("item").distinct()
    known = items.join(F.broadcast(wanted), "item", "left_semi")
    side = known.select(*[F.col(c).alias(seed_prefix + c) for c in known.columns])
    pairs = items.crossJoin(F.broadcast(side)).select(F.col(seed_prefix + "item").alias("seed_item"), "item", likeness.alias("value"))
    return seeds.select("request_id", "seed_pos", F.col("item").alias("seed_item")).join(pairs, "seed_item").select("request_id", "seed_pos", "item", "value")


def candidate_pairs(candidates: DataFrame, seeds: DataFrame, items: DataFrame, likeness: Column, seed_prefix: str = "s_") -> DataFrame:
    """``item_pairs`` of given candidates only, so that no other item meets a seed."""
    side = items.select(*[F.col(c).alias(seed_prefix + c) for c in items.columns])
    named = seeds.select("request_id", "seed_pos", F.col("item").alias(seed_prefix + "item")).join(side, seed_prefix + "item")
    met = candidates.select("request_id", "item").distinct().join(items, "item").join(named, "request_id")
    return met.select("request_id", "seed_pos", "item", likeness.alias("value"))


def item_pairs_in_place(seeds: DataFrame, items: DataFrame, likeness: Column, tasks: int, seed_prefix: str = "s_") -> DataFrame:
    """``item_pairs`` dealt out by item and with the requests' seeds broadcast, so that all
    values of a request and item are in one task and are grouped without a shuffle."""
    side = items.select(*[F.col(c).alias(seed_prefix + c) for c in items.columns])
    named = seeds.select("request_id", "seed_pos", F.col("item").alias(seed_prefix + "item")).join(side, seed_prefix + "item")
    return items.repartition(tasks, "item").crossJoin(F.broadcast(named)).select("request_id", "seed_pos", "item", likeness.alias("value"))
