"""Items that appear in the same groups (baskets, lists, sessions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memberships(interactions: DataFrame, group: str) -> DataFrame:
    """Distinct ``group, item``; events without the group field are left out."""
    return interactions.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col("target").alias("item")).distinct()


def support(members: DataFrame, seed_items: DataFrame) -> DataFrame:
    """``seed_item, item, both, n_seed, n_item, groups``: in how many groups each seed
    item meets each other item, with both items' and all groups' counts.

    Only the groups of the seed items are paired (one side of the self-join is filtered
    first), and pairs are counted map-side before they are shuffled.
    """
    per = members.groupBy("item").agg(F.count("*").alias("n"))
    total = members.agg(F.countDistinct("group").alias("groups"))
    seeded = members.join(seed_items.select("item").distinct(), "item", "left_semi").select("group", F.col("item").alias("seed_item"))
    pairs = seeded.join(members, "group").where(F.col("seed_item") != F.col("item"))
    both = pairs.groupBy("seed_item", "item").agg(F.count("*").alias("both"))
    named = both.join(per.select("item", F.col("n").alias("n_item")), "item").join(per.select(F.col("item").alias("seed_item"), F.col("n").alias("n_seed")), "seed_item")
    return named.crossJoin(F.broadcast(total))


def measure(how: str, min_support: int = 1) -> Column:
    """``count``, ``jaccard`` or ``lift`` (also any other name) of a supported pair; 0
    below the least support."""
    both, a, b = F.col("both"), F.col("n_seed"), F.col("n_item")
    if how == "count":
        value = both.cast("double")
    elif how == "jaccard":
        value = both / (a + b - both)
    else:
        value = both * F.col("groups") / (a * b)
    return F.when(both >= max(min_support, 1), value).otherwise(0.0)


def seed_values(seeds: DataFrame, pairs: DataFrame, how: str = "lift", min_support: int = 1) -> DataFrame:
    """``request_id, seed_pos, item, value`` of every pair that meets at all."""
    scored = pairs.select("seed_item", "item", measure(how, min_support).alias("value"))
    return seeds.select("request_id", "seed_pos", F.col("item").alias("seed_item")).join(scored, "seed_item").select("request_id", "seed_pos", "item", "value")
