"""Learned factors on the customers' purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.decay import edge_weight
from tidemark.operators import candidates as cand
from tidemark.operators import factors
from tidemark.queries import query
from tidemark.queries.binding import HALF_LIFE, SQL_AGE, SQL_EVENTS, events, items, now

PARAMS = factors.Params(factors=8, iterations=3)


@query("als_observations", f"""{SQL_EVENTS} SELECT usr AS user_id, target AS item, round(sum(ln(1 + greatest(value, 0)) * power(2.0, -greatest(({SQL_AGE}), 0) / (365 * 86400.0))), 6) AS x FROM ev WHERE type = 'purchase' GROUP BY usr, target""")
def als_observations(spark, d):
    return observations(spark, d).select(F.col("user").alias("user_id"), "item", F.round("x", 6).alias("x"))


def observations(spark, d):
    weight = F.when(F.col("type") == "purchase", edge_weight(F.col("value"), 1.0, True, "log1p"))
    return factors.observations(events(spark, d), items(spark, d), weight, HALF_LIFE, now())


@query("als_train")
def als_train(spark, d):
    return factors.train(observations(spark, d), PARAMS)[1].select(F.col("id").alias("item"), "vec")


@query("als_fold_in")
def als_fold_in(spark, d):
    """Every customer's vector from the trained items."""
    obs = observations(spark, d)
    vectors = factors.train(obs, PARAMS)[1]
    return factors.fold_in(obs.select(F.col("user").alias("request_id"), "item", "x"), vectors, PARAMS)


@query("src_factors")
def src_factors(spark, d):
    """The best new items of every customer divisible by 20 by the learned factors."""
    obs = observations(spark, d)
    vectors = factors.train(obs, PARAMS)[1]
    own = obs.where("user % 20 = 0").select(F.col("user").alias("request_id"), "item", "x")
    scored = factors.scores(factors.fold_in(own, vectors, PARAMS), vectors)
    return cand.top(scored, own).select("request_id", "item", "value", "src_rank")


@query("sig_embedding")
def sig_embedding(spark, d):
    obs = observations(spark, d)
    vectors = factors.train(obs, PARAMS)[1]
    wanted = vectors.where("id % 20 = 0")
    return factors.scores(wanted, vectors, cosine=True).withColumnRenamed("value", "raw")
