"""Entity, interaction and model tables on any path that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def entities(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an entity type; unordered, as only tie breaks need an order."""
    return spark.read.parquet(path)


def entity(table: DataFrame, key: str, value) -> DataFrame:
    """The row of one id; the filter reaches the Parquet scan."""
    return table.where(F.col(key) == F.lit(value))


def entities_in_order(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted(request_id, pos, item)`` in its order; unknown ids are skipped."""
    return wanted.join(table, wanted["item"] == table[key], "inner").orderBy("request_id", "pos")


def interactions(table: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Interactions of the types, all for none; ``seq`` is the order of arrival."""
    return table.where(F.col("type").isin(types)) if types else table


def user_history(table: DataFrame, user) -> DataFrame:
    """One user's interactions in order of arrival."""
    return table.where(F.col("user") == F.lit(user)).orderBy("seq")


def counts(table: DataFrame, column: str) -> DataFrame:
    """Rows by entity or interaction type; types without rows do not appear."""
    return table.groupBy(column).agg(F.count("*").alias("n"))


def upsert_entities(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: every row of ``new`` is later than all of ``old``; within
    ``new`` the greatest ``order`` is the last."""
    last = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def upsert_interactions(table: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the last value at the first arrival's place.  One shuffle,
    combined map-side; arrivals of equal ``seq`` go by their other columns."""
    other = [c for c in table.columns if c not in keys and c != "seq"]
    last = table.groupBy(*keys).agg(F.min("seq").alias("first_seq"), F.max(F.struct("seq", *other)).alias("last"))
    return last.select(*keys, F.col("first_seq").alias("seq"), *[F.col("last")[c].alias(c) for c in other])


def save_model(model: DataFrame, root: str, name: str) -> int:
    """Write a model as the version after the last; returns the version."""
    spark = model.sparkSession
    version = latest_version(spark, root, name) + 1
    model.write.mode("error").parquet(f"{root}/model={name}/version={version}")
    return version


def latest_version(spark: SparkSession, root: str, name: str) -> int:
    """Version last saved under a name, 0 for none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/model={name}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return 0
    names = [f.getPath().getName() for f in store.listStatus(path)]
    return max((int(n.split("=")[1]) for n in names if n.startswith("version=")), default=0)


def load_model(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The latest version of a model."""
    version = latest_version(spark, root, name)
    if not version:
        raise LookupError(f"no model {name}")
    return spark.read.parquet(f"{root}/model={name}/version={version}")
