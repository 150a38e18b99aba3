"""The engine's tables from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import products

NOW_TEXT = "2001-08-02 00:00:00"
DAY = 86400.0
HALF_LIFE = 365 * DAY
#: Rows that a task of a product makes, and tasks that it is dealt to at most.
TASK_ROWS, TASKS = 4_000_000, 2048
#: Requests that a row meets at a time in ``in_pieces``.
PIECE = products.PIECE


def now():
    return F.lit(NOW_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("item"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
        F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("words"),
        F.timestamp_add("DAY", (key % 2000).cast("int"), F.lit("1995-01-01").cast("timestamp")).alias("created"),
        ((key * 37 % 18000) / 100.0 - 90).cast("float").cast("double").alias("lat"), ((key * 91 % 36000) / 100.0 - 180).cast("float").cast("double").alias("lon"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("user"), F.when(F.col("l_returnflag") == "R", "return").otherwise("purchase").alias("type"), F.col("l_partkey").alias("target"),
        F.col("l_quantity").alias("value"), F.col("o_orderdate").alias("ts"), F.col("l_orderkey").alias("order_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("request_id"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request's part and the two after it, as far as they exist."""
    wanted = requests(spark, sf_dir).select("request_id", F.posexplode(F.sequence("request_id", F.col("request_id") + 2)).alias("seed_pos", "item"))
    return wanted.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), "item", "left_semi").select("request_id", "seed_pos", "item")


def spread(rows: DataFrame, times: int) -> DataFrame:
    """``rows`` dealt to enough tasks for a product with ``times`` others: a short file is
    read by one task, however long the product."""
    return rows.repartition(tasks(rows.count() * times))


def tasks(pairs: int) -> int:
    return min(TASKS, pairs // TASK_ROWS + 1)


def all_candidates(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Every item for every request, in order of id; ``asked`` are requests with columns of
    their own."""
    asked = requests(spark, sf_dir) if asked is None else asked
    return spread(items(spark, sf_dir), asked.count()).crossJoin(F.broadcast(asked)).withColumn("cand_pos", F.col("item"))


def in_pieces(rows: DataFrame, asked: DataFrame, own: str | None = None) -> DataFrame:
    """``rows`` dealt out to tasks for every one of ``asked``, piece by piece, but for those
    in the row's list ``own``."""
    into = tasks(rows.count() * asked.count())
    return products.in_pieces(rows.repartition(into), asked, own=own, into=into, piece=PIECE)


def scales(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the least and greatest value of each column over the catalogue."""
    return table.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])


# The same in SQL.
SQL_ITEMS = """items AS (SELECT p_partkey AS item, p_brand AS brand, p_type AS ptype, p_size::DOUBLE AS size, p_retailprice AS price,
  list_sort(list_distinct(string_split(p_name, ' '))) AS words, TIMESTAMP '1995-01-01' + to_days((p_partkey % 2000)::INTEGER) AS created,
  ((p_partkey * 37 % 18000) / 100.0 - 90)::FLOAT::DOUBLE AS lat, ((p_partkey * 91 % 36000) / 100.0 - 180)::FLOAT::DOUBLE AS lon FROM part)"""
SQL_EVENTS = """ev AS (SELECT o_custkey AS usr, CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'purchase' END AS type, l_partkey AS target,
  l_quantity AS value, o_orderdate AS ts, l_orderkey AS order_id, l_orderkey * 100 + l_linenumber AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_SEEDS = """req AS (SELECT p_partkey AS request_id FROM part WHERE p_partkey % 20 = 0),
seeds AS (SELECT request_id, k AS seed_pos, request_id + k AS item FROM req, (SELECT unnest([0, 1, 2]) AS k) WHERE request_id + k IN (SELECT p_partkey FROM part))"""
SQL_SCALES = "sc AS (SELECT min(size) AS lo_size, max(size) AS hi_size, min(price) AS lo_price, max(price) AS hi_price FROM items)"
SQL_NOW = "TIMESTAMP '2001-08-02'"
SQL_AGE = "(epoch_us(TIMESTAMP '2001-08-02') - epoch_us(ts)) / 1e6"
