"""Helpers shared by the operators: scratch tables, Arrow batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session on one machine that names no folder of its own.
LOCAL_SCRATCH = "/tmp/checkpoints"
#: Text handed to one vectorised step, in bytes; bounds a worker's memory.
CHUNK_BYTES = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``; it has to
    be set on a cluster, where a folder of one machine would lose rows."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    return (found or LOCAL_SCRATCH).rstrip("/")


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a
    lost executor costs only a re-read.  Returns the table and its path."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more, through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def chunks(batches: Iterable[pa.RecordBatch], column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes; a longer
    text is a slice of its own."""
    for batch in batches:
        text = batch.column(column)
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i in range(n):
            total += int(sizes[i])
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < n:
            yield batch.slice(start, n - start)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(src, dst)``, root being the smallest
    node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): each round
    is a grouped minimum, combined map-side, and one join, so a node with very many
    neighbours is never gathered; rounds are written to the shared folder to cut
    lineage.  Null ends are ignored and self-loops make a component of their own.
    """
    spark = edges.sparkSession
    base, base_path = write_table(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u is not null and v is not null").distinct(), "edges")
    current, path = base.where("u <> v"), None
    seen = None
    for _ in range(max_rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        current, new_path = write_table(small, "components")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if path:
            drop_table(spark, path)
        path = new_path
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).union(current.select(F.col("u").alias("node"), F.col("v").alias("root")))
    alone = base.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(alone).groupBy("node").agg(F.min("root").alias("root"))


#: Rows of the smaller side up to which a join sends it to every executor.
BROADCAST_ROWS = 1_000_000


def sized_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with ``small`` broadcast if its counted rows are within ``BROADCAST_ROWS``
    (a few short columns each), else left to Spark's shuffled joins."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def row_key(*columns: str):
    """Columns ``k1, k2`` that identify a row's content: the id (0 for null) and a hash
    of all the named columns; equal rows share them."""
    return [F.coalesce(F.col(columns[0]).cast("long"), F.lit(0)).alias("k1"), F.xxhash64(*[F.col(c) for c in columns]).alias("k2")]


def drop_rows(docs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose ``row_key`` is not among the distinct
    ``keys``, a written table; a short one is broadcast, so that the texts stay in place."""
    k1, k2 = row_key(*columns)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1, k2)
    return sized_join(held, keys, ["k1", "k2"], "left_anti").select("row.*")
