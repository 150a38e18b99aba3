"""Cutting lineage where several branches read one result."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only where the session names no folder of its own.
LOCAL = "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder (``spark.checkpoint.dir``), so
    that its readers neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or LOCAL)
    return df.checkpoint()
