"""Products of rows and requests, written piece by piece."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests that a row meets at a time.  Parquet packs 504 numbers at once and by eights: runs
#: of this length start at a byte and look alike each time, so that they compress.
PIECE = 504


def in_pieces(rows: DataFrame, asked: DataFrame, on: tuple[str, ...] = (), own: str | None = None, into: int | None = None, piece: int | None = None) -> DataFrame:
    """``rows`` for every one of ``asked`` (that has the same ``on``), with its other columns
    first; not for those in the row's list ``own``, of values of the only such column.

    What is asked for is cut into arrays of ``PIECE``, and each task goes through its
    rows once for every array: neighbouring rows of the result hold the same short run of
    requests again and again, which files keep in a fraction of the bytes that runs of all
    requests take.  The arrays are opened in a loop of their own (``into`` tasks), as generated
    code keeps all that it makes of a row until it has made the last.
    """
    named = [c for c in asked.columns if c not in on]
    held, size = F.col(named[0]) if len(named) == 1 else F.struct(*named), piece or PIECE
    whole = asked.groupBy(*on).agg(F.array_sort(F.collect_list(held)).alias("__all")).where(F.size("__all") > 0)
    starts = F.sequence(F.lit(1), F.size("__all"), F.lit(size))
    pieces = whole.select(*on, F.posexplode(F.transform(starts, lambda k: F.slice("__all", k, size))).alias("__piece", "__held"))
    numbers = F.broadcast(pieces.select(*on, "__piece"))
    met = rows.join(numbers, list(on)) if on else rows.crossJoin(numbers)
    # always true, and not known to be: an order below a join is otherwise left out
    turns = met.sortWithinPartitions(*on, "__piece").where(F.spark_partition_id() >= 0)
    met = turns.join(F.broadcast(pieces), [*on, "__piece"])
    met = met if into is None else met.coalesce(into)
    if own is not None:
        met = met.withColumn("__held", F.when(F.col(own).isNull(), F.col("__held")).otherwise(F.filter("__held", lambda x: ~F.array_contains(own, x))))
    rest = [c for c in rows.columns if c != own]
    opened = met.select(F.explode("__held").alias("__x"), *rest)
    return opened.select(*[(F.col("__x") if len(named) == 1 else F.col(f"__x.{c}")).alias(c) for c in named], *rest)
