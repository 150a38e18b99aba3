"""Normalisers of a raw signal over the candidates of a request; NULL becomes 0.5."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def normalise(raw: Column, how: str, request: str = "request_id", position: str = "cand_pos", bounds: tuple[Column, Column] | None = None) -> Column:
    """``minmax`` (also any unknown name; a constant is 0.5), ``rank`` (ordinal share of
    the known, ties by candidate order) or ``none``.  ``bounds`` are the least and the
    greatest raw of the request where they are known; else a window finds them."""
    whole = Window.partitionBy(request)
    if how == "none":
        value = raw
    elif how == "rank":
        order = whole.orderBy(raw.asc_nulls_last(), position)
        value = F.when(raw.isNotNull(), F.row_number().over(order) / F.count(raw).over(whole))
    else:
        lo, hi = bounds or (F.min(raw).over(whole), F.max(raw).over(whole))
        value = F.when(hi > lo, (raw - lo) / (hi - lo))
    return F.coalesce(value, F.lit(0.5))


def combine(mean: Column, most: Column, share: float) -> Column:
    """Blend of a candidate's mean and greatest likeness over the seed."""
    return (1 - share) * mean + share * most
