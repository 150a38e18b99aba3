"""Similarity metrics between two columns: a double in [0, 1], NULL for "cannot tell".

A NULL term is left out of a weighted mean instead of counting as a mismatch.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 for two empty sets, NULL if either is NULL."""
    union = F.size(F.array_union(a, b))
    value = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
    return F.when(a.isNotNull() & b.isNotNull(), value)


#: Distinct members up to which sets are kept as bits, 63 to a number.
BITS, WIDE = 504, 63


def as_bits(rows: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """``rows`` with the sets of ``column`` as the bits of a few numbers, and their names; no
    names if there are more than ``BITS`` members, or a NULL one."""
    found = rows.select(F.explode(column).alias("m")).distinct().limit(BITS + 1).collect()
    members = [r["m"] for r in found]
    if not members or len(members) > BITS or None in members:
        return rows, []
    places = [members[k : k + WIDE] for k in range(0, len(members), WIDE)]
    bit = lambda ms: lambda n, m: n.bitwiseOR(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(ms) for x in (v, 1 << k)]), m).cast("long"), F.lit(0).cast("long")))
    made = {f"__bits_{column}_{k}": F.aggregate(column, F.lit(0).cast("long"), bit(ms)) for k, ms in enumerate(places)}
    return rows.withColumns(made), list(made)


def jaccard_of_bits(a: list[Column], b: list[Column]) -> Column:
    """``jaccard`` of two sets ``as_bits``."""
    count = lambda xs: sum(map(F.bit_count, xs[1:]), F.bit_count(xs[0]))
    union = count([x.bitwiseOR(y) for x, y in zip(a, b)])
    return F.when(union == 0, 0.0).otherwise(count([x.bitwiseAND(y) for x, y in zip(a, b)]) / union)


def equals(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def log_ratio(a: Column, b: Column) -> Column:
    """1 at equal sizes, 0 at a factor of ten or more; NULL unless both are positive."""
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - F.abs(F.ln(a) - F.ln(b)) / F.ln(F.lit(10.0))))


def closeness(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    """Distance on the catalogue's range; 1 where the range is a single value."""
    near = F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.nullif(hi - lo, F.lit(0.0)))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(hi <= lo, 1.0).otherwise(near))


def dot(a: Column, b: Column) -> Column:
    wide = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(wide, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors; NULL if lengths differ, 0 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0, 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0))))


def scaled(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max on the catalogue; a constant attribute is 0."""
    return F.when(x.isNotNull(), F.when(hi <= lo, 0.0).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0))))


def cosine_group(a: list[Column], b: list[Column], ranges: list[tuple[Column, Column]]) -> Column:
    """Cosine of numeric attributes scaled on the catalogue; NULL if any is missing."""
    left = [scaled(x, lo, hi) for x, (lo, hi) in zip(a, ranges)]
    right = [scaled(x, lo, hi) for x, (lo, hi) in zip(b, ranges)]
    known = F.lit(True)
    for x in [*left, *right]:
        known = known & x.isNotNull()
    return F.when(known, cosine(F.array(*left), F.array(*right)))


def weighted_mean(terms: Iterable[tuple[Column, float]]) -> Column:
    """Mean of the terms that are there, by positive weight; 0 if none is."""
    used = [(v, w) for v, w in terms if w > 0]
    if not used:
        return F.lit(0.0)
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in used[1:]), F.coalesce(used[0][0] * used[0][1], F.lit(0.0)))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in used[1:]), F.when(used[0][0].isNotNull(), used[0][1]).otherwise(0.0))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


#: Metrics by name; others can be added.
METRICS = {"jaccard": jaccard, "equals": equals, "log_ratio": log_ratio, "closeness": closeness, "cosine": cosine}
