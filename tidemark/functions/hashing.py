"""FNV-1a buckets for experiments, in SQL functions only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    raw = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(text)
    at = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.expr("cast(array() as array<int>)"))
    byte = F.transform(at, lambda i: F.conv(F.substring(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(byte, F.lit(2166136261), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def bucket(salt: str, unit: Column) -> Column:
    """Bucket 0 to 9,999 of a unit under a salt."""
    return fnv1a32(F.concat(F.lit(salt), F.lit("\0"), unit)) % BUCKETS
