"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they match.  Weak ones (user names, endpoints,
random-looking words) are reported only when an interval join finds complementary
parts within a scope of code points: a secret near an identifier or an endpoint.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import write_table

# Patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""(?:([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Characters that the value of an assignment has at least.
VALUE_LENGTH = 6
# Weak kinds: an account name, an address, and a word of letters of both cases and digits.
ACCOUNT = r"""(?:[Uu]ser(?:name)?|[Ll]ogin|[Aa]ccount|[Cc]lient_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""https?://[^\s"'<>]{4,}|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])(?::[0-9]{2,5})?"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{16,}"
KINDS = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("account", ACCOUNT), ("endpoint", ENDPOINT), ("opaque", OPAQUE)]
BASE = 3
#: Role of each kind: 0 secrets, 1 identifiers, 2 endpoints.
ROLES = (0, 1, 0, 1, 2, 0)
#: Code points between the starts of parts that belong together, at most.
SCOPE = 200


def matches(text: Column, kind: int) -> Column:
    """``array<struct<kind, gap, size, good>>``: the leftmost non-overlapping matches of
    a kind in order, each with the code points since the match before.  The text split
    at the pattern gives the gaps."""
    name, pattern = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = (lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= VALUE_LENGTH) if name == "assign" else (lambda m: F.lit(True))
    sized = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, g: F.struct(F.lit(kind).alias("kind"), F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), good(m).alias("good")))
    return F.when(F.rlike(text, F.lit(pattern)), sized).otherwise(F.lit(None))


def parts(docs: DataFrame) -> DataFrame:
    """``row, doc_id, found``: the matches of all kinds of every row, written once so
    that ``row`` stays the row's number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    each = F.filter(F.array(*[matches(F.col("text"), k) for k in range(len(KINDS))]), lambda x: x.isNotNull())
    return write_table(rows.select("row", "doc_id", F.flatten(each).alias("found")), "secret-parts")[0]


def spans(found: DataFrame) -> DataFrame:
    """``row, kind, start, stop`` in code points, by a running sum over each row's kind."""
    flat = found.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "m")).select("row", "at", "m.*")
    ordered = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = flat.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(ordered)).where("good")
    return placed.select("row", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")


def linked(placed: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts that start within ``scope`` of a complementary part of their row: a
    secret needs an identifier or endpoint, these need a secret.

    An interval join: positions are binned by ``scope``; a part meets the bins around
    its own; per bin and role only the first and last starts are kept, as one of them
    is within reach if any start of a neighbouring bin is.
    """
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("kind") + 1)
    own = placed.withColumn("secret", role == 0).withColumn("bin", F.floor(F.col("start") / scope))
    ends = own.groupBy("row", "bin", "secret").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    around = ends.select("row", F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), F.lit(d).alias("side")) for d in (-1, 0, 1)])).alias("b"), (~F.col("secret")).alias("secret"), "first", "last").select("row", "b.bin", "b.side", "secret", "first", "last")
    weak = own.where(F.col("kind") >= BASE)
    # inside one bin every part is near enough; to the sides the closest end decides
    near = (F.col("side") == 0) | (F.abs(F.col("start") - F.col("first")) <= scope) | (F.abs(F.col("start") - F.col("last")) <= scope)
    met = weak.join(around, ["row", "bin", "secret"]).where(near)
    return met.select("row", "kind", "start", "stop").distinct()


def listed(array: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(n) for n, _ in KINDS])
    return F.array_join(F.transform(F.array_sort(array), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Null text is empty; a row without findings has zero counts and empty spans; repeated
    rows are scanned each.
    """
    found = parts(docs)
    placed = spans(found)
    kept = placed.where(F.col("kind") < BASE).union(linked(placed, scope))
    per = kept.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("s"))
    every = found.select("row", "doc_id").join(per, "row", "left").withColumn("s", F.coalesce("s", F.expr("array()")).cast("array<struct<start:bigint,kind:int,stop:bigint>>"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k][0]}")
    return every.select("doc_id", count(0), count(1), count(2), F.sha2(listed(F.filter("s", lambda x: x["kind"] < BASE)), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of the whole ``documents`` table."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
