"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

A text is cut into sections, these into paragraphs and these into phrases, the leaves;
every node above is a SHA-256 over its children's digests, so equal roots mean equal texts
and a walk down differing branches finds the paragraphs that differ.  Sections and phrases
start where the content says, not by count, so an insertion changes the nodes around it and
leaves later branches alone.  The likeness of two trees is that of their sets of leaves.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: A section starts at a line that is empty or begins with ``#`` or one of A to F.
SECTION = r"\n(?=[\n#A-F])"
#: A phrase ends at a blank after punctuation or one of these frequent letters (Latin,
#: Cyrillic, Greek, Arabic, Hebrew, Devanagari, Hangul), or after one of the frequent
#: characters or marks of scripts without blanks; at the latest after so many characters.
#: What is cheap to test comes first.
BEFORE_BLANK, WITHOUT_BLANK, LONGEST = ".,;:!?eаиςαنةהםाे다는", "的一是不了のにはをาเ。、，？！", 32
PHRASE = rf"(?s).{{1,{LONGEST}}}?(?:(?<=\x20)(?<=[{BEFORE_BLANK}]\x20)|(?<=[^\x00-\x7F])(?<=[{WITHOUT_BLANK}])|$)|.{{{LONGEST}}}"
#: Documents of one bucket of ids, on average; neighbours are found inside buckets.
BUCKET_ROWS = 2_000
#: Quantiles of the ids that buckets are cut at, and parts of a quantile's range, at most.
QUANTILES, PARTS = 4_096, 16


def tree(text: Column) -> Column:
    """``array<struct<digest, paragraphs: array<struct<digest, leaves>>>>`` of a text: its
    sections.  A leaf is a phrase's XXH64; a paragraph's digest is the SHA-256 of its text
    and its leaves, a section's that of its paragraphs' digests.

    Null is the empty text, which is one section with one empty paragraph without leaves.
    """
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PHRASE), 0), lambda x: F.xxhash64(x))
    sealed = lambda p, xs: F.struct(F.sha2(F.concat(p, F.lit("\n"), F.xxhash64(xs).cast("string")), 256).alias("digest"), xs.alias("leaves"))
    paragraph = lambda p: F.transform(F.array(leaves(p)), lambda xs: sealed(p, xs))[0]
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), SECTION, -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))
    return F.transform(lines, lambda ps: F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["digest"]), ""), 256).alias("digest"), ps.alias("paragraphs")))


def root(t: Column) -> Column:
    """Root digest of a tree, 64 hex digits: the document's fingerprint."""
    return F.sha2(F.array_join(F.transform(t, lambda s: s["digest"]), ""), 256)


def leaf_set(t: Column) -> Column:
    """Distinct leaves of a tree."""
    return F.array_distinct(F.flatten(F.flatten(F.transform(t, lambda s: F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def likeness(a: Column, b: Column) -> Column:
    """Share of two sets of leaves that both have: 0 to 1, 1 for equal or both empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(all_ == 0, 1.0).otherwise(2.0 * both / all_)


def places(xs: Column, lost: Column) -> Column:
    """Numbers from 0 of the members of ``xs`` that ``lost`` holds.  ``lost`` is bound to a
    name first: inside the walk over ``xs`` it would be worked out for every member."""
    held = F.transform(F.array(lost), lambda ls: F.filter(F.transform(xs, lambda x, i: F.when(F.array_contains(ls, x), i)), lambda i: i.isNotNull()))
    return held[0]


def changed_sections(old: Column, new: Column) -> Column:
    """Numbers from 0 of the sections of ``new`` whose digests ``old`` does not have."""
    digests = lambda t: F.transform(t, lambda s: s["digest"])
    return places(digests(new), F.array_except(digests(new), digests(old)))


def changed_paragraphs(old: Column, new: Column) -> Column:
    """Numbers from 0 of the paragraphs of ``new`` that ``old`` does not have; these are
    under differing sections only, as a section's digest is that of its paragraphs'."""
    flat = lambda t: F.flatten(F.transform(t, lambda s: F.transform(s["paragraphs"], lambda p: p["digest"])))
    return places(flat(new), F.array_except(flat(new), flat(old)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, n_sections, n_paragraphs`` of every row."""
    trees = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree(F.col("text").cast("string")).alias("tree"))
    return trees.select("doc_id", root(F.col("tree")).alias("fingerprint"), F.size("tree").alias("n_sections"), F.aggregate("tree", F.lit(0), lambda n, s: n + F.size(s["paragraphs"])).alias("n_paragraphs"))


def bucketed(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows(doc_id, h, ...)`` with ``bucket``: numbers that rise with the id, nulls first,
    and among rows of one id fall with the hash ``h``.

    Buckets are cut at quantiles of the ids, and a quantile's range into equal parts, so
    ids far apart or crowded do not matter; an id that fills several quantiles is cut by
    ``h``, and so are null ids.  At most ``QUANTILES`` bounds reach the driver.
    """
    n, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    cuts = max(1, min(QUANTILES, -(-known // bucket_rows)))
    parts = max(1, min(PARTS, -(-known // (cuts * bucket_rows))))
    found = rows.agg(F.percentile_approx("doc_id", [k / cuts for k in range(cuts + 1)], 10 * QUANTILES)).first()[0] if known else None
    bounds = sorted(set(found or [0]))
    times = [(found or [0]).count(b) for b in bounds]
    # two steps of a search: the block of bounds, then the bound inside the block
    block = max(1, int(len(bounds) ** 0.5))
    heads, all_ = F.array(*[F.lit(b) for b in bounds[::block]]), F.array(*[F.lit(b) for b in bounds])
    last = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    start = F.greatest(last(heads) - 1, F.lit(0)) * block
    at = F.greatest(start + last(F.slice(all_, start + 1, block)) - 1, F.lit(0))
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    low, high = F.get(all_, at), F.get(all_, at + 1)
    real = lambda x: x.cast("double")
    within = F.coalesce((real(F.col("doc_id")) - real(low)) / (real(high) - real(low)), F.lit(0.0))
    # rows of a bound's own id are cut by h after the part of the range above it
    fold = F.get(F.array(*[F.lit(t) for t in times]), at)
    own = F.when((F.col("doc_id") == low) & (fold > 1), fold - 1 - F.floor(share * fold).cast("int")).otherwise(fold + F.floor(within * parts).cast("int"))
    width = max(times) + parts + 1
    none = -1 - F.floor(share * max(1, min(QUANTILES * PARTS, -(-(n - known) // bucket_rows)))).cast("long")
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), none).otherwise(at.cast("long") * width + own))


def in_order(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, WindowSpec]:
    """``doc_id, text, h, at, copy`` dealt out and sorted by buckets, and the window in which
    each row that is no ``copy`` is followed by the next document by descending doc_id, the
    last by the first.

    Rows of one id, and those of null id, which come last, go by a hash of their text.
    The first row of each bucket is copied to the end of the one before, so that one window
    inside buckets sees every neighbour and the texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    placed = bucketed(rows, bucket_rows)
    # the first row of each bucket, and the bucket before it (the last one, for the first);
    # at most QUANTILES * (PARTS + 1) buckets and those of an id or null id cut by its hash
    tops = placed.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("minus"), "h")).alias("top"))
    order = Window.orderBy(F.desc("bucket"))
    chain = tops.select(F.bitwise_not("top.minus").alias("top_id"), F.col("top.h").alias("top_h"), F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy(F.lit(1)))).alias("before"))
    linked = placed.join(F.broadcast(chain), placed["doc_id"].eqNullSafe(F.col("top_id")) & (placed["h"] == F.col("top_h")), "left")
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("copy"))
    copied = F.struct(F.col("before").alias("at"), F.lit(True).alias("copy"))
    spread = linked.select("doc_id", "text", "h", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copied))).alias("p")).select("doc_id", "text", "h", "p.at", "p.copy")
    order = ["copy", F.desc_nulls_last("doc_id"), "h"]
    return spread.repartition("at").sortWithinPartitions("at", *order), Window.partitionBy("at").orderBy(*order)


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, text, next_text``: each row with the text of the next document."""
    rows, follow = in_order(docs, bucket_rows)
    return rows.withColumn("next_text", F.lead("text").over(follow)).where(~F.col("copy")).select("doc_id", "text", "next_text")


def edit_report(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the last third
    replaced by the beginning of the next document) and their likenesses.

    A text's tree is grown once, after the shuffle, and its leaves are handed to the
    document before it together with the text.
    """
    rows, follow = in_order(docs, bucket_rows)
    grown = rows.select("*", tree(F.col("text")).alias("a"))
    grown = grown.select("*", leaf_set(F.col("a")).alias("x"))
    pairs = grown.select("*", F.lead("text").over(follow).alias("next_text"), F.lead("x").over(follow).alias("z")).where(~F.col("copy"))
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(length(text) / 3) as int))"))
    texts = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "a", "x", "z", edited.alias("edited"))
    trees = texts.select("doc_id", "n_chars", "a", "x", "z", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("edited")).alias("b"))
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    sets = trees.select("*", leaf_set(b).alias("y"))
    return sets.select("doc_id", "n_chars", "edited_sha256", root(a).alias("fingerprint"), root(b).alias("edited_fingerprint"), likeness(x, F.col("y")).alias("near_edited"), likeness(x, F.col("z")).alias("near_next"), F.size(a).alias("n_sections"), F.size(changed_sections(a, b)).alias("n_changed_sections"), F.size(changed_paragraphs(a, b)).alias("n_changed_paragraphs"))


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and edits of the whole ``documents`` table."""
    return edit_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
