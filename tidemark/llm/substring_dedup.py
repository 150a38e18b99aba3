"""Substring dedup: paragraph MinHash banding, exact verification, components.

Paragraphs (lines of at least ``MIN_WORDS`` words) are sets of 5-word shingles; their MinHash
bands are tuned for recall, paragraphs that collide in a band are compared by exact Jaccard,
and components of the links are the clusters of which one paragraph stays.

A passage of ``PASSAGE`` words that repeats inside differing paragraphs, or over line
breaks, is found on the whole text's words: 32-word pieces at content-chosen starts
(winnowing) are candidates, since two texts that share 50 words in a row share such a piece,
and the 50-word windows around the pieces that occur in several texts decide exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, connected_components, drop_table, row_key, sized_join, texts, write_table

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Words of a repeated passage that is found wherever it lies, and of its pieces.
PASSAGE, PIECE = 50, 32
#: Words that a paragraph has at least to be compared; shorter repeats are left to line dedup.
MIN_WORDS = PASSAGE
#: Bytes of a text split into words at a time, and words or shingles worked on at a time.
SPLIT_BYTES, BLOCK = 1 << 20, 1 << 16
#: Texts of one band group compared in one task; larger groups go by pairs of blocks.
GROUP_BLOCK = 1024
#: Numbers of 4 bytes that a broadcast of places holds at most (64 MB).
BROADCAST_PLACES = 16_000_000
BLANK = re.compile(rb"[\x20\x09-\x0D]")
_ODD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 40) -> tuple[int, int]:
    """Bands and rows: the most rows per band (fewest chance collisions) with which at
    most ``most`` hashes find pairs at ``similarity`` with probability ``recall``."""
    for rows in range(10, 0, -1):
        bands = most // rows
        if bands and 1 - (1 - similarity**rows) ** bands >= recall:
            return next(b for b in range(1, bands + 1) if 1 - (1 - similarity**rows) ** b >= recall), rows
    return most, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Word hashes, kept for the words seen last."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w, 3)
        return np.array([seen[w] for w in words], dtype=np.uint64)


def word_hashes(line: bytes, hasher: Hasher) -> np.ndarray:
    """Hashes of a line's words in lower case, a bounded part of it at a time."""
    if len(line) <= SPLIT_BYTES:
        return hasher(line.split())
    out, start = [], 0
    while start < len(line):
        cut = BLANK.search(line, start + SPLIT_BYTES)
        end = cut.start() if cut else len(line)
        out.append(hasher(line[start:end].split()))
        start = end
    return np.concatenate(out)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.full(size, base, dtype=np.uint64)) for base in (_ODD, pow(_ODD, -1, 1 << 64)))


@lru_cache(maxsize=4)
def _draws(n: int) -> np.ndarray:
    return np.random.default_rng(17).integers(0, 1 << 63, (2, n, 1), dtype=np.uint64) | np.uint64(1)


def line_hashes(text: bytes, hasher: Hasher) -> list[np.ndarray]:
    """Hashes of the words of each line of a text."""
    lines = text.lower().split(b"\n")
    if len(text) > SPLIT_BYTES:
        return [word_hashes(line, hasher) for line in lines]
    words = [line.split() for line in lines]
    return np.split(hasher([w for line in words for w in line]), np.cumsum([len(line) for line in words])[:-1])


class Runs:
    """Hashes of runs of words, from prefix sums of a polynomial."""

    def __init__(self, h: np.ndarray):
        # powers of a few sizes are kept; those of a very long text are made for it alone
        power, self.inverse = _powers(BLOCK) if len(h) <= BLOCK else _powers.__wrapped__(len(h))
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], out=self.total[1:])

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.total[at + length] - self.total[at]) * self.inverse[at])


def piece_starts(runs: Runs, ends: np.ndarray) -> np.ndarray:
    """Starts of the pieces: of every ``PASSAGE`` words in a row inside one text, the start
    whose next three words hash least.  ``ends`` has each word's end of text."""
    span, out = PASSAGE - PIECE + 1, [np.zeros(0, np.int64)]
    for s in range(0, len(ends) - PASSAGE + 1, BLOCK):
        e = min(len(ends) - PASSAGE + 1, s + BLOCK)
        low = np.lib.stride_tricks.sliding_window_view(runs(np.arange(s, e + span - 1), 3), span).argmin(axis=1)
        inside = np.flatnonzero(np.arange(s, e) + PASSAGE <= ends[s:e])
        out.append(s + inside + low[inside])
    return np.unique(np.concatenate(out))


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Distinct hashes of the 5-word shingles of a paragraph, sorted."""
    return np.unique(Runs(h)(np.arange(len(h) - SHINGLE + 1), SHINGLE))


def band_keys(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash bands of a set of shingles."""
    draws = _draws(bands * rows)
    low = np.full(bands * rows, _M64, dtype=np.uint64)
    for s in range(0, len(grams), BLOCK):
        np.minimum(low, ((grams[None, s : s + BLOCK] * draws[0] + draws[1]) >> np.uint64(20)).min(axis=1), out=low)
    keys = np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for k in range(rows):
        keys = keys * np.uint64(_ODD) + low[k::rows]
    return _mix(keys)


def text_rows(group: list[bytes], hasher: Hasher, bands: int, rows: int) -> list[tuple]:
    """``owner, paragraph, n_words, key, bands, shingles, pieces, places``: a row of paragraph
    -1 for each text of at least ``PASSAGE`` words and one for each of its paragraphs."""
    out, parts, sizes, owners = [], [], [], []
    none = np.zeros(0, np.int64)
    for i, text in enumerate(group):
        lines = line_hashes(text, hasher)
        h = np.concatenate(lines)
        if len(h) < PASSAGE:
            continue
        parts.append(h)
        sizes.append(len(h))
        owners.append(i)
        for k, own in enumerate(lines):
            if len(own) >= MIN_WORDS:
                grams = shingle_set(own)
                low = np.unique((grams & np.uint64(0x7FFFFFFF)).astype(np.int32))
                out.append((i, k, len(own), xxhash.xxh64_intdigest(own.tobytes()), band_keys(grams, bands, rows).view(np.int64), low, none, none))
    if parts:
        runs = Runs(np.concatenate(parts))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        starts = piece_starts(runs, np.repeat(begin[1:], sizes))
        values, cut = runs(starts, PIECE).view(np.int64), np.searchsorted(starts, begin)
        for i, h, a, z, s in zip(owners, parts, cut[:-1], cut[1:], begin):
            out.append((i, -1, len(h), xxhash.xxh64_intdigest(h.tobytes()), none, none, values[a:z], starts[a:z] - s))
    return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays), kind))


def sketched(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, k1, k2`` with what ``text_rows`` gives for each text."""
    schema = "doc_id long, k1 long, k2 long, paragraph int, n_words int, key long, bands array<long>, shingles array<int>, pieces array<long>, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in chunks(batches, 3):
            found = text_rows(texts(b.column(3)), hasher, bands, rows)
            if found:
                owner, paragraph, n, key, band, shingles, pieces, places = zip(*found)
                at = pa.array(owner)
                arrays = [*(b.column(c).take(at) for c in range(3)), pa.array(paragraph, pa.int32()), pa.array(n, pa.int32()), pa.array(np.array(key, dtype=np.uint64).view(np.int64)), _lists(band), _lists(shingles, pa.int32()), _lists(pieces), _lists(places, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def _verify(similarity: float):
    """Scan rows sorted by group; link texts of a group with Jaccard at ``similarity``.
    Pairs that links already connect are not compared again, so a group of ``n`` gives
    ``n - 1`` links at most and near-copies cost about one comparison each."""

    def group_links(keys: list[int], sets: list[np.ndarray]):
        heads: list[list[int]] = []
        for i in range(len(keys)):
            joined = None
            for members in list(heads):
                for j in members:
                    a, b = len(sets[i]), len(sets[j])
                    if min(a, b) < similarity * max(a, b):
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= similarity * (a + b - both) - 1e-9:
                        yield keys[i], keys[j]
                        if joined is None:
                            members.append(i)
                            joined = members
                        else:
                            joined.extend(members)
                            heads.remove(members)
                        break
            if joined is None:
                heads.append([i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, sets, out = None, [], [], []

        def close():
            if len(keys) > 1:
                out.extend(group_links(keys, sets))

        for b in batches:
            for group, x, y, key, shingles in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if (group, x, y) != current:
                    close()
                    current, keys, sets = (group, x, y), [], []
                keys.append(key)
                sets.append(shingles.values.to_numpy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], ["src", "dst"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], ["src", "dst"])

    return run


def paragraph_links(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(src, dst)`` between keys of distinct paragraphs, from ``rows(key, bands, shingles)``."""
    distinct = rows.groupBy("key").agg(F.first("bands").alias("bands"))
    keyed, keyed_path = write_table(distinct.select(F.explode("bands").alias("band"), "key"), "bands")
    sizes = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    groups, _ = write_table(keyed.join(sizes, "band"), "band-groups")
    drop_table(rows.sparkSession, keyed_path)
    colliding = groups.select("key").distinct()
    shingles = sized_join(rows.select("key", "shingles"), colliding, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))
    blocks = F.ceil(F.col("n") / GROUP_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j.cast("int")).alias("x"), F.greatest(own, j.cast("int")).alias("y")))
    spread = groups.select("band", "key", F.explode(pairs).alias("p")).select("band", "p.x", "p.y", "key")
    full = spread.join(shingles, "key").select("band", "x", "y", "key", "shingles")
    return full.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "key").mapInArrow(_verify(similarity), "src long, dst long").distinct()


def merged_spans(starts: np.ndarray) -> str:
    """The words covered by windows at the sorted starts, as ``first-end`` with the end
    exclusive, comma-joined."""
    if not len(starts):
        return ""
    new = np.flatnonzero(np.r_[True, np.diff(starts) > PASSAGE])
    last = np.r_[new[1:] - 1, len(starts) - 1]
    return ",".join(f"{a}-{z + PASSAGE}" for a, z in zip(starts[new].tolist(), starts[last].tolist()))


def repeated_passages(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, head, shared, removable``: by key of a text its spans of at least ``PASSAGE``
    words that a text of another key and another document has too, and those of them that
    a document of smaller id has.  ``docs(doc_id, k1, k2, text)``; ``rows`` are its
    ``sketched`` texts."""
    one = F.min(F.struct("k1", "k2"))
    # equal texts are one, whose documents are a to z
    once, _ = write_table(rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), one.alias("at"), F.min_by(F.struct("pieces", "places"), F.struct("k1", "k2")).alias("p")), "texts")
    # a piece of several texts; its windows tell whether those are of several documents
    pieces = F.explode(F.array_distinct("p.pieces")).alias("piece")
    spots, _ = write_table(once.select(pieces).groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece"), "shared-pieces")
    places = once.select("key", F.explode(F.arrays_zip("p.pieces", "p.places")).alias("x")).select("key", F.col("x.pieces").alias("piece"), F.col("x.places").alias("place"))
    hit = sized_join(places, spots, "piece", "left_semi").groupBy("key").agg(F.collect_list("place").alias("places"))
    hits, _ = write_table(hit.join(once.select("key", "at.k1", "at.k2", "a", "z"), "key"), "piece-hits")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in chunks(batches, 0):
            found, starts = [], []
            for text, places in zip(texts(b.column(0)), b.column(4)):
                h = np.concatenate(line_hashes(text, hasher))
                at = np.unique((places.values.to_numpy()[:, None] - np.arange(PASSAGE - PIECE + 1)[None, :]).ravel()).astype(np.int64)
                at = at[(at >= 0) & (at + PASSAGE <= len(h))]
                found.append(Runs(h)(at, PASSAGE).view(np.int64))
                starts.append(at)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), _lists(found), _lists(starts, pa.int32())], ["key", "a", "z", "windows", "starts"])

    # lists of places differ in length: their sum, not the rows, says what a broadcast sends
    numbers = hits.agg(F.sum(F.size("places") + 8)).first()[0] or 0
    read = docs.select("k1", "k2", "text").join(F.broadcast(hits) if numbers <= BROADCAST_PLACES else hits, ["k1", "k2"]).select("text", "key", "a", "z", "places")
    around, _ = write_table(read.mapInArrow(windows, "key long, a long, z long, windows array<long>, starts array<int>"), "windows")
    spread = around.select("key", "a", "z", F.explode(F.arrays_zip("windows", "starts")).alias("w")).select("key", "a", "z", F.col("w.windows").alias("window"), F.col("w.starts").alias("start"))
    both, _ = write_table(spread.groupBy("window").agg(F.min("a").alias("first"), F.max("z").alias("last")).where("first <> last").select("window", "first"), "shared-windows")
    # not broadcast even if short: it grows with the documents; Spark splits hot windows
    starts = spread.select("window", "key", "a", "start").join(both, "window").groupBy("key").agg(F.sort_array(F.collect_set("start")).alias("every"), F.sort_array(F.collect_set(F.when(F.col("first") < F.col("a"), F.col("start")))).alias("later"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pa.array([merged_spans(x.values.to_numpy()) for x in b.column(k)]) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["key", "shared", "removable"])

    inside = starts.select("key", "every", "later").mapInArrow(spans, "key long, shared string, removable string")
    copies = once.where("a <> z").select("key", F.col("a").alias("head"))
    return copies.join(inside, "key", "full_outer")


def repeated_text(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, paragraph, n_words, cluster_doc, cluster_paragraph, keep, shared, removable``.

    One row for every paragraph that is similar or equal to one of another document: the
    cluster's first paragraph (by doc_id, then paragraph) names it and is kept.  Paragraphs
    are numbered from 0 by line.  And one row of paragraph -1 for every document that
    shares a passage of ``PASSAGE`` words with another, line breaks counting as blanks:
    ``shared`` lists the spans of words that another document has too, ``removable`` those
    that a document of smaller id has, as ``first-end`` with the end exclusive; a copy of
    a whole text is clustered with the first of its documents and one span.

    Null, empty and shorter texts have no rows; repetition inside one doc_id alone is not
    reported; repeated rows give equal rows.  A row of null doc_id counts as no other
    document.  Words are split at ASCII blanks, A-Z in lower case.
    """
    bands, per = tune_bands(similarity)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("doc_id", "text"), F.col("text").cast("string").alias("text")).where("text <> ''")
    every, _ = write_table(sketched(named, bands, per), "sketches")
    rows, whole = every.where("paragraph >= 0"), every.where("paragraph < 0")
    roots = connected_components(paragraph_links(rows, similarity)).withColumnsRenamed({"node": "key"})
    by_key = rows.groupBy("key").agg(F.min(F.struct("doc_id", "paragraph")).alias("low"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    clustered, _ = write_table(by_key.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "clustered")
    clusters = clustered.groupBy("root").agg(F.min("low").alias("head"), F.min("a").alias("a"), F.max("z").alias("z")).where("a <> z")
    near, _ = write_table(clustered.select("key", "root").join(clusters.select("root", "head"), "root").select("key", "head"), "near")
    paragraphs = sized_join(rows.select("key", "doc_id", "paragraph", "n_words"), near, "key")
    first = paragraphs.select("doc_id", "paragraph", "n_words", F.col("head.doc_id").alias("cluster_doc"), F.col("head.paragraph").alias("cluster_paragraph"), (F.struct("doc_id", "paragraph") == F.col("head")).alias("keep"), F.lit("").alias("shared"), F.lit("").alias("removable"))
    passages, _ = write_table(repeated_passages(named, whole), "passages")
    found = sized_join(whole.select("key", "doc_id", "paragraph", "n_words"), passages, "key")
    all_ = F.concat(F.lit("0-"), F.col("n_words").cast("string"))
    copy = F.col("head").isNotNull()
    later = F.coalesce(F.col("doc_id") != F.col("head"), F.lit(False))
    removable = F.when(later, all_).otherwise(F.coalesce("removable", F.lit("")))
    second = found.select("doc_id", "paragraph", "n_words", F.coalesce("head", "doc_id").alias("cluster_doc"), F.lit(-1).alias("cluster_paragraph"), (~later).alias("keep"), F.when(copy, all_).otherwise(F.col("shared")).alias("shared"), removable.alias("removable"))
    return first.union(second)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages of the whole ``documents`` table."""
    return repeated_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
