"""Near-duplicate documents by SimHash, found through the generalised pigeonhole
principle.

The 64 bits are grouped into parts of correlated bits; a dynamic program gives each
part its own threshold ``t_i`` (``-1`` skips the part) so that the thresholds sum to
``distance - parts + 1`` and the estimated number of signatures and candidates is
least.  Two fingerprints within ``distance`` bits then lie within ``t_i`` bits on some
part, hence share a signature: the part's value with ``t_i`` of its bits masked.
Signature groups are probed and every candidate is verified on all 64 bits.

``one_of_each`` asks for more: all texts at a Jaccard similarity of 0.8 on 5-word
shingles, most of which are further apart than any radius the signatures can afford.
Its candidates are the classes of near fingerprints and the groups of equal MinHash
bands, and each is verified by the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, connected_components, sized_join, texts, write_table
from tidemark.llm.substring_dedup import _ODD, GROUP_BLOCK, _mix, _verify, tune_bands

BITS = 64
#: Shingles hashed at a time, so that one very long text stays bounded in memory.
SHINGLE_BLOCK = 1 << 18
#: A signature shared by more fingerprints than this is split by a second pigeonhole.
HOT_SIGNATURE = 2048
#: Groups up to this size report their links; larger ones a spanning forest.
LINKS_UP_TO = 64
#: Numbers of parts that the plan chooses from.
PARTS = (2, 3, 4)
#: Near-copies for ``one_of_each``: words of a shingle and least Jaccard similarity.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: Shingles of one text that all MinHash draws see at a time.
DRAW_BLOCK = 1 << 15


def _digests(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each word shingle, repeats included, as 8 bytes; in blocks."""
    count = max(1, len(words) - shingle + 1)
    join, digest = b" ".join, xxhash.xxh64_digest
    for start in range(0, count, SHINGLE_BLOCK):
        part = words[start : min(count, start + SHINGLE_BLOCK) + shingle - 1]
        grams = map(join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [join(words)]
        yield np.frombuffer(b"".join([digest(g, 42) for g in grams]), dtype=np.uint8).reshape(-1, 8)


def _majority(blocks: Iterable[np.ndarray]) -> int:
    ones, count = np.zeros(BITS, dtype=np.int64), 0
    for raw in blocks:
        ones += np.add.reduce(np.unpackbits(raw, axis=1), axis=0, dtype=np.int64)
        count += len(raw)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def simhash64(text: bytes, shingle: int) -> int:
    """SimHash of one text: majority of the bits of XXH64 (seed 42) over its word
    shingles, repeats included; 0 if it has no word."""
    words = text.lower().split()
    return _majority(_digests(words, shingle)) if words else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)``: the SimHash of every whole text as a signed long,
    and XXH64 of the text, which tells apart rows of one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 1):
            fps = np.array([simhash64(t, shingle) for t in texts(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(run, "doc_id long, text_hash long, fp long")


# ------------------------------------------------------------------ planning


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of
    them.  Each task sends one matrix, and 4,096 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            m = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for s in range(0, len(m), 65536):
                total += m[s : s + 65536].T @ m[s : s + 65536]
            n += len(m)
        cell = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(total.ravel(), n))], ["cell", "total"])

    rows = fps.select("fp").mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["cell"]] = r["total"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy grouping: the bit with the strongest links to a part joins it next."""
    p = both / max(n, 1)
    mean = np.diag(p)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((p - np.outer(mean, mean)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        sub = corr[np.ix_(left, left)]
        group = [left[int(np.argmax(sub.max(axis=1)))]]
        left.remove(group[0])
        while len(group) < size:
            nxt = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        out.append(group)
    return out


def agreement(n: int, both: np.ndarray, part: list[int]) -> np.ndarray:
    """For each bit of the part, the chance that two fingerprints agree on it given
    that they agree on the earlier bit it is most correlated with."""
    p = both / max(n, 1)
    mean = np.clip(np.diag(p), 1e-6, 1 - 1e-6)
    out = []
    for k, j in enumerate(part):
        alone = mean[j] ** 2 + (1 - mean[j]) ** 2
        best = alone
        for i in part[:k]:
            p11 = p[i, j]
            joint = p11**2 + (mean[i] - p11) ** 2 + (mean[j] - p11) ** 2 + (1 - mean[i] - mean[j] + p11) ** 2
            best = max(best, joint / (mean[i] ** 2 + (1 - mean[i]) ** 2))
        out.append(min(best, 1 - 1e-9))
    return np.array(out)


def allocate(n: int, both: np.ndarray, distance: int, choices: tuple[int, ...] = PARTS) -> list[tuple[list[int], int]]:
    """Parts and their thresholds of least estimated cost: ``n`` rows for every
    signature and ``n * n / 2`` times the chance that two fingerprints share a part
    within its threshold.  Dynamic programming over the parts and the sum spent."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in choices:
        groups = correlated_parts(n, both, m)
        budget = distance - m + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            a = agreement(n, both, group)
            odds = (1 - a) / a
            poly = np.zeros(distance + 1)
            poly[0] = 1.0
            for o in odds:
                poly[1:] += o * poly[:-1].copy()
            cumulative = np.prod(a) * np.cumsum(poly)
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, distance + 1):
                    if t > len(group):
                        continue
                    add = 0.0 if t < 0 else n * comb(len(group), t) * 8.0 + n * n / 2 * cumulative[t]
                    total = cost + add
                    if spent + t not in step or total < step[spent + t][0]:
                        step[spent + t] = (total, [*chosen, t])
            table = step
        if budget in table and (best is None or table[budget][0] < best[0]):
            best = (table[budget][0], list(zip(groups, table[budget][1])))
    assert best is not None, "no allocation for this distance"
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def signature_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """One mask for each part and choice of ``t`` masked bits (bit 0 is the highest)."""
    out = []
    for part, t in plan:
        if t < 0:
            continue
        for hidden in combinations(part, t):
            mask = 0
            for b in part:
                if b not in hidden:
                    mask |= 1 << (BITS - 1 - b)
            out.append(mask)
    return out


# ------------------------------------------------------------------ probing


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links of ``distance`` bits connect, at most one for each
    fingerprint: labels fall to the least neighbour until they settle."""
    n, block = len(fps), max(1, (1 << 22) // len(fps))
    label = np.arange(n)
    while True:
        new = label.copy()
        for s in range(0, n, block):
            near = np.bitwise_count(fps[s : s + block, None] ^ fps[None, :]) <= distance
            new[s : s + block] = np.minimum(new[s : s + block], np.where(near, label[None, :], n).min(axis=1))
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(n)
    return fps[keep], fps[label[keep]]


def _probe(distance: int):
    """Scan rows sorted by signature; emit verified links ``(src, dst)`` of each group."""

    def emit(sig: np.ndarray, fps: np.ndarray):
        same = np.flatnonzero(np.r_[True, np.any(sig[1:] != sig[:-1], axis=1)])
        ends = np.r_[same[1:], len(fps)]
        size = ends - same
        a, b = [], []
        for s, e in zip(same[size > LINKS_UP_TO], ends[size > LINKS_UP_TO]):
            x, y = _forest(np.unique(fps[s:e]), distance)
            a.append(x)
            b.append(y)
        run = np.repeat(np.arange(len(same)), size)
        small = np.repeat(size <= LINKS_UP_TO, size)
        for d in range(1, int(size[size <= LINKS_UP_TO].max(initial=1))):
            ok = (run[d:] == run[:-d]) & small[d:] & (fps[d:] != fps[:-d])
            i = np.flatnonzero(ok)
            i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= distance]
            a.append(fps[i])
            b.append(fps[i + d])
        return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sig, held = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def flush(sig, fps):
            src, dst = emit(sig, fps)
            lo, hi = np.minimum(src, dst), np.maximum(src, dst)
            pairs = np.unique(np.stack([lo, hi], axis=1), axis=0) if len(lo) else np.zeros((0, 2), dtype=np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["src", "dst"])

        for batch in batches:
            sig = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)], axis=1)
            fps = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sig, fps = np.concatenate([held_sig, sig]), np.concatenate([held, fps])
            if len(fps) == 0:
                continue
            cut = int(np.flatnonzero(np.any(sig != sig[-1], axis=1)).max(initial=-1)) + 1
            if cut:
                yield flush(sig[:cut], fps[:cut])
            held_sig, held = sig[cut:], fps[cut:]
        if len(held):
            yield flush(held_sig, held)

    return run


def hamming_links(fps: DataFrame, distance: int) -> DataFrame:
    """``(src, dst)``: links that connect exactly the distinct fingerprints ``fp`` that
    chains of pairs within ``distance`` bits connect.

    A signature shared by more than ``HOT_SIGNATURE`` fingerprints is split by a second
    pigeonhole over the bits outside it, so that no task gets the whole group.
    """
    spark = fps.sparkSession
    n, both = bit_moments(fps)
    if n < 2:
        return spark.createDataFrame([], "src long, dst long")
    masks = signature_masks(allocate(n, both, distance))
    signatures = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("v")) for i, x in enumerate(masks)])).alias("s")).select("s.m", "s.v", "fp")
    sizes = signatures.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = signatures.join(sizes, ["m", "v"])
    # the second level: the other bits of a hot signature, cut into distance + 1 parts
    finer = []
    for i, x in enumerate(masks):
        rest = [b for b in range(BITS) if not x >> (BITS - 1 - b) & 1]
        for k in range(distance + 1):
            mask = sum(1 << (BITS - 1 - b) for b in rest[k :: distance + 1])
            finer.append((i, k, mask))
    per = distance + 1
    table = F.array(*[F.lit(_signed(m)) for _, _, m in finer])
    plain = F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")))
    split = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: F.struct((F.lit(len(masks)) + F.col("m") * per + k).cast("long").alias("a"), F.xxhash64("v", F.col("fp").bitwiseAND(F.element_at(table, (F.col("m") * per + k + 1).cast("int")))).alias("b")))
    keyed = shared.select("fp", F.explode(F.when(F.col("n") <= HOT_SIGNATURE, plain).otherwise(split)).alias("k")).select("k.a", "k.b", "fp")
    sorted_ = keyed.repartition("a", "b").sortWithinPartitions("a", "b", "fp")
    return sorted_.mapInArrow(_probe(distance), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: ``doc_id, text_hash, fp, component_id``.

    component_id is the smallest doc_id that chains of fingerprints within ``distance``
    bits reach, the document's own included.  Texts without a word (null, empty) have
    fingerprint 0 and link like any other.  Repeated rows keep a row each; a null doc_id
    keeps its row and is never a component_id unless all of the component are null.
    """
    rows, _ = write_table(fingerprints(docs, shingle), "fingerprints")
    return grouped(rows, distance)


def grouped(rows: DataFrame, distance: int) -> DataFrame:
    """The same from ``rows(doc_id, text_hash, fp)``, written beforehand."""
    distinct, _ = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = hamming_links(distinct.select("fp"), distance)
    roots = connected_components(links).withColumnsRenamed({"node": "fp"})
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "text_hash", "fp", "component_id")


def _shingles(text: bytes, shingle: int) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Digests of a text's shingles, the distinct ones as sorted 64-bit hashes, and a key
    that texts of the same shingles share."""
    words = text.lower().split()
    raw = list(_digests(words, shingle)) if words else [np.zeros((0, 8), np.uint8)]
    grams = np.unique(np.concatenate(raw).reshape(-1).view(">u8").astype(np.uint64))
    return raw, grams, xxhash.xxh64_intdigest(grams.tobytes(), 42)


def _longs(values: list) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), _longs(np.concatenate(arrays)))


def sketches(docs: DataFrame, shingle: int, bands: int, per: int) -> DataFrame:
    """``(doc_id, text_hash, fp, key, bands)``: besides the fingerprint a key that texts
    of the same shingles share, and the shingles' MinHash bands."""
    draws = np.random.default_rng(17).integers(0, 1 << 63, (2, bands * per, 1), dtype=np.uint64) | np.uint64(1)

    def sketch(text: bytes) -> tuple[int, int, np.ndarray]:
        raw, grams, key = _shingles(text, shingle)
        low = np.full(bands * per, np.iinfo(np.uint64).max, dtype=np.uint64)
        for s in range(0, len(grams), DRAW_BLOCK):
            np.minimum(low, ((grams[None, s : s + DRAW_BLOCK] * draws[0] + draws[1]) >> np.uint64(20)).min(axis=1), out=low)
        keys = np.arange(bands, dtype=np.uint64)
        for k in range(per):
            keys = keys * np.uint64(_ODD) + low[k::per]
        return _majority(raw) if len(grams) else 0, key, _mix(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 1):
            fps, keys, band = zip(*map(sketch, texts(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _longs(fps), _longs(keys), _lists(band)], ["doc_id", "text_hash", "fp", "key", "bands"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, fp long, key long, bands array<long>")


def shingle_sets(docs: DataFrame, rows: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """``(key, shingles)`` of the ``keys``, from one text of each."""
    id_ = F.coalesce("doc_id", F.lit(0)).alias("k1")
    spot = rows.select("key", id_, "text_hash").join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.struct("k1", "text_hash")).alias("at")).select("at.k1", "at.text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 0):
            _, grams, own = zip(*(_shingles(t, shingle) for t in texts(b.column(0))))
            yield pa.RecordBatch.from_arrays([_longs(own), _lists(grams)], ["key", "shingles"])

    found = sized_join(docs.select(id_, "text_hash", "text"), spot, ["k1", "text_hash"], "left_semi")
    return found.select("text").mapInArrow(run, "key long, shingles array<long>").groupBy("key").agg(F.first("shingles").alias("shingles"))


def similar_links(docs: DataFrame, rows: DataFrame, shingle: int, distance: int, similarity: float) -> DataFrame:
    """``(src, dst)``: links between keys of ``rows``, the ``sketches`` of ``docs``, that
    connect those of a Jaccard similarity of at least ``similarity``.

    Candidates share a band or a class of fingerprints within ``distance`` bits.  Groups
    of the same members are compared once; large ones go by pairs of blocks.
    """
    fps, _ = write_table(rows.select("fp").distinct(), "distinct")
    classes = connected_components(hamming_links(fps, distance)).withColumnsRenamed({"node": "fp"})
    near = rows.select("key", "fp").distinct().join(classes, "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("band"), "key")
    equal = rows.groupBy("key").agg(F.first("bands").alias("bands")).select(F.explode("bands").alias("band"), "key")
    keyed, _ = write_table(near.union(equal).distinct(), "bands")
    sizes = keyed.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("members"), F.min("key").alias("low"), F.max("key").alias("high")).where("n > 1")
    once = sizes.groupBy("n", "members", "low", "high").agg(F.min("band").alias("band")).select("band", "n")
    groups, _ = write_table(keyed.join(once, "band"), "band-groups")
    shingles, _ = write_table(shingle_sets(docs, rows, groups.select("key").distinct(), shingle), "shingles")
    blocks = F.ceil(F.col("n") / GROUP_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j.cast("int")).alias("x"), F.greatest(own, j.cast("int")).alias("y")))
    spread = groups.select("band", "key", F.explode(pairs).alias("p")).select("band", "p.x", "p.y", "key")
    full = spread.join(shingles, "key").select("band", "x", "y", "key", "shingles")
    return full.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "key").mapInArrow(_verify(similarity), "src long, dst long").distinct()


def one_of_each(docs: DataFrame, shingle: int = STAGE_SHINGLE, distance: int = 3, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one kept of each group of near-copies, all columns as they
    are: the one of the smallest doc_id (null last), then of the smallest text hash.
    Rows equal in id and text are one document and one row of them stays.

    Near-copies are chains of texts of a Jaccard similarity of at least ``similarity``
    on their ``shingle``-word shingles (all words, if fewer); texts without a word are
    near-copies of each other."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    rows, _ = write_table(sketches(named, shingle, *tune_bands(similarity)), "sketches")
    roots = connected_components(similar_links(named, rows, shingle, distance, similarity)).withColumnsRenamed({"node": "key"})
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = rows.select("doc_id", "text_hash", "key").join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(first)
    keys = kept.select(F.coalesce("first.doc_id", F.lit(0)).alias("k1"), F.col("first.text_hash").alias("k2"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"))
    once = Window.partitionBy("k1", "k2").orderBy("k1", "k2")
    return held.join(keys.distinct(), ["k1", "k2"], "left_semi").withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
