"""Reversible incremental line deduplication.

An exact reference-count table holds, for every line key, the number of documents that
contain it; inserting documents adds to the counts and deleting them subtracts, so any
state can be undone.  Sharded cuckoo filters hold the keys whose count has reached the
limit and answer lookups inside the scan of the documents; the keys of the table that
a filter takes wrongly are listed exactly beside it, and so are those of other lines that
are looked up, so answers are exact.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, texts, write_table

#: A line key found in this many documents loses its lines.
MIN_DOCUMENTS = 10
#: Slots of a cuckoo bucket, and tries before a filter is rebuilt at twice the size.
SLOTS, MAX_KICKS = 4, 500
#: Most keys of one shard on average, and most bytes of filters that are broadcast;
#: beyond that, lines are looked up by a join.
SHARD_KEYS, BROADCAST_BYTES = 50_000, 128 << 20
#: What is stripped from the ends of a line.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes) -> bytes:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case."""
    return line.strip().lower()


def key_digest(key: bytes) -> bytes:
    """128-bit identity of a key."""
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Partial-key cuckoo filter over 16-byte digests: insert, delete, contains.

    Buckets of four 16-bit tags; a key's second bucket is the first one xor a hash of
    its tag, so tags can move and be removed without the key.
    """

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, SLOTS), dtype=np.uint16)

    @staticmethod
    def _split(digests: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = digests.view("<u8").reshape(-1, 2)
        tag = (words[:, 1] & 0xFFFF).astype(np.uint16)
        tag[tag == 0] = 1
        first = (words[:, 0] & np.uint64(buckets - 1)).astype(np.int64)
        return tag, first, first ^ CuckooFilter._jump(tag, buckets)

    @staticmethod
    def _jump(tag: np.ndarray, buckets: int) -> np.ndarray:
        return ((tag.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(buckets - 1)).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        tag, a, b = self._split(digests, self.buckets)
        return ((self.table[a] == tag[:, None]) | (self.table[b] == tag[:, None])).any(axis=1)

    def insert(self, digest: bytes) -> bool:
        """Place one digest; False if the filter is too full."""
        tag, a, b = (x[0] for x in self._split(np.frombuffer(digest, dtype=np.uint8).reshape(1, 16).copy(), self.buckets))
        at = int(a)
        for k in range(MAX_KICKS):
            for place in (at, int(b)) if k == 0 else (at,):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = tag
                    return True
            slot = (k * 7 + at) % SLOTS
            tag, self.table[at, slot] = self.table[at, slot], tag
            at ^= int(self._jump(np.array([tag], dtype=np.uint16), self.buckets)[0])
        return False

    def delete(self, digest: bytes) -> bool:
        """Remove one copy of a digest that was inserted."""
        tag, a, b = (x[0] for x in self._split(np.frombuffer(digest, dtype=np.uint8).reshape(1, 16).copy(), self.buckets))
        for place in (int(a), int(b)):
            held = np.flatnonzero(self.table[place] == tag)
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        capacity = max(len(digests), 4)
        while True:
            out = cls(capacity)
            if all(out.insert(d) for d in digests):
                return out
            capacity *= 2


def shard_of(digest, shards: int):
    """Shard of a digest: its last four bytes, so that buckets and tags stay free."""
    return np.frombuffer(digest, dtype=np.uint8).reshape(-1, 16)[:, 12:].copy().view("<u4").ravel() % shards


def count_keys(docs: DataFrame, sign: int = 1) -> DataFrame:
    """``(key, refs)``: how many of the documents contain each line key, times ``sign``.

    Every row is one document; empty keys are not counted.  Counts are combined within
    a slice of documents, then map-side, then by key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 0):
            found: Counter[bytes] = Counter()
            for text in texts(b.column(0)):
                found.update(set(map(bytes.strip, text.lower().split(b"\n"))))
            found.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array([key_digest(k) for k in found], pa.binary()), pa.array(found.values(), pa.int64())], ["key", "refs"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key binary, refs long")
    return found.groupBy("key").agg((F.sum("refs") * sign).alias("refs"))


class LineIndex:
    """Exact reference counts of line keys, with filters over those at the limit.

    ``insert`` and ``delete`` return a new index; deleting the documents of an insert
    gives back the counts before it.  Deleting documents that were never inserted
    leaves negative counts, which are kept so that a later insert restores balance.
    """

    def __init__(self, refs: DataFrame, min_documents: int = MIN_DOCUMENTS):
        self.refs, self.min_documents = refs, min_documents

    @classmethod
    def build(cls, docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> LineIndex:
        return cls(write_table(count_keys(docs), "line-refs")[0], min_documents)

    def _merged(self, change: DataFrame) -> LineIndex:
        both = self.refs.union(change).groupBy("key").agg(F.sum("refs").alias("refs")).where("refs <> 0")
        return LineIndex(write_table(both, "line-refs")[0], self.min_documents)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._merged(count_keys(docs))

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._merged(count_keys(docs, -1))

    def frequent(self) -> DataFrame:
        return self.refs.where(F.col("refs") >= self.min_documents).select("key")

    def filters(self, docs: DataFrame | None = None) -> tuple[list[CuckooFilter], set[bytes]] | None:
        """Filters by shard and the keys they take wrongly, of the table and of ``docs``
        with lines that the table does not have; None if they are too large to broadcast,
        which the exact count of frequent keys decides."""
        total = self.frequent().count()
        # 2.4 bytes a key at 85 % load, at most doubled by rounding up to a power of 2
        if total * 6 > BROADCAST_BYTES:
            return None
        shards = max(1, -(-total // SHARD_KEYS))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            for b in batches:
                for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    held.setdefault(s, []).append(k)
            made = {s: CuckooFilter.of(sorted(k)) for s, k in held.items()}
            yield pa.RecordBatch.from_arrays([pa.array(made.keys(), pa.int64()), pa.array([f.table.tobytes() for f in made.values()], pa.binary())], ["shard", "table"])

        # the shard is read from bytes 12 to 15, little-endian, as in shard_of
        byte = [F.conv(F.hex(F.substring("key", 16 - k, 1)), 16, 10).cast("long") for k in range(4)]
        shard = (byte[0] * (1 << 24) + byte[1] * (1 << 16) + byte[2] * (1 << 8) + byte[3]) % shards
        keyed = self.frequent().select(shard.alias("shard"), "key").repartition(min(shards, 1000), "shard")
        rows = keyed.mapInArrow(build, "shard long, table binary").collect()
        out = [CuckooFilter(1) for _ in range(shards)]
        for r in rows:
            out[r["shard"]].table = np.frombuffer(r["table"], dtype=np.uint16).reshape(-1, SLOTS).copy()
            out[r["shard"]].buckets = len(out[r["shard"]].table)
        sent = self.refs.sparkSession.sparkContext.broadcast(out)
        limit = self.min_documents

        def wrongly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(0).to_pylist()
                taken = probe(sent.value, keys) & (b.column(1).to_numpy(zero_copy_only=False) < limit)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(taken))], ["key"])

        # about 8 * 2^-16 of the keys asked for; bounded like the filters
        asked = self.refs.select("key", "refs")
        if docs is not None:
            asked = asked.union(count_keys(docs).join(self.refs.select("key"), "key", "left_anti").select("key", F.lit(0).cast("long").alias("refs")))
        wrong = asked.mapInArrow(wrongly, "key binary").limit(BROADCAST_BYTES // 64 + 1).collect()
        if len(wrong) > BROADCAST_BYTES // 64:
            return None
        return out, {bytes(r["key"]) for r in wrong}


def probe(filters: list[CuckooFilter], digests: list[bytes]) -> np.ndarray:
    """Which digests the filters of their shards take."""
    out = np.zeros(len(digests), dtype=bool)
    if not digests:
        return out
    raw = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 16)
    shard = shard_of(raw.tobytes(), len(filters))
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        out[at] = filters[s].contains(np.ascontiguousarray(raw[at]))
    return out


def _rewrite(columns: list[str], text_at: int, frequent_of) -> object:
    """Arrow function that drops frequent lines: passes ``columns`` through and adds
    n_lines, n_dropped and the text kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text_at):
            lines = [t.split(b"\n") for t in texts(b.column(text_at))]
            keys = [[line_key(x) for x in doc] for doc in lines]
            gone = frequent_of(list({k for doc in keys for k in doc if k}))
            kept = [[x for x, k in zip(doc, ks) if k not in gone] for doc, ks in zip(lines, keys)]
            n = [len(doc) for doc in lines]
            new = [b"\n".join(doc) for doc in kept]
            arrays = [b.column(i) for i in range(len(columns)) if i != text_at]
            names = [c for i, c in enumerate(columns) if i != text_at]
            extra = [pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept)], pa.int64()), pa.array(new, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *extra], [*names, "n_lines", "n_dropped", "kept"])

    return run


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: each document without its frequent lines.

    A text is split at ``\\n``; null or empty text is one empty line, which is never
    frequent.  Kept lines stay as they are, joined by ``\\n``.  Every row is a document
    of its own, so repeated rows count each.  ``index`` is the documents' own unless given;
    a given one is exact for lines that it never saw, too.
    """
    given = index is not None
    index = index or LineIndex.build(docs, min_documents)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = index.filters(docs if given else None)
    schema = "doc_id long, n_lines long, n_dropped long, kept string"
    if made is not None:
        sent = docs.sparkSession.sparkContext.broadcast(made)

        def frequent_of(keys: list[bytes]) -> set[bytes]:
            filters, wrong = sent.value
            digests = [key_digest(k) for k in keys]
            hit = probe(filters, digests)
            return {k for k, d, h in zip(keys, digests, hit) if h and d not in wrong}

        return source.mapInArrow(_rewrite(["doc_id", "text"], 1, frequent_of), schema)
    # More frequent keys than may be broadcast: look the lines up by a join on the key.
    rows = source.withColumn("row", F.monotonically_increasing_id())
    rows, _ = write_table(rows, "line-rows")
    stripped = F.btrim(F.col("line"), F.lit(BLANKS))
    lower = F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = rows.select("row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line")).withColumn("key_text", lower)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([key_digest(k) for k in texts(b.column(3))], pa.binary())], ["row", "at", "line", "key_text", "key"])

    keyed = lines.select("row", "at", "line", "key_text").mapInArrow(digest, "row long, at int, line string, key_text string, key binary")
    marked = keyed.join(index.frequent().withColumn("hit", F.lit(True)), "key", "left").withColumn("gone", F.coalesce("hit", F.lit(False)) & (F.col("key_text") != ""))
    per = marked.groupBy("row").agg(F.count("*").alias("n_lines"), F.count_if("gone").alias("n_dropped"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("at", "line")))), lambda x: x["line"]), "\n").alias("kept"))
    return rows.join(per, "row").select("doc_id", "n_lines", "n_dropped", "kept")


def deduplicated_documents(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with their frequent lines dropped from ``text``; the other columns
    stay, but ``n_chars``, if there, becomes the length of the new text.  A null text
    becomes empty."""
    index = LineIndex.build(docs, min_documents)
    frequent = index.filters()
    if frequent is None:  # the join path, on numbered rows
        rows, _ = write_table(docs.withColumn("__row", F.monotonically_increasing_id()), "line-documents")
        kept = dedup_lines(rows.select(F.col("__row").alias("doc_id"), "text"), index).select(F.col("doc_id").alias("__row"), "kept")
        value = {"text": F.col("kept"), "n_chars": F.length("kept")}
        both = rows.join(kept, "__row")
        return both.select(*[value[c].cast(docs.schema[c].dataType).alias(c) if c in value else F.col(f"`{c}`") for c in docs.columns])
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def frequent_of(keys: list[bytes]) -> set[bytes]:
        filters, wrong = sent.value
        digests = [key_digest(k) for k in keys]
        hit = probe(filters, digests)
        return {k for k, d, h in zip(keys, digests, hit) if h and d not in wrong}

    other = [f for f in docs.schema.fields if f.name != "text"]
    row = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in other]).alias("row"), F.col("text").cast("string").alias("text"))
    kept = row.mapInArrow(_rewrite(["row", "text"], 1, frequent_of), f"row {row.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")
    value = {f.name: F.col("row")[f.name] for f in other} | {"text": F.col("kept")}
    if "n_chars" in value:
        value["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[value[c].alias(c) for c in docs.columns])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines found in 10 or more of the whole ``documents`` are dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l),
k AS (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.r, k.pos, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN l ON l.r = m.r GROUP BY l.r, l.doc_id
"""
