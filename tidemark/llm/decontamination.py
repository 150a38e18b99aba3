"""Benchmark decontamination by latent semantic retrieval.

Passages of documents (overlapping windows of words) are TF-IDF vectors over the
benchmark's terms; a randomised SVD of the whole passage matrix, computed from two
distributed products with its Gram matrix, gives the latent space.  Passages whose
latent cosine with an item is high are candidates, verified by their longest common
word subsequence with the item and with its answer, which paraphrases keep in part.

Items are taken in blocks of bounded size, each block against every passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, drop_table, sized_join, texts, write_table
from tidemark.llm.toxicity import FOLD

#: Words of a passage and from one passage's start to the next.
WINDOW, STEP = 40, 20
#: Items of one block.
BLOCK_ITEMS = 500
#: Latent dimensions, further ones of the random sketch, and its seed.
RANK, OVERSAMPLE, SEED = 64, 8, 11
#: Terms in more than this share of all passages are left out, as they tell little, but
#: every item keeps this many of its rarest terms.
MAX_SHARE, RAREST = 0.002, 6
#: Latent cosine of a candidate, at least.
CANDIDATE_COSINE = 0.5
#: Shares of an item's words, in order, at which a passage contains it; the lower one
#: holds if the same share ``ANSWER_SHARE`` of the answer is there as well.
COPY_SHARE, PARAPHRASE_SHARE, ANSWER_SHARE = 0.8, 0.6, 0.8
#: Words at an item's end that count as its answer, unless it names one.
ANSWER_WORDS = 8
#: Items of fewer words name nothing in particular and must be there in whole.
SHORT_ITEM = 8
#: Terms whose partial sums travel together.
TERM_BLOCK = 256


def words(text: bytes) -> list[bytes]:
    """Words in lower case, ASCII punctuation as blanks."""
    return text.translate(FOLD).split()


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays, row by row of ``a``."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        hit = np.concatenate([[0], row[:-1] + (b == x)])
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1])


class Items:
    """One block of the benchmark: ids, word numbers, answers and the vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.answers = [], [], []
        self.vocabulary: dict[bytes, int] = {}
        for item, text in rows:
            raw = (text or "").encode()
            found = words(raw)
            if not found:
                continue
            self.ids.append(item)
            number = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], dtype=np.int32)
            self.words.append(number)
            mark = raw.lower().rfind(b"answer:")
            tail = len(words(raw[mark + 7 :])) if mark >= 0 else 0
            self.answers.append(number[-(tail or ANSWER_WORDS) :])


def encode(docs: DataFrame, items: Items) -> DataFrame:
    """``doc_id, ids``: every document as vocabulary numbers, -1 for other words; those
    without any word of the vocabulary are left out, as nothing in them can match."""
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for b in chunks(batches, 1):
            rows = [np.array([number(w, -1) for w in words(t)], dtype=np.int32) for t in texts(b.column(1))]
            own = [i for i, r in enumerate(rows) if len(r) and r.max() >= 0]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array([rows[i] for i in own], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''").mapInArrow(run, "doc_id long, ids array<int>")


def _windows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All word numbers of a batch, and its passages: row, start and end among them."""
    ids = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = np.maximum(1, -(-(size - (WINDOW - STEP)) // STEP))
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[row] + nth * STEP
    return ids, row, start, np.minimum(start + WINDOW, begin[row] + size[row])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about 200,000 words, to bound the dense rows made from them."""
    for b in batches:
        size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) // 200_000)) + 1, [b.num_rows]])
        for s, e in zip(cut[:-1], cut[1:]):
            if e > s:
                yield b.slice(s, e - s)


def passage_frequencies(encoded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages each term is, over all documents, and all passages; every
    ``WINDOW / STEP``-th passage counts, so that each word does once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(size, dtype=np.int64), 0
        for b in _pieces(batches):
            ids, row, start, end = _windows(b.column(1))
            first = np.r_[True, row[1:] != row[:-1]]
            nth = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
            start, end = start[nth % (WINDOW // STEP) == 0], end[nth % (WINDOW // STEP) == 0]
            width = end - start
            passage = np.repeat(np.arange(len(start)), width)
            at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(start, width)
            term = ids[at]
            known = term >= 0
            pair = np.unique(passage[known].astype(np.int64) * size + term[known])
            found += np.bincount(pair % size, minlength=size)
            total += len(start)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.concatenate([[total], found]))], ["term", "n"])

    rows = encoded.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r["term"]: r["n"] for r in rows}
    return np.array([by.get(i, 0) for i in range(size)]), by.get(-1, 0)


def term_weights(items: Items, df: np.ndarray, total: int) -> np.ndarray:
    """Inverse passage frequencies of the telling terms, 0 for the others."""
    telling = df <= max(2, MAX_SHARE * total)
    for w in items.words:
        own = np.unique(w)
        own = own[df[own] > 0]
        telling[own[np.argsort(df[own], kind="stable")[:RAREST]]] = True
    return np.where(telling & (df > 0), np.log((total + 1) / (df + 0.5)), 0.0)


def _vectors(ids, start, end, idf, basis):
    """Passages' products with ``basis`` by running sums, their norms, and the terms."""
    weight = np.where(ids >= 0, idf[ids], 0.0).astype(np.float32)
    live = np.flatnonzero(weight > 0)
    rows = basis[ids[live]] * weight[live, None]
    lo, hi = np.searchsorted(live, start), np.searchsorted(live, end)
    square = np.concatenate([[0.0], np.cumsum(weight[live].astype(np.float64) ** 2)])
    product = np.zeros((len(start), basis.shape[1]), dtype=np.float32)
    full = np.flatnonzero(hi > lo)
    if len(full):
        edges = np.stack([lo[full], hi[full]], axis=1).ravel()
        product[full] = np.add.reduceat(np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)]), edges, axis=0)[::2]
    return live, weight, lo, hi, product, np.sqrt(square[hi] - square[lo])


def gram_product(encoded: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A.T @ (A @ basis)`` for the passage matrix ``A`` of unit TF-IDF rows: each task
    sums over its passages, and sums of blocks of terms are added by block."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast((idf, basis.astype(np.float32)))
    size, width = basis.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, base = sent.value
        out, seen = np.zeros((size, width)), False
        for b in _pieces(batches):
            ids, _, start, end = _windows(b.column(1))
            live, weight, lo, hi, product, norm = _vectors(ids, start, end, weights, base)
            used = np.flatnonzero(hi > lo)
            if not len(used):
                continue
            seen = True
            product = product[used] / np.maximum(norm[used, None] ** 2, 1e-12)
            # a passage's row goes to the terms of its positions, which are in WINDOW / STEP passages
            padded = np.zeros((len(start) + 1, width), dtype=np.float32)
            padded[used] = product
            last = np.searchsorted(start, live, side="right") - 1
            rows = np.zeros((len(live), width), dtype=np.float32)
            for back in range(WINDOW // STEP):
                over = np.maximum(last - back, 0)
                inside = (last >= back) & (start[over] <= live) & (live < end[over])
                rows += padded[np.where(inside, over, len(start))]
            rows *= weight[live, None]
            order = np.argsort(ids[live], kind="stable")
            term = ids[live][order]
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            out[term[first]] += np.add.reduceat(rows[order], first, axis=0)
        if seen:
            block = range(0, size, TERM_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(list(block), pa.int64()), pa.array([out[s : s + TERM_BLOCK].astype(np.float32).tobytes() for s in block], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(raw, dtype=np.float32).astype(np.float64)
                held[s] = held[s] + part if s in held else part
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "sums"])

    blocks = -(-size // TERM_BLOCK)
    rows = encoded.mapInArrow(partial, "block long, sums binary").repartition(min(blocks, 200), "block").mapInArrow(add, "block long, sums binary").collect()
    out = np.zeros((size, width))
    for r in rows:
        part = np.frombuffer(r["sums"], dtype=np.float64).reshape(-1, width)
        out[r["block"] : r["block"] + len(part)] = part
    return out


def latent_space(encoded: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the passage matrix: a random
    sketch, one product with the Gram matrix to find its range, one to solve in it."""
    width = min(rank + OVERSAMPLE, int((idf > 0).sum()))
    if width == 0:
        return np.zeros((len(idf), 1))
    sketch = np.random.default_rng(SEED).normal(size=(len(idf), width)) * (idf > 0)[:, None]
    basis, _ = np.linalg.qr(gram_product(encoded, idf, sketch))
    small = basis.T @ gram_product(encoded, idf, basis)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    return basis @ vector[:, np.argsort(-value)[: min(rank, width)]]


def search(encoded: DataFrame, items: Items, idf: np.ndarray, space: np.ndarray, cosine: float = CANDIDATE_COSINE) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share, first_word``: verified
    passages, the best of each document and item."""
    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    latent = unit(np.stack([(space[w] * idf[w][:, None]).sum(axis=0) for w in items.words])).astype(np.float32)
    known = np.array([(idf[w] > 0).any() for w in items.words])
    sent = encoded.sparkSession.sparkContext.broadcast((idf, space.astype(np.float32), latent, known, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, base, target, has, block = sent.value
        member = np.zeros((len(block.ids), len(weights)), dtype=bool)
        for k, w in enumerate(block.words):
            member[k, w] = True
        member &= (weights > 0)[None, :]
        # of an item's telling words, a passage over half of it has this many at least
        need = np.array([PARAPHRASE_SHARE / 2 * (weights[w] > 0).sum() * min(1.0, STEP / len(w)) for w in block.words])
        for b in _pieces(batches):
            docs = b.column(0)
            ids, row, start, end = _windows(b.column(1))
            begin = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            _, _, lo, hi, product, _ = _vectors(ids, start, end, weights, base)
            used = np.flatnonzero(hi > lo)
            best: dict[tuple[int, int], tuple] = {}
            for s in range(0, len(used), 8192):
                own = used[s : s + 8192]
                near = unit(product[own]) @ target.T
                passage, number = np.nonzero((near >= cosine) & has[None, :])
                for p, k in zip(*_overlapping(ids, weights, start[own], end[own], passage, number, member, need)):
                    item, answer = block.words[k], block.answers[k]
                    r, at = row[own[p]], start[own[p]]
                    left = max(begin[r], at - len(item))
                    text = ids[left : min(begin[r + 1], end[own[p]] + len(item))]
                    if np.isin(item, text).mean() < PARAPHRASE_SHARE:
                        continue
                    share, tail = _best_share(text, item, answer)
                    if share < (1.0 if len(item) < SHORT_ITEM else COPY_SHARE) and not (len(item) >= SHORT_ITEM and share >= PARAPHRASE_SHARE and tail >= ANSWER_SHARE):
                        continue
                    key = (int(r), int(k))
                    if key not in best or best[key][1] < share:
                        best[key] = (float(near[p, k]), share, tail, int(left - begin[r]))
            if best:
                yield pa.RecordBatch.from_arrays([docs.take(pa.array([r for r, _ in best], pa.int64())), pa.array([block.ids[k] for _, k in best], pa.int64()), *[pa.array([v[i] for v in best.values()], pa.float64()) for i in range(3)], pa.array([v[3] for v in best.values()], pa.int64())], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])

    return encoded.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long")


def _overlapping(ids, weights, start, end, passage, number, member, need):
    """The candidate pairs whose passage has enough of the item's telling words."""
    keep = [np.zeros(0, dtype=np.int64)]
    for s in range(0, len(passage), 50_000):
        p, k = passage[s : s + 50_000], number[s : s + 50_000]
        at = start[p][:, None] + np.arange(WINDOW)[None, :]
        inside = at < end[p][:, None]
        term = ids[np.where(inside, at, start[p][:, None])]
        hits = (member[k[:, None], np.maximum(term, 0)] & (term >= 0) & inside).sum(axis=1)
        keep.append(s + np.flatnonzero(hits >= np.maximum(need[k], 1)))
    own = np.concatenate(keep)
    return passage[own], number[own]


def _best_share(text: np.ndarray, item: np.ndarray, answer: np.ndarray) -> tuple[float, float]:
    """Largest share of the item that a stretch of 1.5 times its length has in order,
    and the share of the answer there."""
    span = max(len(item) + len(item) // 2, 4)
    best = (0.0, 0.0)
    for s in range(0, max(1, len(text) - span + 1 + span // 4), max(1, span // 4)):
        part = text[s : s + span]
        if np.isin(item, part).mean() <= best[0]:
            continue
        share = common_subsequence(part, item) / len(item)
        if share > best[0]:
            best = (share, common_subsequence(part, answer) / len(answer))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = CANDIDATE_COSINE) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share, first_word`` of every document
    and benchmark item it contains.

    Items without a word match nothing, and items of one text are reported each.  Null
    and empty documents contain nothing.  Rows of one doc_id are searched each, and
    reported once for each item with the best passage.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    blocks = -(-rows.count() // BLOCK_ITEMS)
    found = None
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else rows
        items = Items([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").toLocalIterator()])
        if not items.ids:
            continue
        encoded, path = write_table(encode(docs, items), "encoded")
        df, total = passage_frequencies(encoded, len(items.vocabulary))
        idf = term_weights(items, df, total)
        hits, _ = write_table(search(encoded, items, idf, latent_space(encoded, idf, rank), cosine), "contaminated")
        drop_table(spark, path)
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long")
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("lcs_share"), F.desc("cosine"), "first_word")
    return found.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with all their columns.  A row of null doc_id
    goes if any row of null doc_id contains one."""
    hit = contaminated(docs, benchmark).select(F.coalesce("doc_id", F.lit(-1)).alias("__hit")).distinct()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__hit"))
    return sized_join(marked, hit, "__hit", "left_anti").select("row.*")


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Items of the whole benchmark found in the whole ``documents`` table."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
