"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms; its score is ``sigmoid(b + sum w_i + sum <v_i,
v_j>)`` over the terms of the model and their pairs, so that two terms together can
weigh more than each alone.  Training takes a bounded sample of labelled rows; every
whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, drop_table, texts, write_table

#: Training rows of each label, those of least hash; bounds the driver's work.
SAMPLE_PER_LABEL = 6_000
#: Hash space of terms, and documents of the sample that a model term is in at least.
TERM_BITS, MIN_DOCUMENTS = 40, 4
#: Least chi-squared of a model term against the label, and most terms of a model.
MIN_CHI, MAX_TERMS = 6.0, 20_000
#: Most frequent terms whose pairs are tested for an effect beyond those of their terms,
#: and least chi-squared of a pair whose terms the model takes for it.
PAIR_TERMS, MIN_PAIR_CHI = 512, 30.0
#: Lengths in bytes of the beginnings of words that are terms.
STEM_BYTES = (4, 5, 6, 7, 8)
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 12, 256, 0.1, 1e-3
#: ASCII letters in lower case, other ASCII but digits to blanks, the rest as it is.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words(text: bytes) -> set[bytes]:
    return set(text.translate(FOLD).split())


def hashed(word: bytes) -> list[int]:
    """Hashed terms of a word: the word and its beginnings, which inflected forms share."""
    mask = (1 << TERM_BITS) - 1
    stems = [xxhash.xxh64_intdigest(word[:k], k) & mask for k in STEM_BYTES if k <= len(word)]
    return [xxhash.xxh64_intdigest(word, 99) & mask, *stems]


def term_ids(text: bytes) -> np.ndarray:
    """Sorted distinct hashed terms of a text."""
    return np.unique(np.array([h for w in words(text) for h in hashed(w)], dtype=np.int64))


def held_out(doc_id, modulus: int, remainder: int):
    """Whether CRC-32 of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


class FactorizationMachine:
    """Sorted hashed terms with a weight and a factor vector each, and a bias."""

    def __init__(self, ids: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float):
        self.ids, self.w, self.v, self.bias = ids, w, v, bias
        self.square = (v * v).sum(axis=1)
        self.at: dict[int, int] = {int(x): i for i, x in enumerate(ids)}
        self.cache: dict[bytes, list[int]] = {}

    def __reduce__(self):
        return FactorizationMachine, (self.ids, self.w, self.v, self.bias)

    def indices(self, word: bytes) -> list[int]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            found = self.cache[word] = [self.at[h] for h in hashed(word) if h in self.at]
        return found

    def score(self, text: bytes) -> float:
        own = list({i for w in words(text) for i in self.indices(w)})
        z = self.bias
        if own:
            s = self.v[own].sum(axis=0)
            z += self.w[own].sum() + 0.5 * (s @ s - self.square[own].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def telling_pairs(terms: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which of the terms (columns of the 0/1 matrix ``terms``) make a telling pair.

    A pair tells if the documents with both are toxic more or less often than the shares
    of either term predict by adding up on the logit scale."""
    x = terms.astype(np.float32)
    y = labels.astype(np.float32)[:, None]
    both, toxic = (x.T @ x).astype(float), (x.T @ (x * y)).astype(float)
    n, pos = np.diag(both), np.diag(toxic)
    logit = lambda a, k: np.log((a + 0.5) / (k - a + 0.5))
    alone = logit(pos, n)
    p = 1 / (1 + np.exp(-np.clip(alone[:, None] + alone[None, :] - logit(y.sum(), len(y)), -12, 12)))
    chi = (toxic - both * p) ** 2 / np.maximum(both * p * (1 - p), 0.5)
    # a pair of terms that always come together has no effect of its own
    apart = both < 0.9 * np.minimum(n[:, None], n[None, :])
    return ((chi >= MIN_PAIR_CHI) & (both >= MIN_DOCUMENTS) & apart).any(axis=1)


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> FactorizationMachine:
    """Fit to ``(label, distinct hashed terms)`` rows by Adagrad on the logistic loss,
    rows of the rarer label weighted up to balance.  The terms are those that tell of the
    label alone or in a pair."""
    labels = np.array([y for y, _ in rows], dtype=float)
    if not len(rows) or labels.min() == labels.max():
        rate = labels.mean() if len(rows) else 0.0
        p = float(np.clip(rate, 0.01, 0.99))
        return FactorizationMachine(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, FACTORS)), float(np.log(p / (1 - p))))
    flat = np.concatenate([t for _, t in rows])
    owner = np.repeat(np.arange(len(rows)), [len(t) for _, t in rows])
    ids, where = np.unique(flat, return_inverse=True)
    n = np.bincount(where, minlength=len(ids))
    pos = np.bincount(where, weights=labels[owner], minlength=len(ids))
    share = labels.mean()
    chi = (pos - n * share) ** 2 / (n * share * (1 - share))
    chosen = np.flatnonzero((n >= MIN_DOCUMENTS) & (chi >= MIN_CHI))
    chosen = chosen[np.argsort(-chi[chosen], kind="stable")[:MAX_TERMS]]
    often = np.argsort(-n, kind="stable")[:PAIR_TERMS]
    column = np.full(len(ids), -1)
    column[often] = np.arange(len(often))
    seen = np.zeros((len(rows), len(often)), dtype=bool)
    own = column[where] >= 0
    seen[owner[own], column[where][own]] = True
    chosen = np.union1d(chosen, often[telling_pairs(seen, labels)])
    to = np.full(len(ids), -1)
    to[chosen] = np.arange(len(chosen))
    kept = to[where] >= 0
    col, row = to[where][kept], owner[kept]
    start = np.searchsorted(row, np.arange(len(rows) + 1))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS)), 0.0
    gw, gv, gb = np.full(len(chosen), 1e-6), np.full((len(chosen), FACTORS), 1e-6), 1e-6
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(rows), BATCH):
            batch = order[s : s + BATCH]
            sizes = start[batch + 1] - start[batch]
            at = np.repeat(start[batch] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            c, r = col[at], np.repeat(np.arange(len(batch)), sizes)
            vc = v[c]
            sums = np.stack([np.bincount(r, weights=vc[:, k], minlength=len(batch)) for k in range(FACTORS)], axis=1)
            z = bias + np.bincount(r, weights=w[c] - 0.5 * (vc * vc).sum(axis=1), minlength=len(batch)) + 0.5 * (sums * sums).sum(axis=1)
            g = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[batch]) / len(batch)
            u, inv = np.unique(c, return_inverse=True)
            dw = np.bincount(inv, weights=g[r], minlength=len(u)) + DECAY * w[u]
            dv = np.stack([np.bincount(inv, weights=g[r] * (sums[r, k] - vc[:, k]), minlength=len(u)) for k in range(FACTORS)], axis=1) + DECAY * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            gb += g.sum() ** 2
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= RATE * 0.2 * dv / np.sqrt(gv[u])
            bias -= RATE * g.sum() / np.sqrt(gb)
    return FactorizationMachine(ids[chosen], w, v, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """``(toxic, text)`` of at most ``per_label`` different rows of each label, never held
    out; an id labelled both ways is toxic.  Rows of equal id and text count once."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    least = lambda rows, by: rows.where("toxic = 1").orderBy(*by).limit(per_label).union(rows.where("toxic = 0").orderBy(*by).limit(per_label))
    sample, _ = write_table(least(known, order), "labelled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(sample), "doc_id").withColumn("t", F.xxhash64("text"))
    # an id may have many rows: the bound holds for rows, too
    keys, _ = write_table(least(found.select("toxic", "doc_id", "t").distinct(), [F.xxhash64("doc_id", "t"), F.col("doc_id"), F.col("t")]), "training-keys")
    return found.join(F.broadcast(keys), ["toxic", "doc_id", "t"]).dropDuplicates(["toxic", "doc_id", "t"]).select("toxic", "text")


def telling_terms(sample: DataFrame) -> list[int]:
    """At most ``MAX_TERMS`` hashed terms of the sample by chi-squared against the label and
    the ``PAIR_TERMS`` most frequent ones, which ``fit`` tests in pairs; counted by Spark:
    rare terms, which are most of them, do not reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 1):
            label = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = [term_ids(x) for x in texts(b.column(1))]
            term, at, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            pos = np.bincount(at, weights=np.repeat(label, [len(t) for t in found]), minlength=len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64)), pa.array(pos)], ["term", "n", "pos"])

    rows, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not rows or not 0 < toxic < rows:
        return []
    share = toxic / rows
    counts, path = write_table(sample.mapInArrow(run, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= MIN_DOCUMENTS), "term-counts")
    gap = F.col("pos") - F.col("n") * share
    chi = gap * gap / (F.col("n") * (share * (1 - share)))
    best = counts.withColumn("chi", chi).where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "term").limit(MAX_TERMS)
    often = counts.orderBy(F.desc("n"), "term").limit(PAIR_TERMS)
    out = {r["term"] for r in best.select("term").union(often.select("term")).collect()}
    drop_table(sample.sparkSession, path)
    return sorted(out)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> FactorizationMachine:
    """Model from the bounded sample; only the telling terms of its rows are collected."""
    sample, path = write_table(training_rows(docs, labels, per_label), "training")
    known = np.sort(np.array(telling_terms(sample), dtype=np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 1):
            found = [np.intersect1d(term_ids(x), sent.value, assume_unique=True) for x in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())], ["toxic", "terms"])

    rows = sample.mapInArrow(run, "toxic long, terms binary").collect()
    drop_table(docs.sparkSession, path)
    return fit(sorted(((r["toxic"], np.frombuffer(r["terms"], dtype=np.int64)) for r in rows), key=lambda x: (x[0], len(x[1]), x[1].tobytes())))


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and empty texts have no terms and score the bias; a null doc_id is not held
    out; repeated rows score alike.  Without labels of both kinds every score is the
    share of toxic ones (0.01 without any).
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in chunks(batches, 1):
            score = np.array([model.score(t) for t in texts(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of the whole ``documents`` table."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
