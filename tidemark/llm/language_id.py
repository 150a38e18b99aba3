"""Language identification by error-correcting output codes.

Each language has a codeword; binary logistic classifiers over hashed character n-grams
predict its bits, and loss-weighted decoding picks the language whose codeword costs
least, each bit weighted by how well its classifier does on that language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, drop_table, sized_join, write_table
from tidemark.llm.toxicity import held_out

#: Training documents of each language, those of least hash, and of all languages: with
#: more languages each has fewer, at least one.
SAMPLE_PER_LANGUAGE, SAMPLE = 600, 12_000
#: Characters of a text that are folded and counted at a time.
BLOCK = 1 << 16
#: Hashed n-gram features, bits of the code at least, steps of the fit.
FEATURES, MIN_BITS, STEPS = 4096, 15, 150
#: A decision whose runner-up has more than this share of its score is ambiguous.
AMBIGUOUS = 0.6
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode letter category (Lu, Ll, Lt, Lm, Lo)."""
    return any(map(str.isalpha, text))


def folded(text: str) -> Iterator[str]:
    """The text in lower case between blanks, white space of any kind and length as one
    blank, a bounded part of it at a time."""
    begun = blank = False
    yield " "
    for s in range(0, len(text), BLOCK):
        part = text[s : s + BLOCK].lower()
        core = " ".join(part.split())
        lead = " " if begun and core and (blank or part[0].isspace()) else ""
        blank, begun = part[-1].isspace() if core else True, begun or bool(core)
        yield lead + core
    yield " "


def _counts(parts: list[str], owner: np.ndarray, before: np.ndarray, rows: int) -> np.ndarray:
    """Counts by row of the hashed 1- to 3-grams that end in the ``parts``, of which the
    first ``before`` characters are of the part before."""
    sizes = np.array([len(t) for t in parts])
    x = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    part = np.repeat(np.arange(len(parts), dtype=np.int64), sizes)
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros(rows * FEATURES)
    h = x * np.uint32(2654435761)
    for n in (1, 2, 3):
        if n > 1:
            h = h[:-1] * np.uint32(40503) ^ (x[n - 1 :] * np.uint32(2246822519) + np.uint32(n))
        own = part[n - 1 :]
        same = (part[: len(h)] == own) & (place[n - 1 :] >= before[own])
        bucket = ((h ^ h >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
        out += np.bincount((owner[own] * FEATURES + bucket)[same], minlength=len(out))
    return out.reshape(rows, FEATURES)


def ngram_features(group: list[str]) -> np.ndarray:
    """Rows of square-rooted shares of hashed character 1- to 3-grams of the ``folded``
    texts, of unit length."""
    short = [i for i, t in enumerate(group) if len(t) <= BLOCK]
    out = np.zeros((len(group), FEATURES), dtype=np.float32)
    if short:
        out[short] = _counts(["".join(folded(group[i])) for i in short], np.arange(len(short)), np.zeros(len(short), np.int64), len(short))
    for i in set(range(len(group))) - set(short):
        total, tail = np.zeros((1, FEATURES)), ""
        for part in folded(group[i]):
            if part:
                total += _counts([tail + part], np.zeros(1, np.int64), np.array([len(tail)]), 1)
                tail = (tail + part)[-2:]
        out[i] = total[0]
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """``languages x bits`` of +-1: of many random codes without constant bits (fewer for
    many languages, as the work grows with their square), the one whose closest codewords
    are furthest apart."""
    bits = max(MIN_BITS, int(np.ceil(10 * np.log2(max(languages, 2)))))
    rng = np.random.default_rng(seed)
    best, most = None, (-1.0, -1.0)
    for _ in range(max(1, min(200, 8_000_000 // languages**2))):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (languages, bits)).astype(np.float32)
        for b in np.flatnonzero(np.abs(code.sum(axis=0)) == languages):
            code[rng.integers(languages), b] *= -1
        if best is None and languages > 2000:
            return code
        apart = (bits - code @ code.T) / 2
        np.fill_diagonal(apart, bits)
        if (apart.min(), apart.mean()) > most:
            best, most = code, (apart.min(), apart.mean())
    return best


class CodeClassifier:
    """Languages, their codewords, the bits' weights by language, and the classifiers."""

    def __init__(self, languages: list[str], code: np.ndarray, trust: np.ndarray, w: np.ndarray, bias: np.ndarray):
        self.languages, self.code, self.trust, self.w, self.bias = languages, code, trust, w, bias

    def predict(self, group: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores in 0..1 and whether each decision is ambiguous."""
        margins = ngram_features(group) @ self.w + self.bias
        on, off = (self.trust * (self.code > 0)).T, (self.trust * (self.code < 0)).T
        cost = np.logaddexp(0, -margins) @ on + np.logaddexp(0, margins) @ off
        share = np.exp(-(cost - cost.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        score = share[np.arange(len(group)), best]
        second = np.partition(share, -2, axis=1)[:, -2] if len(self.languages) > 1 else np.zeros(len(group))
        return [self.languages[i] for i in best], score, second > AMBIGUOUS * score


def fit(rows: Iterable[tuple[str, np.ndarray]]) -> CodeClassifier | None:
    """Fit to ``(language, features)`` rows; None without any.  Every bit's classifier takes
    full gradient steps (Nesterov) with rows weighted to balance the languages."""
    rows = list(rows)
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    y = np.array([number[lang] for lang, _ in rows])
    x = np.stack([f for _, f in rows])
    if len(languages) == 1:
        return CodeClassifier(languages, np.ones((1, 1)), np.ones((1, 1)), np.zeros((FEATURES, 1), np.float32), np.ones(1))
    code = codewords(len(languages))
    target = code[y].astype(np.float32)
    weight = (1.0 / (np.bincount(y)[y] * len(languages))).astype(np.float32)[:, None]
    w, bias = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    pw, pb, t, rate, decay = w, bias, 1.0, 8.0, 1e-5
    for _ in range(STEPS):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yb = w + np.float32((t - 1) / t2) * (w - pw), bias + np.float32((t - 1) / t2) * (bias - pb)
        pw, pb, t = w, bias, t2
        g = -target * weight / (1 + np.exp(np.clip(target * (x @ yw + yb), -30, 30)))
        w, bias = yw - rate * (x.T @ g + decay * yw), yb - rate * g.sum(axis=0)
    right = (x @ w + bias) * target > 0
    trust = np.stack([right[y == k].mean(axis=0) for k in range(len(languages))])
    return CodeClassifier(languages, code, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9) * code.shape[1], w, bias)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, sample: int = SAMPLE) -> CodeClassifier | None:
    """Model from at most ``per_language`` documents of each language, at most ``sample``
    in all (one of each if there are more languages), held-out documents never among them.
    Every language with text is learned.  Workers count the n-grams; a document reaches
    the driver as at most ``FEATURES`` numbers."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2) & (F.length("text") > 0))
    hashed = known.select("lang", F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t")).alias("key"))
    share = hashed.groupBy("lang").agg(F.count("*").alias("n"))
    share, path = write_table(share, "languages")
    each = max(1, min(per_language, sample // max(1, share.count())))
    # about twice as many as needed by hash, then the least keys; all of a small language
    few = F.col("n") <= 4 * each
    picked = sized_join(hashed, share, "lang").where(few | (F.col("key.h") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * F.lit(2.0 * each + 20) / F.col("n")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    least = picked.distinct().withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "key.doc_id", F.col("key.t").alias("t"))
    rows = sized_join(known.withColumn("t", F.xxhash64("text")), write_table(least, "language-sample")[0], ["lang", "doc_id", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 3):
            x = ngram_features(b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "doc_id", "t", "x"])

    found = rows.select("lang", "doc_id", "t", "text").mapInArrow(run, "lang string, doc_id long, t long, x binary").groupBy("lang", "doc_id", "t").agg(F.first("x").alias("x"))
    held = sorted(((r["lang"], r["doc_id"], r["t"], bytes(r["x"])) for r in found.toLocalIterator()), key=lambda r: r[:3])
    drop_table(docs.sparkSession, path)
    return fit((lang, np.frombuffer(x, dtype=np.float32)) for lang, _, _, x in held)


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, ambiguous``.

    Null texts and those without a letter are ``und`` with score 0, as is every text if
    there is nothing to learn from; a null doc_id is not held out and not learned from;
    repeated rows get the same answer.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in chunks(batches, 1):
            group = b.column(1).to_pylist()
            known = [i for i, t in enumerate(group) if t and model is not None and has_letter(t)]
            lang, score, unsure = [UNDETERMINED] * len(group), np.zeros(len(group)), np.zeros(len(group), dtype=bool)
            for s in range(0, len(known), 256):
                own = known[s : s + 256]
                found, p, doubt = model.predict([group[i] for i in own])
                score[own], unsure[own] = p, doubt
                for i, name in zip(own, found):
                    lang[i] = name
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of the whole ``documents`` table."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
