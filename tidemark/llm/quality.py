"""Quality classifier: 4-gram models with interpolated modified Kneser-Ney smoothing, one
for each language, trained on trusted text.

A symbol is a UTF-16 code unit, so no alphabet is chosen, no two characters share a symbol
and a 4-gram is one 64-bit number.  Counts, continuation counts and context totals are
Spark aggregates over all trusted text, hash-sharded by model and context; each order is
joined with the next lower one.  The result is two kinds of entries: the probability of
every seen gram, and of every seen context the mass left to grams not seen after it.

Documents are read once.  The entries, or if they are too many the most frequent 4-grams
among them, are sent to the workers; what a worker cannot resolve leaves as counts of grams
for a document, which are joined with the sharded entries and summed back, so a score does
not depend on how much was sent.  A document's perplexity is compared with a quantile of the
trusted documents of its language, each scored for that by models of the other folds.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, drop_rows, drop_table, row_key, sized_join, texts, write_table

ORDER = 4
#: Bits of a symbol, the symbols that the lowest order is spread over, and the pad (a
#: non-character; U+FFFF in a text counts as one).
UNIT, SYMBOLS, PAD = 16, 1 << 16, b"\xff\xff"
#: Entries sent to the workers, 12 bytes each and an index of at most 16.
SENT_ENTRIES = 1_500_000
#: Bytes of text taken from a batch at a time, UTF-16 units (or bytes of a long text) worked
#: on at a time, and grams that a counting task holds.
SLICE_BYTES, BLOCK, HELD_GRAMS = 256 << 10, 1 << 17, 1 << 20
#: Model of documents without a language or whose language has little trusted text.
POOLED = "*"
MIN_TRUSTED = 20
#: A document is kept up to this quantile of its language's trusted perplexities ...
QUANTILE = 0.995
#: ... each under models that have not seen its text: trusted text is cut into so many
#: folds, and a fold is scored by models of the others.
FOLDS = 2
#: Characters at the language's median that every document is padded with in effect, so
#: that the chance of a few odd letters does not reject short documents.
PRIOR_CHARS = 60
#: Parts of a nat that quantiles are counted in, so that they do not depend on the order in
#: which tasks end, as a sketch's would.
GRID = 100_000
#: Steps of that grid that are ordered in one go.
GRID_BLOCK = 1000
#: Id of the pooled model; a language's is a hash of its name.
POOLED_ID = 0
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


# ------------------------------------------------------------------ grams of texts


def unit_blocks(group: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(grams, owners, low, high)`` of UTF-8 texts, a bounded number at a time.

    ``grams[low[i]:high[i]]`` are the 4-grams that end at the symbols, and at the closing
    pad, of text ``owners[i]``; a long text comes in several blocks."""

    def grams(units: np.ndarray) -> np.ndarray:
        g = units.astype(np.uint64)
        g = g[:-1] << np.uint64(UNIT) | g[1:]
        return g[:-2] << np.uint64(2 * UNIT) | g[2:]

    def packed(held: list[bytes], owners: list[int]):
        sizes = np.array([len(x) // 2 for x in held])
        low = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
        return grams(np.frombuffer(PAD * (ORDER - 1) + (PAD * ORDER).join(held) + PAD, dtype="<u2")), np.array(owners), low, low + sizes + 1

    held: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(group):
        if len(text) <= BLOCK:
            held.append(text.decode("utf-8", "replace").encode("utf-16-le"))
            owners.append(i)
            size += len(held[-1]) // 2
            if size >= BLOCK:
                yield packed(held, owners)
                held, owners, size = [], [], 0
            continue
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        tail = PAD * (ORDER - 1)
        for s in range(0, len(text), BLOCK):
            last = s + BLOCK >= len(text)
            raw = tail + decoder.decode(text[s : s + BLOCK], last).encode("utf-16-le") + (PAD if last else b"")
            g = grams(np.frombuffer(raw, dtype="<u2"))
            yield g, np.array([i]), np.array([0]), np.array([len(g)])
            tail = raw[-2 * (ORDER - 1) :]
    if held:
        yield packed(held, owners)


def gram_counts(trusted: DataFrame, folds: int) -> DataFrame:
    """``m, fold, gram, n`` summed by task over ``trusted(m, fold, text)``."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return gram, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (m, fold), parts in held.items():
                for g, n in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), m)), pa.array(np.full(len(g), fold, dtype=np.int32)), pa.array(g.view(np.int64)), pa.array(n)], ["m", "fold", "gram", "n"])
            held.clear()

        for b in chunks(batches, 2, SLICE_BYTES):
            m, fold = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for g, owners, low, high in unit_blocks(texts(b.column(2))):
                for key in set(zip(m[owners].tolist(), fold[owners].tolist())):
                    own = (m[owners] == key[0]) & (fold[owners] == key[1])
                    step = np.zeros(len(g) + 1, dtype=np.int8)
                    step[low[own]] += 1
                    step[high[own]] -= 1
                    gram, n = np.unique(g[np.cumsum(step[:-1]) > 0], return_counts=True)
                    held.setdefault(key, []).append((gram, n))
                    size += len(gram)
                if size > HELD_GRAMS:
                    held.update({k: [merged(v)] for k, v in held.items()})
                    size = sum(len(g) for v in held.values() for g, _ in v)
                    if size > HELD_GRAMS // 2:
                        yield from flush()
                        size = 0
        held.update({k: [merged(v)] for k, v in held.items()})
        yield from flush()

    return trusted.select("m", "fold", "text").mapInArrow(run, "m long, fold int, gram long, n long")


# ------------------------------------------------------------------ smoothing


def model_key(m: Column, variant: Column | int) -> Column:
    """Key of a model's variant: the one without fold ``variant``, or of all text (-1)."""
    return F.xxhash64(m, (F.lit(variant) if isinstance(variant, int) else variant).cast("int"))


def variants(counts: DataFrame, folds: int) -> DataFrame:
    """``mk, gram, n``: the counts of every language's and the pooled model, of all text
    and without each fold, from the counts by fold."""
    by_fold, _ = write_table(counts.groupBy("m", "gram").agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(folds)]), "fold-counts")
    pooled = F.lit(POOLED_ID).cast("long")
    every = by_fold.groupBy("gram").agg(*[F.sum(f"n{f}").alias(f"n{f}") for f in range(folds)]).select(pooled.alias("m"), "gram", *[f"n{f}" for f in range(folds)])
    both = by_fold.where(F.col("m") != pooled).unionByName(every)
    total = sum((F.col(f"n{f}") for f in range(1, folds)), F.col("n0"))
    kinds = [F.struct(model_key(F.col("m"), -1).alias("mk"), total.alias("n"))] + [F.struct(model_key(F.col("m"), f).alias("mk"), (total - F.col(f"n{f}")).alias("n")) for f in range(folds)]
    return both.select("gram", F.explode(F.array(*kinds)).alias("v")).select("v.mk", "gram", "v.n").where("n > 0")


def discount_columns(counts: DataFrame) -> DataFrame:
    """``mk, d1, d2, d3``: modified Kneser-Ney discounts of counts 1, 2 and 3 or more; 0.5,
    1 and 1.5 where the counts of counts cannot give them."""
    rows = counts.groupBy("mk").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)])
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    full = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("c3") > 0) & (F.col("c4") > 0)
    out = []
    for k in (1, 2, 3):
        found = k - (k + 1) * y * F.try_divide(f"c{k + 1}", f"c{k}")
        out.append(F.when(full, F.least(F.greatest(found, F.lit(0.05)), F.lit(k - 0.05))).otherwise(k / 2).alias(f"d{k}"))
    return rows.select("mk", *out)


def entries(counts: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``kind, mk, gram, value, n`` from the 4-gram counts ``mk, gram, n``.

    Kind ``k`` (1 to 4) is a seen gram of ``k`` symbols with its smoothed log-probability,
    kind ``-k`` a context of ``k`` symbols (0 to 3) with the logarithm of the mass that is
    left to the next lower order; context 0 has kind 0.  The tables read from are added to
    ``paths``.
    """
    paths = [] if paths is None else paths
    tables = {ORDER: counts}
    mask = lambda k: F.lit((1 << UNIT * k) - 1 if UNIT * k < 64 else -1)
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
        tables[k], path = write_table(tables[k + 1].groupBy("mk", F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count("*").alias("n")), f"counts-{k}")
        paths.append(path)
    out, lower = None, None
    for k in range(1, ORDER + 1):
        rows = sized_join(tables[k], discount_columns(tables[k]), "mk")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("mk", "gram", "n", F.shiftrightunsigned("gram", UNIT).alias("context"), F.least(cut, F.col("n")).alias("cut"))
        inside = Window.partitionBy("mk", "context")
        rows = rows.withColumns({"total": F.sum("n").over(inside), "left": F.sum("cut").over(inside) / F.sum("n").over(inside), "nth": F.row_number().over(inside.orderBy("gram"))})
        own = (F.col("n") - F.col("cut")) / F.col("total")
        if lower is None:
            made = rows.withColumn("p", own + F.col("left") / SYMBOLS)
        else:
            low = lower.where(f"kind = {k - 1}").select("mk", F.col("gram").alias("suffix"), F.exp("value").alias("low"))
            made = rows.withColumn("suffix", F.col("gram").bitwiseAND(mask(k - 1))).join(low, ["mk", "suffix"]).withColumn("p", own + F.col("left") * F.col("low"))
        gram = F.struct(F.lit(k).alias("kind"), F.col("gram").alias("gram"), F.log("p").alias("value"), "n")
        context = F.struct(F.lit(1 - k).alias("kind"), F.col("context").alias("gram"), F.log("left").alias("value"), F.col("total").alias("n"))
        both = made.select("mk", F.explode(F.when(F.col("nth") == 1, F.array(gram, context)).otherwise(F.array(gram))).alias("e"))
        lower, path = write_table(both.select("e.kind", "mk", "e.gram", "e.value", "e.n"), f"kneser-ney-{k}")
        paths.append(path)
        out = lower if out is None else out.union(lower)
    return out


# ------------------------------------------------------------------ scoring


class Entries:
    """Entries by hash: sorted keys, where each range of keys begins, and values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, complete: bool):
        order = np.argsort(keys)
        self.complete = complete
        self.keys = np.concatenate([keys[order], np.full(1, np.iinfo(np.uint64).max)])
        self.values = np.concatenate([values[order], np.full(1, np.nan, np.float32)])
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    @staticmethod
    def key(kind: int, mk: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """64-bit hash: one-to-one among the grams of a model's kind."""
        with np.errstate(over="ignore"):
            x = gram * _MULTIPLY[0] ^ (mk + np.uint64(kind % 16)) * _MULTIPLY[1]
            x = (x ^ x >> np.uint64(29)) * _MULTIPLY[2]
            return x ^ x >> np.uint64(32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, NaN for those not held."""
        at = self.begin[keys >> self.shift]
        got = self.keys[at]
        behind = np.flatnonzero(got < keys)
        while len(behind):
            at[behind] += 1
            got[behind] = self.keys[at[behind]]
            behind = behind[got[behind] < keys[behind]]
        return np.where(got == keys, self.values[at], np.float32(np.nan))

    def log_probs(self, mk: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Log-probabilities of 4-grams; NaN where an entry that was not sent may hold it."""
        out = self.find(self.key(ORDER, mk, gram)).astype(np.float64)
        rest = np.flatnonzero(np.isnan(out)) if self.complete else np.zeros(0, np.int64)
        total = np.zeros(len(rest))
        for k in range(ORDER - 1, -1, -1):  # back off to grams of k symbols
            if not len(rest):
                break
            cut = lambda n: gram[rest] & np.uint64((1 << UNIT * n) - 1 if n < ORDER else 2**64 - 1)  # noqa: B023, E731
            left = self.find(self.key(-k, mk[rest], cut(k + 1) >> np.uint64(UNIT)))
            total += np.where(np.isnan(left), 0, left)
            if k == 0:
                out[rest] = total - math.log(SYMBOLS)
                break
            p = self.find(self.key(k, mk[rest], cut(k)))
            known = ~np.isnan(p)
            out[rest[known]] = total[known] + p[known]
            rest, total = rest[~known], total[~known]
        return out


def sent_entries(table: DataFrame, most: int = SENT_ENTRIES) -> Entries:
    """What the workers get: all entries if they are at most ``most``, else the 4-grams of
    the highest counts, ties in or out together."""
    complete = table.count() <= most
    rows = table
    if not complete:
        rows = table.where(F.col("kind") == ORDER)
        step = F.floor(F.log2("n") * 8).cast("int")
        total, least = 0, 1 << 30
        for r in sorted(rows.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
            total += r["count"]
            if total > most:
                break
            least = r["step"]
        rows = rows.where(step >= least)
    keys, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
    for b in rows.select("kind", "mk", "gram", F.col("value").cast("float").alias("value")).toArrow().to_batches():
        kind, mk, gram, value = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        for k in np.unique(kind):
            own = kind == k
            keys.append(Entries.key(int(k), mk[own].view(np.uint64), gram[own].view(np.uint64)))
            values.append(value[own])
    return Entries(np.concatenate(keys), np.concatenate(values), complete)


def resolved(grams: DataFrame, table: DataFrame) -> DataFrame:
    """``mk, gram, value``: log-probabilities of distinct 4-grams by joins with the entries."""
    of = lambda kind, name: table.where(f"kind = {kind}").select(F.col("mk"), F.col("gram").alias("at"), F.col("value").alias(name))
    part = lambda n, drop: F.shiftrightunsigned(F.col("gram").bitwiseAND(F.lit((1 << UNIT * n) - 1 if n < ORDER else -1)), UNIT * drop)
    rows = grams.withColumn("at", F.col("gram")).join(of(ORDER, "value"), ["mk", "at"], "left").withColumn("left", F.lit(0.0))
    for k in range(ORDER - 1, -1, -1):
        rows = rows.drop("at").withColumn("at", part(k + 1, 1)).join(of(-k, "mass"), ["mk", "at"], "left").withColumn("left", F.col("left") + F.coalesce("mass", F.lit(0.0))).drop("at", "mass")
        if k:
            rows = rows.withColumn("at", part(k, 0)).join(of(k, "p"), ["mk", "at"], "left").withColumn("value", F.coalesce("value", F.col("p") + F.col("left"))).drop("p")
    return rows.select("mk", "gram", F.coalesce("value", F.col("left") - math.log(SYMBOLS)).alias("value"))


def score(rows: DataFrame, table: DataFrame, most: int = SENT_ENTRIES, paths: list[str] | None = None) -> DataFrame:
    """The columns of ``rows(mk, text, ...)`` but the text, with ``log_p`` and ``n``: the
    sum of the symbols' log-probabilities and their number, the closing pad included."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(sent_entries(table, most))
    other = [f for f in rows.schema.fields if f.name not in ("mk", "text")]
    held = rows.select("mk", "text", F.struct(F.monotonically_increasing_id().alias("rid"), *[f.name for f in other]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in chunks(batches, 1, SLICE_BYTES):
            mk = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            log_p, n = np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=np.int64)
            cold: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for g, owners, low, high in unit_blocks(texts(b.column(1))):
                owner = np.repeat(owners, np.diff(np.append(low, len(g))))
                value = table.log_probs(mk[owner], g)
                if not table.complete:
                    step = np.zeros(len(g) + 1, dtype=np.int8)
                    step[low] += 1
                    step[high] -= 1
                    away = np.flatnonzero(np.isnan(value) & (np.cumsum(step[:-1]) > 0))
                    cold.append((owner[away], g[away]))
                    value = np.nan_to_num(value)
                total = np.concatenate([[0.0], np.cumsum(value)])
                log_p[owners] += total[high] - total[low]
                n[owners] += high - low
            who, gram = (np.concatenate(x) for x in zip(*cold))
            order = np.lexsort((gram, who))
            who, gram = who[order], gram[order]
            new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (gram[1:] != gram[:-1])]) if len(who) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(who)))
            offsets = np.searchsorted(who[new], np.arange(b.num_rows + 1))
            pairs = pa.StructArray.from_arrays([pa.array(gram[new].view(np.int64)), pa.array(times.astype(np.int64))], ["gram", "times"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(log_p), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["mk", "row", "log_p", "n", "cold"])

    kind = held.schema["row"].dataType.simpleString()
    made = held.mapInArrow(run, f"mk long, row {kind}, log_p double, n long, cold array<struct<gram: long, times: long>>")
    names = [F.col("row")[f.name].alias(f.name) for f in other]
    if sent.value.complete:
        return made.select(*names, "log_p", "n")
    table_, path = write_table(made, "partial-scores")
    if paths is not None:
        paths.append(path)
    cold = table_.select("row.rid", "mk", F.explode("cold").alias("c")).select("rid", "mk", "c.gram", "c.times")
    values, path = write_table(resolved(cold.select("mk", "gram").distinct(), table), "resolved")
    if paths is not None:
        paths.append(path)
    more = cold.join(values, ["mk", "gram"]).groupBy("rid").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
    return table_.join(more, table_["row"]["rid"] == more["rid"], "left").select(*names, (F.col("log_p") + F.coalesce("more", F.lit(0.0))).alias("log_p"), "n")


# ------------------------------------------------------------------ classification

def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of what is labelled good and never poor."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def trusted_documents(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``(lang, text, fold)`` of documents labelled good and never labelled poor, with
    text.  Equal texts are in one fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return sized_join(rows, trusted_ids(labels), "doc_id", "left_semi").select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"))


def languages(trusted: DataFrame, folds: int) -> DataFrame:
    """``lang, m, others``: the languages with enough trusted text, the ids of their
    models and how many of their documents are outside each fold."""
    by_fold = [F.count_if(F.col("fold") == f) for f in range(folds)]
    rows = trusted.where(F.col("lang") != POOLED).groupBy("lang").agg(F.count("*").alias("size"), F.array(*[F.count("*") - x for x in by_fold]).alias("others"))
    return rows.where(F.col("size") >= MIN_TRUSTED).select("lang", F.xxhash64("lang").alias("m"), "others")


def held_out(trusted: DataFrame, known: DataFrame, table: DataFrame, most: int, folds: int, paths: list[str]) -> DataFrame:
    """``model, log_p, n`` of the trusted documents under models of the other folds'
    text.  A language that only one fold has is scored there by the pooled model, and
    a fold that has all trusted text is left out."""
    sizes = trusted.groupBy("fold").count().collect()
    total = sum(r["count"] for r in sizes)
    alone = [r["fold"] for r in sizes if r["count"] == total]
    rows = sized_join(trusted.where(~F.col("fold").isin(alone)) if alone else trusted, known, "lang", "left")
    own = F.coalesce(F.get("others", F.col("fold")) > 0, F.lit(False))
    return score(rows.select(model_key(F.when(own, F.col("m")).otherwise(F.lit(POOLED_ID).cast("long")), F.col("fold")).alias("mk"), "text", F.when(own, F.col("lang")).otherwise(POOLED).alias("model")), table, most, paths)


def quantiles(rows: DataFrame, share: float, name: str) -> DataFrame:
    """``model, size`` and the quantile of ``rate`` by model, rounded up to the grid.

    Blocks of ``GRID_BLOCK`` steps are ordered first, then the steps of the one block in
    which the quantile falls, so that no task orders a model's whole grid.
    """
    steps = rows.groupBy("model", F.floor(F.col("rate") * GRID).alias("step")).agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("step") / GRID_BLOCK))
    of = Window.partitionBy("model")
    upto = F.sum("n").over(of.orderBy("block"))
    blocks = steps.groupBy("model", "block").agg(F.sum("n").alias("n")).select("model", "block", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.sum("n").over(of).alias("size"))
    reached = blocks.where(F.col("upto") >= F.lit(share) * F.col("size")).groupBy("model").agg(F.min("block").alias("block"), F.min("before").alias("before"), F.max("size").alias("size"))
    counted = steps.join(reached, ["model", "block"]).withColumn("upto", F.col("before") + F.sum("n").over(of.orderBy("step")))
    return counted.where(F.col("upto") >= F.lit(share) * F.col("size")).groupBy("model").agg(((F.min("step") + 1) / GRID).alias(name), F.max("size").alias("size"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, most: int = SENT_ENTRIES, folds: int = FOLDS) -> DataFrame:
    """One row per document: ``doc_id, k1, k2, model, perplexity, threshold, keep``.

    ``perplexity`` is that of the UTF-16 units and ``PRIOR_CHARS`` more at the median of
    the model's trusted documents; ``threshold`` is the quantile of the trusted documents'
    perplexities, each under models that have not seen its text.
    A null or unknown language, or one with fewer than 20 trusted documents, is
    scored by the pooled model.  A null or empty text has null perplexity and is not
    kept; without any trusted text nothing can be judged and every text is kept.
    Repeated rows are scored alike, and text that is no UTF-8 as if repaired.
    """
    spark = docs.sparkSession
    trusted = trusted_documents(docs, labels, folds)
    known, known_path = write_table(languages(trusted, folds), "languages")
    everything = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("doc_id", "text", "lang"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    unjudged = lambda rows, keep: rows.select("doc_id", "k1", "k2", F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(keep).alias("keep"))
    empty = unjudged(everything.where("text is null or text = ''"), False)
    named = sized_join(trusted, known.select("lang", "m"), "lang", "left").select(F.coalesce("m", F.lit(POOLED_ID).cast("long")).alias("m"), "fold", "text")
    counts, path = write_table(variants(gram_counts(named, folds), folds), "grams")
    if counts.isEmpty():
        return unjudged(everything.where("text <> ''"), True).union(empty)
    paths = [path]
    table = entries(counts, paths)
    mine = known.select("m").union(spark.range(1).select(F.lit(POOLED_ID).cast("long").alias("m"))).select(model_key(F.col("m"), -1).alias("mk"))
    rest = sized_join(table, mine.withColumn("all", F.lit(True)), "mk", "left")
    unseen, unseen_path = write_table(held_out(trusted, known, rest.where("all is null").drop("all"), most, folds, paths), "held-out")
    rows = sized_join(everything.where("text <> ''"), known.select("lang", "m"), "lang", "left")
    rows = rows.select("doc_id", "k1", "k2", F.when(F.col("m").isNull(), POOLED).otherwise(F.col("lang")).alias("model"), model_key(F.coalesce("m", F.lit(POOLED_ID).cast("long")), -1).alias("mk"), "text")
    scored, _ = write_table(score(rows, rest.where("all").drop("all"), most, paths), "scores")
    per_unit = -F.col("log_p") / F.col("n")
    plain = unseen.withColumn("rate", per_unit)
    middle, _ = write_table(quantiles(plain, 0.5, "middle").select("model", "middle"), "middles")
    found = quantiles(plain.withColumn("model", F.lit(POOLED)), 0.5, "middle").first()
    overall = found["middle"] if found else None
    centre = lambda rows: sized_join(rows, middle, "model", "left").withColumn("rate", (F.lit(PRIOR_CHARS) * F.coalesce("middle", F.lit(overall).cast("double"), per_unit) - F.col("log_p")) / (F.col("n") + PRIOR_CHARS))
    limits = quantiles(centre(unseen), quantile, "limit")
    limits, _ = write_table(limits, "limits")
    widest = limits.agg(F.max("limit")).first()[0]
    judged = sized_join(centre(scored), limits.where(F.col("size") >= MIN_TRUSTED), "model", "left")
    limit = F.coalesce("limit", F.lit(widest).cast("double"))
    for p in [*paths, known_path]:
        drop_table(spark, p)
    out = judged.select("doc_id", "k1", "k2", "model", F.exp("rate").alias("perplexity"), F.exp(limit).alias("threshold"), F.coalesce(F.col("rate") <= limit, F.lit(True)).alias("keep"))
    return out.union(empty)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``classify`` keeps, with all their columns."""
    rejected, _ = write_table(classify(docs, labels).where("not keep").select("k1", "k2").distinct(), "rejected")
    return drop_rows(docs, rejected, "doc_id", "text", "lang")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).select("doc_id", "model", "perplexity", "threshold", "keep")
