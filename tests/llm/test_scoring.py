"""Quality, toxicity, language: held-out accuracy, brute force and odd inputs."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as lid
from tidemark.llm import quality as q
from tidemark.llm import toxicity as tox

SMALL = "/root/testdata/sf0.01"


def discounts(n1, n2, n3, n4):
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def test_discounts(spark):
    for counts in ((100, 40, 20, 10), (0, 1, 1, 1), (3, 9, 1, 1)):
        rows = [(1, n) for n, times in enumerate(counts, 1) for _ in range(times)] + [(1, 7)]
        got = q.discount_columns(spark.createDataFrame(rows, "mk long, n long")).first()
        assert (got.d1, got.d2, got.d3) == pytest.approx(discounts(*counts))


def units(text):
    raw = text.encode("utf-16-le")
    return [int.from_bytes(raw[k : k + 2], "little") for k in range(0, len(raw), 2)]


def reference_model(texts):
    """Modified Kneser-Ney over UTF-16 units, by definition."""
    order = q.ORDER
    from collections import Counter, defaultdict

    grams = Counter()
    for t in texts:
        s = ["^"] * (order - 1) + units(t) + ["^"]
        grams.update(tuple(s[k : k + order]) for k in range(len(s) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in counts[k + 1]:
            before[g[1:]].add(g[0])
        counts[k] = {g: len(v) for g, v in before.items()}
    cut = {k: discounts(*[sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]) for k, c in counts.items()}
    ctx = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            ctx[k][g[:-1]].append(n)

    def prob(context, w, k):
        if k == 0:
            return 1 / q.SYMBOLS
        c = tuple(context[len(context) - (k - 1) :]) if k > 1 else ()
        low = prob(context, w, k - 1)
        if c not in ctx[k]:
            return low
        ns = ctx[k][c]
        d = lambda n: cut[k][min(n, 3) - 1]
        n = counts[k].get((*c, w), 0)
        return (max(n - d(n), 0) if n else 0) / sum(ns) + sum(min(d(x), x) for x in ns) / sum(ns) * low

    def log_p(t):
        s = ["^"] * (order - 1) + units(t) + ["^"]
        return sum(math.log(prob(s[k - order + 1 : k], s[k], order)) for k in range(order - 1, len(s)))

    return log_p


@pytest.mark.parametrize("most", [q.SENT_ENTRIES, 40, 0])
@pytest.mark.parametrize("block", [q.BLOCK, 7])
def test_log_probabilities_by_definition(spark, monkeypatch, most, block):
    """All entries, some or none are sent to the workers; texts are cut anywhere."""
    monkeypatch.setattr(q, "BLOCK", block)
    texts = ["the cat sat", "the dog ran to the cat", "a cat and a dog", "then", "\u4f60\u597d\u4e16\u754c", "caf\u00e9 \U0001f600"]
    every = [*texts, "the hat", "zzz", "zzz the zzz", "\u4e16\u597d", "x" * 50]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(every)], "doc_id long, text string, lang string")
    trusted = docs.where(f"doc_id < {len(texts)}").select(F.lit(5).cast("long").alias("m"), F.pmod("doc_id", F.lit(2)).cast("int").alias("fold"), "text")
    table = q.entries(q.variants(q.gram_counts(trusted, 2), 2))
    for fold in (-1, 0, 1):
        log_p = reference_model([t for k, t in enumerate(texts) if fold < 0 or k % 2 != fold])
        for m in (5, q.POOLED_ID):
            rows = docs.select("doc_id", "text", q.model_key(F.lit(m).cast("long"), fold).alias("mk"))
            got = {r.doc_id: (r.log_p, r.n) for r in q.score(rows, table, most).collect()}
            for k, t in enumerate(every):
                assert got[k] == (pytest.approx(log_p(t), rel=1e-5), len(units(t)) + 1)


def test_quality_keeps_trusted_text_and_rejects_junk(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = q.classify(docs, labels).toPandas()
    assert len(got) == docs.count()
    known = labels.groupBy("doc_id").max("quality").toPandas().set_index("doc_id")["max(quality)"]
    got["label"] = got.doc_id.map(known)
    assert got[got.label == 1].keep.mean() > 0.98
    assert got[got.label == 0].keep.mean() < 0.25


def test_threshold_is_the_quantile_of_unseen_trusted_text(spark):
    """Texts of few words, which models of one half know as well as models of all: the
    quantile of trusted perplexities is the threshold, and held-out scores hardly differ."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    got = q.classify(docs, labels).toPandas()
    assert got.threshold.iloc[0] == pytest.approx(got.perplexity.quantile(q.QUANTILE), rel=0.08)
    assert got.keep.mean() >= 0.98


def test_held_out_text_is_scored_by_the_other_folds(spark, monkeypatch):
    monkeypatch.setattr(q, "MIN_TRUSTED", 1)
    texts = [("the cat sat", 0)] * 3 + [("the dog ran to the cat", 1), ("a cat and a dog", 1), ("then the hat", 0)]
    trusted = spark.createDataFrame([("en", *t) for t in texts] + [("fr", "le chat", 0)], "lang string, text string, fold int")
    known = q.languages(trusted, 2)
    named = trusted.join(known, "lang").select("m", "fold", "text")
    table = q.entries(q.variants(q.gram_counts(named, 2), 2))
    want = sorted([("en", reference_model([x for x, g in texts if g != f])(t)) for t, f in texts] + [("*", reference_model([x for x, g in texts if g])("le chat"))])
    got = sorted((r.model, r.log_p) for r in q.held_out(trusted, known, table, q.SENT_ENTRIES, 2, []).collect())
    assert [m for m, _ in got] == [m for m, _ in want] and [p for _, p in got] == pytest.approx([p for _, p in want], rel=1e-5)
    assert q.held_out(trusted.where("fold = 0"), known, table, q.SENT_ENTRIES, 2, []).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.995])
def test_quantiles_do_not_depend_on_the_partitions(spark, share):
    rng = np.random.default_rng(9)
    rates = {m: rng.gamma(9, 0.2, n) for m, n in (("a", 4001), ("b", 7))}
    rows = spark.createDataFrame([(m, float(x)) for m, v in rates.items() for x in v], "model string, rate double")
    got = {tuple(sorted((r.model, r.at, r["size"]) for r in q.quantiles(rows.repartition(n, "rate"), share, "at").collect())) for n in (1, 3, 17)}
    assert len(got) == 1
    for m, at, size in got.pop():
        want = np.sort(rates[m])[math.ceil(share * len(rates[m])) - 1]
        assert size == len(rates[m]) and 0 <= at - want <= 1 / q.GRID


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", "en", 1), (1, "good text here", "en", 1), (2, None, "en", 2), (3, "", None, 3), (None, "good text", None, 4), (4, "퟿￿ ok", "xx", 5)], "doc_id long, text string, lang string, keep int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = sorted((str(r.doc_id), r.keep) for r in q.classify(docs, labels).collect())
    assert got[0:2] == [("1", True)] * 2 and ("2", False) in got and ("3", False) in got and len(got) == 6
    kept = q.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 2
    none = q.classify(docs, labels.limit(0)).collect()
    assert {(r.doc_id, r.keep) for r in none} >= {(1, True), (2, False)}
    assert q.classify(docs.limit(0), labels).count() == 0


def test_factorization_machine_learns_a_pair():
    """Neither term alone is toxic; both together are."""
    a, b, c = 11, 22, 33
    rows = []
    rng = np.random.default_rng(0)
    for _ in range(1500):
        t = {x for x in (a, b) if rng.random() < 0.5} | ({c} if rng.random() < 0.3 else set())
        rows.append((int({a, b} <= t), np.array(sorted(t), dtype=np.int64)))
    m = tox.fit(rows, epochs=60)

    def z(*own):
        i = [m.at[x] for x in own if x in m.at]
        s = m.v[i].sum(axis=0)
        return m.bias + m.w[i].sum() + 0.5 * (s @ s - m.square[i].sum())

    assert z(a, b) > 0 > max(z(a), z(b), z())
    assert m.v[m.at[a]] @ m.v[m.at[b]] > 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = tox.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    known = labels.groupBy("doc_id").max("toxic").toPandas().set_index("doc_id")["max(toxic)"]
    held = got[got.held_out].assign(label=got.doc_id.map(known)).dropna()
    pos, neg = held[held.label == 1].score.values, held[held.label == 0].score.values
    assert (pos[:, None] > neg[None]).mean() > 0.95 and (neg >= 0.5).mean() < 0.02


def test_toxicity_of_a_pair_alone(spark):
    """The label is whether exactly one of two words is there: neither tells anything."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(2500):
        a, b = rng.random(2) < 0.5
        words = [f"w{i}" for i in rng.integers(0, 60, 12)] + ["first"] * int(a) + ["second"] * int(b)
        rows.append((k, " ".join(words), int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = tox.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).where("held_out").join(docs, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95


def test_scores_by_definition(spark):
    """The machine's score of whole texts, pair by pair."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    m = tox.train(docs, labels, 300)
    for text in [r.text or "" for r in docs.select("text").limit(25).collect()]:
        own = sorted({m.at[h] for w in tox.words(text.encode()) for h in tox.hashed(w) if h in m.at})
        z = m.bias + sum(m.w[i] for i in own) + sum(float(m.v[i] @ m.v[j]) for i in own for j in own if i < j)
        assert m.score(text.encode()) == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "same")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r["count"] for r in tox.training_rows(docs, labels, 10).groupBy("toxic").count().collect()) == [1, 10]


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "idiot", 0.1), (3, "x " * 50000, 0.1), (3, "x", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == 5 and all(r.score == pytest.approx(0.01) for r in got)
    assert tox.toxicity(docs.limit(0), labels).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = lid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out))


def test_codewords_are_apart():
    code = lid.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 5
    assert (np.abs(code.sum(axis=0)) < 12).all()


@pytest.mark.parametrize("text", ["a b", "  Lots\tof \n\n blank  ", "", " ", "x" * 40, "ab " * 30, "\u00c9t\u00e9 \u4f60\u597d"])
@pytest.mark.parametrize("block", [1, 2, 7])
def test_features_of_long_texts(monkeypatch, text, block):
    """Texts cut into blocks have the features of whole ones."""
    want = lid.ngram_features([text, "other"])
    monkeypatch.setattr(lid, "BLOCK", block)
    assert lid.ngram_features([text, "other"]) == pytest.approx(want)


def brute_decode(model, text):
    """Loss-weighted decoding by definition, a codeword and a bit at a time."""
    margins = lid.ngram_features([text])[0] @ model.w + model.bias
    cost = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(trust, margins, code)) for trust, code in zip(model.trust, model.code)]
    share = [math.exp(min(cost) - c) for c in cost]
    return model.languages[int(np.argmin(cost))], max(share) / sum(share)


def test_decoding_by_definition(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model, texts = lid.train(docs, 40), [r.text or "" for r in docs.select("text").limit(30).collect()]
    found, score, _ = model.predict(texts)
    want = [brute_decode(model, t) for t in texts]
    assert found == [w for w, _ in want] and score == pytest.approx([p for _, p in want], rel=1e-4)


def test_every_language_is_learned(spark):
    """More languages than the sample allows 3 documents of each, with letters of their own."""
    rows = [(k * 5 + d, f"l{k:03d}", " ".join(chr(0x4E00 + k * 5 + (d + i) % 5) for i in range(6))) for k in range(330) for d in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = lid.train(docs, 600, 700)
    learned = {r.lang for r in docs.where(~tox.held_out(F.col("doc_id"), 4, 2)).select("lang").collect()}
    assert set(model.languages) == learned and len(learned) > 300


def test_language_of_odd_rows(spark):
    rows = [(k, "hello there my friend", "en") for k in range(20)] + [(k + 20, "guten tag mein freund", "de") for k in range(20)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 !", "en"), (104, "\u00bd \u00b2 \u2460 _ \u0301", "en"), (None, "hello friend", "zz"), (103, "guten freund", None), (103, "guten freund", None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in lid.identify(docs).collect()]
    by = dict((d, p) for d, p, _ in got)
    assert len(got) == len(rows) and by[100] == by[101] == by[102] == by[104] == "und" and by[None] == "en" and by[103] == "de"
    assert {r.lang_pred for r in lid.identify(docs.where("lang is null")).collect()} == {"und"}
    assert lid.identify(docs.limit(0)).count() == 0
