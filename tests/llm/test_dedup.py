"""SimHash, line dedup, substring dedup: against brute force, and odd inputs."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as lines
from tidemark.llm import simhash
from tidemark.llm import substring_dedup as sub
from tidemark.llm.common import connected_components

WORDS = [f"w{k}" for k in range(400)]


def corpus(seed=3, n=120):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(WORDS, rng.integers(5, 120))) for _ in range(n)]
    for k in range(0, n, 6):  # near-copies: one word changed
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    return texts + [texts[0]] * 5 + ["", None, "one", "one two"]


def table(spark, texts):
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")


def test_fingerprint_by_definition():
    for text in corpus():
        words = (text or "").lower().split()
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        want = 0
        for bit in range(64):
            ones = sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams)
            want |= (2 * ones > len(grams)) << bit
        assert simhash.simhash64((text or "").encode(), 3) == want
    long = b"a b c d " * 3
    assert simhash.simhash64(long, 3) == simhash.simhash64(long.replace(b" ", b"\t\n"), 3)


def brute_components(fps, ids, distance=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, d in zip(label, ids):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return [least.get(x) for x in label]


def test_near_duplicates_against_brute_force(spark):
    found = simhash.near_duplicates(table(spark, corpus())).collect()
    fps = [r.fp & (1 << 64) - 1 for r in found]
    assert [r.component_id for r in found] == brute_components(fps, [r.doc_id for r in found])
    assert len(found) == len(corpus())


def test_links_of_hot_and_dense_groups(spark, monkeypatch):
    """A ball of fingerprints around one centre, split and unsplit, connects the same."""
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    centre = int(rng.integers(0, 1 << 63))
    for _ in range(400):
        x = centre
        for b in rng.choice(63, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components(fps, fps)
    for hot in (simhash.HOT_SIGNATURE, 20):
        monkeypatch.setattr(simhash, "HOT_SIGNATURE", hot)
        roots = {r.node: r.root for r in connected_components(simhash.hamming_links(df, 3)).collect()}
        assert [roots.get(f, f) for f in fps] == want


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 10**8), st.integers(1, 6), st.integers(0, 1000))
def test_allocation_obeys_the_pigeonhole(n, distance, seed):
    bits = np.random.default_rng(seed).random((500, 64)) < np.linspace(0.1, 0.9, 64)
    both = bits.T.astype(float) @ bits * n / 500
    plan = simhash.allocate(n, both, distance)
    assert sorted(b for part, _ in plan for b in part) == list(range(64))
    assert sum(t for _, t in plan) == distance - len(plan) + 1


def test_simhash_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, None), (7, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 5), (-1, 7), (5, 5), (5, 5), (7, 7)]
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [5, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_takes_jaccard_on_five_words(spark):
    """Copies with words changed here and there, at Jaccard 0.8 and more, fall to one;
    those below it stay, however near their fingerprints are."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(40):
        words = list(rng.choice(WORDS, 200))
        texts.append(" ".join(words))
        for j in range(1 + k % 8):
            words[12 + 23 * j] = f"changed{j}"
        texts.append(" ".join(words))
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(grams[::2], grams[1::2])]
    assert 10 < sum(alike) < 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert kept == {2 * k for k in range(40)} | {2 * k + 1 for k in range(40) if not alike[k]}


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 10 for k in range(10, 41)} | {k: 100 for k in range(100, 130)} | {7: 7}


def line_corpus():
    rng = np.random.default_rng(1)
    common = [f"Common LINE {k}" for k in range(5)]
    docs = []
    for d in range(60):
        own = [f"line {d} {k}" for k in range(rng.integers(0, 4))]
        docs.append("\n".join([*own, *[f"  {c}\t" if d % 2 else c.lower() for k, c in enumerate(common) if d % (k + 2) == 0], "", own[0] if own else ""]))
    return [*docs, None, "", "\n\n", common[0]]


def brute_lines(docs, least=10):
    split = [(t or "").split("\n") for t in docs]
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").lower()
    count = Counter(k for d in split for k in {key(x) for x in d} if k)
    return [(len(d), sum(count[key(x)] >= least for x in d), "\n".join(x for x in d if count[key(x)] < least)) for d in split]


@pytest.mark.parametrize("room", [lines.BROADCAST_BYTES, 0])
def test_line_dedup_against_brute_force(spark, monkeypatch, room):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", room)
    docs = line_corpus()
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(docs)], "doc_id long, text string, key int")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(df).collect()}
    assert [got[k] for k in range(len(docs))] == brute_lines(docs)
    out = {r.doc_id: (r.text, r.key) for r in lines.deduplicated_documents(df).collect()}
    assert [out[k] for k in range(len(docs))] == [(kept, 1) for _, _, kept in brute_lines(docs)]
    assert lines.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("room", [lines.BROADCAST_BYTES, 0])
def test_lines_of_all_ascii_characters(spark, monkeypatch, room):
    """Every ASCII character at both ends of a line, and the letters f, n, r, t and v."""
    monkeypatch.setattr(lines, "BROADCAST_BYTES", room)
    ends = [chr(c) for c in range(1, 128) if chr(c) != "\n"]
    kinds = ["\n".join(f"{c}foo {ord(c)} bar{c}" for c in ends), "\n".join(f" {c}oo\x0b{c}\t\x0c" for c in ends)]
    docs = [kinds[k % 2] for k in range(24)] + [kinds[0].swapcase(), "oo bar", "f", "foo bar of"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(docs))] == brute_lines(docs)


def test_lines_that_a_given_index_never_saw(spark):
    """A filter takes a few of 120,000 other lines wrongly; they stay all the same."""
    common = spark.createDataFrame([(k, "\n".join(f"common {i}" for i in range(1500))) for k in range(10)], "doc_id long, text string")
    other = spark.range(400).selectExpr("id as doc_id", "array_join(transform(sequence(0, 299), x -> concat('own ', id, ' ', x)), '\n') as text")
    got = lines.dedup_lines(other, lines.LineIndex.build(common)).agg(F.sum("n_dropped"), F.sum("n_lines")).first()
    assert tuple(got) == (0, 120_000)
    assert lines.dedup_lines(common, lines.LineIndex.build(common)).agg(F.sum("n_dropped")).first()[0] == 15_000


def test_line_index_is_reversible(spark):
    docs = line_corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    state = lambda index: {bytes(r["key"]): r.refs for r in index.refs.collect()}
    first = lines.LineIndex.build(df.where("doc_id < 40"))
    both = first.insert(df.where("doc_id >= 40"))
    assert state(both) == state(lines.LineIndex.build(df))
    assert state(both.delete(df.where("doc_id >= 40"))) == state(first)
    kept = {r.doc_id: r.kept for r in lines.dedup_lines(df, both.delete(df.where("doc_id >= 5"))).collect()}
    assert kept == {k: t or "" for k, t in enumerate(docs)}


def test_cuckoo_filter():
    digests = [hashlib.blake2b(str(k).encode(), digest_size=16).digest() for k in range(3000)]
    f = lines.CuckooFilter.of(digests[:1000])
    raw = lambda ds: np.frombuffer(b"".join(ds), dtype=np.uint8).reshape(-1, 16).copy()
    assert f.contains(raw(digests[:1000])).all()
    assert f.contains(raw(digests[1000:])).mean() < 0.01
    for d in digests[:500]:
        assert f.delete(d)
    assert f.contains(raw(digests[500:1000])).all()
    assert f.contains(raw(digests[:500])).mean() < 0.01


def passages():
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    wrap = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    shared, other, third = text(60), text(70), text(60)
    changed = other.split()
    changed[20] = "different"
    docs = [text(30) + " " + shared + " " + text(20), text(50) + " " + shared, other, " ".join(changed) + "\n" + text(45), text(80), text(10), None, "", text(30) + "\n" + other]
    docs += [docs[4], wrap(third, 30), wrap(third, 20), text(12) + "\n\n" + third.upper().replace(" ", "  "), wrap(docs[4], 11), text(49), "x " + " ".join(third.split()[:49])]
    return docs + [text(100) + "\n" + shared + "\n" + text(200) + wrap(" " + third + " ", 7) + text(50)]


def brute_spans(docs):
    """Spans of 50-word windows that another document has, and that an earlier one has."""
    words = [(t or "").lower().split() for t in docs]
    has = defaultdict(set)
    for d, w in enumerate(words):
        for k in range(len(w) - 49):
            has[tuple(w[k : k + 50])].add(d)

    def spans(d, test):
        starts = [k for k in range(len(words[d]) - 49) if test(has[tuple(words[d][k : k + 50])])]
        return sub.merged_spans(np.array(starts, dtype=np.int64))

    return {d: (spans(d, lambda s: len(s) > 1), spans(d, lambda s: min(s) < d)) for d in range(len(docs))}  # noqa: B023


@pytest.mark.parametrize("small", [False, True])
def test_repeated_text_against_brute_force(spark, monkeypatch, small):
    """Also with texts cut into parts and without broadcasts."""
    if small:
        monkeypatch.setattr(sub, "SPLIT_BYTES", 40)
        monkeypatch.setattr(sub, "BLOCK", 16)
        monkeypatch.setattr("tidemark.llm.common.BROADCAST_ROWS", 0)
        monkeypatch.setattr(sub, "BROADCAST_PLACES", 0)
    docs = passages()
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(docs)], "doc_id long, text string, key int")
    rows = sub.repeated_text(df).collect()
    found = {(r.doc_id, r.paragraph): r for r in rows if r.paragraph >= 0}
    paras = [(d, k, line.lower().split()) for d, t in enumerate(docs) for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= sub.MIN_WORDS]
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    near = defaultdict(set)
    for d, k, w in paras:
        for e, m, v in paras:
            a, b = grams(w, 5), grams(v, 5)
            if d != e and len(a & b) >= 0.8 * len(a | b):
                near[(d, k)].add((e, m))
    assert set(found) == set(near)
    assert {x: (r.cluster_doc, r.cluster_paragraph) for x, r in found.items() if not r.keep} == {x: min(near[x]) for x in near if min(near[x]) < x}
    want = {d: x for d, x in brute_spans(docs).items() if x[0]}
    assert {r.doc_id: (r.shared, r.removable) for r in rows if r.paragraph < 0} == want
    assert {0, 1, 10, 11, 12, 13, 16} <= set(want) and not {5, 6, 7, 14, 15} & set(want)
    assert sub.repeated_text(df.limit(0)).count() == 0


def test_repeated_text_of_odd_rows(spark):
    long, other = " ".join(WORDS[:60]), " ".join(WORDS[60:140])
    rows = [(1, long), (1, long), (None, long), (None, other), (2, "\x0b" + long.upper()), (3, other), (None, None)]
    got = sub.repeated_text(spark.createDataFrame(rows, "doc_id long, text string")).where("paragraph = -1").collect()
    assert sorted((str(r.doc_id), r.cluster_doc, r.keep, r.shared, r.removable) for r in got) == [("1", 1, True, "0-60", "")] * 2 + [("2", 1, False, "0-60", "0-60"), ("None", 1, True, "0-60", "")]


def test_bands_reach_their_recall():
    for s in (0.6, 0.8, 0.9):
        bands, rows = sub.tune_bands(s, 0.99)
        assert bands * rows <= 40 and 1 - (1 - s**rows) ** bands >= 0.99


def test_repetition_inside_one_document_is_not_reported(spark):
    text = " ".join(WORDS[:60])
    df = spark.createDataFrame([(1, text + "\n" + text), (2, " ".join(WORDS[100:160]))], "doc_id long, text string")
    assert sub.repeated_text(df).count() == 0
