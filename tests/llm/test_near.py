import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from granary.llm import fingerprints, graph, ngram_join, shingles
from pyspark.sql import functions as F

from tests.llm.helpers import TEXTS, awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def planted(seed=5):
    """Groups of near copies on both sides of the threshold, and exact copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 6)):
            other = text[:]
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append(" ".join(other))
    text = [rng.choice(words) for _ in range(300)]
    for k in range(60):
        rows.append(" ".join([*text[: 290 - k % 7], f"end{k}"]))
    return list(enumerate(rows))


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or (sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= threshold):
                links[a] += 1
                links[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[top(k)].append(i)
    least = {k: min([x for x in v if x is not None], default=None) for k, v in ids.items()}
    return sorted(((i, least[top(k)], links[k]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("blocks", [1000, 7])
def test_join_equals_brute_force(spark, blocks):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.link(docs, block_classes=blocks).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)
    keepers = [r for r in got if r.keeper]
    assert len(keepers) == len({r.class_id for r in got})


def test_join_of_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.link(docs).collect()), key=str) == brute(rows)
    got = ngram_join.link(awkward(spark)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(TEXTS)
    assert ngram_join.link(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each_class(spark):
    rows = [*planted(), (0, planted()[0][1]), (None, "a lone text without an id that is long enough")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    kept = ngram_join.stage(spark, docs, "").collect()
    expected = {c for _, c, _ in brute(rows)}
    assert len(kept) == len(expected) and {r.doc_id for r in kept} == expected and kept[0].source == "x"


def test_shortest_prefix_keeps_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        d = ngram_join.shortest_for(threshold)
        assert ngram_join.meets(threshold, d) >= ngram_join.RECALL
        assert d == 24 or ngram_join.meets(threshold, d + 1) < ngram_join.RECALL


def test_depth_follows_the_links_that_are_there():
    short = ngram_join.shortest_for(0.8)
    deep = short + ngram_join.LEVELS
    assert ngram_join.depth_for([(1.0, 500)], short, 0.8) == deep  # close copies meet at any depth
    between = ngram_join.depth_for([(1.0, 500), (0.82, 20)], short, 0.8)
    assert short < between < deep
    links = [(1.0, 500), (0.82, 20)]
    true = [n / ngram_join.meets(s, short, ngram_join.FIRST) for s, n in links]
    recall = lambda d: sum(w * ngram_join.meets(s, d) for (s, _), w in zip(links, true)) / sum(true)
    assert recall(between) >= ngram_join.RECALL > recall(between + 1)
    assert ngram_join.depth_for([(0.3, 500)], short, 0.8) == ngram_join.depth_for([], short, 0.8) == short


def near_pairs(rng, n, low, high):
    """Pairs of texts whose similarity lies from ``low`` to ``high``, beside texts that nothing resembles."""
    words, rows = [f"v{i}" for i in range(5000)], []
    while len(rows) < 2 * n:
        size = rng.randint(40, 300)
        a = [rng.choice(words) for _ in range(size)]
        b = a[:]
        for _ in range(rng.randint(1, max(1, size // 40))):
            b[rng.randrange(size)] = rng.choice(words)
        a, b = " ".join(a), " ".join(b)
        if low <= jaccard(grams(a), grams(b)) <= high:
            rows += [a, b]
    return list(enumerate(rows))


def test_recall_against_brute_force(spark):
    rows = near_pairs(random.Random(9), 400, 0.8, 0.85)
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.n_links == 1 for r in got) / len(rows) >= 0.99


def boilerplate(n, seed=4):
    """Texts with nearly half of their words in common, of which none is a near copy of another."""
    rng, words = random.Random(seed), [f"u{i}" for i in range(20_000)]
    shared = [rng.choice(words) for _ in range(90)]
    return [(i, " ".join([*shared, *[rng.choice(words) for _ in range(100)]])) for i in range(n)]


def test_boilerplate_makes_no_candidates(spark):
    each = []
    for n in (600, 1200):
        docs = spark.createDataFrame(boilerplate(n), "doc_id long, text string")
        signed = ngram_join.sign(docs).withColumn("node", F.monotonically_increasing_id())
        each.append(ngram_join.neighbours(ngram_join.materialize(signed, "test")).count() / n)
        assert not ngram_join.link(docs).filter("n_links > 0").count()
    assert each[1] <= each[0] + 0.01 and each[1] < 0.05


def test_a_repeated_row_is_verified_once(spark):
    rows = near_pairs(random.Random(3), 5, 0.8, 0.99)
    docs = spark.createDataFrame(rows + [rows[0]] * 500, "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.link(docs).collect()}
    assert {(r[0], r[2]) for r in got if r[0] in (0, 1)} == {(0, 501), (1, 501)}


def test_stage_with_clashing_names(spark):
    rows = [(i, t, "a", "b", "c", "e", 5) for i, t in planted()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_id string, D string, h string, keeper string, n int")
    kept = ngram_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {tuple(r)[2:] for r in kept.collect()} == {("a", "b", "c", "e", 5)}
    assert ngram_join.stage(spark, docs.limit(0), "").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(80)]]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame([*edges, (None, "n001")], "a string, b string"), "a", "b").collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_shingles_are_those_of_the_words():
    texts = [t or "" for _, t in TEXTS] + ["a b c d e f g", "a b c d e", "a b c d", " a b  c d e \n"]
    raw = [t.encode() for t in texts]
    hashes, many = shingles.shingle_hashes(b"".join(raw), np.array([len(r) for r in raw]))
    cuts = np.concatenate([[0], np.cumsum(many)])
    by_gram = {}
    for k, t in enumerate(texts):
        own, w = hashes[cuts[k] : cuts[k + 1]], WORD.findall(t)
        listed = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        assert len(own) == len(listed)
        for g, h in zip(listed, own):
            assert by_gram.setdefault(g, h) == h
    assert len(set(by_gram.values())) == len(by_gram)
    long = ("alpha beta gamma " * 2000).encode()
    assert (shingles.word_hashes(long, np.array([len(long)]), most=1000)[0] == shingles.word_hashes(long, np.array([len(long)]))[0]).all()


def in_order(docs):
    """(doc_id, text) by doc_id, ties by the hash that the operator uses."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    return [(r.doc_id, r.t) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id, r.h, r.t))]


def test_fingerprints_of_a_hot_id(spark):
    rows = [(7 if i % 2 else i, f"text {i} of some words that differ by {i * i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.compare_with_next(docs, rows_per_range=20)
    used = docs.select(fingerprints.range_bucket("doc_id", fingerprints.range_bounds(docs, "doc_id", 20), F.xxhash64("text")).alias("r")).groupBy("r").count()
    assert max(r["count"] for r in used.collect()) < 60
    rows = in_order(docs)
    expected = sorted(hashlib.sha256(fingerprints.edited(t, n).encode()).hexdigest() for (_, t), (_, n) in zip(rows, rows[1:] + rows[:1]))
    assert sorted(r.edited_sha256 for r in got.collect()) == expected


def test_fingerprints_of_tables(spark, small):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), awkward(spark)):
        rows = in_order(docs)
        got = {(r.doc_id, r.fingerprint, r.edited_sha256): r for r in fingerprints.compare_with_next(docs, rows_per_range=7).collect()}
        errors = []
        for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
            changed = fingerprints.edited(t, n)
            print_ = fingerprints.packed(fingerprints.signatures([t.encode()]))[0]
            r = got[i, print_, hashlib.sha256(changed.encode()).hexdigest()]
            assert r.n_chars == len(t) and r.edited_fingerprint == fingerprints.packed(fingerprints.signatures([changed.encode()]))[0]
            if len(grams(t)) > 20:
                errors += [r.near_edited - jaccard(grams(t), grams(changed)), r.near_next - jaccard(grams(t), grams(n))]
            assert (r.near_next == 1) or t != n
        if len(errors) > 50:
            assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.15
    assert fingerprints.compare_with_next(docs.limit(0)).count() == 0
    one = fingerprints.compare_with_next(docs.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_densified_bins_keep_the_similarity():
    rng = np.random.default_rng(2)
    for overlap in (0.0, 0.4, 0.8, 1.0):
        estimates = []
        for _ in range(60):
            n = 40  # far fewer than bins
            both = [f"s{x}" for x in rng.integers(0, 1 << 40, int(n * overlap))]
            a, b = ([*both, *[f"{c}{x}" for x in rng.integers(0, 1 << 40, n - len(both))]] for c in "xy")
            s = fingerprints.signatures([" ".join(a).encode(), " ".join(b).encode()], words=1)
            estimates.append(fingerprints.likeness(s[:1], s[1:])[0])
        assert abs(np.mean(estimates) - overlap / (2 - overlap)) < 0.04


def test_short_texts_have_prints_of_their_own():
    s = fingerprints.signatures([f"short text {i}".encode() for i in range(200)])
    assert len(set(fingerprints.packed(s))) == 200
    assert max(fingerprints.likeness(s[:-1], s[1:])) < 0.2
    assert (s == fingerprints.signatures([f"short  text {i}".encode() for i in range(200)])).all()
