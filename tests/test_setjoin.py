"""The set-similarity join against all pairs, and near-duplicate clusters in crowds."""

import random

import pytest

from corpusloom.operators import dedup, setjoin
from corpusloom.sources.scratch import Scratch


def jaccard(a, b):
    return len(a & b) / len(a | b)


def frame(spark, sets, roots=None):
    rows = [(k, (roots or {}).get(k, k), sorted(s)) for k, s in sets.items()]
    return spark.createDataFrame(rows, "node long, root long, grams array<long>")


def families(seed, n=160):
    rng = random.Random(seed)
    bases = [[rng.randrange(1 << 60) for _ in range(rng.choice([1, 2, 5, 20, 60]))] for _ in range(12)]
    out = {}
    for k in range(n):
        base = rng.choice(bases)
        out[k] = {x for x in base if rng.random() > 0.06} | {rng.randrange(1 << 60) for _ in range(rng.randint(0, max(1, len(base) // 12)))} - {None}
    out[n], out[n + 1] = set(), set()
    return out


@pytest.mark.parametrize(("similarity", "tile"), [(0.8, setjoin.TILE), (0.8, 3), (0.5, 7), (0.95, 2), (1.0, 4)])
def test_all_pairs_are_found(spark, similarity, tile):
    sets = families(3)
    df = frame(spark, sets)
    found = setjoin.candidates(df, similarity, Scratch(spark, "t"), tile)
    got = {(r.a, r.b): r.jaccard for r in setjoin.decided(found, df, similarity).collect()}
    want = {(a, b): jaccard(sets[a], sets[b]) for b in sets for a in sets if a < b and sets[a] | sets[b] and jaccard(sets[a], sets[b]) >= similarity}
    assert got == pytest.approx(want) and len(want) > 20


def test_sets_of_one_root_do_not_meet(spark):
    sets, roots = families(4), {k: k % 5 for k in range(170)}
    df = frame(spark, sets, roots)
    for tile in (setjoin.TILE, 4):
        got = {(r.a, r.b) for r in setjoin.decided(setjoin.candidates(df, 0.8, Scratch(spark, "t"), tile), df, 0.8).collect()}
        assert got == {(a, b) for b in sets for a in sets if a < b and roots[a] != roots[b] and sets[a] | sets[b] and jaccard(sets[a], sets[b]) >= 0.8}
    assert setjoin.candidates(frame(spark, sets, dict.fromkeys(sets, 1)), 0.8, Scratch(spark, "t")).count() == 0
    assert setjoin.candidates(df.limit(0), 0.8, Scratch(spark, "t")).count() == 0


def crowd(n=600, planted=40, words=250, edits=5):
    """``n`` texts around one template, mutually at a Jaccard under 0.8; of the first ``planted`` a near copy each."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for k in range(n):
        t = list(base)
        for part in range(edits):  # far apart, so that each edit costs five shingles
            i = part * words // edits + rng.randrange(5, words // edits - 5)
            t[i] = f"n{k}x{i}"
        texts.append(t)
    for k in range(planted):
        t = list(texts[k])
        t[0], t[-1] = f"a{k}", f"b{k}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def grams_of(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_clusters_of_a_crowd_under_the_threshold(spark):
    """All texts of the crowd share most of their bands; only the planted pairs are links, and all of them are found with few candidates."""
    texts = crowd()
    sets = [grams_of(t) for t in texts]
    rng = random.Random(1)
    assert all(jaccard(sets[a], sets[b]) < 0.8 for a, b in (rng.sample(range(600), 2) for _ in range(2000)))
    assert all(jaccard(sets[k], sets[600 + k]) >= 0.8 for k in range(40))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    scratch = Scratch(spark, "t")
    met = dedup.buckets(dedup.banded(df, scratch), scratch)
    many = dedup.crowded(met)
    assert many.count() > 500
    held = dedup.shingle_sets(df, many, scratch).select("node", "grams").selectExpr("node", "node AS root", "grams")
    assert setjoin.candidates(held, 0.8, scratch).count() < 4 * len(texts)
    clusters = {}
    for r in dedup.clusters(df).collect():
        clusters.setdefault(r.cluster_id, set()).add(r.doc_id)
    assert all({k, 600 + k} <= clusters[k] for k in range(40))
    links = {(a, b) for b in range(len(texts)) for a in range(b) if b >= 600 and a != b - 600 and jaccard(sets[a], sets[b]) >= 0.8}
    assert sum(len(c) > 1 for c in clusters.values()) == 40 and not links
    assert {(r.a, r.b) for r in dedup.near_pairs(df, Scratch(spark, "t")).collect()} == {(k, 600 + k) for k in range(40)}
    counted = {r.doc_id: (r.cluster_id, r.links) for r in dedup.link_counts(df).collect()}
    assert all(counted[k] == counted[600 + k] == (k, 1) for k in range(40)) and sum(n for _, n in counted.values()) == 80
