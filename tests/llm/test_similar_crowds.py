import random

import numpy as np

from corpusloom.llm import similar
from tests.llm.test_similar import jaccard


def test_a_crowd_of_texts_that_are_near_and_not_alike_makes_no_pairs(spark, monkeypatch):
    """300 texts around one template, hardly any two alike, among them 20 that are a near copy of one."""
    rng, base = random.Random(3), [f"w{i}" for i in range(150)]
    texts = [" ".join(f"n{rng.randrange(10**9)}" if i % 30 == k % 30 or i % 37 == k % 37 else w for i, w in enumerate(base)) for k in range(280)]
    texts += [t + f" end{k}" for k, t in enumerate(texts[:20])]
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                old, new = sorted((label[i], label[j]))[::-1]
                label = [new if x == old else x for x in label]
    assert len(set(label)) > 200
    decided, alike = [], similar._alike
    monkeypatch.setattr(similar, "_alike", lambda pairs, *rest: decided.append(pairs.count()) or alike(pairs, *rest))
    got = similar.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label))
    assert sum(decided) < 3 * len(texts)


def crowd_of_fingerprints(n):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, similar.BITS, np.uint8)
    for k in range(n):
        bits = base.copy()
        bits[rng.choice(similar.BITS, 8, replace=False)] ^= 1
        yield k, np.packbits(bits, bitorder="little").view(np.int64).tolist()


def test_every_pair_of_a_small_bucket_is_found_but_those_of_one_root(spark):
    n = similar.LIMIT
    nodes = spark.createDataFrame([(k, bands, k // 2) for k, bands in crowd_of_fingerprints(n)], "node long, bands array<long>, root long")
    every = {(a, b) for b in range(n) for a in range(b)}
    assert {tuple(r) for r in similar.candidates(nodes.drop("root"), [0]).collect()} == every
    apart = {(a, b) for a, b in every if a // 2 != b // 2}
    assert {tuple(r) for r in similar.candidates(nodes, [0]).collect()} == apart
    assert {tuple(r) for r in similar.candidates(nodes, [0], "ends").collect()} == {(k, 0) for k in range(n)}
    some = nodes.withColumn("known", (nodes.node % 3).cast("long"))
    assert {tuple(r) for r in similar.candidates(some, [0], "ends").collect()} == {(k, 0) for k in range(0, n, 3)}
    assert similar.candidates(nodes, [0], "chain").count() <= n * similar.CHAINED


def test_larger_buckets_of_several_roots_are_named_and_give_their_nodes(spark):
    n = 5 * similar.LIMIT
    rows = [(k, bands, 0) for k, bands in crowd_of_fingerprints(n)]
    schema = "node long, bands array<long>, root long"
    joined = spark.createDataFrame(rows, schema)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    for batch in ("30", before):  # buckets that go on over batches
        spark.conf.set(setting, batch)
        assert similar.candidates(joined, [0], "ends").count() == 0
        one_apart = spark.createDataFrame([(k, bands, 1 if k == 7 else r) for k, bands, r in rows], schema)
        marks = [tuple(r) for r in similar.candidates(one_apart, [0], "ends").collect()]
        assert marks and {b for _, b in marks} <= {0, 1} and any(b == 1 for _, b in marks)
        crowded = spark.createDataFrame([(a,) for a, b in marks if b == 1], "bucket long")
        found = {r.node for r in similar.nodes_of_buckets(one_apart, crowded).collect()}
        assert 7 in found and len(found) > 0.9 * n
    spark.conf.set(setting, before)


def test_sketches_differ_in_no_more_bits_than_their_sets():
    rng = np.random.default_rng(7)
    for size in (0, 1, 9, 150, 3000):
        found = rng.integers(0, 1 << 63, size + size // 5, np.uint64)
        one, other = found[:size], found[size // 5 :]
        x, y = similar.odd_sketch(one), similar.odd_sketch(other)
        assert x[0] == len(one) and len(x) == len(similar.ODD_NAMES)
        assert int(np.bitwise_count((x[1:] ^ y[1:]).view(np.uint64)).sum()) <= len(np.setxor1d(one, other))


def test_sets_at_the_limit_pass_the_whole_fingerprint():
    """1,000 pairs at a Jaccard of exactly 0.8, long and very short."""
    rng = np.random.default_rng(15)
    for size, step in ((100, 10), (5, 1)):
        sets = [(rng.integers(0, 1 << 63, size, np.uint64), step) for _ in range(1000)]
        pairs = [(s[:-1], s) if size == 5 else (s[:-step], s[step:]) for s, step in sets]
        differ = [int(np.bitwise_count((similar.fingerprint(a) ^ similar.fingerprint(b)).view(np.uint64)).sum()) for a, b in pairs]
        assert max(differ) <= similar.FAR_ALL
