import random

import numpy as np

from corpusloom.llm import similar


def test_fingerprint_bits_are_signs_of_sums():
    rng = random.Random(2)
    for size in (1, 4, 300):
        found = np.array([rng.randrange(1 << 64) for _ in range(size)], np.uint64)
        sums = [0] * similar.BITS
        for h in found.tolist():
            for k, (m, a) in enumerate(zip(similar._MULTIPLY.tolist(), similar._ADD.tolist(), strict=True)):
                x = (h * m + a) % (1 << 64)
                x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
                for j, byte in enumerate((x ^ x >> 32).to_bytes(8, "little")):
                    sums[8 * k + j] += 2 * byte - 255
        got = np.unpackbits(similar.fingerprint(found).view(np.uint8), bitorder="little")
        assert [x > 0 for x in sums] == got.astype(bool).tolist()


def test_sets_at_the_limit_share_a_block():
    """1,000 pairs at a Jaccard of exactly 0.8; by the binomial law 0.1 of them are lost."""
    rng, lost = np.random.default_rng(5), 0
    for _ in range(1000):
        found = rng.integers(0, 1 << 63, 100, np.uint64)
        differ = (similar.fingerprint(found[:90]) ^ similar.fingerprint(found[10:])).view(np.uint64)
        bits = np.unpackbits(differ.view(np.uint8), bitorder="little")
        met = any((bits[dealt].reshape(-1, similar.BLOCK).sum(axis=1) == 0).any() for dealt in similar._DEALT)
        lost += not (met and np.bitwise_count(differ[: similar.WORDS]).sum() <= similar.FAR)
    assert lost <= 2


def test_candidates_are_the_near_fingerprints_of_a_bucket(spark):
    rng = np.random.default_rng(8)
    rows, near = [], set()
    for k in range(0, 60, 3):
        base = rng.integers(0, 2, similar.BITS, np.uint8)
        close, far = base.copy(), base.copy()
        close[rng.choice(similar.BITS, 31, replace=False)] ^= 1  # pigeonhole: one block of 32 is spared
        far[: 64 * similar.WORDS : 2] ^= 1
        far[64 * similar.WORDS :] ^= rng.integers(0, 16, similar.BITS - 64 * similar.WORDS) == 0
        rows += [(k + i, np.packbits(x, bitorder="little").view(np.int64).tolist()) for i, x in enumerate((base, close, far))]
        near.add((k, k + 1))
    nodes = spark.createDataFrame(rows, "node long, bands array<long>")
    for deal in (0, similar.DEALS - 1):
        assert {tuple(r) for r in similar.candidates(nodes, [deal]).collect()} == near


def test_pairs_that_links_join_already_are_not_decided_again(spark, monkeypatch):
    decided, alike = [], similar._alike
    monkeypatch.setattr(similar, "_alike", lambda pairs, *rest: decided.append(pairs.count()) or alike(pairs, *rest))
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(w if i != k else f"n{k}" for i, w in enumerate(base))) for k in range(200)]
    assert [r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    assert len(decided) == 2 and decided[0] > 0 and decided[1] == 0
