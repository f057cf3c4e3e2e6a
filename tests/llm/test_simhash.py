import random

import numpy as np
import pytest
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.scratch import Scratch


def plain_fingerprint(text, k=3):
    words = [w for w in bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable over pairs within two bits, by brute force."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_match_plain_ones():
    rng = random.Random(1)
    texts = ["", None, "one", "One two", "a b c", "A b C\x1cd e", " x\n\ty\x0bz  z z z z"]
    texts += ["\n a  b\t\tc d\x0b", "   ", "\t", "x" * 40000, "a " * 30000]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "zz"]) for _ in range(rng.randint(1, 60))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint_of(t) == plain_fingerprint(t)


@pytest.mark.parametrize("dense", [1, 4, 64])
def test_links_close_like_all_pairs(spark, dense):
    rng = random.Random(dense)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {b for b in base}
    for b in base[:3]:
        values |= {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)}
    values |= {base[0] ^ (1 << k) for k in range(16)}
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    scratch = Scratch(spark, "test")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, scratch, dense=dense), scratch).collect()}
    got = [roots.get(simhash._signed(v), simhash._signed(v)) for v in values]
    expected = plain_components(dict(enumerate(values)))
    groups = {}
    for i, g in enumerate(got):
        groups.setdefault(g, []).append(i)
    assert sorted(map(min, groups.values())) == sorted(set(expected.values()))
    assert all(len({expected[i] for i in members}) == 1 for members in groups.values())


def test_crowded_keys_and_hubs_are_met_by_broadcast(spark, monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = sorted({base} | {base ^ 1 << i ^ 1 << j for i in range(14) for j in range(i)} | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    results = []
    for crowd, hub in ((simhash.CROWD, 10_000), (5, 3)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        scratch = Scratch(spark, "test")
        results.append({(r.node, r.root) for r in simhash.components(simhash.links(df, scratch, dense=4), scratch, hub).collect()})
    assert results[0] == results[1] and len({root for _, root in results[0]}) == 1 and len(results[0]) == 91


def test_survivors_do_not_change_between_runs(spark):
    rows = [(1, "same words in here", "a"), (1, "same words in here", "b"), (1, "same words in here", "b"), (None, "same words in here", "a"), (None, None, None), (None, "", "x"), (5, "x y z w", "c")]
    runs = [{tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect()} for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 3


def test_rows_and_survivors(spark):
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(4000))
    texts = {1: "a b c d", 2: "a B c d", 3: None, 4: "", 5: long, 6: long + " 17", 7: "other words are here"}
    rows = [(i, t, "k") for i, t in texts.items()] + [(7, texts[7], "again"), (None, "a b c d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    label = plain_components({i: plain_fingerprint(t) for i, t in texts.items()})
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == label[r.doc_id]
            assert r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}"
        else:
            assert r.component_id == 1
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))
    assert np.all([simhash.near_duplicates(df.limit(0)).count() == 0, simhash.keep_one(df.limit(0)).count() == 0])
