import random

from corpusloom.llm import similar
from tests.llm.test_simhash import plain_fingerprint

import corpus_pipeline


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_drops_near_copies_that_simhash_bits_miss(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for edits in (0, 1, 3, 9):
            words = list(base)
            for i in rng.sample(range(10, 190), edits):
                words[i] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["", None, "one two", "One  TWO", "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = list(range(len(texts)))
    missed = 0
    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if jaccard(a or "", b or "") >= 0.8 if (a or b) and (a and b) else (not a and not b):
                missed += (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() > 2
                old, new = label[i], label[j]
                label = [min(old, new) if x in (old, new) else x for x in label]
    assert missed > 10
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label))


def test_a_crowd_of_near_copies_is_one_group_without_all_pairs(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(w if i != k % 300 else f"n{k}" for i, w in enumerate(base))) for k in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in similar.keep_one(df).collect()] == [0]
    held = similar._with_bands(df, "text").selectExpr("_loom_node AS node", "_loom_bands AS bands")
    assert similar.candidates(held, [0], "chain").count() <= 600 * similar.CHAINED
    assert similar.candidates(held).count() <= 600 * similar.BANDS * similar.LIMIT / 2
    marks = [r.b for r in similar.candidates(held, how="ends").collect()]
    assert 0 < marks.count(1) <= 600 * similar.BANDS / similar.LIMIT and marks.count(0) <= 600


def test_reruns_agree_on_repeated_rows(spark):
    text = "one two three four five six seven"
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "c"), (2, text, "c"), (None, text, "a"), (None, None, "a"), (None, "", "b"), (9, "alone", "z")]
    runs = [sorted(map(tuple, similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect()), key=str) for n in (1, 2, 5)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 3 and [r[0] for r in runs[0]].count(2) == 1
