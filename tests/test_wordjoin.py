"""Pairs by shared words, against all pairs; sizes of what is written."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import compose, wordjoin
from corpusloom.operators.evaluate import lcs_length
from corpusloom.sources.scratch import Scratch


def made(seed=5):
    """Lists around a few templates, with edits, repeated words and lengths of 2 to 60."""
    rng, rows = random.Random(seed), []
    for _ in range(30):
        base = [rng.choice(["the", "a", *(f"w{i}" for i in range(60))]) for _ in range(rng.choice([2, 4, 5, 6, 9, 20, 60]))]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 6))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [f"x{rng.randrange(40)}"], [words[at], "the"]])
            rows.append((len(rows), words))
    return rows


@pytest.mark.parametrize(("share", "rounds", "tile"), [(0.8, None, 8192), (0.8, 3, 4), (0.6, 2, 7)])
def test_every_pair_of_enough_words_is_a_candidate(spark, share, rounds, tile):
    rows = [(i, w) for i, w in made() if len(w) >= 2]
    df = spark.createDataFrame(rows, "id long, w array<string>").withColumn("k", F.unhex(F.sha2(F.to_json("w"), 256)))
    scratch = Scratch(spark, "test")
    lists = wordjoin.distinct_lists(df, share, scratch)
    got = [tuple(r) for r in wordjoin.candidates(lists, share, scratch, rounds, tile).collect()]
    one = {}
    for i, w in rows:
        one.setdefault(tuple(w), i)
    want = {(i, j) for (v, i), (w, j) in itertools.combinations(one.items(), 2) if (Counter(v) & Counter(w)).total() >= share * max(len(v), len(w)) - 1e-9}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 20
    assert {(r.id, r.many) for r in lists.collect()} == {(i, sum(tuple(w) == v for _, w in rows)) for v, i in one.items()}


def test_lower_shares_still_ask_for_a_2_gram(spark):
    rows = [(i, w) for i, w in made(6) if len(w) >= 2] + [(900, ["p", "q", "r", "s"]), (901, ["p", "u", "r", "v"])]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    want = {(i, j, lcs_length(v, w)) for (i, v), (j, w) in itertools.combinations(rows, 2) if set(itertools.pairwise(v)) & set(itertools.pairwise(w)) and 2 * lcs_length(v, w) >= max(len(v), len(w))}
    got = [tuple(r) for r in compose.lcs_pairs(df, "id", F.col("w"), 0.5).collect()]
    assert set(got) == want and len(got) == len(want)


def test_texts_without_a_partner_write_one_row_at_most(spark, monkeypatch):
    """Before, each wrote and met a row for each of its rare 2-grams."""
    rng = random.Random(7)
    rows = [(k, [f"w{rng.randrange(400)}" for _ in range(60)]) for k in range(300)]
    rows.append((300, [*rows[0][1][:55], *"vwxyz"]))
    written, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    found = compose.lcs_pairs(spark.createDataFrame(rows, "id long, w array<string>"), "id", F.col("w")).collect()
    assert [tuple(r) for r in found] == [(0, 300, 55)]
    assert max(written.values()) <= 301 and min(written.values()) <= 5, written
