import hashlib
import random
import struct
import unicodedata
from collections import Counter

import numpy as np
import pytest
import xxhash

from corpusloom.llm import imatch


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    return {7 * i: " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 80, 400]))) for i in range(n)}


def test_report_over_every_row(spark, monkeypatch):
    docs = texts(300)
    docs[21] = None
    docs[14] = docs[28] = "Same text, TWICE over."
    docs[35] = "y" * 30000
    rows = [(i, t, "x") for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in imatch.edit_report(df).collect()}
    order = sorted(docs)
    assert sorted(got) == order
    for k, i in enumerate(order):
        text, after = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        q = len(text) // 4
        changed = text[: len(text) - q] + after[:q]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        following = got[order[(k + 1) % len(order)]]
        assert got[i].near_next == imatch.likeness(got[i].fingerprint, following.fingerprint)
    assert got[14].fingerprint == got[28].fingerprint
    long = [got[i] for i in order if len(docs[i] or "") > 1000 and i != 35]
    assert np.mean([r.near_edited > 0.3 for r in long]) > 0.9
    assert np.mean([r.near_next < 0.25 for r in long]) > 0.9


def plain_terms(text):
    words, word = set(), ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LNM":
            word += c
        elif word:
            words.add(word)
            word = ""
    out = set()
    for w in words:
        h = sum(ord(c) * pow(imatch._BASE, i, 1 << 64) for i, c in enumerate(w)) % (1 << 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ h >> shift) * factor % (1 << 64)
        out.add(h)
    return out


def plain_fingerprint(text, lexicon):
    found = plain_terms(text)
    found = sorted(found & lexicon or found)
    digest = lambda terms: xxhash.xxh64_intdigest(b"".join(struct.pack("<Q", t) for t in terms))
    out, k = f"{digest(found):016x}", 0
    for density, number in imatch.DENSITIES:
        for _ in range(number):
            seed, own = xxhash.xxh64_intdigest(b"lexicon %d" % k), []
            for t in found:
                h = t ^ seed
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    h = (h ^ h >> shift) * factor % (1 << 64)
                if h < int(density * 2.0**64):
                    own.append(t)
            out += f"{min(len(own), 15) << 16 | (digest(own) & 0xFFFF if own else 0):05x}"
            k += 1
    return out


def test_fingerprints_equal_plain_ones(spark):
    docs = {**texts(150, 3), 2: None, 4: "", 5: "naïve—«mot»\u00a0x y", 6: "Ünï " * 3, 8: "only here once"}
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    held = Counter(t for text in docs.values() for t in plain_terms(text))
    lexicon = {t for t, n in held.items() if max(imatch.MIN_DOCS, imatch.LOW * len(docs)) <= n <= max(imatch.MIN_DOCS, imatch.HIGH * len(docs))}
    assert set(imatch.lexicon(df).tolist()) == lexicon
    for r in imatch.fingerprints(df).collect():
        assert r.fingerprint == plain_fingerprint(docs[r.doc_id], lexicon)


def test_punctuation_of_any_script_ends_a_word():
    assert len(imatch.terms("word—word «word» word\u00a0word")) == 1
    assert imatch.terms("x" * ((1 << 20) + 5)).size == 1


def test_segments_of_any_size_give_the_same_terms(monkeypatch):
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice("ab cdé—« »1İΣ.\u0301") for _ in range(rng.randint(0, 70)))
        assert set(imatch.terms(text).tolist()) == plain_terms(text)
        for n in range(1, 51):
            monkeypatch.setattr(imatch, "SEGMENT", n)
            assert set(imatch.terms(text).tolist()) == plain_terms(text)


def test_one_id_with_most_rows_is_cut_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 25)
    rows = [(None, f"null {k}") for k in range(200)] + [(7, f"seven {k}") for k in range(200)] + [(k, f"t {k}") for k in range(100, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = imatch._neighbours(df, "doc_id", "text")
    assert dealt.where("key = 7 AND last = 0").select("part").distinct().count() > 3
    got = imatch.edit_report(df).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    with pytest.raises(TypeError):
        imatch.edit_report(df.withColumn("doc_id", df.doc_id.cast("string")))


def test_ranges_do_not_change_the_result(spark, monkeypatch):
    df = spark.createDataFrame(list(texts(200).items()) + [(None, "no id"), (0, "again"), (1393, "last again")], "doc_id long, text string")
    whole = sorted(map(tuple, imatch.edit_report(df).collect()), key=str)
    monkeypatch.setattr(imatch, "RANGE_ROWS", 20)
    assert sorted(map(tuple, imatch.edit_report(df).collect()), key=str) == whole


def test_frequencies_and_lexicon(spark):
    df = spark.createDataFrame([("a b b, c",), ("B. d",), (None,), ("",)], "text string")
    got = {r.term: r.docs for r in imatch.document_frequencies(df).collect()}
    key = lambda w: int(imatch.terms(w).view(np.int64)[0])
    assert got == {key("a"): 1, key("b"): 2, key("c"): 1, key("d"): 1}
    assert imatch.lexicon(df).view(np.int64).tolist() == [key("b")]


def test_terms_do_not_depend_on_segments(monkeypatch):
    text = "Ünï code, words-and 12 numbers! " * 50 + "x" * 300
    whole = imatch.terms(text)
    assert len(whole) == 7 + 0
    assert imatch.terms("NUMBERS 12 and words code ünï " + "x" * 300).tolist() == whole.tolist()
    monkeypatch.setattr(imatch, "SEGMENT", 310)
    assert imatch.terms(text).tolist() == whole.tolist()
    rng = random.Random(8)
    many = {"".join(rng.choices("abcdefghé", k=rng.randint(1, 12))) for _ in range(20000)}
    assert len(imatch.terms(" ".join(many))) == len(many)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, "only one text here, four parts")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = imatch.edit_report(df).collect()
    assert len(got) == len(rows)
    assert imatch.fingerprints(df).count() == len(rows)
    if rows:
        assert got[0].near_next == 1.0
