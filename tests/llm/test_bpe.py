import hashlib
import json
import random
from array import array

import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from corpusloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string"
TEXTS = ["", None, "Hello  world", "it's <|endoftext|>!", "a" * 5000, " \n\n x\t\t", "é" * 300, "\x1c\x85 z", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library_on_random_texts(library):
    own, rng = bpe.load(PATH), random.Random(3)
    signs = [chr(c) for c in range(0x180)] + list(" " * 60) + ["'ll", "<|endoftext|>", "日", "😀", "́", "٣", "²"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert list(array("I", packed)) == ids
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_parts_do_not_change_the_ids(monkeypatch, library):
    rng = random.Random(6)
    monkeypatch.setattr(bpe, "PART_CHARS", 7)
    own = bpe.load(PATH)
    for _ in range(400):
        text = "".join(rng.choice(["a", "be", " ", "  ", "\n", "'s", "é", "1", "<|endoftext|>", "\u3000"]) for _ in range(rng.randint(0, 60)))
        packed = own.encode(text)
        assert list(array("I", packed)) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(packed) == text


def test_long_and_short_merges_agree():
    own, rng = bpe.load(PATH), random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("abent ") for _ in range(rng.randint(1, 80))).encode()
        assert own.merge_short(word) == own.merge_long(word)


def test_digests_of_every_row(spark, library):
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(TEXTS)] + [(None, "x", None)], SCHEMA)
    rows = bpe.encode_digests(df, PATH).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = "x" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(TEXTS)], SCHEMA)
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id, r.decoded) for r in back) == [(i, t or "") for i, t in enumerate(TEXTS)]
    assert all(r.n_tokens == len(r.ids) for r in back)


def test_broken_ids_and_empty_table(spark):
    df = spark.createDataFrame([Row(ids=[None, 10**6, 39]), Row(ids=None)], "ids array<int>")
    assert sorted(r.decoded or "" for r in bpe.decode(df, PATH).collect()) == ["", "H"]
    assert bpe.encode_digests(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
    {"model.ignore_merges": True}, {"model.byte_fallback": True}, {"token.lstrip": True},
])
def test_other_settings_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check_settings(spec)
    for name, value in change.items():
        of, _, inner = name.partition(".")
        (spec[of] if of == "model" else spec["added_tokens"][0] if of == "token" else spec)[inner or of] = value
    with pytest.raises(ValueError):
        bpe.check_settings(spec)


def test_decoding_skips_ids_that_stand_for_nothing(spark):
    df = spark.createDataFrame([([15496, -1, None, 10**7, 995], 1), (None, 2), ([], 3)], "ids array<int>, decoded int")
    assert [r.decoded for r in bpe.decode(df, PATH).collect()] == [bpe.load(PATH).decode(array("I", [15496, 995]).tobytes()), None, ""]
