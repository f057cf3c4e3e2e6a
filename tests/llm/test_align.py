import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusloom.llm import align, bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, "one", "Hello  world, these are unusualized tokens.", " leading", "tabs\tand\n\nlines ", "naïve café 日本語 😀", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "a▁b", "▁", "x" * 3000, "ab" * 40, " ", "  \n", "same words here", "same words here", "1234567890 3.14", "\x00\x01 nul", "é combining", "﻿mark", "the of and the of and",
]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(libraries, text):
    """Groups of (left ids, right ids) by sets of byte borders; None without tokens."""
    t, sp = libraries
    if not text:
        return None
    a, b, vocab = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), bpe.byte_alphabet()
    left = [bytes(vocab[c] for c in t.id_to_token(i)) for i in a]
    right = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
        return None
    spans = []
    for side in (left, right):
        ends, at = [], 0
        for x in side:
            at += len(x)
            ends.append(at)
        spans.append(ends)
    common, groups, i, j = sorted(set(spans[0]) & set(spans[1])), [], 0, 0
    for end in common:
        x, y = spans[0].index(end) + 1, spans[1].index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def plain_report(libraries, texts):
    every = [plain_groups(libraries, t) for t in texts]
    links = [[(x, y) for one, other in g or [] for x in one for y in other] for g in every]
    counts = Counter(p for found in links for p in set(found))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for g, found in zip(every, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(found), sum(counts[p] == most[p[0]] for p in found),
                    sum(counts[p] for p in found), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out


def random_texts(n):
    rng = random.Random(8)
    signs = list("abcdefghijklmnopqrstuvwxyz" * 3 + " " * 25 + "\n\t.,'<>éß日語😀▁\x00") + ["ing ", "tion", "the ", "ization", "    "]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 0])
def test_report_against_brute_force(spark, libraries, monkeypatch, frequent):
    texts = TEXTS + (random_texts(150) if frequent else [])
    df = spark.createDataFrame([(k % 30 if k % 7 else None, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, n_a long")
    got = align.alignment_report(df, A, B, frequent=frequent).collect()
    want = [(k % 30 if k % 7 else None, *r) for k, r in enumerate(plain_report(libraries, texts))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r.n_a == 0 and r.doc_id is not None for r in got) and max(r.count_sum for r in got) > 0


def test_left_ids_lose_no_byte_and_are_those_of_both_encoders():
    own = align.load(A, B)
    for text in [*TEXTS, *random_texts(300), "\x85 \u2028x", "\u3000\u3000a"]:
        ids = own.left_ids(text or "")
        assert b"".join(own.left[k] for k in ids).decode() == (text or "")
        assert ids == np.frombuffer(own.byte_bpe.ordinary(text or ""), np.uint32).tolist()


def test_wide_groups_are_multiplied(monkeypatch):
    own = align.load(A, B)
    for text in ["x" * 300, "ab" * 40, *random_texts(60)]:
        narrow = own.align(text)
        monkeypatch.setattr(align, "WIDE", 0)
        wide = own.align(text)
        monkeypatch.undo()
        assert narrow[:5] == wide[:5] and dict(zip(*map(list, narrow[5:]), strict=True)) == dict(zip(*map(list, wide[5:]), strict=True))


def test_transducer_keeps_only_suffixes_and_may_forget(monkeypatch):
    left, right = [b"a", b"ab", b"abc", b"bc"], [b"a", b"b", b"c", b"bca"]
    t = align.Transducer(left, right)
    for _ in range(2):
        assert t.groups([1, 2], [0, 1, 0, 1, 2]).said == ["1|0,1", "2|0,1,2"]
        assert t.groups([0, 3, 0], [0, 3]).said == ["0|0", "3,0|3"]
        assert t.groups([2], [0, 1]) is t.groups([0], [0, 1]) is t.groups([0], [1]) is t.groups([0, 0], [0]) is t.groups([], [0]) is None
        assert t.groups([], []) == ([], [], [])
    suffixes = {x[k:] for side in (left, right) for x in side for k in range(len(x) + 1)}
    assert {r for _, r in t.states} <= suffixes
    monkeypatch.setattr(align, "MEMO", 0)
    assert t.groups([1, 2], [0, 1, 0, 1, 2]).said == ["1|0,1", "2|0,1,2"]


def test_empty_table(spark):
    assert align.alignment_report(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
