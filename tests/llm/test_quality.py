import base64
import random
import re
from collections import Counter

import pytest
import zstandard

from corpusloom.llm import quality

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("etaoinshrdlucmf") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(VOCABULARY[min(int(rng.expovariate(1 / 300)), 2999)] + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = text.split("\n")
    repeats = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)

    def ok(raw):
        ratio = len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw)
        low, high = next(b[1:] for b in quality.BANDS if len(raw) < b[0])
        return low <= ratio <= high

    raw = text.encode()
    chunks = [c for c in (raw[k : k + 4096] for k in range(0, len(raw), 4096)) if len(c) >= 512]
    stray = sum(len(c) for c in chunks if not ok(c)) / max(1, sum(map(len, chunks)))
    kept = not failed and ok(raw) and stray <= 0.25
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), failed, kept


def noise(n, seed):
    return base64.b64encode(random.Random(seed).randbytes(n)).decode()


CASES = {
    "": False,
    None: False,
    "a b a b": False,
    "  \n\t ": False,
    prose(40, 1): False,
    prose(60, 2): True,
    prose(300, 3): True,
    prose(20_000, 4): True,
    " ".join(noise(60, k) for k in range(80)): False,  # incompressible words
    prose(3000, 5) + " ".join(noise(60, k) for k in range(400)): False,  # incompressible second half
    " ".join(f"row {k} of table" for k in range(400)): False,  # no window comes twice, yet all is alike
    prose(4000, 6) + "\n" + "\n".join(f"{k} item" for k in range(8000)): False,
    (prose(30, 7) + "\n") * 50: False,
    "日本語 の 文章 é | # " * 3 + prose(200, 8): True,
}


def test_verdicts_against_brute_force(spark):
    rows = [(k, t, 1) for k, t in enumerate([*CASES, *CASES])] + [(None, prose(90, 9), 2)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert len(got) == len(rows)
    texts = {k: t for k, t, _ in rows}
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == plain(text)
        if r.doc_id is not None:
            assert r.kept == CASES[text], (r, (text or "")[:80])
    assert {r.ratio is None for r in got if r.n_words == 0} == {True, False}


def test_repeated_words_of_random_sequences():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        assert quality.repeated_words(words) == plain(" ".join(words))[4]


def test_limits_are_a_parameter(spark):
    df = spark.createDataFrame([(1, prose(300, 3))], "doc_id long, text string")
    assert quality.judge(df, bands=((1 << 20, 0.9, 1.0),)).first().kept is False
    assert quality.judge(df, bands=((100, 0.9, 1.0), (200, 0.0, 1.0))).first().kept is True  # the last band goes on
    with pytest.raises(ValueError, match="rise"):
        quality.judge(df, bands=((200, 0.0, 1.0), (100, 0.0, 1.0)))
    assert quality.judge(df.limit(0)).collect() == []
