import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fim
from tests import oracle

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "char": r"(?s:.)"}
TEXTS = ["", None, "one", "\n", "\n\n\n", "a\nb", "a\n\n\nb\n", "\n\nx", "<P>", "a <M> b\nc\nd", "<S", "é日😀\nb\r\nc\n" * 40, "<\n<P\nM>\n>", "same\ntext\n", "same\ntext\n"]


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_cuts_are_those_of_listed_units(unit):
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab \n\t\r😀") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for text in texts:
        listed, runs = re.findall(UNITS[unit], text), fim.encode_runs(text, unit)
        assert runs.count == len(listed)
        assert [fim.cut(runs, k) for k in range(len(listed) + 1)] == [len("".join(listed[:k])) for k in range(len(listed) + 1)]
    with pytest.raises(ValueError, match="unknown unit"):
        fim.encode_runs("a", "page")


def plain(key, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(UNITS["line"], text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, m, s = ("".join(lines[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(lines), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


def test_outputs_and_round_trips(spark):
    rows = [(k, t, "mine", k) for k, t in enumerate(TEXTS * 8)] + [(None, "a\nb\nc", None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, form long")
    done = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(done[0].asDict()) == ["back", "doc_id", "form", "middle_chars", "n_units", "output", "prefix_chars", "text"]
    assert {r.form for r in done} == {"plain", "psm", "spm"}
    for r in done:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_rate_order_seed_and_sentinels_are_parameters(spark):
    df = spark.createDataFrame([(k, f"a{k}\nb\nc\n") for k in range(200)], "doc_id long, text string")
    got = {r.doc_id: r for r in fim.transform(df, rate=30, spm=20, seed=3).collect()}
    assert all((got[k].n_units, got[k].form, got[k].prefix_chars, got[k].middle_chars, got[k].output) == plain(k, f"a{k}\nb\nc\n", 30, 20, 3) for k in got)
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    done = fim.transform(df, unit="char", sentinels=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks))
    assert all(r.back == r.text and "<|mid|>" in r.output for r in done.collect())


def test_report_equals_sql(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 5)] + [(None, "x\ny")]
    con = oracle.connect(documents=pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    oracle.same(fim.cut_report(spark.createDataFrame(rows, "doc_id long, text string")), con, fim.oracle())
    assert fim.cut_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
