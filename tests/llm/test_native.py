import random

import pytest

import corpus_pipeline
from corpusloom.llm import line_dedup, mixing, queries
from tests import oracle

SCHEMA = "doc_id long, text string, source string, n_lines long, h1 string"


def documents(spark, n=400, seed=5):
    rng = random.Random(seed)
    common = ["Site menu", "All rights reserved", "x"]
    rows = []
    for i in range(n):
        lines = [f"line {rng.randrange(10**6)}  {rng.choice(['a', 'b c'])}" for _ in range(rng.randint(0, 6))]
        lines += rng.sample(common, rng.randint(0, 2)) + [""] * rng.randint(0, 2)
        source = rng.choice(["big"] * 8 + ["s1", "s2", "é", None])
        rows.append((i, "\n".join(lines) if rng.random() < 0.95 else None, source, 1, "h"))
    rows += [rows[3], rows[3], (None, "Site menu\nlone", "s1", None, None), (n + 1, "w " * 5000, "s2", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_line_dedup_equals_sql(spark):
    df = documents(spark)
    con = oracle.connect(documents=df.toArrow())
    out = line_dedup.drop_boilerplate(df).select("doc_id", "source", "text", "n_lines", "n_dropped")
    oracle.same(out, con, line_dedup.oracle())
    assert out.agg({"n_dropped": "sum"}).first()[0] > 100


def test_line_dedup_salted_path_is_the_same(spark, monkeypatch):
    df = documents(spark)
    plain = oracle.rows_of(df.columns, [tuple(r) for r in line_dedup.drop_boilerplate(df, counts=False).collect()])
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert plain == oracle.rows_of(df.columns, [tuple(r) for r in line_dedup.drop_boilerplate(df, counts=False).collect()])


def test_line_dedup_deals_large_hosts_over_tasks(spark, monkeypatch):
    df = documents(spark)
    plain = oracle.rows_of(df.columns, [tuple(r) for r in line_dedup.drop_boilerplate(df, counts=False).collect()])
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(line_dedup, "PAGES_PER_TASK", 7)
    assert plain == oracle.rows_of(df.columns, [tuple(r) for r in line_dedup.drop_boilerplate(df, counts=False).collect()])


def test_mixed_documents_equal_the_mix_and_reruns_agree(spark):
    df = documents(spark, 300)
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    runs = [oracle.rows_of(df.columns, [tuple(r) for r in mixing.mixed_documents(df.repartition(n)).collect()]) for n in (1, 5)]
    assert runs[0] == runs[1]
    key, text = sorted(df.columns).index("doc_id"), sorted(df.columns).index("text")
    words = {}
    for row, n in runs[0].items():
        words[row[key]] = words.get(row[key], 0) + n * len((row[text] or "").split())
    assert words == {i: n for i, n in taken.items() if n}


@pytest.mark.parametrize("n", [400, 12])
def test_mix_equals_sql(spark, n):
    df = documents(spark, n)
    oracle.same(mixing.mix(df), oracle.connect(documents=df.toArrow()), mixing.oracle())


def test_mix_meets_targets_and_repeats_documents(spark):
    df = documents(spark, 1200)
    rows = mixing.mix(df).collect()
    total = sum(r["size"] for r in rows)
    assert sum({(r["source_size"], r["target"]) for r in rows} and [t for _, t in {(r["source_size"], r["target"]) for r in rows}]) == pytest.approx(total)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() >= sum(r["taken"] // r["size"] for r in rows if r["size"])


def test_empty_tables(spark):
    df = documents(spark).limit(0)
    assert line_dedup.drop_boilerplate(df).count() == mixing.mix(df).count() == mixing.mixed_documents(df).count() == 0


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_mixing"])
def test_registered_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    oracle.same(queries.QUERIES[name](spark, sf), oracle.connect(sf), queries.ORACLES[name])


def test_pipeline_lines_of_a_copy_group_stay(spark):
    """A third of a source are copies of one text; a line of many distinct texts still goes."""
    copy = "copied head\ncopied body"
    rows = [(i, copy, "s") for i in range(50)] + [(100 + i, f"own {i}\nmenu", "s") for i in range(100)]
    rows += [(300 + i, copy if i < 6 else f"lone {i}", "t") for i in range(100)] + [(500 + i, None, "t") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate_lines(spark, docs, "").collect()}
    assert got == {i: f"own {i - 100}" if 100 <= i < 200 else text for i, text, _ in rows}
