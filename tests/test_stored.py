"""Sorted tables, stored postings, sketches, versioned states, pinned files."""

import math
import random
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import retrieval, sketches, textindex
from corpusloom.operators.textindex import TextIndex
from corpusloom.operators.versions import Stale, VersionedTable
from corpusloom.plans import catalogue
from corpusloom.sources import files, ranges
from corpusloom.sources.scratch import Scratch

SF = "/root/testdata/sf0.001"


# -- sorted tables


def test_lookups_open_only_the_files_of_their_ranges(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(5000), k) for k in range(6000)] + [(None, -1), (77, -2), (77, -2)]
    df = spark.createDataFrame(rows, "k long, v long")
    path = f"{tmp_path}/t"
    ranges.write_sorted(df, path, "k", files=20)
    total = len(ranges.manifest(spark, path))
    assert total == 20
    asked = [(70, 80), (75, 90), (4000, 4000), (3, 1), (None, 5), (9000, 9999), (4990, 9000), (70, 80)]
    got = ranges.lookup(spark, path, spark.createDataFrame(asked, "lo long, hi long"), "k", Scratch(spark, "t"))
    want = [r for r in rows if r[0] is not None and any(lo is not None and lo <= r[0] <= hi for lo, hi in asked)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    met = ranges.files_of_ranges(spark, ranges.manifest(spark, path), spark.createDataFrame(asked, "lo long, hi long"))
    assert 3 <= met.select("number").distinct().count() <= 6
    assert len(got.inputFiles()) <= 6 + 8  # table files opened, and those of the small table of ranges
    none = spark.createDataFrame([(9, 1)], "lo long, hi long")
    assert ranges.lookup(spark, path, none, "k", Scratch(spark, "t")).count() == 0


def test_lookups_by_text_keys_and_unsorted_tables(spark, tmp_path):
    words = [f"{c}{i:02d}" for c in "abcé日" for i in range(40)]
    df = spark.createDataFrame([(w,) for w in words], "k string")
    ranges.write_sorted(df, f"{tmp_path}/s", "k", files=6)
    asked = spark.createDataFrame([("b", "b￿"), ("é05", "é07")], "lo string, hi string")
    got = [r.k for r in ranges.lookup(spark, f"{tmp_path}/s", asked, "k", Scratch(spark, "t")).collect()]
    assert sorted(got) == sorted([w for w in words if w[0] == "b"] + ["é05", "é06", "é07"])
    df.repartition(3).write.parquet(f"{tmp_path}/u")
    ranges.write_manifest(spark, f"{tmp_path}/u", "k")
    with pytest.raises(ValueError, match="not sorted"):
        ranges.manifest(spark, f"{tmp_path}/u")


# -- stored postings


def ranking(df):
    return sorted((r["item"], r.doc_id, round(r.score, 6), r.position) for r in df.collect())


def test_an_index_is_reused_extended_and_merged(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "no id the of"), (9001, None), (9002, "the same and of"), (9002, "the same and of")], docs.schema))
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    parts = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0 OR doc_id IS NULL")]
    index = TextIndex(spark, f"{tmp_path}/index", f"{tmp_path}/source")
    read = []
    index.tokens = lambda c: read.append(1) or X.words(c)
    parts[0].repartition(2).write.mode("append").parquet(f"{tmp_path}/source")
    assert index.refresh() == {"reused": 0, "read": 2, "gone": 0} and len(read) == 1
    assert ranking(index.bm25(asked)) == ranking(retrieval.bm25(parts[0], asked))
    before = len(read)
    assert index.refresh() == {"reused": 2, "read": 0, "gone": 0} and len(read) == before  # nothing is cut into words again
    parts[1].coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    assert index.refresh() == {"reused": 2, "read": 1, "gone": 0}
    full = ranking(retrieval.bm25(docs, asked))
    assert ranking(index.bm25(asked)) == full and index.catalogue().select("segment").distinct().count() == 2
    assert ranking(index.sparse_products(asked)) == ranking(retrieval.sparse_products(docs, asked))
    assert not index.merge() and index.merge(at_most=1) and index.catalogue().select("segment").distinct().count() == 1
    assert ranking(index.bm25(asked)) == full
    assert TextIndex(spark, f"{tmp_path}/index", f"{tmp_path}/source").refresh() == {"reused": 3, "read": 0, "gone": 0}


def test_words_are_counted_where_they_lie_and_looked_up_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(1, 10, ["b", "a", "b", None]), (1, 11, []), (2, 12, ["a"])], "doc_id long, row long, w array<string>")
    counted = textindex._counted(docs)
    want = {("a", 1, 10, 4, 1), ("b", 1, 10, 4, 2), (None, 1, 10, 4, 0), (None, 1, 11, 0, 0), ("a", 2, 12, 1, 1), (None, 2, 12, 1, 0)}
    assert {tuple(r) for r in counted.collect()} == want and counted.count() == len(want)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([(1, "b a b"), (2, "a c")], "doc_id long, text string").write.parquet(f"{tmp_path}/source")
    index = TextIndex(spark, f"{tmp_path}/index", f"{tmp_path}/source")
    index.refresh()
    found = index.postings(["a", "b"])
    assert {(r.term, r.doc_id, r.tf, r.dl) for r in found.collect()} == {("a", 1, 1, 3), ("b", 1, 2, 3), ("a", 2, 1, 2)}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and index.totals() == (2, 2.5)


def test_changed_and_removed_files_are_indexed_anew(spark, tmp_path):
    rows = [(k, f"word{k} common") for k in range(8)]
    for k in range(4):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/source/p{k}")
    index = TextIndex(spark, f"{tmp_path}/index", f"{tmp_path}/source")
    assert index.refresh()["read"] == 4
    shutil.rmtree(f"{tmp_path}/source/p1")
    spark.createDataFrame([(40, "common again"), (41, "new")], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/source/p3")
    assert index.refresh() == {"reused": 0, "read": 3, "gone": 2}
    asked = spark.createDataFrame([(1, "common"), (2, "word2"), (3, "again")], "item_id long, text string")
    got = ranking(index.bm25(asked))
    assert {(i, d) for i, d, *_ in got} == {(1, 0), (1, 1), (1, 4), (1, 5), (1, 40), (3, 40)}
    assert index.totals() == (6, 11 / 6)
    empty = TextIndex(spark, f"{tmp_path}/other", f"{tmp_path}/source")
    assert empty.bm25(asked).count() == 0 and empty.totals() == (0, 0.0)


# -- sketches


def test_sketches_of_shards_unite_to_that_of_the_whole(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    value = F.concat_ws(":", "user_id", "event_id")
    shards, whole = sketches.build(events, "event_type", value), sketches.build(events.withColumn("one", F.lit(1)), "one", value)
    n = events.select(value).distinct().count()
    assert all(sketches.count(table).first().distinct == pytest.approx(n, rel=0.06) for table in (shards, whole))
    some = sketches.count(shards, F.col("shard").isin("click", "error")).first()
    assert some.distinct == pytest.approx(events.where("event_type IN ('click', 'error')").select(value).distinct().count(), rel=0.06)
    halves = [sketches.build(events.where(f"event_id % 2 = {k}"), "event_type", value) for k in range(2)]
    both = {r.shard: (r.rows, r.n) for r in sketches.append(*halves).select("shard", "rows", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    built = {r.shard: (r.rows, r.n) for r in shards.select("shard", "rows", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    assert both.keys() == built.keys() and all(both[k][0] == built[k][0] and both[k][1] == pytest.approx(built[k][1], rel=0.06) for k in built)
    assert sketches.count(sketches.build(events.limit(0), "event_type", value)).first() == (0, 0, 0)


def test_query_of_shard_sketches(spark):
    users = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type", "user_id").collect():
        users[r.event_type].add(r.user_id)
    for r in catalogue.QUERIES["shard_sketches"](spark, SF).collect():
        assert r.users == pytest.approx(len(users[r.a] | users[r.b]), rel=0.06)


def test_overlaps_are_exact_while_all_hashes_are_kept_and_near_beyond(spark):
    rng = random.Random(3)
    held = {s: {rng.randrange(900) for _ in range(500)} for s in "abc"} | {"d": set(range(5000, 5400)), "e": set(range(3000)), "f": set(range(1000, 4000))}
    df = spark.createDataFrame([(s, v) for s, vs in held.items() for v in vs] + [("a", None), (None, 3)], "s string, v long")
    got = {(r.a, r.b): r.jaccard for r in sketches.overlaps(sketches.bottom(df, "s", F.col("v")).where("shard IS NOT NULL")).collect()}
    for (a, b), j in got.items():
        exact = len(held[a] & held[b]) / len(held[a] | held[b])
        assert j == pytest.approx(exact) if len(held[a] | held[b]) <= sketches.BOTTOM else abs(j - exact) < 3 / math.sqrt(sketches.BOTTOM)
    assert ("a", "b") in got and ("e", "f") in got and not any("d" in k for k in got)


def test_query_of_source_overlaps(spark):
    words = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("source", X.words(F.col("text")).alias("w")).collect():
        words[r.source] |= set(r.w)
    for r in catalogue.QUERIES["source_overlaps"](spark, SF).collect():
        assert abs(r.jaccard - len(words[r.a] & words[r.b]) / len(words[r.a] | words[r.b])) < 4 / math.sqrt(sketches.BOTTOM)


# -- versioned states


def test_transitions_are_guarded_and_taken_back(spark, tmp_path):
    states = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    states.create(spark.createDataFrame([(k, "new", None) for k in range(6)], "k long, status string, note string"))
    change = spark.createDataFrame([(1, "done", "x"), (2, "done", None), (9, "added", "y")], "k long, status string, note string")
    seen = states.digest(change)
    assert states.apply(change, seen) == 1
    with pytest.raises(Stale):
        states.apply(change, seen)
    assert {r.k: r._absent for r in states.log(1).collect()} == {1: False, 2: False, 9: True}
    other = spark.createDataFrame([(5, "held", None)], "k long, status string, note string")
    assert states.apply(other, states.digest(other)) == 2
    assert states.rollback(1) == 3  # the rows of version 1 have not been touched since
    assert {r.k: r.status for r in states.read().collect()} == {0: "new", 1: "new", 2: "new", 3: "new", 4: "new", 5: "held"}
    with pytest.raises(Stale):
        states.rollback(1)
    assert states.rollback(3) == 4 and {r.k for r in states.read().collect()} == {0, 1, 2, 3, 4, 5, 9}
    assert states.apply(change.limit(0), states.digest(change.limit(0))) == 4
    twice = change.unionByName(change)
    with pytest.raises(ValueError, match="not unique"):
        states.apply(twice, states.digest(twice))
    with pytest.raises(ValueError, match="there already"):
        states.create(change)


# -- pinned files and archives


def test_recorded_files_are_checked_before_use(spark, tmp_path):
    folder, ledger = f"{tmp_path}/f", f"{tmp_path}/ledger"
    for k in range(3):
        spark.createDataFrame([(k,)], "v long").coalesce(1).write.parquet(f"{folder}/p{k}")
    files.record(spark, ledger, "r1", folder)
    assert sorted(r.v for r in files.read_recorded(spark, ledger, "r1").collect()) == [0, 1, 2]
    spark.createDataFrame([(9,)], "v long").coalesce(1).write.parquet(f"{folder}/p9")
    assert files.read_recorded(spark, ledger, "r1").count() == 3  # a file that came later is no input of the run
    shutil.rmtree(f"{folder}/p1")
    spark.createDataFrame([(7,)], "v long").coalesce(1).write.parquet(f"{folder}/p1")
    with pytest.raises(ValueError, match="differ"):
        files.read_recorded(spark, ledger, "r1")
    with pytest.raises(ValueError, match="not in the ledger"):
        files.read_recorded(spark, ledger, "r2")
