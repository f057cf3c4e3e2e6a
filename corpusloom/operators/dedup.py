"""Exact and near duplicates of documents.

Exact classes come first: equal normalised texts share a key, and only one
representative of each class goes further, so mass copies never meet in pairs.
Near duplicates are pairs of representatives whose sets of five-word shingles
have a Jaccard similarity of at least 0.8; MinHash bands propose candidates,
the sets decide.  Shingles are 64-bit hashes from the start.

Null text is the empty text; empty texts, by themselves, are no copies of each
other; documents of fewer than 50 words and without id take no part in near
links; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions.normal import exact_key, metric_normal
from ..sources.scratch import Scratch, few_rows
from . import graph, setjoin
from .grams import grams, lists, word_hashes
from .skew import join_counted, spread

SHINGLE, SIMILARITY, MIN_WORDS = 5, 0.8, 50
PERMUTATIONS, BANDS = 128, 32
SHORT, TEMPLATE_DOCS, TEMPLATE_TITLES = 100, 3, 0.8
#: Documents in a band's bucket beyond which they go through the set join, the neighbours that they meet before, and from how many on the bucket's row is broadcast.
CROWD, STEP, HOT = 64, 6, 100_000


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its class: (doc_id, representative (the smallest id), copies).  Texts without a sign are no copies: each is its own class."""
    keyed = docs.select(F.col(key), exact_key(F.col(text)).alias("k"))
    with few_rows(docs.sparkSession):
        keyed = Scratch(docs.sparkSession, "exact").save(keyed, "keys")
    own = keyed.where("k IS NULL").select(key, F.col(key).alias("representative"), F.lit(1).cast("long").alias("copies"))
    keyed = keyed.where("k IS NOT NULL")
    classes = keyed.groupBy("k").agg(F.min(key).alias("representative"), F.count("*").alias("copies"))
    return join_counted(keyed, classes, ["k"], "copies", HOT).select(key, "representative", "copies").unionByName(own)


def _signature(found: np.ndarray) -> np.ndarray:
    """The least of the gram hashes under each permutation."""
    rng = np.random.default_rng(42)
    a, b = rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[at : at + 1024, None] * a + b) >> np.uint64(20)).min(axis=0))
    return least


def _hashed(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(doc_id, w, ...): hashes of the words of the normalised texts that have enough words."""
    words = word_hashes(X.words(metric_normal(F.coalesce(F.col(text), F.lit("")))))
    return spread(docs.select(key, text)).select(F.col(key).cast("long").alias("doc_id"), words.alias("w"), *more).where((F.size("w") >= MIN_WORDS) & F.col("doc_id").isNotNull())


def banded(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written (doc_id, bands) of one document of each exact class that has enough words: a key for each band of a MinHash signature.

    Texts are read where they lie; what is grouped are ids, keys and bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = lists(batch.column(1))
            rows = []
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                least = _signature(np.unique(grams(words[s:e], SHINGLE)))
                rows.append([xxhash.xxh64_intdigest(part.tobytes()) >> 1 for part in least.reshape(BANDS, -1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "bands", "k"])

    rows = _hashed(docs, key, text, exact_key(F.col(text)).alias("k")).mapInArrow(run, "doc_id long, bands array<long>, k string")
    one = rows.groupBy("k").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("doc_id"))
    with few_rows(docs.sparkSession):
        return scratch.save(one.select("doc_id", "bands"), "bands")


def buckets(bands: DataFrame, scratch: Scratch) -> DataFrame:
    """Written (doc_id, band, key, other, members): the entries of each band's bucket that several documents share; ``other`` is the key of the next band."""
    entries = bands.select("doc_id", F.posexplode("bands").alias("band", "key"), F.col("bands").alias("_b"))
    entries = entries.select("doc_id", "band", "key", F.element_at("_b", (F.col("band") + 1) % BANDS + 1).alias("other"))
    shared = entries.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    return scratch.save(join_counted(entries, shared, ["band", "key"], "members", HOT), "buckets")


def pairs_in_buckets(met: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct (a, b), a < b, of documents that meet in a bucket of at most ``crowd``."""
    few = met.where(F.col("members") <= crowd)
    left = few.select("band", "key", F.col("doc_id").alias("a"))
    return left.join(few.select("band", "key", F.col("doc_id").alias("b")), ["band", "key"]).where("a < b").select("a", "b").distinct()


def chains(met: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct (a, b), a < b: in larger buckets each document with its next ``STEP`` in the order of another band.  They join most of a crowd with few pairs."""
    order = W.partitionBy("band", "key").orderBy("other", "doc_id").rowsBetween(1, STEP)
    many = met.where(F.col("members") > crowd).select(F.col("doc_id").alias("a"), F.collect_list("doc_id").over(order).alias("next")).select("a", F.explode("next").alias("b"))
    return many.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def crowded(met: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The documents in larger buckets: all pairs of them are found by ``setjoin``."""
    return met.where(F.col("members") > crowd).select("doc_id").distinct()


def shingle_sets(docs: DataFrame, asked: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written (node, grams, signature) of the documents ``asked`` (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = lists(batch.column(1))
            sets = [np.unique(grams(words[s:e], SHINGLE)) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], kind), pa.array([_signature(x).view(np.int64) for x in sets], kind)], ["node", "grams", "signature"])

    wanted = docs.join(asked.withColumnRenamed("doc_id", "_id"), F.col(key).cast("long") == F.col("_id"), "left_semi")
    made = _hashed(wanted, key, text).mapInArrow(run, "node long, grams array<long>, signature array<long>").dropDuplicates(["node"])
    with few_rows(docs.sparkSession):
        return scratch.save(made, "sets")


def _asked(pairs: DataFrame, *more: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    return reduce(DataFrame.unionByName, more, ends).distinct()


def near_pairs(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(a, b, jaccard, estimate), a < b: all pairs of representatives at or above ``similarity``; the sets of hashed grams decide.

    ``estimate`` is the share of equal places of the MinHash signatures.  Small
    buckets are paired; what meets in larger ones goes through the set join, which looks at no
    pair that prefix, length and place rule out.  A pair at a Jaccard of 0.8 shares one of the 32
    bands of four with a chance of 1 - 6e-8.  The result has a row for each link between
    different texts; ``exact_groups`` says which documents a text stands for.
    """
    met = buckets(banded(docs, scratch, key, text), scratch)
    pairs, many = scratch.save(pairs_in_buckets(met, crowd), "candidates"), scratch.save(crowded(met, crowd), "crowd")
    sets = shingle_sets(docs, scratch.save(_asked(pairs, many), "asked"), scratch, key, text)
    pairs = scratch.save(pairs.unionByName(_in_crowds(sets, many, similarity, scratch)).distinct(), "pairs")
    alike = setjoin.decided(pairs, sets, similarity)
    left, right = (sets.select(F.col("node").alias(end), F.col("signature").alias(f"m_{end}")) for end in ("a", "b"))
    equal = F.size(F.filter(F.zip_with("m_a", "m_b", lambda x, y: x == y), lambda e: e))
    return alike.join(left, "a").join(right, "b").select("a", "b", "jaccard", (equal / PERMUTATIONS).alias("estimate"))


def _in_crowds(sets: DataFrame, many: DataFrame, similarity: float, scratch: Scratch, roots: DataFrame | None = None) -> DataFrame:
    """Candidates (a, b) among the documents ``many``; with ``roots`` (node, root) only those that are not joined yet."""
    if many.isEmpty():
        return many.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    of = sets.join(many, sets.node == many.doc_id, "left_semi").select("node", "grams")
    of = of.withColumn("root", F.col("node")) if roots is None else of.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return setjoin.candidates(scratch.save(of, "crowd_sets"), similarity, scratch)


def near_links(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """Written edges (a, b) that join the representatives which all links of ``near_pairs`` join, without the square of a crowd.

    Chains join most of a crowd first.  Then the set join looks for links between what is not joined yet, so no link is lost.
    """
    met = buckets(banded(docs, scratch, key, text), scratch)
    pairs, many = scratch.save(pairs_in_buckets(met, crowd).unionByName(chains(met, crowd)).distinct(), "candidates"), scratch.save(crowded(met, crowd), "crowd")
    sets = shingle_sets(docs, scratch.save(_asked(pairs, many), "asked"), scratch, key, text)
    first = scratch.save(setjoin.decided(pairs, sets, similarity).select("a", "b"), "links")
    if many.isEmpty():
        return first
    roots = graph.components(first, Scratch(docs.sparkSession, "crowds"))
    rest = scratch.save(_in_crowds(sets, many, similarity, scratch, roots), "rest")
    return scratch.save(first.unionByName(setjoin.decided(rest, sets, similarity).select("a", "b")), "all_links")


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, cluster_id) of every document, the cluster being the smallest id reachable over exact and near links."""
    scratch = Scratch(docs.sparkSession, "dedup")
    exact = scratch.save(exact_groups(docs, key, text), "exact")
    roots = graph.components(near_links(docs, scratch, key=key, text=text), scratch)
    return exact.join(roots, exact.representative == roots.node, "left").select(key, F.coalesce("root", "representative").alias("cluster_id"))


def least_likeness(docs: DataFrame) -> DataFrame:
    """(cluster_id, min_jaccard, links) of the clusters that near links hold together, over all links between different texts."""
    scratch = Scratch(docs.sparkSession, "likeness")
    pairs = scratch.save(near_pairs(docs, scratch), "near")
    roots = graph.components(pairs.select("a", "b"), scratch)
    return pairs.join(roots, pairs.a == roots.node, "left").groupBy(F.coalesce("root", "a").alias("cluster_id")).agg(F.min("jaccard").alias("min_jaccard"), F.count("*").alias("links"))


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: (doc_id, representative, copies, cluster_id, links): its class of equal texts, their number, its cluster, and the other texts that its text is linked with."""
    scratch = Scratch(docs.sparkSession, "link_counts")
    exact = scratch.save(exact_groups(docs, key, text), "exact")
    pairs = scratch.save(near_pairs(docs, scratch, key=key, text=text).select("a", "b"), "near")
    roots = graph.components(pairs, scratch)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    of = ends.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return exact.join(of, exact.representative == of.node, "left").select(
        key, "representative", "copies", F.coalesce("root", "representative").alias("cluster_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links")
    )


def cluster_table(docs: DataFrame, of: DataFrame) -> DataFrame:
    """One row for each cluster of two or more: size, exact classes, sources, kind and the flags short, template."""
    facts = docs.select("doc_id", "source", exact_key(F.col("text")).alias("k"), F.size(X.words(F.col("text"))).alias("words"), X.title(F.col("text")).alias("title"))
    with few_rows(docs.sparkSession):
        facts = Scratch(docs.sparkSession, "facts").save(facts, "facts")
    return (
        facts.join(of, "doc_id").groupBy("cluster_id")
        .agg(F.count("*").alias("size"), F.count_distinct("k").alias("classes"), F.count_distinct("source").alias("sources"), F.median("words").alias("words"), F.count_distinct("title").alias("titles"))
        .where("size > 1")
        .select(
            "cluster_id", "size", "classes", "sources",
            F.when(F.col("classes") == 1, "exact").otherwise("near").alias("kind"),
            (F.col("words") < SHORT).alias("short"),
            ((F.col("size") >= TEMPLATE_DOCS) & (F.col("sources") == 1) & (F.col("titles") >= TEMPLATE_TITLES * F.col("size"))).alias("template"),
        )
    )


def size_band(size: Column) -> Column:
    return F.when(size <= 4, size.cast("string")).when(size < 10, "5-9").when(size < 50, "10-49").when(size < 100, "50-99").otherwise("100+")
