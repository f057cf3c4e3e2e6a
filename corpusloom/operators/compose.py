"""Composing lists and tables: checked joins, unions by priority, lane merges, calibration, validation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions.normal import metric_normal
from ..sources.scratch import Scratch
from . import wordjoin
from .fusion import bisect, per_query
from .ranking import place

#: Rows with a candidate partner whose keys are broadcast, so that only their texts are shuffled.
MAX_ENDS = 1_000_000


def join_complete(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that must keep every left row exactly once; one aggregate tells a missing or repeated partner."""
    counts = right.groupBy(*keys).agg(F.count("*").alias("_n"))
    bad = left.join(counts, keys, "left").where(F.coalesce("_n", F.lit(0)) != 1).limit(1).count()
    if bad:
        raise ValueError(f"some rows have no partner, or several, by {keys}")
    return left.join(right, keys)


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a table whose keys must be unique."""
    if right.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"keys {keys} are not unique")
    return left.join(right, keys, "left")


def union_by_priority(parts: list[DataFrame], keys: list[str], *ties: Column | str) -> DataFrame:
    """Rows of several tables, one for each key: the first table that has it wins."""
    rows = None
    for k, part in enumerate(parts):
        numbered = part.withColumn("origin", F.lit(k))
        rows = numbered if rows is None else rows.unionByName(numbered, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("origin", *ties)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def append_absent(base: DataFrame, extra: DataFrame, k: int, score: str) -> DataFrame:
    """(query_id, doc_id, position): the base list, then the k best extra documents that it does not have and that score above 0."""
    absent = extra.where(F.col(score) > 0).join(base, ["query_id", "doc_id"], "left_anti")
    ranked = absent.withColumn("n", F.row_number().over(per_query(F.col(score).desc(), "doc_id"))).where(F.col("n") <= k)
    last = base.groupBy("query_id").agg(F.max("position").alias("last"))
    tail = ranked.join(last, "query_id", "left").select("query_id", "doc_id", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long").alias("position"))
    return base.select("query_id", "doc_id", "position").unionByName(tail)


def assign_ids(known: DataFrame, pairs: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Append-only registry: known pairs keep their ids, new ones get the next free numbers in key order.

    New pairs are sorted over the cluster and numbered by their place, so the numbering does not pass through one task.
    """
    new = pairs.select(*keys).distinct().join(known, keys, "left_anti")
    start = known.agg(F.coalesce(F.max(id_), F.lit(0)).alias("start"))
    numbered = place(new, list(keys), "_place").crossJoin(F.broadcast(start))
    return known.select(*keys, id_).unionByName(numbered.select(*keys, (F.col("start") + F.col("_place")).alias(id_)))


def overrides(base: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Rows of ``base`` except the groups that ``new`` has, which are taken from it whole."""
    return base.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def keep_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key).distinct(), key, "left_semi")


def first_k_where(rows: DataFrame, condition: Column, k: int, *order: str) -> DataFrame:
    """The first k rows of each query that meet the condition; rows that do not are all kept."""
    w = W.partitionBy("query_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    seen = F.sum(condition.cast("int")).over(w)
    return rows.withColumn("_seen", seen).where(~condition | (F.col("_seen") <= k)).drop("_seen")


def offset_for_mean(scores: DataFrame, score: str, target: float, bins: int = 20_000) -> float:
    """b with mean(sigmoid(score + b)) = target; works on a histogram of the scores, whose size does not depend on the rows."""
    low, high = scores.agg(F.min(score), F.max(score)).first()
    width = (high - low) / bins or 1.0
    hist = scores.groupBy(F.floor((F.col(score) - low) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean")).collect()
    import math

    total = sum(r.n for r in hist)
    mean = lambda b: sum(r.n / (1 + math.exp(-max(-700.0, min(700.0, r["mean"] + b)))) for r in hist) / total
    return bisect(mean, target, -50.0, 50.0, steps=100)[1]


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of logit(y) on x from sums alone: (a, b)."""
    z = X.logit(F.col(y))
    return df.select(F.col(x).alias("x"), z.alias("z")).agg(F.regr_slope("z", "x").alias("a"), F.regr_intercept("z", "x").alias("b"))


def quantile_map(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Maps each value of one score to the value of the other at the same place of its sorted order."""
    one = place(rows.select("query_id", "doc_id", F.col(source).alias("from")), ["from", "doc_id", "query_id"], "i")
    other = place(rows.select("query_id", "doc_id", F.col(target).alias("to")), ["to", "doc_id", "query_id"], "i").select("to", "i")
    return one.join(other, "i").drop("i")


def tail_mass(rows: DataFrame, p: str, order: str, fit: int, block: int, most: int) -> DataFrame:
    """(query_id, mass): what a geometric decay of p over the last ``fit`` places of each list promises beyond its end."""
    n = F.count("*").over(W.partitionBy("query_id"))
    last = rows.withColumn("_r", F.row_number().over(per_query(order, "doc_id"))).withColumn("_n", n).where((F.col("_n") >= fit) & (F.col("_r") > F.col("_n") - fit))
    blocks = last.groupBy("query_id", F.floor((F.col("_r") - F.col("_n") + fit - 1) / block).alias("b")).agg((F.avg(p) + 1e-9).alias("m"))
    line = blocks.groupBy("query_id").agg(F.regr_slope(F.log("m"), "b").alias("slope"), F.max_by("m", "b").alias("end"))
    decay = F.greatest(-F.col("slope") / block, F.log(F.lit(1 + 1 / most)))
    return line.select("query_id", (F.col("end") * F.exp(-(block / 2 - 0.5) * decay) / F.expm1(decay)).alias("mass"))


def greedy_joint(rows: DataFrame, p: str, gold: Column) -> DataFrame:
    """(query_id, kept): documents are taken by falling p while p exceeds hits / (4 G + k)."""
    lists = rows.withColumn("_g", gold).groupBy("query_id", "_g").agg(F.sort_array(F.collect_list(F.col(p)), asc=False).alias("ps"))
    start = F.struct(F.lit(0.0).alias("tp"), F.lit(0).alias("k"), F.lit(True).alias("open"))

    def step(a, x):
        go = a["open"] & (x > a["tp"] / (4 * F.col("_g") + a["k"]))
        return F.struct(F.when(go, a["tp"] + x).otherwise(a["tp"]).alias("tp"), (a["k"] + go.cast("int")).alias("k"), go.alias("open"))

    return lists.select("query_id", F.aggregate("ps", start, step)["k"].cast("long").alias("kept"))


def chunk_list(ranked: DataFrame, k: int, listed: DataFrame | None = None, split: int = 0) -> DataFrame:
    """(query_id, doc_id, place, added): the documents with text that a list of passages names, of ``ranked`` (query_id, doc_id, rank, has_text).

    Without ``listed`` the first k.  With ``listed`` (query_id, doc_id) and no
    ``split`` the first k that are listed.  With both, places up to ``split``
    among the documents with text are free, and those after it, up to k, are
    kept if they are listed; ``added`` marks what was not.
    """
    some = ranked.where("has_text")
    if listed is not None:
        known = listed.select("query_id", "doc_id").distinct().withColumn("_in", F.lit(True))
        some = some.join(known, ["query_id", "doc_id"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
        if not split:
            some = some.where("_in")
    else:
        some = some.withColumn("_in", F.lit(True))
    placed = some.withColumn("place", F.row_number().over(per_query("rank", "doc_id")).cast("long")).where(F.col("place") <= k)
    if split:
        placed = placed.where(F.col("_in") | (F.col("place") <= split))
    return placed.select("query_id", "doc_id", "place", (~F.col("_in")).alias("added"))


def fill_missing(chunks: DataFrame, listed: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(query_id, doc_id, place): passages, then one for each listed document of a place up to ``most`` that has text and no passage yet."""
    have = chunks.select("query_id", "doc_id").distinct()
    lacking = listed.where(F.col("position") <= most).join(have, ["query_id", "doc_id"], "left_anti").join(texts.select("doc_id"), "doc_id", "left_semi")
    last = chunks.groupBy("query_id").agg(F.max("place").alias("_last"))
    added = lacking.withColumn("_n", F.row_number().over(per_query("position", "doc_id"))).join(last, "query_id", "left")
    return chunks.select("query_id", "doc_id", "place").unionByName(added.select("query_id", "doc_id", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long").alias("place")))


def merge_keeping_order(base: DataFrame, extra: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, position): the k best of two scored lists; those of ``base`` keep their order, each new one stands before the first of them that scores less.

    Inputs: (query_id, doc_id, score), ``base`` with its position too.
    """
    both = base.select("query_id", "doc_id", "score", "position").unionByName(extra.join(base, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "score", F.lit(None).cast("long").alias("position")))
    best = both.withColumn("_r", F.row_number().over(per_query(F.col("score").desc(), "doc_id"))).where(F.col("_r") <= k)
    held, new = best.where("position IS NOT NULL"), best.where("position IS NULL")
    # both sides hold k rows of a query at most
    before = new.select("query_id", "doc_id", F.col("score").alias("_s")).join(held.select("query_id", F.col("score").alias("_b"), F.col("position").alias("_p")), "query_id", "left")
    place = before.groupBy("query_id", "doc_id").agg(F.min(F.when(F.col("_b") < F.col("_s"), F.col("_p"))).alias("_at"))
    inserted = new.drop("position").join(place, ["query_id", "doc_id"]).select("query_id", "doc_id", "score", F.coalesce(F.col("_at") - 0.5, F.lit(1e15)).alias("_at"))
    rows = held.select("query_id", "doc_id", "score", F.col("position").cast("double").alias("_at")).unionByName(inserted)
    return rows.withColumn("position", F.row_number().over(per_query("_at", F.col("score").desc(), "doc_id")).cast("long")).select("query_id", "doc_id", "position")


def lcs_pairs(rows: DataFrame, key: str, tokens: Column, share: float = 0.8, copies: bool = True) -> DataFrame:
    """(a, b, lcs), a < b: rows that share a 2-gram and whose longest common subsequence covers ``share`` of the longer.

    No LCS is longer than what two rows share as multisets of words, so pairs are
    sought by the rarest words of each row (``wordjoin``), which makes rows only for pairs
    that lengths, places and sketches allow.  Only texts of such pairs are
    written and shuffled.  From a share of 0.8 on the LCS implies a shared 2-gram: of an LCS of L of n and m words
    3 L - n - m - 1 are shared at least, and up to four words only equal lists reach the share.

    Equal word lists are one class, for which its smallest key stands.  Without
    ``copies`` the pairs are those of these representatives, and (representative, member, number of words) for each
    further member; only there the LCS is as long as the longer.
    """
    from .evaluate import lcs, overlap

    scratch = Scratch(rows.sparkSession, "lcs")
    whole = rows.select(F.col(key).alias("id"), tokens.alias("w")).where("id IS NOT NULL").where(F.size("w") >= 2)
    whole = whole.withColumn("k", F.unhex(F.sha2(F.to_json("w"), 256)))
    lists = wordjoin.distinct_lists(whole, share, scratch)
    found = wordjoin.candidates(lists, share, scratch)
    ends = scratch.save(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    asked = whole.join(F.broadcast(ends), "id", "left_semi") if ends.count() <= MAX_ENDS else whole
    named = lists.select("id", "k").join(ends, "id", "left_semi")
    words = scratch.save(asked.join(named, ["id", "k"], "left_semi").groupBy("id", "k").agg(F.first("w").alias("w")).select("id", "w"), "words")
    of = lambda x: words.select(F.col("id").alias(x), F.col("w").alias(f"w{x}"))
    longer = F.greatest(F.size("wa"), F.size("wb"))
    both = found.join(of("a"), "a").join(of("b"), "b").where(overlap("wa", "wb") >= F.lit(share) * longer - 1e-9)
    if share < 0.8:
        grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.slice(w, i, 2))
        both = both.where(F.arrays_overlap(grams("wa"), grams("wb")))
    pairs = both.withColumn("lcs", lcs("wa", "wb")).where(F.col("lcs") >= F.lit(share) * longer - 1e-9).select("a", "b", "lcs")
    member = whole.select("k", F.col("id").alias("member")).join(lists.where("many > 1").select("k", "id", "n"), "k").select("id", "member", "n")
    if not copies:
        return pairs.unionByName(member.where("id <> member").select(F.col("id").alias("a"), F.col("member").alias("b"), F.col("n").alias("lcs")))
    for end in "ab":
        named = member.select(F.col("id").alias(end), F.col("member").alias("_member"))
        pairs = pairs.join(named, end, "left").withColumn(end, F.coalesce("_member", end)).drop("_member")
    same = member.withColumnRenamed("member", "a").join(member.select("id", F.col("member").alias("b")), "id").where("a < b").select("a", "b", F.col("n").alias("lcs"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "lcs").unionByName(same)


def cluster_impact(lists: DataFrame, clusters: DataFrame) -> DataFrame:
    """(query_id, docs, drops, adds): what folding clusters would take from each list, and what naming every member of theirs would add.

    ``lists``: (query_id, doc_id); ``clusters``: (doc_id, cluster_id).  Sizes
    of clusters are joined, not their members.
    """
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("_size"))
    of = lists.select("query_id", "doc_id").distinct().join(clusters, "doc_id", "left")
    cluster = F.coalesce(F.col("cluster_id"), F.col("doc_id"))
    per = of.groupBy("query_id", cluster.alias("cluster_id")).agg(F.count("*").alias("_held")).join(sizes, "cluster_id", "left")
    return per.groupBy("query_id").agg(
        F.sum("_held").alias("docs"), F.sum(F.col("_held") - 1).alias("drops"), F.sum(F.coalesce("_size", F.lit(1)) - F.col("_held")).alias("adds")
    )


def validate_answers(rows: DataFrame, chunks: DataFrame, members: DataFrame, texts: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """(rule, errors) of an answer (query_id, doc_id) with its passages (query_id, doc_id, chunk_text).

    Documents that are null, outside the corpus or repeated; passages of
    documents not listed, equal, nearly equal (LCS of 0.8 of the longer within
    a document and query), or empty; with ``texts`` (doc_id, text), passages
    that do not stand in their document word for word; with ``expected``
    (query_id), queries without a row and rows of other queries.
    """
    norm = metric_normal(F.col("chunk_text"))
    numbered = chunks.where(F.col("chunk_text").isNotNull()).withColumn("_n", F.xxhash64("query_id", "doc_id", norm)).select("query_id", "doc_id", "_n", X.words(norm).alias("_w")).dropDuplicates(["_n"])
    checks: dict[str, DataFrame] = {
        "not_a_number": rows.where("doc_id IS NULL OR query_id IS NULL"),
        "not_a_member": rows.where("doc_id IS NOT NULL").join(members, "doc_id", "left_anti"),
        "repeated_document": rows.groupBy("query_id", "doc_id").count().where("count > 1"),
        "passage_of_unlisted_document": chunks.join(rows, ["query_id", "doc_id"], "left_anti"),
        "equal_passages": chunks.groupBy("query_id", "doc_id", norm.alias("k")).count().where("count > 1"),
        "near_passages": _near_passages(numbered),
        "empty_passage": chunks.where(norm == ""),
    }
    if texts is not None:
        checks["not_verbatim"] = chunks.join(texts.select("doc_id", "text"), "doc_id").where("NOT contains(text, chunk_text)")
    if expected is not None:
        checks["query_without_row"] = expected.join(rows, "query_id", "left_anti")
        checks["row_of_other_query"] = rows.join(expected, "query_id", "left_anti")
    out = None
    for rule, bad in checks.items():
        part = bad.agg(F.count("*").alias("errors")).select(F.lit(rule).alias("rule"), "errors")
        out = part if out is None else out.unionByName(part)
    return out


def _near_passages(numbered: DataFrame) -> DataFrame:
    found = lcs_pairs(numbered, "_n", F.col("_w"))
    at = lambda x: numbered.select(F.col("_n").alias(x), F.col("query_id").alias(f"q{x}"), F.col("doc_id").alias(f"d{x}"))
    return found.join(at("a"), "a").join(at("b"), "b").where("qa = qb AND da = db")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, as often as it has them more."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def within_tolerance(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: pairs compared, missing on either side, and beyond the tolerance."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing"), F.count_if(F.abs(F.col("_a") - F.col("_b")) > tolerance).alias("beyond"))


def with_cache(rows: DataFrame, cache: DataFrame, keys: list[str], score: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores from a cache; only rows that it lacks are computed."""
    hit = rows.join(cache.select(*keys, score), keys)
    return hit.unionByName(compute(rows.join(cache, keys, "left_anti")).select(*hit.columns))


def impact(chunks: DataFrame, cuts: DataFrame) -> DataFrame:
    """What a cut at a place of a document does to each chunk: removed, truncated, none."""
    joined = chunks.join(cuts, "doc_id", "left")
    kind = F.when(F.col("cut").isNull() | (F.col("stop") <= F.col("cut")), "none").when(F.col("start") >= F.col("cut"), "removed").otherwise("truncated")
    return joined.withColumn("impact", kind)
