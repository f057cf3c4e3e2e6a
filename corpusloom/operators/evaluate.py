"""Set and rank evaluation, smoothed rates, correlations, and the LCS metric."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import text as X
from .ranking import average_ranks, place


def document_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, p, r, f2) over every query with gold; a query without predictions scores 0.  Repeated pairs count once."""
    pred, gold = pred.select("query_id", "doc_id").distinct(), gold.select("query_id", "doc_id").distinct()
    n_gold = gold.groupBy("query_id").agg(F.count("*").alias("g"))
    n_pred = pred.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = pred.join(gold, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("h"))
    all_ = n_gold.join(n_pred, "query_id", "left").join(hits, "query_id", "left").na.fill(0, ["n", "h"])
    p, r = F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0), F.col("h") / F.col("g")
    return all_.select("query_id", p.alias("p"), r.alias("r"), X.f2(p, r).alias("f2"))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by bit-parallel rows held in one integer."""
    if not a or not b:
        return 0
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = places.get(y, 0)
        hit = row & match
        row = ((row + hit) | (row & ~match)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length of two arrays; null counts as empty."""
    return pd.Series([lcs_length(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.IntegerType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words that two arrays share as multisets: no LCS is longer."""
    return pd.Series([(Counter(x) & Counter(y)).total() for x, y in zip(a, b, strict=True)], dtype="int32")


def passage_scores(pred: DataFrame, gold: DataFrame, both_sides: bool) -> DataFrame:
    """(query_id, p, r, f2) of passages: only passages of one document are compared; 5 LCS >= 2 len(gold), and of the other side too if ``both_sides``.

    ``pred`` and ``gold``: (query_id, doc_id, chunk, tokens).
    """
    g = gold.where(F.size("tokens") > 0).select("query_id", "doc_id", F.col("chunk").alias("g"), F.col("tokens").alias("gt"))
    p = pred.select("query_id", "doc_id", F.col("chunk").alias("c"), F.col("tokens").alias("ct"))
    need = 2 * (F.greatest(F.size("gt"), F.size("ct")) if both_sides else F.size("gt"))
    pairs = p.join(g, ["query_id", "doc_id"]).where(5 * F.least(F.size("gt"), F.size("ct")) >= need)
    pairs = pairs.where(5 * overlap("gt", "ct") >= need).withColumn("l", lcs("gt", "ct"))
    match = 5 * F.col("l") >= 2 * F.size("gt")
    if both_sides:
        match = match & (5 * F.col("l") >= 2 * F.size("ct"))
    hit = pairs.where(match)
    count = lambda df, *c: df.select("query_id", "doc_id", *c).distinct().groupBy("query_id").agg(F.count("*").alias("x"))
    parts = {"ng": count(g, "g"), "np": count(p, "c"), "hg": count(hit, "g"), "hp": count(hit, "c")}
    out = parts["ng"].withColumnRenamed("x", "ng")
    for name in ("np", "hg", "hp"):
        out = out.join(parts[name].withColumnRenamed("x", name), "query_id", "left")
    out = out.na.fill(0, ["np", "hg", "hp"])
    pr, rc = F.when(F.col("np") > 0, F.col("hp") / F.col("np")).otherwise(0.0), F.col("hg") / F.col("ng")
    return out.select("query_id", pr.alias("p"), rc.alias("r"), X.f2(pr, rc).alias("f2"))


def spearman(df: DataFrame, a: str, b: str, *group: str) -> DataFrame:
    """Rank correlation within groups; rows with a missing score take no part."""
    ranked = average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, a, b), list(group), a, "_a")
    return average_ranks(ranked, list(group), b, "_b").groupBy(*group).agg(F.round(F.corr("_a", "_b"), 6).alias("rho"))


def auc(df: DataFrame, score: str, label: str, *group: str) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half, by the rank sum."""
    ranked = average_ranks(df.where(F.col(score).isNotNull()).select(*group, score, label), list(group), score, "_r")
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)
    total = F.sum(F.when(F.col(label) == 1, F.col("_r")).otherwise(0))
    return ranked.groupBy(*group).agg(F.round(F.try_divide(total - pos * (pos + 1) / 2, pos * neg), 6).alias("auc"))


def out_of_fold_rate(df: DataFrame, key: str, hit: str, fold: Column, strength: float) -> DataFrame:
    """Smoothed rate of each row's key without the rows of its own fold: totals minus own, no loop over folds."""
    rows = df.withColumn("fold", fold)
    cells = rows.groupBy(key, "fold").agg(F.sum(hit).alias("h"), F.count("*").alias("n"))
    folds = cells.groupBy("fold").agg(F.sum("h").alias("fh"), F.sum("n").alias("fn"))
    total = folds.agg(F.sum("fh").alias("th"), F.sum("fn").alias("tn"))
    mean = folds.crossJoin(F.broadcast(total)).select("fold", ((F.col("th") - F.col("fh")) / (F.col("tn") - F.col("fn"))).alias("mean"))
    by_key = W.partitionBy(key)
    rest = cells.join(mean, "fold").withColumn("oh", F.sum("h").over(by_key) - F.col("h")).withColumn("on", F.sum("n").over(by_key) - F.col("n"))
    rate = (F.col("oh") + strength * F.col("mean")) / (F.col("on") + strength)
    return rows.join(rest.select(key, "fold", rate.alias("rate")), [key, "fold"])


def recall_curve(df: DataFrame, order: list, relevant: str, fractions: list[float]) -> DataFrame:
    """Share of the relevant rows among the first ceil(f n) in the order, for each fraction."""
    ranked = place(df, order, "i").select(F.col(relevant).alias("y"), "i").crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))
    return ranked.agg(*[F.round(F.sum(F.when(F.col("i") <= F.ceil(F.lit(f) * F.col("n")), F.col("y"))) / F.sum("y"), 6).alias(f"recall_{round(f * 100)}") for f in fractions])


def correlation_summary(df: DataFrame, a: str, b: str, query: str) -> DataFrame:
    """One row: the rank correlation over all rows, and the mean and the 10 % quantile of those within each query."""
    per = spearman(df, a, b, query)
    within = per.agg(F.round(F.avg("rho"), 6).alias("mean"), F.round(F.percentile("rho", 0.1), 6).alias("p10"))
    return spearman(df, a, b).select(F.col("rho").alias("overall")).crossJoin(within)


def compare_strategies(df: DataFrame, strategies: list[str], group: str, relevant: str, fractions: list[float], key: str = "doc_id") -> DataFrame:
    """(strategy, group, recall_...): the share of relevant rows among the first ceil(f n) of each group, for each score column.

    Places are running totals over the sorted table, so no group is in one task.
    """
    long = df.select(key, group, F.col(relevant).alias("_y"), F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("v")) for s in strategies])).alias("s")).select(key, group, "_y", "s.*")
    placed = place(long, ["strategy", group, F.col("v").desc(), key], "_i")
    ends = placed.groupBy("strategy", group).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    rows = placed.join(ends, ["strategy", group]).withColumn("_at", F.col("_i") - F.col("_first") + 1)
    hits = [F.round(F.try_divide(F.sum(F.when(F.col("_at") <= F.ceil(F.lit(f) * F.col("_n")), F.col("_y")).otherwise(0)), F.sum("_y")), 6).alias(f"recall_{round(f * 100)}") for f in fractions]
    return rows.groupBy("strategy", group).agg(*hits)
