"""Mergeable sketches: distinct counts and overlaps of any subset of shards from small stored tables.

A table of sketches has one row for each shard.  Sketches of shards unite to
one of their union, with the error of one made from its rows, so a subset is counted without reading a row of it.  HLL
sketches (``2 ** lg_k`` registers) have a relative standard error of about 1.04 / sqrt(2 ** lg_k);
bottom-k tables keep the k least hashes of a shard's distinct values and give the
Jaccard of two shards within about 1 / sqrt(k).

Defined results: null values are not counted; a null shard is a shard; a shard of null values
only counts zero; repeated rows change nothing; no rows give no sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LG_K, BOTTOM = 12, 1024


def build(df: DataFrame, shard: str, value: Column, lg_k: int = LG_K) -> DataFrame:
    """(shard, sketch, rows): partial sketches are made where rows lie; one small row a shard is shuffled from each task."""
    return df.select(F.col(shard).alias("shard"), value.alias("_v")).groupBy("shard").agg(F.hll_sketch_agg("_v", lg_k).alias("sketch"), F.count("*").alias("rows"))


def append(table: DataFrame, more: DataFrame) -> DataFrame:
    """A table with the sketches of further rows united into those of their shards."""
    both = table.unionByName(more)
    return both.groupBy("shard").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("rows").alias("rows"))


def count(table: DataFrame, among: Column | None = None) -> DataFrame:
    """One row (distinct, rows, shards): the estimate over the union of the shards for which ``among`` holds."""
    some = table if among is None else table.where(among)
    return some.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("long")).alias("distinct"), F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("rows"), F.count("*").alias("shards"))


def bottom(df: DataFrame, shard: str, value: Column, k: int = BOTTOM) -> DataFrame:
    """(shard, h): the ``k`` least hashes of the distinct values of each shard.  Values are made distinct first; ranks are taken within parts of a shard, then over what is left."""
    rows = df.select(F.col(shard).alias("shard"), F.xxhash64(value).alias("h"), value.alias("_v")).where("_v IS NOT NULL").select("shard", "h").distinct()
    part = rows.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(64)))
    first = part.withColumn("n", F.row_number().over(W.partitionBy("shard", "part").orderBy("h"))).where(F.col("n") <= k)
    return first.withColumn("n", F.row_number().over(W.partitionBy("shard").orderBy("h"))).where(F.col("n") <= k).select("shard", "h")


def overlaps(table: DataFrame, k: int = BOTTOM) -> DataFrame:
    """(a, b, jaccard) of the shards, a < b, that share a kept hash: the share of the k least hashes of both that both hold.

    Shards meet by hash, so a pair without a common hash makes no row.
    """
    left, right = (table.select(F.col("shard").alias(x), "h") for x in ("a", "b"))
    pairs = left.join(right, "h").where("a < b").select("a", "b").distinct()
    both = pairs.join(left, "a").select("a", "b", "h", F.lit(1).alias("of")).unionByName(pairs.join(right, "b").select("a", "b", "h", F.lit(2).alias("of")))
    held = both.groupBy("a", "b", "h").agg(F.count_distinct("of").alias("sides"))
    least = held.withColumn("n", F.row_number().over(W.partitionBy("a", "b").orderBy("h"))).where(F.col("n") <= k)
    return least.groupBy("a", "b").agg((F.count_if(F.col("sides") == 2) / F.count("*")).alias("jaccard"))
