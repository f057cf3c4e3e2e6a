"""Corpus bookkeeping: URL groups, profiles, samples, version choice, state updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import urls as U


def group_urls(df: DataFrame, key: str, url: str, ids: bool = False) -> DataFrame:
    """One row for each normalised url with the number of its ids and the first; the representative is https first, then short, then of small id.

    ``ids`` adds the sorted list of them all, which grows with the group.
    """
    u = F.col(url)
    better = F.struct((~F.lower(u).startswith("https://")).cast("int"), F.length(u), F.col(key))
    rows = df.select(F.col(key), u, U.normal(u).alias("url_norm"), U.domain(u).alias("domain"), better.alias("order"))
    found = [F.min_by(url, "order").alias("url"), F.min_by("domain", "order").alias("domain"), F.count("*").alias("n_ids"), F.min(key).alias("first_id")]
    return rows.groupBy("url_norm").agg(*found, *([F.sort_array(F.collect_list(key)).alias("ids")] if ids else []))


def with_section(pages: DataFrame) -> DataFrame:
    """Pages with domain and status, the section of the path that plays the role of a crawl status."""
    p = U.path(F.col("url"))
    section = reduce(lambda rest, s: F.when(p.startswith(f"/{s}/"), s).otherwise(rest), ["es", "fr", "de", "en"], F.lit("other"))
    return pages.select("page_id", "url", U.domain(F.col("url")).alias("domain"), section.alias("status"))


def surt_ranges(pages: DataFrame) -> DataFrame:
    """First and last SURT key of each domain and their common prefix: what a prefix scan of an archive index must cover."""
    keys = pages.select(U.domain(F.col("url")).alias("domain"), U.surt(F.col("url")).alias("k"))
    ends = keys.groupBy("domain").agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.count("*").alias("n"))
    same = F.aggregate(
        F.sequence(F.lit(1), F.least(F.length("first_key"), F.length("last_key"))),
        F.lit(0),
        lambda a, i: F.when((a == i - 1) & (F.col("first_key").substr(i, F.lit(1)) == F.col("last_key").substr(i, F.lit(1))), i).otherwise(a),
    )
    return ends.withColumn("prefix", F.col("first_key").substr(F.lit(1), same))


def profile(df: DataFrame, key: str, url: str) -> DataFrame:
    u = F.col(url)
    return df.agg(
        F.count("*").alias("n"),
        F.count_distinct(u).alias("n_urls"),
        F.count_distinct(U.normal(u)).alias("n_norm"),
        F.count_distinct(U.domain(u)).alias("n_domains"),
        F.count_if(u.isNull() | (u == "")).alias("n_empty"),
        F.count_if(~u.rlike("^https?://")).alias("n_malformed"),
        (F.max(key) - F.min(key) + 1 - F.count_distinct(key)).alias("n_gaps"),
    )


def cumulative_share(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Share of the total covered by the largest groups; runs over the small table of groups."""
    every = W.partitionBy(F.lit(0))
    order = every.orderBy(F.col(n).desc(), key)
    return counts.select(
        key, n, F.round(F.sum(n).over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum(n).over(every), 6).alias("cum_share"), F.row_number().over(order).cast("long").alias("position")
    )


def language_of_host(host: Column, suffixes: list[tuple[str, str]]) -> Column:
    return reduce(lambda rest, s: F.when((host == s[0]) | host.endswith("." + s[0]), s[1]).otherwise(rest), suffixes[::-1], F.lit(None).cast("string"))


def sample_per_domain(pages: DataFrame, least: int, share: float, seed: str = "42") -> DataFrame:
    """The first max(least, share) pages of each domain in a hash order, with the hash hold-out flag."""
    u = F.col("url")
    rows = pages.select("page_id", "url", U.domain(u).alias("domain"))
    d = W.partitionBy("domain")
    rows = rows.withColumn("random_rank", F.row_number().over(d.orderBy(F.md5("url"), "page_id"))).withColumn("of", F.count("*").over(d))
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), u), 256), 1, 2), 16, 10).cast("int")
    return rows.where(F.col("random_rank") <= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("of")))).select(
        "page_id", (first < 128).alias("held_out"), F.col("random_rank").cast("long").alias("random_rank")
    )


def latest_before(rows: DataFrame, keys: list[str], time: str, cut: Column, tie: str) -> DataFrame:
    """As-of choice: for each key the newest row at or before ``cut``, else the oldest after it, flagged ``after_cut``."""
    after = F.col(time) > cut
    distance = F.when(after, F.unix_micros(time)).otherwise(-F.unix_micros(time))
    w = W.partitionBy(*keys).orderBy(after, distance, F.col(tie).desc())
    return rows.withColumn("after_cut", after).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert_latest(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Newest row of each key: what a log of updates amounts to."""
    w = W.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
