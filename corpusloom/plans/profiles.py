"""Queries that profile the corpus and its queries, reduce chunk scores, and read pages by site."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import urls as U
from ..operators import dedup as D
from ..operators import retrieval as R
from ..operators.sites import Registry
from .dedup import _CLUSTERS
from .registry import query, table
from .retrieval import _COS, _queries


@query("cluster_source_pairs", _CLUSTERS + ", held AS (SELECT DISTINCT cluster_id, source FROM c) SELECT x.source AS a, y.source AS b, count(*) AS clusters FROM held x JOIN held y ON x.cluster_id = y.cluster_id AND x.source < y.source GROUP BY 1, 2")
def cluster_source_pairs(spark, sf):
    """Which sources share clusters, and how many; each cluster has a source once, so pairs grow with sources and not with copies."""
    docs = table(spark, sf, "documents")
    held = D.clusters(docs).join(docs.select("doc_id", "source"), "doc_id").select("cluster_id", "source").distinct()
    return held.select("cluster_id", F.col("source").alias("a")).join(held.select("cluster_id", F.col("source").alias("b")), "cluster_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("clusters"))


@query("query_profile", r"""WITH q AS (SELECT len(regexp_extract_all(text, '\S+')) AS n, len(regexp_extract_all(text, '\?')) > 1 OR regexp_matches(text, '(?i)\s(and|also|und|et|y)\s[\s\S]*\?') AS multi, len(regexp_extract_all(text, '(?:^|\s)[A-Z]{2,6}(?:$|[\s.,!?])')) AS short FROM conversations WHERE role = 'user')
 SELECT count(*) AS queries, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.95), 6) AS p95, count(*) FILTER (WHERE multi) AS multi, sum(short)::BIGINT AS abbreviations FROM q""")
def query_profile(spark, sf):
    """Lengths of the questions, how many ask for several things, and abbreviations."""
    t = F.col("text")
    multi = (F.regexp_count(t, F.lit(r"\?")) > 1) | t.rlike(r"(?i)\s(and|also|und|et|y)\s[\s\S]*\?")
    q = table(spark, sf, "conversations").where("role = 'user'").select(F.regexp_count(t, F.lit(r"\S+")).alias("n"), multi.alias("multi"), F.regexp_count(t, F.lit(r"(?:^|\s)[A-Z]{2,6}(?:$|[\s.,!?])")).alias("short"))
    p = lambda x: F.round(F.percentile("n", x), 6).alias(f"p{round(100 * x)}")
    return q.agg(F.count("*").alias("queries"), p(0.25), p(0.5), p(0.75), p(0.95), F.count_if("multi").alias("multi"), F.sum("short").cast("long").alias("abbreviations"))


@query("url_shapes", r"""WITH u AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages), s AS (SELECT regexp_extract(host, '([^.]*)$', 1) AS tld, lower(regexp_extract(path, '\.([A-Za-z0-9]{1,5})$', 1)) AS extension, len(regexp_extract_all(path, '/[^/]+')) AS depth FROM u)
 SELECT tld, extension, depth, count(*) AS n FROM s GROUP BY ALL""")
def url_shapes(spark, sf):
    """Top-level domains, file extensions and depths of the URLs."""
    path = U.path(F.col("url"))
    tld = F.regexp_extract(F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1)), r"([^.]*)$", 1)
    shapes = table(spark, sf, "pages").select(tld.alias("tld"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)).alias("extension"), F.regexp_count(path, F.lit("/[^/]+")).cast("long").alias("depth"))
    return shapes.groupBy("tld", "extension", "depth").agg(F.count("*").alias("n"))


@query("chunk_scores", """WITH c AS (SELECT l_orderkey AS q, l_suppkey AS d, l_linenumber = 1 AS title, l_extendedprice AS s FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY q, d ORDER BY s DESC, title) AS i FROM c),
 m AS (SELECT q, d, max(s) AS top, avg(s) FILTER (WHERE i <= 2) AS two, coalesce(max(s) FILTER (WHERE NOT title), max(s)) AS body FROM r GROUP BY 1, 2) SELECT q, d, round(top, 4) AS top, round(two, 4) AS two, round(body, 4) AS body, round(greatest(top, coalesce(o_totalprice / 4, 0)), 4) AS cmix FROM m LEFT JOIN orders ON o_orderkey = q""")
def chunk_scores(spark, sf):
    """Best, mean of the best two, and best that is no title (else the best) of each document's chunks; and the best of chunk and document score."""
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("d"), (F.col("l_linenumber") == 1).alias("title"), F.col("l_extendedprice").alias("s"))
    ranked = chunks.withColumn("i", F.row_number().over(W.partitionBy("q", "d").orderBy(F.desc("s"), "title")))
    per = ranked.groupBy("q", "d").agg(F.max("s").alias("top"), F.avg(F.when(F.col("i") <= 2, F.col("s"))).alias("two"), F.coalesce(F.max(F.when(~F.col("title"), F.col("s"))), F.max("s")).alias("body"))
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("q"), (F.col("o_totalprice") / 4).alias("whole"))
    mixed = F.greatest("top", F.coalesce("whole", F.lit(0.0)))
    return per.join(docs, "q", "left").select("q", "d", *[F.round(c, 4).alias(c) for c in ("top", "two", "body")], F.round(mixed, 4).alias("cmix"))


@query("site_extract", r"""SELECT page_id, CASE WHEN host LIKE '%.org' THEN regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) WHEN host LIKE '%.net' THEN regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1) ELSE regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) END AS head
 FROM (SELECT page_id, html, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages)""")
def site_extract(spark, sf):
    """What a page is about, read by the rule that is registered for its site."""
    inner = lambda tag: lambda html: F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    sites = Registry(default=inner("title"))
    sites.add("org", inner("h1"))
    sites.add("net", inner("p"))
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    return table(spark, sf, "pages").select("page_id", sites.apply(host, F.col("html")).alias("head"))


@query("search_by_memory", _COS + "SELECT query_id, doc_id, round(score, 6) AS score, position FROM r WHERE position <= 10")
def search_by_memory(spark, sf):
    """Exact search over the vectors as they are."""
    best = R.search(table(spark, sf, "embeddings"), _queries(spark, sf), 10)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")


@query("search_by_codes")
def search_by_codes(spark, sf):
    """The same search by codes of one byte a dimension, with an exact look at a short list."""
    best = R.search(table(spark, sf, "embeddings"), _queries(spark, sf), 10, codes=True)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")


@query("vector_memory", """WITH v AS (SELECT embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  s AS (SELECT count(*) AS vectors, coalesce(sum(len(e)), 0)::BIGINT AS code_bytes FROM v) SELECT vectors, code_bytes * 4 AS float_bytes, code_bytes, CASE WHEN code_bytes * 4 <= 200000 THEN 'flat' WHEN code_bytes <= 200000 THEN 'codes' ELSE 'none' END AS fits FROM s""")
def vector_memory(spark, sf):
    """What the vectors take in memory, and which form fits."""
    return R.memory_plan(table(spark, sf, "embeddings"), 200_000)
