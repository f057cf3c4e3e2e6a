"""Queries about duplicates of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import dedup as D
from ..sources.scratch import Scratch
from .registry import query, table

_NORM = r"""trim(regexp_replace(lower(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), '\s+', ' ', 'g'))"""
_EXACT = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, text, {_NORM} AS norm FROM documents), e AS MATERIALIZED (SELECT doc_id, source, text, norm, min(doc_id) OVER same AS rep, count(*) OVER same AS copies FROM d WINDOW same AS (PARTITION BY norm, CASE WHEN norm = '' THEN doc_id END))
"""
_PAIRS = _EXACT + r"""
, w AS (SELECT doc_id, regexp_extract_all(norm, '[\p{L}\p{N}_]+') AS t FROM e WHERE doc_id = rep), s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')))) AS g FROM w WHERE len(t) >= 50),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (max(nx.n) + max(ny.n) - count(*)) AS j FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id JOIN n nx ON x.doc_id = nx.doc_id JOIN n ny ON y.doc_id = ny.doc_id GROUP BY 1, 2 HAVING j >= 0.8)
"""
_CLUSTERS = _PAIRS + """
, l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), walk AS (SELECT rep AS node, rep AS seen FROM (SELECT DISTINCT rep FROM e) UNION SELECT walk.node, l.b FROM walk JOIN l ON walk.seen = l.a),
root AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1), c AS (SELECT doc_id, source, text, norm, root AS cluster_id FROM e JOIN root ON rep = node)
"""
_TABLE = _CLUSTERS + r"""
, t AS (SELECT cluster_id, count(*) AS size, count(DISTINCT norm) AS classes, count(DISTINCT source) AS sources, median(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS words, count(DISTINCT trim(string_split(text, chr(10))[1])) AS titles FROM c GROUP BY 1 HAVING count(*) > 1)
"""


@query("exact_groups", _EXACT + "SELECT doc_id, rep AS representative, copies FROM e")
def exact_groups(spark, sf):
    return D.exact_groups(table(spark, sf, "documents"))


@query("exact_report", _EXACT + "SELECT count(*) AS classes, sum(copies)::BIGINT AS docs, (sum(copies) - count(*))::BIGINT AS redundant FROM (SELECT DISTINCT rep, copies FROM e WHERE copies > 1)")
def exact_report(spark, sf):
    groups = D.exact_groups(table(spark, sf, "documents")).where("copies > 1").select("representative", "copies").distinct()
    return groups.agg(F.count("*").alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("docs"), (F.sum("copies") - F.count("*")).alias("redundant"))


@query("minhash_lsh_pairs", _PAIRS + "SELECT a, b, round(j, 6) AS jaccard FROM p")
def minhash_lsh_pairs(spark, sf):
    return D.near_pairs(table(spark, sf, "documents"), Scratch(spark, "pairs")).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("near_dup_links", _CLUSTERS + ", k AS (SELECT node, count(*) AS links FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p) GROUP BY 1) SELECT c.doc_id, e.rep AS representative, e.copies, c.cluster_id, coalesce(k.links, 0) AS links FROM c JOIN e USING (doc_id) LEFT JOIN k ON e.rep = k.node")
def near_dup_links(spark, sf):
    """Class, cluster and number of links of every document."""
    return D.link_counts(table(spark, sf, "documents"))


@query("cluster_min_jaccard", _CLUSTERS + ", m AS (SELECT cluster_id, min(j) AS j FROM p JOIN c ON p.a = c.doc_id GROUP BY 1) SELECT cluster_id, round(j, 6) AS min_jaccard FROM m")
def cluster_min_jaccard(spark, sf):
    return D.least_likeness(table(spark, sf, "documents")).select("cluster_id", F.round("min_jaccard", 6).alias("min_jaccard"))


@query("near_dup_clusters", _CLUSTERS + "SELECT doc_id, cluster_id FROM c")
def near_dup_clusters(spark, sf):
    return D.clusters(table(spark, sf, "documents"))


def _table(spark, sf):
    docs = table(spark, sf, "documents")
    return D.cluster_table(docs, D.clusters(docs))


@query("cluster_flags", _TABLE + "SELECT cluster_id, size, classes, sources, CASE WHEN classes = 1 THEN 'exact' ELSE 'near' END AS kind, words < 100 AS short, size >= 3 AND sources = 1 AND titles >= 0.8 * size AS template FROM t")
def cluster_flags(spark, sf):
    return _table(spark, sf)


@query("cluster_size_hist", _TABLE + "SELECT CASE WHEN size <= 4 THEN size::VARCHAR WHEN size < 10 THEN '5-9' WHEN size < 50 THEN '10-49' WHEN size < 100 THEN '50-99' ELSE '100+' END AS band, count(*) AS clusters, sum(size)::BIGINT AS docs FROM t GROUP BY 1")
def cluster_size_hist(spark, sf):
    return _table(spark, sf).groupBy(D.size_band(F.col("size")).alias("band")).agg(F.count("*").alias("clusters"), F.sum("size").alias("docs"))


@query("cluster_scope", _TABLE + "SELECT CASE WHEN classes = 1 THEN 'exact' ELSE 'near' END AS kind, CASE WHEN sources = 1 THEN 'one' ELSE 'many' END AS scope, count(*) AS clusters, sum(size)::BIGINT AS docs FROM t GROUP BY ALL")
def cluster_scope(spark, sf):
    scope = F.when(F.col("sources") == 1, "one").otherwise("many").alias("scope")
    return _table(spark, sf).groupBy("kind", scope).agg(F.count("*").alias("clusters"), F.sum("size").alias("docs"))


@query("cluster_expand", _CLUSTERS + """, base AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS position FROM documents QUALIFY position <= 3)
  SELECT DISTINCT base.source AS list, m.doc_id FROM base JOIN c o ON base.doc_id = o.doc_id JOIN c m ON o.cluster_id = m.cluster_id WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.source = base.source AND b.doc_id = m.doc_id)""")
def cluster_expand(spark, sf):
    """What the clusters of a list's documents add to it."""
    docs = table(spark, sf, "documents")
    of = D.clusters(docs)
    order = W.partitionBy("source").orderBy(F.length("text").desc(), "doc_id")
    base = docs.withColumn("position", F.row_number().over(order)).where("position <= 3").select(F.col("source").alias("list"), "doc_id")
    mates = base.join(of, "doc_id").select("list", "cluster_id").join(of, "cluster_id").select("list", "doc_id").distinct()
    return mates.join(base, ["list", "doc_id"], "left_anti")


@query("dup_line_share", r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, source, substr(trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '\s+', ' ', 'g')), 1, 80) AS key FROM l),
  h AS (SELECT source, key, count(DISTINCT doc_id) AS docs, count(*) AS n FROM k WHERE length(key) >= 10 GROUP BY ALL) SELECT source, count(*) AS keys, count(*) FILTER (WHERE docs > 1) AS repeated, sum(n) FILTER (WHERE docs > 1)::BIGINT AS lines FROM h GROUP BY source""")
def dup_line_share(spark, sf):
    from ..functions import text as X

    rows = table(spark, sf, "documents").select("doc_id", "source", F.explode(X.lines(F.col("text"))).alias("line")).withColumn("key", X.line_key(F.col("line")))
    h = rows.where(F.length("key") >= 10).groupBy("source", "key").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n"))
    many = F.col("docs") > 1
    return h.groupBy("source").agg(F.count("*").alias("keys"), F.count_if(many).alias("repeated"), F.sum(F.when(many, F.col("n"))).alias("lines"))


@query("tail_markers", r"""WITH l AS (SELECT doc_id, source, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
  k AS (SELECT doc_id, source, i / n AS place, substr(trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '\s+', ' ', 'g')), 1, 80) AS key FROM l), t AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1)
  SELECT k.source, key, count(DISTINCT doc_id) FILTER (WHERE place >= 0.7) AS in_tail, count(DISTINCT doc_id) AS anywhere, round(median(place), 6) AS place FROM k JOIN t ON k.source = t.source WHERE length(key) >= 10
  GROUP BY k.source, key, t.docs HAVING count(DISTINCT doc_id) FILTER (WHERE place >= 0.7) >= 0.05 * t.docs AND count(DISTINCT doc_id) > 1""")
def tail_markers(spark, sf):
    """Line keys that stand in the last 30 % of many documents of a host."""
    from ..functions import text as X

    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", "source", F.size(X.lines(F.col("text"))).alias("n"), F.posexplode(X.lines(F.col("text"))).alias("i", "line"))
    keyed = lines.select("doc_id", "source", ((F.col("i") + 1) / F.col("n")).alias("place"), X.line_key(F.col("line")).alias("key")).where(F.length("key") >= 10)
    totals = docs.groupBy("source").agg(F.count("*").alias("docs"))
    found = keyed.groupBy("source", "key").agg(
        F.count_distinct(F.when(F.col("place") >= 0.7, F.col("doc_id"))).alias("in_tail"), F.count_distinct("doc_id").alias("anywhere"), F.round(F.median("place"), 6).alias("place")
    )
    return found.join(totals, "source").where((F.col("in_tail") >= 0.05 * F.col("docs")) & (F.col("anywhere") > 1)).drop("docs")
