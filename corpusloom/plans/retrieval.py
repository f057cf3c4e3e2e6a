"""Queries that rank: BM25, n-gram containment, dense search and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import retrieval as R
from ..operators.textindex import TextIndex
from ..sources.scratch import Scratch
from .registry import query, table

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BM25 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS tokens FROM documents), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
q AS (SELECT DISTINCT item_id AS item, unnest({_WORDS}) AS term FROM benchmark),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT doc_id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM p JOIN f ON p.term = f.term CROSS JOIN stats),
s AS (SELECT item, doc_id, round(sum(w), 9) AS score FROM q JOIN w ON q.term = w.term GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS position FROM s)
"""


@query("bm25_top10", _BM25 + "SELECT item, doc_id, round(score, 6) AS score, position FROM r WHERE position <= 10")
def bm25_top10(spark, sf):
    best = R.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return best.select("item", "doc_id", F.round("score", 6).alias("score"), "position")


@query("bm25_stored", _BM25 + "SELECT item, doc_id, round(score, 6) AS score, position FROM r WHERE position <= 10")
def bm25_stored(spark, sf):
    """The same ranking from a stored index that is built from half of the files, extended by the other half and merged."""
    root = Scratch(spark, "index").root
    docs = table(spark, sf, "documents").select("doc_id", "text")
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    index = TextIndex(spark, f"{root}/index", f"{root}/source")
    for part in (first, ~first):
        docs.where(part).write.mode("append").parquet(f"{root}/source")
        index.refresh()
    index.merge(at_most=1)
    return index.bm25(table(spark, sf, "benchmark")).select("item", "doc_id", F.round("score", 6).alias("score"), "position")


_SLUGS = "(SELECT page_id AS doc_id, replace(replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '_', ' '), '-', ' ') AS text FROM pages)"


@query("slug_append", _BM25.replace("FROM documents)", f"FROM {_SLUGS})").replace("SELECT DISTINCT item_id AS item", "SELECT DISTINCT item_id AS item") + """, a AS (SELECT item AS query_id, doc_id, position FROM r WHERE position <= 40 AND score > 0 AND doc_id >= 0 AND doc_id <> item AND doc_id NOT IN (SELECT c_custkey * 7 FROM customer)),
 n AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM a) SELECT query_id, doc_id, place FROM n WHERE place <= 5""")
def slug_append(spark, sf):
    """Pages whose slugs say words of an item are appended to its list, five at most of the forty best, without those that it has and those that are left out."""
    slug = F.translate(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "_-", "  ")
    docs, items = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), slug.alias("text")), table(spark, sf, "benchmark")
    base = items.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("doc_id"))
    left_out = table(spark, sf, "customer").select((F.col("c_custkey") * 7).alias("doc_id"))
    return R.append_by_words(base, docs, items, 5, 40, left_out)


@query("bm25_doc_best_rank", _BM25 + "SELECT doc_id, min(position) AS best, CASE WHEN min(position) <= 1 THEN 'first' WHEN min(position) <= 5 THEN 'top5' ELSE 'rest' END AS band FROM r WHERE position <= 50 GROUP BY doc_id")
def bm25_doc_best_rank(spark, sf):
    best = R.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50).groupBy("doc_id").agg(F.min("position").alias("best"))
    return best.withColumn("band", F.when(F.col("best") <= 1, "first").when(F.col("best") <= 5, "top5").otherwise("rest"))


@query("idf_table", f"SELECT term, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY term) CROSS JOIN (SELECT count(*) AS n FROM documents)")
def idf_table(spark, sf):
    docs = table(spark, sf, "documents")
    df = docs.select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


_GRAMS = r"CASE WHEN len(t) >= {n} THEN list_distinct(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n} - 1], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END"


@query(
    "ngram_containment",
    f"""WITH d AS (SELECT doc_id, unnest({_GRAMS.format(n=8)}) AS gram FROM (SELECT doc_id, {_WORDS} AS t FROM documents)), q AS (SELECT item_id, unnest({_GRAMS.format(n=8)}) AS gram FROM (SELECT item_id, {_WORDS} AS t FROM benchmark)),
    n AS (SELECT item_id, count(*) AS grams FROM q GROUP BY 1)
    SELECT q.item_id, doc_id, count(*) AS matched, round(count(*) / max(grams), 6) AS cover FROM q JOIN d ON q.gram = d.gram JOIN n ON q.item_id = n.item_id GROUP BY ALL""",
)
def ngram_containment(spark, sf):
    return R.containment(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_COS = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, label AS q_label, v AS q FROM e WHERE vec_id % 50 = 0),
c AS (SELECT query_id, vec_id AS doc_id, q_label, label, round(list_cosine_similarity(q, v), 9) AS score FROM q CROSS JOIN e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM c)
"""


def _queries(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0")


@query("cosine_top10", _COS + "SELECT query_id, doc_id, round(score, 6) AS score, position FROM r WHERE position <= 10")
def cosine_top10(spark, sf):
    return R.dense_topk(table(spark, sf, "embeddings"), _queries(spark, sf), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")


@query("dense_topk_high_ids", _COS.replace("score DESC, doc_id)", "score DESC, doc_id DESC)") + "SELECT query_id, doc_id, position FROM r WHERE position <= 20")
def dense_topk_high_ids(spark, sf):
    return R.dense_topk(table(spark, sf, "embeddings"), _queries(spark, sf), 20, high_ids_first=True).select("query_id", "doc_id", "position")


@query("knn_recall_label", _COS + """, h AS (SELECT query_id, min(position) FILTER (WHERE label = q_label AND doc_id <> query_id) AS first FROM r WHERE position <= 51 GROUP BY 1)
  SELECT round(avg((coalesce(first, 99) <= 2)::INT), 6) AS recall_2, round(avg((coalesce(first, 99) <= 6)::INT), 6) AS recall_6, round(avg((coalesce(first, 99) <= 51)::INT), 6) AS recall_51 FROM h""")
def knn_recall_label(spark, sf):
    rows = table(spark, sf, "embeddings")
    best = R.dense_topk(rows, _queries(spark, sf), 51)
    of = rows.select(F.col("vec_id").alias("doc_id"), "label")
    labelled = best.join(of, "doc_id").join(_queries(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    first = labelled.groupBy("query_id").agg(F.coalesce(F.min(F.when((F.col("label") == F.col("q_label")) & (F.col("doc_id") != F.col("query_id")), F.col("position"))), F.lit(99)).alias("first"))
    return first.agg(*[F.round(F.avg((F.col("first") <= k).cast("int")), 6).alias(f"recall_{k}") for k in (2, 6, 51)])


@query("max_cosine", _COS + "SELECT doc_id, round(max(score), 4) AS best FROM c GROUP BY doc_id")
def max_cosine(spark, sf):
    """Best cosine of each row over all queries."""
    best = R.best_queries(table(spark, sf, "embeddings"), _queries(spark, sf), 1)
    return best.select("doc_id", F.round("score", 4).alias("best"))


@query("reverse_rank_csls", _COS + """, k AS (SELECT doc_id, query_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, query_id) AS rr FROM c),
  m AS (SELECT doc_id, avg(score) AS hub FROM k WHERE rr <= 5 GROUP BY 1) SELECT k.query_id, k.doc_id, rr, round(k.score - hub, 6) AS csls FROM k JOIN m ON k.doc_id = m.doc_id WHERE rr <= 5""")
def reverse_rank_csls(spark, sf):
    near = R.best_queries(table(spark, sf, "embeddings"), _queries(spark, sf), 5)
    hub = F.avg("score").over(W.partitionBy("doc_id"))
    return near.select("query_id", "doc_id", F.col("position").alias("rr"), F.round(F.col("score") - hub, 6).alias("csls"))


@query("hubness", _COS + "SELECT doc_id, count(*) AS hits FROM r WHERE position <= 10 GROUP BY doc_id")
def hubness(spark, sf):
    return R.dense_topk(table(spark, sf, "embeddings"), _queries(spark, sf), 10).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("prf_rescore", _COS + """, x AS (SELECT query_id, i, avg(v[i]) AS fb FROM r JOIN e ON r.doc_id = e.vec_id CROSS JOIN (SELECT unnest(range(1, 65)) AS i) WHERE position <= 5 GROUP BY ALL),
  n AS (SELECT x.query_id, list(q[i] + 0.5 * fb ORDER BY i) AS q FROM x JOIN q ON x.query_id = q.query_id GROUP BY ALL),
  s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(q, v), 9) AS score FROM n CROSS JOIN e)
  SELECT query_id, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM s) WHERE position <= 10""")
def prf_rescore(spark, sf):
    """Pseudo-relevance feedback: each query moves half way to the mean of its first five."""
    rows, queries = table(spark, sf, "embeddings"), _queries(spark, sf)
    first = R.dense_topk(rows, queries, 5).join(rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v")), "doc_id")
    mean = first.select("query_id", F.posexplode("v").alias("i", "x")).groupBy("query_id", "i").agg(F.avg("x").alias("fb"))
    vectors = mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "fb"))), lambda s: s["fb"]).alias("fb"))
    moved = queries.join(vectors, F.col("vec_id") == F.col("query_id")).select("vec_id", F.zip_with(F.col("embedding").cast("array<double>"), "fb", lambda a, b: a + 0.5 * b).alias("embedding"))
    return R.dense_topk(rows, moved, 10).select("query_id", "doc_id", "position")


@query("max_inner_product", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(q, embedding::DOUBLE[]), 9) AS score FROM q CROSS JOIN embeddings)
  SELECT query_id, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM s) WHERE position <= 10""")
def max_inner_product(spark, sf):
    return R.dense_topk(table(spark, sf, "embeddings"), _queries(spark, sf), 10, cosine=False).select("query_id", "doc_id", "position")


@query("sparse_dot", f"""WITH d AS (SELECT doc_id, term, ln(1 + count(*)) AS w FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL), q AS (SELECT item_id, term, ln(1 + count(*)) AS w FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT item_id, doc_id, round(sum(q.w * d.w), 9) AS score FROM q JOIN d ON q.term = d.term GROUP BY ALL) SELECT item_id, doc_id, round(score, 6) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS position FROM s) WHERE position <= 20""")
def sparse_dot(spark, sf):
    best = R.sparse_products(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return best.select(F.col("item").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), "position")


@query("verbatim_match", r"""WITH n AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS needle FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS t FROM documents)
 SELECT item_id, doc_id, position(' ' || needle || ' ' IN ' ' || t || ' ') AS at, substr(t, position(' ' || needle || ' ' IN ' ' || t || ' ') + length(needle) + 1, 40) AS after FROM n JOIN d ON needle <> '' AND contains(' ' || t || ' ', ' ' || needle || ' ')""")
def verbatim_match(spark, sf):
    """Whole passages, as words, that stand in a document, with what follows."""
    return R.verbatim(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
