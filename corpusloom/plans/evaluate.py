"""Queries that evaluate: labels give the gold, sources are the queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import evaluate as E
from ..operators import ranking
from .registry import query, table

_SETS = """
WITH pred AS (SELECT source AS query_id, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 12),
gold AS (SELECT source AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
s AS (SELECT query_id, g, coalesce(n, 0) AS n, coalesce(h, 0) AS h FROM (SELECT query_id, count(*) AS g FROM gold GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS n FROM pred GROUP BY 1) USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS h FROM pred JOIN gold USING (query_id, doc_id) GROUP BY 1) USING (query_id)),
m AS (SELECT query_id, CASE WHEN n > 0 THEN h / n ELSE 0 END AS p, h / g AS r FROM s), f AS (SELECT *, CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END AS f2 FROM m)
"""


def _pred(spark, sf):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf, "documents").withColumn("i", F.row_number().over(w)).where("i <= 12").select(F.col("source").alias("query_id"), "doc_id")


def _gold(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("quality = 1").select(F.col("source").alias("query_id"), "doc_id")


@query("doc_prf", _SETS + "SELECT query_id, round(p, 6) AS p, round(r, 6) AS r, round(f2, 6) AS f2 FROM f")
def doc_prf(spark, sf):
    s = E.document_scores(_pred(spark, sf), _gold(spark, sf))
    return s.select("query_id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f2")])


@query("macro_f2", _SETS + "SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(f2), 6) AS f2, count(*) AS queries FROM f")
def macro_f2(spark, sf):
    s = E.document_scores(_pred(spark, sf), _gold(spark, sf))
    return s.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p", "r", "f2")], F.count("*").alias("queries"))


def _chunks(spark, sf, role):
    words = X.words(F.col("text"))
    return table(spark, sf, "conversations").where(F.col("role") == role).select(F.col("conv_id").alias("query_id"), F.lit(0).alias("doc_id"), F.col("turn").alias("chunk"), words.alias("tokens"))


@query("chunk_match_v1")
def chunk_match_v1(spark, sf):
    return E.passage_scores(_chunks(spark, sf, "assistant"), _chunks(spark, sf, "user"), both_sides=False)


@query("chunk_match_v2")
def chunk_match_v2(spark, sf):
    return E.passage_scores(_chunks(spark, sf, "assistant"), _chunks(spark, sf, "user"), both_sides=True)


@query("lcs_len_pairs")
def lcs_len_pairs(spark, sf):
    """LCS of neighbouring turns of a conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("a"), F.lead(X.words(F.col("text"))).over(w).alias("b"))
    return rows.where("b IS NOT NULL").select("conv_id", "turn", E.lcs("a", "b").alias("lcs"))


@query("recall_curve", "WITH r AS (SELECT quality AS y, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id)) SELECT " + ", ".join(f"round(sum(y) FILTER (WHERE i <= ceil({f} * n)) / sum(y), 6) AS recall_{int(f * 100)}" for f in (0.1, 0.2, 0.3, 0.5)) + " FROM r")
def recall_curve(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return E.recall_curve(rows, [F.desc("n_chars"), "doc_id"], "quality", [0.1, 0.2, 0.3, 0.5])


@query("spearman_judges", """WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS a,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS b FROM lineitem) SELECT g AS l_returnflag, round(corr(a, b), 6) AS rho FROM r GROUP BY g""")
def spearman_judges(spark, sf):
    return E.spearman(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag")


@query("auc_rank", """WITH r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id))
 SELECT lang, round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2) / nullif(count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality <> 1), 0), 6) AS auc FROM r GROUP BY lang""")
def auc_rank(spark, sf):
    return E.auc(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id"), "n_chars", "quality", "lang")


@query("set_diff", "WITH a AS (SELECT doc_id, source FROM documents WHERE n_chars >= 500), b AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0) SELECT coalesce(a.source, b.source) AS source, count(*) FILTER (WHERE b.doc_id IS NULL) AS only_a, count(*) FILTER (WHERE a.doc_id IS NULL) AS only_b, count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1")
def set_diff(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.where("n_chars >= 500").select("doc_id", F.col("source").alias("sa"), F.lit(1).alias("a"))
    b = docs.where("doc_id % 3 <> 0").select("doc_id", F.col("source").alias("sb"), F.lit(1).alias("b"))
    both = a.join(b, "doc_id", "full")
    return both.groupBy(F.coalesce("sa", "sb").alias("source")).agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


@query("beta_prior", "WITH t AS (SELECT source, quality FROM documents JOIN labels USING (doc_id)) SELECT source, round((sum(quality) + 5 * (SELECT avg(quality) FROM t)) / (count(*) + 5), 6) AS rate FROM t GROUP BY source")
def beta_prior(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    mean = rows.agg(F.avg("quality").alias("mean"))
    per = rows.groupBy("source").agg(F.sum("quality").alias("h"), F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(mean)).select("source", F.round((F.col("h") + 5 * F.col("mean")) / (F.col("n") + 5), 6).alias("rate"))


@query("beta_prior_oof", """WITH t AS (SELECT doc_id, source, quality AS y, doc_id % 5 AS fold FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, fold, sum(y) AS h, count(*) AS n FROM t GROUP BY ALL),
 f AS (SELECT fold, ((SELECT sum(h) FROM c) - sum(h)) / ((SELECT sum(n) FROM c) - sum(n)) AS mean FROM c GROUP BY fold),
 o AS (SELECT source, c.fold, (sum(h) OVER w - h + 5 * mean) / (sum(n) OVER w - n + 5) AS rate FROM c JOIN f ON c.fold = f.fold WINDOW w AS (PARTITION BY source)) SELECT doc_id, round(rate, 6) AS rate FROM t JOIN o ON t.source = o.source AND t.fold = o.fold""")
def beta_prior_oof(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", "quality")
    return E.out_of_fold_rate(rows, "source", "quality", F.col("doc_id") % 5, 5.0).select("doc_id", F.round("rate", 6).alias("rate"))


@query("id_bins_prior", "WITH t AS (SELECT doc_id, quality AS y, ntile(20) OVER (ORDER BY doc_id) AS bin FROM labels) SELECT bin, count(*) AS n, round((sum(y) + 5 * (SELECT avg(y) FROM t)) / (count(*) + 5), 6) AS rate FROM t GROUP BY bin")
def id_bins_prior(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    n = labels.agg(F.count("*").alias("all"))
    rows = ranking.place(labels, ["doc_id"], "i").crossJoin(F.broadcast(n)).select("quality", ranking.tile(F.col("i"), F.col("all"), 20).alias("bin"))
    per = rows.groupBy("bin").agg(F.sum("quality").alias("h"), F.count("*").alias("n"))
    mean = per.agg((F.sum("h") / F.sum("n")).alias("mean"))
    return per.crossJoin(F.broadcast(mean)).select("bin", "n", F.round((F.col("h") + 5 * F.col("mean")) / (F.col("n") + 5), 6).alias("rate"))


@query("macro_micro", "SELECT round(avg(m), 6) AS macro, (SELECT round(avg(quality), 6) FROM labels JOIN documents USING (doc_id)) AS micro FROM (SELECT source, avg(quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def macro_micro(spark, sf):
    per = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("m"), F.sum("quality").alias("h"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum("h") / F.sum("n"), 6).alias("micro"))


@query("rank_band_profile", "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM documents) SELECT CASE WHEN i <= 10 THEN '1-10' WHEN i <= 20 THEN '11-20' WHEN i <= 40 THEN '21-40' ELSE '41+' END AS band, lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM r GROUP BY ALL")
def rank_band_profile(spark, sf):
    i = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    rows = table(spark, sf, "documents").select("lang", "n_chars", i.alias("i"))
    band = F.when(F.col("i") <= 10, "1-10").when(F.col("i") <= 20, "11-20").when(F.col("i") <= 40, "21-40").otherwise("41+")
    return rows.groupBy(band.alias("band"), "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("logit_calibration", "SELECT round(avg(1 / (1 + exp(-(0.52981 * ln(p / (1 - p)) - 1.4097)))), 6) AS mean FROM (SELECT least(greatest(l_discount * 5 + 0.1, 1e-6), 1 - 1e-6) AS p FROM lineitem)")
def logit_calibration(spark, sf):
    p = F.col("l_discount") * 5 + 0.1
    return table(spark, sf, "lineitem").agg(F.round(F.avg(X.sigmoid(0.52981 * X.logit(p) - 1.4097)), 6).alias("mean"))
