"""Queries of structured passages, junk rules and lane merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import fusion, structure
from ..operators import passages as P
from .fusion import _POOL, pool
from .registry import query, table

_CHUNK = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("section", T.StringType())]))
_PIECE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


@query("structured_chunks")
def structured_chunks(spark, sf):
    rows = P.map_column(table(spark, sf, "documents").select("doc_id", "text"), "text", "chunks", _CHUNK, lambda t: structure.structured(t or "", 96))
    return rows.select("doc_id", F.posexplode("chunks").alias("chunk", "c")).select("doc_id", "chunk", "c.*")


@query("qa_chunks")
def qa_chunks(spark, sf):
    """Each question with its answers: the turns of a conversation between one user turn and the next."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    turns = table(spark, sf, "conversations").withColumn("q", F.sum((F.col("role") == "user").cast("int")).over(w)).where("q > 0")
    groups = turns.groupBy("conv_id", "q").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda s: s["text"]).alias("answers"),
    )
    packed = groups.select("conv_id", "q", F.struct("question", "answers").alias("qa"))
    made = P.map_column(packed, "qa", "pieces", _PIECE, lambda x: structure.qa_chunks(x["question"] or "", [a for a in x["answers"] or [] if a], 96))
    return made.select("conv_id", "q", F.explode("pieces").alias("p")).select("conv_id", "q", "p.*")


@query("site_junk", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, 'src' || doc_id % 3 AS domain FROM documents)
 SELECT doc_id, len(list_filter(l, lambda x, i: NOT (lower(trim(x)) IN ('', domain, 'www.' || domain)) AND NOT ((i <= 3 OR i > len(l) - 3) AND regexp_full_match(x, '[\p{Lu}\p{N} &/-]+') AND len(regexp_extract_all(trim(x), '\S+')) <= 4))) AS kept FROM l""")
def site_junk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.lines(F.col("text")).alias("l"), F.concat(F.lit("src"), F.col("doc_id") % 3).alias("domain"))
    return docs.select("doc_id", F.size(structure.without_site_junk(F.col("l"), F.col("domain"))).cast("long").alias("kept"))


@query("blob_filter", r"SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length(line) > 144 AND NOT regexp_matches(line, '\s')) AS blobs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def blob_filter(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(X.lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(structure.blob(F.col("line"), 16)).alias("blobs"))


@query("cookie_challenge", r"""SELECT page_id, regexp_extract(raw, '(?i)document\s*\.\s*cookie\s*=\s*["''](\w+)=(\w+)["'']', 1) AS name FROM (SELECT page_id, html || CASE WHEN page_id % 9 = 0 THEN '<script>document.cookie = "k' || page_id || '=v1"</script>' ELSE '' END AS raw FROM pages) WHERE page_id % 9 = 0""")
def cookie_challenge(spark, sf):
    extra = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit('<script>document.cookie = "k'), F.col("page_id"), F.lit('=v1"</script>'))).otherwise("")
    c = table(spark, sf, "pages").select("page_id", structure.cookie_challenge(F.concat("html", extra)).alias("c"))
    return c.where("c IS NOT NULL").select("page_id", "c.name")


@query("merge_lanes", _POOL + """, u AS (SELECT query_id, doc_id, a AS score FROM r WHERE ra <= 8 UNION ALL SELECT query_id, doc_id, b * 100 FROM r WHERE rb <= 8), m AS (SELECT query_id, doc_id, max(score) AS score FROM u GROUP BY ALL)
 SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM m QUALIFY position <= 8""")
def merge_lanes(spark, sf):
    rows = pool(spark, sf)
    a = rows.where("ra <= 8").select("query_id", "doc_id", F.col("a").alias("score"))
    b = rows.where("rb <= 8").select("query_id", "doc_id", (F.col("b") * 100).alias("score"))
    return fusion.merge_lanes(a, b, 8).select("query_id", "doc_id", F.round("score", 4).alias("score"), "position")


@query("variable_keep", _POOL + """, n AS (SELECT query_id, count(*) FILTER (WHERE a >= 42000) AS n, count(*) AS size FROM r GROUP BY 1)
 SELECT query_id, CAST(least(greatest(n, ceil(0.6::DOUBLE * 12 - 1e-9)), floor(1.3::DOUBLE * 12 + 1e-9), size) AS BIGINT) AS thr, CAST(least(greatest(round_even(sqrt(n * 12), 0), ceil(0.6::DOUBLE * 12 - 1e-9)), floor(1.3::DOUBLE * 12 + 1e-9), size) AS BIGINT) AS mix FROM n""")
def variable_keep(spark, sf):
    return fusion.variable_keep(pool(spark, sf), "a", F.lit(12), 42000, 0.6, 1.3)


@query("calibrated_threshold")
def calibrated_threshold(spark, sf):
    """Documents kept a query by the cut whose threshold was solved for a mean of ten."""
    rows = pool(spark, sf)
    tau = fusion.calibrate_threshold(rows, "a", 10, 5, 20)
    kept = fusion.cut_threshold(rows, "a", tau, 5, 20).groupBy("query_id").agg(F.count("*").alias("n"))
    return kept.agg(F.round(F.avg("n"), 1).alias("mean"))


@query("watch_table", """SELECT user_id, CASE WHEN user_id % 29 = 0 THEN 'deadline' WHEN n = 0 THEN 'nothing_remains' WHEN user_id % 5 = 0 AND user_id % 2 = 0 THEN 'finished' WHEN user_id % 5 = 0 AND user_id % 3 = 0 THEN 'gave_up' WHEN user_id % 5 = 0 THEN 'restart' WHEN age <= 100 THEN 'ok' WHEN user_id % 7 <> 0 THEN 'suspect' WHEN user_id % 3 = 0 THEN 'gave_up' ELSE 'kill_restart' END AS action
 FROM (SELECT user_id, count(*) AS n, max(event_id) % 300 AS age FROM events GROUP BY 1)""")
def watch_table(spark, sf):
    u = F.col("user_id")
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.max("event_id") % 300).alias("age"))
    action = structure.watch(u % 29 == 0, F.lit(False), F.col("n"), u % 5 != 0, u % 2, F.when(u % 3 == 0, 0).otherwise(1), F.col("age"), 100, u % 7 == 0)
    return per.select("user_id", action.alias("action"))


@query("crawl_window", "SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1996-06-01' THEN 'after' WHEN o_orderdate >= TIMESTAMP '1995-06-01' THEN 'before' ELSE 'out' END AS part FROM orders")
def crawl_window(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", structure.crawl_window(day, F.to_date(F.lit("1996-06-01"))).alias("part"))
