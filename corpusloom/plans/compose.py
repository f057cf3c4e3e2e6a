"""Queries that compose lists, keep registries, calibrate and validate."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import compose as C
from ..operators import fusion as X
from .fusion import _CUM, _POOL, pool
from .registry import query, table


@query("join_complete", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_complete(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return C.join_complete(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), orders, ["l_orderkey"])


@query("lookup_join", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_join(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return C.lookup(table(spark, sf, "supplier"), nation, ["s_nationkey"]).select("s_suppkey", "n_name")


@query("priority_union", _POOL + """, u AS (SELECT query_id, doc_id, a, 0 AS origin FROM r WHERE rb <= 4 UNION ALL SELECT query_id, doc_id, a, 1 FROM r WHERE ra <= 4 UNION ALL SELECT query_id, doc_id, a, 2 FROM r WHERE rc <= 4),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY origin) AS rn FROM u) SELECT query_id, doc_id, origin, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, doc_id) AS position FROM f WHERE rn = 1""")
def priority_union(spark, sf):
    rows = pool(spark, sf)
    parts = [rows.where(f"{r} <= 4").select("query_id", "doc_id", "a") for r in ("rb", "ra", "rc")]
    return X.with_rank(C.union_by_priority(parts, ["query_id", "doc_id"]), "a", "position").drop("a")


@query("append_absent", _POOL + """, base AS (SELECT query_id, doc_id, ra AS position FROM r WHERE ra <= 6), x AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) AS n FROM r WHERE b > 0 AND ra > 6)
 SELECT * FROM base UNION ALL SELECT x.query_id, x.doc_id, coalesce(last, 0) + n FROM x LEFT JOIN (SELECT query_id, max(position) AS last FROM base GROUP BY 1) m ON x.query_id = m.query_id WHERE n <= 4""")
def append_absent(spark, sf):
    rows = pool(spark, sf)
    return C.append_absent(rows.where("ra <= 6").select("query_id", "doc_id", F.col("ra").alias("position")), rows, 4, "b")


@query("pair_registry", _POOL + """, known AS (SELECT query_id, doc_id, row_number() OVER (ORDER BY query_id, doc_id) AS pair_id FROM r WHERE ra <= 3), new AS (SELECT query_id, doc_id FROM r WHERE rb <= 5 AND ra > 3)
 SELECT * FROM known UNION ALL SELECT query_id, doc_id, (SELECT max(pair_id) FROM known) + row_number() OVER (ORDER BY query_id, doc_id) FROM new""")
def pair_registry(spark, sf):
    rows = pool(spark, sf)
    empty = spark.createDataFrame([], "query_id long, doc_id long, pair_id long")
    known = C.assign_ids(empty, rows.where("ra <= 3"), ["query_id", "doc_id"], "pair_id")
    return C.assign_ids(known, rows.where("rb <= 5"), ["query_id", "doc_id"], "pair_id")


@query("override_groups", _POOL + "SELECT query_id, doc_id, CASE WHEN query_id % 3 = 0 THEN b ELSE a END AS s FROM r WHERE query_id % 3 <> 0 OR rb <= 4")
def override_groups(spark, sf):
    rows = pool(spark, sf)
    new = rows.where("query_id % 3 = 0 AND rb <= 4").select("query_id", "doc_id", F.col("b").alias("s"))
    return C.overrides(rows.select("query_id", "doc_id", F.col("a").alias("s")), new, "query_id")


@query("needed_pairs", _POOL + "SELECT query_id, doc_id, rb <= 4 AS free FROM r WHERE rb <= 8 AND NOT (ra <= 5)")
def needed_pairs(spark, sf):
    rows = pool(spark, sf)
    done = rows.where("ra <= 5").select("query_id", "doc_id")
    return rows.where("rb <= 8").join(done, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", (F.col("rb") <= 4).alias("free"))


@query("keep_members", _POOL + "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY ra) AS position FROM r WHERE doc_id IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def keep_members(spark, sf):
    members = table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("doc_id"))
    kept = C.keep_members(pool(spark, sf), members, "doc_id")
    return kept.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy("ra")).cast("long").alias("position"))


@query("trim_first_k", _POOL + "SELECT query_id, doc_id FROM (SELECT *, sum((doc_id % 2 = 0)::INT) OVER (PARTITION BY query_id ORDER BY ra ROWS UNBOUNDED PRECEDING) AS seen FROM r) WHERE doc_id % 2 <> 0 OR seen <= 3")
def trim_first_k(spark, sf):
    return C.first_k_where(pool(spark, sf), F.col("doc_id") % 2 == 0, 3, "ra").select("query_id", "doc_id")


@query("docs_of_one_chunks_of_other", _POOL + "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rb) AS position FROM r WHERE ra <= 10 AND rb <= 10")
def docs_of_one_chunks_of_other(spark, sf):
    rows = pool(spark, sf)
    mixed = rows.where("rb <= 10").join(rows.where("ra <= 10").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return mixed.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy("rb")).cast("long").alias("position"))


@query("replace_slots", _POOL + """, gone AS (SELECT query_id, count(*) AS n FROM r WHERE ra <= 10 AND doc_id % 5 = 0 GROUP BY 1), fresh AS (SELECT r.query_id, doc_id, row_number() OVER (PARTITION BY r.query_id ORDER BY rb) AS k FROM r WHERE ra > 10 AND doc_id % 5 <> 0)
 SELECT query_id, doc_id FROM r WHERE ra <= 10 AND doc_id % 5 <> 0 UNION ALL SELECT f.query_id, f.doc_id FROM fresh f JOIN gone g ON f.query_id = g.query_id WHERE k <= n""")
def replace_slots(spark, sf):
    """As many of the best new documents as slots were freed."""
    rows = pool(spark, sf)
    freed = rows.where("ra <= 10 AND doc_id % 5 = 0").groupBy("query_id").agg(F.count("*").alias("n"))
    fresh = rows.where("ra > 10 AND doc_id % 5 <> 0").withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("rb")))
    return rows.where("ra <= 10 AND doc_id % 5 <> 0").select("query_id", "doc_id").unionByName(fresh.join(freed, "query_id").where("k <= n").select("query_id", "doc_id"))


@query("candidate_stats", _POOL + "SELECT min(n) AS low, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS high, round(avg(n), 6) AS mean FROM (SELECT query_id, count(*) AS n FROM r WHERE ra <= 12 OR rb <= 12 GROUP BY 1)")
def candidate_stats(spark, sf):
    n = pool(spark, sf).where("ra <= 12 OR rb <= 12").groupBy("query_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("low"), F.round(F.percentile("n", 0.5), 6).alias("p50"), F.round(F.percentile("n", 0.95), 6).alias("p95"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean"))


@query("offset_calibration", _POOL.replace("WITH ", "WITH RECURSIVE ", 1) + """, z AS MATERIALIZED (SELECT a / 10000 AS z FROM r), b AS (SELECT -50.0::DOUBLE AS low, 50.0::DOUBLE AS high, 0 AS step
 UNION ALL SELECT CASE WHEN m < 0.3 THEN (low + high) / 2 ELSE low END, CASE WHEN m < 0.3 THEN high ELSE (low + high) / 2 END, step + 1 FROM (SELECT low, high, step, (SELECT avg(1 / (1 + exp(-(z + (b.low + b.high) / 2)))) FROM z) AS m FROM b WHERE step < 60))
 SELECT round(high, 4) AS b, round((SELECT avg(1 / (1 + exp(-(z + x.high)))) FROM z), 4) AS reached FROM b x WHERE step = 60""")
def offset_calibration(spark, sf):
    """The offset that brings the mean probability to 0.3, and the mean that it reaches."""
    rows = pool(spark, sf).select((F.col("a") / 10000).alias("z"))
    b = C.offset_for_mean(rows, "z", 0.3)
    return rows.agg(F.round(F.lit(b), 4).alias("b"), F.round(F.avg(1 / (1 + F.exp(-(F.col("z") + b)))), 4).alias("reached"))


@query("logit_fit", _POOL + "SELECT round(regr_slope(z, x), 4) AS a, round(regr_intercept(z, x), 4) AS b FROM (SELECT a / 10000 AS x, ln(q / (1 - q)) AS z FROM (SELECT a, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM r))")
def logit_fit(spark, sf):
    fit = C.fit_line(pool(spark, sf).select((F.col("a") / 10000).alias("x"), "p"), "x", "p")
    return fit.select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("quantile_map", _POOL + ", x AS (SELECT query_id, doc_id, a, row_number() OVER (ORDER BY a, doc_id, query_id) AS i FROM r), y AS (SELECT b, row_number() OVER (ORDER BY b, doc_id, query_id) AS i FROM r) SELECT query_id, doc_id, round(a, 4) AS a, round(b, 4) AS mapped FROM x JOIN y ON x.i = y.i")
def quantile_map(spark, sf):
    mapped = C.quantile_map(pool(spark, sf), "a", "b")
    return mapped.select("query_id", "doc_id", F.round("from", 4).alias("a"), F.round("to", 4).alias("mapped"))


@query("tail_mass", _POOL + """, l AS (SELECT query_id, p, row_number() OVER (PARTITION BY query_id ORDER BY rb, doc_id) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM r), b AS (SELECT query_id, (k - n + 12 - 1) // 4 AS b, avg(p) + 1e-9 AS m FROM l WHERE n >= 12 AND k > n - 12 GROUP BY ALL),
 s AS (SELECT query_id, regr_slope(ln(m), b) AS slope, max_by(m, b) AS e FROM b GROUP BY 1), d AS (SELECT query_id, e, greatest(-slope / 4, ln(1 + 1 / 50)) AS d FROM s) SELECT query_id, round(e * exp(-(4 / 2 - 0.5) * d) / (exp(d) - 1), 4) AS mass FROM d""")
def tail_mass(spark, sf):
    return C.tail_mass(pool(spark, sf), "p", "rb", 12, 4, 50).select("query_id", F.round("mass", 4).alias("mass"))


@query("greedy_joint", _POOL + _CUM + ", d AS (SELECT query_id, k, p, coalesce(lag(cum) OVER (PARTITION BY query_id ORDER BY k), 0) / (4 * g + k - 1) AS bar FROM k) SELECT query_id, coalesce(min(k) FILTER (WHERE NOT p > bar) - 1, max(k)) AS kept FROM d GROUP BY query_id")
def greedy_joint(spark, sf):
    return C.greedy_joint(pool(spark, sf), "p", F.sum("p").over(W.partitionBy("query_id")))


@query("answer_validation", """WITH a AS (SELECT conv_id AS query_id, turn % 3 AS doc_id FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id AS query_id, turn % 4 AS doc_id, text AS chunk_text FROM conversations), e AS (SELECT DISTINCT conv_id + conv_id % 2 * 100000 AS query_id FROM conversations)
 SELECT 'not_a_member' AS rule, count(*) FILTER (WHERE doc_id NOT IN (0, 1)) AS errors FROM a UNION ALL SELECT 'not_a_number', 0 UNION ALL SELECT 'repeated_document', count(*) FROM (SELECT 1 FROM a GROUP BY query_id, doc_id HAVING count(*) > 1)
 UNION ALL SELECT 'passage_of_unlisted_document', count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = c.query_id AND a.doc_id = c.doc_id)
 UNION ALL SELECT 'equal_passages', count(*) FROM (SELECT 1 FROM c GROUP BY query_id, doc_id, trim(regexp_replace(lower(chunk_text), '\\s+', ' ', 'g')) HAVING count(*) > 1) UNION ALL SELECT 'empty_passage', count(*) FROM c WHERE trim(chunk_text) = ''
 UNION ALL SELECT 'not_verbatim', count(*) FROM c JOIN documents USING (doc_id) WHERE NOT contains(text, chunk_text) UNION ALL SELECT 'query_without_row', count(*) FROM e WHERE query_id NOT IN (SELECT query_id FROM a) UNION ALL SELECT 'row_of_other_query', count(*) FROM a WHERE query_id NOT IN (SELECT query_id FROM e)""")
def answer_validation(spark, sf):
    """All rules of an answer file but that of nearly equal passages, which is tested by itself."""
    rows = table(spark, sf, "conversations")
    a = rows.where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), (F.col("turn") % 3).alias("doc_id"))
    c = rows.select(F.col("conv_id").alias("query_id"), (F.col("turn") % 4).alias("doc_id"), F.col("text").alias("chunk_text"))
    expected = rows.select((F.col("conv_id") + F.col("conv_id") % 2 * 100000).alias("query_id")).distinct()
    return C.validate_answers(a, c, spark.createDataFrame([(0,), (1,)], "doc_id long"), table(spark, sf, "documents"), expected).where("rule <> 'near_passages'")


@query("table_differences", "SELECT 'a' AS side, l_partkey FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 10 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity >= 40) UNION ALL SELECT 'b', l_partkey FROM (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity < 10)")
def table_differences(spark, sf):
    items = table(spark, sf, "lineitem")
    return C.differences(items.where("l_quantity < 10").select("l_partkey"), items.where("l_quantity >= 40").select("l_partkey"))


@query("gate_tolerance", _POOL + "SELECT count(*) AS pairs, count(*) FILTER (WHERE x.a IS NULL OR y.b IS NULL) AS missing, count(*) FILTER (WHERE abs(x.a - y.b) > 30000) AS beyond FROM (SELECT * FROM r WHERE ra <= 10) x FULL JOIN (SELECT query_id, doc_id, b FROM r WHERE rb <= 10) y ON x.query_id = y.query_id AND x.doc_id = y.doc_id")
def gate_tolerance(spark, sf):
    rows = pool(spark, sf)
    a = rows.where("ra <= 10").select("query_id", "doc_id", F.col("a").alias("s"))
    return C.within_tolerance(a, rows.where("rb <= 10").select("query_id", "doc_id", F.col("b").alias("s")), ["query_id", "doc_id"], "s", 30000)


@query("cached_scores", _POOL + "SELECT query_id, doc_id, CASE WHEN ra <= 6 THEN a ELSE b * 2 END AS s FROM r")
def cached_scores(spark, sf):
    rows = pool(spark, sf)
    cache = rows.where("ra <= 6").select("query_id", "doc_id", F.col("a").alias("s"))
    return C.with_cache(rows.select("query_id", "doc_id", "b"), cache, ["query_id", "doc_id"], "s", lambda df: df.withColumn("s", F.col("b") * 2)).select("query_id", "doc_id", "s")


@query("chunk_impact", """WITH c AS (SELECT doc_id, i * 500 AS start, least((i + 1) * 500, n_chars) AS stop FROM documents, LATERAL (SELECT unnest(range(0, n_chars // 500 + 1)) AS i) WHERE i * 500 < n_chars)
 SELECT CASE WHEN doc_id % 3 <> 0 OR stop <= 700 THEN 'none' WHEN start >= 700 THEN 'removed' ELSE 'truncated' END AS impact, count(*) AS n FROM c GROUP BY 1""")
def chunk_impact(spark, sf):
    docs = table(spark, sf, "documents")
    i = F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 500)))
    chunks = docs.select("doc_id", "n_chars", i.alias("i")).where("i * 500 < n_chars").select("doc_id", (F.col("i") * 500).alias("start"), F.least((F.col("i") + 1) * 500, "n_chars").alias("stop"))
    cuts = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(700).alias("cut"))
    return C.impact(chunks, cuts).groupBy("impact").agg(F.count("*").alias("n"))


@query("adaptive_depth", _POOL + "SELECT query_id, least(greatest(count(*) FILTER (WHERE a >= 40000), 8), count(*)) AS keep FROM r GROUP BY 1")
def adaptive_depth(spark, sf):
    return pool(spark, sf).groupBy("query_id").agg(F.least(F.greatest(F.count_if(F.col("a") >= 40000), F.lit(8)), F.count("*")).alias("keep"))


@query("reverse_best_rank", _POOL + "SELECT doc_id, min(ra) AS best, count(*) AS lists FROM r GROUP BY doc_id")
def reverse_best_rank(spark, sf):
    return pool(spark, sf).groupBy("doc_id").agg(F.min("ra").alias("best"), F.count("*").alias("lists"))


@query("strata_sample", "SELECT item_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(item_id::VARCHAR), item_id) AS k FROM (SELECT item_id, CASE WHEN n < 15 THEN 'short' WHEN n <= 40 THEN 'middle' ELSE 'long' END AS stratum FROM (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark))) WHERE k <= 8")
def strata_sample(spark, sf):
    n = F.size(F.split("text", " "))
    rows = table(spark, sf, "benchmark").select("item_id", F.when(n < 15, "short").when(n <= 40, "middle").otherwise("long").alias("stratum"))
    k = F.row_number().over(W.partitionBy("stratum").orderBy(F.md5(F.col("item_id").cast("string")), "item_id"))
    return rows.withColumn("k", k).where("k <= 8").drop("k")


@query("capped_quota", """WITH RECURSIVE s AS MATERIALIZED (SELECT source, count(*) AS n, least(count(*), 20) AS lim FROM documents GROUP BY 1),
 f AS (SELECT source, n, lim, false AS full_, 60.0::DOUBLE AS rest, (SELECT sum(n) FROM s)::DOUBLE AS whole, 0 AS round FROM s
  UNION ALL SELECT source, n, lim, capped, 60.0 - coalesce(sum(lim) FILTER (WHERE capped) OVER (), 0), coalesce(sum(n) FILTER (WHERE NOT capped) OVER (), 0), round + 1 FROM (SELECT *, full_ OR rest * n / whole >= lim AS capped FROM f WHERE round < 40 AND whole > 0)),
 e AS (SELECT * FROM f QUALIFY round = max(round) OVER ()), b AS (SELECT *, CASE WHEN full_ OR whole = 0 THEN lim ELSE CAST(floor(rest * n / whole + 1e-9) AS BIGINT) END AS base, CASE WHEN full_ OR whole = 0 THEN 0 ELSE rest * n / whole - floor(rest * n / whole + 1e-9) END AS part FROM e)
 SELECT source, base + (NOT full_ AND whole > 0 AND row_number() OVER (ORDER BY full_, round(-part, 9), source) <= 60 - sum(base) OVER ())::BIGINT AS quota FROM b""")
def capped_quota(spark, sf):
    """Sixty documents shared out among the sources by size, none above twenty."""
    return X.quota(table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n", 60, 20)


@query("coverage_rollup", "SELECT source, lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def coverage_rollup(spark, sf):
    return table(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("membership_lists", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 2 = 0) > 0 AS any_even, count(*) FILTER (WHERE o_orderkey % 2 = 0) = count(*) AS all_even FROM orders GROUP BY 1")
def membership_lists(spark, sf):
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    even = lambda x: x % 2 == 0
    return lists.select("o_custkey", F.size("ids").cast("long").alias("n"), F.exists("ids", even).alias("any_even"), F.forall("ids", even).alias("all_even"))


@query("usable_captures", "SELECT page_id FROM pages WHERE html LIKE '<!DOCTYPE html>%' AND page_id % 7 <> 0")
def usable_captures(spark, sf):
    return table(spark, sf, "pages").where(F.col("html").startswith("<!DOCTYPE html>") & (F.col("page_id") % 7 != 0)).select("page_id")


@query("near_query_pairs", r"""WITH w AS (SELECT item_id, list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM benchmark) WHERE len(t) >= 3)
 SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)), 6) AS j FROM w x JOIN w y ON x.item_id < y.item_id WHERE len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)) >= 0.5""")
def near_query_pairs(spark, sf):
    """Pairs of query texts with 3-gram Jaccard of at least 0.5: an equi-join on grams counts what they share."""
    from ..functions import text as T

    w = table(spark, sf, "benchmark").select("item_id", T.words(F.col("text")).alias("w")).where(F.size("w") >= 3).select("item_id", T.shingles(F.col("w"), 3).alias("g"))
    one = w.select("item_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    a, b = (one.select(F.col("item_id").alias(x), F.col("n").alias(f"n_{x}"), "gram") for x in ("a", "b"))
    both = a.join(b, "gram").where("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c"))
    j = F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c"))
    return both.select("a", "b", F.round(j, 6).alias("j")).where(j >= 0.5)
