"""Queries that fuse, cut and share out: the pool pairs come from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import calibrate as K
from ..operators import fusion as X
from .registry import query, table

_POOL = """
WITH pool AS MATERIALIZED (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS query_id, l_partkey AS doc_id, max(l_extendedprice) AS a, max(l_quantity * 10 + l_linenumber) AS b,
  max(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice * (1 - l_discount) END) AS c FROM lineitem GROUP BY 1, 2),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, doc_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) AS rb,
  CASE WHEN c IS NULL THEN count(*) OVER (PARTITION BY query_id) ELSE row_number() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST, doc_id) END AS rc,
  1 / (1 + exp(-(a - 40000) / 15000)) AS p FROM pool)
"""


def pool(spark, sf):
    """(query_id, doc_id) with three scores, their ranks (c is missing for some) and a probability."""
    rows = table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 8).alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(
        F.max("l_extendedprice").alias("a"),
        F.max(F.col("l_quantity") * 10 + F.col("l_linenumber")).alias("b"),
        F.max(F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("c"),
    )
    ranked = X.with_rank_missing_last(X.with_rank(X.with_rank(rows, "a", "ra"), "b", "rb"), "c", "rc")
    return ranked.withColumn("p", 1 / (1 + F.exp(-(F.col("a") - 40000) / 15000)))


@query("rank_missing_last", _POOL + "SELECT query_id, doc_id, ra, rb, rc FROM r")
def rank_missing_last(spark, sf):
    return pool(spark, sf).select("query_id", "doc_id", "ra", "rb", "rc")


def _rrf(name, expression, column, keep):
    @query(
        name,
        _POOL + f""", f AS (SELECT query_id, doc_id, ra, round({expression}, 12) AS fused FROM r)
        SELECT query_id, doc_id, position, round(fused, 9) AS fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, ra, doc_id) AS position FROM f) WHERE position <= {keep}""",
    )
    def run(spark, sf):
        return X.top(pool(spark, sf), column(), keep, "ra").select("query_id", "doc_id", "position", F.round("fused", 9).alias("fused"))


_rrf("rrf2", "1.0::DOUBLE / (60 + ra) + 1.0::DOUBLE / (60 + rb)", lambda: X.rrf(["ra", "rb"]), 10)
_rrf("rrf3_missing_last", "1.0::DOUBLE / (60 + ra) + 1.0::DOUBLE / (60 + rb) + 1.0::DOUBLE / (60 + rc)", lambda: X.rrf(["ra", "rb", "rc"]), 15)
_rrf("weighted_rrf", "0.7::DOUBLE / (60 + ra) + 0.3::DOUBLE / (60 + rb)", lambda: X.rrf(["ra", "rb"], [0.7, 0.3]), 10)


@query(
    "rrf_choice",
    _POOL + """, f AS (SELECT query_id, doc_id, ra, round(1.0::DOUBLE / (60 + ra) + 1.0::DOUBLE / (60 + coalesce(CASE WHEN c IS NOT NULL THEN rc END, 201)), 12) AS fused FROM r)
    SELECT query_id, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, ra, doc_id) AS position FROM f) WHERE position <= 10""",
)
def rrf_choice(spark, sf):
    rows = pool(spark, sf).withColumn("rc_or_null", F.when(F.col("c").isNotNull(), F.col("rc")))
    return X.top(rows, X.rrf(["ra", "rc_or_null"], missing=201), 10, "ra").select("query_id", "doc_id", "position")


@query(
    "hybrid_minmax",
    _POOL + """, m AS (SELECT query_id, doc_id, round(CASE WHEN max(a) OVER w > min(a) OVER w THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE 0 END * 0.7
      + CASE WHEN max(b) OVER w > min(b) OVER w THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE 0 END * 0.3, 9) AS hybrid FROM r WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, doc_id, round(hybrid, 4) AS hybrid, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) AS position FROM m) WHERE position <= 20""",
)
def hybrid_minmax(spark, sf):
    rows = pool(spark, sf).withColumn("hybrid", F.round(X.minmax("a") * 0.7 + X.minmax("b") * 0.3, 9))
    return X.with_rank(rows, "hybrid", "position").where("position <= 20").select("query_id", "doc_id", F.round("hybrid", 4).alias("hybrid"), "position")


@query(
    "cut_a1",
    _POOL + """, n AS (SELECT *, count(*) FILTER (WHERE a >= 45000) OVER (PARTITION BY query_id) AS n FROM r)
    SELECT query_id, doc_id, n < 5 AS hit_floor, n > 12 AS hit_ceil FROM n WHERE ra <= least(greatest(n, 5), 12) OR doc_id % 97 = 0""",
)
def cut_a1(spark, sf):
    return X.cut_threshold(pool(spark, sf), "a", 45000, 5, 12, F.col("doc_id") % 97 == 0).select("query_id", "doc_id", "hit_floor", "hit_ceil")


@query(
    "cut_a2_gap",
    _POOL + """, g AS (SELECT query_id, doc_id, ra, CASE WHEN ra >= 5 THEN round(a - lead(a) OVER (PARTITION BY query_id ORDER BY ra), 9) END AS gap FROM r),
    m AS (SELECT *, max(gap) OVER (PARTITION BY query_id) AS top FROM g), p AS (SELECT *, min(CASE WHEN gap = top THEN ra END) OVER (PARTITION BY query_id) AS place FROM m)
    SELECT query_id, doc_id FROM p WHERE ra <= coalesce(place, ra)""",
)
def cut_a2_gap(spark, sf):
    return X.cut_gap(pool(spark, sf), "a", 5).select("query_id", "doc_id")


_CUM = """, k AS (SELECT *, row_number() OVER o AS k, sum(p) OVER (o ROWS UNBOUNDED PRECEDING) AS cum, sum(p) OVER (PARTITION BY query_id) AS g, count(*) OVER (PARTITION BY query_id) AS n
  FROM r WINDOW o AS (PARTITION BY query_id ORDER BY p DESC, doc_id))"""


@query("ef2_cut", _POOL + _CUM + ", v AS (SELECT *, round(5 * cum / (4 * g + k), 9) AS v FROM k WHERE k >= least(5, n)) SELECT query_id, min(k) FILTER (WHERE v = m) AS k, round(max(v), 6) AS value FROM (SELECT *, max(v) OVER (PARTITION BY query_id) AS m FROM v) GROUP BY query_id")
def ef2_cut(spark, sf):
    gold = F.sum("p").over(W.partitionBy("query_id"))
    return X.expected_f2_cut(pool(spark, sf), "p", 5, gold).select("query_id", "k", F.round("value", 6).alias("value"))


@query("ef2_counts", _POOL + _CUM + ", v AS (SELECT *, round(5 * cum / (4 * 1.5 * g + k), 9) AS v FROM k) SELECT query_id, min(k) FILTER (WHERE v = m) AS k FROM (SELECT *, max(v) OVER (PARTITION BY query_id) AS m FROM v) GROUP BY query_id")
def ef2_counts(spark, sf):
    return X.expected_f2_cut(pool(spark, sf), "p", 1, F.sum("p").over(W.partitionBy("query_id")), F.lit(1.5)).select("query_id", "k")


@query(
    "ef2_scaled",
    _POOL + _CUM + """, f AS (SELECT *, max(5 * cum / (4 * g + k)) OVER (PARTITION BY query_id) AS f FROM k WHERE k >= least(5, n)), v AS (SELECT *, round(cum - 1.3 * f / 5 * k, 9) AS v FROM f)
    SELECT query_id, min(k) FILTER (WHERE v = m) AS k FROM (SELECT *, max(v) OVER (PARTITION BY query_id) AS m FROM v) GROUP BY query_id""",
)
def ef2_scaled(spark, sf):
    return X.marginal_cut(pool(spark, sf), "p", 5, F.sum("p").over(W.partitionBy("query_id")), 1.3)


@query("fair_carriers", _POOL + _CUM + " SELECT query_id, doc_id FROM k WHERE k <= ceil(0.37::DOUBLE * n - 1e-12)")
def fair_carriers(spark, sf):
    return X.carriers_fair(pool(spark, sf), "p", 0.37).select("query_id", "doc_id")


@query("fair_carriers_solved")
def fair_carriers_solved(spark, sf):
    """How far the solved share misses its target; steps of the total at shares j / n make an exact hit impossible at times."""
    rows = pool(spark, sf).select("query_id", "doc_id", "p")
    target = int(rows.count() * 0.4)
    chosen = X.carriers_fair(rows, "p", X.solve_rho(rows, target))
    return chosen.agg(F.abs(F.count("*") - target).alias("missed"))


_THRESHOLD_SQL = _POOL + """, o AS (SELECT *, row_number() OVER (ORDER BY a DESC, query_id, doc_id) AS i FROM r), n AS (SELECT query_id, count(*) AS size FROM r GROUP BY 1),
b AS (SELECT query_id, least(3, size) AS low, least(12, size) AS high FROM n), t AS (SELECT CAST(floor(sum((low + high) / 2)) AS BIGINT) AS target FROM b),
c AS (SELECT o.query_id, i, row_number() OVER (PARTITION BY o.query_id ORDER BY i) AS j, low, high FROM o JOIN b ON o.query_id = b.query_id),
s AS (SELECT i, (SELECT sum(low) FROM b) + sum(CASE WHEN j > low AND j <= high THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS total FROM c),
cut AS (SELECT min(i) AS i FROM s WHERE total >= (SELECT target FROM t)),
m AS (SELECT b.query_id, b.low, b.high, count(c.i) AS n FROM b LEFT JOIN c ON b.query_id = c.query_id AND c.i <= (SELECT i FROM cut) GROUP BY ALL)
SELECT query_id, n, least(greatest(n, low), high) AS k FROM m"""


@query("threshold_counts", _THRESHOLD_SQL)
def threshold_counts(spark, sf):
    rows = pool(spark, sf).cache()
    low, high = F.least(F.lit(3), F.col("size")), F.least(F.lit(12), F.col("size"))
    ends = rows.groupBy("query_id").agg(F.count("*").alias("size")).agg(F.sum((low + high) / 2)).first()[0]
    return X.threshold_counts(rows, "a", low, high, int(ends))


@query(
    "allocate_total",
    _POOL.replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS MATERIALIZED (SELECT query_id, count(*) AS high, sum(p) AS raw FROM r GROUP BY 1), t AS (SELECT sum(greatest(1, CAST(floor(high / 2) AS BIGINT))) AS target FROM s),
    b AS (SELECT 0.0::DOUBLE AS low, 4096.0::DOUBLE AS up, 0 AS step UNION ALL SELECT CASE WHEN total < target THEN (low + up) / 2 ELSE low END, CASE WHEN total < target THEN up ELSE (low + up) / 2 END, step + 1
      FROM (SELECT low, up, step, (SELECT sum(least(greatest((b.low + b.up) / 2 * raw, 1), high)) FROM s) AS total FROM b WHERE step < 90) CROSS JOIN t),
    x AS (SELECT query_id, high, least(greatest(up * raw, 1), high) AS x FROM s CROSS JOIN (SELECT up FROM b WHERE step = 90)), f AS (SELECT *, least(CAST(floor(x + 1e-9) AS BIGINT), high) AS base FROM x)
    SELECT query_id, base + (row_number() OVER (ORDER BY CASE WHEN base < high THEN 0 ELSE 1 END, round(base - x, 6), query_id) <= (SELECT target FROM t) - sum(base) OVER ())::BIGINT AS n FROM f""",
)
def allocate_total(spark, sf):
    """Half of all pairs shared out to the queries in proportion to their expected hits, one at least and their pool at most."""
    sizes = pool(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("p").alias("raw")).select("query_id", "raw", F.lit(1).alias("low"), F.col("n").alias("high"))
    target = sizes.agg(F.sum(F.greatest(F.lit(1), F.floor(F.col("high") / 2)))).first()[0]
    return X.allocate_total(sizes, "raw", "low", "high", int(target))


@query(
    "cluster_dedup_refill",
    _POOL + """, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id % 11 ORDER BY ra, doc_id) AS rn FROM r)
    SELECT query_id, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ra, doc_id) AS position FROM c WHERE rn = 1) WHERE position <= 6""",
)
def cluster_dedup_refill(spark, sf):
    return X.dedup_refill(pool(spark, sf).withColumn("cluster", F.col("doc_id") % 11), "cluster", "ra", 6).select("query_id", "doc_id", "position")


@query(
    "swap_carriers",
    _POOL + """, d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, ra DESC) AS low FROM r) SELECT query_id, doc_id FROM d WHERE low > 2""",
)
def swap_carriers(spark, sf):
    low = F.row_number().over(W.partitionBy("query_id").orderBy("p", F.col("ra").desc()))
    return pool(spark, sf).withColumn("low", low).where("low > 2").select("query_id", "doc_id")


@query(
    "first_last_ratio_pieces",
    _POOL + " SELECT query_id, doc_id FROM (SELECT *, first_value(b) OVER (PARTITION BY query_id ORDER BY rb) AS best FROM r) WHERE rb <= 2 AND b >= 0.5 * best",
)
def first_last_ratio_pieces(spark, sf):
    best = F.first("b").over(W.partitionBy("query_id").orderBy("rb"))
    return pool(spark, sf).withColumn("best", best).where("rb <= 2 AND b >= 0.5 * best").select("query_id", "doc_id")


@query(
    "doc_agg",
    """SELECT l_orderkey AS query_id, l_suppkey AS doc_id, round(max(s), 6) AS best, round(sum(s) FILTER (WHERE rn <= 3), 6) AS sum3, round(avg(s) FILTER (WHERE rn <= 2), 6) AS mean2, min(l_linenumber) FILTER (WHERE rn = 1) AS best_chunk
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY s DESC, l_linenumber, l_partkey) AS rn FROM (SELECT *, l_extendedprice * (1 - l_discount) AS s FROM lineitem)) GROUP BY 1, 2""",
)
def doc_agg(spark, sf):
    s = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    w = W.partitionBy("l_orderkey", "l_suppkey").orderBy(F.desc("s"), "l_linenumber", "l_partkey")
    rows = table(spark, sf, "lineitem").withColumn("s", s).withColumn("rn", F.row_number().over(w))
    return rows.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("doc_id")).agg(
        F.round(F.max("s"), 6).alias("best"),
        F.round(F.sum(F.when(F.col("rn") <= 3, F.col("s"))), 6).alias("sum3"),
        F.round(F.avg(F.when(F.col("rn") <= 2, F.col("s"))), 6).alias("mean2"),
        F.min(F.when(F.col("rn") == 1, F.col("l_linenumber"))).alias("best_chunk"),
    )


@query(
    "tiered_rerank",
    _POOL + """, t1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) AS f1 FROM r WHERE ra <= 8), rest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) AS f2 FROM r WHERE ra > 8 AND ra <= 14)
    SELECT query_id, doc_id, 1 AS tier, f1 AS position FROM t1 UNION ALL SELECT query_id, doc_id, 2, 8 + f2 FROM rest""",
)
def tiered_rerank(spark, sf):
    rows = pool(spark, sf)
    first = X.with_rank(rows.where("ra <= 8"), "b", "position").select("query_id", "doc_id", F.lit(1).alias("tier"), "position")
    rest = X.with_rank(rows.where("ra > 8 AND ra <= 14"), "b", "f2").select("query_id", "doc_id", F.lit(2).alias("tier"), (F.col("f2") + 8).alias("position"))
    return first.unionByName(rest)


@query("global_threshold_topn", _POOL + " SELECT query_id, doc_id, n FROM (SELECT *, row_number() OVER (ORDER BY a DESC, query_id, doc_id) AS n FROM r) WHERE n <= 200")
def global_threshold_topn(spark, sf):
    best = pool(spark, sf).orderBy(F.desc("a"), "query_id", "doc_id").limit(200)
    return best.withColumn("n", F.row_number().over(W.orderBy(F.desc("a"), "query_id", "doc_id")).cast("long")).select("query_id", "doc_id", "n")


@query(
    "hedge_append",
    _POOL + """, base AS (SELECT query_id, doc_id, ra FROM r WHERE ra <= 5), lane AS (SELECT * FROM r WHERE b >= 300 AND NOT EXISTS (SELECT 1 FROM base WHERE base.query_id = r.query_id AND base.doc_id = r.doc_id)),
    add AS (SELECT query_id, doc_id, 5 + row_number() OVER (PARTITION BY query_id ORDER BY rb) AS ra FROM lane QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rb) <= 3) SELECT * FROM base UNION ALL SELECT * FROM add""",
)
def hedge_append(spark, sf):
    rows = pool(spark, sf)
    base = rows.where("ra <= 5").select("query_id", "doc_id", "ra")
    lane = rows.where("b >= 300").join(base, ["query_id", "doc_id"], "left_anti")
    lane = lane.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rb"))).where("n <= 3")
    return base.unionByName(lane.select("query_id", "doc_id", (F.col("n") + 5).cast("long").alias("ra")))


@query("merge_evict", _POOL + " SELECT query_id, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, doc_id) AS position FROM r WHERE ra <= 6 OR rb <= 4) WHERE position <= 6")
def merge_evict(spark, sf):
    rows = pool(spark, sf)
    both = rows.where("ra <= 6").unionByName(rows.where("rb <= 4")).dropDuplicates(["query_id", "doc_id"])
    return X.with_rank(both, "a", "position").where("position <= 6").select("query_id", "doc_id", "position")


@query(
    "marginal_curve",
    _POOL + """, o AS (SELECT query_id, doc_id, a, p, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY a DESC, query_id, doc_id) AS i, doc_id % 4 AS lang FROM r),
    w AS (SELECT *, avg(p) OVER (PARTITION BY lang ORDER BY i ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS m FROM o)
    SELECT lang, min(i) FILTER (WHERE round(m, 9) <= 0.5) AS first_at, round(max(a) FILTER (WHERE round(m, 9) <= 0.5), 6) AS threshold FROM w GROUP BY lang""",
)
def marginal_curve(spark, sf):
    rows = pool(spark, sf).select("query_id", "doc_id", "a", "p", (F.col("doc_id") % 4).alias("lang"))
    curve = K.marginal_curve(rows, "lang", "a", "p", 20)
    below = F.round("marginal", 9) <= 0.5
    return curve.groupBy("lang").agg(F.min(F.when(below, F.col("i"))).alias("first_at"), F.round(F.max(F.when(below, F.col("a"))), 6).alias("threshold"))
