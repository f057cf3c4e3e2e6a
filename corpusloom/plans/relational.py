"""Relational queries over the TPC-H-like tables: joins, grouping sets, windows, set operations, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import corpus, fusion, ranking
from .registry import query, table

_REV = "l_extendedprice * (1 - l_discount)"


def _rev():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _sum(c, name, digits=2):
    return F.round(F.sum(c), digits).alias(name)


@query("tpch_q1", f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({_REV}), 2) AS sum_disc, round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge,
 round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def tpch_q1(spark, sf):
    avg = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        _sum("l_quantity", "sum_qty"), _sum("l_extendedprice", "sum_base"), _sum(_rev(), "sum_disc"), _sum(_rev() * (1 + F.col("l_tax")), "sum_charge"),
        avg("l_quantity", "avg_qty"), avg("l_extendedprice", "avg_price"), avg("l_discount", "avg_disc"), F.count("*").alias("n"),
    )


@query("tpch_q3", f"""SELECT l_orderkey, round(sum({_REV}), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def tpch_q3(spark, sf):
    customers = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf, "orders").where("o_orderdate < TIMESTAMP '1995-03-15'")
    items = table(spark, sf, "lineitem").where("l_shipdate > TIMESTAMP '1995-03-15'")
    joined = customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_orderkey", "o_orderdate").agg(_sum(_rev(), "revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("tpch_q5", f"""SELECT n_name, round(sum({_REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1995-01-01' GROUP BY n_name""")
def tpch_q5(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = (
        t("customer").join(t("orders").where("o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1995-01-01'"), F.col("c_custkey") == F.col("o_custkey"))
        .join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name").agg(_sum(_rev(), "revenue"))


@query("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.04999 AND 0.07001 AND l_quantity < 24")
def tpch_q6(spark, sf):
    return table(spark, sf, "lineitem").where("l_discount BETWEEN 0.04999 AND 0.07001 AND l_quantity < 24").agg(_sum(F.col("l_extendedprice") * F.col("l_discount"), "revenue"))


@query("tpch_q10", f"""SELECT c_custkey, c_name, round(sum({_REV}), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
 WHERE l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""")
def tpch_q10(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("c_custkey", "c_name", "n_name").agg(_sum(_rev(), "revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("tpch_q12", "SELECT l_linestatus, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def tpch_q12(spark, sf):
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("l_linestatus").agg(F.count_if(high).alias("high"), F.count_if(~high).alias("low"))


@query("tpch_q14", f"SELECT round(100 * sum(CASE WHEN p_type LIKE '%PROMO%' OR p_size < 10 THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey")
def tpch_q14(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.agg(F.round(100 * F.sum(F.when(F.col("p_type").contains("PROMO") | (F.col("p_size") < 10), _rev()).otherwise(0)) / F.sum(_rev()), 6).alias("share"))


@query("tpch_q18", "SELECT o_custkey, o_orderkey, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING sum(l_quantity) > 150 ORDER BY quantity DESC, o_orderkey LIMIT 100")
def tpch_q18(spark, sf):
    big = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 150")
    joined = table(spark, sf, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_custkey", "o_orderkey", F.round("q", 2).alias("quantity")).orderBy(F.desc("quantity"), "o_orderkey").limit(100)


@query("rollup_sales", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(_sum("l_quantity", "qty"), F.count("*").alias("n"))


@query("cube_sales", "SELECT l_returnflag, l_linestatus, l_linenumber, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def cube_sales(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus", "l_linenumber").agg(_sum("l_quantity", "qty"))


@query("grouping_sets", "SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY GROUPING SETS ((c_mktsegment), (o_orderpriority), ())")
def grouping_sets(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupingSets([["c_mktsegment"], ["o_orderpriority"], []], "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 200000")
    return table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_join(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 200000")
    return table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("left_join_defaults", "SELECT p_partkey, coalesce(n, 0) AS n, coalesce(flag, 'absent') AS flag FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey")
def left_join_defaults(spark, sf):
    n = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))
    joined = table(spark, sf, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("flag", F.lit("absent")).alias("flag"))


@query("full_outer_diff", "SELECT coalesce(a.k, b.k) AS k, a.n AS a_n, b.n AS b_n FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def full_outer_diff(spark, sf):
    side = lambda flag, name: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias(name))
    return side("A", "a_n").join(side("R", "b_n"), "k", "full").where(~F.col("a_n").eqNullSafe(F.col("b_n")))


@query("pivot_flags", "SELECT l_linenumber, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS A, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2) AS N, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS R FROM lineitem GROUP BY 1")
def pivot_flags(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 2))


@query("union_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size < 3")
def union_ids(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id")).union(table(spark, sf, "part").where("p_size < 3").select("p_partkey")).distinct()


@query("intersect_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def intersect_ids(spark, sf):
    ids = lambda f: table(spark, sf, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("id"))
    return ids("A").intersect(ids("R"))


@query("except_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def except_ids(spark, sf):
    ids = lambda f: table(spark, sf, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("id"))
    return ids("A").subtract(ids("R"))


@query("ordered_union_arrays", "SELECT o_custkey, array_to_string(list(p ORDER BY first), ',') AS kinds FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_union_arrays(spark, sf):
    """Lists joined in order, first occurrences kept."""
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("rows"))
    return rows.select("o_custkey", F.array_join(F.array_distinct(F.transform("rows", lambda r: r["o_orderpriority"])), ",").alias("kinds"))


@query("lag_lead", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS step, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_lead(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("step"), F.lead("o_orderkey").over(w).alias("following"))


@query("ntile_blocks", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS block FROM orders")
def ntile_blocks(spark, sf):
    w = W.partitionBy("o_orderpriority").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("block"))


@query("moving_avg", "SELECT event_id, round(sum(value) OVER w, 2) AS total, count(*) FILTER (WHERE event_type = 'error') OVER w AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def moving_avg(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return table(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w), 2).alias("total"), F.count_if(F.col("event_type") == "error").over(w).alias("errors"))


@query("asof_event", "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_event(spark, sf):
    """The last view at or before each purchase: one pass over the union, no inequality join."""
    events = table(spark, sf, "events").where("event_type IN ('purchase', 'view')")
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return events.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", "view_id")


@query("latest_before", """SELECT user_id, event_id, after_cut FROM (SELECT *, ts > TIMESTAMP '2024-01-15' AS after_cut, row_number() OVER (PARTITION BY user_id ORDER BY ts > TIMESTAMP '2024-01-15',
 CASE WHEN ts > TIMESTAMP '2024-01-15' THEN epoch_us(ts) ELSE -epoch_us(ts) END, event_id DESC) AS rn FROM events WHERE event_type = 'view') WHERE rn = 1""")
def latest_before(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'view'").withColumn("ts", F.col("ts").cast("timestamp"))
    return corpus.latest_before(rows, ["user_id"], "ts", F.lit("2024-01-15").cast("timestamp"), "event_id").select("user_id", "event_id", "after_cut")


@query("interval_join", """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), s AS (SELECT event_id AS start_id, user_id, ts AS a, ts + INTERVAL 1 HOUR AS b FROM events WHERE event_type = 'click')
 SELECT start_id, event_id FROM s JOIN e ON s.user_id = e.user_id AND e.ts >= a AND e.ts < b""")
def interval_join(spark, sf):
    """Range join by hour buckets: an interval of an hour touches two buckets, so the join is an equi-join on user and bucket."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("hour", F.floor(F.unix_micros("ts") / 3_600_000_000))
    e = events.where("event_type = 'error'").select("event_id", "user_id", F.col("ts").alias("at"), "hour")
    s = events.where("event_type = 'click'").select(F.col("event_id").alias("start_id"), "user_id", F.col("ts").alias("a"), F.explode(F.array("hour", F.col("hour") + 1)).alias("hour"))
    return s.join(e, ["user_id", "hour"]).where("at >= a AND at < a + INTERVAL 1 HOUR").select("start_id", "event_id")


@query("sessionize", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(event_id) AS first_id, round(sum(value), 6) AS value FROM s GROUP BY 1, 2""")
def sessionize(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    new = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > 6 * 3_600_000_000, F.lit(True))
    rows = events.withColumn("session", F.sum(new.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 6).alias("value"))


@query("error_streaks", """WITH g AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events)
 SELECT user_id, min(event_id) AS any_id, count(*) AS streak FROM g WHERE bad GROUP BY user_id, island HAVING count(*) >= 2""")
def error_streaks(spark, sf):
    events = table(spark, sf, "events").withColumn("bad", F.col("event_type") == "error")
    at = lambda *p: F.row_number().over(W.partitionBy(*p).orderBy("ts", "event_id"))
    islands = events.withColumn("island", at("user_id") - at("user_id", "bad")).where("bad")
    return islands.groupBy("user_id", "island").agg(F.min("event_id").alias("any_id"), F.count("*").alias("streak")).where("streak >= 2").drop("island")


@query("count_window", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT user_id, (i - 1) // 20 AS block, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, round(avg((event_type = 'error')::INT), 6) AS errors FROM r GROUP BY ALL")
def count_window(spark, sf):
    rows = table(spark, sf, "events").withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return rows.groupBy("user_id", F.floor((F.col("i") - 1) / 20).alias("block")).agg(
        F.count("*").alias("n"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("errors")
    )


@query("tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("sliding", "SELECT s AS start, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS errors FROM events, (SELECT unnest([0, 30]) AS back) CROSS JOIN LATERAL (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - back * INTERVAL 1 MINUTE AS s) GROUP BY s")
def sliding(spark, sf):
    w = table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"))
    return w.agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("errors")).select(F.col("w.start").alias("start"), "n", "errors")


@query("retry_queue", "SELECT user_id, event_id, n_before + 1 AS attempts FROM (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM events) WHERE event_type = 'error' AND n_before + 1 < 3")
def retry_queue(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    rows = table(spark, sf, "events").withColumn("before", F.count_if(F.col("event_type") == "error").over(w))
    return rows.where("event_type = 'error' AND before + 1 < 3").select("user_id", "event_id", (F.col("before") + 1).alias("attempts"))


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf):
    return corpus.upsert_latest(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("json_props", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("heartbeat", "SELECT user_id, CASE WHEN max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'RUNNING' WHEN bool_or(event_type = 'purchase') THEN 'EXITED' ELSE 'DEAD' END AS state FROM events GROUP BY user_id")
def heartbeat(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = events.agg(F.max("ts").alias("newest"))
    per = events.groupBy("user_id").agg(F.max("ts").alias("last"), F.bool_or(F.col("event_type") == "purchase").alias("bought")).crossJoin(F.broadcast(newest))
    return per.select("user_id", F.when(F.col("last") >= F.col("newest") - F.expr("INTERVAL 1 DAY"), "RUNNING").when(F.col("bought"), "EXITED").otherwise("DEAD").alias("state"))


@query("scan_prune", "SELECT count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900")
def scan_prune(spark, sf):
    return table(spark, sf, "lineitem").where("l_orderkey BETWEEN 100 AND 900").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@query("explode_regroup", "SELECT o_custkey, count(*) AS n, min(l_partkey) AS first_part FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) GROUP BY 1")
def explode_regroup(spark, sf):
    """An array of ids is exploded, semi-joined and grouped again."""
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    rows = table(spark, sf, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.explode("parts").alias("part"))
    kept = rows.join(table(spark, sf, "part").where("p_size < 20"), F.col("part") == F.col("p_partkey"), "left_semi")
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("part").alias("first_part"))


@query("version_choice", """WITH v AS (SELECT l_partkey, l_suppkey, bool_or(l_returnflag = 'N') AS live, max(l_quantity) AS body, min(l_shipdate) AS birth FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, l_suppkey FROM v QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY live DESC, body >= 30 DESC, birth DESC, body DESC, l_suppkey) = 1""")
def version_choice(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "N").alias("live"), F.max("l_quantity").alias("body"), F.min("l_shipdate").alias("birth"))
    w = W.partitionBy("l_partkey").orderBy(F.desc("live"), (F.col("body") >= 30).desc(), F.desc("birth"), F.desc("body"), "l_suppkey")
    return v.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_partkey", "l_suppkey")


@query("approx_distinct", None)
def approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.approx_count_distinct("l_partkey").alias("parts"))


@query("band_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(median(l_extendedprice), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(avg((l_extendedprice > 50000)::INT), 6) AS share FROM lineitem GROUP BY 1")
def band_quantiles(spark, sf):
    share = {"share": F.round(F.avg((F.col("l_extendedprice") > 50000).cast("int")), 6)}
    per = ranking.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, share)
    return per.withColumns({n: F.round(n, 6) for n in ("p10", "p50", "p90")})


@query("lane_budget", """WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, s_suppkey, n, 50.0::DOUBLE + s_suppkey % 7 AS rate FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey),
 f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS s_suppkey, 0::BIGINT AS cut, 30.0::DOUBLE AS rest UNION ALL SELECT d.i, d.s_suppkey, c, greatest(0, rest - c / rate) FROM f JOIN d ON d.i = f.i + 1, LATERAL (SELECT least(n, CAST(floor(rest * rate + 1e-9) AS BIGINT), CAST(ceil(n * 0.95::DOUBLE) AS BIGINT)) AS c))
 SELECT s_suppkey, cut FROM f WHERE i > 0""")
def lane_budget(spark, sf):
    """Domains share hours one after the other."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return fusion.sequential_budget(n.withColumn("rate", F.lit(50.0) + F.col("s_suppkey") % 7), "s_suppkey", "n", "rate", 30.0, 0.95)


@query("host_stats", "SELECT source, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source")
def host_stats(spark, sf):
    docs = table(spark, sf, "documents")
    total = docs.agg(F.count("*").alias("total"))
    per = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"))
    return per.crossJoin(F.broadcast(total)).select("source", "docs", "bytes", F.round(F.col("docs") / F.col("total"), 6).alias("share"))


@query("constraint_errors", """SELECT 'duplicate_id' AS rule, count(*) - count(DISTINCT doc_id) AS errors FROM documents UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT 'wrong_length', count(*) FROM documents WHERE length(text) <> n_chars UNION ALL SELECT 'empty_text', count(*) FROM documents WHERE text IS NULL OR text = ''""")
def constraint_errors(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rule = lambda name, df: df.select(F.lit(name).alias("rule"), F.col("errors"))
    return (
        rule("duplicate_id", docs.agg((F.count("*") - F.count_distinct("doc_id")).alias("errors")))
        .unionByName(rule("label_without_document", labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("errors"))))
        .unionByName(rule("wrong_length", docs.agg(F.count_if(F.length("text") != F.col("n_chars")).alias("errors"))))
        .unionByName(rule("empty_text", docs.agg(F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("errors"))))
    )


@query("state_transitions", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'deferred' WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS status FROM orders) GROUP BY 1""")
def state_transitions(spark, sf):
    flagged = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(True))
    rows = table(spark, sf, "orders").join(flagged, "o_orderkey", "left")
    status = F.when((F.col("o_orderstatus") == "O") & F.col("has"), "deferred").when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderstatus"))
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
