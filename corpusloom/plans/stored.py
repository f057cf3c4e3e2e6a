"""Queries over layouts that are kept: sorted tables, sketches, versioned states, pinned files, work queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sketches
from ..operators.versions import Stale, VersionedTable
from ..sources import files, ranges
from ..sources.scratch import Scratch
from .registry import query, table


@query("key_range_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE o_orderkey BETWEEN c_custkey * 20 AND c_custkey * 20 + c_nationkey % 12)")
def key_range_lookup(spark, sf):
    """Orders whose key lies in a stretch that some customer names, from a sorted table: only files that hold such a stretch are opened."""
    scratch = Scratch(spark, "sorted")
    ranges.write_sorted(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), f"{scratch.root}/orders", "o_orderkey", files=16)
    low, width = F.col("c_custkey") * 20, F.col("c_nationkey") % 12
    asked = table(spark, sf, "customer").select(low.cast("long").alias("lo"), (low + width).cast("long").alias("hi"))
    return ranges.lookup(spark, f"{scratch.root}/orders", asked, "o_orderkey", scratch)


@query("shard_sketches")
def shard_sketches(spark, sf):
    """Distinct users of each type of event, and of every two types together, from stored sketches of the types."""
    scratch = Scratch(spark, "sketches")
    held = scratch.save(sketches.build(table(spark, sf, "events"), "event_type", F.col("user_id")), "types")
    left, right = (held.select(F.col("shard").alias(x), F.col("sketch").alias(f"s_{x}")) for x in ("a", "b"))
    estimate = F.hll_sketch_estimate(F.hll_union("s_a", "s_b"))  # there are as many rows as pairs of types
    return left.join(right, F.col("a") <= F.col("b")).select("a", "b", estimate.alias("users"))


@query("source_overlaps")
def source_overlaps(spark, sf):
    """How far the vocabularies of two sources agree, from the least hashes of each."""
    scratch = Scratch(spark, "overlaps")
    words = table(spark, sf, "documents").select("source", F.explode(X.words(F.col("text"))).alias("word"))
    return sketches.overlaps(scratch.save(sketches.bottom(words, "source", F.col("word")), "least"))


@query("guarded_transitions", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE o_orderstatus END AS status, o_orderstatus = 'F' AS changed FROM orders")
def guarded_transitions(spark, sf):
    """Open orders are held, finished ones are closed, a transition that saw an old state is refused, and the first one is taken back."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    states = VersionedTable(spark, Scratch(spark, "states").root, ["o_orderkey"])
    states.create(orders)
    held = orders.where("status = 'O'").withColumn("status", F.lit("H"))
    seen = states.digest(held)
    first = states.apply(held, seen)
    closed = orders.where("status = 'F'").withColumn("status", F.lit("D"))
    second = states.apply(closed, states.digest(closed))
    try:
        states.apply(held.withColumn("status", F.lit("X")), seen)
        raise AssertionError("an update that saw the state before the first transition was let through")
    except Stale:
        states.rollback(first)
    log = states.log(second).select("o_orderkey", F.lit(True).alias("in_log"))
    return states.read().join(log, "o_orderkey", "left").select("o_orderkey", "status", F.coalesce("in_log", F.lit(False)).alias("changed"))


@query("file_pins", "SELECT * FROM (SELECT 'customer' AS category, count(*) AS rows, sum(c_custkey)::BIGINT AS keys FROM customer UNION ALL SELECT 'part', count(*), sum(p_partkey)::BIGINT FROM part UNION ALL SELECT 'supplier', count(*), sum(s_suppkey)::BIGINT FROM supplier)")
def file_pins(spark, sf):
    """Tables of a run are recorded in its ledger, every file is checked against its digest before use, and what the checked files hold is counted by category."""
    folder, ledger = f"{Scratch(spark, 'pins').root}/files", f"{Scratch(spark, 'ledger').root}/ledger"
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")):
        table(spark, sf, name).select(F.col(key).alias("key")).write.parquet(f"{folder}/{name}")
    files.record(spark, ledger, "input", folder)
    rows = files.read_recorded(spark, ledger, "input")
    category = F.regexp_extract(F.col("_metadata.file_path"), r"/files/([a-z]+)/", 1)
    return rows.groupBy(category.alias("category")).agg(F.count("*").alias("rows"), F.sum("key").alias("keys"))


_QUEUE = """SELECT page_id AS rank, url AS url_norm, CASE WHEN page_id % 7 = 0 THEN 'done' ELSE 'pending' END AS status, CASE WHEN page_id % 3 = 0 THEN page_id % 1000 END AS next_try_at, 'd' AS domain FROM pages"""


@query("claim_batches", f"""WITH q AS ({_QUEUE}), d AS (SELECT * FROM q WHERE status = 'pending' AND (next_try_at IS NULL OR next_try_at <= 500)),
 a AS (SELECT 'fresh first' AS variant, rank, row_number() OVER (ORDER BY next_try_at IS NOT NULL, rank, url_norm) AS place FROM d), b AS (SELECT 'by rank' AS variant, rank, row_number() OVER (ORDER BY rank, url_norm) AS place FROM d) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE place <= 100""")
def claim_batches(spark, sf):
    """The next hundred pages of a work queue, fresh ones first, and as the domain that is selected has them, by rank."""
    i = F.col("page_id")
    queue = table(spark, sf, "pages").select(
        i.alias("rank"), F.col("url").alias("url_norm"), F.when(i % 7 == 0, "done").otherwise("pending").alias("status"), F.when(i % 3 == 0, i % 1000).alias("next_try_at"), F.lit("d").alias("domain")
    )
    out = [files.claim_placed(queue, "d", F.lit(500), 100, selected).select(F.lit(name).alias("variant"), "rank", "place") for name, selected in (("fresh first", False), ("by rank", True))]
    return out[0].unionByName(out[1])


@query("capture_groups", """WITH c AS (SELECT c_custkey AS id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 404 WHEN 'P' THEN 410 ELSE 200 END AS fetched, o_totalprice > 150000 AS ok FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
 SELECT id, CASE WHEN count(o_orderkey) = 0 THEN 'no_capture' WHEN bool_and(fetched IN (404, 410)) THEN 'dead' WHEN bool_or(ok) THEN 'usable' ELSE 'unusable' END AS outcome FROM c GROUP BY id""")
def capture_groups(spark, sf):
    """What the captures of each customer are good for; orders play the captures."""
    captures = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 404).when(F.col("o_orderstatus") == "P", 410).otherwise(200).alias("fetched"), (F.col("o_totalprice") > 150_000).alias("ok"))
    return files.capture_outcomes(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), captures)


@query("mapped_coverage", """SELECT coalesce(status, 'absent') AS status, count(*) AS ids, min(p_partkey) FILTER (WHERE status IS NULL) AS next_id FROM part LEFT JOIN (SELECT l_partkey, max(l_returnflag) AS status FROM lineitem GROUP BY 1) ON p_partkey = l_partkey GROUP BY 1""")
def mapped_coverage(spark, sf):
    """How many mapped ids have which terminal status, and the next one to hand on."""
    status = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_returnflag").alias("status"))
    met = table(spark, sf, "part").select("p_partkey").join(status, "p_partkey", "left")
    return met.groupBy(F.coalesce("status", F.lit("absent")).alias("status")).agg(F.count("*").alias("ids"), F.min(F.when(F.col("status").isNull(), F.col("p_partkey"))).alias("next_id"))
