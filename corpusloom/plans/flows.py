"""Queries of streams, files and passages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import passages as P
from ..sources import files
from ..sources.scratch import Scratch
from ..streaming import control as C
from ..streaming import flows as S
from .registry import query, table


def _folders(spark, name):
    """Output and checkpoint folders of one call; a caller that wants to resume passes its own to ``streaming.flows``."""
    root = Scratch(spark, "stream").root
    return f"{root}/{name}", f"{root}/{name}-checkpoint"


@query("stream_counts", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1")
def stream_counts(spark, sf):
    events = S.source(spark, sf, "events.parquet")
    return S.drain(events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")), *_folders(spark, "counts"), "complete")


@query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, sf):
    return S.drain(S.window_counts(S.source(spark, sf, "events.parquet"), "1 hour", "2 days"), *_folders(spark, "windows"), "complete")


@query("stream_closed_windows", "SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def stream_closed_windows(spark, sf):
    """Only windows that the watermark has passed are given out, each once."""
    return S.drain(S.window_counts(S.source(spark, sf, "events.parquet"), "1 hour", "2 days"), *_folders(spark, "closed"))


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf):
    """Repeated deliveries are dropped: every event comes twice, and stays once."""
    events = S.source(spark, sf, "events.parquet")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return S.drain(S.exact_once(twice, ["event_id"], "90 days"), *_folders(spark, "dedup")).select("event_id", "user_id")


@query("stream_upsert_latest", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert_latest(spark, sf):
    events = S.source(spark, sf, "events.parquet")
    return S.upsert(events, *_folders(spark, "latest"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("stream_error_streaks", """WITH g AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events),
 s AS (SELECT user_id, count(*) AS n FROM g WHERE bad GROUP BY user_id, island) SELECT e.user_id, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN s ON e.user_id = s.user_id GROUP BY 1""")
def stream_error_streaks(spark, sf):
    found = S.drain(S.streaks(S.source(spark, sf, "events.parquet")), *_folders(spark, "streaks"), "update")
    return found.groupBy("user_id").agg(F.max("longest").alias("longest"))


@query("stream_liveness", """WITH m AS (SELECT (epoch_us(max(ts)) // 1000 - 3600000) // 1000 * 1000 AS mark FROM events), f AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t FROM events, m WHERE user_id IS NOT NULL AND epoch_us(ts) // 1000 <= mark),
 g AS (SELECT user_id, t, lag(t) OVER w AS before, lead(t) OVER w AS after FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
 SELECT user_id, t AS "at", 'RUNNING' AS event FROM g WHERE before IS NULL OR t - before >= 86400000 UNION ALL SELECT user_id, t + 86400000, 'DEAD' FROM g, m WHERE after - t >= 86400000 OR (after IS NULL AND t + 86400000 <= mark)""")
def stream_liveness(spark, sf):
    """When each user came to life and when a day of silence had passed, by timers of the event time."""
    events = S.source(spark, sf, "events.parquet").select("event_id", "user_id", "ts")
    return S.drain(C.liveness(events, "user_id", "long", "1 hour", 86_400_000), *_folders(spark, "liveness"))


@query("stream_rate_control")
def stream_rate_control(spark, sf):
    """Rate decisions of every user's log, taken as requests: an error is status 503, the value is the latency."""
    events = S.source(spark, sf, "events.parquet").selectExpr("event_id", "user_id", "ts", "value AS latency", "CASE event_type WHEN 'error' THEN 503 ELSE 200 END AS status")
    rule = C.Rule(window=20, baseline_n=10, pause_ms=6 * 3_600_000, errors=20, least_errors=10)
    return S.drain(C.rate_control(events, "user_id", "long", "1 hour", rule), *_folders(spark, "rates"))


@query("dir_json_roundtrip", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id FROM documents GROUP BY lang")
def dir_json_roundtrip(spark, sf):
    docs = table(spark, sf, "documents")
    path = f"{Scratch(spark, 'shards').root}/pages"
    files.write_shards(docs, path, "lang")
    back = files.read_shards(spark, path, docs.schema)
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"))


@query("merge_schema_scan", "SELECT count(*) AS n, count(extra) AS extra FROM (SELECT p_partkey, NULL AS extra FROM part UNION ALL SELECT p_partkey, p_size FROM part)")
def merge_schema_scan(spark, sf):
    part, path = table(spark, sf, "part"), f"{Scratch(spark, 'merge').root}/parts"
    part.select("p_partkey").write.parquet(f"{path}/k=1")
    part.select("p_partkey", F.col("p_size").alias("extra")).write.parquet(f"{path}/k=2")
    return files.read_tables(spark, path).agg(F.count("*").alias("n"), F.count("extra").alias("extra"))


@query("csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, sf):
    nation, path = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{Scratch(spark, 'csv').root}/nation"
    nation.write.option("header", "true").csv(path)
    return spark.read.schema(nation.schema).option("header", "true").csv(path)


@query("state_merge", "SELECT user_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def state_merge(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("status"), "event_id", F.struct("ts", "event_id").alias("at"))
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return files.merge_rows(old, new, ["user_id"], "at").select("user_id", "status", "event_id")


@query("answer_lines", """SELECT l_orderkey AS id, '{"id":' || l_orderkey || ',"relevant_docs":[' || string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) || '],"relevant_chunks":[]}' AS line FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1""")
def answer_lines(spark, sf):
    docs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("relevant_docs"))
    none = F.array().cast("array<struct<doc_id: bigint, chunk_text: string>>")
    return files.answers(docs.withColumn("relevant_chunks", none))


@query("chunk_pack")
def chunk_pack(spark, sf):
    """Spans of about 128 words with their texts; every span stands in its document at its place."""
    spans = P.chunk_column(table(spark, sf, "documents").select("doc_id", "text"), "text", 128)
    rows = spans.select("doc_id", "text", F.posexplode("chunks").alias("chunk", "s"))
    return rows.select("doc_id", "chunk", "s.field", "s.start", "s.stop", F.expr("substr(text, s.start + 1, s.stop - s.start)").alias("passage"))


@query("html_extract")
def html_extract(spark, sf):
    kind = T.StructType([T.StructField("title", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StringType()))])
    return P.map_column(table(spark, sf, "pages").select("page_id", "html"), "html", "page", kind, P.read_html).select("page_id", "page.title", "page.paragraphs", "page.links")


@query("passage_windows")
def passage_windows(spark, sf):
    kind = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])

    def around(t):
        s, e = P.window(t or "", len(t or "") // 2, len(t or "") // 2, 96)
        return {"start": s, "stop": e}

    return P.map_column(table(spark, sf, "documents").select("doc_id", "text"), "text", "w", kind, around).select("doc_id", "w.start", "w.stop")


@query("answer_dedupe")
def answer_dedupe(spark, sf):
    """Places of a document's paragraphs that stay after equal and near-equal ones are folded out."""
    return P.map_column(table(spark, sf, "documents").select("doc_id", "text"), "text", "kept", T.ArrayType(T.IntegerType()), lambda t: P.fold_repeats((t or "").split("\n"))).select("doc_id", "kept")
