"""Queries of quality rules, document states and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from .registry import query, table

_TITLE = "trim(string_split(text, chr(10))[1])"


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _re(pattern):
    return "'" + pattern.replace("(?iu)", "(?i)").replace("'", "''") + "'"


_BODY = "list_filter(list_transform(string_split(text, chr(10))[2:], lambda x: trim(x)), lambda x: x <> '')"
_SITE = f"lower(regexp_extract({_TITLE}, '(?i)^(?:www\\.)?([a-z0-9.-]+\\.[a-z]{{2,}})$', 1))"
_REASON = f"""CASE WHEN regexp_matches({_TITLE}, {_re(X.LOTTERY_TITLE)}) AND regexp_matches({_TITLE}, {_re(X.RESULT_DATE)}) THEN 'lottery_result'
 WHEN domain = 'suckhoecongdongonline.vn' AND regexp_matches({_TITLE}, {_re(X.TEMPLATE_TITLE)}) THEN 'non_medical_template'
 WHEN regexp_matches({_TITLE}, {_re(X.ERROR_TITLE)}) THEN 'error_title' WHEN {_SITE} <> '' AND (lower(domain) = {_SITE} OR ends_with(lower(domain), '.' || {_SITE})) THEN 'title_is_site'
 WHEN len({_BODY}) >= 10 AND len(list_filter({_BODY}, lambda x: list_contains({_sql_list(X.NAV_LINES)}, x) OR regexp_full_match(x, '[0-9]+'))) >= 0.8 * len({_BODY}) THEN 'menu_only' END"""
# Titles and domains that make every rule decide for some documents.
_TITLED = """SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'suckhoecongdongonline.vn' WHEN 2 THEN 'm.bao.vn' ELSE 'bao.vn' END AS domain, CASE doc_id % 10 WHEN 0 THEN 'XSMB 12/3' || chr(10) WHEN 1 THEN 'Giá vàng' || chr(10) WHEN 2 THEN 'www.Bao.vn' || chr(10)
 WHEN 3 THEN '404 Not Found' || chr(10) WHEN 4 THEN 'x' || repeat(chr(10) || 'Trang chủ', 9) || chr(10) || '7' WHEN 5 THEN 'Giá vàng' || chr(10) ELSE '' END || CASE WHEN doc_id % 10 = 4 THEN '' ELSE text END AS text FROM documents"""


@query("status_filter", "SELECT doc_id, CASE WHEN length(text) >= 200 THEN 'ok' ELSE 'thin' END AS status FROM documents WHERE coalesce(n_chars, 0) >= 50 AND length(text) > 0")
def status_filter(spark, sf):
    docs = table(spark, sf, "documents").where((F.coalesce("n_chars", F.lit(0)) >= 50) & (F.length("text") > 0))
    return docs.select("doc_id", F.when(F.length("text") >= 200, "ok").otherwise("thin").alias("status"))


@query("drop_reasons", f"SELECT doc_id, {_REASON} AS reason FROM ({_TITLED})")
def drop_reasons(spark, sf):
    i = F.col("doc_id") % 10
    heads = {0: "XSMB 12/3\n", 1: "Giá vàng\n", 2: "www.Bao.vn\n", 3: "404 Not Found\n", 4: "x" + "\nTrang chủ" * 9 + "\n7", 5: "Giá vàng\n"}
    head = F.lit("")
    for k, text in heads.items():
        head = F.when(i == k, text).otherwise(head)
    domain = F.when(i == 1, "suckhoecongdongonline.vn").when(i == 2, "m.bao.vn").otherwise("bao.vn")
    titled = F.concat(head, F.when(i == 4, "").otherwise(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", X.drop_reason(domain, titled).alias("reason"))


@query("drop_reason_counts", f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM (SELECT *, source || '.net' AS domain FROM documents) GROUP BY 1")
def drop_reason_counts(spark, sf):
    reason = X.drop_reason(F.concat("source", F.lit(".net")), F.col("text"))
    return table(spark, sf, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("menu_only", f"SELECT doc_id, len({_BODY}) >= 10 AND len(list_filter({_BODY}, lambda x: list_contains({_sql_list(X.NAV_LINES)}, x) OR regexp_full_match(x, '[0-9]+'))) >= 0.8 * len({_BODY}) AS menu FROM documents")
def menu_only(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.menu_only(F.col("text")).alias("menu"))


@query("quality_rules", r"""SELECT doc_id, length(text) >= 200 OR len(regexp_extract_all(text, '[㐀-鿿]')) >= 50 AS passes, length(regexp_replace(text, '\s', '', 'g')) AS solid,
 len(regexp_extract_all(text, '[0-9]')) AS digits, CASE WHEN regexp_matches(text, '[A-Za-z0-9+/=]{200,}') THEN true ELSE false END AS has_blob FROM documents""")
def quality_rules(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", ((F.length(t) >= 200) | (F.regexp_count(t, F.lit("[㐀-鿿]")) >= 50)).alias("passes"), F.length(F.regexp_replace(t, r"\s", "")).cast("long").alias("solid"),
        F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("digits"), t.rlike("[A-Za-z0-9+/=]{200,}").alias("has_blob"),
    )


@query("junk_share", r"""SELECT doc_id, CASE WHEN length(text) > 0 THEN round((coalesce(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_full_match(trim(x), '[A-Za-z0-9+/=]{200,}')), lambda x: length(x))), 0)
 + coalesce(list_sum(list_transform(regexp_extract_all(text, '\{[^{}\n]*\}'), lambda x: length(x))), 0)) / length(text), 6) ELSE 0 END AS junk FROM documents""")
def junk_share(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(X.junk_share(F.col("text")), 6).alias("junk"))


@query("base64_lines", "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_full_match(line, '[A-Za-z0-9+/=]{40,}') GROUP BY 1")
def base64_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(X.lines(F.col("text"))).alias("line"))
    return lines.where(F.col("line").rlike("^[A-Za-z0-9+/=]{40,}$")).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("greeting_strip", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(?i)^(hello|hi|dear doctor|chào bác sĩ|xin chào)[,.! ]*', ''), '(?i)[ ,.]*(thank you|thanks|xin cảm ơn|cảm ơn)[.! ]*$', '')) AS text FROM conversations""")
def greeting_strip(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.strip_greeting(F.col("text")).alias("text"))


@query("truncate_words", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:32], ' ') AS head FROM documents")
def truncate_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate_words(F.col("text"), 32).alias("head"))


@query("length_quantiles", "SELECT lang, count(*) AS n, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def length_quantiles(spark, sf):
    p = lambda q, name: F.round(F.percentile("n_chars", q), 6).alias(name)
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), p(0.25, "p25"), p(0.5, "p50"), p(0.95, "p95"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars"), 6).alias("mean")
    )


@query("nearest_rank_quantile", "SELECT lang, list_sort(list(n_chars))[1 + CAST(floor(0.9 * count(*)) AS BIGINT)] AS p90 FROM documents GROUP BY lang")
def nearest_rank_quantile(spark, sf):
    """sorted[int(p n)]: by rank, so that no group is gathered in one row."""
    w = W.partitionBy("lang").orderBy("n_chars", "doc_id")
    rows = table(spark, sf, "documents").select("lang", "n_chars", F.row_number().over(w).alias("i"), F.count("*").over(W.partitionBy("lang")).alias("n"))
    return rows.where(F.col("i") == F.least(F.floor(F.lit(0.9) * F.col("n")) + 1, F.col("n"))).select("lang", F.col("n_chars").alias("p90"))


@query("mode_lang", "SELECT source, min_by(lang, (-n, lang)) AS lang, max(n) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def mode_lang(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"), F.max("n").alias("n"))


@query("source_stats", "SELECT source, count(*) AS n, median(n_chars) AS median_chars, round(avg((n_chars < 200)::INT), 6) AS thin, round((count(*) - count(DISTINCT sha256(text))) / count(*), 6) AS dup FROM documents GROUP BY source")
def source_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.median("n_chars").alias("median_chars"), F.round(F.avg((F.col("n_chars") < 200).cast("int")), 6).alias("thin"),
        F.round((F.count("*") - F.count_distinct(F.sha2("text", 256))) / F.count("*"), 6).alias("dup"),
    )


@query("wilson_rate", """WITH k AS (SELECT source, sum(quality) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source), c AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM k)
 SELECT source, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM c""")
def wilson_rate(spark, sf):
    k = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    i = X.wilson(F.col("k"), F.col("n"))
    return k.select("source", "n", F.round(i["low"], 6).alias("low"), F.round(i["high"], 6).alias("high"))


@query("weighted_coverage", "SELECT round(sum(w * p) / sum(w), 6) AS coverage FROM (SELECT source, count(*) AS w, avg((l.doc_id IS NOT NULL)::INT) AS p FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)")
def weighted_coverage(spark, sf):
    labelled = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has"))
    p = table(spark, sf, "documents").join(labelled, "doc_id", "left").groupBy("source").agg(F.count("*").alias("w"), F.avg(F.coalesce("has", F.lit(0))).alias("p"))
    return p.agg(F.round(F.sum(F.col("w") * F.col("p")) / F.sum("w"), 6).alias("coverage"))


@query("response_states", r"""WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS len, CASE WHEN page_id % 17 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 503 WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 5 = 0 THEN 429 ELSE 200 END AS status,
 CASE WHEN page_id % 17 = 0 THEN 'timeout' ELSE '' END AS error, CASE WHEN page_id % 13 = 0 THEN 'https://home.example.com/' ELSE url END AS final FROM pages)
 SELECT page_id, CASE WHEN error <> '' AND status IS NULL THEN 'network_error' WHEN status >= 500 THEN 'dead_origin' WHEN status = 404 OR regexp_extract(final, '^[^?#]*?://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN 'soft404_or_home' WHEN status >= 400 THEN 'blocked_4xx' WHEN len >= 200 THEN 'ok' ELSE 'thin' END AS state,
 coalesce(CASE WHEN error <> '' AND status IS NULL THEN true WHEN status >= 500 THEN true WHEN status = 404 OR regexp_extract(final, '^[^?#]*?://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN false ELSE status = 429 END, false) AS transient FROM t""")
def response_states(spark, sf):
    i = F.col("page_id")
    status = F.when(i % 17 == 0, F.lit(None)).when(i % 11 == 0, 503).when(i % 7 == 0, 404).when(i % 5 == 0, 429).otherwise(200).cast("int")
    rows = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").alias("len"), status.alias("status"),
        F.when(i % 17 == 0, "timeout").otherwise("").alias("error"), F.when(i % 13 == 0, "https://home.example.com/").otherwise(F.col("url")).alias("final"),
    )
    rows = rows.withColumn("s", X.page_state(F.col("title"), F.col("len"), F.col("status"), F.col("error"), F.col("url"), F.col("final")))
    return rows.select("page_id", F.col("s.state").alias("state"), X.is_transient(F.col("s.state"), F.col("status")).alias("transient"))


@query("pack_ids", "SELECT doc_id, ((65536 + doc_id % 7)::BIGINT << 32) + doc_id AS packed, doc_id % 7 AS segment FROM documents")
def pack_ids(spark, sf):
    packed = X.pack_id(F.col("doc_id") % 7, F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", packed.alias("packed"), X.unpack_id(packed)["segment"].alias("segment"))


@query("doc_layout", r"""SELECT conv_id, q.text || chr(10) || chr(10) || CASE WHEN position(q.text IN a.text) = 0 THEN a.text ELSE '' END AS doc_text, length(q.text) + 2 AS body_start
 FROM (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1) q JOIN (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1) a USING (conv_id)""")
def doc_layout(spark, sf):
    first = lambda role, name: table(spark, sf, "conversations").where(F.col("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias(name))
    both = first("user", "q").join(first("assistant", "a"), "conv_id")
    body = F.when(F.expr("position(q, a)") == 0, F.col("a")).otherwise("")
    return both.select("conv_id", F.concat("q", F.lit("\n\n"), body).alias("doc_text"), (F.length("q") + 2).cast("long").alias("body_start"))


@query("qa_pairs", "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def qa_pairs(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("sentence_split", r"SELECT doc_id, count(*) AS sentences, max(length(s)) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) AS s FROM documents) GROUP BY doc_id")
def sentence_split(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([^.!?\n]+[.!?]*)"), 1)).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).cast("long").alias("longest"))


@query("html_title_text", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<p[ >]')) AS paragraphs,
 length(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g')) AS visible FROM pages""")
def html_title_text(spark, sf):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), "<[^>]*>", "")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("(?i)<p[ >]")).cast("long").alias("paragraphs"), F.length(bare).cast("long").alias("visible")
    )


@query("links_extract", r"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def links_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)).alias("href"))
