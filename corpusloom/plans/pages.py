"""Queries of fetched pages, answer files and passages of one document."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import passages as P
from ..operators import retrieval as R
from ..operators import structure
from ..sources import files
from ..sources.scratch import Scratch
from .registry import query, table

# What a page looks like to the classifier: some of the table's pages are disguised, so that every rule decides for some.
_FETCHED = r"""SELECT page_id, url, CASE page_id % 23 WHEN 1 THEN 'Just a moment...' WHEN 2 THEN 'Trang chủ - x' WHEN 3 THEN '404 ' ELSE 'A page' END AS title, CASE WHEN page_id % 23 IN (1, 3, 4, 5, 6) THEN 150 ELSE length(html) END AS len,
 CASE WHEN page_id % 17 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 503 WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 5 = 0 THEN 429 WHEN page_id % 29 = 0 THEN 302 ELSE 200 END AS status, CASE WHEN page_id % 17 = 0 THEN 'timeout' ELSE '' END AS error,
 CASE page_id % 13 WHEN 0 THEN 'https://home.example.com/' WHEN 1 THEN 'https://x.com/tag/' ELSE url END AS final, CASE page_id % 23 WHEN 4 THEN 'document.cookie = "k=v"' WHEN 5 THEN '<div id="root"></div>' ELSE '' END AS raw,
 CASE WHEN page_id % 31 = 0 THEN 'DISALLOWED' WHEN page_id % 37 = 0 THEN 'UNAVAILABLE' ELSE '' END AS robots FROM pages"""


@query("page_states", rf"""WITH t AS ({_FETCHED}), u AS (SELECT *, regexp_extract(final, '^[^?#]*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1) AS came FROM t)
 SELECT page_id, CASE WHEN robots = 'DISALLOWED' THEN 'robots_disallowed' WHEN robots = 'UNAVAILABLE' THEN 'robots_unavailable' WHEN error <> '' AND status IS NULL THEN 'timeout' WHEN raw LIKE 'document.cookie%' AND len < 2000 AND status BETWEEN 200 AND 399 THEN 'literal_document_cookie_and_short_body'
 WHEN len < 2000 AND title = 'Just a moment...' THEN 'challenge_signature_in_short_response' WHEN status >= 500 THEN 'http_503' WHEN status = 404 THEN 'http_not_found' WHEN path IN ('', '/') OR (path <> came AND path = '/tag/') OR title = 'Trang chủ - x' OR (len < 2000 AND title = '404 ') THEN 'home_listing_or_soft404'
 WHEN status >= 400 THEN 'http_429' WHEN status = 200 AND len < 200 AND raw LIKE '<div%' THEN 'empty_spa_shell' WHEN status = 200 AND len >= 200 THEN 'text_ge_200' WHEN status = 200 THEN 'short_or_empty_content' ELSE 'unexpected_http_status_302' END AS reason FROM u""")
def page_states(spark, sf):
    i, k = F.col("page_id"), F.col("page_id") % 23
    status = F.when(i % 17 == 0, F.lit(None)).when(i % 11 == 0, 503).when(i % 7 == 0, 404).when(i % 5 == 0, 429).when(i % 29 == 0, 302).otherwise(200).cast("int")
    title = F.when(k == 1, "Just a moment...").when(k == 2, "Trang chủ - x").when(k == 3, "404 ").otherwise("A page")
    length = F.when(k.isin(1, 3, 4, 5, 6), 150).otherwise(F.length("html"))
    final = F.when(i % 13 == 0, "https://home.example.com/").when(i % 13 == 1, "https://x.com/tag/").otherwise(F.col("url"))
    raw = F.when(k == 4, 'document.cookie = "k=v"').when(k == 5, '<div id="root"></div>').otherwise("")
    robots = F.when(i % 31 == 0, "DISALLOWED").when(i % 37 == 0, "UNAVAILABLE").otherwise("")
    rows = table(spark, sf, "pages").select("page_id", X.page_state(title, length, status, F.when(i % 17 == 0, "timeout").otherwise(""), F.col("url"), final, raw, F.lit(0), robots).alias("s"))
    return rows.select("page_id", F.col("s.reason").alias("reason"))


@query("strip_tails", r"""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text WHEN trim(split_part(text, chr(10) || 'Licensed under', 1)) <> '' AND contains(text, chr(10) || 'Licensed under') THEN regexp_replace(split_part(text, chr(10) || 'Licensed under', 1), '\s+$', '') ELSE text END AS text FROM documents""")
def strip_tails(spark, sf):
    """The licence line and what follows it go from the documents of three hosts in four; no document is emptied."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("h"), F.col("doc_id") % 4).alias("host"))
    return docs.select("doc_id", X.strip_tail(F.col("host"), F.col("text"), [("licence", ["h0", "h2", "h3"], "\nLicensed under")])["text"].alias("text"))


def _hits(code):
    return rf"len(regexp_extract_all(w, ' (?:{'|'.join(X.LANGUAGE_WORDS[code])}) '))"


@query("language_hints", rf"""WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(substr(text, 1, 1500)), '[^\p{{L}}\p{{N}}_]+', '  ', 'g') || ' ' AS w FROM documents), n AS (SELECT doc_id, unnest([{", ".join(f"{{'lang': '{c}', 'n': {_hits(c)}}}" for c in X.LANGUAGE_WORDS)}]) AS x FROM d),
 b AS (SELECT doc_id, x.lang AS lang, x.n AS n, row_number() OVER (PARTITION BY doc_id ORDER BY x.n DESC, x.lang) AS i FROM n) SELECT doc_id, CASE WHEN n > 0 THEN lang END AS lang FROM b WHERE i = 1""")
def language_hints(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.language_hint(F.col("text")).alias("lang"))


@query("answer_filter", """WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), a AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_partkey) FILTER (WHERE l_partkey % 4 <> 1 AND l_partkey % 7 <> 0) AS kept, count(*) AS n, list(l_partkey ORDER BY l_partkey) AS docs FROM d GROUP BY 1)
 SELECT id, '{"id": ' || id || ',  "relevant_docs": [' || CASE WHEN len(coalesce(kept, [])) = n THEN array_to_string(docs, ', ') ELSE array_to_string(coalesce(kept, []), ',') END || '], "relevant_chunks": []}' AS line FROM a""")
def answer_filter(spark, sf):
    """Ids outside the corpus, and those of dropped hosts, go from answer lines; every other byte stays."""
    docs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("d"))
    lines = docs.select(F.concat(F.lit('{"id": '), "id", F.lit(',  "relevant_docs": ['), F.array_join(F.transform("d", lambda x: x.cast("string")), ", "), F.lit('], "relevant_chunks": []}')).alias("line"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"))
    return files.filter_answers(lines, parts.where("doc_id % 4 <> 1"), parts.where("doc_id % 7 = 0"))


@query("answer_zip_roundtrip", "SELECT conv_id AS id, list(turn ORDER BY turn) FILTER (WHERE role = 'assistant') AS docs FROM conversations GROUP BY 1")
def answer_zip_roundtrip(spark, sf):
    """An answer file of one member with a fixed time stamp in the shared folder, checked by its digest and read back."""
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn").cast("long")))).alias("relevant_docs"))
    none = F.array().cast("array<struct<doc_id: bigint, chunk_text: string>>")
    path = f"{Scratch(spark, 'answers').root}/answers.zip"
    digest = files.write_answer_zip(rows.withColumn("relevant_chunks", none), path)
    if files.member_digest(spark, path) != digest:
        raise ValueError("the archive does not hold what was written")
    return files.read_answer_zip(spark, path).select("id", F.when(F.size("relevant_docs") > 0, F.col("relevant_docs")).alias("docs"))


@query("archive_records", "SELECT url, 200 AS status, 'text/html' AS type, html AS body FROM pages WHERE html IS NOT NULL")
def archive_records(spark, sf):
    """Pages written as archived responses, compressed and in chunks, and parsed back."""
    folder = Scratch(spark, "records").root

    def record(url, html):
        body = gzip.compress(html.encode(), mtime=0)
        parts = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (body[k : k + 700] for k in range(0, len(body), 700))) + b"0\r\n\r\n"
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
        return gzip.compress(b"WARC/1.0\r\n" + (b"" if url is None else b"WARC-Target-URI: " + url.encode() + b"\r\n") + b"\r\n" + head + parts, mtime=0)

    def packed(batches):
        for batch in batches:
            made = [record(u, h) for u, h in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    def parsed(batches):
        for batch in batches:
            rows = [P.parse_response_record(r) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r["url"] for r in rows]), pa.array([r["status"] for r in rows], pa.int32()), pa.array([r["type"] for r in rows]), pa.array([r["body"].decode() for r in rows])], ["url", "status", "type", "body"])

    table(spark, sf, "pages").where("html IS NOT NULL").select("url", "html").mapInArrow(packed, "record binary").write.parquet(folder)
    return spark.read.parquet(folder).mapInArrow(parsed, "url string, status int, type string, body string")


@query("passage_excerpts", r"""WITH b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS needle FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents)
 SELECT item_id, doc_id FROM b JOIN d ON contains(' ' || t || ' ', ' ' || needle || ' ') AND needle <> ''""")
def passage_excerpts(spark, sf):
    """Documents that say a passage up to punctuation, found by its words and read by places."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = R.verbatim(docs, items).select("item_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("needle")), "item_id")
    packed = found.select("item_id", "doc_id", F.struct("text", "needle").alias("x"))
    cut = P.map_column(packed, "x", "excerpt", T.StringType(), lambda x: P.excerpt(x["text"], x["needle"]))
    return cut.where("excerpt IS NOT NULL").select("item_id", "doc_id")


@query("language_shingles", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_filter(string_split(regexp_replace(lower(text), '\s+', '', 'g'), ''), lambda c: c <> '') ELSE regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') END AS t FROM documents),
 x AS (SELECT doc_id, unnest(t) AS x, unnest(range(len(t))) AS i FROM d), g AS (SELECT doc_id, x || ' ' || lead(x, 1) OVER w || ' ' || lead(x, 2) OVER w || ' ' || lead(x, 3) OVER w || ' ' || lead(x, 4) OVER w AS g FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 n AS (SELECT doc_id, count(DISTINCT g) AS n FROM g GROUP BY 1) SELECT d.doc_id, CASE WHEN len(t) >= 5 THEN n WHEN len(t) > 0 THEN 1 ELSE 0 END AS shingles FROM d LEFT JOIN n ON d.doc_id = n.doc_id""")
def language_shingles(spark, sf):
    """Distinct 5-grams of whole texts: of characters in one language in three, of words in the others."""
    lang = F.when(F.col("doc_id") % 3 == 0, "zh").otherwise(F.col("lang"))
    docs = table(spark, sf, "documents").select("doc_id", lang.alias("lang"), "text")
    return docs.select("doc_id", F.size(structure.char_or_word_shingles(F.col("text"), F.col("lang"), 5)).cast("long").alias("shingles"))


@query("score_windows")
def score_windows(spark, sf):
    """Windows of sentences that grow from the best of each document towards the neighbours of higher score."""
    kind = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    def around(text):
        units = [u for u in P.SENTENCE_END.split(text or "") if u]
        if not units:
            return None
        sizes, scores = [P.token_count(u) for u in units], [sum(c in "aeiou" for c in u) / len(u) for u in units]
        first, last = structure.grow(sizes, scores, max(range(len(units)), key=lambda i: (scores[i], -i)), 40)
        return {"first": first, "last": last}

    return P.map_column(table(spark, sf, "documents").select("doc_id", "text"), "text", "w", kind, around).select("doc_id", "w.first", "w.last")


@query("title_questions", r"""SELECT conv_id, turn FROM conversations WHERE role = 'user' AND (trim(string_split(text, chr(10))[1]) LIKE '%?' OR regexp_matches(text, '(?i)^(how|what|why|when|where|who|which|can|is|are|do|does)\s')) AND len(regexp_extract_all(text, '\S+')) BETWEEN 3 AND 40""")
def title_questions(spark, sf):
    """Turns whose first line asks a question, of three to forty words."""
    asks = X.title(F.col("text")).endswith("?") | F.col("text").rlike(r"(?i)^(how|what|why|when|where|who|which|can|is|are|do|does)\s")
    return table(spark, sf, "conversations").where((F.col("role") == "user") & asks & F.regexp_count("text", F.lit(r"\S+")).between(3, 40)).select("conv_id", "turn")


@query("link_members", r"""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages), l AS (SELECT DISTINCT page_id, lower(regexp_extract(href, '://([^/?#]*)', 1)) AS host FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) WHERE href LIKE '%://%')
 SELECT page_id, count(*) AS hosts, count(h.host) AS known FROM l LEFT JOIN h ON l.host = h.host GROUP BY 1""")
def link_members(spark, sf):
    """Hosts that a page links to, and how many of them have pages here."""
    pages = table(spark, sf, "pages")
    host = lambda u: F.lower(F.regexp_extract(u, "://([^/?#]*)", 1))
    known = pages.select(host(F.col("url")).alias("host")).distinct().withColumn("known", F.lit(1))
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)).alias("href")).where("href LIKE '%://%'")
    return links.select("page_id", host(F.col("href")).alias("host")).distinct().join(known, "host", "left").groupBy("page_id").agg(F.count("*").alias("hosts"), F.count("known").alias("known"))
