"""Queries that read pages and texts by rules and small models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import language, passages, phrases, selectors
from .registry import query, table


@query("detect_language")
def detect_language(spark, sf):
    """The language of every document by letter n-grams learned from all labelled ones."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return language.detect(docs, language.train(docs))


@query("search_phrases")
def search_phrases(spark, sf):
    """The word runs of each item that are most worth searching for, by how rare their words are among the items."""
    return phrases.search_phrases(table(spark, sf, "benchmark"))


SITE_RULES = {
    "org": selectors.Rules(content=("article", "main", "#content", "body"), remove=(".ad", "footer", "header"), junk=(r"^(?i:share|read more)\b",)),
    "net": selectors.Rules(content=("div.post p", "p"), cut=(r"^(?i:related|comments)\b",)),
}


@query("selector_extract")
def selector_extract(spark, sf):
    """Title and paragraphs of every page by the selectors of its site."""
    site = F.regexp_extract(F.lower("url"), r"://[^/?#:]*\.([a-z]+)(?:[/?#:]|$)", 1)
    pages = table(spark, sf, "pages").select("page_id", "html", site.alias("site"))
    return selectors.extract_pages(pages, SITE_RULES).select("page_id", "title", "paragraphs")


# The answers to requests for a site's rules: the status, and rules with a path of the page's own.
_ROBOTS = r"""SELECT page_id, regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1) AS path, CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 503 WHEN 2 THEN 429 WHEN 3 THEN 403 WHEN 4 THEN 404 ELSE 200 END AS status, page_id % 3 AS kind FROM pages"""


@query("robots_states", rf"""WITH r AS ({_ROBOTS}) SELECT page_id, CASE WHEN status IS NULL OR status IN (503, 429) THEN 'UNAVAILABLE' WHEN status = 403 THEN 'DISALLOWED' WHEN status = 404 THEN 'no_robots' WHEN kind = 2 THEN 'no_robots_html_fallback' ELSE 'robots_ok' END AS state,
 CASE WHEN status IS NULL OR status IN (503, 429, 403) THEN false WHEN status = 404 OR kind = 2 THEN true WHEN kind = 0 THEN NOT (starts_with(path, '/p') AND NOT starts_with(path, '/page')) ELSE path <> '/' END AS allowed, CASE WHEN status = 200 AND kind = 0 THEN 5.0 WHEN status = 200 AND kind = 1 THEN 2.5 END AS delay FROM r""")
def robots_states(spark, sf):
    """Whether a page may be fetched, and how long to wait, by the rules of its site and the way they were answered."""
    i = F.col("page_id")
    status = F.when(i % 8 == 1, 503).when(i % 8 == 2, 429).when(i % 8 == 3, 403).when(i % 8 == 4, 404).when(i % 8 > 4, 200)
    some = "User-agent: other\nDisallow: /\n\nUser-agent: loom\nDisallow: /p # most\nAllow: /page\nCrawl-delay: 2\nCrawl-delay: 4\nRequest-rate: 1/5\n\nUser-agent: *\nDisallow: /"
    rules = F.when(i % 3 == 0, some).when(i % 3 == 1, "User-agent: *\nDisallow: /$\nCrawl-delay: 2.5").otherwise("<!DOCTYPE html><p>User-agent: *")
    path = F.regexp_extract("url", r"^[^?#]*?://[^/?#]*([^?#]*)", 1)
    kind = T.StructType([T.StructField("state", T.StringType()), T.StructField("allowed", T.BooleanType()), T.StructField("delay", T.DoubleType())])
    asked = table(spark, sf, "pages").select("page_id", F.struct(status.alias("status"), rules.alias("robots"), path.alias("path")).alias("x"))
    said = passages.map_column(asked, "x", "said", kind, lambda x: passages.robots_answer(x["status"], x["robots"], x["path"], "loom/1.0"))
    return said.select("page_id", "said.state", "said.allowed", "said.delay")


@query("decoded_pages", "SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN page_id % 50 + 0.0 WHEN 1 THEN page_id % 60 + 60.0 END AS wait FROM pages")
def decoded_pages(spark, sf):
    """Pages read back from their bytes by header, declaration or guess, and the wait that their Retry-After asks for, in seconds or as a date."""
    i = F.col("page_id")
    utf16 = i % 4 == 2
    body = F.when(utf16, F.encode(F.coalesce("html", F.lit("")), "UTF-16BE")).otherwise(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    header = F.when(utf16, "text/html; charset=utf-16-be").when(i % 4 == 1, 'text/html; charset="no-such-charset"').otherwise("text/html")
    date = F.concat(F.lit("Thu, 01 Jan 1970 00:02:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(" GMT"))
    later = F.when(i % 4 == 0, (i % 50).cast("string")).when(i % 4 == 1, date).when(i % 4 == 2, "soon")
    kind = T.StructType([T.StructField("html", T.StringType()), T.StructField("wait", T.DoubleType())])
    rows = table(spark, sf, "pages").select("page_id", F.col("html").isNull().alias("none"), F.struct(body.alias("body"), header.alias("header"), later.alias("later")).alias("x"))
    read = passages.map_column(rows, "x", "read", kind, lambda x: {"html": passages.decode_page(x["body"], x["header"]), "wait": passages.retry_after(x["later"], 60.0)})
    return read.select("page_id", F.when(~F.col("none"), F.col("read.html")).alias("html"), F.col("read.wait").alias("wait"))
