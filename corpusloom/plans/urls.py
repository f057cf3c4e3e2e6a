"""Queries over URLs of ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import corpus
from .registry import query, table

_PARTS = r"""
WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare FROM pages),
n AS (SELECT *, regexp_extract(bare, '^([^/?]*)', 1) AS netloc, regexp_extract(bare, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(bare, '\?(.*)$', 1) AS q FROM b),
d AS (SELECT *, regexp_replace(lower(regexp_replace(netloc, '^.*@', '')), '^www\.', '') AS domain FROM n),
u AS (SELECT *, regexp_replace(domain, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_norm FROM d)
"""
_STEM = r"""
, s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM u),
t AS (SELECT *, regexp_replace(coalesce(url_decode(segs[-1]), ''), '(?i)\.(html?|shtml|aspx?|php)$', '') AS stem FROM s)
"""


@query("url_norm", _PARTS + "SELECT page_id, url_norm, domain, domain || regexp_replace(path, '/+$', '') AS loose_key FROM u")
def url_norm(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.normal(F.col("url")).alias("url_norm"), U.domain(F.col("url")).alias("domain"), U.loose_key(F.col("url")).alias("loose_key")
    )


@query(
    "surt_key",
    _PARTS
    + r"""SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace(domain, ':[0-9]+$', ''), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN q <> '' THEN '?' || array_to_string(list_sort(string_split(q, '&')), '&') ELSE '' END AS surt FROM u""",
)
def surt_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.surt(F.col("url")).alias("surt"))


@query("url_variants", _PARTS + "SELECT page_id, unnest(['http://' || url_norm, 'https://' || url_norm, 'http://www.' || url_norm, 'https://www.' || url_norm]) AS variant FROM u")
def url_variants(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(U.variants(F.col("url"))).alias("variant"))


@query(
    "url_groups",
    _PARTS
    + r"""SELECT url_norm, min_by(url, (CASE WHEN lower(url) LIKE 'https://%' THEN 0 ELSE 1 END, length(url), page_id)) AS url,
    min_by(domain, (CASE WHEN lower(url) LIKE 'https://%' THEN 0 ELSE 1 END, length(url), page_id)) AS domain, count(*) AS n_ids, min(page_id) AS first_id
    FROM u GROUP BY url_norm""",
)
def url_groups(spark, sf):
    return corpus.group_urls(table(spark, sf, "pages"), "page_id", "url")


@query(
    "slug_tokens",
    _PARTS + _STEM + r"""SELECT page_id, array_to_string(regexp_extract_all(strip_accents(lower(stem)), '[a-z0-9]+'), ' ') AS tokens,
    array_to_string(list_filter(regexp_extract_all(strip_accents(lower(stem)), '[a-z0-9]+'), lambda x: regexp_full_match(x, '[a-z]{2,}')), ' ') AS alpha FROM t""",
)
def slug_tokens(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.array_join(U.slug_tokens(u), " ").alias("tokens"), F.array_join(U.alpha_tokens(u), " ").alias("alpha"))


@query(
    "url_features",
    _PARTS + _STEM + r"""SELECT page_id, CASE WHEN len(segs) > 1 THEN segs[1] ELSE '/' END AS parent1,
    CASE WHEN len(segs) > 2 THEN segs[1] || '/' || segs[2] WHEN len(segs) = 2 THEN segs[1] ELSE '/' END AS parent2,
    TRY_CAST(regexp_extract_all(stem, '[0-9]+')[-1] AS BIGINT) AS number,
    CASE WHEN regexp_matches(stem, '[㐀-鿿]') OR regexp_full_match(stem, '[A-Za-z]+([-_ ][A-Za-z]+)*') THEN regexp_replace(stem, '[-_]+', ' ', 'g') ELSE '' END AS slug,
    CASE WHEN regexp_matches(stem, '[㐀-鿿]') THEN 'cjk' WHEN regexp_full_match(stem, '[0-9]+') THEN 'numeric_id'
         WHEN len(regexp_extract_all(strip_accents(lower(stem)), '[a-z0-9]+')) >= 3 THEN 'meaningful' ELSE 'other' END AS slug_type FROM t""",
)
def url_features(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", U.parents(u, 1).alias("parent1"), U.parents(u, 2).alias("parent2"), U.last_number(u).alias("number"), U.semantic_slug(u).alias("slug"), U.slug_type(u).alias("slug_type")
    )


_PATH_CLASS = "CASE WHEN path LIKE '/en/%' THEN 'en' WHEN path LIKE '/de/%' THEN 'de' WHEN path LIKE '/fr/%' THEN 'fr' WHEN path LIKE '/es/%' THEN 'es' ELSE 'other' END"


@query("host_counts", _PARTS + f"SELECT domain, {_PATH_CLASS} AS status, count(*) AS n FROM u GROUP BY 1, 2")
def host_counts(spark, sf):
    return corpus.with_section(table(spark, sf, "pages")).groupBy("domain", "status").agg(F.count("*").alias("n"))


@query(
    "host_pivot",
    _PARTS + f"""SELECT domain, count(*) FILTER (WHERE c = 'en') AS en, count(*) FILTER (WHERE c = 'de') AS de, count(*) FILTER (WHERE c = 'fr') AS fr,
    count(*) FILTER (WHERE c = 'es') AS es, count(*) FILTER (WHERE c = 'other') AS other FROM (SELECT domain, {_PATH_CLASS} AS c FROM u) GROUP BY domain""",
)
def host_pivot(spark, sf):
    kinds = ["en", "de", "fr", "es", "other"]
    return corpus.with_section(table(spark, sf, "pages")).groupBy("domain").pivot("status", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


@query(
    "surt_prefix",
    _PARTS + r"""SELECT domain, min(k) AS first_key, max(k) AS last_key, count(*) AS n FROM (SELECT domain, array_to_string(list_reverse(string_split(domain, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN q <> '' THEN '?' || array_to_string(list_sort(string_split(q, '&')), '&') ELSE '' END AS k FROM u) GROUP BY domain""",
)
def surt_prefix(spark, sf):
    return corpus.surt_ranges(table(spark, sf, "pages")).drop("prefix")


@query("surt_common_prefix", None)
def surt_common_prefix(spark, sf):
    return corpus.surt_ranges(table(spark, sf, "pages")).select("domain", "prefix")


@query(
    "corpus_profile",
    _PARTS + r"""SELECT count(*) AS n, count(DISTINCT url) AS n_urls, count(DISTINCT url_norm) AS n_norm, count(DISTINCT domain) AS n_domains, count(*) FILTER (WHERE url IS NULL OR url = '') AS n_empty,
    count(*) FILTER (WHERE NOT regexp_matches(url, '^https?://')) AS n_malformed, max(page_id) - min(page_id) + 1 - count(DISTINCT page_id) AS n_gaps FROM u""",
)
def corpus_profile(spark, sf):
    return corpus.profile(table(spark, sf, "pages"), "page_id", "url")


@query(
    "domain_coverage_cum",
    _PARTS + """SELECT domain, n, round(sum(n) OVER (ORDER BY n DESC, domain ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_share,
    row_number() OVER (ORDER BY n DESC, domain) AS position FROM (SELECT domain, count(*) AS n FROM u GROUP BY domain)""",
)
def domain_coverage_cum(spark, sf):
    counts = table(spark, sf, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    return corpus.cumulative_share(counts, "domain", "n")


@query(
    "lang_of_host",
    _PARTS + "SELECT page_id, CASE WHEN domain LIKE '%.example.com' THEN 'en' WHEN domain LIKE '%.example.net' THEN 'zh' WHEN domain LIKE '%.example.org' THEN 'vi' END AS host_lang FROM u",
)
def lang_of_host(spark, sf):
    suffixes = [("example.com", "en"), ("example.net", "zh"), ("example.org", "vi")]
    return table(spark, sf, "pages").select("page_id", corpus.language_of_host(U.domain(F.col("url")), suffixes).alias("host_lang"))


@query(
    "holdout_sample",
    _PARTS + """SELECT page_id, (('0x' || substr(sha256('42' || url), 1, 2))::INT) < 128 AS held_out,
    row_number() OVER (PARTITION BY domain ORDER BY md5(url), page_id) AS random_rank FROM u
    QUALIFY random_rank <= greatest(2, ceil(0.02 * count(*) OVER (PARTITION BY domain)))""",
)
def holdout_sample(spark, sf):
    return corpus.sample_per_domain(table(spark, sf, "pages"), least=2, share=0.02)


@query(
    "title_match",
    _PARTS + _STEM + r""", w AS (SELECT t.page_id, list_distinct(regexp_extract_all(strip_accents(lower(stem)), '[a-z0-9]+')) AS slug,
      list_distinct(regexp_extract_all(strip_accents(lower(regexp_extract(p.html, '<title>([^<]*)</title>', 1))), '[a-z0-9]+')) AS title FROM t JOIN pages p ON t.page_id = p.page_id)
    SELECT page_id, CASE WHEN len(slug) = 0 THEN 0.0 ELSE round(len(list_intersect(slug, title)) / len(slug), 6) END AS score,
    len(slug) > 0 AND len(list_intersect(slug, title)) / len(slug) >= 0.5 AS accepted FROM w""",
)
def title_match(spark, sf):
    pages = table(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    words = F.array_distinct(F.regexp_extract_all(U.plain_letters(title), F.lit("([a-z0-9]+)"), 1))
    slug = F.array_distinct(U.slug_tokens(F.col("url")))
    score = F.when(F.size(slug) == 0, 0.0).otherwise(F.size(F.array_intersect(slug, words)) / F.size(slug))
    return pages.select("page_id", F.round(score, 6).alias("score"), ((F.size(slug) > 0) & (score >= 0.5)).alias("accepted"))
