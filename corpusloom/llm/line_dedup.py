"""Site-relative line deduplication, with DataFrame functions only.

Pages are grouped by host.  For each line of a host, the pages that contain it
(a page counts once) are divided by the host's pages; lines above ``ratio``
that at least ``min_pages`` pages hold are boilerplate of that host and are
dropped wherever they occur there.

Plan: one aggregation over 128-bit line hashes, combined before the shuffle, so
a line that every page holds costs one row for each task.  What survives is
small by construction: a host of P pages with L distinct lines each has at most
L / ratio boilerplate lines, whatever P is.  Texts are never shuffled unless
that table is beyond ``BROADCAST_LINES``; then texts are dealt by host, and a
host of more than ``PAGES_PER_TASK`` pages by so many salts that none has more.

With ``distinct_texts`` a line counts once for each distinct text of the host,
and the host's distinct texts are what it is divided by, so that a group of
exact copies is one page and is left to near-dedup.  The operator's own query
counts rows, as its SQL does.

Defined results: lines are what lies between \\n; lines of spaces only are never
counted nor dropped; null text stays null and counts as a page; pages of null
host form a host of their own; a repeated row is another page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

RATIO = 0.05
MIN_PAGES = 5
#: Boilerplate lines (16 bytes each) up to which their table is broadcast.
BROADCAST_LINES = 500_000
#: Pages of a host that one task takes where texts are shuffled, and the most hosts whose salts are broadcast.
PAGES_PER_TASK, MAX_SALTED = 50_000, 200_000


def _line_key(line):
    """Two XXH64 of different seeds: equal keys mean equal lines up to a chance of n^2 / 2^129."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def _lines(text):
    return F.split(text, "\n", -1)


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct_texts: bool = False) -> DataFrame:
    """(host, h1, h2, pages, host_pages): the boilerplate lines of each host, by hash."""
    page = [_line_key(F.col(text)).alias("page")] if distinct_texts else []
    pages = df.select(F.col(host).alias("host"), *page, F.filter(F.array_distinct(_lines(F.col(text))), lambda x: F.trim(x) != "").alias("lines"))
    lines = pages.select(*pages.columns[:-1], F.explode("lines").alias("line")).select(*pages.columns[:-1], _line_key(F.col("line")).alias("k"))
    if distinct_texts:
        lines, df = lines.distinct(), df.select(F.col(host), *page).distinct()
    counts = lines.groupBy("host", "k.h1", "k.h2").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = df.groupBy(F.col(host).alias("of_host")).agg(F.count("*").alias("host_pages"))
    return (
        counts.join(totals, counts.host.eqNullSafe(totals.of_host))
        .where(F.col("pages") > F.col("host_pages") * F.lit(ratio))
        .select("host", "h1", "h2", "pages", "host_pages")
    )


def drop_boilerplate(
    df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True, distinct_texts: bool = False
) -> DataFrame:
    """``df`` with boilerplate lines cut out of ``text``; with ``counts``, also n_lines and n_dropped (long)."""
    scratch = Scratch(df.sparkSession, "lines")
    found = scratch.save(boilerplate(df, host, text, ratio, min_pages, distinct_texts), "boilerplate")
    by_host = found.groupBy(F.col("host").alias("_loom_host")).agg(F.collect_list(F.struct("h1", "h2")).alias("_loom_keys"))
    if found.count() <= BROADCAST_LINES:
        joined = df.join(F.broadcast(by_host), df[host].eqNullSafe(by_host["_loom_host"]), "left")
    else:
        joined = _by_salted_host(df, found, host, text)
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_loom_keys"), _line_key(x)))
    untouched = F.col("_loom_keys").isNull() | F.col(text).isNull()
    added = {}
    if counts:
        added["n_lines"] = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
        added["n_dropped"] = F.when(untouched, F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long")
    plain = [c for c in df.columns if c not in added]
    columns = [F.when(untouched, F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(c) for c in plain]
    return joined.select(*columns, *(v.alias(k) for k, v in added.items()))


def _by_salted_host(df: DataFrame, found: DataFrame, host: str, text: str) -> DataFrame:
    """``df`` with the boilerplate keys of each row's host in _loom_keys, every host dealt over tasks of bounded size."""
    of_host = found.groupBy(F.col("host").alias("_loom_host")).agg(F.max("host_pages").alias("_loom_pages"), F.collect_list(F.struct("h1", "h2")).alias("_loom_keys"))
    pages = found.select("host", "host_pages").distinct().agg(F.coalesce(F.sum("host_pages"), F.lit(0))).first()[0]
    most = max(PAGES_PER_TASK, pages // MAX_SALTED)
    salts = F.ceil(F.col("_loom_pages") / most).cast("int")
    # hosts of more than ``most`` pages: at most MAX_SALTED
    large = found.select("host", "host_pages").distinct().where(F.col("host_pages") > most)
    large = F.broadcast(large.select(F.col("host").alias("_loom_large"), F.ceil(F.col("host_pages") / most).cast("int").alias("_loom_salts")))
    salted = df.join(large, df[host].eqNullSafe(large["_loom_large"]) & F.col("_loom_salts").isNotNull(), "left")
    salted = salted.withColumn("_loom_salt", F.pmod(F.xxhash64(text), F.coalesce("_loom_salts", F.lit(1))).cast("int"))
    keys = of_host.withColumn("_loom_salt2", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(keys, salted[host].eqNullSafe(keys["_loom_host"]) & (salted["_loom_salt"] == keys["_loom_salt2"]), "left")


#: DuckDB: the same rows from a table with columns doc_id, source and text.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM {documents}),
one AS (SELECT DISTINCT rid, source, unnest(lines) AS line FROM d),
totals AS (SELECT source, count(*) AS host_pages FROM d GROUP BY source),
held AS (SELECT source, line, count(*) AS pages FROM one WHERE trim(line) <> '' GROUP BY source, line),
bad AS (SELECT held.source, list(held.line) AS keys FROM held JOIN totals ON held.source IS NOT DISTINCT FROM totals.source
        WHERE pages >= {min_pages} AND pages > host_pages * CAST({ratio} AS DOUBLE) GROUP BY held.source),
cut AS (SELECT d.*, list_filter(lines, lambda x: keys IS NULL OR NOT list_contains(keys, x)) AS kept
        FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped
FROM cut
"""


def oracle(documents: str = "documents") -> str:
    return SQL.format(documents=documents, min_pages=MIN_PAGES, ratio=RATIO)
