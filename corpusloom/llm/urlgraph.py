"""URL filtering by rules and by link-graph propagation over hosts.

Rules name a host (which fits its subdomains) and a path prefix; the longest
rule that fits decides.  Other pages are judged by their host: trust flows from
hosts with allowed pages along links (personalised PageRank), distrust flows
from hosts with blocked pages against the links, since who links to bad pages
is suspect.  A host is blocked if its distrust exceeds the share ``THRESHOLD``
of trust and distrust together.

Edges are counted once for each pair of hosts, so a hub weighs no more rows
than it has neighbours.  Besides hyperlinks, a host and its parent domain, both
with pages, are joined both ways: a site vouches for its own subdomains.

Rounds go on until what is still moving is at most ``TOLERANCE`` of the mass.
Hosts without out-links give their mass back to the seeds: the scores of that
process are those of plain propagation scaled to the seeds' mass, so they are
scaled once at the end.  Each few rounds are written to the shared folder, so a
lost executor costs those rounds at most.  A host of very many edges is met by
broadcast of its score, so no task holds them all.

Defined results: null urls and urls without :// have empty host and path, fit
no rule, and are allowed; null html has no links; repeated rows are judged each;
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import MAX_HUBS
from ..operators.skew import join_counted
from .scratch import Scratch

# Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING, ROUNDS, WRITTEN, THRESHOLD, TOLERANCE = 0.85, 10, 4, 0.5, 0.01
#: Out-edges of a host beyond which its score is broadcast to them.
HUB = 10_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; both null if none does."""

    def fits(h: str, p: str) -> Column:
        return ((host == h) | host.endswith("." + h)) & path.startswith(p)

    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return reduce(lambda rest, r: F.when(fits(r[1], r[2]), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest), ordered[::-1], none)


def host_edges(pages: DataFrame, hosts: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, weight): pages of src that link to dst; and pairs of host and parent domain, both ways, weight 1."""
    links = (
        pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(_HREF), 2))).alias("dst"))
        .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    parents = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).where("src <> dst")
    known = parents.join(hosts.select(F.col("host").alias("dst")), "dst")
    site = known.select("src", "dst").unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.unionByName(site.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """(host, trust, distrust).  ``seeds``: (host, trusted, blocked), the shares of a host's pages under such rules.

    Both flows run in one table: kind 0 is trust along the edges, kind 1 is
    distrust along the reversed ones.  With a ``tolerance``, rounds go on until
    what all further rounds could add is at most that share of the mass.
    """
    both = edges.select(F.lit(0).alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"), F.count("*").alias("of"))
    hub = max(HUB, 2 * edges.count() // MAX_HUBS)
    shares = join_counted(both, out, ["kind", "src"], "of", hub).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share"), "of")
    shares = scratch.save(shares, "steps")
    steps, crowded = shares.where(F.col("of") <= hub).drop("of"), shares.where(F.col("of") > hub).drop("of")
    hubs = scratch.save(crowded.select("kind", "src").distinct(), "hubs")
    crowds = not hubs.isEmpty()
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trusted").alias("seed")), F.struct(F.lit(1).alias("kind"), F.col("blocked").alias("seed")))).alias("s"))
    start = scratch.save(start.select("s.kind", "host", "s.seed").where("seed > 0"), "seeds")
    given = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    score, last, before = given, None, {}
    for k in count(1):
        held = score.withColumnRenamed("host", "src")
        met = held.join(steps, ["kind", "src"])
        if crowds:
            of_hubs = F.broadcast(held.join(F.broadcast(hubs), ["kind", "src"]))
            met = met.unionByName(crowded.join(of_hubs, ["kind", "src"]))
        moved = met.select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        score = moved.unionByName(given).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        done = tolerance is None and k == rounds
        if k % WRITTEN == 0 or done:
            score = scratch.save(score, f"round{k}")
            if last:
                scratch.drop(f"round{last}")
            last = k
            if tolerance is not None:
                # scores only grow, and what W rounds add shrinks by damping ** W at least
                mass = {r.kind: r.m for r in score.groupBy("kind").agg(F.sum("score").alias("m")).collect()}
                shrink = damping**WRITTEN
                done = k > WRITTEN and all((m - before.get(kind, 0.0)) * shrink / (1 - shrink) <= tolerance * m for kind, m in mass.items()) or not mass
                before = mass
        if done:
            break
    value = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return score.groupBy("host").agg(value(0).alias("trust"), value(1).alias("distrust"))


def scaled(scores: DataFrame, seeds: DataFrame) -> DataFrame:
    """Trust and distrust scaled to the mass of their seeds, which gives back what hosts without out-links swallowed."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    mass = seeds.agg(zero("trusted").alias("_t"), zero("blocked").alias("_b")).crossJoin(scores.agg(zero("trust").alias("_ts"), zero("distrust").alias("_bs")))
    part = lambda c, want, has: F.when(F.col(has) > 0, F.col(c) * F.col(want) / F.col(has)).otherwise(F.lit(0.0))
    return scores.crossJoin(F.broadcast(mass)).select("host", part("trust", "_t", "_ts").alias("trust"), part("distrust", "_b", "_bs").alias("distrust"))


def judge(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each page: key, host, path, rule, verdict, and the host's trust and distrust."""
    scratch = Scratch(df.sparkSession, "urls")
    pages = df.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    ruled = pages.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("key", "host", "path", "html", "r.rule", "r.verdict")
    slim = scratch.save(ruled.drop("html"), "pages")
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    hosts = scratch.save(slim.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "hosts")
    scores = scratch.save(propagate(scratch.save(host_edges(ruled, hosts), "edges"), hosts, scratch, tolerance=tolerance), "scores")
    scores = scaled(scores, hosts).select(F.col("host").alias("h"), "trust", "distrust")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    bad = (zero("distrust") > 0) & (zero("distrust") > threshold * (zero("trust") + zero("distrust")))
    verdict = F.coalesce("verdict", F.when(bad, "block").otherwise("allow"))
    joined = slim.join(scores, slim.host == scores.h, "left")
    return joined.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), zero("trust").alias("trust"), zero("distrust").alias("distrust"))
