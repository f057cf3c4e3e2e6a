"""Fusing rankings, cutting lists and sharing out budgets.

A pool is a DataFrame of (query_id, doc_id, ...).  Everything per query is a
window over ``query_id``; everything global is solved on the small table of
queries, or by sums over ordered ranges, never over all pairs in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import Scratch
from . import ranking

RRF_K = 60


def per_query(*order: Column | str) -> W:
    return W.partitionBy("query_id").orderBy(*order)


RUNNING = (W.unboundedPreceding, 0)


def with_rank(pool: DataFrame, score: str, out: str, *ties: str) -> DataFrame:
    """Rank by descending score; ties by the given columns, then doc_id."""
    return pool.withColumn(out, F.row_number().over(per_query(F.col(score).desc(), *ties, "doc_id")).cast("long"))


def with_rank_missing_last(pool: DataFrame, score: str, out: str, *ties: str) -> DataFrame:
    """Scored rows are ranked 1..m; every row without a score gets the pool's size."""
    rank = F.row_number().over(per_query(F.col(score).desc_nulls_last(), *ties, "doc_id"))
    size = F.count("*").over(W.partitionBy("query_id"))
    return pool.withColumn(out, F.when(F.col(score).isNull(), size).otherwise(rank).cast("long"))


def rrf(ranks: list[str], weights: list[float] | None = None, k: int = RRF_K, missing: int | None = None) -> Column:
    """Reciprocal-rank fusion of rank columns; a null rank counts as ``missing``, or adds nothing."""
    total = None
    for r, w in zip(ranks, weights or [1.0] * len(ranks), strict=True):
        rank = F.coalesce(F.col(r), F.lit(missing)) if missing is not None else F.col(r)
        part = F.coalesce(F.lit(w) / (rank + k), F.lit(0.0))
        total = part if total is None else total + part
    return total


def top(pool: DataFrame, score: Column, keep: int, *ties: str) -> DataFrame:
    """The ``keep`` best of each query with their position."""
    scored = pool.withColumn("fused", F.round(score, 12))
    w = per_query(F.col("fused").desc(), *ties, "doc_id")
    return scored.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= keep)


def minmax(score: str) -> Column:
    """Scaled to 0..1 within the query; 0 where all are equal."""
    w = W.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(0.0))


def cut_threshold(pool: DataFrame, score: str, tau: float, floor: int, ceil: int, protect: Column | None = None) -> DataFrame:
    """Keeps score >= tau, but at least ``floor`` and at most ``ceil`` by score; protected documents stay."""
    w = W.partitionBy("query_id")
    ranked = pool.withColumn("_r", F.row_number().over(per_query(F.col(score).desc(), "doc_id"))).withColumn("_n", F.count_if(F.col(score) >= tau).over(w))
    limit = F.least(F.greatest(F.col("_n"), F.lit(floor)), F.lit(ceil))
    kept = F.col("_r") <= limit
    out = ranked.withColumn("hit_floor", F.col("_n") < floor).withColumn("hit_ceil", F.col("_n") > ceil)
    return out.where(kept | (protect if protect is not None else F.lit(False))).drop("_r", "_n")


def cut_gap(pool: DataFrame, score: str, floor: int) -> DataFrame:
    """Cuts each list at its largest drop between neighbours after at least ``floor`` documents (the first one on ties)."""
    order = per_query(F.col(score).desc(), "doc_id")
    ranked = pool.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead(score).over(order))
    gap = F.when((F.col("_r") >= floor) & F.col("_next").isNotNull(), F.round(F.col(score) - F.col("_next"), 9))
    ranked = ranked.withColumn("_gap", gap)
    has = F.count("_gap").over(W.partitionBy("query_id")) > 0
    best = ranked.withColumn("_max", F.max("_gap").over(W.partitionBy("query_id"))).withColumn("_has", has)
    best = best.withColumn("_at", F.min(F.when(F.col("_gap") == F.col("_max"), F.col("_r"))).over(W.partitionBy("query_id")))
    return best.where(~F.col("_has") | (F.col("_r") <= F.col("_at"))).drop("_r", "_next", "_gap", "_max", "_has", "_at")


def expected_f2_cut(pool: DataFrame, p: str, floor: int, gold: Column, scale: Column | None = None) -> DataFrame:
    """For each query the k >= floor of largest 5 sum(p) / (4 G + k), the smallest on ties: (query_id, k, value)."""
    order = per_query(F.col(p).desc(), "doc_id")
    scored = pool.withColumn("_k", F.row_number().over(order)).withColumn("_g", gold).withColumn("_n", F.count("*").over(W.partitionBy("query_id")))
    cum = F.sum(p).over(order.rowsBetween(*RUNNING))
    value = F.round(5 * cum / (4 * (scale if scale is not None else F.lit(1.0)) * F.col("_g") + F.col("_k")), 9)
    valued = scored.withColumn("_v", value).where(F.col("_k") >= F.least(F.lit(floor), F.col("_n")))
    best = F.max(F.struct(F.col("_v"), (-F.col("_k")).alias("neg")))
    return valued.groupBy("query_id").agg(best.alias("b")).select("query_id", (-F.col("b.neg")).cast("long").alias("k"), F.col("b._v").alias("value"))


def marginal_cut(pool: DataFrame, p: str, floor: int, gold: Column, scale: float) -> DataFrame:
    """The cut with its marginal threshold scaled: k of largest sum(p) - scale F*/5 k, where F* is the query's best expected F2."""
    order = per_query(F.col(p).desc(), "doc_id")
    w = W.partitionBy("query_id")
    rows = (
        pool.withColumn("_k", F.row_number().over(order)).withColumn("_cum", F.sum(p).over(order.rowsBetween(*RUNNING))).withColumn("_g", gold)
        .withColumn("_n", F.count("*").over(w)).where(F.col("_k") >= F.least(F.lit(floor), F.col("_n")))
    )
    rows = rows.withColumn("_f", F.max(5 * F.col("_cum") / (4 * F.col("_g") + F.col("_k"))).over(w))
    rows = rows.withColumn("_v", F.round(F.col("_cum") - scale * F.col("_f") / 5 * F.col("_k"), 9))
    best = F.max(F.struct(F.col("_v"), (-F.col("_k")).alias("neg")))
    return rows.groupBy("query_id").agg(best.alias("b")).select("query_id", (-F.col("b.neg")).cast("long").alias("k"))


def bisect(total, target: float, low: float, high: float, steps: int = 80, geometric: bool = False) -> tuple[float, float]:
    """Brackets the place where the growing ``total`` reaches ``target``; each step is one aggregate over a small table."""
    for _ in range(steps):
        mid = (low * high) ** 0.5 if geometric else (low + high) / 2
        low, high = (mid, high) if total(mid) < target else (low, mid)
    return low, high


def carriers_fair(pool: DataFrame, p: str, rho: float) -> DataFrame:
    """The first ceil(rho n) documents of each query by ``p``."""
    n = F.count("*").over(W.partitionBy("query_id"))
    ranked = pool.withColumn("_r", F.row_number().over(per_query(F.col(p).desc(), "doc_id"))).withColumn("_n", n)
    return ranked.where(F.col("_r") <= F.ceil(F.lit(rho) * F.col("_n") - 1e-12)).drop("_r", "_n")


def solve_rho(pool: DataFrame, target: int) -> float:
    """The share whose total of ceil(rho n) is closest to ``target``; works on the histogram of list lengths."""
    lengths = pool.groupBy("query_id").count().groupBy("count").agg(F.count("*").alias("queries")).collect()
    sizes = [(r["count"], r["queries"]) for r in lengths]
    total = lambda rho: sum(q * max(0, -int(-(rho * n - 1e-12) // 1)) for n, q in sizes)
    low, high = bisect(total, target, 0.0, 1.0)
    return min((r for r in (low, high) if r > 0), key=lambda r: (abs(total(r) - target), r))


def threshold_counts(pool: DataFrame, score: str, low: Column, high: Column, target: int, bins: int = 1000, last: int = 50_000) -> DataFrame:
    """One global threshold so that the clipped counts above it sum to ``target``: (query_id, n, k).

    The threshold is a place in the order (score descending, query, document).
    Only pairs whose place in their own list lies between the bounds change the
    clipped sum, each by one; so the threshold is the pair of a known number in
    the order of those pairs.  Histograms of the score narrow it down, and only
    the last bin is sorted.
    """
    bounds = pool.groupBy("query_id").agg(F.count("*").alias("size")).withColumn("low", low).withColumn("high", high)
    place = F.row_number().over(per_query(F.col(score).desc(), "doc_id"))
    rows = pool.select("query_id", "doc_id", F.col(score).cast("double").alias("s"), place.alias("j")).join(bounds, "query_id")
    rows = Scratch(pool.sparkSession, "threshold").save(rows, "rows")
    given, most = bounds.agg(F.sum("low"), F.sum("high")).first()
    if not given <= target <= most:
        raise ValueError(f"target {target} outside [{given}, {most}]")
    wanted = target - given
    active = rows.where((F.col("j") > F.col("low")) & (F.col("j") <= F.col("high"))).select("s", "query_id", "doc_id")
    cut = None
    while wanted and cut is None:
        n, a, b = active.agg(F.count("*"), F.min("s"), F.max("s")).first()
        if n <= last or a == b:
            order = [F.col("s").desc(), F.col("query_id"), F.col("doc_id")]
            cut = ranking.place(active, order, "i").where(F.col("i") == wanted).first()
            break
        bin_ = F.least(F.floor((F.lit(b) - F.col("s")) / F.lit((b - a) / bins)), F.lit(bins - 1))
        before = 0
        for number, count in sorted((r[0], r[1]) for r in active.groupBy(bin_.alias("bin")).count().collect()):
            if before + count >= wanted:
                active, wanted = active.where(bin_ == number), wanted - before
                break
            before += count
    above = F.lit(False)
    if cut is not None:
        before_cut = (F.col("query_id") < cut.query_id) | ((F.col("query_id") == cut.query_id) & (F.col("doc_id") <= cut.doc_id))
        above = (F.col("s") > cut.s) | ((F.col("s") == cut.s) & before_cut)
    n = rows.groupBy("query_id", "low", "high").agg(F.count_if(above).alias("n"))
    return n.select("query_id", "n", F.least(F.greatest("n", "low"), "high").alias("k"))


def common_factor(sizes: DataFrame, target: float) -> float:
    """c with sum(clip(c raw, low, high)) = target, in closed form.

    The sum is piecewise linear in c: at low / raw a row begins to grow, at
    high / raw it stops.  Running totals over those places, sorted over the
    cluster, give the sum at each of them and the slope after it.
    """
    low, high = F.col("low") / F.col("raw"), F.col("high") / F.col("raw")
    turns = sizes.where("raw > 0").select(
        F.explode(F.array(F.struct(low.alias("c"), F.col("raw").alias("slope"), F.col("low").alias("gone")), F.struct(high.alias("c"), (-F.col("raw")).alias("slope"), (-F.col("high")).alias("gone")))).alias("t")
    ).select("t.*")
    given, most = sizes.agg(F.sum("low"), F.sum(F.when(F.col("raw") > 0, F.col("high")).otherwise(F.col("low")))).first()
    if given is None or not given <= target <= most:
        raise ValueError(f"target {target} outside [{given}, {most}]")
    along = ranking.running_totals(turns, ["c", "slope", "gone"], {"grows": F.col("slope"), "base": F.col("gone")})
    # up to a place c, with all turns before it, the sum is given - base + grows c; it never falls
    reached = F.lit(float(given)) - F.col("base") + F.col("grows") * F.col("c")
    at = along.where(reached <= F.lit(target + 1e-9)).agg(F.max("c")).first()[0]
    if at is None:
        return 0.0
    slope, gone = turns.where(F.col("c") <= at).agg(F.sum("slope"), F.sum("gone")).first()
    short = target - (given - gone + slope * at)
    return at + short / slope if slope > 1e-12 and short > 0 else at


def allocate_total(sizes: DataFrame, raw: str, low: str, high: str, target: int) -> DataFrame:
    """(query_id, n): whole numbers between the bounds that sum to ``target``, in proportion to ``raw``: largest remainders take the rest, ties by query."""
    held = sizes.select("query_id", *(F.col(c).cast("double").alias(n) for c, n in ((raw, "raw"), (low, "low"), (high, "high"))))
    c = common_factor(held, target)
    x = held.withColumn("x", F.least(F.greatest(F.lit(c) * F.col("raw"), F.col("low")), F.col("high"))).withColumn("base", F.least(F.floor(F.col("x") + 1e-9), F.floor("high")).cast("long"))
    left = target - x.agg(F.sum("base")).first()[0]
    order = [F.when(F.col("base") < F.col("high"), 0).otherwise(1), F.round(F.col("base") - F.col("x"), 6), "query_id"]
    return ranking.place(x, order, "_r").select("query_id", (F.col("base") + (F.col("_r") <= left).cast("long")).alias("n"))


def dedup_refill(pool: DataFrame, cluster: str, rank: str, k: int) -> DataFrame:
    """The best document of each cluster, then the first k of each query: later ones move up into the gaps."""
    first = pool.withColumn("_c", F.row_number().over(W.partitionBy("query_id", cluster).orderBy(rank, "doc_id"))).where("_c = 1").drop("_c")
    return first.withColumn("position", F.row_number().over(per_query(rank, "doc_id")).cast("long")).where(F.col("position") <= k)


def quota(groups: DataFrame, key: str, size: str, n: int, cap: int | None) -> DataFrame:
    """(key, quota): shares of ``n`` in proportion to size, none above its size or the cap; what the capped ones leave is shared again.

    In closed form over the table of groups, which has one row for each: with
    groups in ascending order of limit over size, those before the first whose
    share stays under its limit are capped, and the rest split what remains;
    largest remainders take what rounding leaves, ties by key.
    """
    limit = F.least(F.col(size), F.lit(cap)) if cap else F.col(size)
    every = W.partitionBy(F.lit(0))
    order = every.orderBy(F.col("_limit") / F.col(size), key)
    rows = groups.where(F.col(size) > 0).select(key, size, limit.alias("_limit"))
    rows = rows.withColumn("_left", F.lit(n) - (F.sum("_limit").over(order.rowsBetween(*RUNNING)) - F.col("_limit")))
    rows = rows.withColumn("_level", F.col("_left") / F.sum(size).over(order.rowsBetween(0, W.unboundedFollowing)))
    free = F.when((F.col("_level") * F.col(size) < F.col("_limit")) & (F.col("_left") >= 0), F.col("_level"))
    level = F.first(free, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    shared = rows.withColumn("_share", F.least(F.coalesce(level * F.col(size), F.col("_limit").cast("double")), F.col("_limit").cast("double")))
    shared = shared.withColumn("_open", F.col("_share") < F.col("_limit")).withColumn("_base", F.floor(F.col("_share") + 1e-9))
    spare = F.lit(n) - F.sum("_base").over(every)
    by_rest = F.row_number().over(every.orderBy(F.col("_open").desc(), F.round(F.col("_base") - F.col("_share"), 9), key))
    return shared.withColumn("_spare", spare).withColumn("_r", by_rest).select(key, (F.col("_base") + (F.col("_open") & (F.col("_r") <= F.col("_spare"))).cast("long")).cast("long").alias("quota"))


def sequential_budget(groups: DataFrame, key: str, size: str, rate: str, budget: float, saturation: float) -> DataFrame:
    """(key, cut): groups in the order of their key each take min(size, floor(rest rate), ceil(size saturation)) at their rate from one budget.

    While the budget lasts a group takes what saturation allows, so running
    totals tell the first group that it does not reach; what that one leaves is
    less than one unit at its rate, so only a group of a higher rate can take
    more, and the search goes on there.  There are as many searches as distinct
    rates at most.
    """
    full = F.least(F.col(size), F.ceil(F.col(size) * F.lit(saturation))).cast("long")
    rows = groups.select(key, F.col(rate).cast("double").alias("_rate"), full.alias("_full"))
    rows = ranking.running_total(rows, [key], F.col("_full") / F.col("_rate"), "_spent")
    short = F.floor((F.lit(budget) - (F.col("_spent") - F.col("_full") / F.col("_rate"))) * F.col("_rate") + 1e-9)
    bound = rows.where(short < F.col("_full")).select(key, "_rate", F.greatest(short, F.lit(0)).cast("long").alias("cut"), "_spent", "_full").orderBy(key).first()
    if bound is None:
        return rows.select(key, F.col("_full").alias("cut"))
    taken, at = {bound[key]: bound.cut}, bound
    rest = budget - (bound._spent - bound._full / bound._rate) - bound.cut / bound._rate
    while True:
        able = F.least(F.floor(F.lit(max(0.0, rest)) * F.col("_rate") + 1e-9), F.col("_full")).cast("long")
        at = rows.where(F.col(key) > at[key]).select(key, "_rate", able.alias("cut")).where("cut > 0").orderBy(key).first()
        if at is None:
            break
        taken[at[key]] = at.cut
        rest -= at.cut / at._rate
    later = F.lit(0)
    for k, cut in taken.items():
        later = F.when(F.col(key) == k, cut).otherwise(later)
    return rows.select(key, F.when(F.col(key) < bound[key], F.col("_full")).otherwise(later).cast("long").alias("cut"))


def calibrate_threshold(pool: DataFrame, score: str, target_mean: float, floor: int, ceil: int, steps: int = 6, tries: int = 24, decimals: int | None = None) -> float:
    """The threshold whose floor-and-ceiling cut keeps ``target_mean`` documents a query; each step tries many values in one aggregate.

    With ``decimals`` it is the best of the five values of that many decimals around the solution: nearest in the mean, then the larger mean, then the smaller value.
    """
    held = Scratch(pool.sparkSession, "threshold").save(pool.select("query_id", F.col(score).alias("s")), "scores")
    low, high = held.agg(F.min("s"), F.max("s")).first()

    def means(values: list[float]) -> list[float]:
        n = F.count("*")
        per = held.groupBy("query_id").agg(*[F.least(F.greatest(F.least(F.lit(floor), n), F.count_if(F.col("s") >= v)), F.lit(ceil)).alias(f"k{i}") for i, v in enumerate(values)])
        return list(per.agg(*[F.avg(f"k{i}") for i in range(len(values))]).first())

    for _ in range(steps):
        values = [low + (high - low) * k / tries for k in range(tries + 1)]
        found = means(values)
        above = max((i for i, m in enumerate(found) if m >= target_mean), default=0)
        low, high = values[above], values[min(above + 1, tries)]
    if decimals is None:
        return low
    grid = sorted({round(low + k / 10**decimals, decimals) for k in range(-2, 3)})
    return min(zip(grid, means(grid), strict=True), key=lambda x: (abs(x[1] - target_mean), -x[1], x[0]))[0]


def variable_keep(pool: DataFrame, score: str, base: Column, threshold: float, low: float, high: float) -> DataFrame:
    """(query_id, keep): documents at or above a threshold, between bounds relative to the base depth, and the geometric mean of the two."""
    n = pool.groupBy("query_id").agg(F.count_if(F.col(score) >= threshold).alias("n"), F.count("*").alias("size")).withColumn("base", base)
    clip = lambda x: F.least(F.greatest(x, F.ceil(F.lit(low) * F.col("base") - 1e-9)), F.floor(F.lit(high) * F.col("base") + 1e-9), F.col("size"))
    return n.select("query_id", clip(F.col("n")).cast("long").alias("thr"), clip(F.bround(F.sqrt(F.col("n") * F.col("base")))).cast("long").alias("mix"))


def merge_lanes(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Two scored lists as one: a document's best score counts, the k best stay; (query_id, doc_id, score, position)."""
    both = a.select("query_id", "doc_id", "score").unionByName(b.select("query_id", "doc_id", "score"))
    return with_rank(both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), "score", "position").where(F.col("position") <= k)
