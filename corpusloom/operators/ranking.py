"""Ranks, running totals and quantiles over a whole table, without a task that sees all rows.

The rows are sorted over the cluster and written with their place; sums of the
partitions, a table of one row each, give every partition its start.  The
written table keeps the places fixed if a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import Scratch


def running_totals(df: DataFrame, order: list[Column | str], values: dict[str, Column]) -> DataFrame:
    """``df`` with the sums of ``values`` up to and including each row, in a total order."""
    scratch, names = Scratch(df.sparkSession, "order"), list(values)
    inner = {n: f"_v{i}" for i, n in enumerate(names)}
    placed = scratch.save(df.withColumns({inner[n]: v for n, v in values.items()}).orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_p", F.shiftright("_m", 33))
    sums = placed.groupBy("_p").agg(*[F.sum(inner[n]).alias(f"_s{i}") for i, n in enumerate(names)])
    # one row for each partition of the sort
    along = W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    before = sums.select("_p", *[(F.sum(f"_s{i}").over(along) - F.col(f"_s{i}")).alias(f"_b{i}") for i in range(len(names))])
    rows = W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, 0)
    within = placed.withColumns({f"_w{i}": F.sum(inner[n]).over(rows) for i, n in enumerate(names)})
    added = within.join(F.broadcast(before), "_p").withColumns({n: F.col(f"_b{i}") + F.col(f"_w{i}") for i, n in enumerate(names)})
    return added.drop("_p", "_m", *inner.values(), *(f"_w{i}" for i in range(len(names))), *(f"_b{i}" for i in range(len(names))))


def running_total(df: DataFrame, order: list[Column | str], value: Column, out: str) -> DataFrame:
    return running_totals(df, order, {out: value})


def place(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """``df`` with the number of each row, from 1, in a total order."""
    return running_total(df, order, F.lit(1).cast("long"), out)


def tile(place_: Column, n: Column, k: int) -> Column:
    """Which of k nearly equal parts a place falls into; the first parts take the remainder."""
    base, extra = F.floor(n / k), n % k
    head = extra * (base + 1)
    return F.when(place_ <= head, F.floor((place_ - 1) / (base + 1)) + 1).otherwise(extra + F.floor((place_ - 1 - head) / F.greatest(base, F.lit(1))) + 1)


def average_ranks(df: DataFrame, group: list[str], score: str, out: str) -> DataFrame:
    """``df`` with the rank of ``score`` within its group, ties sharing their mean; ranks are worked out on distinct values."""
    counts = df.groupBy(*group, score).agg(F.count("*").alias("_n"))
    total = running_total(counts, [*group, score], F.col("_n"), "_t")
    start = total.groupBy(*group).agg(F.min(F.col("_t") - F.col("_n")).alias("_s"))
    ranked = total.join(start, group) if group else total.crossJoin(F.broadcast(start))
    ranked = ranked.select(*group, score, (F.col("_t") - F.col("_s") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranked, [*group, score])


#: How far from a quantile its bracket ends lie, in errors of the sketch.
MARGIN = 5


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], also: dict[str, Column] | None = None, accuracy: int = 10_000) -> DataFrame:
    """(group, a column for each of ``shares`` and of the aggregates ``also``): exact quantiles of the values that are not null, between neighbours by place.

    ``percentile`` holds every distinct value of a group in one task.  Here a sketch
    of each group brackets a quantile first; then values within a bracket, some
    2 ``MARGIN`` / ``accuracy`` of the rows, are counted one by one and those below it together.  A quantile that its
    bracket misses is sought again among all values of its group.  The rows are read twice, values of a bracket are
    sorted in one task, and the groups must be few enough to be broadcast.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    keys = [f"_g{i}" for i in range(len(group))]
    rows = df.withColumns({"_v": F.col(value).cast("double"), **{k: F.col(g) for k, g in zip(keys, group, strict=True)}})
    ends = [min(1.0, max(0.0, q + sign * MARGIN / accuracy)) for q in shares.values() for sign in (-1, 1)]
    whole = [F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", ends, accuracy).alias("_e")]
    first = scratch.save(rows.groupBy(*keys).agg(*whole, *[c.alias(n) for n, c in (also or {}).items()]), "first")
    end = lambda k, edge: F.when(F.col("_n") <= accuracy, F.col(edge)).otherwise(F.col("_e")[k])
    each = [F.struct(F.lit(i).alias("_k"), (F.lit(q) * (F.col("_n") - 1)).alias("_at"), end(2 * i, "_low").alias("_lo"), end(2 * i + 1, "_high").alias("_hi")) for i, q in enumerate(shares.values())]
    brackets = first.where("_n > 0").select(*keys, "_low", "_high", F.explode(F.array(*each)).alias("_b")).select(*keys, "_low", "_high", "_b.*")

    def equal(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
        """Joined by ``names``, nulls equal."""
        other = right.withColumnsRenamed({c: f"_r{c}" for c in names})
        on = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in names]
        return left.join(F.broadcast(other), on or None, how if on else "cross").drop(*(f"_r{c}" for c in names))

    def found(some: DataFrame, name: str) -> DataFrame:
        """``some`` brackets with the values at both neighbours of the place, and whether they are certain."""
        met = equal(rows.select(*keys, "_v"), some.select(*keys, "_k", "_lo", "_hi"), keys).where("_v <= _hi")
        counts = scratch.save(met.groupBy(*keys, "_k", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_m")), f"{name}_counts")
        along = W.partitionBy(*keys, "_k").orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0)
        placed = equal(counts.withColumn("_t", F.sum("_m").over(along)), some, [*keys, "_k"])
        at = lambda place_: F.min(F.when(F.col("_t") > place_, F.col("_v")))
        sure = (F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_m"))), F.lit(0)) <= F.floor(F.first("_at"))) & (F.max("_t") > F.ceil(F.first("_at")))
        got = placed.groupBy(*keys, "_k").agg(at(F.floor("_at")).alias("_x"), at(F.ceil("_at")).alias("_y"), sure.alias("_sure"))
        return scratch.save(equal(some, got, [*keys, "_k"], "left"), name)

    held = found(brackets, "near")
    missed = held.where("NOT coalesce(_sure, false)").select(*keys, "_low", "_high", "_k", "_at", F.col("_low").alias("_lo"), F.col("_high").alias("_hi"))
    if missed.limit(1).count():
        held = held.where("_sure").unionByName(found(missed, "far"))
    low, high, at = F.floor("_at"), F.ceil("_at"), F.col("_at")
    between = F.when((low == high) | (F.col("_x") == F.col("_y")), F.col("_x")).otherwise((high - at) * F.col("_x") + (at - low) * F.col("_y"))
    wide = held.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == i, between)).alias(n) for i, n in enumerate(shares)])
    return equal(first, wide, keys, "left").select(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=True)], *shares, *(also or {}))
