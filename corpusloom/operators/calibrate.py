"""Fits and solved cuts: factors, thresholds and curves that meet a target over the whole pool.

A pool has (query_id, doc_id, ...).  A solver tries many values in each pass
over the pool, so a handful of passes narrows a bracket down; what reaches the
driver are a few numbers for each value tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..sources.scratch import Scratch
from . import fusion, ranking
from .fusion import RUNNING, per_query

#: Lists that are looked at together.
LISTS = 1024


def solve(evaluate: Callable[[list[float]], list[float]], target: float, low: float, high: float, passes: int = 5, tries: int = 24, geometric: bool = False, grows: bool = True) -> float:
    """Of the values that bracket the place where a monotone function meets ``target``, the one whose value is closest to it (the smaller on ties)."""
    space = np.geomspace if geometric else np.linspace
    for _ in range(passes):
        values = [float(v) for v in space(low, high, tries + 1)]
        found = evaluate(values)
        below = [v for v, y in zip(values, found, strict=True) if (y < target) == grows and y != target]
        at = len(below) - 1 if below else 0
        low, high = values[at], values[min(at + 1, tries)]
    ends = evaluate([low, high])
    return min(zip((low, high), ends, strict=True), key=lambda e: (abs(e[1] - target), e[0]))[0]


def cumulated(pool: DataFrame, p: str, floor: int, gold: Column, scratch: Scratch) -> DataFrame:
    """Written (query_id, k, cum, g): places of each list by falling p from the floor on, the sum of p up to there and the expected hits."""
    order = per_query(F.col(p).desc(), "doc_id")
    n = F.count("*").over(W.partitionBy("query_id"))
    rows = pool.select("query_id", F.row_number().over(order).alias("k"), F.sum(p).over(order.rowsBetween(*RUNNING)).alias("cum"), gold.alias("g"), n.alias("n"))
    return scratch.save(rows.where(F.col("k") >= F.least(F.lit(floor), F.col("n"))).drop("n"), "cumulated")


def _rounded(x: float) -> float:
    """As Spark rounds to nine places."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if np.isfinite(x) else x


def first_best(value: np.ndarray, k: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each list the smallest k of largest value to nine places; only values so close that rounding may decide are rounded."""
    value = np.where(np.isnan(value), -np.inf, value)
    sizes = np.diff(np.append(starts, len(value)))
    top = np.repeat(np.maximum.reduceat(value, starts), sizes)
    near = np.flatnonzero(value >= top - 1.5e-9)
    of = np.repeat(np.arange(len(starts)), sizes)[near]
    first = np.searchsorted(of, np.arange(len(starts)))
    out = k[near[first]]
    ends = np.append(first[1:], len(near))
    for i in np.flatnonzero(ends - first > 1):
        some = near[first[i] : ends[i]]
        out[i] = min((-_rounded(v), place) for v, place in zip(value[some].tolist(), k[some].tolist(), strict=True))[1]
    return out


def _listed(rows: DataFrame, scratch: Scratch, *facts: str) -> DataFrame:
    """Written (query_id, k, cum, and the facts of a query): one row for each list, so that no pass sorts or shuffles."""
    pairs = F.sort_array(F.collect_list(F.struct("k", "cum")))
    lists = rows.groupBy("query_id").agg(pairs.alias("x"), *[F.first(c).cast("double").alias(c) for c in facts])
    return scratch.save(lists.select("query_id", F.col("x.k").cast("array<long>").alias("k"), F.col("x.cum").cast("array<double>").alias("cum"), *facts), "lists")


def _cuts(lists: DataFrame, value: Callable, values: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]]:
    """For each batch of lists, by slices, the best places under each of ``values``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches:
            for at in range(0, batch.num_rows, LISTS):
                some = batch.slice(at, LISTS)
                n = some.column(1).value_lengths().to_numpy()
                k, cum = some.column(1).flatten().to_numpy(), some.column(2).flatten().to_numpy(zero_copy_only=False)
                facts = [np.repeat(c.to_numpy(zero_copy_only=False), n) for c in some.columns[3:]]
                yield some, [first_best(value(s, k, cum, *facts), k, np.cumsum(n) - n) for s in values]

    return run


def _totals(lists: DataFrame, value: Callable, values: list[float]) -> tuple[list[float], int]:
    """The sums of the best places under each value, and the number of lists; a task sends one row for each value."""
    cuts = _cuts(lists, value, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(values), np.int64), 0
        for some, found in cuts(batches):
            total, n = total + [int(f.sum()) for f in found], n + some.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(total), pa.array(np.full(len(values), n))], ["i", "total", "n"])

    rows = lists.mapInArrow(run, "i long, total long, n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("i").collect()
    return [float(r.total) for r in rows], rows[0].n if rows else 0


def _cut(lists: DataFrame, value: Callable, s: float) -> DataFrame:
    cuts = _cuts(lists, value, [s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, (found,) in cuts(batches):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found)], ["query_id", "k"])

    return lists.mapInArrow(run, T.StructType([lists.schema["query_id"], T.StructField("k", T.LongType())]))


def solve_marginal_scale(pool: DataFrame, p: str, floor: int, gold: Column, mean: float) -> tuple[float, DataFrame]:
    """The factor on the marginal threshold whose cuts have ``mean`` documents a query, and the cuts (query_id, k)."""
    scratch = Scratch(pool.sparkSession, "lambda")
    rows = cumulated(pool, p, floor, gold, scratch)
    best = F.max(5 * F.col("cum") / (4 * F.col("g") + F.col("k"))).over(W.partitionBy("query_id"))
    rows = rows.withColumn("f", best)
    lists = _listed(rows, scratch, "f")
    value = lambda s, k, cum, f: cum - s * f / 5 * k

    def means(values: list[float]) -> list[float]:
        totals, n = _totals(lists, value, values)
        return [t / n for t in totals]

    s = solve(means, mean, 0.05, 50.0, geometric=True, grows=False)
    return s, _cut(lists, value, s)


def solve_gold_scale(pool: DataFrame, p: str, gold: Column, target: int) -> tuple[float, DataFrame]:
    """The factor on expected hits whose best cuts argmax sum(p) / (4 s G + n) add up to ``target``, and the cuts (query_id, k)."""
    scratch = Scratch(pool.sparkSession, "scale")
    lists = _listed(cumulated(pool, p, 1, gold, scratch), scratch, "g")
    value = lambda s, k, cum, g: cum / (4 * s * g + k)
    s = solve(lambda values: _totals(lists, value, values)[0], target, 1e-4, 1e4, passes=6, geometric=True)
    return s, _cut(lists, value, s)


def fit_gold_scale(cuts: DataFrame, target: float) -> float:
    """The factor s on expected hits for which cuts (query_id, k, cum, g) have the mean expected F2 ``target``."""
    def means(values: list[float]) -> list[float]:
        return list(cuts.agg(*[F.avg(5 * F.col("cum") / (4 * F.lit(s) * F.col("g") + F.col("k"))) for s in values]).first())

    return solve(means, target, 0.01, 100.0, geometric=True, grows=False)


def _newton(step: Callable[[float, float], tuple], start: tuple[float, float], rounds: int) -> tuple[float, float]:
    """Damped Gauss-Newton for two parameters; ``step`` gives (cost, normal matrix, gradient) at a place."""
    at, (cost, matrix, slope), damp = np.array(start), step(*start), 1e-3
    for _ in range(rounds):
        move = np.linalg.solve(matrix + damp * np.diag(np.diag(matrix) + 1e-12), -slope)
        there = at + move
        new = step(*there.tolist())
        if new[0] <= cost:
            done = np.abs(move).max() < 1e-10
            at, (cost, matrix, slope), damp = there, new, max(damp / 10, 1e-12)
            if done:
                break
        else:
            damp *= 10
            if damp > 1e8:
                break
    return float(at[0]), float(at[1])


def fit_macro_means(pool: DataFrame, set_: str, p: str, targets: dict, rounds: int = 25) -> tuple[float, float]:
    """(a, b) of sigmoid(a logit(p) + b) whose macro means over the queries of each set come closest to its target."""
    rows = Scratch(pool.sparkSession, "macro").save(pool.select(F.col(set_).alias("of"), "query_id", X.logit(F.col(p)).alias("x")).where(F.col("of").isin(*targets)), "rows")

    def step(a: float, b: float) -> tuple:
        s = X.sigmoid(F.lit(a) * F.col("x") + F.lit(b))
        per = rows.groupBy("of", "query_id").agg(F.avg(s).alias("m"), F.avg(s * (1 - s) * F.col("x")).alias("da"), F.avg(s * (1 - s)).alias("db"))
        found = per.groupBy("of").agg(*[F.avg(c).alias(c) for c in ("m", "da", "db")]).orderBy("of").collect()
        jac = np.array([[r.da, r.db] for r in found]).reshape(-1, 2)
        rest = np.array([r.m - targets[r["of"]] for r in found])
        return float(rest @ rest), jac.T @ jac, jac.T @ rest

    starts = [(a, b) for a in (0.5, 1.0, 2.0) for b in (-2.0, 0.0, 2.0)]
    return _newton(step, min(starts, key=lambda s: step(*s)[0]), rounds)


def fit_sigmoid(rows: DataFrame, x: str, y: str, rounds: int = 25) -> tuple[float, float]:
    """(a, b) of least squares of sigmoid(a x + b) against y, from sums alone."""
    rows = Scratch(rows.sparkSession, "sigmoid").save(rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL"), "rows")

    def step(a: float, b: float) -> tuple:
        s = X.sigmoid(F.lit(a) * F.col("x") + F.lit(b))
        d, rest = s * (1 - s), s - F.col("y")
        sums = [rest * rest, d * d * F.col("x") * F.col("x"), d * d * F.col("x"), d * d, d * rest * F.col("x"), d * rest]
        cost, xx, x1, one, gx, g1 = (v or 0.0 for v in rows.agg(*[F.sum(c) for c in sums]).first())
        return cost, np.array([[xx, x1], [x1, one]]), np.array([gx, g1])

    return _newton(step, (1.0, 0.0), rounds)


def marginal_curve(rows: DataFrame, group: str, judge: str, p: str, band: int | float) -> DataFrame:
    """(group, i, judge, marginal): each group by falling ``judge`` with the mean of p over ``band`` places on either side (a share of the group if below 1).

    Sums of runs are differences of running totals, met by joins on places, so
    no group is in one task.
    """
    placed = ranking.running_totals(rows.select(group, "query_id", "doc_id", judge, p), [group, F.col(judge).desc(), "query_id", "doc_id"], {"_i": F.lit(1).cast("long"), "_cum": F.col(p)})
    ends = placed.groupBy(group).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"), F.min_by(F.col("_cum") - F.col(p), "_i").alias("_zero"))
    half = F.lit(band) if band >= 1 else F.greatest(F.lit(1), F.bround(F.lit(band) * F.col("_n")).cast("long"))
    at = placed.join(ends, group).select(group, judge, (F.col("_i") - F.col("_first") + 1).alias("i"), (F.col("_cum") - F.col("_zero")).alias("_sum"), "_n", half.alias("_h"))
    at = at.withColumn("_from", F.greatest(F.col("i") - F.col("_h") - 1, F.lit(0))).withColumn("_to", F.least(F.col("i") + F.col("_h"), F.col("_n")))
    sums = at.select(F.col(group).alias("_g"), F.col("i").alias("_at"), F.col("_sum").alias("_s"))
    met = at.join(sums.select(F.col("_g").alias("_g1"), F.col("_at").alias("_a1"), F.col("_s").alias("_s1")), (F.col(group) == F.col("_g1")) & (F.col("_to") == F.col("_a1")))
    met = met.join(sums.select(F.col("_g").alias("_g0"), F.col("_at").alias("_a0"), F.col("_s").alias("_s0")), (F.col(group) == F.col("_g0")) & (F.col("_from") == F.col("_a0")), "left")
    return met.select(group, "i", judge, ((F.col("_s1") - F.coalesce("_s0", F.lit(0.0))) / (F.col("_to") - F.col("_from"))).alias("marginal"))


def group_thresholds(pool: DataFrame, group: str, judge: str, p: str, base: str, band: float = 0.05, low: float = 0.5, high: float = 1.3, passes: int = 3, tries: int = 20) -> tuple[float, DataFrame]:
    """(c, thresholds): one threshold for each group, where its marginal precision falls to a common c that is a fifth of the F2 that they give.

    ``base`` is the base depth of a document's query.  A query keeps as many
    documents, in the order of its p, as pass their group's threshold, between
    the bounds relative to its base depth.
    """
    scratch = Scratch(pool.sparkSession, "thresholds")
    curve = scratch.save(marginal_curve(pool, group, judge, p, band), "curve")
    order = per_query(F.col(p).desc(), "doc_id")
    rows = pool.select("query_id", group, judge, F.col(base).alias("_base"), F.row_number().over(order).alias("k"), F.sum(p).over(order.rowsBetween(*RUNNING)).alias("cum"), F.sum(p).over(W.partitionBy("query_id")).alias("g"))
    rows = scratch.save(rows, "rows")
    sums = rows.select("query_id", "k", "cum", "g")

    def thresholds(values: list[float]) -> DataFrame:
        """Judge scores where the marginal first falls to each value, else the last one of the group."""
        first = [F.coalesce(F.max(F.when(F.col("marginal") <= c, F.col(judge))), F.min(judge)).alias(f"t{i}") for i, c in enumerate(values)]
        return curve.groupBy(group).agg(*first)

    def gaps(values: list[float]) -> list[float]:
        met = rows.join(thresholds(values), group)
        clip = lambda n: F.least(F.greatest(n, F.ceil(F.lit(low) * F.first("_base") - 1e-9)), F.floor(F.lit(high) * F.first("_base") + 1e-9), F.count("*"))
        keep = met.groupBy("query_id").agg(*[clip(F.count_if(F.col(judge) >= F.col(f"t{i}"))).cast("int").alias(f"k{i}") for i in range(len(values))])
        each = keep.select("query_id", F.posexplode(F.array(*[f"k{i}" for i in range(len(values))])).alias("i", "k"))
        f2 = each.join(sums, ["query_id", "k"], "left").groupBy("i").agg(F.sum(F.coalesce(5 * F.col("cum") / (4 * F.col("g") + F.col("k")), F.lit(0.0))).alias("f"), F.count("*").alias("n"))
        found = {r.i: r.f / r.n for r in f2.collect()}
        return [found.get(i, 0.0) / 5 - c for i, c in enumerate(values)]

    c = solve(gaps, 0.0, 0.01, 0.5, passes=passes, tries=tries, grows=False)
    return c, thresholds([c]).withColumnRenamed("t0", "threshold")


def keep_by_scale(pool: DataFrame, judge: str, rank: str, base: Column, low: float = 0.6, high: float = 1.3) -> DataFrame:
    """(query_id, n): base depths scaled by how good their own documents are, with the same total."""
    per = pool.withColumn("_base", base).where(F.col(rank) <= F.col("_base")).groupBy("query_id").agg(F.first("_base").alias("_base"), F.avg(judge).alias("_r"))
    mean = per.agg(F.avg("_r").alias("_mean"))
    sizes = per.crossJoin(F.broadcast(mean)).select(
        "query_id", (F.col("_base") * F.col("_r") / F.col("_mean")).alias("raw"), F.ceil(F.lit(low) * F.col("_base") - 1e-9).alias("low"), F.floor(F.lit(high) * F.col("_base") + 1e-9).alias("high"), "_base"
    )
    return fusion.allocate_total(sizes, "raw", "low", "high", int(sizes.agg(F.sum("_base")).first()[0]))


def keep_free(pool: DataFrame, judge: str, base: Column, threshold: float, low: float = 0.5, high: float = 1.3, wider: float = 2.0) -> DataFrame:
    """(query_id, keep, extended): documents at or above a threshold, clipped around the base depth; and the same with a wider cap for lists that hit theirs."""
    n = pool.withColumn("_base", base).groupBy("query_id").agg(F.first("_base").alias("_base"), F.count_if(F.col(judge) >= threshold).alias("_n"), F.count("*").alias("_size"))
    end = lambda x: F.floor(F.lit(x) * F.col("_base") + 1e-9)
    clip = lambda x: F.least(F.greatest(F.col("_n"), F.ceil(F.lit(low) * F.col("_base") - 1e-9)), end(x), F.col("_size")).cast("long")
    return n.select("query_id", clip(high).alias("keep"), F.when(clip(high) == end(high), clip(wider)).otherwise(clip(high)).alias("extended"))


def folded_regression(rows: DataFrame, key: str, features: list[str], y: str, folds: int = 5, ridge: float = 1e-6) -> DataFrame:
    """(key, y, predicted): linear regression whose coefficients for a row come from the other folds.

    The fold is the key modulo ``folds``.  Sums of products of each fold are all
    that the driver sees; features are centred and scaled by the sums.
    """
    fold = F.pmod(F.col(key), F.lit(folds))
    held = Scratch(rows.sparkSession, "regression").save(rows.select(key, fold.alias("_fold"), F.col(y).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]), "rows")
    columns = [F.lit(1.0), *(F.col(f) for f in features), F.col("_y")]
    m = len(columns)
    sums = held.groupBy("_fold").agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]).collect()
    grams = {}
    for r in sums:
        gram = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                gram[i, j] = gram[j, i] = r[f"s{i}_{j}"]
        grams[r._fold] = gram
    whole = sum(grams.values(), np.zeros((m, m)))
    predicted = F.lit(None).cast("double")
    for f, own in grams.items():
        gram = whole - own if len(grams) > 1 else whole
        n = gram[0, 0]
        mean = gram[0, 1:-1] / n
        spread = np.sqrt(np.maximum(np.diag(gram)[1:-1] / n - mean**2, 1e-12))
        centred = (gram[1:-1, 1:-1] / n - np.outer(mean, mean)) / np.outer(spread, spread)
        slope = np.linalg.solve(centred + ridge * np.eye(m - 2), (gram[1:-1, -1] / n - mean * gram[0, -1] / n) / spread) / spread
        at = F.lit(float(gram[0, -1] / n - slope @ mean))
        for name, s in zip(features, slope.tolist(), strict=True):
            at = at + F.lit(s) * F.col(name)
        predicted = F.when(F.col("_fold") == f, at).otherwise(predicted)
    return held.select(key, F.col("_y").alias("y"), predicted.alias("predicted"))
