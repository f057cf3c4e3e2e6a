"""Quantiles by sketch and exact counts, against sorted lists and Spark's percentile."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ranking

SHARES = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def plain(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] if low == high or values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high]


def made():
    rng = random.Random(3)
    rows = [("many", rng.gauss(0, 1e3)) for _ in range(4000)] + [("crowd", rng.choice([1.0, 1.0, 1.0, 2.0, 1e300])) for _ in range(2000)]
    rows += [(None, float(k)) for k in range(7)] + [("one", 5.0), ("none", None), ("many", None)]
    return rows


@pytest.mark.parametrize(("accuracy", "margin"), [(10_000, 5), (200, 5), (10, 5), (10, -3)])
def test_quantiles_are_exact(spark, monkeypatch, accuracy, margin):
    """A small accuracy makes brackets matter; ends the wrong way round make every bracket miss."""
    monkeypatch.setattr(ranking, "MARGIN", margin)
    df = spark.createDataFrame(made(), "g string, v double").repartition(5)
    got = {r.g: r for r in ranking.quantiles(df, ["g"], "v", SHARES, {"n": F.count("*")}, accuracy).collect()}
    assert set(got) == {"many", "crowd", None, "one", "none"} and got["many"].n == 4001
    for g, r in got.items():
        values = [v for h, v in made() if h == g and v is not None]
        assert [r[n] for n in SHARES] == [plain(values, q) if values else None for q in SHARES.values()]


def test_only_values_near_a_quantile_are_counted(spark, monkeypatch):
    """Before, a task held every distinct value of its group."""
    from corpusloom.plans import catalogue, relational

    df = spark.range(300_000).select((F.col("id") % 2).cast("string").alias("l_returnflag"), (F.col("id") / 3).alias("l_extendedprice"))
    monkeypatch.setattr(relational, "table", lambda *_: df)
    counted, save = {}, ranking.Scratch.save

    def kept(self, df, name):
        out = save(self, df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(ranking.Scratch, "save", kept)
    got = {r.l_returnflag: r for r in catalogue.QUERIES["band_quantiles"](spark, "").collect()}
    p = lambda q, n: F.round(F.percentile("l_extendedprice", q), 6).alias(n)
    for r in df.groupBy("l_returnflag").agg(p(0.1, "p10"), p(0.5, "p50"), p(0.9, "p90"), F.round(F.avg((F.col("l_extendedprice") > 50000).cast("int")), 6).alias("share")).collect():
        assert got[r.l_returnflag].asDict() == r.asDict()
    assert 0 < sum(counted.values()) < 3_000 and "far" not in counted


def test_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("int").alias("v"))
    assert [tuple(r) for r in ranking.quantiles(df, [], "v", {"p": 0.255}).collect()] == [(25.5,)]
    assert [tuple(r) for r in ranking.quantiles(df.where("v < 0"), [], "v", {"p": 0.5}).collect()] == [(None,)]
