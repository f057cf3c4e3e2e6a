"""Connected components without driver-side graphs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import Scratch
from .skew import join_counted

#: Neighbours beyond which a node is a hub whose edges stay where they lie, and the most hubs that are broadcast.
HUB, MAX_HUBS = 10_000, 200_000
#: Up to so many times the hub's neighbours of edges, no node can have too many for a task, and both stars are one job of three shuffles.
FEW = 10


def _both_stars(state: DataFrame) -> DataFrame:
    """Large-star and small-star of few edges (u, v), u > v; what a node needs to know is a window over its edges."""
    own = W.partitionBy("u")
    both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.withColumn("m", F.least(F.min("v").over(own), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = large.withColumn("m", F.min("v").over(own))
    met = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
    return small.select(met.alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def _wide_stars(state: DataFrame, scratch: Scratch, k: int, crowded: int) -> DataFrame:
    """The same of any number of edges; nodes of more than ``crowded`` neighbours are met by broadcast."""
    both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    large = join_counted(both, least, ["u"], "n", crowded).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = scratch.save(large, f"large{k}")
    up = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    small = (
        join_counted(large, up, ["u"], "n", crowded)
        .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u <> v")
        .distinct()
    )
    return small


def components(edges: DataFrame, scratch: Scratch, hub: int = HUB) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b: long) with the smallest node reachable.

    Alternates large-star and small-star until the edges form stars, however
    many rounds that takes (the square of the logarithm of the nodes at most).
    Each round is a written table; the only value that reaches the driver is a
    checksum.  Up to ``FEW`` times ``hub`` edges a round is one job, so that many small rounds do
    not fill the driver with the records of their tasks.  Beyond, a node of many neighbours is a hub: what its edges need to know,
    one row, is broadcast to them.  The bound rises with the edges, so at most
    ``MAX_HUBS`` rows are broadcast.

    Defined results: loops, repeated edges and edges with a null end change
    nothing; no edges give no rows.
    """
    given = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v AND a IS NOT NULL AND b IS NOT NULL").distinct()
    state, now, seen = scratch.save(given, "star0"), None, None
    for k in count():
        n = state.count() if now is None else now[0]
        state = scratch.save(_both_stars(state) if n <= FEW * hub else _wide_stars(state, scratch, k, max(hub, 2 * n // MAX_HUBS)), f"star{k + 1}")
        now = state.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)), F.coalesce(F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))"), F.lit(0).cast("decimal(38,0)"))).first()
        scratch.drop(f"star{k}")
        if n > FEW * hub:
            scratch.drop(f"large{k}")
        if seen == now:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
