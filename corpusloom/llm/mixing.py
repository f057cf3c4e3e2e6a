"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document of a source, in an order shuffled by a hash, is a packet of its
size in words.  Its virtual finish time is the source's cumulative words over
the source's target; a source that must repeat goes through the same order
again, up to ``MAX_COPIES`` times.  All copies are sorted by finish time over
the whole corpus and the queue is cut where the total budget is used up: a
source reaches its target at time 1, and no source runs beyond it.  A document
that would not end in time leaves a gap, so the queue is run again over what is
left, with the gaps as targets; documents larger than a gap stand back.

Both running sums are computed in two levels, so that no source and no stretch
of the queue lies in one task: shuffle order is split by the hash's first three
digits, the queue into ranges of finish time; sums of whole parts are added up
over the small table of parts, which has at most 3 x 4,096 rows for a source
and 4,096 for the queue, however many documents there are.  Targets are worked
out in one task over one row for each source.

Where the mix is applied to documents, texts stay where they lie: of each part
of a source almost all documents are taken equally often, so one broadcast row a
part says how often, and the names of the others, which the queue's cuts and
gaps make, are broadcast too.  Only if both are more than ``MAX_RULES`` rows are
texts dealt by name instead.

Defined results: null text has size 0; documents of size 0 take nothing; null
source is a source, the last one; targets of an empty corpus are 0; repeated
rows are documents of their own; ties go by source, round, hash, id and size;
reruns agree, for nothing depends on the order of the input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import rows as named_rows
from .scratch import Scratch

# The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Queues that are run one after the other; each but the first fills what is left with documents that fit.
PASSES = 3
#: Ranges of finish time in the global sort.
SPANS = 4096
#: Rows of parts and exceptions up to which they are broadcast to the documents.
MAX_RULES = 200_000
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, rank, source_size, target) from rows of (source, size).

    Water-filling in closed form: with sources in ascending order of cap over
    weight, those before the first source that its share does not overfill are
    capped, and the rest split what remains by weight.
    """
    one = W.partitionBy(F.lit(0))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    room = ranked.withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(cap))
    filling = one.orderBy(F.col("room") / F.col("weight"), "rank")
    level = (F.sum("source_size").over(one) - (F.sum("room").over(filling.rowsBetween(W.unboundedPreceding, 0)) - F.col("room"))) / F.sum(
        "weight"
    ).over(filling.rowsBetween(0, W.unboundedFollowing))
    levels = room.withColumn("level", level.cast("double"))
    free = F.col("level") * F.col("weight") <= F.col("room")
    # of the sources that have room, the first fixes the level
    first = F.first(F.when(free, F.col("level")), ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    capped = levels.withColumn("water", first)
    target = F.least(F.col("water") * F.col("weight"), F.col("room").cast("double"))
    return capped.select("source", "rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _pass(state: DataFrame, targets: DataFrame, scratch: Scratch, number: int, copies: int) -> DataFrame:
    """One queue over the copies that are left and fit; adds what it takes to ``turns``."""
    spent = state.groupBy("rank").agg(F.sum(F.col("turns") * F.col("size")).alias("spent"))
    rooms = scratch.save(targets.join(spent, "rank").select("rank", "spent", (F.col("target") - F.col("spent")).alias("room")), f"rooms{number}")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("b")).crossJoin(rooms.agg(F.coalesce(F.sum("spent"), F.lit(0)).alias("s")))
    offers = (
        state.join(rooms.drop("spent"), "rank")
        .where((F.col("size") > 0) & (F.col("size") <= F.col("room")) & (F.col("turns") < copies))
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(copies - 1) - F.col("turns").cast("int"))))
        .withColumn("stretch", F.concat(F.col("round").cast("string"), F.col("part")))
    )
    offers = scratch.save(offers, f"offers{number}")
    sums = offers.groupBy("rank", "stretch").agg(F.sum("size").alias("stretch_size"))
    before = F.sum("stretch_size").over(W.partitionBy("rank").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("stretch_size")
    offsets = sums.select("rank", "stretch", before.alias("before"))
    within = F.sum("size").over(W.partitionBy("rank", "stretch").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    finish = (F.col("before") + F.col("within")).cast("double") / F.col("room")
    timed = offers.withColumn("within", within).join(offsets, ["rank", "stretch"]).withColumn("finish", finish)
    # a source stops at its own target, where its finish time is 1; the ranges of the global sort divide what is before
    queue = scratch.save(timed.where("finish <= 1").withColumn("span", F.floor(F.col("finish") * SPANS).cast("int")), f"queue{number}")
    along = W.partitionBy(F.lit(0)).orderBy("span").rowsBetween(W.unboundedPreceding, 0)
    ahead = queue.groupBy("span").agg(F.sum("size").alias("span_size")).select("span", (F.sum("span_size").over(along) - F.col("span_size")).alias("ahead"))
    order = W.partitionBy("span").orderBy("finish", "rank", "round", "part", "place").rowsBetween(W.unboundedPreceding, 0)
    used = queue.join(ahead, "span").withColumn("used", F.col("ahead") + F.sum("size").over(order))
    taken = used.crossJoin(F.broadcast(budget)).where("used <= b - s").groupBy("rank", "part", "place").agg(F.count("*").alias("now"))
    added = state.join(taken, ["rank", "part", "place"], "left").withColumn("turns", F.col("turns") + F.coalesce("now", F.lit(0))).drop("now")
    return scratch.save(added, f"state{number}")


def _queue(slim: DataFrame, scratch: Scratch, weights: tuple[int, ...], copies: int) -> DataFrame:
    """``slim`` (source, size, doc_id, mix_order, ...) with source_size, target and ``turns``, the copies that the queue takes."""
    targets = scratch.save(source_targets(slim, weights, copies), "targets")
    known = targets.select(F.col("source").alias("of"), "rank", "source_size", "target")
    parts = slim.withColumn("part", _part(F.col("mix_order"))).join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    place = F.row_number().over(W.partitionBy("rank", "part").orderBy("mix_order", "doc_id", "size"))
    full = scratch.save(parts.withColumn("place", place), "placed")
    state = full.select("rank", "part", "place", "size", F.lit(0).cast("long").alias("turns"))
    for number in range(PASSES):
        state = _pass(state, targets, scratch, number, copies)
    return full.join(state.drop("size"), ["rank", "part", "place"]).select(*slim.columns, "source_size", "target", "turns")


def _part(mix_order: Column) -> Column:
    return F.substring(mix_order, 1, 3)


def _order(key: str) -> Column:
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _slim(df: DataFrame, key: str, source: str, text: str, *more: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _order(key).alias("mix_order"), *more)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, copies: int = MAX_COPIES) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (words that the mix takes)."""
    scratch = Scratch(df.sparkSession, "mix")
    slim = scratch.save(_slim(df, key, source, text), "slim")
    queued = _queue(slim, scratch, weights, copies)
    return queued.select(F.col("doc_id").alias(key), "size", "source_size", "target", (F.col("turns") * F.col("size")).alias("taken"))


def mixed_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, copies: int = MAX_COPIES) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, all columns kept."""
    scratch = Scratch(df.sparkSession, "mix")
    slim = scratch.save(_slim(named_rows.named(df, key), key, source, text, named_rows.KEY, named_rows.HASH), "slim")
    queued = _queue(slim, scratch, weights, copies).where("size > 0").withColumn("part", _part(F.col("mix_order")))
    alike = [F.first(c).alias(c) for c in ("source", "part")]
    per_name = queued.groupBy(named_rows.KEY, named_rows.HASH).agg(F.count("*").alias(named_rows.COPIES), F.sum("turns").alias("turns"), *alike)
    per_name = scratch.save(per_name, "turns")
    of = per_name.groupBy("source", "part", F.floor(F.col("turns") / F.col(named_rows.COPIES)).cast("int").alias("often")).agg(F.count("*").alias("n"))
    usual = of.groupBy(F.col("source").alias("_loom_of"), F.col("part").alias("_loom_part")).agg(F.max_by("often", F.struct("n", "often")).alias("_loom_often"))
    usual = scratch.save(usual, "usual")
    by_part = F.col("source").eqNullSafe(F.col("_loom_of")) & (F.col("part") == F.col("_loom_part"))
    other = per_name.join(usual, by_part).where(F.col("turns") != F.col("_loom_often") * F.col(named_rows.COPIES))
    other = scratch.save(other.select(named_rows.KEY, named_rows.HASH, named_rows.COPIES, "turns"), "other")
    if usual.count() + other.count() > MAX_RULES:
        return named_rows.repeat(df, per_name.where("turns > 0").select(*other.columns), key)
    rows = named_rows.named(df.where(F.col(text).rlike(WORD)), key).withColumn("_loom_source", F.col(source)).withColumn("_loom_at", _part(_order(key)))
    rows = rows.join(F.broadcast(usual), F.col("_loom_source").eqNullSafe(F.col("_loom_of")) & (F.col("_loom_at") == F.col("_loom_part")))
    return named_rows.repeat(df, F.broadcast(other), key, rows, "_loom_often")


#: DuckDB: the rows of ``mix``.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mix_order FROM {documents}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
room AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS room FROM per),
levels AS (SELECT *, CAST(CAST(sum(source_size) OVER () - (sum(room) OVER f - room) AS DOUBLE)
             / CAST(sum(weight) OVER (ORDER BY CAST(room AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS DOUBLE) AS level
           FROM room WINDOW f AS (ORDER BY CAST(room AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
water AS (SELECT min_by(level, (CAST(room AS DOUBLE) / weight, rank)) AS water FROM levels WHERE level * weight <= room),
targets AS (SELECT source, rank, source_size, coalesce(least(water * weight, CAST(room AS DOUBLE)), 0.0) AS target FROM levels CROSS JOIN water),
state0 AS (SELECT d.*, rank, source_size, target, CAST(0 AS BIGINT) AS turns, target AS room FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source){passes}
SELECT doc_id, size, source_size, target, CAST(turns * size AS BIGINT) AS taken FROM state{last}
"""

_PASS_SQL = r""",
offer{k} AS (SELECT *, CAST(sum(size) OVER (PARTITION BY rank ORDER BY round, mix_order, doc_id, size, rid ROWS UNBOUNDED PRECEDING) AS DOUBLE) / room AS finish
             FROM state{k} CROSS JOIN (SELECT unnest([0, 1, 2]) AS round) WHERE size > 0 AND size <= room AND round < 3 - turns),
used{k} AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, round, mix_order, doc_id, size, rid ROWS UNBOUNDED PRECEDING) AS used FROM offer{k} WHERE finish <= 1),
got{k} AS (SELECT rid AS got_rid, count(*) AS now FROM used{k} WHERE used <= (SELECT sum(size) - sum(turns * size) FROM state{k}) GROUP BY rid),
turn{k} AS (SELECT s.* EXCLUDE (turns, room), turns + coalesce(now, 0) AS turns FROM state{k} s LEFT JOIN got{k} ON rid = got_rid),
state{j} AS (SELECT *, target - CAST(sum(turns * size) OVER (PARTITION BY rank) AS BIGINT) AS room FROM turn{k})"""


def oracle(documents: str = "documents") -> str:
    passes = "".join(_PASS_SQL.format(k=k, j=k + 1) for k in range(PASSES))
    return SQL.format(documents=documents, passes=passes, last=PASSES)
