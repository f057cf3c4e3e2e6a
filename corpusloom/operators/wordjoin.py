"""Pairs of word lists that may share a given part of the longer one's words, without a row for each pair that meets.

A list is the multiset of its words; what occurs again is told apart by its
number.  Two lists of n <= m words that share ``share`` of m have, in one order of
all words, rare ones first, a word in common within the first
``n - ceil(share n) + 1`` of one and ``m - ceil(share m) + 1`` of the other.  Only these are
exploded and met by word, each with its place and its list's sketch (``BITS``
parities, of which two lists that differ in d words differ in d at most).  What
length, place and sketch rule out makes no row.

The order comes from ``setjoin.rarity``; a word that its counter has seen once has no
partner and is left out.  The words are met in rounds, by ranges of their hash, so
the disk holds the shuffle of one round.  The lists of a crowded word are cut
into blocks of ``TILE``, each two of which meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, few_rows
from . import setjoin

#: Parities of a sketch, a power of two, and their columns.
BITS = 512
_ODDS = [f"o{k}" for k in range(BITS // 64)]
#: Words that are met in one round (some 80 bytes each), and the most rounds.
ROUND, MAX_ROUNDS = 3_000_000, 16
#: Lists of a word that meet in one task, lists that a task looks at in one step, and those that Python takes at a time.
TILE, CHUNK, ROWS = 8192, 1 << 17, 1024
_EPS = 1e-9


def numbered(lists: DataFrame) -> DataFrame:
    """``lists`` (id, k, n, grams) with what occurs again in a row told apart by the number of the occurrence."""
    kind = lists.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(3)
            every = held.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy())
            order = np.lexsort((every, row))
            again = np.zeros(len(every), bool)
            again[1:] = (every[order][1:] == every[order][:-1]) & (row[order][1:] == row[order][:-1])
            at = np.arange(len(every))
            occurrence = at - np.maximum.accumulate(np.where(again, 0, at))
            own = every[order].view(np.uint64) + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            ends = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(own.view(np.int64)))], ["id", "k", "n", "grams"])

    return lists.mapInArrow(run, f"id {kind}, k binary, n int, grams array<long>")


def _early(lists: DataFrame, counts: np.ndarray, share: float) -> DataFrame:
    """(id, k, n, words, places, most, and the sketch) of ``numbered`` lists: hashes and places of the early words that others may have, and the highest count of them."""
    sent, kind = lists.sparkSession.sparkContext.broadcast(counts), lists.schema["id"].dataType.simpleString()
    names = ["id", "k", "n", "words", "places", "most", *_ODDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n, held = batch.column(2).to_numpy().astype(np.int64), batch.column(3)
            every, row = held.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            odd = np.zeros((len(n), BITS), np.uint8)
            np.add.at(odd, (row, every & (BITS - 1)), 1)
            odd = np.packbits(odd & 1, axis=1, bitorder="little").view(np.int64)
            seen = known[setjoin.counter_of(every)]
            order = np.lexsort((every, seen, row))
            place = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
            every, seen = every[order], seen[order]
            keep = (place < np.repeat(n - np.ceil(share * n - _EPS).astype(np.int64) + 1, n)) & (seen > 1)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(n)))]).astype(np.int32))
            most = np.zeros(len(n), np.int64)
            np.maximum.at(most, row[keep], seen[keep])
            lists_of = lambda x: pa.ListArray.from_arrays(ends, pa.array(x[keep].astype(np.int32)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists_of(every >> 32), lists_of(place), pa.array(most), *(pa.array(np.ascontiguousarray(c)) for c in odd.T)], names)

    return lists.mapInArrow(run, f"id {kind}, k binary, n int, words array<int>, places array<int>, most long, " + ", ".join(f"{c} long" for c in _ODDS))


def _pairs(rows: list[np.ndarray], share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of rows of whole groups, sorted by group and n: each row meets those after it in its group as long as the lengths allow."""
    word, tile, side, n, place, *odd = rows
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (tile[1:] != tile[:-1])])
    end = np.append(np.flatnonzero(new)[1:], len(word))[np.cumsum(new) - 1]
    cross = (tile >> 32) != (tile & 0xFFFFFFFF)
    for at in range(0, len(word), CHUNK):
        one = np.arange(at, min(at + CHUNK, len(word)))
        for step in count(1):
            one = one[one + step < end[one]]
            one = one[n[one] >= share * n[one + step] - _EPS]
            if not len(one):
                break
            other = one + step
            need = share * n[other] - _EPS
            good = (n[one] - place[one] >= need) & (n[other] - place[other] >= need) & (~cross[one] | (side[one] != side[other]))
            x, y = one[good], other[good]
            if len(x):
                differ = sum(np.bitwise_count((w[x] ^ w[y]).view(np.uint64)).astype(np.int64) for w in odd)
                allowed = differ <= n[x] + n[y] - 2 * np.ceil(share * n[y] - _EPS)
                yield x[allowed], y[allowed]


def _meet(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Holds whole groups, which are of two blocks at most, and names a pair once for all that it holds."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, CHUNK

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table["id"].combine_chunks()
        # a list is known by the first of its rows
        first = ids.dictionary_encode().indices.to_numpy()
        name = np.full(int(first.max()) + 1, len(first), np.int64)
        np.minimum.at(name, first, np.arange(len(first)))
        found, many = [np.zeros(0, np.int64)], 0

        def out() -> pa.RecordBatch:
            both = np.unique(np.concatenate(found))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(name[both // len(name)])), ids.take(pa.array(name[both % len(name)]))], ["x", "y"])

        for x, y in _pairs([table[c].to_numpy() for c in ["word", "tile", "side", "n", "place", *_ODDS]], share):
            found.append(first[x].astype(np.int64) * len(name) + first[y])
            many += len(x)
            if many >= CHUNK:
                yield out()
                found, many = [np.zeros(0, np.int64)], 0
        if many:
            yield out()

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            word, tile = table["word"].to_numpy(), table["tile"].to_numpy()
            whole = int(np.flatnonzero((word == word[-1]) & (tile == tile[-1]))[0])
            if whole:
                yield from pairs(table.slice(0, whole))
                table = table.take(pa.array(np.arange(whole, size)))  # a slice would keep what is done
            held, size = table.to_batches(), size - whole
            enough = max(CHUNK, 2 * size)
    if size:
        yield from pairs(pa.Table.from_batches(held))


def distinct_lists(rows: DataFrame, share: float, scratch: Scratch) -> DataFrame:
    """(id, k, n, many, words, places, most, and the sketch) of one row for each key ``k`` of ``rows`` (id, k, w); written.  Its id is the smallest, ``many`` the number of rows."""
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    with few_rows(rows.sparkSession, ROWS):
        lists = numbered(rows.select("id", "k", F.size("w").alias("n"), hashes.alias("grams")))
        early = _early(lists, setjoin.rarity(lists), share)
        values = [c for c in early.columns if c not in ("id", "k")]
        one = early.groupBy("k").agg(F.min_by(F.struct(*values), "id").alias("v"), F.min("id").alias("id"), F.count("*").alias("many"))
        return scratch.save(one.select("id", "k", "many", "v.*"), "lists")


def candidates(lists: DataFrame, share: float, scratch: Scratch, rounds: int | None = None, tile: int = TILE) -> DataFrame:
    """Distinct (a, b), a < b, of ``distinct_lists`` that pass length, place and sketch; every pair that shares ``share`` of the longer's words is among them.  Written."""
    spark, kind = lists.sparkSession, lists.schema["id"].dataType.simpleString()
    entries, most = lists.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.max("most"), F.lit(0))).first()
    rounds = rounds or min(MAX_ROUNDS, max(1, -(-entries // ROUND)))
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        parts = []
        for number in range(rounds):
            met = lists.select("id", "n", F.explode(F.arrays_zip("words", "places")).alias("e"), *_ODDS).select(F.col("e.words").alias("word"), F.col("e.places").alias("place"), "id", "n", *_ODDS)
            met = _dealt(met.where(F.pmod(F.xxhash64("word"), F.lit(rounds)) == number), most, tile)
            dealt = met.repartition("word", "tile").sortWithinPartitions("word", "tile", "n")
            found = dealt.mapInArrow(lambda batches: _meet(batches, share), f"x {kind}, y {kind}")
            found = found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            parts.append(scratch.save(found.distinct(), f"round{number}"))
        if rounds == 1:
            return parts[0]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return scratch.save(every.distinct(), "candidates")
    finally:
        spark.conf.set(cleanup, before)


def _dealt(met: DataFrame, most: int, tile: int) -> DataFrame:
    """``met`` with (tile, side): a word of more than ``tile`` lists is cut into blocks, each two of which are a tile.  ``most`` bounds the lists of a word."""
    one: Column = F.lit(0).cast("long")
    if most <= tile:
        return met.withColumn("tile", one).withColumn("side", one)
    many = met.groupBy("word").agg(F.count("*").alias("many")).where(F.col("many") > tile)
    blocks = F.coalesce(F.ceil(F.col("many") / F.lit(tile)), F.lit(1)).cast("int")
    met = met.join(F.broadcast(many), "word", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return met.withColumn("tile", F.shiftleft(low.cast("long"), 32) + high).withColumn("side", (F.col("block") == low).cast("long")).drop("many", "blocks", "block", "other")
