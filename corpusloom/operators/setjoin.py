"""Set-similarity join: all pairs of sets with at least a given Jaccard, by prefix, length and position.

Every set is put into one order, rare elements first.  Two sets that are alike
share an element early in both: of the smaller set within the first
``n - ceil(2t / (1 + t) n) + 1``, of the larger within the first ``n - ceil(t n) + 1``.  Only these
prefixes are exploded and met by element.  A meeting goes on if the lengths
allow the likeness, if enough elements are left behind both places for the
overlap that it needs, and if the sets' sketches allow it: ``ODD`` bits, each whether an
odd number of the set's elements falls on it.  Sets differ in at least as many elements as their
sketches in bits.  So texts around one template, each with edits of its own,
meet in a task and make no rows there.

The order comes from ``COUNTERS`` hashed counts, a table of fixed size.  Any order gives
the same pairs; a poor one only makes more candidates.

Sets may carry a root: sets of one root are joined already and do not meet.
Elements that all their sets share with one root only, or that no smaller set
indexes, are dropped before anything is sorted.  The sets of a crowded element
are cut into blocks of ``TILE``, and each two blocks meet in a task of their own, so
no task holds more than two blocks.

Defined results: sets are distinct elements without nulls; empty sets have no partner; nodes are not null and come
once; no sets give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, few_rows
from .skew import join_counted

#: Hashed counts that order the elements, a power of two; they reach the driver and every task (4 bytes each).
COUNTERS = 1 << 20
#: Sets of an element that meet in one task, and the most elements whose numbers are broadcast.
TILE, MAX_HOT = 8192, 500_000
#: Meetings that a task looks at in one step.
CHUNK = 1 << 18
#: Bits of a sketch, a power of two, and their columns.
ODD = 1024
_ODDS = [f"o{k}" for k in range(ODD // 64)]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EPS = 1e-9


def counter_of(elements: np.ndarray) -> np.ndarray:
    return ((elements.view(np.uint64) * _SPREAD) >> np.uint64(44)).astype(np.int64) & (COUNTERS - 1)


def rarity(sets: DataFrame) -> np.ndarray:
    """How many elements of all ``sets`` fall on each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(counter_of(batch.column(0).flatten().to_numpy()), minlength=COUNTERS)
        (some,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["counter", "n"])

    found = sets.select("grams").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def probe_length(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(similarity * n - _EPS).astype(np.int64) + 1


def index_length(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(2 * similarity / (1 + similarity) * n - _EPS).astype(np.int64) + 1


def parity(elements: np.ndarray) -> np.ndarray:
    """The sketch of a set as signed words."""
    on = np.bincount((elements & (ODD - 1)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").view(np.int64)


def _prefixes(sets: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(element, node, root, n, place, indexed, and the sketch) of the prefix of each set."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    names = ["element", "node", "root", "n", "place", "indexed", *_ODDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            every, n = batch.column(2).flatten().to_numpy(), np.diff(ends)
            keep = np.where(n > 0, probe_length(n, similarity), 0)
            chosen, odd = [], np.zeros((len(n), ODD // 64), np.int64)
            for row, (s, e, k) in enumerate(zip(ends[:-1], ends[1:], keep, strict=True)):
                own = every[s:e]
                odd[row] = parity(own)
                chosen.append(own[np.lexsort((own, known[counter_of(own)]))[:k]])
            place = np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
            columns = [np.concatenate([*chosen, np.zeros(0, np.int64)]), *(np.repeat(batch.column(k).to_numpy(), keep) for k in range(2)), np.repeat(n, keep), place]
            columns += [place < np.repeat(index_length(n, similarity), keep), *(np.repeat(c, keep) for c in odd.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    return sets.select("node", "root", "grams").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _meetings(rows: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller set, larger set) of whole groups, sorted by group and root: every indexed row meets the rows of other roots."""
    group, tile, side, node, root, n, place, indexed, *odd = rows
    new_group = np.concatenate([[True], (group[1:] != group[:-1]) | (tile[1:] != tile[:-1])])
    new_run = new_group | np.concatenate([[True], root[1:] != root[:-1]])
    first, run = np.flatnonzero(new_group), np.flatnonzero(new_run)
    of_group, of_run = np.cumsum(new_group) - 1, np.cumsum(new_run) - 1
    start, end = first[of_group], np.append(first[1:], len(group))[of_group]
    run_start, run_size = run[of_run], np.diff(np.append(run, len(group)))[of_run]
    cross = (tile >> 32) != (tile & 0xFFFFFFFF)
    every = np.flatnonzero(indexed)
    for at in range(0, len(every), CHUNK):
        one, found, held = every[at : at + CHUNK], [], 0
        for step in count():
            one = one[start[one] + step < end[one] - run_size[one]]
            if not len(one):
                break
            other = start[one] + step
            other = other + np.where(other >= run_start[one], run_size[one], 0)
            small, large = n[one], n[other]
            need = np.ceil(similarity / (1 + similarity) * (small + large) - _EPS)
            good = (small < large) | ((small == large) & (node[one] < node[other]))
            good &= (small - place[one] >= need) & (large - place[other] >= need) & (small >= similarity * large - _EPS)
            good &= ~cross[one] | (side[one] != side[other])
            x, y = one[good], other[good]
            if len(x):
                differ = sum(np.bitwise_count((w[x] ^ w[y]).view(np.uint64)).astype(np.int64) for w in odd)
                allowed = differ * (1 + similarity) <= (n[x] + n[y]) * (1 - similarity) + 1e-6
                x, y = x[allowed], y[allowed]
            found.append((node[x], node[y]))
            held += len(found[-1][0])
            if held >= CHUNK:
                yield tuple(map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*found, strict=True)))


def _meet(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Holds whole groups, which are of two blocks at most."""
    held: list[list[np.ndarray]] = []
    size, enough = 0, CHUNK

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, y in _meetings(rows, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= enough:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            whole = int(np.flatnonzero(last)[0])
            if whole:
                yield from pairs([c[:whole] for c in rows])
            held, size = [[c[whole:].copy() for c in rows]], size - whole
            enough = max(CHUNK, 2 * size)
    if size:
        yield from pairs([np.concatenate(c) for c in zip(*held, strict=True)])


def candidates(sets: DataFrame, similarity: float, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """Distinct (a, b), a < b, of written ``sets`` (node, root, grams) of two roots that pass prefix, length and position; every pair of at least the Jaccard ``similarity`` is among them."""
    with few_rows(sets.sparkSession):
        entries = scratch.save(_prefixes(sets, rarity(sets), similarity), "prefixes")
    shared = entries.groupBy("element").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("indexed").alias("some"))
    shared = scratch.save(shared.where("low <> high AND some = 1").select("element", "many"), "elements")
    blocks = F.ceil(F.col("many") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    block = F.when(F.col("many") > tile, own).otherwise(0)
    met = _met(entries, shared, tile).withColumn("block", block).withColumn("blocks", F.when(F.col("many") > tile, blocks).otherwise(1))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("*", other.alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = met.select("element", (F.shiftleft(low.cast("long"), 32) + high).alias("tile"), (F.col("block") == low).cast("long").alias("side"), "node", "root", "n", "place", "indexed", *_ODDS)
    dealt = met.repartition("element", "tile").sortWithinPartitions("element", "tile", "root")
    return dealt.mapInArrow(lambda batches: _meet(batches, similarity), "a long, b long").distinct()


def _met(entries: DataFrame, shared: DataFrame, tile: int) -> DataFrame:
    """``entries`` with the number of rows of their element, for the elements of ``shared``.

    Elements of very many rows are met by broadcast where their rows lie; the
    bound rises with the rows, so at most ``MAX_HOT`` elements are broadcast.
    """
    total = shared.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    return join_counted(entries, shared, ["element"], "many", max(tile, total // MAX_HOT))


def decided(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, jaccard) of the ``pairs`` whose ``sets`` (node, grams) have at least that Jaccard."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("_x") + F.size("_y") - both)).alias("jaccard"))
    return met.where(F.col("jaccard") >= similarity)
