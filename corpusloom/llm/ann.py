"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids split the space into cells; what a vector differs from its
centroid by (the residual) is cut into sub-vectors, each coded by its nearest
codeword.  A query visits its nearest cells and estimates distances there from
a table of its own residual against the codewords (asymmetric: the query is not
coded).  The estimates of all its cells make one short list for each query, and
only that list is compared with the original vectors, in double precision.

How many cells a query visits and how long its short list is are measured on
the fit sample: as many cells as hold ``CELL_RECALL`` of the sample's own
neighbours, and twice the place at which 99 % of them stand by estimate.  Data
with clusters get few cells; data without any, as in the tests' tables, need
half of them, and then the work grows as queries times rows, on codes of
``SUB_VECTORS`` bytes.

Equal vectors are indexed once, with the smallest ids that a result of k can
show; so a vector with many copies costs no more than another.  Cells are
dealt to parts, parts are cut into blocks of bounded size, and a block meets
the queries of its part in chunks of bounded size, so no task holds more than
one block and one chunk, however full a cell is; blocks are cut, not capped:
every vector is indexed.

Centroids and codewords are fitted on at most ``SAMPLE`` vectors, chosen by a
hash of the values; all vectors are indexed.  Codebooks are fitted in parallel,
one task for each sub-vector.  Recall against brute force is measured in the
tests.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; a query finds all candidates
if they are fewer than k, for it visits cells until they hold k + 1 distinct
vectors; ties go to the smaller id; repeated rows of an id count as one
candidate for each different vector; a null id takes no part; other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import Scratch

SAMPLE = 16_384
#: Cells: the square root of the number of distinct vectors, up to MAX_CELLS.
MAX_CELLS = 1024
#: Share of the sample's true neighbours that the visited cells must hold, and the cells visited at least.
CELL_RECALL, LEAST_PROBES = 0.96, 8
SUB_VECTORS, CODEWORDS = 32, 256
#: The short list is never shorter than so many times k.
LEAST_LIST = 4
#: Vectors of the sample whose neighbours the calibration looks for.
ASKED = 256
BLOCK, CHUNK = 16_384, 1024
#: Parts that the cells are dealt to.
PARTS = 32
K, EVERY = 10, 100


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; an empty centre moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = distances(x, centres)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if len(empty := np.flatnonzero(n == 0)):
            far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
            centres[empty] = x[far[: len(empty)]]
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray
    codebooks: np.ndarray  # sub-vector, codeword, dimension

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into sub-vectors, the last one filled with zeros."""
        padded = np.zeros((len(x), self.codebooks.shape[0] * self.codebooks.shape[2]))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), self.codebooks.shape[0], -1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = distances(x, self.centres).argmin(axis=1)
        parts = self.split(x - self.centres[cells])
        codes = np.stack([distances(parts[:, m], book).argmin(axis=1) for m, book in enumerate(self.codebooks)], axis=1)
        return cells, codes.astype(np.uint8)

    def estimate(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of each query to each coded vector of a cell."""
        parts = self.split(queries - self.centres[cell])
        out = np.zeros((len(queries), len(codes)), np.float32)
        for m, book in enumerate(self.codebooks):
            out += distances(parts[:, m], book).astype(np.float32)[:, codes[:, m]]
        return out

    def estimate_all(self, queries: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """``estimate`` against coded vectors of any cells."""
        out = np.full((len(queries), len(codes)), np.inf, np.float32)
        for c in np.unique(cells):
            own = np.flatnonzero(cells == c)
            out[:, own] = self.estimate(queries, int(c), codes[own])
        return out


def fit(spark: SparkSession, x: np.ndarray, cells: int) -> Quantiser:
    """Centroids on the driver, from a sample of bounded size; codebooks in tasks, one for each sub-vector."""
    width = x.shape[1]
    centres = kmeans(x, cells)
    residual = x - centres[distances(x, centres).argmin(axis=1)]
    m = min(SUB_VECTORS, width)
    step = -(-width // m)
    m = -(-width // step)
    parts = np.zeros((len(x), m * step))
    parts[:, :width] = residual
    sent = spark.sparkContext.broadcast(parts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            books = [kmeans(sent.value[:, i * step : (i + 1) * step], CODEWORDS, seed=i).tobytes() for i in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(books, pa.binary())], ["id", "book"])

    rows = sorted(spark.range(0, m, 1, m).mapInArrow(learn, "id long, book binary").collect())
    return Quantiser(centres, np.stack([np.frombuffer(r.book).reshape(-1, step) for r in rows]))


def calibrate(quantiser: Quantiser, x: np.ndarray, k: int) -> tuple[int, int]:
    """(cells to visit, length of the short list) by which the sample's own neighbours are found."""
    k = min(k, len(x) - 1)
    if k < 1:
        return 1, LEAST_LIST
    at = np.arange(0, len(x), max(1, len(x) // ASKED))[:ASKED]
    exact = distances(x[at], x)
    exact[np.arange(len(at)), at] = np.inf
    near = np.argpartition(exact, k - 1, axis=1)[:, :k]
    cells, codes = quantiser.encode(x)
    visits = np.argsort(np.argsort(distances(x[at], quantiser.centres), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(visits, cells[near], 1) + 1
    estimates = quantiser.estimate_all(x[at], cells, codes)
    wanted = np.take_along_axis(estimates, near, 1)
    places = np.stack([np.searchsorted(row, own) for row, own in zip(np.sort(estimates, axis=1), wanted, strict=True)])
    return int(np.ceil(np.quantile(needed, CELL_RECALL))), max(LEAST_LIST * k, 2 * int(np.ceil(np.quantile(places, 0.99))))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with v of doubles, of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K, probe_share: float | None = None, shortlist: int | None = None) -> DataFrame:
    """For each row whose id is divisible by ``every``: its k nearest other rows as (query_id, rank, vec_id, score).

    ``probe_share`` (of the cells) and ``shortlist`` (vectors reranked for a query) are measured on the sample if not given.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.save(usable(df, key, vector).dropDuplicates(["id", "v"]), "rows")
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = lengths[0].n
    # the smallest ids of each distinct vector: k and one more, for the query itself may be among them
    first = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = rows.where(F.size("v") == width).withColumn("n", first).where(F.col("n") <= k + 1)
    grouped = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # the smallest id and a hash name a distinct vector where the vector itself need not go
    distinct = scratch.save(grouped.select(F.element_at("ids", 1).alias("first"), F.xxhash64("v").alias("h"), "v", "ids"), "distinct")
    n = distinct.count()
    small = F.col("h").cast("double") / 2.0**64 + 0.5 <= min(1.0, (2.0 * SAMPLE + 1000) / n)
    picked = distinct.where(small).orderBy("h", "v").limit(SAMPLE).select("v").toArrow()
    sample = _vectors(picked.column("v").combine_chunks(), width)
    quantiser = fit(spark, sample, max(1, min(MAX_CELLS, int(n**0.5), len(sample))))
    probes, listed = calibrate(quantiser, sample, k)
    probes = max(probes if probe_share is None else round(len(quantiser.centres) * probe_share), min(LEAST_PROBES, len(quantiser.centres)))
    listed = shortlist or listed
    sent = spark.sparkContext.broadcast(quantiser)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, codes = sent.value.encode(_vectors(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["first", "h", "cell", "code"])

    coded = scratch.save(distinct.select("first", "h", "v").mapInArrow(index, "first long, h long, cell int, code binary"), "index")
    held = np.zeros(len(quantiser.centres), np.int64)
    for r in coded.groupBy("cell").count().collect():
        held[r.cell] = r["count"]
    parted = coded.withColumn("part", F.col("cell") % PARTS)
    sizes = parted.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"))
    asked = rows.where((F.size("v") == width) & (F.col("id") % every == 0)).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("qh"), "v")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and part of the cells, with the cells that the query visits there."""
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(distances(_vectors(batch.column(2), width), sent.value.centres), axis=1, kind="stable")
            # further cells until k vectors besides the query's own are in them
            enough = (np.cumsum(held[near], axis=1) <= k).sum(axis=1) + 1
            near = [own[: max(probes, n)] for own, n in zip(near, enough.tolist(), strict=True)]
            at, part, cells = [], [], []
            for i, own in enumerate(near):
                for p in np.unique(own % PARTS).tolist():
                    at.append(i)
                    part.append(p)
                    cells.append(own[own % PARTS == p].astype(np.int32).tolist())
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "qh", "v", "part", "cells"])

    routed = scratch.save(asked.mapInArrow(route, "query_id long, qh long, v array<double>, part int, cells array<int>"), "routed")
    chunk_count = routed.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK)).cast("int").alias("chunks"))
    q = (
        routed.join(F.broadcast(sizes.join(chunk_count, "part")), "part")
        .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "block", "chunk", "query_id", "qh", "v", "cells")
    )
    d = (
        parted.join(F.broadcast(sizes), "part")
        .withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
        .join(F.broadcast(chunk_count), "part")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("part", "block", "chunk", "cell", "first", "h", "code")
    )

    def scan(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The best of one block for one chunk of queries, by estimate alone."""
        out = {"query_id": [], "qh": [], "first": [], "h": [], "estimate": []}
        if len(asked) and len(held):
            q = np.stack(asked["v"].to_numpy())
            codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
            cell, smallest, hashes = (held[c].to_numpy() for c in ("cell", "first", "h"))
            members = {int(c): np.flatnonzero(cell == c) for c in np.unique(cell)}
            visits = [set(c.tolist()) for c in asked["cells"]]
            for at in range(0, len(q), 64):
                some = range(at, min(len(q), at + 64))
                est = np.full((len(some), len(held)), np.inf, np.float32)
                for c, own in members.items():
                    here = [i - at for i in some if c in visits[i]]
                    if here:
                        est[np.ix_(here, own)] = sent.value.estimate(q[[at + i for i in here]], c, codes[own])
                for i, row in zip(some, est, strict=True):
                    best = np.flatnonzero(np.isfinite(row))
                    if len(best) > listed + 1:
                        worst = np.partition(row[best], listed)[listed]
                        best = best[row[best] <= worst]
                        best = best[np.lexsort((hashes[best], smallest[best], row[best]))[: listed + 1]]
                    out["query_id"].append(np.full(len(best), asked["query_id"].iloc[i], np.int64))
                    out["qh"].append(np.full(len(best), asked["qh"].iloc[i], np.int64))
                    out["first"].append(smallest[best])
                    out["h"].append(hashes[best])
                    out["estimate"].append(row[best])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    keys = ["part", "block", "chunk"]
    found = q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(scan, "query_id long, qh long, first long, h long, estimate float")
    # one list over all cells of a query; one vector more than asked for, since the query's own may be among them
    by_estimate = W.partitionBy("query_id", "qh").orderBy("estimate", "first", "h")
    short = found.withColumn("n", F.row_number().over(by_estimate)).where(F.col("n") <= listed + 1).select("query_id", "qh", "first", "h")
    short = scratch.save(short, "short")
    distance = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x))
    pairs = short.join(distinct, ["first", "h"]).join(asked.withColumnRenamed("v", "q"), ["query_id", "qh"])
    ids = pairs.select("query_id", distance.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ids = ids.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    final = W.partitionBy("query_id").orderBy("score", "vec_id")
    return ids.withColumn("rank", F.row_number().over(final).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, every: int = EVERY, k: int = K) -> dict[int, list[tuple[int, float]]]:
    """The exact answer for vectors in memory, for measuring recall."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[int(ids[i])] = heapq.nsmallest(k, ((float(s), int(j)) for s, j in zip(d, ids, strict=True) if j != ids[i]))
    return {q: [(j, s) for s, j in best] for q, best in out.items()}
