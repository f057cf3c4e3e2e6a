"""Ranking documents for queries: BM25, sparse products, n-gram containment, exact vector search, evaluation of lists.

The queries are the small side.  They travel to the workers in blocks of bounded
size, the documents are read once for each block, and every task keeps a running
top k for each query, so what is shuffled does not depend on the rows read.
Postings hold only words that some query has; they are made in one pass over
the texts, written, and shared by all that scores them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..sources.scratch import Scratch
from .grams import grams, lists, word_hashes
from .skew import spread

K1, B = 1.2, 0.75
#: Query vectors, and queries of words, that are sent to the workers at a time.
QUERY_BLOCK, WORD_QUERIES = 4096, 512
#: Rows and queries that are multiplied at a time.
ROW_TILE, QUERY_TILE = 2048, 512
#: Numbers (postings by queries) that are multiplied at a time.
PRODUCTS = 4_000_000
#: Hashes of query grams that are sent to the workers at a time.
GRAM_BLOCK = 2_000_000
#: Words at the start of a passage that find its candidates.
GRAM = 8


def term_weights(queries: DataFrame, key: str, tokens: Column, weight: Callable[[Column], Column]) -> DataFrame:
    """(item, term, w): ``weight`` of how often each query has each of its terms."""
    words = queries.select(F.col(key).alias("item"), F.explode(tokens).alias("term"))
    return words.groupBy("item", "term").agg(weight(F.count("*")).alias("w"))


def _blocks(rows: Iterator, size: int, key: Callable) -> Iterator[list]:
    """Rows in the order of their key, cut into blocks of at most ``size`` keys."""
    block, seen, last = [], 0, None
    for row in rows:
        if not block or key(row) != last:
            if seen == size:
                yield block
                block, seen = [], 0
            seen, last = seen + 1, key(row)
        block.append(row)
    if block:
        yield block


class Vocabulary:
    """The terms of a block of queries and the weight of each in each query."""

    def __init__(self, rows: list):
        self.items = np.array(sorted({r["item"] for r in rows}))
        self.terms = sorted({r.term for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        self.weights = np.zeros((len(self.terms), len(self.items)))
        place = {item: i for i, item in enumerate(self.items.tolist())}
        for r in rows:
            self.weights[number[r.term], place[r["item"]]] = r.w


def postings(docs: DataFrame, key: str, tokens: Column, terms: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Written (doc_id, dl, ids, tfs): the length of each document, and the numbers and counts of its words that are ``terms``."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(sent.value, pa.string())
        for batch in batches:
            column = batch.column(1)
            n = np.zeros(len(column) + 1, np.int64)
            np.cumsum(np.asarray(column.value_lengths().fill_null(0)), out=n[1:])
            found = pc.index_in(column.flatten(), value_set=values).fill_null(-1).to_numpy()
            doc = np.repeat(np.arange(len(column)), np.diff(n))[found >= 0]
            pairs, tfs = np.unique(doc * len(values) + found[found >= 0], return_counts=True)
            of, ids = pairs // max(1, len(values)), pairs % max(1, len(values))
            offsets = pa.array(np.searchsorted(of, np.arange(len(column) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(n)), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int32)))],
                ["doc_id", "dl", "ids", "tfs"],
            )

    rows = spread(docs.where(F.col(key).isNotNull())).select(F.col(key).cast("long"), F.coalesce(tokens, F.array().cast("array<string>")))
    return scratch.save(rows.mapInArrow(run, "doc_id long, dl long, ids array<int>, tfs array<int>"), name)


def document_frequencies(post: DataFrame, terms: int) -> np.ndarray:
    """In how many documents of the postings each term stands; a task sends one number for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["id", "n"])

    out = np.zeros(terms, np.int64)
    for r in post.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def _keep_best(scores: np.ndarray, docs: np.ndarray, k: int, high_ids_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by falling score, then by id."""
    if scores.shape[1] > 4 * k:
        bar = np.partition(scores, -k, axis=1)[:, -k]
        some = (scores >= bar[:, None]).any(axis=0)
        scores, docs = scores[:, some], docs[:, some]
    best = np.lexsort((-docs if high_ids_first else docs, -scores))[:, :k]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(docs, best, 1)


class _Best:
    """The k best of each of ``n`` lists so far, by falling score, then by id; besides them only one tile of scores is held."""

    def __init__(self, n: int, k: int, high_ids_first: bool = False, kind: type = np.float64):
        self.sign = -1 if high_ids_first else 1
        self.scores, self.ids = np.full((n, k), -np.inf, kind), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """A tile: the scores of the lists from ``at`` on with the candidates ``ids``."""
        n, k = len(scores), self.scores.shape[1]
        best, kept, ids = self.scores[at : at + n], self.ids[at : at + n], self.sign * ids
        bar = best[:, -1:]
        hit = (scores > bar) | ((scores == bar) & (ids < kept[:, -1:]))
        if np.count_nonzero(hit) > 4 * k * n and scores.shape[1] > k:
            hit &= scores >= np.partition(scores, -k, axis=1)[:, -k, None]
        row, column = np.nonzero(hit)
        row = np.concatenate([row, np.repeat(np.arange(n), k)])
        held, names = np.concatenate([scores[hit], best.ravel()]), np.concatenate([ids[column], kept.ravel()])
        order = np.lexsort((names, -held, row))
        chosen = order[np.searchsorted(row[order], np.arange(n))[:, None] + np.arange(k)]
        self.scores[at : at + n], self.ids[at : at + n] = held[chosen], names[chosen]

    def found(self, seen: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, after ``seen`` candidates for each list."""
        some = min(seen, self.scores.shape[1])
        return self.scores[:, :some], self.sign * self.ids[:, :some]


def _tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(at, at + size) for at in range(0, n, size))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _top_products(post: DataFrame, vocabulary: Vocabulary, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], k: int) -> DataFrame:
    """(item, doc_id, score): for each task and query the k best documents that share a term, by sum of ``weigh(term, tf, dl)`` times query weight."""
    sent = post.sparkSession.sparkContext.broadcast((vocabulary.items, vocabulary.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        step = max(1, PRODUCTS // max(1, len(items)))
        scores, docs = np.full((len(items), 0), -np.inf), np.zeros((len(items), 0), np.int64)
        for batch in batches:
            ids, ends = lists(batch.column(2))
            tfs, _ = lists(batch.column(3))
            keys, lengths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held = np.flatnonzero(np.diff(ends))
            at = 0
            while at < len(held):
                stop = max(at + 1, int(np.searchsorted(ends[held + 1], ends[held[at]] + step, side="right")))
                some, low, high = held[at:stop], ends[held[at]], ends[held[stop - 1] + 1]
                at = stop
                each = weigh(ids[low:high], tfs[low:high], np.repeat(lengths[some], ends[some + 1] - ends[some]))
                shared = weights[ids[low:high]]
                starts = ends[some] - low
                made = np.add.reduceat(shared * each[:, None], starts, axis=0)
                hit = np.add.reduceat(shared != 0, starts, axis=0) > 0
                new = np.where(hit, np.round(made, 9), -np.inf).T
                scores = np.concatenate([scores, new], axis=1)
                docs = np.concatenate([docs, np.broadcast_to(keys[some], (len(items), len(some)))], axis=1)
                scores, docs = _keep_best(scores, docs, k)
        q, place = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(items[q].astype(np.int64)), pa.array(docs[q, place]), pa.array(scores[q, place])], ["item", "doc_id", "score"])

    return post.mapInArrow(run, "item long, doc_id long, score double")


def _merged(spark: SparkSession, parts: Iterator[DataFrame], scratch: Scratch, schema: str) -> DataFrame:
    """The rows of all parts, each written before the next is made, so that no plan grows with their number."""
    saved = [scratch.save(part, f"part{i}") for i, part in enumerate(parts)]
    if not saved:
        return spark.createDataFrame([], schema)
    return saved[0] if len(saved) == 1 else spark.read.schema(saved[0].schema).parquet(*(f"{scratch.root}/part{i}" for i in range(len(saved))))


def _positions(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= k)


def search_postings(spark: SparkSession, weighted: DataFrame, k: int, weigher: Callable[[DataFrame, int], Callable], postings_of: Callable[[list[str], Scratch, str], DataFrame]) -> DataFrame:
    """(item, doc_id, score, position): the k best documents of each query of ``weighted`` (item, term, w), by blocks of queries.

    ``postings_of`` gives the written postings of the terms of a block.
    """
    scratch = Scratch(spark, "search")
    weighted = scratch.save(weighted.where("item IS NOT NULL"), "queries")

    def parts() -> Iterator[DataFrame]:
        rows = weighted.orderBy("item").toLocalIterator(prefetchPartitions=True)
        for i, block in enumerate(_blocks(rows, WORD_QUERIES, lambda r: r["item"])):
            vocabulary = Vocabulary(block)
            post = postings_of(vocabulary.terms, scratch, f"postings{i}")
            yield _top_products(post, vocabulary, weigher(post, len(vocabulary.terms)), k)

    return _positions(_merged(spark, parts(), scratch, "item long, doc_id long, score double"), k)


def _word_search(docs: DataFrame, weighted: DataFrame, key: str, tokens: Column, k: int, weigher: Callable[[DataFrame, int], Callable]) -> DataFrame:
    return search_postings(docs.sparkSession, weighted, k, weigher, lambda terms, scratch, name: postings(docs, key, tokens, terms, scratch, name))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents of each query: (item, doc_id, score, position).  A query is a set of terms.

    Null texts are empty documents, which count for the mean length; rows
    without id take no part; documents without a term of a query are not ranked
    for it.
    """
    tokens = X.words(F.col(text))

    def weigher(post: DataFrame, terms: int):
        n, mean = post.agg(F.count("*"), F.avg("dl")).first()
        df = document_frequencies(post, terms)
        idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), mean or 1.0
        return lambda ids, tf, dl: idf[ids] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))

    return _word_search(docs.select(key, text), term_weights(queries, query_key, tokens, lambda n: F.lit(1.0)), key, tokens, k, weigher)


def append_by_words(base: DataFrame, docs: DataFrame, queries: DataFrame, k: int, scan_depth: int, excluded: DataFrame | None = None, key: str = "doc_id", text: str = "text", query_key: str = "item_id") -> DataFrame:
    """(query_id, doc_id, place): up to ``k`` documents to append to each list of ``base`` (query_id, doc_id), by BM25 of their words.

    Only the ``scan_depth`` best of a query are looked at, and of these those of a positive score, with an id from 0 on, not in
    its list and not ``excluded`` (doc_id).
    """
    best = bm25(docs, queries, key, text, query_key, scan_depth).where("score > 0 AND doc_id >= 0").withColumnRenamed("item", "query_id")
    free = best.join(base.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    free = free if excluded is None else free.join(excluded.select("doc_id").distinct(), "doc_id", "left_anti")
    order = W.partitionBy("query_id").orderBy("position")
    return free.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select("query_id", "doc_id", "place")


def sparse_products(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", k: int = 20) -> DataFrame:
    """The k documents of largest inner product of ln(1 + count) vectors with each query: (item, doc_id, score, position).

    Only terms of the queries are looked at; a document without any is not ranked.
    """
    tokens = X.words(F.col(text))
    return _word_search(docs.select(key, text), term_weights(queries, query_key, tokens, lambda n: F.log(1 + n)), key, tokens, k, lambda post, terms: lambda ids, tf, dl: np.log(1 + tf))


def containment(docs: DataFrame, queries: DataFrame, n: int = 8) -> DataFrame:
    """Documents that share n-word grams with a query: (item_id, doc_id, matched, cover).

    All grams of a document are in its own row, so the distinct ones that a
    query has are counted where the text is read, and nothing is shuffled.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "grams")
    hashed = lambda df, key: spread(df.select(key, "text")).select(F.col(key).cast("long"), word_hashes(X.words(F.col("text"))).alias("w")).where(F.col(key).isNotNull() & F.col("w").isNotNull())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = lists(batch.column(1))
            made = [np.unique(grams(words[s:e], n)).view(np.int64) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["item_id", "grams"])

    asked = scratch.save(hashed(queries, "item_id").mapInArrow(own, "item_id long, grams array<long>"), "queries")

    def search(block: list) -> DataFrame:
        items = np.array([r.item_id for r in block], np.int64)
        of = np.repeat(np.arange(len(block)), [len(r.grams) for r in block])
        held = np.array([g for r in block for g in r.grams], np.int64).view(np.uint64)
        order = np.argsort(held, kind="stable")
        sizes = np.array([len(r.grams) for r in block], np.int64)
        sent = spark.sparkContext.broadcast((items, sizes, held[order], of[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, sizes, held, of = sent.value
            for batch in batches:
                words, ends = lists(batch.column(1))
                keys, out = batch.column(0).to_numpy(), []
                for doc, s, e in zip(keys.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    mine = np.unique(grams(words[s:e], n))
                    low, high = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
                    met = np.flatnonzero(high > low)
                    if len(met):
                        hits = np.bincount(np.concatenate([of[low[i] : high[i]] for i in met]), minlength=len(items))
                        out.append((np.full(np.count_nonzero(hits), doc, np.int64), np.flatnonzero(hits), hits[hits > 0]))
                docs_, which, hits = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(items[which]), pa.array(docs_), pa.array(hits.astype(np.int64)), pa.array(sizes[which])], ["item_id", "doc_id", "matched", "grams"])

        return hashed(docs, "doc_id").mapInArrow(run, "item_id long, doc_id long, matched long, grams long")

    def parts() -> Iterator[DataFrame]:
        block, size = [], 0
        for row in asked.orderBy("item_id").toLocalIterator(prefetchPartitions=True):
            if block and size + len(row.grams) > GRAM_BLOCK:
                yield search(block)
                block, size = [], 0
            block.append(row)
            size += len(row.grams)
        if block:
            yield search(block)

    found = _merged(spark, parts(), scratch, "item_id long, doc_id long, matched long, grams long")
    return found.select("item_id", "doc_id", "matched", F.round(F.col("matched") / F.col("grams"), 6).alias("cover"))


def verbatim(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query_key: str = "item_id", text: str = "text", after: int = 40) -> DataFrame:
    """Queries whose words stand side by side in a document: (item_id, doc_id, at, after).

    Both sides are compared as lower-case words with single spaces.  A document
    holds a query of n words if it holds its first min(n, 8) words as a gram;
    grams of that length, one length after the other, are the candidates, and
    the text decides.  ``at`` is the place in the spaced words, ``after`` what
    follows there.  Queries without a word match nothing.
    """
    spaced = lambda c: F.trim(F.regexp_replace(F.lower(c), X.NO_WORD, " "))
    asked = queries.where(F.col(query_key).isNotNull()).select(F.col(query_key).cast("long").alias("item_id"), spaced(F.col(text)).alias("needle")).where("needle <> ''")
    asked = asked.withColumn("w", F.split("needle", " ")).withColumn("n", F.least(F.size("w"), F.lit(GRAM)))
    asked = asked.select("item_id", "needle", "n", F.xxhash64(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ")).alias("gram"))
    lengths = sorted(r.n for r in asked.select("n").distinct().collect())
    read = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), spaced(F.col(text)).alias("t")).withColumn("w", F.split("t", " "))
    starts = lambda n: F.when(F.size("w") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "))))).otherwise(F.array().cast("array<long>"))
    found = None
    for n in lengths:
        some = asked.where(F.col("n") == n).drop("n")
        met = read.select("doc_id", "t", F.explode(starts(n)).alias("gram")).join(some, "gram")
        found = met if found is None else found.unionByName(met)
    schema = "item_id long, doc_id long, at long, after string"
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    at = F.expr("position(concat(' ', needle, ' '), concat(' ', t, ' '))").cast("long")
    placed = found.withColumn("at", at).where("at > 0")
    return placed.select("item_id", "doc_id", "at", F.expr(f"substr(t, at + length(needle) + 1, {after})").alias("after"))


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of doubles; rows without id and vectors that are null, zero, or hold null or non-finite components are left out."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def _vector_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and vectors in blocks; vectors of one length are in one block."""
    rows = queries.orderBy(F.size("v"), "id", "v").toLocalIterator(prefetchPartitions=True)
    block: list = []
    for row in rows:
        if block and (len(block) == QUERY_BLOCK or len(row.v) != len(block[0].v)):
            yield np.array([r.id for r in block], np.int64), np.array([r.v for r in block])
            block = []
        block.append(row)
    if block:
        yield np.array([r.id for r in block], np.int64), np.array([r.v for r in block])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dense_topk(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", high_ids_first: bool = False, cosine: bool = True) -> DataFrame:
    """Exact top k by cosine or inner product: (query_id, doc_id, score, position).

    A query is compared with the vectors of its own length.  What ``vectors``
    leaves out takes no part on either side.
    """
    spark, scratch, all_ = rows.sparkSession, Scratch(rows.sparkSession, "dense"), vectors(rows, key, vector)

    def search(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, _unit(q) if cosine else q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best, seen = _Best(len(ids), k, high_ids_first), 0
            for batch in batches:
                for rows_ in _tiles(batch.num_rows, ROW_TILE):
                    x, docs = _matrix(batch.column(1)[rows_]), batch.column(0)[rows_].to_numpy()
                    x, seen = _unit(x) if cosine else x, seen + len(x)
                    for some in _tiles(len(ids), QUERY_TILE):
                        best.add(some.start, np.round(q[some] @ x.T, 9), docs)
            scores, docs = best.found(seen)
            n = scores.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(docs.ravel()), pa.array(scores.ravel())], ["query_id", "doc_id", "score"])

        return all_.where(F.size("v") == q.shape[1]).mapInArrow(run, "query_id long, doc_id long, score double")

    out = _merged(spark, (search(ids, q) for ids, q in _vector_blocks(vectors(queries, key, vector))), scratch, "query_id long, doc_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id") if high_ids_first else F.asc("doc_id"))
    return out.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= k)


def best_queries(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row the k queries of largest cosine: (doc_id, query_id, score, position), ties to the smaller query.

    The rows stay where they are: each is compared with a block of queries, and
    its best of that block are kept.
    """
    spark, scratch, all_ = rows.sparkSession, Scratch(rows.sparkSession, "reverse"), vectors(rows, key, vector)

    def search(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, _unit(q)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                for rows_ in _tiles(batch.num_rows, ROW_TILE):
                    x, docs = _unit(_matrix(batch.column(1)[rows_])), batch.column(0)[rows_].to_numpy()
                    best = _Best(len(x), k)
                    for some in _tiles(len(ids), QUERY_TILE):
                        best.add(0, np.round(x @ q[some].T, 9), ids[some])
                    scores, found = best.found(len(ids))
                    n = scores.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(docs, n)), pa.array(found.ravel()), pa.array(scores.ravel())], ["doc_id", "query_id", "score"])

        return all_.where(F.size("v") == q.shape[1]).mapInArrow(run, "doc_id long, query_id long, score double")

    out = _merged(spark, (search(ids, q) for ids, q in _vector_blocks(vectors(queries, key, vector))), scratch, "doc_id long, query_id long, score double")
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "query_id")
    return out.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= k)


def recall_at(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Share of queries with a hit among the first k, for each k."""
    hits = ranked.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("position").alias("first"))
    total = gold.select("query_id").distinct().agg(F.count("*").alias("n"))
    found = hits.agg(*[F.count_if(F.col("first") <= k).alias(f"h{k}") for k in ks]).crossJoin(total)
    return found.select(*[F.round(F.col(f"h{k}") / F.col("n"), 6).alias(f"recall_{k}") for k in ks])


def quantised_topk(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", shortlist: int = 8) -> DataFrame:
    """Top k by cosine over vectors of one byte a dimension, ``shortlist`` times k of them compared exactly: (query_id, doc_id, score, position).

    The scale of a dimension comes from its extremes over all rows.  Queries and
    rows are of one length; the codes are written and read once for each block
    of queries.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "codes")
    all_ = scratch.save(vectors(rows, key, vector).withColumn("v", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)))), "rows")

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                low, high = (x.min(0), x.max(0)) if low is None else (np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
        n = 0 if low is None else len(low)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(low if n else [], pa.float64()), pa.array(high if n else [], pa.float64())], ["i", "low", "high"])

    ends = all_.select("v").mapInArrow(extremes, "i long, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    if not ends:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, position long")
    low, step = np.array([r.low for r in ends]), np.array([max(r.high - r.low, 1e-12) / 255 for r in ends])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            codes = np.clip(np.round((x - low) / step), 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    coded = scratch.save(all_.mapInArrow(code, "id long, code binary"), "codes")

    def search(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        q = _unit(q)
        sent = spark.sparkContext.broadcast((ids, (q * step).astype(np.float32), (q @ low).astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, scaled, base = sent.value
            best, seen = _Best(len(ids), k * shortlist, kind=np.float32), 0
            for batch in batches:
                for rows_ in _tiles(batch.num_rows, ROW_TILE):
                    codes = np.frombuffer(b"".join(batch.column(1)[rows_].to_pylist()), np.uint8).reshape(-1, scaled.shape[1])
                    x, docs, seen = codes.T.astype(np.float32), batch.column(0)[rows_].to_numpy(), seen + len(codes)
                    for some in _tiles(len(ids), QUERY_TILE):
                        best.add(some.start, scaled[some] @ x + base[some, None], docs)
            scores, docs = best.found(seen)
            n = scores.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(docs.ravel()), pa.array(scores.ravel().astype(np.float64))], ["query_id", "doc_id", "score"])

        return coded.mapInArrow(run, "query_id long, doc_id long, score double")

    asked = vectors(queries, key, vector)
    found = _merged(spark, (search(ids, q) for ids, q in _vector_blocks(asked)), scratch, "query_id long, doc_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    short = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k * shortlist).select("query_id", "doc_id")
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)))
    exact = F.round(F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 9)
    met = short.join(all_.withColumnRenamed("id", "doc_id"), "doc_id").join(asked.select(F.col("id").alias("query_id"), unit("v").alias("q")), "query_id")
    return met.select("query_id", "doc_id", exact.alias("score")).withColumn("position", F.row_number().over(best).cast("long")).where(F.col("position") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int, codes: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top k by cosine: over all vectors, or with ``codes`` by one byte a dimension and an exact look at a short list.  The caller chooses; no size does."""
    return quantised_topk(rows, queries, k, key, vector) if codes else dense_topk(rows, queries, k, key, vector)


def memory_plan(rows: DataFrame, budget: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: vectors, the bytes that they take as floats and as codes, and which of both fits ``budget`` bytes (flat, codes or none)."""
    size = vectors(rows, key, vector).agg(F.count("*").alias("vectors"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0).cast("long")).alias("code_bytes"))
    flat = F.col("code_bytes") * 4
    return size.select("vectors", flat.alias("float_bytes"), "code_bytes", F.when(flat <= budget, "flat").when(F.col("code_bytes") <= budget, "codes").otherwise("none").alias("fits"))
