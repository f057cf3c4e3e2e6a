"""Stored postings: texts are cut into words once, and an index is reused, extended and merged.

An index is a folder of segments.  A segment holds the words of some source
files as postings (term, doc_id, row, tf, dl) in ``BUCKETS`` folders by the hash of the term, sorted by term, so a
search reads the buckets of its terms only.  Words are counted where their text lies, so each posting is
shuffled once.  The
catalogue says for each source file its length, time of change and segment.
``refresh`` compares it with the files that are there: files that agree are not
read again; new ones become a segment of their own; where a file has changed or
gone, the files of its segment are indexed anew.  ``merge`` turns all segments into one without reading a text.

A catalogue is a numbered table; the largest number whose write was completed counts,
and it is written after its segments, so a run that fails leaves the old index in
force.  Two runs that refresh one index at a time are not supported.

Defined results: rows without id take no part; null texts are empty documents,
which count for the mean length; equal ids are separate documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import few_rows
from . import retrieval
from .skew import spread

BUCKETS, MAX_SEGMENTS = 32, 8
#: Texts whose words are counted at a time.
TEXTS = 256
_CATALOGUE = "file string, length long, changed timestamp, segment string, docs long, words long"
_POSTINGS = "term string, doc_id long, row long, tf long, dl long, bucket int"


def _counted(docs: DataFrame) -> DataFrame:
    """(term, doc_id, row, dl, tf) of the words ``w`` of each row, counted where it lies, and for each row one without term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, dl = batch.column(2), batch.column(2).value_lengths().to_numpy().astype(np.int64)
            held = words.flatten()
            of = np.repeat(np.arange(batch.num_rows), dl)[held.is_valid().to_numpy(zero_copy_only=False)]
            coded = held.drop_null().dictionary_encode()
            many = max(1, len(coded.dictionary))
            found, tf = np.unique(of * many + coded.indices.to_numpy(), return_counts=True)
            row, every = np.concatenate([found // many, np.arange(batch.num_rows)]), batch.num_rows
            terms = pa.concat_arrays([coded.dictionary.take(pa.array(found % many)), pa.nulls(every, coded.dictionary.type)])
            tf = np.concatenate([tf.astype(np.int64), np.zeros(every, np.int64)])
            yield pa.RecordBatch.from_arrays([terms, *(batch.column(k).take(pa.array(row)) for k in range(2)), pa.array(dl[row]), pa.array(tf)], ["term", "doc_id", "row", "dl", "tf"])

    return docs.select("doc_id", "row", "w").mapInArrow(run, "term string, doc_id long, row long, dl long, tf long")


class TextIndex:
    """The stored postings of ``source`` (a folder of Parquet files) under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, source: str, key: str = "doc_id", text: str = "text", tokens=X.words):
        self.spark, self.root, self.source, self.key, self.text, self.tokens = spark, root.rstrip("/"), source, key, text, tokens

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/catalogue")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def catalogue(self) -> DataFrame:
        """(file, length, changed, segment, docs, words) of the index as it stands."""
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], _CATALOGUE)
        return self.spark.read.schema(_CATALOGUE).parquet(f"{self.root}/catalogue/{found[-1]}")

    def files(self) -> DataFrame:
        """(file, length, changed) of the source; contents are not read."""
        there = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.source)
        return there.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("changed"))

    def refresh(self) -> dict[str, int]:
        """Brings the index up to date; says how many files were reused, read, and gone."""
        old = self.catalogue()
        met = self.files().select("file", F.struct("length", "changed").alias("_now")).join(old.select("file", F.struct("length", "changed").alias("_then"), "segment"), "file", "full")
        rows = met.select("file", "segment", (F.col("_now") == F.col("_then")).alias("same"), F.col("_now").isNull().alias("gone")).collect()  # one row for each source file
        stale = {r.segment for r in rows if r.segment is not None and not r.same}
        keep = [r.file for r in rows if r.segment is not None and r.segment not in stale]
        read = [r.file for r in rows if not r.gone and (r.segment is None or r.segment in stale)]
        if read or stale:
            made = [self._write_segment(sorted(read))] if read else []
            kept = old.where(F.col("segment").isin(*{r.segment for r in rows if r.segment is not None} - stale))
            self._commit(kept, made)
        return {"reused": len(keep), "read": len(read), "gone": sum(r.gone for r in rows)}

    def _write_segment(self, files: list[str]) -> DataFrame:
        segment = uuid.uuid4().hex
        docs = spread(self.spark.read.parquet(*files).select(F.col(self.key).cast("long").alias("doc_id"), F.col(self.text).alias("_text")).where("doc_id IS NOT NULL"))
        words = F.coalesce(self.tokens(F.col("_text")), F.array().cast("array<string>"))
        with few_rows(self.spark, TEXTS):
            self._write_postings(_counted(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("w"))), segment)
        n, total = self._rows([segment]).where("term IS NULL").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        first = F.col("file") == files[0]  # the totals of a segment stand beside its first file
        numbers = [F.when(first, F.lit(x)).otherwise(0).cast("long").alias(c) for c, x in (("docs", n), ("words", total))]
        return self.files().where(F.col("file").isin(*files)).select("file", "length", "changed", F.lit(segment).alias("segment"), *numbers)

    def _write_postings(self, counted: DataFrame, segment: str) -> None:
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        rows = counted.select("term", "doc_id", "row", "tf", "dl").withColumn("bucket", bucket)
        part = F.pmod(F.xxhash64("row"), F.lit(8))  # a bucket of common words is cut over several files
        self._write_sorted(rows.repartition("bucket", part), segment)

    def _write_sorted(self, rows: DataFrame, segment: str) -> None:
        rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/postings/segment={segment}")

    def _commit(self, kept: DataFrame, made: list[DataFrame]) -> None:
        out = kept
        for df in made:
            out = out.unionByName(df)
        found = self._versions()
        out.coalesce(1).write.parquet(f"{self.root}/catalogue/{(found[-1] if found else 0) + 1}")

    def merge(self, at_most: int = MAX_SEGMENTS) -> bool:
        """If there are more than ``at_most`` segments, their postings become one; texts are not read, and nothing is shuffled, for all are cut by the same buckets."""
        old = self.catalogue()
        names = [r.segment for r in old.select("segment").distinct().collect()]
        if len(names) <= at_most:
            return False
        segment = uuid.uuid4().hex
        self._write_sorted(self._rows(names).select("term", "doc_id", F.xxhash64("row", "segment").alias("row"), "tf", "dl", "bucket"), segment)
        self._commit(old.withColumn("segment", F.lit(segment)), [])
        return True

    def _rows(self, segments: list[str]) -> DataFrame:
        """The postings of segments; a row without term stands for each document."""
        parts = [self.spark.read.schema(_POSTINGS).parquet(f"{self.root}/postings/segment={s}").withColumn("segment", F.lit(s)) for s in segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, doc_id, row, tf, dl, segment); with ``terms`` only theirs, from their buckets."""
        segments = sorted(r.segment for r in self.catalogue().select("segment").distinct().collect())
        if not segments:
            return self.spark.createDataFrame([], _POSTINGS).drop("bucket").withColumn("segment", F.lit(""))
        rows = self._rows(segments).where("term IS NOT NULL")
        if terms is not None:
            asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
            buckets = [r.b for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(*buckets)).join(F.broadcast(asked), "term", "left_semi")
        return rows.drop("bucket")

    def totals(self) -> tuple[int, float]:
        """Documents, and their mean number of words."""
        n, words = self.catalogue().agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        return n, words / n if n else 0.0

    def bm25(self, queries: DataFrame, query_key: str = "item_id", k: int = 10, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
        """As ``retrieval.bm25``, from the stored postings: (item, doc_id, score, position)."""
        n, mean = self.totals()

        def weigher(post: DataFrame, terms: int):
            df = retrieval.document_frequencies(post, terms)
            idf, average = np.log(1 + (n - df + 0.5) / (df + 0.5)), mean or 1.0
            return lambda ids, tf, dl: idf[ids] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))

        return self._search(retrieval.term_weights(queries, query_key, self.tokens(F.col("text")), lambda n: F.lit(1.0)), k, weigher)

    def sparse_products(self, queries: DataFrame, query_key: str = "item_id", k: int = 20) -> DataFrame:
        """As ``retrieval.sparse_products``, from the stored postings."""
        weighted = retrieval.term_weights(queries, query_key, self.tokens(F.col("text")), lambda n: F.log(1 + n))
        return self._search(weighted, k, lambda post, terms: lambda ids, tf, dl: np.log(1 + tf))

    def _search(self, weighted: DataFrame, k: int, weigher) -> DataFrame:
        return retrieval.search_postings(self.spark, weighted, k, weigher, lambda terms, scratch, name: scratch.save(self._by_document(terms), name))

    def _by_document(self, terms: list[str]) -> DataFrame:
        """(doc_id, dl, ids, tfs) of the documents with some of the terms, as ``retrieval.postings`` makes from texts."""
        number = self.spark.createDataFrame(list(enumerate(terms)), "id int, term string")
        rows = self.postings(terms).join(F.broadcast(number), "term")  # the terms of one block of queries
        pairs = F.array_sort(F.collect_list(F.struct("id", F.col("tf").cast("int").alias("tf"))))
        dealt = rows.select("doc_id", F.col("row"), F.xxhash64("segment").alias("segment"), "dl", "id", "tf").repartition("segment", "row")  # else lists are begun, sorted and spilled before the shuffle too
        return dealt.groupBy("segment", "row").agg(F.max("doc_id").alias("doc_id"), F.max("dl").alias("dl"), pairs.alias("p")).select("doc_id", "dl", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"))

