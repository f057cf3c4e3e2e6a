"""Tables sorted by a key, and the rows of many asked key ranges from only the files that hold them.

A sorted table is dealt by ranges of its key and sorted, so every file holds one
stretch of keys.  Its manifest says the first and last key of each file.  A lookup
finds the files of each asked range by two binary searches in the manifest, opens
only those, and keeps the rows of the ranges.

What reaches the driver is the manifest, one row for each file, as Spark's own file index does; asked ranges
and rows do not.

Defined results: ranges are inclusive at both ends; those that are null at an end or end before
they start hold nothing; overlapping and repeated ranges give a row once; rows of null key are in no range; repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .scratch import Scratch


def _manifest_path(path: str) -> str:
    return path.rstrip("/") + ".manifest"


def write_sorted(df: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """``df`` dealt by ranges of ``key`` into about ``files`` files, each sorted; the manifest is written last."""
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.parquet(path)
    write_manifest(df.sparkSession, path, key)


def write_manifest(spark: SparkSession, path: str, key: str) -> None:
    """(file, first, last, rows) of each file of a table that is there already; only the key is read."""
    name = F.col("_metadata.file_path").alias("file")
    rows = spark.read.parquet(path).groupBy(name).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))
    rows.coalesce(1).write.mode("overwrite").parquet(_manifest_path(path))


def manifest(spark: SparkSession, path: str) -> list:
    """The manifest in the order of keys; an error if two files overlap by more than a shared end, for then no search can tell where a key lies."""
    rows = spark.read.parquet(_manifest_path(path)).where("first IS NOT NULL").orderBy("first", "last", "file").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        if a["last"] > b["first"]:
            raise ValueError(f"files are not sorted by key: {a['file']} and {b['file']} overlap")
    return rows


def files_of_ranges(spark: SparkSession, files: list, ranges: DataFrame) -> DataFrame:
    """(number, lo, hi): for each range (lo, hi) the files, by their place in the manifest, that may hold some of it."""
    kind = ranges.schema["lo"].dataType
    sent = spark.sparkContext.broadcast(([r["first"] for r in files], [r["last"] for r in files]))
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("lo", kind), T.StructField("hi", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed = np.array(sent.value[0]).dtype
        typed = typed if typed.kind in "if" else np.dtype(object)
        first, last = (np.array(side, dtype=typed) for side in sent.value)
        for batch in batches:
            lo, hi = (np.array(batch.column(k).to_pylist(), dtype=typed) for k in range(2))
            begin, end = np.searchsorted(last, lo, "left"), np.searchsorted(first, hi, "right")
            many = np.maximum(end - begin, 0)
            of = np.repeat(np.arange(len(lo)), many)
            number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + begin[of]
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of))], schema.names)

    return ranges.where("lo <= hi").select("lo", "hi").mapInArrow(run, schema)


def lookup(spark: SparkSession, path: str, ranges: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """The rows of a sorted table whose key lies in one of the ``ranges`` (lo, hi, of the key's type).

    Within a file overlapping ranges are merged, and a row looks at the last
    range that starts at or before it; a file's rows and ranges are one group, which is as large as a file.
    """
    files = manifest(spark, path)
    met = scratch.save(files_of_ranges(spark, files, ranges).distinct(), "met")
    opened = sorted(r["number"] for r in met.select("number").distinct().collect())
    table = spark.read.parquet(path)
    if not opened:
        return table.limit(0)
    names = spark.createDataFrame([(files[k]["file"], k) for k in opened], "_file string, _number long")
    by_start = W.partitionBy("number").orderBy("lo", "hi")
    before = F.max("hi").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    starts = F.count_if(F.col("_before").isNull() | (F.col("_before") < F.col("lo"))).over(by_start.rowsBetween(W.unboundedPreceding, 0))
    merged = met.withColumn("_before", before).withColumn("_group", starts)
    merged = merged.groupBy("number", "_group").agg(F.min("lo").alias("_key"), F.max("hi").alias("_hi"))
    rows = spark.read.schema(table.schema).parquet(*(files[k]["file"] for k in opened)).where(F.col(key).isNotNull())
    rows = rows.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col("_metadata.file_path").alias("_file")).join(F.broadcast(names), "_file")
    none = F.lit(None).cast(T.StructType(table.schema.fields))
    events = rows.select(F.col("_number").alias("number"), "_key", F.lit(1).alias("_kind"), F.lit(None).cast(table.schema[key].dataType).alias("_hi"), "_row")
    events = events.unionByName(merged.select("number", "_key", F.lit(0).alias("_kind"), "_hi", none.alias("_row")))
    reached = F.last("_hi", ignorenulls=True).over(W.partitionBy("number").orderBy("_key", "_kind").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("_reached", reached).where("_kind = 1 AND _key <= _reached").select("_row.*")
