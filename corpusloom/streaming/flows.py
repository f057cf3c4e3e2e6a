"""Structured Streaming forms of the incremental behaviours.

Each flow takes the folder of its checkpoint and the folder of its output from
the caller and drains what is there (``availableNow``).  Started again with the
same folders it takes up only what is new: the checkpoint remembers the files
read and the state, and everything written carries the number of its batch, so
a batch that is replayed after a crash overwrites its own output.  Nothing is
kept in the driver between batches; the current version of a table is found in
storage.

Output folders hold ``batch=<n>`` (append and update: all of them are the
result) or ``version=<n>`` (complete and upsert: the last one is).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 8, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files of a folder that match a name pattern, as a stream; times become timestamps with zone."""
    schema = schema or spark.read.parquet(f"{folder}/{pattern}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The numbers of the parts ``<kind>=<n>`` that are whole in storage, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))


def _forget(spark: SparkSession, folder: str, kind: str, before: int) -> None:
    jvm = spark.sparkContext._jvm
    for n in numbers(spark, folder, kind):
        if n < before:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}={n}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _run(rows: DataFrame, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def drain(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream until nothing is left; the result is the written table (in complete mode its last version)."""
    spark, kind = rows.sparkSession, "version" if mode == "complete" else "batch"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{kind}={number}")
        if kind == "version":
            _forget(spark, out, kind, number)

    _run(rows, checkpoint, mode, write)
    return written(spark, out, kind, rows.schema)


def written(spark: SparkSession, out: str, kind: str, schema: T.StructType) -> DataFrame:
    """All batches of an output folder, or its last version."""
    found = numbers(spark, out, kind)
    found = found[-1:] if kind == "version" else found
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{out}/{kind}={n}" for n in found))


def window_counts(events: DataFrame, size: str, late: str) -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


def exact_once(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upsert(rows: DataFrame, out: str, checkpoint: str, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key; a row that arrives late does not replace a newer one.

    Batch n makes version n from the last version before it that is whole in
    storage, and the ones before that go.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = [n for n in numbers(spark, out, "version") if n < number][-1:]
        held = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{out}/version={before[0]}")) if before else batch
        newest = held.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(time, tie)).alias("v")).select("v.*")
        newest.write.mode("overwrite").parquet(f"{out}/version={number}")
        _forget(spark, out, "version", before[0] if before else 0)

    _run(rows, checkpoint, "append", write)
    return written(spark, out, "version", rows.schema)


def streaks(events: DataFrame) -> DataFrame:
    """Longest run of errors of each user so far, by arbitrary state: (user_id, current, longest)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, longest = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            current = current + 1 if kind == "error" else 0
            longest = max(longest, current)
        state.update((current, longest))
        yield pd.DataFrame({"user_id": [key[0]], "current": [current], "longest": [longest]})

    return events.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, current long, longest long", "current long, longest long", "update", GroupStateTimeout.NoTimeout
    )
