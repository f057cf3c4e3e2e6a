"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a Parquet table and reading it
back.  The folder is the one named by ``spark.checkpoint.dir``.  Only a session
on one machine may leave it unset (as tests do): there a temporary folder is
made and removed at exit.  On a cluster an unset folder is an error, for a
temporary folder of one machine is not seen by the others.  Unlike a local
checkpoint the table survives the loss of any executor.

Results read these tables lazily, so they stay until ``Scratch.sweep`` or
``sweep_all`` is called, or the process that made them ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[Scratch] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.TemporaryDirectory(prefix="corpusloom-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        root = "file://" + folder.name
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextlib.contextmanager
def few_rows(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """Python gets Arrow batches of so many rows from what is run inside: for rows that hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Named tables of one operator call under the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        _made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def sweep(self) -> None:
        """Deletes all tables of the call; no result that reads them may be used afterwards."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep_all() -> None:
    """Deletes the tables of all calls so far, for a caller that has consumed its results."""
    while _made:
        _made.pop().sweep()


@atexit.register
def _sweep_at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone; a session of one machine removes its folder anyway
        sweep_all()
