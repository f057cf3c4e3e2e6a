"""What the operators of this subpackage share: written intermediate tables and small Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.scratch import Scratch, shared_root

__all__ = ["BATCH_ROWS", "Scratch", "shared_root", "small_batches"]

#: Rows in an Arrow batch handed to a Python worker; with texts of 100 KB this bounds a batch near 25 MB.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
