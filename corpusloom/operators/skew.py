"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], size: str, hot: int) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row for each key and in ``size`` the number of its rows.

    Keys of more than ``hot`` rows are met by broadcast where their rows lie, so
    no task holds them all; there are at most (number of rows) / ``hot`` of
    them.  The other keys are joined by a shuffle.  Keys must not be null; the
    rows of keys that ``per_key`` lacks are left out.
    """
    values = [c for c in per_key.columns if c not in keys]
    big = F.broadcast(per_key.where(F.col(size) > hot).select(*keys, F.struct(*values).alias("_big")))
    marked = rows.join(big, keys, "left")
    at_home = marked.where("_big IS NOT NULL").select(*rows.columns, "_big.*")
    moved = marked.where("_big IS NULL").drop("_big").join(per_key.where(F.col(size) <= hot), keys)
    return at_home.unionByName(moved.select(*rows.columns, *values))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it has no more partitions than there are, as a table of one file has; a larger one stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
