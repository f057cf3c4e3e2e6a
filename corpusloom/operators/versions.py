"""A versioned state table whose updates are guarded by a digest and can be taken back.

A version is a folder of rows by key; the largest number whose write was completed counts.  A
transition names the rows that it touches and what they become.  It carries the digest
of the touched rows as its author saw them: if they have changed since, nothing is
written.  The rows as they were go to an undo log beside the new version, and ``rollback``
puts them back, again only if nobody has touched them in between.

Defined results: keys are unique and not null (an error else); a transition may touch rows that do not exist (they are
added, and a rollback takes them out), but a key only once; an empty transition makes no version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Stale(ValueError):
    """The rows have changed since the digest was taken."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/rows")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def create(self, rows: DataFrame) -> int:
        if self.versions():
            raise ValueError("the table is there already")
        self._checked(rows)
        rows.write.parquet(f"{self.root}/rows/version=0")
        return 0

    def read(self, version: int | None = None) -> DataFrame:
        number = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(f"{self.root}/rows/version={number}")

    def log(self, version: int) -> DataFrame:
        """The rows that ``version`` replaced, as they were; ``_absent`` where there was none."""
        return self.spark.read.parquet(f"{self.root}/undo/version={version}")

    def _checked(self, rows: DataFrame) -> None:
        bad = rows.groupBy(*self.keys).count().where(F.col("count") > 1).limit(1).count() or rows.where(self._null_key()).limit(1).count()
        if bad:
            raise ValueError(f"keys {self.keys} are null or not unique")

    def _null_key(self) -> Column:
        out = F.lit(False)
        for k in self.keys:
            out = out | F.col(k).isNull()
        return out

    def digest(self, touched: DataFrame, version: int | None = None) -> str:
        """A digest of the rows with the keys of ``touched`` as they are now, independent of their order; rows that do not exist count by their key."""
        now = self.read(version)
        columns = sorted(now.columns)
        state = F.when(F.col("_here").isNull(), F.lit("-")).otherwise(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
        rows = touched.select(*self.keys).distinct().join(now.withColumn("_here", F.lit(1)), self.keys, "left")
        one = F.sha2(F.concat_ws("|", F.to_json(F.struct(*self.keys)), state), 256)
        n, total, mixed = rows.select(F.xxhash64(one).alias("x"), F.xxhash64(one, F.lit(1)).alias("y")).agg(
            F.count("*"), F.coalesce(F.sum(F.col("x").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor("y"), F.lit(0))
        ).first()
        return f"{n}:{int(total)}:{mixed}"

    def apply(self, changes: DataFrame, seen: str) -> int:
        """Writes the next version, in which the rows of ``changes`` replace those of their keys; ``Stale`` if the touched rows have not the digest ``seen``."""
        self._checked(changes)
        number = self.versions()[-1]
        now = self.read(number)
        if self.digest(changes, number) != seen:
            raise Stale(f"rows of version {number} are not those that were seen")
        if changes.isEmpty():
            return number
        keys = changes.select(*self.keys)
        before = keys.join(now.withColumn("_here", F.lit(1)), self.keys, "left").select(*now.columns, F.col("_here").isNull().alias("_absent"))
        before.write.mode("overwrite").parquet(f"{self.root}/undo/version={number + 1}")
        after = now.join(keys, self.keys, "left_anti").unionByName(changes.select(*now.columns))
        after.write.mode("overwrite").parquet(f"{self.root}/rows/version={number + 1}")
        return number + 1

    def rollback(self, version: int) -> int:
        """A new version in which the rows that ``version`` changed are as before; ``Stale`` if one of them has changed since."""
        undo, last = self.log(version), self.versions()[-1]
        keys = undo.select(*self.keys)
        if self.digest(keys, last) != self.digest(keys, version):
            raise Stale(f"rows of version {version} have changed since")
        now = self.read(last)
        before = keys.join(now.withColumn("_here", F.lit(1)), self.keys, "left").select(*now.columns, F.col("_here").isNull().alias("_absent"))
        before.write.mode("overwrite").parquet(f"{self.root}/undo/version={last + 1}")
        after = now.join(keys, self.keys, "left_anti").unionByName(undo.where("NOT _absent").drop("_absent"))
        after.write.mode("overwrite").parquet(f"{self.root}/rows/version={last + 1}")
        return last + 1
