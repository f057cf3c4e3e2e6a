"""Files in and out: checked tables, JSON-lines shards, pinned inputs, answer archives, archive records."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def read_tables(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files of one folder with their columns unified; a column that a file lacks is null there."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(path)


def require(df: DataFrame, schema: dict[str, str] | None = None, unique: list[str] | None = None, **rules: Column) -> DataFrame:
    """``df``, after one pass has shown that no row breaks a rule, the key is unique and the columns have their types."""
    wrong = {c: t for c, t in (schema or {}).items() if dict(df.dtypes).get(c) != t}
    if wrong:
        raise ValueError(f"columns are not as declared: {wrong}")
    checks = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    found = df.agg(*checks).first().asDict() if checks else {}
    if unique:
        found["unique"] = df.groupBy(*unique).count().where("count > 1").limit(1).count()
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise ValueError(f"rows break rules: {broken}")
    return df


def write_shards(df: DataFrame, path: str, partition: str, codec: str = "gzip") -> None:
    """JSON lines, compressed, one folder for each value of ``partition``; the commit protocol makes files appear whole."""
    df.write.mode("append").partitionBy(partition).option("compression", codec).json(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_zstd_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines shards in Zstandard frames, which the JSON reader has no codec for: each file is unpacked as a stream."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for content in batch.column(0):
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_py()), read_across_frames=True), "utf-8")
                while rows := list(itertools.islice(text, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([r.rstrip("\n") for r in rows], pa.string())], ["line"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").option("recursiveFileLookup", "true").load(path).select("content")
    return raw.mapInArrow(lines, "line string").where("line <> ''").select(F.from_json("line", schema).alias("r")).select("r.*")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_pins(spark: SparkSession, path: str, pins: dict[str, str]) -> None:
    """Raises if a pinned file (by name) is missing or has changed."""
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in digests(spark, path).where(F.element_at(F.split("path", "/"), -1).isin(*pins)).collect()}
    bad = {n: found.get(n) for n, h in pins.items() if found.get(n) != h}
    if bad:
        raise ValueError(f"inputs differ from their pins: {bad}")


def record(spark: SparkSession, ledger: str, run: str, path: str) -> None:
    """Adds every file of a folder, with its length and digest, to the ledger as of ``run``."""
    digests(spark, path).where("path LIKE '%.parquet'").withColumn("run", F.lit(run)).write.mode("append").parquet(ledger)


def read_recorded(spark: SparkSession, ledger: str, run: str) -> DataFrame:
    """The Parquet files that a run recorded, after each has been found unchanged; an error names those that are missing or differ."""
    pinned = spark.read.parquet(ledger).where(F.col("run") == run)
    names = [r.path for r in pinned.select("path").distinct().collect()]  # one row a file, as Spark's own file index
    if not names:
        raise ValueError(f"run {run} is not in the ledger")
    folders = sorted({n.rpartition("/")[0] for n in names})
    now = digests_of(spark, folders).select("path", F.col("sha256").alias("now"))
    bad = pinned.join(now, "path", "left").where("now IS NULL OR now <> sha256").limit(20).collect()
    if bad:
        raise ValueError(f"inputs differ from their pins: {[r.path for r in bad]}")
    return spark.read.parquet(*names)


def digests_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, length, sha256) of the files of several folders."""
    return spark.read.format("binaryFile").load(folders).select("path", "length", F.sha2("content", 256).alias("sha256"))


def answers(df: DataFrame) -> DataFrame:
    """One JSON text for each answer row (id, relevant_docs, relevant_chunks), in the order of ids."""
    return df.select("id", F.to_json(F.struct("id", "relevant_docs", "relevant_chunks")).alias("line"))


def _stream(spark: SparkSession, path: str, write: bool):
    """A file of the shared file system as a binary stream of the driver."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.create(at, True) if write else fs.open(at)


class _Out(io.RawIOBase):
    """Bytes to a stream of the file system, in pieces; it cannot seek, which ZIP files do not need."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def writable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def write_answer_zip(df: DataFrame, path: str, member: str = "answers.json", method: int = zipfile.ZIP_LZMA) -> str:
    """A ZIP of one member, a JSON list with one row a line, the same bytes for the same rows, in the shared file system; returns the member's SHA-256.

    An answer file is a single file by its format, so its rows pass the driver, one partition at a time and none of them held.
    """
    import hashlib

    info = zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0))
    info.compress_type = method
    digest = hashlib.sha256()
    out_file = io.BufferedWriter(_Out(_stream(df.sparkSession, path, True)), 1 << 20)
    with out_file, zipfile.ZipFile(out_file, "w") as z, z.open(info, "w", force_zip64=True) as out:
        first = True
        for row in answers(df).orderBy("id").toLocalIterator():
            data = (("[\n" if first else ",\n") + row.line).encode()
            first = False
            digest.update(data)
            out.write(data)
        tail = b"[\n]\n" if first else b"\n]\n"
        digest.update(tail)
        out.write(tail)
    return digest.hexdigest()


def _member_lines(content: bytes) -> Iterator[bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if len(names) != 1:
            raise ValueError(f"an answer archive has {len(names)} members")
        with z.open(names[0]) as member:
            yield from member


def member_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the one member of an archive, read by a task."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                digest = hashlib.sha256()
                for line in _member_lines(content.as_py()):
                    digest.update(line)
                yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["sha256"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "sha256 string").first().sha256


def read_answer_zip(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a one-member ZIP with a row a line, unpacked line by line in a task, or of a plain JSON list."""
    schema = "id long, relevant_docs array<long>, relevant_chunks array<struct<doc_id: long, chunk_text: string>>"
    if not path.endswith(".zip"):
        return spark.read.schema(schema).option("multiLine", "true").json(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                lines = (line.decode("utf-8").strip().rstrip(",") for line in _member_lines(content.as_py()))
                rows = (line for line in lines if line not in ("[", "]", ""))
                while some := list(itertools.islice(rows, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


_DOCS = r'"relevant_docs"\s*:\s*\[([^\]]*)\]'


def answer_spans(lines: DataFrame, line: str = "line") -> DataFrame:
    """Answer lines with ``id``, ``docs`` and the literal of the document list with its place in the line (from 1): spans that a rewrite may touch."""
    literal = F.regexp_extract(line, _DOCS, 1)
    head = F.regexp_extract(line, r'(?s)^(.*?"relevant_docs"\s*:\s*\[)', 1)
    return lines.select(
        F.regexp_extract(line, r'"id"\s*:\s*(-?\d+)', 1).cast("long").alias("id"), F.col(line),
        F.transform(F.filter(F.split(literal, r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long")).alias("docs"),
        (F.length(head) + 1).cast("long").alias("start"), F.length(literal).cast("long").alias("length"),
    )


def filter_answers(lines: DataFrame, members: DataFrame, dropped: DataFrame | None = None, line: str = "line") -> DataFrame:
    """(id, line): documents that are no ``members`` (doc_id), or are ``dropped``, go from each list; every other byte of the line stays."""
    spans = answer_spans(lines, line)
    flat = spans.select("id", F.posexplode("docs").alias("at", "doc_id")).join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    if dropped is not None:
        flat = flat.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti")
    kept = flat.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), lambda s: s["doc_id"].cast("string")).alias("kept"))
    whole = spans.join(kept, "id", "left")
    same = F.size(F.coalesce("kept", F.array())) == F.size("docs")
    cut = F.concat(F.expr(f"substr({line}, 1, start - 1)"), F.array_join(F.coalesce("kept", F.array().cast("array<string>")), ","), F.expr(f"substr({line}, start + length)"))
    return whole.select("id", F.when(same, F.col(line)).otherwise(cut).alias("line"))


def inventory(spark: SparkSession, path: str, categories: list[tuple[str, str]]) -> DataFrame:
    """(category, files, bytes, digest) of a folder: a file's category is that of the first pattern that its path matches; the digest covers names and contents."""
    name = F.expr("substring_index(path, '/', -1)")
    kind = F.lit("other")
    for category, pattern in categories[::-1]:
        kind = F.when(F.col("path").rlike(pattern), category).otherwise(kind)
    rows = digests(spark, path).select(kind.alias("category"), "length", F.sha2(F.concat_ws(":", name, "sha256"), 256).alias("one"))
    return rows.groupBy("category").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.expr("bit_xor(xxhash64(one))").alias("digest"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(url, status, type, body) of archived responses, one record a file."""
    from ..operators.passages import parse_response_record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_response_record(c.as_py()) for c in batch.column(0)]
            kinds = {"url": pa.string(), "status": pa.int32(), "type": pa.string(), "body": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return raw.mapInArrow(run, "url string, status int, type string, body binary")


def merge_rows(state: DataFrame, updates: DataFrame, keys: list[str], time: str) -> DataFrame:
    """A keyed table after updates: the newest row of each key stays, on equal times the update."""
    w = F.struct(F.col(time), F.col("_new"))
    both = state.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    value = F.struct(*[c for c in state.columns if c not in keys])
    best = both.groupBy(*keys).agg(F.max_by(value, w).alias("v"))
    return best.select(*keys, "v.*").select(*state.columns)


def claim_placed(state: DataFrame, domain: str, now: Column, n: int, selected: bool = False) -> DataFrame:
    """The next ``n`` rows of a domain that are due, with their place from 1: fresh ones first, then by rank; where the domain is ``selected``, by rank alone."""
    due = (F.col("status") == "pending") & (F.col("next_try_at").isNull() | (F.col("next_try_at") <= now))
    order = [*([] if selected else [F.col("next_try_at").isNotNull()]), F.col("rank"), F.col("url_norm")]
    rows = state.where((F.col("domain") == domain) & due).orderBy(*order).limit(n)
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))  # over the rows that were taken


def claim(state: DataFrame, domain: str, now: Column, n: int, selected: bool = False) -> DataFrame:
    """The rows of ``claim_placed`` in their order."""
    return claim_placed(state, domain, now, n, selected).orderBy("place").drop("place")


def capture_outcomes(targets: DataFrame, captures: DataFrame) -> DataFrame:
    """(id, outcome) of each of ``targets`` (id) by its ``captures`` (id, fetched: the HTTP status, ok: whether text came out): no_capture, dead if all are gone, usable if any gave text, else unusable."""
    gone = F.coalesce(F.col("fetched").isin(404, 410), F.lit(False))
    of = captures.groupBy("id").agg(F.bool_and(gone).alias("dead"), F.bool_or(F.coalesce("ok", F.lit(False))).alias("usable"))
    outcome = F.when(F.col("dead").isNull(), "no_capture").when(F.col("dead"), "dead").when(F.col("usable"), "usable").otherwise("unusable")
    return targets.select("id").distinct().join(of, "id", "left").select("id", outcome.alias("outcome"))
