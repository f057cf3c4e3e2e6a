"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits, each the majority over the XXH64 hashes of the
text's word shingles.  Fingerprints within ``BITS`` = 2 differing bits link.

Candidates: the 64 bits are split into four blocks of 16.  Two differing bits
touch two blocks at most, so any linked pair agrees on some pair of blocks; each
distinct fingerprint enters six tables, keyed by 32 of its bits.  Fingerprints
are joined on those keys and the Hamming distance is verified.

Hot keys: a key that more than ``DENSE`` distinct fingerprints share would give
the square of its size.  There the members are linked through common neighbours
instead: x and y differ in at most two bits exactly if some point lies within
one bit of both.  Each member names the 33 points that keep the key (itself and
one flip in each free bit); members that name the same point are mutually
linked, so linking each to the smallest of them loses no connection.  That is
exact, linear, and needs no pairs.

Components are found by alternating large-star and small-star steps over
written tables, on one node for each distinct fingerprint.  A key or a node that
very many fingerprints share is met by broadcast of its one row.

Defined results: null text is the empty text; texts without words get
fingerprint zero and link like any other; repeated rows stay repeated; a null
id never becomes a component id unless no document of the component has one;
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import MAX_HUBS, components
from ..operators.skew import join_counted
from . import rows as named_rows
from .scratch import Scratch, small_batches

BITS = 2
SHINGLE = 3
#: Distinct fingerprints under one block key beyond which they are linked through neighbours instead of pairs.
DENSE = 64
#: Fingerprints under one key beyond which the key's row is broadcast to them.
CROWD = 100_000
_BLOCKS = [0xFFFF << (16 * k) for k in range(4)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASKS = [_BLOCKS[i] | _BLOCKS[j] for i in range(4) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    data = np.frombuffer((text or "").encode("utf-8").lower(), np.uint8)  # bytes: A-Z only
    # words with one space between: of each run of white space the first byte after a word stays, as a space
    space = _SPACE[data]
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[:1] = False
    line = np.where(space, np.uint8(32), data)[~space | first]
    line = line[:-1] if len(line) and line[-1] == 32 else line
    if not len(line):
        return 0
    gaps = np.flatnonzero(line == 32)
    words = len(gaps) + 1
    n = max(1, words - shingle + 1)
    starts = np.concatenate(([0], gaps + 1))[:n]
    stops = np.concatenate((gaps, [len(line)]))[min(shingle, words) - 1 :]
    line = line.tobytes()
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        some = zip(starts[at : at + 8192].tolist(), stops[at : at + 8192].tolist(), strict=True)
        hashes = np.array([digest(view[a:b], 42) for a, b in some], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Adds the fingerprint as a (signed) long to the columns in ``keep`` (all by default).  A narrow map."""
    small_batches(df.sparkSession)
    keep = [c for c in (keep if keep is not None else df.columns) if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType())])
    read = [*keep, *([text] if text not in keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint_of(t, shingle)) for t in batch.column(read.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints, pa.int64())], schema.names)

    return df.select(*read).mapInArrow(run, schema)


def _keyed(prints: DataFrame) -> DataFrame:
    """One row for each table and fingerprint: (table, key, fp)."""
    entries = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(_MASKS)])
    return prints.select("fp", F.explode(entries).alias("e")).select("e.table", "e.key", "fp")


def _near_points(table: Column, fp: Column) -> Column:
    """The fingerprint and its one-bit flips outside the table's key bits."""
    by_table = [
        F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64) if not m >> b & 1]) for m in _MASKS
    ]
    return F.element_at(F.array(*by_table), table + 1)


def links(prints: DataFrame, scratch: Scratch, bits: int = BITS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b), a != b, between distinct fingerprints ``fp`` whose closure is that of all pairs within ``bits``."""
    if bits != BITS:
        raise ValueError("the block tables are laid out for two differing bits")
    keyed = scratch.save(_keyed(prints), "keyed")
    crowd = max(CROWD, keyed.count() // MAX_HUBS)
    groups = keyed.groupBy("table", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = scratch.save(join_counted(keyed, groups, ["table", "key"], "members", crowd), "shared")
    few = shared.where(F.col("members") <= dense)
    pairs = (
        few.select("table", "key", F.col("fp").alias("a"))
        .join(few.select("table", "key", F.col("fp").alias("b")), ["table", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
        .select("a", "b")
    )
    many = shared.where(F.col("members") > dense).select("table", "key", "fp", F.explode(_near_points(F.col("table"), F.col("fp"))).alias("point"))
    many = scratch.save(many.select("table", "point", "fp"), "points")
    hubs = many.groupBy("table", "point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    # a point lies within one bit of at most 33 members
    through = many.join(hubs, ["table", "point"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return scratch.save(pairs.unionByName(through).distinct(), "links")


def _prepare(with_fp: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(fp, root, component_id): every distinct fingerprint with the smallest document id of its component."""
    distinct = scratch.save(with_fp.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("first_id")), "distinct")
    edges = links(distinct.select("fp"), scratch)
    roots = components(edges, scratch)
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    labelled = scratch.save(labelled, "labelled")
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return scratch.save(labelled.join(smallest, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each input row: key, fingerprint (16 lower-case hex digits), component_id (smallest key reachable)."""
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.save(with_fingerprint(df, text, shingle=shingle, keep=[key]), "prints")
    found = _prepare(prints, key, scratch)
    return prints.join(found, prints.fingerprint == found.fp).select(
        key, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` with one document, that of the smallest key, for each component; all columns kept.

    Rows repeated under the surviving key count as copies, so one of them stays.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    named = named_rows.named(df, key).select(named_rows.KEY, named_rows.HASH, F.col(text).alias("_loom_text"))
    prints = scratch.save(with_fingerprint(named, "_loom_text", shingle=shingle, out="fingerprint", keep=[named_rows.KEY, named_rows.HASH]), "rows")
    found = _prepare(prints.select("fingerprint", F.col(named_rows.KEY).alias("key")), "key", scratch)
    labelled = prints.join(found.select("fp", "root"), F.col("fingerprint") == F.col("fp"))
    return named_rows.keep(df, scratch.save(first_of_each(labelled, "root", "fingerprint"), "chosen"), key)


def first_of_each(labelled: DataFrame, root: str, tie: str) -> DataFrame:
    """Of each ``root`` the row name of the smallest key (a null key last), then of the smallest ``tie`` and hash."""
    order = F.struct(F.col(named_rows.KEY).isNull(), named_rows.KEY, tie, named_rows.HASH)
    per_name = labelled.groupBy(root, named_rows.KEY, tie, named_rows.HASH).agg(F.count("*").alias(named_rows.COPIES))
    best = per_name.groupBy(root).agg(F.min_by(F.struct(named_rows.KEY, named_rows.HASH, named_rows.COPIES), order).alias("best"))
    return best.select("best.*")
