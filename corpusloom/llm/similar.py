"""Near copies by SimHash blocks, decided by the exact likeness of their word shingles.

Two texts are near copies if the sets of their five-word shingles have a
Jaccard of 0.8 or more.

Fingerprint: 512 bits.  Each is the sign of a sum over the text's distinct
shingles, of a signed byte that the shingle's XXH64 gives for that bit.  Sets at
a Jaccard of 0.8 have a cosine of 0.89 or more and so differ in at most 15 % of
the bits by average; in 64 bits that is up to 16, in 512 the share hardly strays.

Candidates: the 512 bits are dealt six times, each time otherwise, into 32
blocks of 16.  Texts that agree on a block meet in its bucket and go on if at most
``FAR`` of 192 bits differ there, and at most ``FAR_ALL`` of all.  Texts within
31 bits share a block for certain.  By the binomial law of independent bits a
pair at 0.8 shares one of the 192 blocks with a chance of 0.9999, more above,
fails the 192 bits with a chance of 1e-8 and all bits with one of 1e-9.  Texts
of equal sets are one node from the start.

Sketch: 1024 bits, each whether an odd number of the set's hashes falls on it.
Sets differ in at least as many hashes as their sketches in bits, so a pair whose
sketches differ in more than a Jaccard of 0.8 allows is no link for certain.

Crowds: first come chains.  In the buckets of the first ``CHAINED`` blocks a node
looks at the next ``NEXT`` rows in the order of the next two blocks and goes on with
the first near one, which is a forest for each bucket.  What the exact links among these pairs join is
a component, and components enter the buckets of all dealings.  A bucket of at most
``LIMIT`` rows says which nodes are near one of another component; these enter once more with
their sketches, and every pair of two components that is near and that the
sketches allow is decided.  A larger bucket of several components only says that
it is crowded.  All nodes of crowded buckets go through the set join
(``operators.setjoin``), which finds every pair of two components at the likeness by prefix, length and place of
the sets themselves, whatever the fingerprints say.  So no near pair is left out but those that
are joined already or are no links for certain.  No bucket is held whole: a task
keeps ``LIMIT`` rows of it.

Defined results: words are what white space separates, A-Z in lower case; a
text of fewer than five words is one shingle; null and texts without words
equal each other; a document without id stays only where its group has none
with one; of rows equal in all columns one stays; reruns agree.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from functools import partial, reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import setjoin
from ..operators.graph import components
from . import rows as named_rows
from .scratch import Scratch, small_batches
from .simhash import first_of_each

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, of a block; blocks of a dealing, dealings; buckets that a node enters.
BITS, BLOCK = 512, 16
BLOCKS, DEALS = BITS // BLOCK, 6
#: Dealings that lie in the shuffle at once.
AT_ONCE = 2
BANDS = DEALS * BLOCKS
#: Words of the fingerprint that are compared in a bucket, the most bits that may differ there, and of all bits.
WORDS, FAR, FAR_ALL = 3, 61, 128
#: In chains: blocks of the first dealing, and the rows behind it that a node looks at.  Otherwise: rows of a bucket that are compared.
CHAINED, NEXT, LIMIT = 8, 32, 64
#: Bits of a sketch, a power of two; what is kept of it: the set's size and the words.
ODD = 1024
ODD_NAMES = ["size", *(f"o{k}" for k in range(ODD // 64))]
#: Rows in an Arrow batch of blocks, and the nodes that a task remembers to have named.
ENTRY_ROWS, NAMED = 10_000, 1 << 20
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(0, 1 << 63, BITS // 8, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BITS // 8, np.uint64)
_DEALT = [_RNG.permutation(BITS) for _ in range(DEALS)]
_EVEN = np.uint64(0x00FF00FF00FF00FF)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or "").encode("utf-8").lower().split()
    grams = {xxhash.xxh64_intdigest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))} if words else set()
    return np.sort(np.fromiter(grams, np.uint64, len(grams)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set, as ``BITS`` // 64 signed words; no shingles give zeros."""
    sums = np.zeros((BITS // 8, 4, 2), np.int64)  # of each word its four even and odd bytes
    for at in range(0, len(hashes), 256):  # 256 bytes add up to less than 16 bits hold
        mixed = hashes[at : at + 256, None] * _MULTIPLY + _ADD
        mixed ^= mixed >> np.uint64(29)  # the low bits of a product hang on low bits only
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        sums[:, :, 0] += (mixed & _EVEN).sum(axis=0).view(np.uint16).reshape(-1, 4)
        sums[:, :, 1] += ((mixed >> np.uint64(8)) & _EVEN).sum(axis=0).view(np.uint16).reshape(-1, 4)
    return np.packbits(2 * sums.ravel() > 255 * len(hashes), bitorder="little").view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The size of a shingle set, then the words of its sketch."""
    odd = np.bincount((hashes & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1
    return np.append(np.int64(len(hashes)), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))


def _with_bands(df: DataFrame, text: str) -> DataFrame:
    """The columns but ``text``, with _loom_node (hash of the shingle set), _loom_bands (its fingerprint) and _loom_odd (its sketch).  A narrow map."""
    small_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField("_loom_node", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("_loom_bands", "_loom_odd"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(len(keep)).to_pylist()]
            made = [pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (fingerprint, odd_sketch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(map(_node, sets), pa.int64()), *made], schema.names)

    return df.select(*(f.name for f in keep), text).mapInArrow(run, schema)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _sets(df: DataFrame, text: str) -> DataFrame:
    """(node, grams): the shingle hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "grams"])

    return df.select(text).mapInArrow(run, "node long, grams array<long>")


def _entries(nodes: DataFrame, deals: list[int], blocks: int = BLOCKS, more: str = "") -> DataFrame:
    """One row for each node and block of ``deals``: slot (table, block, and the next two blocks for order), node, its root, the words to compare, and the sketch (``more`` = odd) or known."""
    sketched = more == "odd"
    names = ["slot", "node", "root", *(f"w{k}" for k in range(WORDS)), *(ODD_NAMES if sketched else [more] if more else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(2).flatten().to_numpy().reshape(-1, BITS // 64)
            odd = batch.column(3).flatten().to_numpy().reshape(-1, len(ODD_NAMES)).T if sketched else [batch.column(3).to_numpy()] if more else []
            bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
            same = [*(batch.column(k).to_numpy() for k in range(2)), *prints.T[:WORDS], *odd]
            for deal in deals:
                dealt = np.packbits(bits.take(_DEALT[deal], axis=1), axis=1, bitorder="little").view(np.uint16).astype(np.int64)
                table = np.arange(deal * BLOCKS, deal * BLOCKS + blocks, dtype=np.int64) << 48
                slot = table | dealt[:, :blocks] << 32 | np.roll(dealt, -1, axis=1)[:, :blocks] << 16 | np.roll(dealt, -2, axis=1)[:, :blocks]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (slot.ravel(), *(np.repeat(c, blocks) for c in same))], names)

    root = "root" if "root" in nodes.columns else F.col("node").alias("root")
    return nodes.select("node", root, "bands", *([more] if more else [])).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _starts(bucket: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of each row, sorted by bucket and root, the first row behind those of its own bucket and root."""
    last = np.append(np.flatnonzero((bucket[1:] != bucket[:-1]) | (root[1:] != root[:-1])), len(bucket) - 1)
    return last[np.searchsorted(last, np.arange(len(bucket)))] + 1


def _near(rows: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the row pairs differ in at most ``FAR`` bits of the words; those are unsigned, for of signed ones NumPy counts the bits of the magnitude."""
    return sum(np.bitwise_count((w[one] ^ w[other]).view(np.uint64)).astype(np.int64) for w in rows[3 : 3 + WORDS]) <= FAR


def _chain(rows: list[np.ndarray], starters: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of the first ``starters`` rows the first near one among the ``NEXT`` behind it in its bucket."""
    bucket, node = rows[0] >> 32, rows[1]
    at, found = np.arange(starters), []
    for step in range(1, NEXT + 1):
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        near = _near(rows, at, at + step)
        found.append((node[at[near]], node[at[near] + step]))
        at = at[~near]
    one, other = (np.concatenate(c) for c in zip(*found, strict=True))
    return np.minimum(one, other), np.maximum(one, other)


def _allowed(rows: list[np.ndarray], one: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the row pairs their sketches allow to be a link."""
    size, *odd = rows[3 + WORDS :]
    differ = sum(np.bitwise_count((w[one] ^ w[other]).view(np.uint64)).astype(np.int64) for w in odd)
    return differ * (1 + similarity) <= (size[one] + size[other]) * (1 - similarity) + 1e-6


def _small_buckets(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of buckets of at most ``LIMIT``, and the larger buckets of several roots."""
    bucket, root = rows[0] >> 32, rows[2]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(bucket)))
    several = root[first] != root[first + size - 1]
    keep = np.repeat((size <= LIMIT) & several, size)
    return [c[keep] for c in rows], bucket[first[(size > LIMIT) & several]]


def _met(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near row pairs of two roots in whole small buckets, sorted by bucket and root."""
    bucket = rows[0] >> 32
    ends, start, at = np.searchsorted(bucket, bucket, "right"), _starts(bucket, rows[2]), np.arange(len(bucket))
    for step in count():
        at = at[start[at] + step < ends[at]]
        if not len(at):
            return
        other = start[at] + step
        near = _near(rows, at, other)
        yield at[near], other[near]


def _meet(batches: Iterator[pa.RecordBatch], how: str, similarity: float) -> Iterator[pa.RecordBatch]:
    """Walks sorted buckets; what goes on in the next batch is held, ``NEXT`` or ``LIMIT`` + 1 rows."""
    held: list[np.ndarray] | None = None
    named: set[int] = set()
    for batch in chain(batches, [None]):
        rows = [c.to_numpy() for c in batch.columns] if batch is not None else None
        if held is not None:
            rows = held if rows is None else [np.concatenate(c) for c in zip(held, rows, strict=True)]
        if rows is None or not len(rows[0]):
            continue
        n, last = len(rows[0]), batch is None
        if how == "chain":
            whole = n if last else max(0, n - NEXT)
            a, b = _chain(rows, whole)
            held = [c[whole:].copy() for c in rows]
        else:
            bucket = rows[0] >> 32
            whole = n if last else int(np.searchsorted(bucket, bucket[-1]))
            held = [c[whole:].copy() for c in rows]
            if len(held[0]) > LIMIT + 1:  # it is large; its first and last root say whether it has several
                held = [np.append(c[:LIMIT], c[-1:]) for c in held]
            small, crowded = _small_buckets([c[:whole] for c in rows])
            node, pairs = small[1], list(_met(small))
            if how == "ends":
                if len(named) > NAMED:
                    named = set()
                told = small[3 + WORDS] == 0 if len(small) > 3 + WORDS else np.ones(len(node), bool)  # known nodes are not named again
                new = {x for pair in pairs for of in pair for x in node[of[told[of]]].tolist()} - named
                named |= new
                a = np.concatenate([np.fromiter(new, np.int64, len(new)), crowded])
                b = np.concatenate([np.zeros(len(new), np.int64), np.ones(len(crowded), np.int64)])
            else:
                pairs = [(x[k], y[k]) for x, y in pairs for k in (_allowed(small, x, y, similarity) if len(small) > 3 + WORDS else slice(None),)]
                x, y = (np.concatenate([np.zeros(0, np.int64), *(node[p[k]] for p in pairs)]) for k in range(2))
                a, b = np.minimum(x, y), np.maximum(x, y)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def candidates(nodes: DataFrame, deals: list[int] | None = None, how: str = "pairs", similarity: float = SIMILARITY) -> DataFrame:
    """Distinct (a, b) of ``nodes`` (node, bands: the fingerprint, root if known, odd: the sketch if pairs have to pass it, known: 1 for ends that need not be named).

    ``pairs``: nodes of two roots that are near and share a bucket of at most ``LIMIT``.  ``ends``: (node, 0) of each node in such a pair,
    and (bucket, 1) for each larger bucket of several roots.  ``chain``: of each node and bucket the first near one behind it.
    """
    bucket = F.shiftright("slot", 32)
    order = ["slot", "node"] if how == "chain" else [bucket, "root", "node"]
    blocks = CHAINED if how == "chain" else BLOCKS
    more = {"pairs": "odd", "ends": "known"}.get(how, "")
    entries = _entries(nodes, list(range(DEALS)) if deals is None else deals, blocks, more if more in nodes.columns else "")
    return entries.repartition(bucket).sortWithinPartitions(*order).mapInArrow(partial(_meet, how=how, similarity=similarity), "a long, b long").distinct()


def nodes_of_buckets(nodes: DataFrame, crowded: DataFrame) -> DataFrame:
    """Distinct node of ``nodes`` that enter one of the buckets ``crowded`` (bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(-1, BITS // 64)).view(np.uint8), axis=1, bitorder="little")
            for deal in range(DEALS):
                dealt = np.packbits(bits.take(_DEALT[deal], axis=1), axis=1, bitorder="little").view(np.uint16).astype(np.int64)
                slot = np.arange(deal * BLOCKS, (deal + 1) * BLOCKS, dtype=np.int64) << 16 | dealt
                yield pa.RecordBatch.from_arrays([pa.array(slot.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BLOCKS))], ["bucket", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "bucket long, node long").join(crowded, "bucket", "left_semi").select("node").distinct()


@contextlib.contextmanager
def _setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs within."""
    names = {k: k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(names[k]) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(names[k], v)


def _pairs(nodes: DataFrame, scratch: Scratch, name: str, deals: list[int], how: str, similarity: float) -> DataFrame:
    """The candidates of ``deals``, ``AT_ONCE`` after the other, so that no more lie in the shuffle."""
    with _setting(nodes.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(ENTRY_ROWS)):
        return reduce(DataFrame.unionByName, [scratch.save(candidates(nodes, some, how, similarity), f"{name}{some[0]}") for some in _parts(deals)])


def _parts(deals: list[int]) -> list[list[int]]:
    return [deals[k : k + AT_ONCE] for k in range(0, len(deals), AT_ONCE)]


def _marks(rooted: DataFrame, scratch: Scratch, deals: list[int], similarity: float) -> DataFrame:
    """The ends and crowded buckets of all ``deals``, ``AT_ONCE`` after the other; nodes that one job has named are not named by the next."""
    found, asked = [], rooted
    for some in _parts(deals):
        found.append(_pairs(asked, scratch, "met", some, "ends", similarity))
        if some[-1] == deals[-1]:
            break
        known = reduce(DataFrame.unionByName, found).where("b = 0").select(F.col("a").alias("node")).distinct().withColumn("known", F.lit(1).cast("long"))
        asked = rooted.join(known, "node", "left").withColumn("known", F.coalesce("known", F.lit(0).cast("long")))
    return reduce(DataFrame.unionByName, found)


def _close(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose fingerprints differ in at most ``FAR_ALL`` bits and whose sketches allow a link."""
    left, right = (nodes.select(F.col("node").alias(end), F.struct("bands", "odd").alias(of)) for end, of in (("a", "x"), ("b", "y")))

    def differ(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, bits: total + bits)

    words = [F.slice(f"{of}.odd", 2, ODD // 64) for of in "xy"]
    allowed = differ(*words) * F.lit(1 + similarity) <= (F.col("x.odd")[0] + F.col("y.odd")[0]) * F.lit(1 - similarity) + F.lit(1e-6)
    met = pairs.distinct().join(left, "a").join(right, "b")
    return met.where((differ(F.col("x.bands"), F.col("y.bands")) <= FAR_ALL) & allowed).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets have at least the Jaccard ``similarity``."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b")


def links(df: DataFrame, rows: DataFrame, key: str, text: str, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) between the nodes of ``rows``, the banded rows of ``df``, that join what links of at least the Jaccard ``similarity`` join."""
    name = F.struct(F.col(named_rows.KEY).isNull(), named_rows.KEY, named_rows.HASH)
    firsts = [F.first(f"_loom_{c}").alias(c) for c in ("bands", "odd")]
    nodes = rows.groupBy(F.col("_loom_node").alias("node")).agg(*firsts, F.min_by(F.struct(named_rows.KEY, named_rows.HASH), name).alias("row"))
    nodes = scratch.save(nodes, "nodes")

    def sets_of(asked: DataFrame, k: int) -> DataFrame:
        asked = asked.join(nodes.select("node", "row.*"), "node").select(named_rows.KEY, named_rows.HASH, F.lit(1).alias(named_rows.COPIES))
        return scratch.save(_sets(named_rows.keep(df, scratch.save(asked, f"asked{k}"), key), text), f"sets{k}").dropDuplicates(["node"])

    deals = list(range(DEALS))
    chains = scratch.save(_close(_pairs(nodes, scratch, "chain", [0], "chain", similarity), nodes, similarity), "chains")
    sets = sets_of(_ends(chains), 0)
    roots = components(scratch.save(_alike(chains, sets, similarity), "links0"), Scratch(df.sparkSession, "similar"))
    rooted = scratch.save(nodes.drop("row").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    marks = _marks(rooted, scratch, deals, similarity)
    met = scratch.save(rooted.join(marks.where("b = 0").select(F.col("a").alias("node")).distinct(), "node"), "met")
    rest = scratch.save(_close(_pairs(met, scratch, "pairs", deals, "pairs", similarity), met, similarity), "rest")
    many = scratch.save(nodes_of_buckets(rooted, marks.where("b = 1").select(F.col("a").alias("bucket")).distinct()), "crowd")
    sets = sets.unionByName(sets_of(_ends(rest).unionByName(many).distinct().join(_ends(chains), "node", "left_anti"), 1))
    if not many.isEmpty():
        of = sets.join(many, "node", "left_semi").join(rooted.select("node", "root"), "node")
        rest = rest.unionByName(setjoin.candidates(scratch.save(of, "crowd_sets"), similarity, scratch)).distinct()
    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return scratch.save(_alike(rest, sets, similarity).unionByName(joined), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct node of ``pairs`` (a, b)."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` with one document, that of the smallest key, for each group of near copies; all columns kept.

    Shuffles are deleted with the job that made them: every table of this operator is written once and read from there.
    """
    with _setting(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        return _keep_one(df, key, text, similarity)


def _keep_one(df: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    scratch = Scratch(df.sparkSession, "similar")
    slim = named_rows.named(df, key).select(named_rows.KEY, named_rows.HASH, F.col(text).alias("_loom_text"))
    rows = scratch.save(_with_bands(slim, "_loom_text"), "rows")
    roots = components(links(df, rows, key, text, scratch, similarity), scratch)
    labelled = rows.drop("_loom_bands", "_loom_odd").join(roots, F.col("_loom_node") == roots.node, "left").withColumn("_loom_root", F.coalesce("root", "_loom_node"))
    return named_rows.keep(df, scratch.save(first_of_each(labelled, "_loom_root", "_loom_node"), "chosen"), key)
