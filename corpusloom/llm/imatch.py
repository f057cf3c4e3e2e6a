"""I-Match document fingerprints with randomised lexicons.

Terms are the lower-cased words of a text: runs of letters, digits and marks of
any script, so that dashes, quotes and no-break spaces end a word.  Document
frequencies are counted over all documents; the lexicon keeps the terms whose
inverse document frequency lies in a band, which drops words that every text
has and words of no evidence.  A fingerprint hashes the sorted distinct lexicon
terms of a text, once for the whole lexicon and once for each of several random
sub-lexicons of different densities: a dense one changes with any edit, a
sparse one survives many.

The likeness of two fingerprints is the share of common terms that best explains
which of their sub-lexicon hashes agree.

Size bound: terms in at least the share ``LOW`` of the documents number at most
(mean distinct terms of a text) / LOW, however large the corpus; the lexicon is
sent to the workers as one sorted array of 8-byte hashes.

Defined results: null text is the empty text; a text without lexicon terms is
fingerprinted by all its terms; texts without any term are equal to each other;
a sub-lexicon's count of terms stops at 15 in the fingerprint, its hash covers
all of them; rows of equal ids are ordered by their texts' hash; a null id sorts
first; ids are integers, others are an error; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches

#: The band: terms in more than HIGH or less than LOW of all documents, or in fewer than MIN_DOCS, are left out.
LOW, HIGH, MIN_DOCS = 1e-4, 0.1, 2
#: (density, number) of the random sub-lexicons.
DENSITIES = ((1 / 8, 8), (1 / 24, 16), (1 / 72, 24), (1 / 216, 16), (1 / 650, 8))
_P = np.array([p for p, n in DENSITIES for _ in range(n)])
_LIMIT = (_P * 2.0**64).astype(np.uint64)
_SEEDS = np.array([xxhash.xxh64_intdigest(b"lexicon %d" % k) for k in range(len(_P))], np.uint64)
#: Term hashes that a task counts before it passes them on.
FLUSH_TERMS = 1_000_000
#: Rows aimed at in a range of ids, and the most ranges.
RANGE_ROWS, MAX_RANGES = 2048, 4096
_FIRST = -(1 << 63)


#: Characters of a text that are worked on at a time; results do not depend on it.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _in_words() -> np.ndarray:
    """Which code points stand in words: letters, digits and marks (categories L, N, M)."""
    return np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x32000)])


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, up to 2^bits of them."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.ones(1 << bits, np.uint64)
        for k in range(bits):
            row[1 << k : 2 << k] = row[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
        out.append(row)
    return out[0], out[1]


def _word_hashes(codes: np.ndarray, open_hash: int, open_length: int) -> tuple[np.ndarray, int, int]:
    """Polynomial hashes of the words that end in a segment, and the hash and length of the word that its end leaves open.

    Running sums give the polynomial of each stretch, shifted back to its
    start; a word that the segment before left open goes on at the first place.
    """
    table = _in_words()
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = table[np.minimum(codes, len(table) - 1)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    up, down = _powers(max(10, int(len(codes)).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * down[starts]
    if open_length and not (len(starts) and starts[0] == 0):
        hashes = np.concatenate((np.array([open_hash], np.uint64), hashes))
        open_length = 0
    elif open_length:
        hashes[0] = np.uint64((open_hash + pow(_BASE, open_length, 1 << 64) * int(hashes[0])) % (1 << 64))
    if len(stops) and stops[-1] == len(codes):
        length = int(stops[-1] - starts[-1]) + (open_length if len(stops) == 1 else 0)
        return hashes[:-1], int(hashes[-1]), length
    return hashes, 0, 0


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the words of a text."""
    text, found, left, length = (text or "").lower(), [], 0, 0
    for at in range(0, len(text), SEGMENT):
        codes = np.frombuffer(text[at : at + SEGMENT].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashes, left, length = _word_hashes(codes, left, length)
        found.append(hashes)
    if length:
        found.append(np.array([left], np.uint64))
    if not found:
        return np.zeros(0, np.uint64)
    out = _mix(found[0] if len(found) == 1 else np.concatenate(found))
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """(term long, docs long) over all documents; counts are combined in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.array([], np.uint64), np.array([], np.int64))
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "docs"])

        held, size = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(terms(t))
                size += len(held[-1])
            if size >= FLUSH_TERMS * 4:
                yield out(held)
                held, size = [], 0
        yield out(held)

    small_batches(df.sparkSession)
    return df.select(text).mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def lexicon(df: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH, min_docs: int = MIN_DOCS) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    n = df.count()
    found = document_frequencies(df, text).where((F.col("docs") >= max(min_docs, low * n)) & (F.col("docs") <= max(min_docs, high * n)))
    return np.unique(found.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def memberships(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sub-lexicons that hold each term: how many, and their numbers one term after the other."""
    many, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for at in range(0, len(found), 8192):
        member = _mix(found[at : at + 8192, None] ^ _SEEDS) < _LIMIT
        many.append(member.sum(axis=1))
        numbers.append(np.nonzero(member)[1].astype(np.uint8))
    return np.concatenate(many), np.concatenate(numbers)


class Lexicon:
    """The terms in the band with their memberships, worked out once for each worker."""

    def __init__(self, found: np.ndarray):
        self.terms = found
        self.many, self.numbers = memberships(found)
        self.starts = np.cumsum(self.many) - self.many

    def select(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lexicon terms among ``found`` (all of them if there is none) and their memberships."""
        if len(self.terms) and len(found):
            at = np.searchsorted(self.terms, found)
            at[at == len(self.terms)] = 0
            inside = self.terms[at] == found
            if inside.any():
                at = at[inside]
                many = self.many[at]
                ends = np.cumsum(many)
                places = np.repeat(self.starts[at] - ends + many, many) + np.arange(ends[-1])
                return found[inside], many, self.numbers[places]
        return found, *memberships(found)


@functools.lru_cache(maxsize=2)
def _lexicon(sent) -> Lexicon:
    return Lexicon(sent.value)


@dataclass(frozen=True)
class Signature:
    """Hash of all lexicon terms; for each sub-lexicon 20 bits: its number of terms (15: more) and 16 bits of their hash."""

    whole: int
    codes: np.ndarray

    def __str__(self) -> str:
        return f"{self.whole:016x}" + "".join([f"{c:05x}" for c in self.codes.tolist()])

    @staticmethod
    def parse(text: str) -> Signature:
        return Signature(int(text[:16], 16), np.array([int(text[k : k + 5], 16) for k in range(16, len(text), 5)], np.int64))


def signature(found: np.ndarray, lex: Lexicon) -> Signature:
    found, many, numbers = lex.select(found)
    # the sorted terms of one sub-lexicon after those of another
    held = memoryview(np.repeat(found, many)[np.argsort(numbers, kind="stable")].tobytes())
    counts = np.bincount(numbers, minlength=len(_P))
    codes, at, digest = [], 0, xxhash.xxh64_intdigest
    for n in counts.tolist():
        codes.append(digest(held[at : at + 8 * n]) & 0xFFFF if n else 0)
        at += 8 * n
    return Signature(xxhash.xxh64_intdigest(found.tobytes()), np.minimum(counts, 15) << 16 | np.array(codes, np.int64))


def share(a: Signature, b: Signature) -> float:
    """The share of common terms that best explains which sub-lexicon hashes agree; 1 for equal fingerprints, 0 if none agrees.

    A sub-lexicon that holds u terms of the texts agrees with chance s ** u for
    a share s; the likelihood over all sub-lexicons that hold any is maximised
    by bisection.
    """
    same = a.codes == b.codes
    if a.whole == b.whole and same.all():
        return 1.0
    agree = int((a.codes[same] >> 16).sum())
    if not agree:
        return 0.0
    differ = np.bincount(np.maximum(a.codes, b.codes)[~same] >> 16, minlength=16).tolist()
    rest = [(u, n) for u, n in enumerate(differ) if n and u]
    low, high = 0.0, 1.0
    for _ in range(14):
        s = (low + high) / 2
        if agree > sum(n * u * s**u / (1 - s**u) for u, n in rest):
            low = s
        else:
            high = s
    return low


def likeness(a: str, b: str) -> float:
    """``share`` of two fingerprints as texts."""
    return share(Signature.parse(a), Signature.parse(b))


def edited(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _dealt(k: np.ndarray, h: np.ndarray, cut_k: np.ndarray, cut_h: np.ndarray) -> np.ndarray:
    """The range of each row: how many of the sorted cuts (k, h) are at or before it."""
    low, high = np.searchsorted(cut_k, k, side="left"), np.searchsorted(cut_k, k, side="right")
    out = low.astype(np.int32)
    within = np.flatnonzero(low < high)
    for first in np.unique(low[within]).tolist():
        rows = within[low[within] == first]
        out[rows] = first + np.searchsorted(cut_h[first : high[rows[0]]], h[rows], side="right")
    return out


def _neighbours(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt by ranges of (id, hash of the text), sorted; each range ends with a copy of the next range's first row (last = 1).

    The cuts between ranges come from a sample of rows; where they lie has no
    effect on the result.  An id with many rows is cut by the hashes.
    """
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is not of an integer type")
    keys = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)).alias("k"), F.xxhash64(text).alias("h"))
    n = keys.count()
    m = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    picked = sorted(set(map(tuple, keys.sample(min(1.0, 64.0 * m / n), seed=7).collect()))) if m > 1 else []
    cuts = sorted({picked[len(picked) * i // m] for i in range(1, m)}) if picked else []
    cut_k, cut_h = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))

    @F.pandas_udf(T.IntegerType())
    def dealt(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_dealt(k.to_numpy(), h.to_numpy(), cut_k, cut_h))

    firsts = [(r.part, (r["first"].k, r["first"].h)) for r in keys.groupBy(dealt("k", "h").alias("part")).agg(F.min(F.struct("k", "h")).alias("first")).orderBy("part").collect()]
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # the first range comes after the last

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ranges(k: pd.Series, h: pd.Series) -> pd.Series:
        own = _dealt(k.to_numpy(), h.to_numpy(), cut_k, cut_h).tolist()
        return pd.Series([[p, before[x]] if x in before else [p] for p, x in zip(own, zip(k.tolist(), h.tolist(), strict=True), strict=True)])

    k, h = F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)), F.xxhash64(text)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), k.alias("k"), h.alias("h"), ranges(k, h).alias("ranges"))
    return (
        rows.select("key", "text", "k", "h", F.posexplode("ranges").alias("last", "part"))
        .repartition("part")
        .sortWithinPartitions("part", "last", "k", "h")
        .select("key", "text", "part", "last")
    )


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: key and fingerprint."""
    lex = _sent(df, text)
    schema = T.StructType([df.schema[key], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [str(signature(terms(t), _lexicon(lex))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def _sent(df: DataFrame, text: str):
    return df.sparkSession.sparkContext.broadcast(lexicon(df, text))


def edit_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likenesses to the edited and to the next text."""
    lex = _sent(df, text)
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([df.schema[key]] + [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexed, open_row = _lexicon(lex), None
        for batch in batches:
            rows, ids = [], []
            for k, (t, part, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                t = t or ""
                own = signature(terms(t), lexed)
                if open_row is not None and open_row[0] == part:
                    _, ident, before, print_before = open_row
                    changed = edited(before, t)
                    print_edited = signature(terms(changed), lexed)
                    ids.append(ident)
                    rows.append(
                        (len(before), hashlib.sha256(changed.encode()).hexdigest(), str(print_before), str(print_edited), share(print_before, print_edited), share(print_before, own))
                    )
                open_row = None if last else (part, batch.column(0)[k], t, own)
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(arrow)]
            ident = pa.array([i.as_py() for i in ids], batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([ident, *columns], schema.names)

    small_batches(df.sparkSession)
    return _neighbours(df, key, text).mapInArrow(run, schema)
