"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed letter n-grams (1 to 3 letters, word
ends included), scaled to length one.  Each language has several centroids,
found by spherical k-means over its labelled texts, so that a language with
distinct kinds of text is not averaged into one.  A text gets the language of
the centroid of largest cosine.

Rejection is by distance: each centroid has a floor, and a text below the floor
of its nearest centroid is too far from every language.  The floor lies below
the cosine that all but ``REJECTED_SHARE`` of its own training texts reach, by
half of what parts that cosine from their median, since texts that had no part
in a centroid lie farther from it.  ``predict`` says so in
``rejected``; with ``und_if_rejected`` such a text becomes ``und``.

Learning is bounded: at most ``PER_LANGUAGE`` texts of a language and
``SAMPLE`` in all, chosen by a hash of the id over all labelled rows.

Defined results: null text, and text without a letter, is ``und`` with score 0;
so is everything where nothing could be learned; a text whose n-grams were
never seen gets the language with most labelled texts and is rejected, as are
texts without a letter; repeated rows are predicted each; null and ``und``
languages are not learned; other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .scratch import Scratch, small_batches
from .toxicity import held_out

PER_LANGUAGE, SAMPLE = 800, 6_400
DIMENSIONS, CENTROIDS = 4096, 4
#: Share of a centroid's own training texts that lie below its floor.
REJECTED_SHARE = 0.002
UNKNOWN = "und"
_LETTER: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points, of all planes, are letters (categories L*)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])
    return _LETTER[codes]


#: Characters of a text that are counted at a time; results do not depend on it.
PART_CHARS = 1 << 18


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, or None if it has no letter.

    A word stands between zeros.  Position i of the text so padded begins one
    gram of each length; a part reads two code points beyond its last position,
    so grams over an edge are counted once and none is made up.
    """
    text = (text or "").lower()
    total, seen = np.zeros(DIMENSIONS, np.int64), False
    for at in range(0, len(text) + 1, PART_CHARS):
        stop = min(len(text) + 1, at + PART_CHARS)
        codes = np.zeros(stop - at + 2, np.int64)
        read = np.frombuffer(text[max(0, at - 1) : stop + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[(at == 0) : (at == 0) + len(read)] = np.where(_letters(read), read, 0)
        if codes.any():
            seen = True
            total += _counts(codes)
    return total.astype(np.float32) if seen else None


def _counts(codes: np.ndarray) -> np.ndarray:
    """Counts of the grams that begin at each position but the last two: one letter (the second), two, three."""
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    two = first * 0x9E3779B1 + second * 0x85EBCA77
    three = two + third * 0xC2B2AE3D
    grams = np.concatenate((second[second != 0] * 0x27D4EB2F, two[(first != 0) | (second != 0)], three[second != 0]))
    return np.bincount(((grams ^ (grams >> 15)) * 0x2C1B3C6D >> 12) & (DIMENSIONS - 1), minlength=DIMENSIONS)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from the farthest-first points; deterministic."""
    at = [0]
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    centres = x[at]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = unit(np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    default: str
    idf: np.ndarray
    centres: np.ndarray  # centroid by dimension
    owner: np.ndarray  # the language of each centroid
    floors: np.ndarray  # the least cosine to each centroid that is not rejected

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return unit(np.log1p(rows) * self.idf)

    def predict(self, texts: list[str | None], reject: float = 0.0) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine and rejection of each text; below ``reject``, which no floor undercuts, the language is ``und`` too."""
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        known = [(i, c) for i, t in enumerate(texts) if (c := counts(t)) is not None] if self.languages else []
        if known:
            cosines = self.vectors(np.stack([c for _, c in known])) @ self.centres.T
            best = cosines.argmax(axis=1)
            for (i, _), row, b in zip(known, cosines, best.tolist(), strict=True):
                s = float(min(1.0, max(0.0, row[b])))
                rejected[i] = bool(s <= 0 or s < self.floors[b] or s < reject)
                if s >= reject:
                    langs[i], scores[i] = (self.languages[self.owner[b]] if s > 0 else self.default), s
        return langs, scores, rejected


def floors_of(x: np.ndarray, centres: np.ndarray, share: float = REJECTED_SHARE) -> np.ndarray:
    """The floor of each centroid, from the cosines of the texts nearest to it; 0 where there are none."""
    cosines = x @ centres.T
    own, best = cosines.argmax(axis=1), cosines.max(axis=1)
    ends = [np.quantile(best[own == c], (share, 0.5)) if (own == c).any() else (0.0, 0.0) for c in range(len(centres))]
    return np.array([max(0.0, low - (middle - low) / 2) for low, middle in ends])


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, bound: int = SAMPLE) -> Model:
    """Fits on a bounded sample of the labelled rows outside the held-out ones; the driver sees count vectors, no texts."""
    small_batches(df.sparkSession)
    df = df.select(key, text, lang)
    scratch = Scratch(df.sparkSession, "langid")
    usable = df.where(F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    said = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    ids = usable.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(F.lit("langid"), F.col(key)).alias("h"), said.alias("t"))
    # the smallest hashes of each language lie below a bound that its count gives; only those few are ranked
    share = F.lit(2.0 * per_language + 200) / F.col("of")
    small = (F.col("h").cast("double") / 2.0**64 + 0.5) < share
    ids = ids.join(F.broadcast(ids.groupBy("lang").agg(F.count("*").alias("of")).orderBy(F.desc("of"), "lang").limit(bound)), "lang").where(small).groupBy("key", "lang", "h").agg(F.min("t").alias("t"))  # one text of each id
    ranked = ids.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "key"))).where(F.col("n") <= per_language)
    chosen = scratch.save(ranked.orderBy("n", "lang").limit(bound).select(F.col("key").alias("chosen"), F.col("lang").alias("of"), F.col("t").alias("said")), "chosen")
    texts = df.join(F.broadcast(chosen), (F.col(key) == F.col("chosen")) & (F.col(lang) == F.col("of")) & (said == F.col("said")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [c.tobytes() if (c := counts(t)) is not None else None for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(made, pa.binary())], ["key", "lang", "v"])

    rows = texts.select(key, lang, text).mapInArrow(run, "key string, lang string, v binary").where("v IS NOT NULL").dropDuplicates(["key", "lang"]).toArrow().to_pylist()
    rows = sorted(rows, key=lambda r: (r["lang"], r["key"], r["v"]))
    if not rows:
        return Model((), UNKNOWN, np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in rows])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = unit(np.log1p(x) * idf)
    of = np.array([r["lang"] for r in rows])
    languages = sorted(set(of.tolist()))
    centres = [kmeans(x[of == name], CENTROIDS) for name in languages]
    owner = np.concatenate([[i] * len(c) for i, c in enumerate(centres)])
    most = max(languages, key=lambda name: (int((of == name).sum()), name))
    centres = np.concatenate(centres)
    return Model(tuple(languages), most, idf, centres, owner, floors_of(x, centres))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", reject: float = 0.0, und_if_rejected: bool = False) -> DataFrame:
    """One row for each document: key, held_out, lang_pred, score, rejected.  A narrow map over whole texts."""
    small_batches(df.sparkSession)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([df.schema[key], *added])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = sent.value.predict(batch.column(1).to_pylist(), reject)
            if und_if_rejected:
                langs = [UNKNOWN if r else x for x, r in zip(langs, rejected, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], schema.names)

    found = df.select(key, text).mapInArrow(run, schema)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "rejected")
