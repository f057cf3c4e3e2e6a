"""Language of a text by naive Bayes over letter n-grams, whose counts are Spark aggregates.

Each text gives the 1- to 3-grams of its words, spaced at both ends, from its first ``CHARS`` characters; so much is
read by definition of the feature.  A language's log probability of a gram is
smoothed by one.  The model keeps the ``GRAMS`` grams of most texts, so its size does not grow with the corpus.

Defined results: texts of at most ``LEAST`` characters, null ones and ones without a
known gram have no language (empty string); of equal scores the smaller code
wins; rows of null language are not learned from; other columns do not matter.

A task holds the grams of ``SLICE`` texts, as numbers: the code points of a gram, ``BITS`` bits each.  Texts are cut
before they go to Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch

CHARS, LEAST, SIZES, GRAMS = 1500, 20, (1, 2, 3), 30_000
#: Texts whose grams are held at a time, and the bits of a code point in the number of a gram.
SLICE, BITS = 256, 21
_NO_LETTER = re.compile(r"[\W\d_]+")


def _spaced(text: str | None) -> str:
    return " " + _NO_LETTER.sub(" ", (text or "")[:CHARS].lower()) + " "


def grams_of(text: str | None) -> list[str]:
    """The n-grams of the words of a text's first characters, repeats included."""
    spaced = _spaced(text)
    return [g for n in SIZES for g in (spaced[i : i + n] for i in range(len(spaced) - n + 1)) if g.strip()]


def number_of(gram: str) -> int:
    return sum(ord(c) << (BITS * i) for i, c in enumerate(gram))


def gram_of(number: int) -> str:
    return "".join(chr(c) for i in SIZES if (c := number >> (BITS * (i - 1)) & ((1 << BITS) - 1)))


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number, text) of the grams of ``grams_of`` each text, those of one text in its order."""
    spaced = [_spaced(t) for t in texts]
    points = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in spaced])
    numbers, rows, made, blank = [], [], np.zeros(len(points), np.int64), 0
    for n in SIZES:
        made = made[: len(points) - n + 1] + (points[n - 1 :] << (BITS * (n - 1)))
        blank += ord(" ") << (BITS * (n - 1))
        kept = (of[n - 1 :] == of[: len(made)]) & (made != blank)
        numbers.append(made[kept])
        rows.append(of[: len(made)][kept])
    return np.concatenate(numbers), np.concatenate(rows)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    grams: tuple[str, ...]
    log_p: np.ndarray  # of each gram and language
    prior: np.ndarray


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of batches of (lang, text)."""
    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, t in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            texts.setdefault(lang, []).append(t)
        for lang, some in texts.items():
            parts = [np.unique(numbered(some[at : at + SLICE])[0], return_counts=True) for at in range(0, len(some), SLICE)]
            found, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(place, np.concatenate([p[1] for p in parts]), minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([gram_of(g) for g in found.tolist()], pa.string()), pa.array(n)], ["lang", "gram", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", grams: int = GRAMS) -> Model:
    """Counts over all labelled texts; what reaches the driver are numbers of the kept grams, by language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.substring(text, 1, CHARS).alias("text"))
    priors = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    counts = rows.mapInArrow(count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = Scratch(docs.sparkSession, "language").save(counts, "counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    kept = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy(F.desc("all"), "gram").limit(grams).collect()
    langs = tuple(sorted(priors))
    table = np.array([[r["by"].get(c, 0) for c in langs] for r in kept], float).reshape(len(kept), len(langs))
    size = np.array([totals.get(c, 0) for c in langs]) + len(kept) + 1
    n = sum(priors.values())
    return Model(langs, tuple(r.gram for r in kept), np.log((table + 1) / size), np.log(np.array([priors[c] / n for c in langs])) if n else np.zeros(0))


def judge(batch: pa.RecordBatch, model: Model, order: np.ndarray, known: np.ndarray) -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
    """(keys, languages, shares) of the texts (key, text) of a batch, by slices; ``known`` are the sorted numbers of the model's grams, ``order`` their places."""
    for at in range(0, batch.num_rows, SLICE):
        some = batch.slice(at, SLICE)
        texts = some.column(1).to_pylist()
        numbers, row = numbered(texts)
        # what is too short counts no gram
        place = np.minimum(np.searchsorted(known, numbers), max(0, len(known) - 1))
        hit = np.array([t is not None and len(t) > LEAST for t in texts], bool)[row] & (known[place] == numbers if len(known) else False)
        found, row = order[place[hit]], row[hit]
        scores = np.tile(model.prior, (len(texts), 1)) if len(model.langs) else np.zeros((len(texts), 1))
        hits = np.bincount(row, minlength=len(texts))
        if len(row):
            for k in range(len(model.langs)):
                scores[:, k] += np.bincount(row, model.log_p[found, k], minlength=len(texts))
        best = scores.argmax(axis=1)
        share = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        yield some.column(0), [model.langs[b] if h else "" for b, h in zip(best, hits, strict=True)], np.where(hits > 0, share, 0.0)


def detect(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, share): the likeliest language of each text and its posterior of one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        numbers = np.array([number_of(g) for g in m.grams], np.int64)
        order = np.argsort(numbers)
        for batch in batches:
            for keys, langs, share in judge(batch, m, order, numbers[order]):
                yield pa.RecordBatch.from_arrays([keys, pa.array(langs, pa.string()), pa.array(share)], out.names)

    return docs.select(key, F.substring(text, 1, max(CHARS, LEAST + 1)).alias(text)).mapInArrow(run, out)
