"""Quality rules: compression bands, behind a few word counts.

Text that repeats itself compresses far below prose, random or encoded text hardly
at all.  The Zstandard ratio (bytes behind over bytes before) of the whole text and of
each chunk of ``CHUNK`` bytes must lie in the band of its length: short texts have
less to refer back to and so a higher ratio.  A text is rejected if its own ratio
is out of band, or if more than ``STRAY`` of its bytes lie in chunks that are:
the whole text finds repeats far apart, chunks a bad part of a good text.  A last chunk under ``LEAST``
bytes says too little and is not judged.

Base rules come first: under 50 words, or over half of the words in repeated
three-word windows, fail.

Defined results: null text is the empty text, without words, and fails; every row is judged on its own,
so repeated rows and null ids are rows like others; other columns do not matter.
Ratios are those of the installed Zstandard at ``LEVEL``; another version may differ in the third digit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import small_batches

#: Bytes of a text or chunk (below), lowest and highest ratio.  Prose has 0.50 to 0.75 in 300 bytes, 0.35 to 0.55 in 20,000; base64 0.76 at any length.
BANDS = ((512, 0.38, 0.95), (1024, 0.36, 0.88), (2048, 0.34, 0.80), (4096, 0.32, 0.76), (16384, 0.28, 0.72), (1 << 62, 0.20, 0.70))
LEVEL, CHUNK, LEAST, STRAY = 3, 4096, 512, 0.25
MIN_WORDS, MAX_REPEAT, WINDOW = 50, 0.5, 3
SYMBOLS = "#*$%&|<>"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    if len(words) < size:
        return 0
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    name = ids[: len(ids) - size + 1]
    for k in range(1, size):  # names of windows one word longer; they stay below the number of words
        name = np.unique(name * len(index) + ids[k : len(ids) - size + 1 + k], return_inverse=True)[1]
    often = np.bincount(name)[name] > 1
    marked = np.zeros(len(ids), bool)
    for k in range(size):
        marked[k : k + len(often)] |= often
    return int(marked.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, found = set(), 0
    for line in text.split("\n"):
        if line in seen:
            found += 1
        elif _WORDS.search(line):
            seen.add(line)
    return found


def in_band(n_bytes: int, ratio: float, bands: Sequence[tuple[int, float, float]] = BANDS) -> bool:
    low, high = next((low, high) for below, low, high in bands if n_bytes < below)
    return low <= ratio <= high


def stray_share(raw: bytes, packer: zstandard.ZstdCompressor, bands: Sequence[tuple[int, float, float]] = BANDS) -> float:
    """The share of the judged bytes that lie in chunks out of band."""
    judged = stray = 0
    view = memoryview(raw)
    for at in range(0, len(raw), CHUNK):
        part = view[at : at + CHUNK]
        if len(part) >= LEAST:
            judged += len(part)
            stray += 0 if in_band(len(part), len(packer.compress(part)) / len(part), bands) else len(part)
    return stray / judged if judged else 0.0


_COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "ratio": pa.float64(), "stray_share": pa.float64(), "kept": pa.bool_(),
}


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", bands: Sequence[tuple[int, float, float]] = BANDS) -> DataFrame:
    """One row for each text: key, counts, base_failed, ratio (null without bytes), stray_share and kept.  A narrow map: no shuffle."""
    small_batches(df.sparkSession)
    if [b[0] for b in bands] != sorted({b[0] for b in bands}):
        raise ValueError("bands must rise by length")
    bands = (*bands, (1 << 62, *bands[-1][1:]))

    def one(t: str | None, packer: zstandard.ZstdCompressor) -> tuple:
        t = t or ""
        words, raw = _WORDS.findall(t), t.encode("utf-8")
        repeats = repeated_words(words)
        failed = len(words) < MIN_WORDS or repeats > MAX_REPEAT * len(words)
        ratio = len(packer.compress(raw)) / len(raw) if raw else None
        stray = stray_share(raw, packer, bands)
        kept = not failed and in_band(len(raw), ratio, bands) and stray <= STRAY
        return len(words), sum(map(len, words)), sum(map(t.count, SYMBOLS)), repeated_lines(t), repeats, failed, ratio, stray, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            made = list(zip(*(one(t, packer) for t in batch.column(1).to_pylist()), strict=True)) or [()] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made, _COLUMNS.values())], [key, *_COLUMNS])

    kinds = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType()}
    out = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, kinds[t]) for n, t in _COLUMNS.items())])
    return df.select(key, text).mapInArrow(run, out)
