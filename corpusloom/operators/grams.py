"""Word n-grams as 64-bit hashes, made from hashes of the words.

Words are cut and hashed by Spark; the hash of an n-gram is a polynomial of its
words' hashes, worked out for a whole batch at once.  Two different grams agree
with a chance of 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without null elements; a null list is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.zeros(len(column) + 1, np.int64)
    np.cumsum(np.asarray(column.value_lengths().fill_null(0)), out=n[1:])
    return column.flatten().to_numpy(zero_copy_only=False), n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the n-grams of one text's word hashes, repeats included; a shorter text is one gram, an empty one none."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    words = words.astype(np.int64).view(np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * _BASE + _mixed(words[i : i + len(out)] + np.uint64(1))
    return _mixed(out ^ np.uint64(k))
