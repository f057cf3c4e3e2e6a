"""Normal forms of texts that the JVM's column functions lack: one Arrow pass over a column."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def metric_text(text: str) -> str:
    """NFKC, HTML entities resolved, lower case, white space collapsed and stripped, in this order."""
    return " ".join(html.unescape(unicodedata.normalize("NFKC", text)).lower().split())


#: Texts of a batch that are Python strings at a time.
SLICE = 64


def _column(column: pa.Array, f) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = [pa.array([None if t is None else f(t) for t in column.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, len(column), SLICE)]
    return pa.concat_arrays([*parts, pa.array([], pa.string())])


@F.arrow_udf(StringType())
def metric_normal(texts: pa.Array) -> pa.Array:
    """``metric_text`` of a column; null stays null."""
    return _column(texts, metric_text)


@F.arrow_udf(StringType())
def compatible(texts: pa.Array) -> pa.Array:
    """NFKC of a column; null stays null."""
    return _column(texts, lambda t: unicodedata.normalize("NFKC", t))


def exact_key(text: Column) -> Column:
    """MD5 of the metric form; texts without a sign have none."""
    norm = metric_normal(text)
    return F.when(norm != "", F.md5(norm))
