"""Fill-in-middle: a text is cut twice at unit borders, and its middle is moved to the end.

A text is stored as its maximal runs of one character class, each with the
number of units that end in it and the cumulative number up to its end.  A cut
behind ``k`` units is a binary search for the run that holds the end of the k-th
unit; within the run the offset follows from arithmetic, as all its units are
equally long.  The units themselves are never listed.

Units: ``line`` (up to and with its newline), ``word`` (with the ASCII white space before it;
white space at the end is a unit of its own) or ``char``.

Defined results: null text is the empty text; empty texts, texts that contain a
sentinel and those left out by ``rate`` stay plain; cuts hang on the seed and
the id only (a null id counts as the empty string), so reruns agree and rows of equal id are cut at
equal shares; input columns named like an output are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _schema, _with_columns
from .scratch import small_batches

#: Sentinels in front of prefix, suffix and middle; percent of texts that are changed, and of those in the order suffix, prefix, middle.
SENTINELS, RATE, SPM = ("<P>", "<S>", "<M>"), 100, 50
SEED, UNIT = 7, "line"


class Runs(NamedTuple):
    """Of each maximal run its first code point and length, the units that end in it and those up to its end."""

    start: np.ndarray
    length: np.ndarray
    units: np.ndarray
    total: np.ndarray

    @property
    def count(self) -> int:
        return int(self.total[-1]) if len(self.total) else 0


def encode_runs(text: str, unit: str = UNIT) -> Runs:
    """The runs of a text; a run's units are equally long, and a run without units ends none."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if unit == "line":
        inside = codes == 10
    elif unit == "word":
        inside = (codes == 32) | (codes - np.uint32(9) < 5)
    elif unit == "char":
        inside = np.ones(len(codes), bool)
    else:
        raise ValueError(f"unknown unit {unit!r}")
    border = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start = np.concatenate([np.zeros(min(1, len(codes)), np.int64), border])
    length = np.diff(np.append(start, len(codes)))
    if unit == "word":
        units = np.where(inside[start], 0, 1)
    else:
        units = np.where(inside[start], length, 0)
    if len(units) and not units[-1]:
        units[-1] = 1  # what is left at the end is a unit
    return Runs(start, length, units, np.cumsum(units))


def cut(runs: Runs, k: int) -> int:
    """The code points in the first ``k`` units."""
    if not k:
        return 0
    r = int(np.searchsorted(runs.total, k))
    within = k - int(runs.total[r] - runs.units[r])
    return int(runs.start[r]) + within * int(runs.length[r] // runs.units[r])


def draws(key: object, seed: int) -> tuple[int, ...]:
    """Four 32-bit numbers from the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def transform(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = UNIT,
    rate: int = RATE,
    spm: int = SPM,
    seed: int = SEED,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """Adds n_units, form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output.  A narrow map: no shuffle."""
    small_batches(df.sparkSession)
    p, s, m = sentinels

    def one(value: object, t: str | None) -> tuple:
        t = t or ""
        runs = encode_runs(t, unit)
        h1, h2, h3, h4 = draws(value, seed)
        if not t or any(x in t for x in sentinels) or h3 % 100 >= rate:
            return runs.count, "plain", None, None, t
        ends = sorted((h1 % (runs.count + 1), h2 % (runs.count + 1)))
        a, b = (cut(runs, k) for k in ends)
        if h4 % 100 < spm:
            return runs.count, "spm", a, b - a, f"{s}{t[b:]}{p}{t[:a]}{m}{t[a:b]}"
        return runs.count, "psm", a, b - a, f"{p}{t[:a]}{s}{t[b:]}{m}{t[a:b]}"

    added = {"n_units": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, text))
            made = list(zip(*map(one, keys, texts), strict=True)) or [()] * len(added)
            yield _with_columns(batch, {n: pa.array(c, t) for n, c, t in zip(added, made, types, strict=True)})

    return df.mapInArrow(run, _schema(df, **added))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output stands for: its three parts are found by their sentinels, which no part contains."""
    p, s, m = sentinels

    def part(mark: str, end: str | None) -> Column:
        start = F.locate(mark, output) + len(mark)
        return F.substring(output, start, (F.locate(end, output) if end else F.length(output) + 1) - start)

    psm = F.concat(part(p, s), part(m, None), part(s, m))
    spm = F.concat(part(p, m), part(m, None), part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def cut_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: key, n, form, prefix_chars, middle_chars, the digests of the output and of the text rebuilt from it."""
    done = transform(df.select(key, text), key, text)
    return done.select(
        key, F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def oracle() -> str:
    """DuckDB SQL of ``cut_report`` over ``documents``."""
    h = ", ".join(f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    return f"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), drawn AS (SELECT *, len(u) AS n, {h} FROM lines), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
