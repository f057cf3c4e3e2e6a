"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

Both token sequences spell the same bytes.  A transducer walks them side by
side.  Its state is which side leads and by what bytes: the dangling suffix of one
token, so states are bounded by the vocabularies.  The side behind gives the next
token; what then dangles is the next state.  Transitions are memoised by state and
token.  An empty residual closes a group, the least run of tokens that starts and ends at
common borders.  Tokens of a group are linked, each of one side with each of the other.

Over the corpus an id pair is counted once for each document that links it.
Counts go back to documents by two ways that give the same rows: pairs counted in many
documents, at most ``FREQUENT`` of them, are broadcast; all others are joined by pair, where no
key has more rows than the least count that is broadcast.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the text (characters that a
vocabulary loses or changes), have no tokens; special tokens' strings are plain text; every row is a document, rows
of equal or null id too; other columns do not matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import bpe
from .scratch import Scratch, small_batches

#: Id pairs that are broadcast at most (24 bytes each).
FREQUENT = 1 << 20
#: Transitions and links of groups remembered by a worker; the memory is emptied when full, results do not depend on it.
MEMO = 1 << 20
#: Links of a group above which equal ids are multiplied by their numbers instead of being listed.
WIDE = 4096
ROW = "_loom_row"


class Groups(NamedTuple):
    """Of each group its ids as text, in order; the packed pair of each link; the tokens (from, to, from, to) of groups of more than ``WIDE`` links."""

    said: list[str]
    pairs: list[int]
    wide: list[tuple[int, int, int, int]]


class Transducer:
    """Walks two token sequences by their bytes; state 0 is the empty residual."""

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.sides = (left, right)
        self.forget()

    def forget(self) -> None:
        self.known: dict[tuple[int, bytes], int] = {(1, b""): 0}
        self.states: list[tuple[int, bytes]] = [(1, b"")]
        #: Of each state the next state by token of the side behind; -1 where the bytes differ.
        self.moves: list[dict[int, int]] = [{}]
        #: Groups of one token a side, by the packed pair: two transitions at once.
        self.closed: dict[int, str] = {}
        #: Other groups by their ids: as text, and their links.
        self.runs: dict[tuple[tuple[int, ...], tuple[int, ...]], tuple[str, list[int]]] = {}
        self.size = 0

    def move(self, state: int, token: int) -> int:
        leads, residual = self.states[state]
        behind = 1 - leads
        new = self.sides[behind][token]
        if not new:
            follows = -1
        elif residual.startswith(new):
            follows = self._state(leads, residual[len(new) :])
        elif new.startswith(residual):
            follows = self._state(behind, new[len(residual) :])
        else:
            follows = -1
        self.moves[state][token] = follows
        self.size += 1
        return follows

    def _state(self, leads: int, residual: bytes) -> int:
        name = (leads, residual) if residual else (1, b"")
        if name not in self.known:
            self.known[name] = len(self.states)
            self.states.append(name)
            self.moves.append({})
        return self.known[name]

    def groups(self, left: list[int], right: list[int]) -> Groups | None:
        """The groups of two sequences; None if they spell different bytes."""
        if self.size > MEMO:
            self.forget()
        i = j = state = 0
        n, m, moves, states, closed, width = len(left), len(right), self.moves, self.states, self.closed, len(self.sides[1])
        said: list[str] = []
        pairs: list[int] = []
        wide: list[tuple[int, int, int, int]] = []
        while i < n and j < m:
            pair = left[i] * width + right[j]
            name = closed.get(pair)
            if name is not None:  # one token of each side, known to spell the same
                i += 1
                j += 1
                said.append(name)
                pairs.append(pair)
                continue
            from_i, from_j = i, j
            while True:
                if states[state][0]:  # the right side leads, or none does
                    if i == n:
                        return None
                    token = left[i]
                    i += 1
                else:
                    if j == m:
                        return None
                    token = right[j]
                    j += 1
                follows = moves[state].get(token)
                if follows is None:
                    follows = self.move(state, token)
                if follows < 0:
                    return None
                state = follows
                if not state:
                    break
            if i - from_i == j - from_j == 1:
                closed[pair] = name = f"{left[from_i]}|{right[from_j]}"
                self.size += 1
                said.append(name)
                pairs.append(pair)
                continue
            if (i - from_i) * (j - from_j) > WIDE:
                said.append(f"{','.join(map(str, left[from_i:i]))}|{','.join(map(str, right[from_j:j]))}")
                wide.append((from_i, i, from_j, j))
                continue
            run = tuple(left[from_i:i]), tuple(right[from_j:j])
            found = self.runs.get(run)
            if found is None:
                found = f"{','.join(map(str, run[0]))}|{','.join(map(str, run[1]))}", [x * width + y for x in run[0] for y in run[1]]
                self.runs[run] = found
                self.size += len(found[1])
            said.append(found[0])
            pairs += found[1]
        return Groups(said, pairs, wide) if i == n and j == m else None


class Aligner:
    """Two vocabulary files: byte-level BPE in the tokenizers format, and a sentencepiece model."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.byte_bpe = bpe.RankArrayBPE(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        a, n = self.byte_bpe.token_bytes, self.pieces.vocab_size()
        left = [a.get(k, b"") for k in range(max(a) + 1)]
        right = [self._piece_bytes(k) for k in range(n)]
        self.width = n
        self.left, self.right = left, right
        self.left_ids = self._left_encoder()
        self.transducer = Transducer(left, right)

    def _piece_bytes(self, k: int) -> bytes:
        piece = self.pieces.id_to_piece(k)
        if self.pieces.is_byte(k):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode("utf-8")

    def _left_encoder(self) -> Callable[[str], list[int]]:
        """Where ids follow the order of merges, as they do in public files, the installed ranked encoder gives the same ids at less cost; else the encoder of operator 1."""
        own = self.byte_bpe
        merged = [made for _, made in sorted(own.pair.values())]
        if merged != sorted(merged) or max(own.byte_id) >= min(merged, default=1 << 31):
            return lambda text: np.frombuffer(own.ordinary(text), np.uint32).tolist()
        import tiktoken

        special = set(own.special.values())
        ranks = {x: k for k, x in own.token_bytes.items() if k not in special}
        return tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a space and the text by the first vocabulary, which loses no byte, and of the text by the second, which adds the space."""
        return self.left_ids(" " + text), self.pieces.encode(text, num_threads=1)

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Numbers of left and right tokens, groups and links, the digest of the groups, the distinct linked id pairs and how often each."""
        none = np.zeros(0, np.int64)
        if not text:
            return 0, 0, 0, 0, "", none, none
        a, b = self.encode(text)
        groups = self.transducer.groups(a, b)
        if groups is None:
            return 0, 0, 0, 0, "", none, none
        pairs, times = self.links(a, b, groups)
        return len(a), len(b), len(groups.said), int(times.sum()), hashlib.sha256(";".join(groups.said).encode()).hexdigest(), pairs, times

    def links(self, a: list[int], b: list[int], groups: Groups) -> tuple[np.ndarray, np.ndarray]:
        """The distinct id pairs of all groups, packed as left id x ``width`` + right id, and how often each is linked."""
        found, width = Counter(groups.pairs), self.width
        pairs, times = (np.fromiter(side, np.int64, len(found)) for side in (found.keys(), found.values()))
        if not groups.wide:
            return pairs, times
        more, often = [pairs], [times]
        for i, x, j, y in groups.wide:
            (left, n), (right, m) = (np.unique(ids, return_counts=True) for ids in (a[i:x], b[j:y]))
            more.append(np.add.outer(left * width, right).ravel())
            often.append(np.multiply.outer(n, m).ravel())
        pairs, names = np.unique(np.concatenate(more), return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, names, np.concatenate(often))
        return pairs, times


@functools.lru_cache(maxsize=1)
def load(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


_COLUMNS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}


def align(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: key, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs with their times.  A narrow map: no shuffle."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(byte_path, piece_path)
        for batch in batches:
            made = list(zip(*map(aligner.align, batch.column(1).to_pylist()), strict=True)) or [()] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made, _COLUMNS.values())], [key, *_COLUMNS])

    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.list_(pa.int64()): T.ArrayType(T.LongType())}
    return df.select(key, text).mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, kinds[t]) for n, t in _COLUMNS.items())]))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): in how many rows of ``aligned`` each id pair is linked, and 1 if no pair of the same left id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    of_left = W.partitionBy(F.floor(F.col("pair") / F.lit(width)))  # at most ``width`` pairs each
    return counts.withColumn("best", (F.col("docs") == F.max("docs").over(of_left)).cast("long"))


def _least_broadcast(counts: DataFrame, bound: int) -> int:
    """The least power of two such that at most ``bound`` pairs are in that many documents or more."""
    sizes = counts.groupBy(F.floor(F.log2("docs")).alias("power")).agg(F.count("*").alias("n")).collect()
    total, least = 0, 62
    for power, n in sorted(((int(r["power"]), r["n"]) for r in sizes), reverse=True):
        total += n
        if total > bound:
            break
        least = power
    return 0 if least == min((int(r["power"]) for r in sizes), default=0) else 1 << least


def alignment_report(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row for each text: the numbers of ``align``, n_best (links whose pair no pair of its left id outnumbers) and count_sum (documents of the pair, over all links)."""
    import sentencepiece

    scratch = Scratch(df.sparkSession, "align")
    aligned = scratch.save(align(df, byte_path, piece_path, key, text).withColumn(ROW, F.monotonically_increasing_id()), "aligned")
    width = sentencepiece.SentencePieceProcessor(model_file=piece_path).vocab_size()
    counts = scratch.save(pair_counts(aligned, width), "counts")
    least = _least_broadcast(counts, frequent)
    links = aligned.select(ROW, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(ROW, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    often = counts.where(F.col("docs") >= least)
    known = links.join(F.broadcast(often), "pair")
    if least:
        rest = links.join(F.broadcast(often.select("pair")), "pair", "left_anti")
        known = known.unionByName(rest.join(counts.where(F.col("docs") < least).hint("merge"), "pair"))
    sums = known.groupBy(ROW).agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.select(ROW, key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums.hint("merge"), ROW, "left").select(
        key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
