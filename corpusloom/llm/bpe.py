"""Byte-level BPE encoding and decoding by contiguous rank arrays.

A word is a short list of parts.  Beside it lies the list of the ranks of
adjacent pairs; the leftmost minimum of that list is the next merge.  A merge
deletes one boundary and refreshes the ranks of its two neighbours only.
Scanning a list of a dozen numbers beats any tree, and a word is seen once for
each worker's bounded cache.  Long words, where repeated scans would cost the
square of the length, are merged through a heap with the same order.

The vocabulary file is a parameter; every worker reads it once.

Defined results: null text is the empty text (no tokens); a special token's
string in the text is that token, as in the public library; in decoding, null
ids give null, and null, negative and unknown ids give nothing; extra columns of
the input are kept, and input columns named like an output are replaced.  A
vocabulary file whose settings differ from those built in here is an error.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import small_batches

#: Words of more bytes than this are merged through a heap.
SHORT_WORD_BYTES = 96
#: Words remembered by one worker; the cache is emptied when full.
CACHE_WORDS = 1 << 19
#: Characters of a text that are cut into words at a time; results do not depend on it.
PART_CHARS = 1 << 19
_NONE = 1 << 60

# Fixed value: the word pattern of the byte-level vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files.

    Bytes that print stand for themselves; the others, in order, take the code
    points from 256 on.
    """
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in printing}
    hidden = [b for b in range(256) if b not in set(printing)]
    out.update({chr(256 + k): b for k, b in enumerate(hidden)})
    return out


# The settings of a vocabulary file that this encoder follows; absent ones are as good.
_SETTINGS = {
    "normalizer": (None,),
    "pre_tokenizer": ({"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},),
}
_MODEL = {"type": ("BPE",), "dropout": (None, 0.0), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "byte_fallback": (False,), "ignore_merges": (False,)}
_TOKEN_FLAGS = {"single_word": (False,), "lstrip": (False,), "rstrip": (False,), "normalized": (False,)}


def check_settings(spec: dict) -> None:
    """Raises if the file asks for anything that would give other ids than this encoder's."""
    wrong = {k: spec.get(k) for k, allowed in _SETTINGS.items() if spec.get(k) not in allowed}
    wrong |= {f"model.{k}": spec["model"][k] for k, allowed in _MODEL.items() if k in spec["model"] and spec["model"][k] not in allowed}
    wrong |= {f"token {t['content']!r} {k}": t[k] for t in spec.get("added_tokens", []) for k, allowed in _TOKEN_FLAGS.items() if k in t and t[k] not in allowed}
    if wrong:
        raise ValueError(f"vocabulary settings that are not supported: {wrong}")


_GAP = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")


class RankArrayBPE:
    """Encoder and decoder of one vocabulary file in the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        model, to_byte = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: dict[int, bytes] = {
            i: bytes(to_byte[c] for c in token) for token, i in vocab.items() if all(c in to_byte for c in token)
        }
        self.token_bytes.update({i: s.encode() for s, i in self.special.items()})
        self.byte_id = [vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.pair: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pair[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.words = regex.compile(WORD_PATTERN).findall
        self.specials = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )
        self.cache: dict[str, bytes] = {}

    def merge_short(self, word: bytes) -> list[int]:
        pair = self.pair
        parts = [self.byte_id[b] for b in word]
        none = (_NONE, 0)
        found = [pair.get(a << 32 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        ranks = [r for r, _ in found]
        made = [m for _, m in found]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = made[i]
            del parts[i + 1], ranks[i], made[i]
            if i:
                ranks[i - 1], made[i - 1] = pair.get(parts[i - 1] << 32 | parts[i], none)
            if i < len(ranks):
                ranks[i], made[i] = pair.get(parts[i] << 32 | parts[i + 1], none)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges in the same order, n log n: a heap of (rank, place) over a linked list."""
        pair, n = self.pair, len(word)
        ids = [self.byte_id[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := pair.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (p := pair.get(ids[i] << 32 | ids[after[i]])):
                heapq.heappush(heap, (p[0], i, ids[i], ids[after[i]], p[1]))

        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers, remembered."""
        data = word.encode("utf-8")
        ids = self.merge_short(data) if len(data) <= SHORT_WORD_BYTES else self.merge_long(data)
        packed = array("I", ids).tobytes()
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        if len(data) <= SHORT_WORD_BYTES:
            self.cache[word] = packed
        return packed

    def ordinary(self, text: str) -> bytes:
        cached, word = self.cache.get, self.word
        if len(text) <= PART_CHARS:
            return b"".join([cached(w) or word(w) for w in self.words(text)])
        return b"".join([b"".join([cached(w) or word(w) for w in self.words(part)]) for part in self.pieces(text)])

    def pieces(self, text: str) -> Iterator[str]:
        """A long text in parts.  A white space after another character always starts a word, so no word is cut."""
        at = 0
        while len(text) - at > PART_CHARS and (gap := _GAP.search(text, at + PART_CHARS)):
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; special tokens' strings are the tokens."""
        if not text:
            return b""
        if self.specials is None or not self.specials.search(text):
            return self.ordinary(text)
        return b"".join(
            array("I", [self.special[piece]]).tobytes() if k % 2 else self.ordinary(piece)
            for k, piece in enumerate(self.specials.split(text))
        )

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; unknown ids give nothing, bytes that are no UTF-8 the replacement character."""
        get, step = self.token_bytes.get, 4 * PART_CHARS
        parts = (array("I", packed[k : k + step]) for k in range(0, len(packed), step))
        return b"".join([b"".join([get(i, b"") for i in part]) for part in parts]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> RankArrayBPE:
    return RankArrayBPE(path)


def _with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(batch.schema.get_field_index(n)) for n in keep), *columns.values()], [*keep, *columns]
    )


def _schema(df: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType(
        [f for f in df.schema.fields if f.name not in added] + [T.StructField(n, t) for n, t in added.items()]
    )


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """Adds the token ids of ``text`` (array of int) and their number.  A narrow map: no shuffle."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            packed = [bpe.encode(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            offsets, at = [0], 0
            for p in packed:
                at += len(p) // 4
                offsets.append(at)
            flat = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(packed))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield _with_columns(batch, {ids: lists, count: pa.array([len(p) // 4 for p in packed], pa.int64())})

    return df.mapInArrow(run, _schema(df, **{ids: T.ArrayType(T.IntegerType()), count: T.LongType()}))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for; null ids give null, null elements are skipped."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if x is None else bpe.decode(array("I", [i for i in x if i is not None and i >= 0]).tobytes()) for x in lists]
            yield _with_columns(batch, {text: pa.array(texts, pa.string())})

    return df.mapInArrow(run, _schema(df, **{text: T.StringType()}))


def encode_digests(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text; one row each: key, n_tokens, SHA-256 of the packed ids and of the decoded text."""
    small_batches(df.sparkSession)
    out = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            n, ids, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                packed = bpe.encode(t)
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(packed).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], out.names
            )

    return df.select(key, text).mapInArrow(run, out)
