"""Chat formatting with typed content parts.

A turn holds parts of four kinds: text, image, audio, document.  A visitor
walks the parts in order and flattens them: text is escaped, an attachment
becomes a numbered placeholder, its reference is recorded with its place, and
the tokens that it expands to are counted.  Placeholders are numbered, and places
of references counted, through the whole conversation.

Template: ``### role:`` and a line feed, the body, ``</turn>`` and a line feed.
Inside texts and roles, backslash, # and < are preceded by a backslash (in
roles also the colon and the line feed), so no control string can occur in a
text and every text can be read back exactly.  The loss mask covers the body of
assistant turns.

Turns are formatted where they lie.  What a turn needs to know of those before
it, how many attachments and characters, are running totals over the sorted
corpus, so a conversation of any length is dealt over many tasks.  Only its
digests are sequential: for those a conversation is streamed through one task,
which keeps one batch.

Defined results: null text is empty; null role is the empty role; null parts
are skipped; a part without a type is text; a part of another type is an error,
or an ``attachment`` of no tokens if ``strict`` is off; missing or negative
sizes count as 0; a null turn number sorts first; ties in the turn number go by
the formatted text; repeated turns are all kept; a null conversation id is a
conversation; other columns are kept unless they bear the name of an output.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranking
from .scratch import small_batches

HEAD, END = "### ", "</turn>\n"


def _words(text: str) -> int:
    return len(text.split())


@dataclass(frozen=True)
class Costs:
    """Tokens that parts expand to: a count of the text, one for each image patch, a rate for sound, a number for a page."""

    patch: int = 14
    sound_rate: float = 25
    page_tokens: int = 512
    count_text: Callable[[str], int] = _words


COSTS = Costs()

PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
ATTACHMENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("number", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("tokens", T.LongType()),
    ]
)

_TEXT, _ROLE, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:\n]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:\n]++|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _TEXT.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visitor of one turn's parts; ``numbered`` attachments come before it."""

    costs: Costs = COSTS
    numbered: int = 0
    strict: bool = True
    body: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def add(self, text: str) -> None:
        self.body.append(text)
        self.length += len(text)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.tokens += self.costs.count_text(text)
        self.add(escape(text))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.numbered + len(self.attachments) + 1
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "number": number, "at": self.length, "tokens": tokens})
        self.tokens += tokens
        self.add(f"<{kind} {number}>")

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(max(0, part.get(k) or 0) / self.costs.patch) for k in ("width", "height"))
        self.attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0
        self.attach("audio", part, math.ceil(seconds * self.costs.sound_rate) if 0 < seconds < math.inf else 0)

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(0, part.get("pages") or 0) * self.costs.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        if self.strict:
            raise ValueError(f"unknown content part {part.get('type')!r}")
        self.attach("attachment", part, 0)


def format_turn(
    role: str | None, parts: list[dict | None] | None, numbered: int = 0, costs: Costs = COSTS, strict: bool = True
) -> tuple[str, list[dict], list[dict], int]:
    """The turn's text, its loss spans, its attachments (places in the turn's text) and its expanded tokens."""
    role, flat = role or "", Flattener(costs, numbered, strict)
    for part in parts or []:
        flat.visit(part)
    head = f"{HEAD}{_ROLE.sub(lambda m: chr(92) + m[0], role)}:\n"
    spans = [{"start": len(head), "stop": len(head) + flat.length}] if role == "assistant" and flat.length else []
    for a in flat.attachments:
        a["at"] += len(head)
    return head + "".join(flat.body) + END, spans, flat.attachments, flat.tokens


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted text; placeholders stay in the text as they are."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_turns(df: DataFrame, parts: str = "parts", role: str = "role", numbered: str | None = None, costs: Costs = COSTS, strict: bool = True) -> DataFrame:
    """Adds formatted, loss_spans, attachments and tokens to rows of one turn each.  A narrow map.

    Numbers start after the value of the column ``numbered``, at 1 in every turn without it.
    """
    small_batches(df.sparkSession)
    added = {"formatted": T.StringType(), "loss_spans": T.ArrayType(SPAN), "attachments": T.ArrayType(ATTACHMENT), "tokens": T.LongType()}
    keep = [c for c in df.columns if c not in added]
    before = (F.col(numbered) if numbered else F.lit(0)).cast("long")
    read = df.select(*keep, F.col(parts).alias("_loom_parts"), F.col(role).alias("_loom_role"), before.alias("_loom_before"))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added.items()])
    kinds = [
        pa.string(),
        pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
        pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("number", pa.int64()), ("at", pa.int64()), ("tokens", pa.int64())])),
        pa.int64(),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(len(keep) + k).to_pylist() for k in range(3)]
            rows = [format_turn(r, p, n or 0, costs, strict) for p, r, n in zip(*columns, strict=True)]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], schema.names)

    return read.mapInArrow(run, schema)


def format_conversations(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", costs: Costs = COSTS, strict: bool = True
) -> DataFrame:
    """Whole conversations, a row for each turn in order: conversation, turn, position (from 1), starts_at, formatted, loss_spans, attachments, tokens.

    The texts of a conversation, joined by position, are the formatted
    conversation; ``starts_at``, loss spans and the places of attachments count
    in it.  ``summaries`` adds it up.
    """
    slim = df.select(F.col(conversation).alias("_loom_conv"), F.col(turn).alias("_loom_turn"), F.col(role).alias("_loom_of_role"), F.col(parts).alias("_loom_of_parts"))
    local = format_turns(slim, "_loom_of_parts", "_loom_of_role", costs=costs, strict=strict)
    order = ["_loom_conv", "_loom_turn", "formatted"]
    held = local.select("_loom_conv", "_loom_turn", "_loom_of_role", "_loom_of_parts", "formatted", F.size("attachments").cast("long").alias("_loom_n"))
    placed = ranking.running_totals(held, order, {"_loom_row": F.lit(1).cast("long"), "_loom_all": F.col("_loom_n")})
    firsts = placed.groupBy("_loom_conv").agg(F.min("_loom_row").alias("_loom_first"), F.min(F.col("_loom_all") - F.col("_loom_n")).alias("_loom_before"))
    firsts = firsts.withColumnRenamed("_loom_conv", "_loom_of")
    same = F.col("_loom_conv").eqNullSafe(F.col("_loom_of"))
    numbers = placed.join(firsts, same).select(
        "_loom_conv", "_loom_turn", "_loom_of_role", "_loom_of_parts",
        (F.col("_loom_row") - F.col("_loom_first") + 1).alias("position"),
        (F.col("_loom_all") - F.col("_loom_n") - F.col("_loom_before")).alias("_loom_numbered"),
    )
    made = format_turns(numbers, "_loom_of_parts", "_loom_of_role", "_loom_numbered", costs, strict).drop("_loom_of_parts", "_loom_of_role", "_loom_numbered")
    length = F.length("formatted").cast("long")
    ended = ranking.running_total(made, ["_loom_conv", "position"], length, "_loom_end")
    starts = ended.groupBy(F.col("_loom_conv").alias("_loom_of")).agg(F.min(F.col("_loom_end") - length).alias("_loom_zero"))
    at = F.col("_loom_end") - length - F.col("_loom_zero")
    return ended.join(starts, same).withColumn("starts_at", at).select(
        F.col("_loom_conv").alias(conversation), F.col("_loom_turn").alias(turn), "position", "starts_at", "formatted",
        F.transform("loss_spans", lambda s: F.struct((s["start"] + F.col("starts_at")).alias("start"), (s["stop"] + F.col("starts_at")).alias("stop"))).alias("loss_spans"),
        F.transform("attachments", lambda a: a.withField("at", a["at"] + F.col("starts_at"))).alias("attachments"),
        "tokens",
    )


def summaries(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``format_conversations``: n_turns, formatted_chars, n_attachments, tokens."""
    return formatted.groupBy(conversation).agg(
        F.count("*").alias("n_turns"), F.sum(F.length("formatted")).alias("formatted_chars"), F.sum(F.size("attachments")).alias("n_attachments"), F.sum("tokens").alias("tokens")
    )


def text_part(text: str) -> F.Column:
    """A turn's text as its only part."""
    values = {"type": F.lit("text"), "text": F.col(text)}
    return F.array(F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields]))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row for each conversation, parsed from ``formatted`` and ``loss_spans``: what the texts and the loss mask say.

    Rows are dealt by conversation and sorted; each task streams over them with
    running digests and keeps one batch.
    """
    schema = T.StructType.fromDDL(_DIGEST)
    schema.fields[0] = T.StructField(conversation, turns.schema[conversation].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None

        def close() -> list:
            n, turned, chars, lost, formatted = state
            return [open_key, n, turned.hexdigest(), chars, lost.hexdigest(), formatted]

        for batch in batches:
            done = []
            for key, formatted, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if state is None or key != open_key:
                    if state is not None:
                        done.append(close())
                    open_key, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"] : span["stop"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            yield _batch(done, schema)
        if state is not None:
            yield _batch([close()], schema)

    rows = turns.repartition(conversation).sortWithinPartitions(conversation, turn, "formatted")
    return rows.select(conversation, "formatted", "loss_spans").mapInArrow(run, schema)


def _batch(rows: list[list], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)


def conversation_digests(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formats conversations of plain texts and reads the result back: one row for each conversation."""
    turns = df.select(conversation, turn, role, text_part(text).alias("parts"))
    return read_back(format_turns(turns, "parts", role), conversation, turn)
