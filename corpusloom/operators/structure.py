"""Passages that follow a document's structure, site junk, tail cuts, and windows that grow towards high scores."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .passages import SLACK, Span, cut_down, joined, paragraphs, token_count

_HEADING = re.compile(r"^(#{1,6}\s|\d+(\.\d+)*[.)]\s+\S.{0,80}$|[^.!?]{1,80}:$)")
_ITEM = re.compile(r"^\s*([-*+•–]|\d+[.)]|[a-z]\))\s+")


def kind_of(line: str) -> str:
    """heading, item, row (a table line) or para."""
    if line.count("|") >= 2 or "\t" in line:
        return "row"
    if _ITEM.match(line) and len(line.split()) > 1 and not _HEADING.match(line):
        return "item"
    if _HEADING.match(line) and len(line.split()) <= 14:
        return "heading"
    return "item" if _ITEM.match(line) else "para"


@dataclass
class Block:
    """Paragraphs that belong together: a run of items or of rows, or a single paragraph."""

    kind: str
    spans: list[Span]
    sizes: list[int]

    @property
    def size(self) -> int:
        return sum(self.sizes)


def blocks_of(text: str) -> list[Block]:
    parts = [(kind_of(text[s:e]), (s, e), token_count(text[s:e])) for s, e in paragraphs(text)]
    out = []
    for kind, run in itertools.groupby(parts, key=lambda p: p[0]):
        run = list(run)
        sets = [run] if kind in ("item", "row") else [[p] for p in run]
        out += [Block(kind, [p[1] for p in some], [p[2] for p in some]) for some in sets]
    return out


def sections_of(blocks: list[Block]) -> list[list[Block]]:
    """A heading opens a section; headings that follow one another open it together."""
    opens = [i for i, b in enumerate(blocks) if i == 0 or (b.kind == "heading" and blocks[i - 1].kind != "heading")]
    return [blocks[i:j] for i, j in itertools.pairwise([*opens, len(blocks)])]


class Packed:
    """Chunks made so far and the blocks of the open one."""

    def __init__(self, text: str, target: int):
        self.text, self.target = text, target
        self.out: list[dict] = []
        self.open: list[Block] = []
        self.section: str | None = None

    @property
    def size(self) -> int:
        return sum(b.size for b in self.open)

    def put(self, spans: list[Span]) -> None:
        self.out.append({"start": spans[0][0], "stop": spans[-1][1], "section": self.section})

    def close(self) -> None:
        if self.open:
            self.put([s for b in self.open for s in b.spans])
        self.open = []

    def take(self, blocks: list[Block]) -> None:
        if self.open and self.size + sum(b.size for b in blocks) > self.target:
            self.close()
        self.open += blocks

    def pieces(self, head: list[Block], block: Block) -> None:
        """A block that no chunk holds: its paragraphs packed, or cut down; what heads it stands at the start of the first piece."""
        self.close()
        made: list[Span] = []
        run: list[tuple[Span, int]] = []
        for span, size in [*zip(block.spans, block.sizes, strict=True), (None, 0)]:
            if run and (span is None or size > SLACK * self.target or sum(n for _, n in run) + size > self.target):
                made.append((run[0][0][0], run[-1][0][1]))
                run = []
            if span is not None and size > SLACK * self.target:
                made += cut_down(self.text, span, self.target, token_count)
            elif span is not None:
                run.append((span, size))
        first = head[0].spans[0][0] if head else made[0][0]
        for i, (s, e) in enumerate(made):
            self.put([(first if i == 0 else s, e)])


def structured(text: str, target: int) -> list[dict]:
    """Chunks {start, stop, section} that follow a text's structure; ``section`` is its last heading before the chunk's first block.

    Runs of items or rows stay together; a heading goes with the block below it
    and never ends a chunk, but for one at the end of the text, which goes to the
    chunk before.  A section that fits is one chunk; sections are put together
    only while the open chunk is under a quarter of the target.  Nothing is
    repeated.
    """
    packed, sections = Packed(text, target), sections_of(blocks_of(text))
    trailing = sections.pop() if len(sections) > 1 and all(b.kind == "heading" for b in sections[-1]) else None
    for section in sections:
        heads = list(itertools.takewhile(lambda b: b.kind == "heading", section))
        size = sum(b.size for b in section)
        if not (packed.open and packed.size < target / 4 and packed.size + size <= target):
            packed.close()
            if heads:
                s, e = heads[-1].spans[0]
                packed.section = text[s:e].strip("#: ").strip()
        if size <= target:
            packed.open += section
            continue
        packed.close()
        rest = section[len(heads) :]
        for i, block in enumerate(rest or [Block("para", [], [])]):
            head = heads if i == 0 else []
            if block.spans and sum(b.size for b in [*head, block]) > target:
                packed.pieces(head, block)
            else:
                packed.take([*head, *([block] if block.spans else [])])
    packed.close()
    if trailing:
        packed.out[-1]["stop"] = trailing[-1].spans[-1][1]
    return packed.out


def qa_chunks(question: str, answers: list[str], target: int) -> list[dict]:
    """Pieces {kind, text}: the question with the first piece of its first answer, the other pieces, and each later answer with the question before it."""
    if not answers:
        return [{"kind": "question", "text": question}] if question else []
    out = []
    for k, answer in enumerate(answers):
        spans = joined(answer, paragraphs(answer) or [(0, len(answer))], target, token_count)
        for i, (s, e) in enumerate(spans):
            first = k == 0 and i == 0 and question
            out.append({"kind": "qa" if first else "answer", "text": f"{question}\n\n{answer[s:e]}" if first else answer[s:e]})
        if k:
            out.append({"kind": "span_qa", "text": f"{question}\n\n{answer}"})
    return out


def grow(sizes: list[int], scores: list[float], at: int, limit: int) -> tuple[int, int]:
    """First and last unit of a window that starts at ``at`` and takes the neighbour of higher score (right on ties) while the sizes fit."""
    first = last = at
    total = sizes[at]
    while True:
        left = (scores[first - 1], first - 1) if first > 0 and total + sizes[first - 1] <= limit else None
        right = (scores[last + 1], last + 1) if last + 1 < len(sizes) and total + sizes[last + 1] <= limit else None
        if left is None and right is None:
            return first, last
        if right is not None and (left is None or right[0] >= left[0]):
            last += 1
            total += sizes[last]
        else:
            first -= 1
            total += sizes[first]


def without_site_junk(lines: Column, domain: Column, edge: int = 3) -> Column:
    """Paragraphs without lines that are the site's own domain and, among the first and last ones, short labels in capitals."""
    n = F.size(lines)

    def keep(x: Column, i: Column) -> Column:
        own = F.lower(F.trim(x)).isin("") | (F.lower(F.trim(x)) == F.lower(domain)) | (F.lower(F.trim(x)) == F.concat(F.lit("www."), F.lower(domain)))
        label = ((i < edge) | (i >= n - edge)) & x.rlike(r"^[\p{Lu}\p{N} &/-]+$") & (F.size(F.split(F.trim(x), r"\s+")) <= 4)
        return ~own & ~label

    return F.filter(lines, keep)


def cut_point(lines: Column, markers: list[str], share: float = 0.7) -> Column:
    """Place of the first line in the last part of a text that is a tail marker, or null."""
    n = F.size(lines)
    hits = F.filter(F.transform(lines, lambda x, i: F.when((i >= F.floor(n * share)) & F.lower(F.trim(x)).isin(*markers), i)), lambda i: i.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def blob(text: Column, target: int) -> Column:
    """A passage without white space that is far too long to be words."""
    return (F.length(text) > 6 * 1.5 * target) & ~text.rlike(r"\s")


def cookie_challenge(raw: Column) -> Column:
    """struct(name, value) that a page's script sets as its cookie, or null."""
    pattern = r"""(?i)document\s*\.\s*cookie\s*=\s*["'](\w+)=(\w+)["']"""
    name, value = F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2)
    return F.when(name != "", F.struct(name.alias("name"), value.alias("value")))


def char_or_word_shingles(text: Column, lang: Column, n: int = 5) -> Column:
    """Distinct shingles: of characters where words are not separated (zh), else of words."""
    from ..functions import text as X

    chars = F.split(F.regexp_replace(F.lower(text), r"\s+", ""), "")
    return F.when(lang == "zh", X.shingles(F.filter(chars, lambda c: c != ""), n)).otherwise(X.shingles(X.words(text), n))


def watch(deadline_passed: Column, paused: Column, remaining: Column, alive: Column, exit_code: Column, restarts_left: Column, beat_age: Column, fresh: float, suspected: Column) -> Column:
    """What to do about a worker: the first row of the decision table that fits."""
    return (
        F.when(deadline_passed, "deadline")
        .when(paused, "paused")
        .when(remaining == 0, "nothing_remains")
        .when(~alive & (exit_code == 0), "finished")
        .when(~alive & (restarts_left <= 0), "gave_up")
        .when(~alive, "restart")
        .when(beat_age <= fresh, "ok")
        .when(~suspected, "suspect")
        .when(restarts_left <= 0, "gave_up")
        .otherwise("kill_restart")
    )


def crawl_window(day: Column, anchor: Column, months: int = 12) -> Column:
    """before, after or out: crawls of the year up to the anchor, later ones flagged."""
    return F.when(day > anchor, "after").when(day >= F.add_months(anchor, -months), "before").otherwise("out")
