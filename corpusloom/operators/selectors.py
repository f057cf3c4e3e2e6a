"""Extraction of pages by selectors, one rule set a site.

Selectors (``tag``, ``.class``, ``#id``, their compounds, descendants by white space, alternatives by commas) of all
purposes are compiled into one automaton over the events of the parser.  Its
state is one integer, a bit for each part of a selector that its ancestors have
reached; an element's own bits come from tables by tag, class and id.  No tree
is built: a page is read once, and text goes to the sinks that are open.

Rules then work on paragraphs: what is scrubbed out of them, which are junk, and which ends the text.

Defined results: a null page is empty; broken markup is read as far as it goes; the first
content selector in the order of the rules that holds a paragraph wins; text inside
removed elements is nowhere; sites without rules use the default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")
_SPACE = re.compile(r"[\s​‌‍﻿]+")

# Elements that never hold article text, that stand inside a line, that have no end, and whose start ends an open one of the same kind.
DROPPED = ("script", "style", "noscript", "iframe", "svg", "button", "input", "select", "textarea", "nav", "figure", "aside", "video", "audio", "canvas", "template", "object")
INLINE = frozenset("a span strong b em i u sup sub small mark font abbr label code s del ins time cite q img wbr kbd var br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass(frozen=True)
class Rules:
    """Selectors and patterns of one site; patterns are searched in a paragraph."""

    content: tuple[str, ...] = ("article", "main", "body")
    remove: tuple[str, ...] = ()
    title: tuple[str, ...] = ("h1", "title")
    question: tuple[str, ...] = ()
    answer: tuple[str, ...] = ()
    scrub: tuple[str, ...] = ()
    junk: tuple[str, ...] = ()
    cut: tuple[str, ...] = ()
    drop_title: bool = True


class Automaton:
    """All selectors of a site.  ``step`` takes the parent's state and an element, and gives the element's state and the selectors that end at it."""

    def __init__(self, selectors: list[str]):
        self.tags: dict[str, int] = {}
        self.by_class: dict[str, int] = {}
        self.by_id: dict[str, int] = {}
        self.any_tag = self.needs_id = self.last = self.start = 0
        self.classes: dict[int, frozenset[str]] = {}
        self.ends: dict[int, int] = {}
        bit = 1
        for number, selector in enumerate(selectors):
            for alternative in selector.split(","):
                parts = alternative.split()
                if not parts:
                    raise ValueError(f"empty selector in {selector!r}")
                self.start |= bit
                for part in parts:
                    self._part(part, bit)
                    bit <<= 1
                self.last |= bit >> 1
                self.ends[bit >> 1] = number

    def _part(self, part: str, bit: int) -> None:
        met = _PART.match(part)
        if not met or not part:
            raise ValueError(f"not a selector: {part!r}")
        tag, names = met[1], re.findall(r"[.#][\w-]+", met[2])
        if tag and tag != "*":
            self.tags[tag.lower()] = self.tags.get(tag.lower(), 0) | bit
        else:
            self.any_tag |= bit
        classes = frozenset(n[1:] for n in names if n[0] == ".")
        if classes:
            self.classes[bit] = classes
        for name in (n[1:] for n in names if n[0] == "#"):
            self.needs_id |= bit
            self.by_id[name] = self.by_id.get(name, 0) | bit

    def step(self, state: int, tag: str, attributes: Mapping[str, str | None]) -> tuple[int, list[int]]:
        met = state & (self.any_tag | self.tags.get(tag, 0))
        met &= ~self.needs_id | self.by_id.get(attributes.get("id") or "", 0)
        if met:
            own = frozenset((attributes.get("class") or "").split())
            for bit, classes in self.classes.items():
                if met & bit and not classes <= own:
                    met &= ~bit
        ended = met & self.last
        return state | (met & ~self.last) << 1, [n for bit, n in self.ends.items() if bit & ended]


class _Sink:
    """Paragraphs of the open elements of one selector."""

    def __init__(self) -> None:
        self.paragraphs: list[str] = []
        self.buffer: list[str] = []
        self.breaks = 0

    def text(self, data: str) -> None:
        self.buffer.append(data)
        if data.strip():
            self.breaks = 0

    def line_break(self) -> None:
        self.breaks += 1
        self.buffer.append(" ")
        if self.breaks > 1:
            self.flush()

    def flush(self) -> None:
        said = _SPACE.sub(" ", "".join(self.buffer)).strip()
        if said:
            self.paragraphs.append(said)
        self.buffer, self.breaks = [], 0


class _Reader(HTMLParser):
    def __init__(self, automaton: Automaton, sinks: int):
        super().__init__(convert_charrefs=True)
        self.automaton = automaton
        self.sinks = [_Sink() for _ in range(sinks)]
        #: Open elements: tag, state, open sinks, inside a removed one.
        self.stack: list[tuple[str, int, frozenset[int], bool]] = [("", automaton.start, frozenset(), False)]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SIBLINGS:
            while self.stack[-1][0] in SIBLINGS[tag]:
                self._close()
        elif self.stack[-1][0] == "p" and tag not in INLINE:
            self._close()
        self._boundary(tag)
        _, state, open_, gone = self.stack[-1]
        if tag == "br":
            for k in () if gone else open_:
                self.sinks[k].line_break()
        if tag in VOID:
            return
        state, ended = self.automaton.step(state, tag, dict(attrs))
        gone = gone or tag in DROPPED or any(n >= len(self.sinks) for n in ended)
        new = open_ | {n for n in ended if n < len(self.sinks)}
        if tag in INLINE:
            for k in new - open_:
                self.sinks[k].flush()
        self.stack.append((tag, state, new, gone))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(tag == t for t, *_ in self.stack):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, _, open_, _ = self.stack.pop()
        for k in open_ if tag not in INLINE else open_ - self.stack[-1][2]:
            self.sinks[k].flush()
        return tag

    def _boundary(self, tag: str) -> None:
        if tag not in INLINE:
            for k in self.stack[-1][2]:
                self.sinks[k].flush()

    def handle_data(self, data: str) -> None:
        _, _, open_, gone = self.stack[-1]
        if not gone:
            for k in open_:
                self.sinks[k].text(data)

    def finish(self) -> list[list[str]]:
        self.close()
        while len(self.stack) > 1:
            self._close()
        return [s.paragraphs for s in self.sinks]


@lru_cache(maxsize=256)
def _compiled(rules: Rules) -> tuple[Automaton, list[list[re.Pattern]]]:
    selectors = [*rules.content, *rules.title, *rules.question, *rules.answer, *rules.remove]
    return Automaton(selectors), [[re.compile(p) for p in patterns] for patterns in (rules.scrub, rules.junk, rules.cut)]


def extract(html: str | None, rules: Rules) -> dict:
    """title, question, answer and paragraphs of a page."""
    automaton, (scrub, junk, cut) = _compiled(rules)
    sizes = [len(rules.content), len(rules.title), len(rules.question), len(rules.answer)]
    reader = _Reader(automaton, sum(sizes))
    reader.feed(html or "")
    sinks, at, found = reader.finish(), 0, []
    for n in sizes:
        found.append(next((s for s in sinks[at : at + n] if s), []))
        at += n
    content, title, question, answer = found
    head = title[0] if title else ""

    def ruled(paragraphs: list[str]) -> Iterator[str]:
        for p in paragraphs:
            for pattern in scrub:
                p = pattern.sub("", p)
            p = _SPACE.sub(" ", p).strip()
            if any(c.search(p) for c in cut):
                return
            if p and not any(j.search(p) for j in junk) and not (rules.drop_title and p == head):
                yield p

    return {"title": head, "question": "\n\n".join(ruled(question)), "answer": "\n\n".join(ruled(answer)), "paragraphs": list(ruled(content))}


def extract_pages(pages: DataFrame, sites: Mapping[str, Rules], default: Rules = Rules(), key: str = "page_id", html: str = "html", site: str = "site") -> DataFrame:  # noqa: B008
    """(key, title, question, answer, paragraphs) of each page by the rules of its site."""
    known = dict(sites)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [extract(h, known.get(s, default)) for h, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            said = [pa.array([m[c] for m in made], pa.string()) for c in ("title", "question", "answer")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *said, pa.array([m["paragraphs"] for m in made], pa.list_(pa.string()))], [key, "title", "question", "answer", "paragraphs"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key), html, site).mapInArrow(run, f"{key} {kind}, title string, question string, answer string, paragraphs array<string>")
