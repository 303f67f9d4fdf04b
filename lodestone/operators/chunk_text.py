"""Chunkers as plain functions from one file's text to Piece rows; lines, Markdown and chat transcripts.

Offsets are exact: bytes and lines of the part in the file, overlaps counted once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import pairwise
from typing import NamedTuple

OVERLAP = 200


@dataclass(frozen=True)
class Piece:
    kind: str
    symbol: str | None
    heading_path: str | None
    start_line: int
    end_line: int
    start_byte: int
    end_byte: int
    text: str
    facets: dict[str, list[str]] = field(default_factory=dict)


def line_windows(lines: list[str], limit: int, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Ranges of whole lines of at most limit characters; each begins with the last lines before it, up to overlap characters.

    A line longer than limit stays whole.
    """
    first, size = 0, 0
    for i, line in enumerate(lines):
        if i > first and size + len(line) > limit:
            yield first, i
            back, carried = i, 0
            while back > first and carried + len(lines[back - 1]) <= overlap:
                back -= 1
                carried += len(lines[back])
            first, size = back, carried
        size += len(line)
    if first < len(lines):
        yield first, len(lines)


def split_text(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(offset, part) of text: itself if it fits, else its line windows."""
    if len(text) <= limit:
        return [(0, text)]
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    return [(starts[a], text[starts[a] : starts[b]]) for a, b in line_windows(lines, limit, overlap)]


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class Places:
    """Line and byte of places in a text, which are asked for in order, so that each character is counted once."""

    def __init__(self, text: str, line: int = 1, byte: int = 0):
        self.text, self.at, self.line, self.byte = text, 0, line, byte

    def of(self, at: int) -> tuple[int, int]:
        if at < self.at:
            back = self.text[at : self.at]
            self.line, self.byte = self.line - back.count("\n"), self.byte - n_bytes(back)
        else:
            between = self.text[self.at : at]
            self.line, self.byte = self.line + between.count("\n"), self.byte + n_bytes(between)
        self.at = at
        return self.line, self.byte


def chunk_lines(text: str, limit: int, kind: str = "file", symbol: str | None = None, line: int = 1, byte: int = 0) -> list[Piece]:
    """Line windows of text, which starts at line and byte of its file."""
    out = []
    places = Places(text, line, byte)
    for at, part in split_text(text, limit):
        first, start = places.of(at)
        size = n_bytes(part)
        out.append(Piece(kind, symbol, None, first, first + part.count("\n"), start, start + size, part))
    return out


#: Fixed patterns of the Markdown dialect.
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})|\s*(?:-{3,}|\*{3,}|_{3,})\s*")
_OPEN = re.compile(r" {0,3}<details\b.*", re.IGNORECASE)
_CLOSE = re.compile(r" {0,3}</details\s*>.*", re.IGNORECASE)
_TURN = re.compile(r"<summary>\s*(\d{4}-\d{2}-\d{2}T[^<\s]+)\s+-\s+(user|agent)\s*:\s*(.*?)</summary>", re.IGNORECASE | re.DOTALL)


class Line(NamedTuple):
    """A line that means something outside fences: what it is, its place, and for headings the level and title."""

    kind: str
    number: int
    start: int
    stop: int
    level: int = 0
    title: str = ""


def marked_lines(text: str) -> Iterator[Line]:
    """Headings, rules, and opened and closed details blocks of a text; lines inside fences are plain."""
    fence, stop = "", 0
    for number, line in enumerate(text.splitlines(keepends=True), 1):
        start, stop, bare = stop, stop + len(line), line.rstrip("\r\n")
        ticks = _FENCE.fullmatch(bare)
        if fence:
            # Closed by as many of the same mark, with nothing behind them.
            if ticks and ticks[1].startswith(fence) and not ticks[2].strip():
                fence = ""
            continue
        if ticks and not (ticks[1].startswith("`") and "`" in ticks[2]):
            fence = ticks[1]
        elif _RULE.fullmatch(bare):
            yield Line("rule", number, start, stop)
        elif heading := _HEADING.fullmatch(bare):
            yield Line("heading", number, start, stop, len(heading[1]), heading[2].strip())
        elif _OPEN.fullmatch(bare):
            yield Line("open", number, start, stop)
        elif _CLOSE.fullmatch(bare):
            yield Line("close", number, start, stop)


class Cut(NamedTuple):
    """Where one section ends and the next begins (a rule lies between), the next one's line and breadcrumb."""

    end: int
    begin: int
    line: int
    title: str | None


def cuts(lines: Iterable[Line]) -> Iterator[Cut]:
    """Headings and rules cut; a details block is cut out as a whole, and headings inside it are its own affair."""
    trail: list[str] = []
    inside = 0
    for x in lines:
        if x.kind == "rule":
            yield Cut(x.start, x.stop, x.number + 1, None)
        elif x.kind == "heading" and not inside:
            trail[x.level - 1 :] = [x.title]
            yield Cut(x.start, x.start, x.number, " > ".join(trail))
        elif x.kind == "open":
            inside += 1
            if inside == 1:
                yield Cut(x.start, x.start, x.number, None)
        elif x.kind == "close" and inside:
            inside -= 1
            if not inside:
                yield Cut(x.stop, x.stop, x.number + 1, None)


@dataclass(frozen=True)
class Section:
    title: str | None
    line: int
    start: int
    body: str


def sections(text: str) -> list[Section]:
    """The stretches between cuts that have text."""
    found = [Cut(0, 0, 1, None), *cuts(marked_lines(text)), Cut(len(text), len(text), 0, None)]
    whole = (Section(a.title, a.line, a.begin, text[a.begin : b.end]) for a, b in pairwise(found))
    return [s for s in whole if s.body.strip()]


class Turn(NamedTuple):
    at: str
    role: str
    preview: str

    @property
    def label(self) -> str:
        return f"{self.at} - {self.role}: {self.preview}"

    @property
    def summary(self) -> str:
        return f"<summary>{self.label}</summary>"


def turn_of(section: Section) -> Turn | None:
    m = _TURN.search(section.body)
    return Turn(m[1], m[2].lower(), " ".join(m[3].split())) if m else None


class Spoken(NamedTuple):
    """A section with its turn, the transcript's title and the user's turn before it."""

    section: Section
    turn: Turn | None
    topic: str | None
    asked: tuple[Section, Turn] | None


def conversation(found: list[Section]) -> Iterator[Spoken]:
    """Sections with what was said before them."""
    topic, asked = None, None
    for s in found:
        if s.title and " > " not in s.title and s.body.lstrip().startswith("# "):
            topic = s.title
        turn = turn_of(s)
        yield Spoken(s, turn, topic, asked)
        if turn and turn.role == "user":
            asked = s, turn


def lead_in(x: Spoken, part: int, text: str) -> list[str]:
    """What goes before a part of a turn: an answer's first part repeats the question, later parts say whose they are."""
    if x.turn is None:
        return []
    if x.turn.role == "agent" and x.asked:
        question, asker = x.asked
        return [question.body.rstrip()] if part == 0 else [x.turn.summary, *([f"User: {asker.preview}"] if asker.preview else [])]
    return [x.turn.summary] if part and x.turn.summary not in text else []


def chunk_markdown(text: str, limit: int) -> list[Piece]:
    """Sections with their breadcrumbs; chat turns carry facets and repeat the question they answer."""
    out: list[Piece] = []
    places = Places(text)
    for x in conversation(sections(text)):
        s, turn = x.section, x.turn
        kind, path, facets = ("heading" if s.title else "prose"), s.title, {}
        symbol = s.title.rpartition(" > ")[2] if s.title else None
        if turn:
            kind, symbol = "turn", turn.preview or symbol
            path = " > ".join(filter(None, [x.topic, turn.label]))
            facets = {"at": [turn.at], "day": [turn.at[:10]], "role": [turn.role]}
        byte = places.of(s.start)[1]
        for k, piece in enumerate(chunk_lines(s.body, limit, kind, symbol, s.line, byte)):
            body = "\n\n".join([*lead_in(x, k, piece.text), piece.text])
            out.append(replace(piece, heading_path=path, facets=facets, text=body))
    return out


def halves(piece: Piece, budget: int) -> list[Piece]:
    """piece cut in halves, at line ends where there are any, until each part has at most budget characters. Parts keep their own offsets."""
    if len(piece.text) <= budget or len(piece.text) < 2:
        return [piece]
    mid = len(piece.text) // 2
    cut = piece.text.rfind("\n", 1, mid) + 1 or mid
    head, tail = piece.text[:cut], piece.text[cut:]
    line, byte = piece.start_line + head.count("\n"), piece.start_byte + n_bytes(head)
    first = replace(piece, text=head, end_line=line, end_byte=min(byte, piece.end_byte))
    second = replace(piece, text=tail, start_line=min(line, piece.end_line), start_byte=min(byte, piece.end_byte))
    return halves(first, budget) + halves(second, budget)


def long_enough(pieces: list[Piece], least: int) -> list[Piece]:
    """Pieces with text of at least least characters; all with text if none is."""
    some = [p for p in pieces if p.text.strip()]
    return [p for p in some if len(p.text) >= least] or some
