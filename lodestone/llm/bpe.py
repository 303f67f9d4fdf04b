"""Byte-level BPE by forced boundaries: byte pairs inside no vocabulary token are certain cuts.

A merge makes a vocabulary token, so it never spans two bytes that are adjacent in no token. Text is split by the
tokenizer's pattern, each piece at such pairs, the fragments are encoded one by one (and remembered, since they recur),
and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import map_texts

#: Fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the standard library's faster engine: exact for ASCII, else but for characters that ForcedBpe replaces.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
WIDE_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Pieces that each of a worker's two generations of memory holds, and the longest that is remembered.
MEMORY, REMEMBERED = 250_000, 48


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(extra)] = b
            extra += 1
    return out


def merge_order(spec: dict) -> list[bytes]:
    """Tokens of a tokenizers file by rank: single bytes by their ids, then what each merge makes, in the file's order."""
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    single = sorted((i, raw(t)) for t, i in spec["model"]["vocab"].items() if len(t) == 1)
    return [*(t for _, t in single), *(b"".join(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"])]


def merge_bytes(fragment: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ranks of a fragment's tokens: the adjacent pair of least rank, leftmost first, is merged until none is known."""
    parts = [fragment[i : i + 1] for i in range(len(fragment))]
    while len(parts) > 1:
        best, at = min((rank.get(a + b, len(rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == len(rank):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [rank[p] for p in parts]


class Piece(NamedTuple):
    """What one piece of text becomes: ids, the same as decimal text, and the bytes that the ids decode to."""

    ids: tuple[int, ...]
    text: str
    back: bytes


class Memory:
    """A bounded map in two generations: when the young one is full it becomes the old one, whose hits return to the young."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> Piece | None:
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: Piece) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class ForcedBpe:
    """Encoder and decoder of one tokenizers file of byte-level BPE, equal to that library's results."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        order = merge_order(spec)
        rank = {t: r for r, t in enumerate(order)}
        by_rank = [self.ids[t] for t in order]
        try:
            # tiktoken's merge routine isn't part of its public interface; without it the merges are made here.
            one = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=rank, special_tokens={})._core_bpe.encode_single_piece
        except AttributeError:
            one = lambda fragment: merge_bytes(fragment, rank)
        #: Ids of one fragment: the merge of least rank, leftmost first, until none applies.
        self.merge = one if by_rank == list(range(len(order))) else lambda fragment: [by_rank[r] for r in one(fragment)]
        self.token = {i: t for t, i in self.ids.items()}
        if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: special tokens that take in what is around them aren't supported")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.token[i] = content.encode()
        self.inside = bytearray(65536)
        for t in self.ids:
            for a, b in zip(t, t[1:], strict=False):
                self.inside[a << 8 | b] = 1
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("|".join(map(re.escape, names))) if names else None
        self.ascii, self.wide = re.compile(ASCII_PATTERN, re.ASCII), re.compile(WIDE_PATTERN)
        self.probe = Tokenizer.from_file(path).pre_tokenizer
        self.plain: set[str] = {chr(c) for c in range(128) if not 0x1C <= c < 0x20}
        self.odd: dict[str, str] = {}
        self.memory = Memory(MEMORY)

    def _learn(self, letters: Iterable[str]) -> None:
        """Classes of characters differ between libraries: ask the tokenizer for each new character's once."""
        ours = lambda c: [m.span() for m in self.wide.finditer(f"a{c}1{c}!{c}{c}b")]
        for c in letters:
            theirs = [o for _, o in self.probe.pre_tokenize_str(f"a{c}1{c}!{c}{c}b")]
            if theirs == ours(c):
                self.plain.add(c)
            else:
                self.odd[c] = next(s for s in "é1\xa0☃" if ours(s) == theirs)

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        new = set(text) - self.plain
        if new:
            self._learn(new - self.odd.keys())
            if new & self.odd.keys():
                like = text.translate({ord(c): s for c, s in self.odd.items()})
                return [text[m.start() : m.end()] for m in self.wide.finditer(like)]
        return self.wide.findall(text)

    def fragments(self, piece: bytes) -> list[bytes]:
        """piece cut at every byte pair that is inside no token."""
        inside = self.inside
        cuts = [i for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False), 1) if not inside[a << 8 | b]]
        if not cuts:
            return [piece]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def _piece(self, piece: str) -> Piece:
        found = self.memory.get(piece)
        if found is None:
            ids: list[int] = []
            for fragment in self.fragments(piece.encode("utf-8")):
                ids += self.merge(fragment)
            found = Piece(tuple(ids), ",".join(map(str, ids)), b"".join(map(self.token.__getitem__, ids)))
            if len(piece) <= REMEMBERED:
                self.memory.put(piece, found)
        return found

    def _ordinary(self, text: str, out: list[Piece]) -> None:
        known, other = self.memory.young.get, self._piece
        for piece in self.pieces(text):
            found = known(piece)
            if found is None:
                found = other(piece)
                known = self.memory.young.get
            out.append(found)

    def encode_pieces(self, text: str) -> list[Piece]:
        """What text's pieces become, in order."""
        out: list[Piece] = []
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            self._ordinary(text[at : m.start()], out)
            i = self.special[m[0]]
            out.append(Piece((i,), str(i), self.token[i]))
            at = m.end()
        self._ordinary(text[at:] if at else text, out)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.encode_pieces(text) for i in p.ids]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, ForcedBpe] = {}


def coder(path: str) -> ForcedBpe:
    """One encoder per worker process and file."""
    if path not in _CODERS:
        _CODERS[path] = ForcedBpe(path)
    return _CODERS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row; a null text gives no ids, an empty table no rows. path must exist on every worker."""

    def work(texts: list[str]):
        c = coder(path)
        return [[c.encode(t) for t in texts]]

    return map_texts(docs, text_col, [id_col], [T.StructField("ids", T.ArrayType(T.IntegerType()))], work)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row; ids and texts are made and hashed text by text, none are moved."""

    def work(texts: list[str]):
        c, counts, digests, texts_back = coder(path), [], [], []
        for t in texts:
            pieces = c.encode_pieces(t)
            ids = ",".join([p.text for p in pieces])
            back = b"".join([p.back for p in pieces]).decode("utf-8", "replace")
            counts.append(ids.count(",") + 1 if ids else 0)
            digests.append(hashlib.sha256(ids.encode()).hexdigest())
            texts_back.append(hashlib.sha256(back.encode()).hexdigest())
        return counts, digests, texts_back

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(docs, text_col, [id_col], fields, work)
