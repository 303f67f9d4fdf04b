"""Glob patterns as anchored regular expressions: `**`, `*`, `?`, `[..]` and `{a,b}`; names with a leading dot match too."""

from __future__ import annotations

import re
from functools import lru_cache


def braces(pattern: str) -> list[str]:
    """pattern with its brace lists written out; braces without a comma stay."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            depth += 1
            start = i if depth == 1 else start
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                options = _top_level(pattern[start + 1 : i])
                if len(options) > 1:
                    return [x for o in options for x in braces(pattern[:start] + o + pattern[i + 1 :])]
    return [pattern]


def _top_level(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def to_regex(pattern: str) -> str:
    """A regular expression, alike in Python and Java, for whole `/`-separated relative paths."""
    return "^(?:" + "|".join(_one(p.removeprefix("./")) for p in braces(pattern)) + ")$"


def _one(pattern: str) -> str:
    parts = pattern.split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    return out


def _segment(part: str) -> str:
    tokens = re.finditer(r"\[(!|\^)?(\]?[^\]]*)\]|\*+|\?|.", part)
    out = ""
    for t in tokens:
        if t[0].startswith("[") and len(t[0]) > 1:
            out += f"[{'^/' if t[1] else ''}{re.sub(r'([\\&[])', r'\\\1', t[2])}]"
        elif t[0].startswith("*"):
            out += "[^/]*"
        elif t[0] == "?":
            out += "[^/]"
        else:
            out += re.sub(r"([^\w/ -])", r"\\\1", t[0])
    return out


@lru_cache(maxsize=1024)
def compiled(patterns: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(to_regex, patterns)) or r"(?!)")


def matches_any(rel: str, patterns: tuple[str, ...]) -> bool:
    return compiled(tuple(patterns)).match(rel) is not None
