"""Secret scan: patterns find candidates, and how widely each is owned across the corpus tells examples from credentials."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import ROW, cut, map_texts, small, with_rows, without

KINDS = ["assign", "access", "hex", "private_key", "jwt", "github", "slack", "google", "token"]
#: A value with so many owners, or in so many repositories, is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 4, 8
#: Bits per character that a candidate needs besides one of the base patterns.
MIN_ENTROPY = 3.2
#: Fixed patterns.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_BASE = {"access": re.compile(r"AKIA[A-Z0-9]{16,}"), "hex": re.compile(r"[0-9a-f]{24,}")}
#: A key from its header to its footer (line ends may be written as escapes), or, without one, its long lines.
_KEY = re.compile(
    r"-----BEGIN (?P<name>[A-Z0-9 ]{0,40})PRIVATE KEY-----(?:(?:\s|\\[nr])+[A-Z][A-Za-z-]{2,30}: [^\n\\]{0,200})*"
    r"(?:(?P<body>(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]+)+)(?:\s|\\[nr])*-----END (?P=name)PRIVATE KEY-----|(?P<open>(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{32,})+))"
)
_BREAKS = re.compile(r"\s|\\[nr]")
_MORE = {
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35,}"),
    "token": re.compile(r"[A-Za-z0-9_+/-]{24,}"),
}
SPAN = "array<struct<kind:int,start:long,stop:long,value:bigint,base:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, value) of the base patterns, in order of start, then kind."""
    out = [(0, *m.span(), m[1]) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    for kind, pattern in _BASE.items():
        out += [(KINDS.index(kind), *m.span(), m[0]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates that look random; they touch no span found before. A private key, though, is one span whatever lies in it.

    What is taken is kept as sorted disjoint intervals, so the time is that of sorting, however many spans there are.
    """
    out = [(KINDS.index("private_key"), *m.span(), _BREAKS.sub("", m["body"] or m["open"])) for m in _KEY.finditer(text)]
    taken = _union([s[1:3] for s in base] + [s[1:3] for s in out])
    for kind, pattern in _MORE.items():
        ends, found = [e for _, e in taken], []
        for m in pattern.finditer(text):
            value, (start, stop) = m[0], m.span()
            at = bisect_left(ends, start + 1)
            if at < len(taken) and taken[at][0] < stop:
                continue
            if kind == "token" and (not any(c.isdigit() for c in value) or value.isdigit() or not any(c.isalpha() for c in value)):
                continue
            if entropy(value) >= MIN_ENTROPY:
                found.append((KINDS.index(kind), start, stop, value))
        taken = _union(taken + [s[1:3] for s in found])
        out += found
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals over the same places."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def scan(text: str) -> list[tuple[int, int, int, int, bool]]:
    base = base_spans(text)
    more = more_spans(text, base)
    return [(k, s, e, _value_hash(v), b) for b, spans in ((True, base), (False, more)) for k, s, e, v in spans]


def candidates(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep and found, the candidate spans of each text (value: a 64-bit hash, the credential itself isn't kept)."""

    def work(texts: list[str]):
        return [[[dict(zip(("kind", "start", "stop", "value", "base"), s, strict=True)) for s in scan(t)] for t in texts]]

    field = T.StructField("found", T._parse_datatype_string(SPAN))
    return map_texts(docs, text_col, keep, [field], work)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners) over rows (repo, owner, found). Pre-aggregated by task; copies inside a repository count once."""
    each = found.select("repo", "owner", F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value"))
    distinct = each.groupBy("value", "repo", "owner").agg(F.lit(1).alias("one"))
    return distinct.groupBy("value").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def found_spans(docs: DataFrame, id_col: str, text_col: str, repo_cols: tuple, owner_cols: tuple) -> DataFrame:
    """(id, row, repo, owner, found) of docs with ROW: the candidates of each text, written once."""
    key = lambda cols: F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols))
    named = docs.select(F.col(id_col).alias("id"), F.col(ROW).alias("row"), key(repo_cols).alias("repo"), key(owner_cols).alias("owner"), F.col(text_col).alias("text"))
    return cut(candidates(named, "text", ["id", "row", "repo", "owner"]))


def judged_spans(found: DataFrame) -> DataFrame:
    """(row, spans) of texts with spans: each with live (owner-specific) set; spans that only the method adds stay if live.

    Candidates are joined to the examples alone, which many owners share: a copied example is a hot key of the candidates' side only.
    """
    some = found.where(F.size("found") > 0)
    known = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS)
    examples = cut(ownership(some).where(known))
    spans = some.select("row", F.explode("found").alias("s")).withColumn("value", F.col("s.value"))
    judged = spans.join(small(examples), "value", "left").withColumn("live", F.col("n_owners").isNull()).where("s.base OR live")
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.stop").alias("stop"), F.col("s.base").alias("base"), "live")
    return judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple = ("source", "lang"), owner_cols: tuple = ("source",)) -> DataFrame:
    """One row per row of docs: counts of base spans by kind, the digest of base spans, all spans, and how many are live or examples.

    Null texts are empty; null repositories or owners count as one of their own. Offsets are code points, the end
    exclusive. Repeated rows are judged each for itself. An empty table gives no rows.
    """
    found = found_spans(docs.withColumn(ROW, F.monotonically_increasing_id()), id_col, text_col, repo_cols, owner_cols)
    each = cut(judged_spans(found))
    none = F.array().cast(each.schema["spans"].dataType)
    rows = found.select("id", "row").join(each, "row", "left").select("id", F.coalesce("spans", none).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    line = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return rows.select(
        F.col("id").alias(id_col),
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_examples"),
    )


def mask_spans(text: str, marks: list[tuple[int, int]], mask: str) -> str:
    """text with each stretch of touching or overlapping marks replaced by mask."""
    parts, at = [], 0
    for start, stop in _union(marks):
        parts += [text[at:start], mask]
        at = stop
    return "".join([*parts, text[at:]])


def masked(text: Column, marks: Column, mask: str) -> Column:
    @F.pandas_udf(T.StringType())
    def each(texts: pd.Series, spans: pd.Series) -> pd.Series:
        pairs = lambda ms: [(int(m["start"]), int(m["stop"])) for m in ms]
        return pd.Series([mask_spans(t, pairs(ms), mask) for t, ms in zip(texts, spans, strict=True)], dtype=object)

    return each(text, marks)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", repo_cols: tuple = ("source", "lang"), owner_cols: tuple = ("source",), length_col: str | None = "n_chars") -> DataFrame:
    """docs with each live span of the text replaced by mask; all rows and columns stay, length_col follows the text.

    Only the marked rows' texts go through Python again; no text is shuffled while the marks are few enough to be broadcast.
    """
    rows = with_rows(docs)
    found = found_spans(rows, id_col, text_col, repo_cols, owner_cols)
    live = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    marks = cut(judged_spans(found).select(F.col("row").alias(ROW), live.alias("_ls_marks")).where(F.size("_ls_marks") > 0))
    clear = without(rows, marks)
    fixed = rows.join(small(marks), ROW).withColumn(text_col, masked(F.col(text_col), F.col("_ls_marks"), mask))
    if length_col in docs.columns:
        fixed = fixed.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return clear.select(*docs.columns).unionByName(fixed.select(*docs.columns))
