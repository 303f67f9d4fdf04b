"""Expressions over files and chunks: headers, keys, ids, hashes, languages, durations and formatted values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.facets import facets_line, spec_slug

#: Languages by suffix, and those that the code chunker takes.
LANGUAGES = {
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".md": "markdown",
    ".mdx": "markdown",
    ".vue": "vue",
    ".py": "python",
    ".json": "json",
}
CODE = ("typescript", "tsx", "javascript", "python", "vue")
#: Folders that are never read.
HARD_EXCLUDED = (".git", ".venv", "node_modules", ".next", ".turbo", ".nx", ".angular", "dist", "coverage", "build", "out")
MAX_BYTES = 8_000_000
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, empty without one; a leading dot alone is no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """Language of a path by its suffix, null if unknown."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, suffix(path))


def hard_excluded(rel: Column) -> Column:
    return F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, HARD_EXCLUDED)))


def too_large(size: Column, lang: Column) -> Column:
    return (size > MAX_BYTES) & ~(lang.eqNullSafe(F.lit("openapi")))


def embed_text(path: Column, symbol: Column, kind: Column, heading_path: Column, facets: Column, text: Column) -> Column:
    """What the dense model reads: a header of the parts that exist, a blank line, the text."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), _some(c))
    header = F.concat_ws("\n", F.concat(F.lit("File: "), path), line("Symbol", symbol), line("Kind", kind), line("Section", heading_path), line("Facets", facets_line(facets)))
    return F.concat(header, F.lit("\n\n"), text)


def prepared_body(rel: Column, lang: Column, text: Column) -> Column:
    """A corpus document: Markdown as it is, anything else under a title in a fence."""
    fences = {".ts": "ts", ".mts": "ts", ".cts": "ts", ".tsx": "tsx", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "jsx", ".vue": "vue", ".py": "python", ".json": "json"}
    table = F.create_map(*(F.lit(x) for kv in fences.items() for x in kv))
    fence = F.coalesce(F.try_element_at(table, suffix(rel)), F.lit(""))
    wrapped = F.concat(F.lit("# "), rel, F.lit("\n\n```"), fence, F.lit("\n"), text, F.lit("\n```\n"))
    plain = lang.eqNullSafe(F.lit("markdown")) | suffix(rel).isin(".md", ".mdx")
    return F.when(plain, text).otherwise(wrapped)


def corpus_key(rel: Column, lang: Column, facets: Column, system: str = "default") -> Column:
    """Where a document lies in the corpus: by vendor and spec outside, by lifecycle and system inside."""
    first = lambda key: _some(F.get(F.try_element_at(facets, F.lit(key)), F.lit(0)))
    name = file_name(rel)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    vendor = F.coalesce(first("vendor"), first("provider"), F.lit("unknown"))
    outside = F.concat_ws("/", F.lit("external"), vendor, F.coalesce(spec_slug(rel), stem), name)
    inner = F.regexp_replace(rel, "^openapi-md/", "")
    inner = F.when((lang != "markdown") & ~inner.endswith(".md"), F.concat(inner, F.lit(".md"))).otherwise(inner)
    inside = F.concat_ws("/", F.lit("internal"), F.coalesce(first("lifecycle"), F.lit("current")), F.coalesce(first("system"), F.lit(system)), inner)
    return F.when(F.coalesce(first("scope"), F.lit("internal")) == "external", outside).otherwise(inside)


def chunker(lang: Column) -> Column:
    """Name of the chunker that takes a language."""
    return F.when(lang.isin("markdown", "json", "openapi"), lang).when(lang.isin(*CODE), F.lit("code")).otherwise(F.lit("lines"))


def embed_strategy(model: Column, provider: Column) -> Column:
    """How a model's vectors are asked for."""
    contextual = model.startswith("voyage-context")
    return F.when(contextual, "contextual").when(model.startswith("voyage-"), "voyage").when(provider == "jina", "jina").otherwise("local")


def point_id(key: Column) -> Column:
    """Version 5 UUID of key in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(key, "utf-8")))
    variant = F.substring("89ab", 1, 0)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), nibble + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def newline_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def estimate_tokens(chars: Column, per_token: int = 4) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / per_token).cast("long"))


def duration_seconds(text: Column) -> Column:
    """Seconds of `90s`, `5m`, `2h` or a bare number; null if it is none of them or not above zero."""
    found = r"^\s*(\d+(?:\.\d+)?)\s*([smhSMH]?)\s*$"
    number = F.regexp_extract(text, found, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, found, 2))
    seconds = number * F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return F.when(seconds > 0, seconds)


def parse_duration(text: str) -> float:
    """The same on the driver; bad values raise."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smh]?)\s*", text, re.IGNORECASE)
    seconds = float(m[1]) * {"h": 3600, "m": 60}.get(m[2].lower(), 1) if m else 0
    if seconds <= 0:
        raise ValueError(f"not a duration: {text!r}; use 90s, 5m, 2h or seconds")
    return seconds


def bytes_text(n: Column) -> Column:
    """Bytes in B, KB, MB or GB, to one digit, halves upwards."""

    def tenths(unit: int) -> Column:
        t = F.floor((n + unit // 20) * 10 / unit).cast("long")
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))

    return (
        F.when(n < 1000, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1000**2, F.concat(tenths(1000), F.lit(" KB")))
        .when(n < 1000**3, F.concat(tenths(1000**2), F.lit(" MB")))
        .otherwise(F.concat(tenths(1000**3), F.lit(" GB")))
    )


def seconds_text(s: Column) -> Column:
    whole = F.floor(s).cast("long")
    return (
        F.when(s < 60, F.format_string("%.1fs", s))
        .when(s < 3600, F.concat((F.floor(whole / 60)).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat((F.floor(whole / 3600)).cast("string"), F.lit("h "), (F.floor(whole / 60) % 60).cast("string"), F.lit("m")))
    )


def masked(value: Column) -> Column:
    """A secret as its last four characters behind stars; short ones as stars alone."""
    return F.when(F.char_length(value) <= 8, F.lit("****")).otherwise(F.concat(F.lit("****"), F.right(value, F.lit(4))))


def event_level(event: Column) -> Column:
    """Severity by the event's name."""
    return F.when(event.rlike("error|failed"), "error").when(event.rlike("skip|retry|busy|stopped"), "warn").otherwise("info")


def tokens_text(n: Column) -> Column:
    """A count of tokens, from a thousand on in k, from a million on in M."""
    return (
        F.when(n.isNull(), F.lit("-"))
        .when(n < 1000, n.cast("long").cast("string"))
        .when(n < 1_000_000, F.format_string("%.1fk", n / 1000))
        .otherwise(F.format_string("%.2fM", n / 1_000_000))
    )


_TOTALS = "scanned {scanned}, indexed {indexed}, unchanged {unchanged}, deleted {deleted}, chunks {chunks}, errors {errors}"
#: Events as readable lines; names in braces are fields, {where} is the space and path.
EVENT_LINES = {
    "file_complete": "indexed {where}: {chunks} chunks",
    "skip_large": "skipped {where}: {bytes} bytes are too many",
    "empty": "empty {where}: no chunks",
    "error": "error {where}: {stage} {message}",
    "deleted": "deleted {where}",
    "space": "space {space}: {files} files",
    "done": f"done: {_TOTALS}",
    "stopped": f"stopped: {_TOTALS}; the next run goes on",
}


def event_line(event: Column, fields: Column) -> Column:
    """An event and its fields (a map of strings) as a readable line; events without a line of their own as key=value."""
    field = lambda k: F.coalesce(F.element_at(fields, F.lit(k)), F.lit(""))
    where = F.trim(F.concat(field("space"), F.lit(" "), field("path")))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), " ")
    line = None
    for name, form in EVENT_LINES.items():
        parts = [F.lit(x) if i % 2 == 0 else where if x == "where" else field(x) for i, x in enumerate(re.split(r"\{(\w+)\}", form))]
        text = F.regexp_replace(F.trim(F.concat(*parts)), " {2,}", " ")
        line = F.when(event == name, text) if line is None else line.when(event == name, text)
    return line.otherwise(F.trim(F.concat(event, F.lit(" "), F.coalesce(pairs, F.lit("")))))
