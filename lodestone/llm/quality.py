"""Quality rules whose thresholds adapt: mergeable quantile sketches per language and source, then a joined filter.

The sketch is a histogram over integer buckets of bounded relative width (1/64): a value keeps its seven leading
binary digits. Bucket counts add up, so sketches of any split of the rows merge to the same sketch, and those
of a language or of all documents come from those of its sources without another look at the texts.

Rates that vary in any text (punctuation, word length, share of short words) are fenced on both sides of the group's median, at WIDTH
times the smaller of its two distances to the 0.1 and 0.9 quantiles: a third of bad rows on one side doesn't widen that one. Rates that are
zero in most texts (repeated lines, repeated words) are fenced above, as far beyond the 0.99 quantile as that lies from the median.
No distance is a constant. Rows that fail the base rules don't count, and copies count once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import WORD, cut, map_texts

SYMBOLS, PUNCTUATION = "#*$%&|<>", r"[!-/:-@\[-`{-~]"
MIN_WORDS, MAX_REPEATED, SHORT_WORD = 50, 50, 3
#: A group's own quantiles hold from so many different documents on; smaller ones use their language's, then all documents'.
MIN_GROUP = 100
#: Leading binary digits that a sketch keeps, and the fence in quantile distances.
DIGITS, WIDTH = 7, 6
#: Rates with a fence on both sides, and those with one above: numerator, denominator and scale.
TWO_SIDED = {"punct_rate": ("n_punct", "word_chars", 1000), "word_length": ("word_chars", "n_words", 100), "short_rate": ("n_short", "n_words", 1000)}
ABOVE = {"dup_line_rate": ("n_dup_lines", "n_lines", 1000), "repeat_rate": ("n_repeat_words", "n_words", 1000)}
RATES = TWO_SIDED | ABOVE
#: Quantiles per rate, in hundredths.
LEVELS = {r: (10, 50, 90) for r in TWO_SIDED} | {r: (50, 99) for r in ABOVE}
FENCES = [*(f"min_{r}" for r in TWO_SIDED), *(f"max_{r}" for r in RATES)]
_WORD, _PUNCTUATION = re.compile(WORD), re.compile(PUNCTUATION + "+")
_SPACES = " \t\n\v\f\r"
METRICS = ["n_words", "word_chars", "n_symbols", "n_punct", "n_short", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[str]) -> int:
    """Words inside a 3-word window that occurs at least twice, its first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    inside, first = bytearray(len(words)), {}
    for at, window in enumerate(windows):
        before = first.setdefault(window, at)
        if before != at:
            inside[at : at + 3] = b"\1\1\1"
            inside[before : before + 3] = b"\1\1\1"
    return sum(inside)


def measure(text: str) -> tuple[int, ...]:
    """METRICS of one text."""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    lengths = list(map(len, words))
    return (
        len(words),
        sum(lengths),
        sum(map(text.count, SYMBOLS)),
        sum(map(len, _PUNCTUATION.findall(text))),
        sum(map(SHORT_WORD.__ge__, lengths)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def work(texts: list[str]):
        return list(zip(*map(measure, texts), strict=True)) or [[]] * len(METRICS)

    return map_texts(docs, text_col, keep, [T.StructField(m, T.LongType()) for m in METRICS], work)


def metrics_of(text: Column) -> Column:
    """METRICS as a struct. Not deterministic to Spark: a filter on it must not be moved below and measure the text again."""

    @F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in METRICS]))
    def each(texts):
        import pandas as pd

        return pd.DataFrame([measure(t or "") for t in texts], columns=METRICS)

    return each.asNondeterministic()(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def with_rates(df: DataFrame) -> DataFrame:
    """Integer rates; zero where there is nothing to divide by."""
    return df.withColumns({r: F.expr(f"CASE WHEN {b} > 0 THEN {k} * {a} DIV {b} ELSE 0 END") for r, (a, b, k) in RATES.items()})


def bucket(x: Column) -> Column:
    """The least value with x's DIGITS leading binary digits; x itself below 2**DIGITS."""
    digits = F.length(F.bin(x))
    drop = F.greatest(digits - DIGITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, rate, bucket, n) of rows with METRICS that pass the base rules; equal measurements in a group count once."""
    each = rows.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *METRICS).distinct()
    pairs = F.array(*(F.struct(F.lit(r).alias("rate"), F.col(r).alias("x")) for r in RATES))
    long = with_rates(each).select("lang", "source", F.explode(pairs).alias("p"))
    return long.groupBy("lang", "source", F.col("p.rate").alias("rate"), bucket(F.col("p.x")).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """Per group: documents n and, for each rate, q<level>_<rate>, merged from the sketches of its parts."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rate")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("upto", upto).withColumn("all", F.sum("n").over(group))
    cols = [F.max(F.when(F.col("rate") == r, F.col("all"))).alias("n") for r in list(RATES)[:1]]
    for r, levels in LEVELS.items():
        for k in levels:
            here = (F.col("rate") == r) & (100 * F.col("upto") >= k * F.col("all"))
            cols.append(F.min(F.when(here, F.col("bucket"))).alias(f"q{k}_{r}"))
    spreads = {f"d_{r}": F.expr(f"nullif(least(q50_{r} - q10_{r}, q90_{r} - q50_{r}), 0)") for r in TWO_SIDED}
    return ranked.groupBy(*by).agg(*cols).withColumns(spreads)


def thresholds(sketch: DataFrame) -> DataFrame:
    """(k_lang, k_source, level, FENCES...): per group of the sketch, the fences of the finest level with enough documents.

    A group whose distance is zero takes its language's, then that of all documents; where that is zero too there is no fence.
    """
    fine, mid, top = quantiles(sketch, "lang", "source"), quantiles(sketch, "lang"), quantiles(sketch)
    name = lambda df, tag, keys: df.select(*keys, *(F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in keys))
    joined = name(fine, "f", ["lang", "source"]).alias("a")
    other = name(mid, "m", ["lang"]).withColumnRenamed("lang", "m_lang")
    joined = joined.join(other, F.col("a.lang").eqNullSafe(F.col("m_lang")), "left").crossJoin(F.broadcast(name(top, "t", [])))
    own, wide = F.col("f_n") >= MIN_GROUP, F.col("m_n") >= MIN_GROUP
    pick = lambda c: F.when(own, F.col(f"f_{c}")).when(wide, F.col(f"m_{c}")).otherwise(F.col(f"t_{c}"))
    level = F.when(own, "source").when(wide, "lang").otherwise("all").alias("level")
    away = lambda r: WIDTH * F.coalesce(pick(f"d_{r}"), F.col(f"m_d_{r}"), F.col(f"t_d_{r}"))
    fences = [(pick(f"q50_{r}") - away(r)).cast("long").alias(f"min_{r}") for r in TWO_SIDED]
    fences += [(pick(f"q50_{r}") + away(r)).cast("long").alias(f"max_{r}") for r in TWO_SIDED]
    fences += [(2 * pick(f"q99_{r}") - pick(f"q50_{r}")).cast("long").alias(f"max_{r}") for r in ABOVE]
    return joined.select(F.col("a.lang").alias("k_lang"), F.col("a.source").alias("k_source"), level, *fences)


def judged(rows: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    """rows with base_failed and kept, after a join with the thresholds of their group (nulls match nulls)."""
    same = F.col(lang).eqNullSafe(F.col("k_lang")) & F.col(source).eqNullSafe(F.col("k_source"))
    out = F.lit(False)
    for r in RATES:
        out = out | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    for r in TWO_SIDED:
        out = out | F.coalesce(F.col(r) < F.col(f"min_{r}"), F.lit(False))
    return rows.join(limits, same, "left").withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~out)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, metrics, base_failed, kept, rates, the thresholds they met and the level these are from.

    Null texts count as empty and fail the base rules. Null languages or sources form groups of their own; in a group where all rows
    fail the base rules, thresholds and level are null. Rows are judged one by one, so repeated ids are no matter. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = cut(measured(named, "text", ["id", "lang", "source"]))
    limits = cut(thresholds(cut(sketches(rows, "lang", "source"))))
    out = judged(with_rates(rows), limits, "lang", "source")
    return out.select(F.col("id").alias(id_col), *METRICS, "base_failed", "kept", *RATES, *FENCES, "level")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without the rows that the rules reject; the columns stay.

    Texts are measured once for the sketches and once more beside the join with the thresholds: that is cheaper than
    moving texts to their metrics.
    """
    named = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sketch = cut(sketches(measured(named, "text", ["lang", "source"]), "lang", "source"))
    limits = cut(thresholds(sketch))
    own = [f"_ls_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own)
    at = {c: own[i] for i, c in enumerate(docs.columns)}
    rows = plain.withColumn("m", metrics_of(F.col(at[text_col]))).select(*own, "m.*")
    kept = judged(with_rates(rows), limits, at[lang_col], at[source_col]).where("kept")
    return kept.select(*own).toDF(*docs.columns)
