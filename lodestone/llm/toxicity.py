"""Toxicity by a noisy channel: Viterbi decoding of character lattices, then a score of the restored text.

Words that look disguised (leetspeak, marks between letters, repeated letters, spaced-out letters) become
lattices of what each character may stand for. A character trigram model of the whole corpus and the costs of each
disguise choose the reading. A logistic model over word stems, fitted to labelled rows, scores the restored words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, map_texts

#: Labelled rows for the fit: those of the smallest hashes of their ids, so many at most.
LABELLED_ROWS = 12_000
#: Stems kept for the logistic model (its size, whatever the corpus's), and the labelled documents that one needs.
STEMS, SUPPORT = 512, 4
MEMORY = 300_000
#: What a character may stand for, beside itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
FILL = frozenset(".-_*~'`^,:;/\\|#+")
#: Costs in nats: a stand-in, a dropped mark, a kept mark, a shortened run, a new word inside a spaced run.
SUBSTITUTE, DROP, KEEP, SHORTEN, SPLIT = 1.0, 1.5, 30.0, 0.5, 1.0
#: Letters of the model: boundary, a-z, lower-case Latin-1, any other letter.
LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
CODE = {c: i + 1 for i, c in enumerate(LATIN)}
OTHER = len(LATIN) + 1
LETTERS = OTHER + 1
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_RUNS = re.compile(r"(.)\1+")
_TRIPLE = re.compile(r"(.)\1\1")
_SPLIT = re.compile(r"[\W_]+")
_HARD = re.compile("[^\\w" + re.escape("".join(c for c in LEET if not c.isalnum())) + "]+")
_TABLE = np.zeros(0x10000, np.int64)
for _c in range(0x10000):
    if (_x := chr(_c)).isalpha():
        _TABLE[_c] = CODE.get(_x, OTHER)


def letter_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x10000, _TABLE[np.minimum(points, 0xFFFF)], OTHER)


def trigram_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(gram, n) of all texts in lower case, added up within tasks before the shuffle; at most LETTERS**3 rows."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for part in parts:
            for i in range(0, part.num_rows, 256):
                texts = [t for t in part.column(0).slice(i, 256).to_pylist() if t]
                x = letter_codes("  ".join(["", *texts, ""]).lower())
                total += np.bincount((x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:], minlength=LETTERS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    return docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def trigram_model(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b), interpolated with the bigram and unigram estimates."""
    n = np.zeros(LETTERS**3)
    n[grams] = counts
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    one = n.sum(axis=(0, 1)) + 1
    one /= one.sum()
    two = n.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (n + 5 * two) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


def disguised(word: str) -> bool:
    """Whether a lower-case word without outer marks has letters and anything that isn't plain spelling."""
    if word.isalpha():
        return bool(_TRIPLE.search(word))
    return any(c.isalpha() for c in word)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, its readings and their costs."""
    out = []
    for m in re.finditer(r"(.)\1*", word, re.DOTALL):
        c, n = m[1], len(m[0])
        whole = min(n, 3)
        if c.isalpha():
            options = [(c * whole, 0.0 if n < 3 else SHORTEN)]
            options += [(c * k, SHORTEN * (n - k if n < 3 else 1)) for k in range(1, min(n, 3)) if k < whole]
        else:
            options = [(s * k, SUBSTITUTE) for s in LEET.get(c, "") for k in range(1, whole + 1) if k == 1 or k == n]
            if c in FILL or not c.isalnum():
                options.append(("", DROP))
            options.append((c, KEEP))
        out.append(options)
    return out


def restore(word: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest reading of word; of a spaced-out run, blanks mark where new words start."""
    # Readings are linked backwards, so the time is linear in the length.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(word):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        if spaced:
            options = options + [(" " + o, c + SPLIT) for o, c in options if o]
        for (a, b), (cost, path) in states.items():
            for reading, extra in options:
                x, y, total = a, b, cost + extra
                for c in reading:
                    z = CODE.get(c, OTHER if c.isalpha() else 0)
                    total -= float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, reading))
        states = after
    path = min(((v[0] - float(model[k[0], k[1], 0]), v[1]) for k, v in states.items()), key=lambda e: e[0])[1]
    out = []
    while path is not None:
        path, reading = path
        out.append(reading)
    return "".join(reversed(out)).strip()


def restored_words(token: str, model: np.ndarray) -> list[str]:
    """Words that one lower-case token stands for: its parts between marks and, if they or it look disguised, their readings.

    Parts are taken between all marks and between those that stand for no letter ('dumb,1d!0t').
    """
    core = _TRIM.sub("", token)
    if core.isalpha() and not _TRIPLE.search(core):
        return [core]
    parts = _SPLIT.split(core)
    words = [w for w in parts if w.isalpha()]
    for form in dict.fromkeys((core, token, *parts, *_HARD.split(token))):
        if disguised(form):
            words.append(restore(form, model))
    return words


def words_of(text: str, model: np.ndarray, memory: dict[str, list[str]]) -> set[str]:
    """All restored words of a text."""
    low = text.lower()
    out: set[str] = set()
    for token in set(low.split()):
        found = memory.get(token)
        if found is None:
            if len(memory) >= MEMORY:
                memory.clear()
            found = memory[token] = restored_words(token, model)
        out.update(found)
    for run in set(_SPACED.findall(low)):
        joined = run.replace(" ", "").replace("\t", "")
        out.update(restore(joined, model, spaced=True).split())
    return out


def stems_of(word: str) -> list[str]:
    """The whole word, marked, and its beginnings of 4 to 8 letters."""
    return ["=" + word, *(word[:k] for k in range(4, min(len(word), 8) + 1))]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent; weights don't fall below zero: stems are evidence for, never against."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    n = max(1, len(y))
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    top = float(x.sum(axis=1).max(initial=0)) + 1
    rate, seen_w, seen_b = 4.0 / top, w.copy(), b
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ seen_w + seen_b, -30, 30)))
        new_w = np.maximum(0, seen_w - rate * (x.T @ (p - y) / n + ridge / n * seen_w))
        new_b = seen_b - rate * float((p - y).mean())
        k = t / (t + 3)
        seen_w, seen_b = new_w + k * (new_w - w), new_b + k * (new_b - b)
        w, b = new_w, new_b
    return w.astype(float), b


def _remainder():
    return F.crc32(F.encode(F.col("id").cast("string"), "utf-8")) % 5


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, labelled_rows: int) -> tuple[np.ndarray, dict[str, int], np.ndarray, float]:
    """The character model, and the classifier's stems, weights and base. Of rows that share an id, the least text is fitted."""
    counted = cut(trigram_counts(docs, text_col))
    grams = counted.collect()
    model = trigram_model(np.array([r.gram for r in grams], np.int64), np.array([r.n for r in grams], float))
    truth = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    truth = truth.where(_remainder() != 0).groupBy("id").agg(F.max("y").alias("y"))
    truth = truth.orderBy(F.xxhash64("id"), "id").limit(labelled_rows)
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = cut(named.join(F.broadcast(truth), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("y", "text"))
    return model, *_classifier(sample, model)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Labels count only where crc32 of the id as text isn't divisible by 5; null labels don't count, of repeated
    ones the largest does. Ids, languages and sources are never inputs of a score. At most labelled_rows labelled documents are fitted
    (the bound of this classifier); the character model counts all texts. Null texts are empty; without words the score
    is the fitted base rate; without labels it is 0. A null id counts as held out. An empty table gives no rows.
    """
    model, stems, weights, base = fitted(docs, labels, id_col, text_col, label_col, labelled_rows)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(texts: list[str]):
        memory, known = _memory(zlib.crc32(model.tobytes()))
        scores = []
        for t in texts:
            hits = set()
            for w in words_of(t, model, memory):
                own = known.get(w)
                if own is None:
                    if len(known) >= MEMORY:
                        known.clear()
                    own = known[w] = tuple(stems[s] for s in stems_of(w) if s in stems)
                hits.update(own)
            z = base + float(weights[list(hits)].sum()) if hits else base
            scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return [scores]

    scored = map_texts(named, "text", ["id"], [T.StructField("score", T.DoubleType())], work)
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(_remainder() == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


_MEMORY: dict[int, tuple[dict, dict]] = {}


def _memory(key: int) -> tuple[dict, dict]:
    """What a worker remembers under one model."""
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = ({}, {})
    return _MEMORY[key]


def _classifier(sample: DataFrame, model: np.ndarray) -> tuple[dict[str, int], np.ndarray, float]:
    """Stems that labelled toxic documents hold far more often than others, their weights and the base."""

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[str]] = {}
        for part in parts:
            for i in range(0, part.num_rows, 256):
                piece = part.slice(i, 256)
                seen = {0: Counter(), 1: Counter()}
                for y, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    seen[1 if y else 0].update({s for w in words_of(t, model, memory) for s in stems_of(w)})
                both = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([seen[k][s] for s in both], pa.int64()) for k in (0, 1))], ["stem", "clean", "toxic"])

    totals = {r.y: r.n for r in sample.groupBy(F.when(F.col("y") != 0, 1).otherwise(0).alias("y")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean + toxic:
        return {}, np.zeros(0), -30.0
    counts = sample.select("y", "text").mapInArrow(features, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    sure = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counts.where(F.col("t") >= SUPPORT).withColumn("odds", odds).withColumn("sure", sure).where("odds > 1.5 AND sure > 2")
    chosen = [r.stem for r in best.orderBy(F.desc("sure"), "stem").limit(STEMS).collect()]
    stems = {s: i for i, s in enumerate(chosen)}

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[str]] = {}
        for part in parts:
            hits = [sorted({stems[s] for w in words_of(t, model, memory) for s in stems_of(w) if s in stems}) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hits, pa.list_(pa.int32()))], ["y", "hits"])

    data = sample.select("y", "text").mapInArrow(rows, "y int, hits array<int>").collect()
    x, y = np.zeros((len(data), len(stems))), np.array([r.y != 0 for r in data], float)
    for i, r in enumerate(data):
        x[i, r.hits] = 1
    weights, base = fit(x, y)
    return stems, weights, base
