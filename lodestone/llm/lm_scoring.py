"""Masked pseudo-likelihood: a two-sided window network, trained in numpy, predicts every token from both sides.

Tokens are words between white space, all of the corpus's: the network predicts the most frequent ones and, for the others,
classes by their last letters; within a class the full counts give each word's probability. The numbers of frequent words and classes
follow the vocabulary. The softmax has two levels (a group of classes, then a class), so a token costs about the square root of the classes.

Texts are dealt by hash to shards of many tokens, shards to splits. In each round the shards of one split train the network from
the same start, and the averages of the weights, by tokens, start the next round (federated averaging). All splits
are used, then rounds go on until the loss of held-out texts settles. Weights are added up on the executors; the driver receives one
model a round, whatever the number of partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import ROW, WORD, cut, text_slices

HIDDEN = 16
OFFSETS = (-2, -1, 1, 2)
BATCH, RATE = 2048, 1.0
#: Classes that are words of their own and classes of the others, per bit of the vocabulary's size; the least numbers.
TOP_PER_BIT, RARE_PER_BIT, LEAST_TOP, LEAST_RARE = 16, 4, 159, 32
#: Words, at most, whose counts travel with the tasks; the counts of all others are joined.
HEAD = 200_000
#: Tokens of a shard at least, and tokens between two looks at a shard's rows.
SHARD, CHUNK = 500_000, 64 * BATCH
#: One text in so many is held out; splits of the shards, one a round; a round's share of the loss below which it has settled; rounds at most.
HELD_OUT, SPLITS, SETTLED, MOST_ROUNDS = 50, 16, 0.002, 64
#: Classes as stored, and units of a nat: integers add up to the same sum in any order.
CODE, SCALE = np.uint16, 10_000

Params = dict[str, np.ndarray]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, each token's place among them, tokens of each text): the tokens are the matches of WORD."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    at, sizes = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # White space at either end leaves an empty word there.
    none = pc.index(coded.dictionary, "").as_py()
    if none >= 0:
        some = at != none
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
        at = at[some]
    return coded.dictionary, at, sizes


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, added up within slices and tasks before the shuffle."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in text_slices(part, 0):
                words, at, _ = words_of(piece.column(0))
                n = np.bincount(at, minlength=len(words))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(n[some])], ["word", "n"])

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _level():
    return F.floor(F.log2("n") * 16).cast("int")


def level_sizes(counted: DataFrame) -> list[tuple[int, int]]:
    """(level, words) by falling level: sixteenths of a doubling of the count, so no task or driver sorts the vocabulary."""
    return sorted(((r.k, r.words) for r in counted.groupBy(_level().alias("k")).agg(F.count("*").alias("words")).collect()), reverse=True)


def least_level(sizes: list[tuple[int, int]], most: int) -> int | None:
    """The least level such that the words from it on are at most `most`; None if the highest has more. Words of a level stay together."""
    total, least = 0, None
    for k, words in sizes:
        total += words
        if total > most:
            break
        least = k
    return least


def words_from(counted: DataFrame, least: int | None) -> list[tuple[str, int]]:
    """(word, n) from a level on, by falling n, then by word."""
    if least is None:
        return []
    return sorted(((r.word, r.n) for r in counted.where(_level() >= least).collect()), key=lambda x: (-x[1], x[0]))


def classes_for(words: int) -> tuple[int, int]:
    """(words that are classes of their own, classes of the others): both follow the logarithm of the vocabulary."""
    bits = math.log2(words + 1)
    return max(LEAST_TOP, int(TOP_PER_BIT * bits)), max(LEAST_RARE, int(RARE_PER_BIT * bits))


class Tokens:
    """Words to classes: the top words' ranks, then a class by the last three letters."""

    def __init__(self, top: list[str], rare: int):
        self.known = {w: i for i, w in enumerate(top)}
        self.first, self.rare = len(top), rare

    def of(self, word: str) -> int:
        c = self.known.get(word)
        return self.first + zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % self.rare if c is None else c


def parameters(counts: np.ndarray, seed: int = 17) -> Params:
    """The common start: small random weights, biases from the classes' counts."""
    rnd, classes = np.random.default_rng(seed), len(counts)
    size = math.ceil(math.sqrt(classes))
    groups = -(-classes // size)
    share = np.zeros(groups * size)
    share[:classes] = (counts + 1) / (counts.sum() + classes)
    share = share.reshape(groups, size)
    leaf = np.full(groups * size, -1e4)
    leaf[:classes] = np.log((share / share.sum(axis=1, keepdims=True)).ravel()[:classes])
    start = {
        "embed": rnd.normal(0, 0.1, (len(OFFSETS), classes + 1, HIDDEN)),
        "hidden": np.zeros(HIDDEN),
        "leaf": rnd.normal(0, 0.1, (groups, HIDDEN, size)),
        "leaf_bias": leaf.reshape(groups, size),
        "top": rnd.normal(0, 0.1, (HIDDEN, groups)),
        "top_bias": np.log(share.sum(axis=1)),
    }
    return {k: v.astype(np.float32) for k, v in start.items()}


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(values: np.ndarray, start: Params) -> Params:
    out, at = {}, 0
    for k, like in sorted(start.items()):
        out[k] = values[at : at + like.size].reshape(like.shape).astype(like.dtype)
        at += like.size
    return out


def padded(codes: np.ndarray, sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of texts with two pads around each text, and the places of the tokens."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(codes)) + 2 * (text + 1)
    row = np.full(len(codes) + 2 * (len(sizes) + 1), pad, np.int64)
    row[places] = codes
    return row, places


def _softmax(logits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The own entries' log-probabilities, and all terms (in place of logits) with their sums behind them.

    Hidden units lie within 1, so logits stay far below where exp overflows; capping them guards a model that diverges.
    """
    mine = logits[np.arange(len(own)), own]
    np.minimum(logits, 60, out=logits)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return np.minimum(mine, 60) - np.log(sums), sums


class Step(NamedTuple):
    """A batch, ordered by the groups of its tokens' classes: order of its places, neighbours, hidden layer, and terms with their sums."""

    order: np.ndarray
    near: list[np.ndarray]
    hidden: np.ndarray
    group: np.ndarray
    slot: np.ndarray
    ends: list[int]
    log_prob: np.ndarray
    top: np.ndarray
    leaf: np.ndarray
    top_sums: np.ndarray
    leaf_sums: np.ndarray


def forward(p: Params, row: np.ndarray, at: np.ndarray) -> Step:
    size = p["leaf"].shape[2]
    group = row[at] // size
    order = np.argsort(group.astype(np.uint16), kind="stable")
    at, group = at[order], group[order]
    slot = row[at] - group * size
    ends = np.searchsorted(group, np.arange(len(p["leaf"]) + 1)).tolist()
    near = [row[at + o] for o in OFFSETS]
    hidden = p["hidden"] + sum(p["embed"][k][x] for k, x in enumerate(near))
    np.tanh(hidden, out=hidden)
    top, leaf = hidden @ p["top"] + p["top_bias"], p["leaf_bias"][group]
    for g, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        if a < b:
            leaf[a:b] += hidden[a:b] @ p["leaf"][g]
    first, top_sums = _softmax(top, group)
    second, leaf_sums = _softmax(leaf, slot)
    return Step(order, near, hidden, group, slot, ends, first + second, top, leaf, top_sums, leaf_sums)


def train(p: Params, row: np.ndarray, places: np.ndarray, rate: float = RATE) -> None:
    """One pass of gradient descent over all places, in place."""
    for i in range(0, len(places), BATCH):
        s = forward(p, row, places[i : i + BATCH])
        each = np.arange(len(s.order))
        step = p["hidden"].dtype.type(rate * min(1.0, len(each) / BATCH) / len(each))
        for terms, sums, own in ((s.top, s.top_sums, s.group), (s.leaf, s.leaf_sums, s.slot)):
            terms *= (1 / sums)[:, None]
            terms[each, own] -= 1
        back = s.top @ p["top"].T
        for g, (a, b) in enumerate(zip(s.ends, s.ends[1:], strict=False)):
            if a < b:
                back[a:b] += s.leaf[a:b] @ p["leaf"][g].T
                p["leaf"][g] -= step * (s.hidden[a:b].T @ s.leaf[a:b])
        some = [g for g, (a, b) in enumerate(zip(s.ends, s.ends[1:], strict=False)) if a < b]
        p["leaf_bias"][some] -= step * np.add.reduceat(s.leaf, [s.ends[g] for g in some], axis=0)
        p["top"] -= step * (s.hidden.T @ s.top)
        p["top_bias"] -= step * s.top.sum(axis=0)
        back *= 1 - s.hidden * s.hidden
        p["hidden"] -= step * back.sum(axis=0)
        back *= 4 * step
        for k, x in enumerate(s.near):
            o = np.argsort(x.astype(np.uint16), kind="stable")
            x = x[o]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            p["embed"][k][x[first]] -= np.add.reduceat(back[o], first, axis=0)


def token_scores(p: Params, row: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Log-probability of each token's class given its neighbours on both sides."""
    out = np.zeros(len(places))
    for i in range(0, len(places), BATCH):
        s = forward(p, row, places[i : i + BATCH])
        out[i : i + BATCH][s.order] = s.log_prob
    return out


def _joined(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(codes), CODE).astype(np.int64), np.array([len(c) for c in codes], np.int64) // CODE().itemsize


def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(shard, texts) of rows (shard, codes) sorted by shard: where they end depends on the texts, not on batches or files."""
    now, texts, size = None, [], 0
    for part in parts:
        for i in range(0, part.num_rows, 256):
            for shard, codes in zip(*(part.column(c).slice(i, 256).to_pylist() for c in (0, 1)), strict=True):
                if texts and (shard != now or size >= CHUNK):
                    yield now, texts
                    texts, size = [], 0
                now = shard
                texts.append(codes)
                size += len(codes) // CODE().itemsize
    if texts:
        yield now, texts


def one_round(coded: DataFrame, start: Params, pad: int) -> Params:
    """The average, by tokens, of what a pass over each shard makes of start."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, own, n, now = 0.0, 0, None, 0, None
        for shard, texts in chunks(parts):
            if shard != now:
                if n:
                    total, seen = total + flat(own).astype(np.float64) * n, seen + n
                own, n, now = {k: v.copy() for k, v in start.items()}, 0, shard
            row, places = padded(*_joined(texts), pad)
            train(own, row, places)
            n += len(places)
        if n:
            total, seen = total + flat(own).astype(np.float64) * n, seen + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), seen))], ["k", "w", "n"])

    summed = coded.select("shard", "codes").mapInArrow(work, "k long, w double, n long").groupBy("k").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    model = sorted((r.k, r.w / r.n) for r in summed.collect())
    return unflat(np.array([v for _, v in model]), start) if model else start


def mean_loss(coded: DataFrame, model: Params, pad: int) -> float | None:
    """Mean negative log-probability of the classes of all texts; None without tokens."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(parts):
            scores = token_scores(model, *padded(*_joined(texts), pad))
            yield pa.RecordBatch.from_arrays([pa.array([-float(scores.sum())]), pa.array([len(scores)])], ["loss", "n"])

    loss, n = coded.select("shard", "codes").mapInArrow(work, "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
    return loss / n if n else None


def trained(coded: DataFrame, start: Params, splits: int, pad: int) -> tuple[Params, list[float]]:
    """The model, and the held-out losses of the start and of the models from the last but one round of the first pass on.

    Rounds go over all splits, then on until the loss settles. Texts are held out by hash; a corpus too small to have any is judged by
    its own loss.
    """
    held, own = coded.where("held"), coded.where("NOT held")
    loss = mean_loss(held, start, pad)
    if loss is None:
        held, loss = own, mean_loss(own, start, pad)
    if loss is None:
        return start, []
    model, losses = start, [loss]
    for t in range(MOST_ROUNDS):
        model = one_round(own.where(F.col("split") == t % splits), model, pad)
        if t + 2 >= splits:
            losses.append(mean_loss(held, model, pad))
        if t + 1 >= splits and losses[-2] - losses[-1] < SETTLED * losses[-2]:
            break
    return model, losses


def coded_texts(named: DataFrame, top: list[str], rare: int, totals: np.ndarray, head: dict[str, int]) -> DataFrame:
    """id, row, h, the classes of the words, the sum of log p(word | class) in units, and the words outside head.

    Those words' terms are without log n(word), which comes from a join with the counts: the sum is whole after it.
    """
    log_totals = np.log(np.maximum(totals, 1))
    schema = T.StructType([*(named.schema[c] for c in ("id", ROW, "h")), T.StructField("codes", T.BinaryType()), T.StructField("inside", T.LongType()), T.StructField("others", T.ArrayType(T.StringType()))])

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(top, rare)
        for part in parts:
            for piece in text_slices(part, 3):
                words, at, sizes = words_of(piece.column(3))
                plain = words.to_pylist()
                classes = np.fromiter(map(tokens.of, plain), np.int64, len(plain))
                counts = np.array([head.get(w, 0) for w in plain], np.int64)
                inside = np.round((np.log(np.maximum(counts, 1)) - log_totals[classes]) * SCALE).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sums = np.concatenate([[0], np.cumsum(inside[at])])[ends]
                codes = classes[at].astype(CODE)
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * codes.itemsize).astype(np.int32)), pa.py_buffer(codes)])
                far = np.flatnonzero(counts[at] == 0)
                others = pa.ListArray.from_arrays(pa.array(np.searchsorted(far, ends), pa.int32()), words.take(pa.array(at[far])))
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in range(3)), packed, pa.array(sums[1:] - sums[:-1]), others], schema.names)

    return named.select("id", ROW, "h", "text").mapInArrow(code, schema)


class Fitted(NamedTuple):
    """A corpus as classes, its word counts, the model, the losses of its training and the classes' counts."""

    coded: DataFrame
    counted: DataFrame
    model: Params
    losses: list[float]
    totals: np.ndarray
    top: list[str]


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """Counts, classes and the network of all texts."""
    counted = cut(word_counts(docs, text_col))
    sizes = level_sizes(counted)
    n_top, rare = classes_for(sum(n for _, n in sizes))
    top = words_from(counted, least_level(sizes, n_top))
    head = words_from(counted, least_level(sizes, max(HEAD, n_top)))
    words = [w for w, _ in top]
    ending = F.crc32(F.encode(F.right("word", F.lit(3)), "utf-8")) % rare
    others = {r.c: r.n for r in counted.where(~F.col("word").isin(words)).groupBy(ending.alias("c")).agg(F.sum("n").alias("n")).collect()}
    totals = np.array([n for _, n in top] + [others.get(c, 0) for c in range(rare)], float)
    named = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias(ROW), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    # Shards go by hash, so training doesn't see how the table is cut into files; they lengthen with the corpus.
    shards = max(1, math.ceil(totals.sum() / max(SHARD, 100 * math.sqrt(totals.sum()))))
    splits = min(SPLITS, shards)
    files = min(shards, max(math.ceil(shards / 8), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shard = F.pmod("h", F.lit(shards))
    placed = coded_texts(named, words, rare, totals, dict(head)).withColumns({"shard": shard, "held": F.pmod(F.xxhash64("h"), F.lit(HELD_OUT)) == 0, "split": (shard % splits).cast("int")})
    order = ["held", "split", "shard", "h"]
    coded = cut(placed.repartition(files, "shard").sortWithinPartitions(*order), by=["held", "split"])
    model, losses = trained(coded, parameters(totals), splits, len(totals))
    return Fitted(coded, counted, model, losses, totals, words)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, log_prob (summed), mean_log_prob, pseudo_perplexity.

    Every word of the corpus is in the vocabulary: log p(word) = log p(class | neighbours) + log p(word | class), the second
    term from the counts of all texts. HEAD words' counts travel to the workers, the others' are joined; HEAD changes no result.
    A null, empty or blank text has no tokens, log_prob 0 and null means. Repeated rows score alike. Words of equal counts
    are classes of their own together or not at all. An empty table gives no rows. Counts and training cover all texts.
    """
    coded, counted, model, _, totals, _ = fitted(docs, id_col, text_col)
    pad = len(totals)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 512):
                piece = part.slice(i, 512)
                codes, sizes = _joined(piece.column(2).to_pylist())
                units = np.round(token_scores(model, *padded(codes, sizes, pad)) * SCALE).astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(units)])[np.concatenate([[0], np.cumsum(sizes)])]
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in (0, 1, 3)), pa.array(sizes), pa.array(sums[1:] - sums[:-1])], ["id", ROW, "inside", "n_tokens", "outer"])

    schema = T.StructType([coded.schema["id"], *(T.StructField(c, T.LongType()) for c in (ROW, "inside", "n_tokens", "outer"))])
    scored = coded.select("id", ROW, "codes", "inside").mapInArrow(score, schema)
    logs = F.round(F.log("n") * SCALE).cast("long")
    far = coded.where(F.size("others") > 0).select(ROW, F.explode("others").alias("word"))
    tail = far.join(counted.select("word", logs.alias("log_n")), "word").groupBy(ROW).agg(F.sum("log_n").alias("tail"))
    total = (F.col("outer") + F.col("inside") + F.coalesce(F.col("tail"), F.lit(0))) / SCALE
    out = scored.join(tail, ROW, "left").withColumn("log_prob", F.when(F.col("n_tokens") > 0, total).otherwise(0.0))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("pseudo_perplexity"))
