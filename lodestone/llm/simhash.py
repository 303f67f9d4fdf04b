"""SimHash near-duplicates: byte-position inverted index, count filter on shared positional bytes, verification.

Fingerprints within DISTANCE bits share at least SHARED = BYTES - DISTANCE of their bytes in place. A posting list per
single positional byte has 256 values whatever the corpus, so lists would grow with it and their pairs with
its square. The lists kept are intersections of such lists: of three positions, and of SHARED ones for more than
WIDE fingerprints, so that lists stay short. A pair is tallied in the first list where it meets; those
with fewer than SHARED shared positional bytes are dropped, the others verified on all bits.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import ROW, WORD, components, cut, free, map_texts, with_rows, without

BYTES, DISTANCE, SHINGLE, SEED = 8, 4, 4, 42
SHARED = BYTES - DISTANCE
#: Distinct fingerprints up to which lists of three positions are short (one on average), so that the tally decides.
WIDE = 1 << 24
#: Of lists longer than this, blocks are paired in separate groups; of runs longer than RUN, a spanning forest is made.
BLOCK, RUN = 8192, 64
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the 4-word shingles, repeats included; zero without words."""
    words = _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep and fp, the fingerprint as a signed long."""

    def work(texts: list[str]):
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()]

    return map_texts(docs, text_col, keep, [T.StructField("fp", T.LongType())], work)


def position_sets(width: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(BYTES), width))


def _first_sets(width: int) -> np.ndarray:
    """For each mask of equal bytes, the number of the set that its lowest width positions make; -1 if fewer than SHARED are equal."""
    number = {s: i for i, s in enumerate(position_sets(width))}
    out = np.full(1 << BYTES, -1, np.int64)
    for mask in range(1 << BYTES):
        on = tuple(i for i in range(BYTES) if mask >> i & 1)
        if len(on) >= SHARED:
            out[mask] = number[on[:width]]
    return out


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """Mask of the zero bytes of each of x."""
    zero = x.view(np.uint8).reshape(-1, BYTES) == 0
    return np.packbits(zero, axis=1, bitorder="little")[:, 0]


class _Forest:
    """Union by least element over positions of one run."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _long_run(fps: np.ndarray, blocks: np.ndarray, across: bool) -> list[tuple[int, int]]:
    """A spanning forest of one list's links; across: only those between its two blocks count."""
    forest, out = _Forest(len(fps)), []
    for at in range(0, len(fps), 256):
        near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= DISTANCE
        if across:
            near &= blocks[at : at + 256, None] != blocks[None, :]
        left, right = np.nonzero(near)
        left += at
        for i, j in zip(left[left < right].tolist(), right[left < right].tolist(), strict=True):
            if forest.join(i, j):
                out.append((i, j))
    return out


def links_of_lists(parts: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """From rows (list, i, j, block, fp) sorted by (list, i, j): links a, b between fingerprints that meet there."""
    first_set = _first_sets(width)
    left: list[np.ndarray] | None = None

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, i, j, block, fp = cols
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, len(key)))
        a, b = [], []
        short = (length <= RUN)[run]
        for gap in range(1, min(RUN, int(length.max(initial=1)))):
            at = np.flatnonzero((run[gap:] == run[:-gap]) & short[gap:])
            if not len(at):
                break
            differs = fp[at] ^ fp[at + gap]
            good = (first_set[equal_bytes(differs)] == key[at] >> 32) & (np.bitwise_count(differs) <= DISTANCE)
            good &= (i[at] == j[at]) | (block[at] != block[at + gap])
            a.append(fp[at[good]])
            b.append(fp[at[good] + gap])
        for r in np.flatnonzero(length > RUN):
            s = slice(starts[r], starts[r] + length[r])
            found = _long_run(fp[s], block[s], bool(i[starts[r]] != j[starts[r]]))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            a.append(fp[s][pairs[:, 0]])
            b.append(fp[s][pairs[:, 1]])
        both = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["a", "b"])

    for part in parts:
        cols = [part.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        cols[4] = cols[4].astype(np.int64).view(np.uint64)
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        cutoff = int(np.argmax(last))
        left = [c[cutoff:] for c in cols]
        if cutoff:
            yield solve([c[:cutoff] for c in cols])
    if left is not None:
        yield solve(left)


def lists_of(fps: DataFrame, width: int) -> DataFrame:
    """(list, fp): the number of a set of width positions, above the bytes of fp there."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(0xFF)
    keys = []
    for number, positions in enumerate(position_sets(width)):
        key = F.lit(number << 32).cast("long")
        for k, p in enumerate(positions):
            key = key.bitwiseOR(F.shiftleft(byte(p), 8 * k))
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("list"), "fp")


def links(fps: DataFrame, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """Links (a, b) of distinct fingerprints fps(fp) that connect all that lie within DISTANCE bits of each other.

    Every list is counted; one of more than block fingerprints is split into blocks by a hash, and each pair of blocks
    is a group of its own, so that no task holds more than two blocks of one list.
    """
    width = SHARED - 1 if fps.count() <= wide else SHARED
    lists = lists_of(fps, width)
    zero = F.lit(0).cast("int")
    sized = lists.groupBy("list").count().where(F.col("count") > block)
    hot = cut(sized.select("list", F.ceil(F.col("count") / block).cast("int").alias("n")))
    if hot.isEmpty():
        rows = lists.select("list", zero.alias("i"), zero.alias("j"), zero.alias("block"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))).cast("int")
        rows = lists.join(hot, "list", "left").select("list", "fp", own.alias("block"), F.coalesce("n", F.lit(1)).alias("n"))
        rows = rows.select("list", "fp", "block", F.explode(F.sequence(zero, F.col("n") - 1)).alias("other"))
        rows = rows.select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j")
    return rows.mapInArrow(lambda parts: links_of_lists(parts, width), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (hex), component_id, is_first.

    component_id is the smallest id reachable over links, the row's own included; null ids count only where a
    component has no other. Null or wordless texts have fingerprint zero and are linked like any other. is_first marks one row
    of each component: smallest id, then input order. Repeated rows share a fingerprint. An empty table gives no rows.
    """
    return _marked(docs.withColumn(ROW, F.monotonically_increasing_id()), id_col, text_col).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("top_id").alias("component_id"),
        (F.col("row") == F.col("top_row")).alias("is_first"),
    )


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, fp, top_id, top_row) of docs with ROW: the fingerprint, and the first row of its component."""
    named = docs.select(F.col(id_col).alias("id"), F.col(ROW).alias("row"), F.col(text_col).alias("text"))
    marked = cut(fingerprints(named, "text", ["id", "row"]))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    distinct = cut(marked.groupBy("fp").agg(least))
    edges = cut(links(distinct.select("fp")))
    joined = components(edges)
    member = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    member = cut(member)
    free(edges, distinct)
    tops = cut(member.groupBy("c").agg(F.min("least").alias("top")))
    found = cut(member.join(tops, "c").select("fp", F.col("top.id").alias("top_id"), F.col("top.row").alias("top_row")))
    free(member, tops)
    return marked.join(found, "fp")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component; the columns stay."""
    rows = with_rows(docs)
    return without(rows, _marked(rows, id_col, text_col).where("row != top_row").select(F.col("row").alias(ROW)))
