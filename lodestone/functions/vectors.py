"""Vector expressions: cosine, hashing embeddings and int8 quantization."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens whose buckets a task remembers.
REMEMBERED = 200_000
_TOKEN = re.compile("[a-z0-9_]+")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot_literal(a: Column, b: Sequence[float]) -> Column:
    """Unrolled, so that it stays inside generated code."""
    out = F.lit(0.0)
    for i, x in enumerate(b):
        out = out + F.get(a, F.lit(i)).cast("double") * F.lit(float(x))
    return out


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where either has no length, or lengths of the arrays differ."""
    size = norm(a) * norm(b)
    return F.when((size > 0) & (F.size(a) == F.size(b)), dot(a, b) / size)


def tokens(text: Column) -> Column:
    """Words of the keyword analyzer: lower case, [a-z0-9_]+."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def hash_vectors(df: DataFrame, keep: Sequence[str], text: str, dim: int = 64) -> DataFrame:
    """(keep, dense array<double>) for rows with at least one token: L2-normalized counts of tokens, by the first 32 bits of their md5 modulo dim.

    Each row's vector is made where the row is, in Arrow batches; nothing is shuffled.
    """
    rows = df.select(*keep, F.lower(F.col(text)).alias("_text"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("dense", T.ArrayType(T.DoubleType()))])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(REMEMBERED)
        def bucket_of(word: str) -> int:
            return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim

        for part in parts:
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                some, vectors = [], []
                for i, low in enumerate(piece.column(len(keep)).to_pylist()):
                    words = _TOKEN.findall(low or "")
                    if not words:
                        continue
                    counts = np.bincount([bucket_of(w) for w in words], minlength=dim).astype(float)
                    some.append(i)
                    vectors.append(counts / np.sqrt((counts * counts).sum()))
                flat = pa.array(np.concatenate(vectors) if vectors else np.zeros(0), pa.float64())
                offsets = pa.array(np.arange(len(vectors) + 1) * dim, pa.int32())
                taken = [piece.column(k).take(pa.array(some, pa.int64())) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*taken, pa.ListArray.from_arrays(offsets, flat)], schema.names)

    return rows.mapInArrow(work, schema)


def hash_embeddings(df: DataFrame, keep: Sequence[str], text: str, dim: int = 64) -> DataFrame:
    """hash_vectors as array<float>."""
    return hash_vectors(df, keep, text, dim).withColumn("dense", F.col("dense").cast("array<float>"))


def hash_buckets(df: DataFrame, keep: Sequence[str], text: str, dim: int = 64) -> DataFrame:
    """(keep, bucket, value): the entries of hash_vectors that aren't zero."""
    long = hash_vectors(df, keep, text, dim).select(*keep, F.posexplode("dense").alias("bucket", "value"))
    return long.where("value != 0")


def clip_scale(df: DataFrame, vector: str, share: float = 0.99, grid: int = 10_000) -> float:
    """Where the given share of all components' sizes ends, rounded up to a step of 1 / grid.

    Steps are counted with map-side sums; the driver receives one row per step that occurs (at most grid + 1 for unit vectors).
    """
    step = F.ceil(F.abs(F.col("x").cast("double")) * grid).cast("long")
    steps = sorted(tuple(r) for r in df.select(F.explode(vector).alias("x")).where("x IS NOT NULL").groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect())
    total, upto = sum(n for _, n in steps), 0
    for k, n in steps:
        upto += n
        if upto >= share * total:
            return max(k, 1) / grid
    return 1.0


def quantize(a: Column, scale: Column) -> Column:
    """int8 codes of a vector clipped at scale."""
    code = lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") / scale)) * 127)
    return F.transform(a, lambda x: code(x).cast("tinyint"))
