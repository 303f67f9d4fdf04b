"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equal row counts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut

BITS = 5


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (rows of axes, each coordinate under 2**bits), after Skilling (2004)."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def ordered(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): df sorted across range partitions and written with `at`, and the rows and weights of each partition.

    `at` is the partition's number above 33 bits of the place in it. Only one row per partition describes them.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = cut(placed.withColumn("at", F.monotonically_increasing_id()))
    return rows, rows.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("rows"), *([F.sum("n").alias("n")] if "n" in df.columns else []))


def value_edges(narrow: DataFrame, column: str, bins: int) -> list:
    """The values of a column of any ordered type at its bins - 1 quantiles over all rows; a frequent value stands at several.

    Different values are counted first; their order is that of a range partitioning, and the values where a quantile is reached are
    all that the driver receives besides a weight per partition.
    """
    counts = narrow.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    rows, sizes = ordered(counts, "v")
    starts, total = [], 0
    for p, n in sorted((r.p, r.n) for r in sizes.collect()):
        starts.append((p, total))
        total += n
    if not total:
        return []
    begin = narrow.sparkSession.createDataFrame(starts, "p long, start long")
    p = F.shiftright("at", 33)
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("at"))
    ranked = rows.withColumn("p", p).withColumn("own", upto).join(F.broadcast(begin), "p").withColumn("upto", F.col("own") + F.col("start"))
    # A value stands at the quantiles that it reaches and the values before it don't.
    times = F.expr(f"upto * {bins} div {total} - (upto - n) * {bins} div {total}").alias("times")
    reached = ranked.select("v", times).where("times > 0").collect()
    return [v for v, k in sorted((r.v, r.times) for r in reached) for _ in range(k)][: bins - 1]


def hilbert_shards(
    docs: DataFrame,
    shards: int = 24,
    dims: Sequence[str] = ("source", "lang", "n_chars"),
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """One row per document: id, size, text_crc32, law 'rows', shard, slot, grown_shard (null), hilbert.

    Dimensions are cut at quantiles of their values (numbers approximately, other types exactly) into at most 2**bits bins, equal values
    in one and a frequent value leaving the next ones empty, so that few values spread over the whole axis. Rows are ordered by the
    curve index, then by a hash of the text and the id, and the order is cut into runs whose counts differ by at most one. A null text has size 8 and the checksum of no bytes; null dimensions take the lowest bin; a missing dimension
    column is an error. Ties end with the row's place in the input. An empty table gives no rows.
    Only ids, dimensions and numbers are shuffled.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    number = [isinstance(kinds[d], T.NumericType) for d in dims]
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("crc"),
            F.xxhash64(text).alias("tie"),
            *(F.col(d).cast("double" if number[i] else "string").alias(f"d{i}") for i, d in enumerate(dims)),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    levels = [k / 2**bits for k in range(1, 2**bits)]
    numbers = [F.percentile_approx(f"d{i}", levels, 10000).alias(f"d{i}") for i in range(len(dims)) if number[i]]
    cuts = narrow.agg(F.count("*"), *numbers).first()
    edges = [np.array(cuts[f"d{i}"] or [], dtype=float) if number[i] else value_edges(narrow, f"d{i}", 2**bits) for i in range(len(dims))]

    @F.pandas_udf(T.LongType())
    def curve(*columns: pd.Series) -> pd.Series:
        bins = []
        for e, c, n in zip(edges, columns, number, strict=True):
            if n:
                bins.append(np.where(c.isna(), 0, np.searchsorted(e, c.to_numpy(dtype=float), side="left")))
            else:
                codes, values = pd.factorize(c, use_na_sentinel=True)
                at = np.array([*(bisect_left(e, v) for v in values), 0], np.int64)
                bins.append(at[codes])
        return pd.Series(hilbert_index(np.stack(bins, axis=1), bits))

    indexed = narrow.select("id", "size", "crc", "tie", "row", curve(*(f"d{i}" for i in range(len(dims)))).alias("hilbert"))
    placed, sizes = ordered(indexed, "hilbert", "tie", "id", "row")
    starts, total = [], 0
    for p, n in sorted((r.p, r.rows) for r in sizes.collect()):
        starts.append((p, total))
        total += n
    begin = spark.createDataFrame(starts, "p long, start long")
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    out = placed.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(begin), "p").withColumn("place", place).withColumn("shard", shard)
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"place - (shard * {max(total, 1)} + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )
