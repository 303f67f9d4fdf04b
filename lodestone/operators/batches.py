"""Greedy batches of ordered items: by characters and count, by tokens, and running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT_CHARS, FLAT_TEXTS = 40_000, 64
SPAN_TOKENS, SPAN_ITEMS = 20_000, 16_000
RERANK_TOKENS = 600_000


def greedy_bins(sizes: Column, max_total: int, max_items: int) -> Column:
    """Batch number of each of an array of sizes: a new batch where the next item would pass either limit; an item too large stands alone."""
    start = F.struct(F.array().cast("array<int>").alias("bins"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("items"))

    def step(s: Column, x: Column) -> Column:
        fresh = (s["items"] > 0) & ((s["total"] + x > max_total) | (s["items"] >= max_items))
        number = F.when(fresh, s["bin"] + 1).otherwise(s["bin"])
        total = F.when(fresh, x).otherwise(s["total"] + x)
        items = F.when(fresh, 1).otherwise(s["items"] + 1)
        return F.struct(F.concat(s["bins"], F.array(number)).alias("bins"), number.alias("bin"), total.alias("total"), items.alias("items"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), start, step, lambda s: s["bins"])


def packed(items: DataFrame, by: list[str], order: str, size: str, max_total: int = FLAT_CHARS, max_items: int = FLAT_TEXTS) -> DataFrame:
    """(by, order, size, batch) with items packed in order within by.

    A by-group is gathered in one row, so it must be bounded: the chunks of a document, or a segment of a longer run.
    """
    lists = items.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, size))).alias("xs"))
    bins = greedy_bins(F.transform("xs", lambda x: x[size]), max_total, max_items)
    zipped = lists.select(*by, F.explode(F.arrays_zip("xs", bins.alias("batch"))).alias("z"))
    return zipped.select(*by, F.col(f"z.xs.{order}").alias(order), F.col(f"z.xs.{size}").alias(size), F.col("z.batch").alias("batch"))


def within_budget(found: DataFrame, size: str, budget: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first rows whose running size stays within budget, the very first always. found is bounded: candidates of a search."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    rows = found.withColumn("_n", F.row_number().over(w)).withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("running") <= budget) | (F.col("_n") == 1)).drop("_n")
