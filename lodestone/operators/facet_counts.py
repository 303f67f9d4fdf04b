"""Facet listings: keys, values, capped overviews, and declared against stored values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALUES, OVERVIEW, ONE_KEY, COLLAPSE = 10_000, 50, 1000, 50


def facet_keys(points: DataFrame, column: str = "facets") -> DataFrame:
    """(key, points): how many points carry a key."""
    return points.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("points"))


def facet_values(points: DataFrame, key: str, limit: int = VALUES, column: str = "facets") -> DataFrame:
    """(value, points) of one key, most first; a point counts once per value."""
    values = F.array_distinct(F.try_element_at(F.col(column), F.lit(key)))
    counts = points.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("points"))
    return counts.orderBy(F.desc("points"), "value").limit(limit)


def facet_pairs(points: DataFrame, *by: str, column: str = "facets") -> DataFrame:
    """(by, key, value, points) of all keys in one pass."""
    entry = points.select(*by, F.explode(F.map_entries(column)).alias("e"))
    long = entry.select(*by, F.col("e.key").alias("key"), F.explode(F.array_distinct("e.value")).alias("value"))
    return long.groupBy(*by, "key", "value").agg(F.count("*").alias("points"))


def facet_overview(points: DataFrame, cap: int = OVERVIEW, column: str = "facets") -> DataFrame:
    """(key, points, distinct_values, values, truncated): each key's cap first values by count, then name.

    One scan: each point adds its values and, as a value of null, itself to a key's counts, and both uses of these counts share a shuffle.
    """
    entry = points.select(F.explode(F.map_entries(column)).alias("e"))
    marks = F.array_append(F.filter(F.array_distinct("e.value"), lambda v: v.isNotNull()), F.lit(None).cast("string"))
    counts = entry.select(F.col("e.key").alias("key"), F.explode(marks).alias("value")).groupBy("key", "value").agg(F.count("*").alias("n"))
    own = F.max(F.when(F.col("value").isNull(), F.col("n"))).alias("points")
    sizes = counts.groupBy("key").agg(F.count("value").alias("distinct_values"), own)
    # The filter on the rank lets every task drop all but its first cap values of a key before the shuffle.
    order = Window.partitionBy("key").orderBy(F.col("value").isNull(), F.desc("n"), "value")
    first = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap)
    best = first.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("r", "value")))).alias("best"))
    values = F.transform("best", lambda b: b["value"])
    return sizes.join(best, "key").select("key", "points", "distinct_values", values.alias("values"), (F.col("distinct_values") > cap).alias("truncated"))


def with_meanings(listing: DataFrame, meanings: Mapping[str, str], key: str = "key") -> DataFrame:
    """A listing of keys with the meanings that a project declares; null where it declares none."""
    rows = listing.sparkSession.createDataFrame(sorted(meanings.items()), f"{key} string, meaning string")
    return listing.join(F.broadcast(rows), key, "left")


def facets_report(declared: DataFrame, stored: DataFrame, collapse: int = COLLAPSE) -> DataFrame:
    """declared(space, key, value) against stored(space, key, value, points): (space, key, value, points, source, distinct_values).

    points is null where the space has no such key and 0 where the key lacks the value. A key of more than collapse values is
    one row: value null, their number and sum.
    """
    d = declared.distinct().withColumn("d", F.lit(True))
    s = stored.withColumn("s", F.lit(True))
    keys = stored.select("space", "key").distinct().withColumn("has_key", F.lit(True))
    both = d.join(s, ["space", "key", "value"], "full").join(keys, ["space", "key"], "left")
    points = F.when(F.col("has_key"), F.coalesce("points", F.lit(0)))
    source = F.when(F.col("d") & F.col("s"), "both").when(F.col("d"), "declared").otherwise("stored")
    rows = both.select("space", "key", "value", points.cast("long").alias("points"), source.alias("source"))
    sizes = rows.groupBy("space", "key").agg(F.count("*").alias("distinct_values"), F.sum("points").alias("total"))
    wide = sizes.where(F.col("distinct_values") > collapse)
    one = wide.select("space", "key", F.lit(None).cast("string").alias("value"), F.col("total").alias("points"), F.lit(None).cast("string").alias("source"), "distinct_values")
    many = rows.join(sizes, ["space", "key"]).where(F.col("distinct_values") <= collapse)
    return many.select(*one.columns).unionByName(one)
