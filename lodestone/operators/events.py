"""Event logs, rate windows, schedules and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import duration_seconds


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a time zone, whatever the session's."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def append_log(events: DataFrame, path: str, run_id: str) -> None:
    """Append a run's events(timestamp, level, message, meta) to the log table, one folder per run; a repeated run replaces its own."""
    rows = events.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def stage_counts(events: DataFrame, by: str, kinds: list[str], kind: str) -> DataFrame:
    """Per by: events in all and one count per kind; one pass."""
    return events.groupBy(by).agg(F.count("*").alias("events"), *(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds))


def _spread(events: DataFrame, ts: str, seconds: int, span: int) -> DataFrame:
    """events with _at (microseconds), _slot and _own: each in its slot of span seconds, and again, as context, in the next one if within seconds of it."""
    slot = F.floor(F.col("_at") / (span * 1_000_000)).cast("long")
    near = F.col("_at") >= (F.col("_first") + 1) * (span * 1_000_000) - seconds * 1_000_000
    rows = events.withColumn("_at", micros(ts)).withColumn("_first", slot)
    rows = rows.withColumn("_slot", F.explode(F.when(near, F.array(F.col("_first"), F.col("_first") + 1)).otherwise(F.array("_first"))))
    return rows.withColumn("_own", F.col("_slot") == F.col("_first")).drop("_first")


def rate_window(events: DataFrame, key: str, ts: str, weight: str, seconds: int = 60, span: int | None = None) -> DataFrame:
    """Requests and weight in the seconds up to each event, its own moment included.

    A key's events are dealt out by slots of span seconds, with what reaches over a slot's start, so one busy key fills many tasks.
    """
    rows = _spread(events, ts, seconds, span or 60 * seconds)
    w = Window.partitionBy(key, "_slot").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    found = rows.withColumn("requests", F.count("*").over(w)).withColumn("weight", F.sum(weight).over(w))
    return found.where("_own").drop("_at", "_slot", "_own")


def cooldown(events: DataFrame, key: str, ts: str, throttled: str, seconds: int = 60, span: int | None = None) -> DataFrame:
    """events with waiting: a throttled answer in the seconds before. Dealt out as in rate_window."""
    rows = _spread(events, ts, seconds, span or 60 * seconds)
    w = Window.partitionBy(key, "_slot").orderBy("_at").rangeBetween(-seconds * 1_000_000, -1)
    found = rows.withColumn("waiting", F.coalesce(F.max(F.col(throttled)).over(w), F.lit(False)))
    return found.where("_own").drop("_at", "_slot", "_own")


def merged_stats(runs: DataFrame, counters: list[str], by: list[str] | None = None, stopped: str = "stopped", errors: str = "errors") -> DataFrame:
    """Per by (or in all): counters added, stopped if any run was, the number of errors. run_errors lists the errors."""
    sums = (F.sum(c).cast("long").alias(c) for c in counters)
    n = F.sum(F.coalesce(F.size(errors), F.lit(0))).cast("long").alias("n_errors")
    return runs.groupBy(*(by or [])).agg(*sums, F.bool_or(stopped).alias(stopped), n)


def run_errors(runs: DataFrame, keep: list[str], errors: str = "errors") -> DataFrame:
    """(keep, error): all errors of all runs, one a row."""
    return runs.select(*keep, F.explode(errors).alias("error"))


def rate_snapshot(windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of rate_window's rows, per by (or in all): requests, their greatest number and weight within a window."""
    return windows.groupBy(*(by or [])).agg(F.count("*").alias("total_requests"), F.max("requests").alias("max_requests"), F.max("weight").alias("max_weight"))


def effective_every(projects: DataFrame, override: str, own: str, default: str) -> DataFrame:
    """projects with every, the first of the three settings that is there, and every_seconds (null if off)."""
    every = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (override, own, default)))
    return projects.withColumn("every", every).withColumn("every_seconds", F.when(F.lower("every") != "off", duration_seconds(F.col("every"))))


def due(projects: DataFrame, state: DataFrame, now: str, key: str = "name") -> DataFrame:
    """Projects whose next run is due at now, longest waiting first; those that never ran come first."""
    rows = projects.join(state.select(key, "last_finish"), key, "left").where("every_seconds IS NOT NULL")
    at = micros("last_finish") / 1e6 + F.col("every_seconds")
    waiting = F.coalesce(at, F.lit(0.0))
    return rows.withColumn("due_at", waiting).where(F.col("due_at") <= micros(f"TIMESTAMP_NTZ'{now}'") / 1e6).orderBy("due_at", key)


def space_overview(points: DataFrame, ledger: DataFrame) -> DataFrame:
    """(space, points, files, bytes, indexed_at) of every space in either table."""
    p = points.groupBy("space").agg(F.count("*").alias("points"))
    m = ledger.groupBy("space").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("indexed_at").alias("indexed_at"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return p.join(m, "space", "full").select("space", zero("points"), zero("files"), zero("bytes"), "indexed_at")


def group_timings(listing: DataFrame) -> DataFrame:
    """(group, files, bytes, glob_ms) slowest first."""
    return listing.groupBy("name", "priority").agg(F.count("path").alias("files"), F.sum("size").alias("bytes"), F.max("glob_ms").alias("glob_ms")).orderBy(F.desc("glob_ms"), F.desc("priority"), "name")
