"""Interval runs: projects that are due, longest waiting first, each outcome recorded."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "name string, running boolean, last_start timestamp_ntz, last_finish timestamp_ntz, result string, error string"


class BusyIndex(RuntimeError):
    """Another run holds the index."""


def run_due(projects: list[tuple[str, float | None]], state: dict[str, dict], run: Callable[[str], str | None], now: datetime | None = None) -> list[str]:
    """Run each due project of (name, every_seconds) once; state is updated in place. Returns the names run, in order.

    A run's result is ok, or stopped if it returns that; busy if the index is held; error with the message otherwise.
    """
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    waiting = []
    for name, every in projects:
        last = state.get(name, {}).get("last_finish")
        if every is not None and (last is None or last + timedelta(seconds=every) <= now):
            waiting.append((last + timedelta(seconds=every) if last else datetime.min, name))
    done = []
    for _, name in sorted(waiting):
        row = state.setdefault(name, {}) | {"running": True, "last_start": now}
        try:
            result, error = run(name) or "ok", None
        except BusyIndex as e:
            result, error = "busy", str(e)
        except Exception as e:  # noqa: BLE001  one project's failure must not stop the others
            result, error = "error", str(e)
        finish = row.get("last_finish") if result == "busy" else now
        state[name] = row | {"running": False, "last_finish": finish, "result": result, "error": error}
        done.append(name)
    return done


def state_frame(spark: SparkSession, state: dict[str, dict]) -> DataFrame:
    keys = ("running", "last_start", "last_finish", "result", "error")
    return spark.createDataFrame([(n, *(s.get(k) for k in keys)) for n, s in sorted(state.items())], STATE)


def failures(state: DataFrame) -> DataFrame:
    return state.where(F.col("result").isin("error", "busy")).select("name", "result", "error")
