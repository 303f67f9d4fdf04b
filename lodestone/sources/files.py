"""A Spark data source of files: listings with or without texts, and a stream of what changed since the last offset.

    spark.dataSource.register(FileTree)
    spark.read.format("file_tree").option("path", root).load()

Hidden files are listed (Spark's own file sources skip them); excluded folders are never entered. The folder must be mounted
on driver and executors alike.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions.text import HARD_EXCLUDED

SCHEMA = "path string, size long, mtime_ns long, text string, error string"
FILES_PER_TASK = 500
#: Seconds for which a change must be past before a stream shows it: longer than a file system's clock stands still.
SETTLE = 0.05


def listing(root: str, excluded: tuple[str, ...] = HARD_EXCLUDED, skip: str | None = None) -> list[tuple[str, int, int]]:
    """(relative path, size, mtime_ns) of the regular files under root, sorted; not those under the folder skip."""
    out = []
    skip = os.path.realpath(skip) if skip else None
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if d not in excluded and (not skip or os.path.realpath(os.path.join(folder, d)) != skip))
        for name in names:
            full = os.path.join(folder, name)
            try:
                info = os.stat(full)
            except OSError:
                continue
            if os.path.isfile(full):
                out.append((os.path.relpath(full, root).replace(os.sep, "/"), info.st_size, info.st_mtime_ns))
    return sorted(out)


def read_text(root: str, rel: str, size: int, cap: int | None) -> tuple[str | None, str | None]:
    """(text, error) of one file; files over cap aren't read."""
    if cap is not None and size > cap:
        return None, "too large"
    try:
        with open(os.path.join(root, rel), encoding="utf-8", newline="") as f:
            return f.read(), None
    except UnicodeDecodeError:
        return None, "not utf-8"
    except OSError as e:
        return None, str(e)


def with_texts(files: DataFrame, root: str) -> DataFrame:
    """files(path, ...) with text and error, read where the rows are, whatever their sizes."""
    schema = StructType([*files.schema.fields, *(StructField(c, StringType()) for c in ("text", "error"))])
    at = files.columns.index("path")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            # A few files at a time, so that a batch never holds many texts.
            for i in range(0, part.num_rows, 16):
                some = part.slice(i, 16)
                found = [read_text(root, rel, 0, None) for rel in some.column(at).to_pylist()]
                both = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*some.columns, *both], schema.names)

    return files.mapInArrow(read, schema)


class Some(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Options:
    def __init__(self, options: dict):
        self.root = options["path"]
        self.cap = int(options.get("maxBytes", 8_000_000))
        self.skip = options.get("skip")
        self.texts = options.get("texts", "true") != "false"

    def rows(self, files) -> Iterator[tuple]:
        for rel, size, mtime in files:
            yield (rel, size, mtime, *(read_text(self.root, rel, size, self.cap) if self.texts else (None, None)))


def _dealt(files: list[tuple[str, int, int]]) -> list[InputPartition]:
    return [Some(files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [Some([])]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self) -> list[InputPartition]:
        return _dealt(listing(self.options.root, skip=self.options.skip))

    def read(self, partition: Some) -> Iterator[tuple]:
        return self.options.rows(partition.files)


class TreeStream(DataSourceStreamReader):
    """Files whose status changed after the offset, a moment. Deletions show in listings, not here.

    Status times are the file system's own: a copy or checkout that keeps an old modification time has a new one. Changes
    of the last SETTLE seconds wait for the next batch, so that none of the same tick is split. Texts are read by the tasks.
    """

    def __init__(self, options: dict):
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {"changed_ns": 0}

    def latestOffset(self) -> dict:
        horizon = time.time_ns()
        time.sleep(SETTLE)
        times = [t for t in self._times().values() if t <= horizon]
        return {"changed_ns": max(times, default=0)}

    def _times(self) -> dict[str, int]:
        out = {}
        for rel, *_ in listing(self.options.root, skip=self.options.skip):
            try:
                out[rel] = os.stat(os.path.join(self.options.root, rel)).st_ctime_ns
            except OSError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = listing(self.options.root, skip=self.options.skip)
        times = self._times()
        return _dealt([f for f in files if start["changed_ns"] < times.get(f[0], 0) <= end["changed_ns"]])

    def read(self, partition: Some) -> Iterator[tuple]:
        return self.options.rows(partition.files)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)
