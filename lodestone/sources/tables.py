"""Tables as versioned Parquet folders behind a pointer: readers see the old rows or the new, never both.

A table may be dealt into parts by a hash of key columns; a change then writes the parts that it touches, and the pointer names
each part's folder. Paths go through Spark's own file system layer, so a table lies in any store that Spark reads.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs locally, a temporary one for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class TableError(RuntimeError):
    """A table whose pointer can't be read; never taken for a first run."""


class Table:
    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = (), parts: int = PARTS):
        self.spark, self.path, self.by, self.parts = spark, path.rstrip("/"), by, parts if by else 1

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _current(self) -> dict | None:
        """The pointer: schema, folder by part, folders of the version before. None if the table was never written."""
        fs, path = self._fs()
        pointer = path(f"{self.path}/CURRENT")
        if not fs.exists(pointer):
            return None
        stream = fs.open(pointer)
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
            if not all(fs.exists(path(f"{self.path}/{f}")) for f in found["parts"].values()):
                raise ValueError
        except (ValueError, KeyError, TypeError, AttributeError):
            raise TableError(f"{self.path}: its pointer names no version") from None
        finally:
            stream.close()
        return found

    def part(self) -> Column:
        """Number of the part that a row with the key columns belongs to."""
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int") if self.by else F.lit(0)

    def touched(self, keys: DataFrame) -> set[int]:
        """Parts that rows with these keys are in; there are `parts` of them at most."""
        return {r.p for r in keys.select(self.part().alias("p")).distinct().collect()}

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """The rows (of some parts only); None if the table was never written. A table without rows keeps its schema."""
        now = self._current()
        if now is None:
            return None
        schema = StructType.fromJson(now["schema"])
        folders = [f"{self.path}/{f}" for p, f in sorted(now["parts"].items()) if only is None or int(p) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def replace(self, df: DataFrame, only: set[int] | None = None) -> None:
        """Write df beside the current version, then turn the pointer; with only, df has the rows of these parts and the others stay.

        Folders of the version before stay for readers that have it open; older ones go.
        """
        fs, path = self._fs()
        now, name = self._current() or {"parts": {}}, f"v-{uuid.uuid4().hex}"
        if self.by:
            df.withColumn("part", self.part()).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{name}")
            written = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{name}")) if s.isDirectory()]
            parts = {f.removeprefix("part="): f"{name}/{f}" for f in written if f.startswith("part=")}
        else:
            df.write.parquet(f"{self.path}/{name}")
            parts = {"0": name}
        if only is not None:
            parts |= {p: f for p, f in now["parts"].items() if int(p) not in only}
        self._point({"schema": df.schema.jsonValue(), "parts": parts, "before": sorted(now["parts"].values())})
        kept = {f.split("/")[0] for f in [*parts.values(), *now["parts"].values()]} | {name}
        for status in fs.listStatus(path(self.path)):
            own = status.getPath().getName()
            if own.startswith("v-") and own not in kept:
                fs.delete(status.getPath(), True)

    def _point(self, to: dict) -> None:
        fs, path = self._fs()
        context = self.spark.sparkContext
        fresh = path(f"{self.path}/.CURRENT-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(to).encode()))
        out.close()
        pointer = path(f"{self.path}/CURRENT")
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), context._jsc.hadoopConfiguration())
        kind = getattr(context._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = context._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        files.rename(fresh, pointer, options)

    def drop(self) -> bool:
        fs, path = self._fs()
        return fs.delete(path(self.path), True)
