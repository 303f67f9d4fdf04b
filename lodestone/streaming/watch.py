"""Watching a folder: a stream of changed files drives incremental runs, each batch once, deletions by comparing listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import hard_excluded
from lodestone.operators.files import claimed_by, last_write
from lodestone.sources.files import FileTree
from lodestone.sources.tables import Table


def changes(spark: SparkSession, root: str, skip: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """A stream of the files that are new or edited since the last batch; with groups, of those that one of them claims."""
    spark.dataSource.register(FileTree)
    reader = spark.readStream.format("file_tree").option("path", root)
    files = (reader.option("skip", skip) if skip else reader).load()
    files = files.where(~hard_excluded(F.col("path")))
    return files if groups is None else files.join(groups.where("enabled"), claimed_by(F.col("path")), "left_semi")


def watch(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Start the stream: once over what is there, or again and again with every as the debounce."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: on_batch(df.dropDuplicates(["path"]), n))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upsert_batches(table: Table, key: str = "point_id") -> Callable[[DataFrame, int], None]:
    """A batch function that replaces rows of table by key. A batch that comes again changes nothing.

    Of a table dealt by its key, only the parts that the batch touches are read and written.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("version", F.lit(number).cast("long"))
        parts = table.touched(batch) if table.by else None
        stored = table.read(parts)
        both = rows if stored is None else stored.unionByName(rows)
        table.replace(last_write(both, key), parts)

    return apply
