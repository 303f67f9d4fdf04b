"""The corpus: each file's prepared document and its metadata sidecar, written only where they changed, pruned by key."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.facets import with_facet
from lodestone.sources.files import FileTree

#: Fixed ending of a document's sidecar.
SIDECAR = ".metadata.json"


def sidecar_json(facets: Column, group: Column) -> Column:
    """Metadata as JSON with sorted keys and an indent of two, byte for byte as json.dumps writes it (ASCII values)."""
    full = F.when(group.isNull() | (group == ""), facets).otherwise(with_facet(facets, "group", F.array(group)))
    entries = F.sort_array(F.transform(F.map_entries(full), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    quoted = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    values = lambda v: F.concat(F.lit("[\n      "), F.array_join(F.transform(v, lambda x: quoted(x)), ",\n      "), F.lit("\n    ]"))
    lines = F.transform(entries, lambda e: F.concat(F.lit("    "), quoted(e["k"]), F.lit(": "), values(e["v"])))
    body = F.when(F.size(entries) == 0, F.lit("{}")).otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n  }")))
    return F.concat(F.lit('{\n  "metadataAttributes": '), body, F.lit("\n}\n"))


def documents(files: DataFrame, system: str = "default") -> DataFrame:
    """(corpus_key, path, body, sidecar, content_sha256, sidecar_sha256) of files(path, language, facets, grp, text)."""
    path, lang = F.col("path"), F.col("language")
    rows = files.select(
        tx.corpus_key(path, lang, F.col("facets"), system).alias("corpus_key"),
        "path",
        tx.prepared_body(path, lang, F.col("text")).alias("body"),
        sidecar_json(F.col("facets"), F.col("grp")).alias("sidecar"),
    )
    return rows.withColumn("content_sha256", F.sha2("body", 256)).withColumn("sidecar_sha256", F.sha2("sidecar", 256))


def to_write(made: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents that are new or differ from stored(corpus_key, content_sha256, sidecar_sha256)."""
    keys = ["corpus_key", "content_sha256", "sidecar_sha256"]
    return made.join(stored.select(*keys), keys, "left_anti")


def to_prune(stored: DataFrame, keep: DataFrame) -> DataFrame:
    """Keys of stored documents that no space keeps."""
    return stored.select("corpus_key").join(keep.select("corpus_key").distinct(), "corpus_key", "left_anti")


def merged(stored: DataFrame, made: DataFrame, keep: DataFrame) -> DataFrame:
    """The corpus after a run: made in place of older versions, pruned to keep."""
    old = stored.join(made.select("corpus_key"), "corpus_key", "left_anti").unionByName(made)
    return old.join(keep.select("corpus_key").distinct(), "corpus_key", "left_semi")


def stale_specs(specs: DataFrame, cache: DataFrame) -> DataFrame:
    """Specs(path, sha256) whose rendering in cache(path, sha256) is missing or of another version."""
    return specs.join(cache.select("path", "sha256"), ["path", "sha256"], "left_anti")


def _put(path: str, text: str) -> bool:
    """Whether the file had to be written: it is left alone if it has the text. Readers see the old or the new one, whole."""
    body = text.encode("utf-8", "surrogatepass")
    try:
        with open(path, "rb") as f:
            if f.read() == body:
                return False
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}.part"
    with open(beside, "wb") as f:
        f.write(body)
    os.replace(beside, path)
    return True


def export(made: DataFrame, root: str) -> DataFrame:
    """(corpus_key, wrote_document, wrote_sidecar): documents(corpus_key, body, sidecar) as files under root, a folder that all executors mount.

    Files are written by the tasks, each as a whole and only where they differ, so a task that runs again changes nothing.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, bodies, sidecars = (part.column(i) for i in range(3))
            wrote = [[], []]
            for key, body, sidecar in zip(keys, bodies, sidecars, strict=True):
                path = os.path.join(root, key.as_py())
                wrote[0].append(_put(path, body.as_py()))
                wrote[1].append(_put(path + SIDECAR, sidecar.as_py()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(w, pa.bool_()) for w in wrote)], ["corpus_key", "wrote_document", "wrote_sidecar"])

    return made.select("corpus_key", "body", "sidecar").mapInArrow(write, "corpus_key string, wrote_document boolean, wrote_sidecar boolean")


def prune_files(keep: DataFrame, root: str) -> DataFrame:
    """(path) of the files under root that belong to no key of keep(corpus_key); the tasks delete them, and folders left empty."""
    spark = keep.sparkSession
    spark.dataSource.register(FileTree)
    files = spark.read.format("file_tree").option("path", root).option("texts", "false").load().select("path")
    key = F.when(F.col("path").endswith(SIDECAR), F.expr(f"left(path, length(path) - {len(SIDECAR)})")).otherwise(F.col("path"))
    gone = files.withColumn("corpus_key", key).join(keep.select("corpus_key").distinct(), "corpus_key", "left_anti").select("path")

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rel in part.column(0).to_pylist():
                try:
                    os.unlink(os.path.join(root, rel))
                except FileNotFoundError:
                    pass
                folder = os.path.dirname(rel)
                while folder:
                    try:
                        os.rmdir(os.path.join(root, folder))
                    except OSError:
                        break
                    folder = os.path.dirname(folder)
            yield part

    return gone.mapInArrow(remove, "path string")
