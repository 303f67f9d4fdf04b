"""Indexing a project: a listing to claims to an incremental plan, and the files that changed to chunks with ids, facets and vectors."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import facets as fc
from lodestone.functions import text as tx
from lodestone.functions.vectors import hash_embeddings
from lodestone.operators.chunk import CONTEXT_CHARS, chunk_files
from lodestone.operators.files import claim, incremental
from lodestone.sources.config import Project, groups_table
from lodestone.sources.files import FileTree, with_texts
from lodestone.sources.tables import Table

Embed = Callable[[DataFrame], DataFrame]
POINT = ["point_id", "space", "path", "language", "kind", "symbol", "heading_path", "start_line", "end_line", "start_byte", "end_byte", "text", "facets", "grp", "priority", "dense"]


def _labelled(files: DataFrame, spark: SparkSession, project: Project) -> DataFrame:
    won = claim(files, groups_table(spark, project))
    language = F.when(F.col("kind") == "openapi", "openapi").otherwise(tx.language(F.col("path")))
    won = won.withColumn("language", language).where("language IS NOT NULL").withColumnRenamed("group_facets", "facets")
    models = F.create_map(*(F.lit(x) for n, s in project.spaces.items() for x in (n, f"{s.dense.model}/{s.sparse.model}/{s.chunk.max_chars}/{s.dimensions or 0}")))
    return won.withColumn("model", F.element_at(models, F.col("space"))).drop("kind")


def claimed_files(spark: SparkSession, root: str, project: Project, skip: str | None = None) -> DataFrame:
    """(space, name, priority, path, size, mtime_ns, language, facets, model) of the files that groups claim; no file is read."""
    spark.dataSource.register(FileTree)
    reader = spark.read.format("file_tree").option("path", root).option("texts", "false")
    return _labelled((reader.option("skip", skip) if skip else reader).load().drop("text", "error"), spark, project)


def claimed_file(spark: SparkSession, root: str, project: Project, rel: str) -> DataFrame:
    """One path's rows of claimed_files, without listing the others; none if it is no file or no group claims it."""
    full = os.path.join(root, rel)
    found = [(rel, os.path.getsize(full), os.stat(full).st_mtime_ns)] if os.path.isfile(full) else []
    return _labelled(spark.createDataFrame(found, "path string, size long, mtime_ns long"), spark, project)


def read_claimed(files: DataFrame, root: str) -> DataFrame:
    """files with text, error and sha256, the hash of what would be indexed."""
    read = with_texts(files, root)
    body = tx.prepared_body(F.col("path"), F.col("language"), F.col("text"))
    return read.withColumn("sha256", F.when(F.col("error").isNull(), F.sha2(F.concat_ws("\0", body, fc.facets_line(F.col("facets"))), 256)))


def chunks_of_path(spark: SparkSession, root: str, project: Project, rel: str) -> DataFrame:
    """Chunk rows of one file in every space that claims it."""
    files = read_claimed(claimed_file(spark, root, project, rel), root).where("error IS NULL")
    return reduce(DataFrame.unionByName, (points_of(files.where(F.col("space") == n), s.chunk.max_chars, s.chunk.min_chars) for n, s in project.spaces.items())).orderBy("space", "start_byte", "end_byte")


def points_of(files: DataFrame, max_chars: int, min_chars: int, embed: Embed | None = None, budget: int = CONTEXT_CHARS, dimensions: int | None = None) -> DataFrame:
    """Points of claimed files; with dimensions, a vector of another length is an error. The id is that of path, bytes and ordinal, so that parts of one span stay apart."""
    made = chunk_files(files.select("space", "path", "language", "facets", F.col("name").alias("grp"), "priority", "text"), max_chars, min_chars, budget).where("error IS NULL")
    own = fc.with_facet(fc.merged(F.col("facets"), F.col("chunk_facets")), "group", F.array("grp"))
    key = F.concat_ws(":", F.col("space"), F.col("path"), F.col("start_byte").cast("string"), F.col("end_byte").cast("string"), F.col("ordinal").cast("string"))
    rows = made.withColumn("facets", own).withColumn("point_id", tx.point_id(key))
    header = tx.embed_text(F.col("path"), F.col("symbol"), F.col("kind"), F.col("heading_path"), F.col("facets"), F.col("text"))
    inputs = rows.select("point_id", header.alias("embed_text"))
    vectors = embed(inputs) if embed else hash_embeddings(inputs, ["point_id"], "embed_text")
    if dimensions:
        wrong = F.raise_error(F.concat(F.lit(f"the model gives vectors of other than {dimensions} numbers: "), F.size("dense").cast("string")))
        vectors = vectors.withColumn("dense", F.when(F.size("dense") != dimensions, wrong.cast("array<float>")).otherwise(F.col("dense")))
    return rows.join(vectors, "point_id", "left").select(*POINT)


@dataclass
class Report:
    """What a run did: files by outcome, the first files that couldn't be read (path, error), and whether all were done anew."""

    counts: dict[str, int]
    rebuilt: bool
    errors: list[tuple[str, str]]


ERRORS_SHOWN = 1000
LEDGER = "space string, path string, size long, mtime_ns long, sha256 string, model string, indexed_at timestamp"


class Index:
    """Stored points and ledger of one project under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.points, self.ledger = Table(spark, f"{folder}/points", ("space", "path")), Table(spark, f"{folder}/ledger", ("space", "path"))

    def plan(self, root: str, project: Project, *, wanted: DataFrame | None = None, force: bool = False, skip: str | None = None) -> DataFrame:
        """(space, path, model, size, mtime_ns, sha256, error, outcome): what a run does with every claimed or stored file.

        Sizes and times decide first; only files that differ in them are read, for their hash. Outcomes: skip_large, skip_stat, skip_hash,
        changed, new, deleted, error. A file that is too large or can't be read keeps what is stored of it.
        """
        files = claimed_files(self.spark, root, project, skip)
        before = self.ledger.read()
        old = self.spark.createDataFrame([], LEDGER) if before is None else before
        if wanted is not None and not force:
            files, old = (df.join(wanted.select("path").distinct(), "path", "left_semi") for df in (files, old))
        key = F.concat_ws("\0", "space", "path", "model")
        stat = lambda df, *more: df.select(key.alias("path"), "size", "mtime_ns", *more)
        # Without hashes a file of another size or time is changed at this point.
        first = incremental(stat(files, "language", F.lit("").alias("sha256")), stat(old, F.lit("?").alias("sha256")), None, force)
        parts = F.split("path", "\0")
        first = first.select(parts[0].alias("space"), parts[1].alias("path"), parts[2].alias("model"), F.col("outcome").alias("_first"))
        rows = first.join(files, ["space", "path", "model"], "left")
        known = old.select("space", "path", "model", F.col("sha256").alias("_sha"))
        read = read_claimed(rows.where("_first IN ('new', 'changed')"), root).join(known, ["space", "path", "model"], "left")
        same = F.col("sha256").eqNullSafe(F.col("_sha")) & F.lit(not force)
        outcome = F.when(F.col("error").isNotNull(), "error").when(same, "skip_hash").otherwise(F.col("_first"))
        columns = ["space", "path", "model", "size", "mtime_ns", "sha256", "error", "outcome"]
        none = F.lit(None).cast("string")
        rest = rows.where("_first NOT IN ('new', 'changed')").withColumns({"sha256": none, "error": none}).withColumn("outcome", F.col("_first"))
        return read.withColumn("outcome", outcome).select(*columns).unionByName(rest.select(*columns))

    def run(self, root: str, project: Project, *, wanted: DataFrame | None = None, force: bool = False, embed: Embed | None = None, skip: str | None = None) -> Report:
        """Bring the index up to date. Only new and changed files are chunked and embedded; deleted ones lose their points.

        Files that can't be read are reported and keep their points. Only the parts of the tables that hold touched files are written.
        """
        rebuild = force or self.ledger.read() is None
        plan = self.plan(root, project, wanted=wanted, force=force, skip=skip).cache()
        counts = {r.outcome: r["count"] for r in plan.groupBy("outcome").count().collect()}
        errors = [(r.path, r.error) for r in plan.where("outcome = 'error'").select("path", "error").distinct().orderBy("path").limit(ERRORS_SHOWN).collect()]
        touched = plan.where("outcome IN ('new', 'changed', 'deleted')").select("space", "path").distinct()
        if counts.keys() & {"new", "changed", "deleted"}:
            todo = claimed_files(self.spark, root, project, skip).join(plan.where("outcome IN ('new', 'changed')").select("space", "path", "model"), ["space", "path", "model"], "left_semi")
            texts = with_texts(todo, root).where("error IS NULL").drop("error")
            fresh = reduce(DataFrame.unionByName, (points_of(texts.where(F.col("space") == n), s.chunk.max_chars, s.chunk.min_chars, embed, dimensions=s.dimensions) for n, s in project.spaces.items()))
            self._rewrite(self.points, fresh.select(*POINT), touched)
        seen = plan.where("outcome IN ('new', 'changed', 'skip_hash')")
        if counts.keys() & {"new", "changed", "deleted", "skip_hash"} or rebuild:
            rows = seen.select("space", "path", "size", "mtime_ns", "sha256", "model", F.current_timestamp().alias("indexed_at"))
            self._rewrite(self.ledger, rows, touched.unionByName(seen.select("space", "path")).distinct())
        plan.unpersist()
        return Report(counts, rebuild, errors)

    def _rewrite(self, table: Table, fresh: DataFrame, gone: DataFrame) -> None:
        """table with the rows of the paths in gone replaced by fresh, by the parts that hold these paths."""
        parts = table.touched(gone)
        stored = table.read(parts)
        rows = fresh if stored is None else stored.join(gone, ["space", "path"], "left_anti").select(*fresh.columns).unionByName(fresh)
        table.replace(rows, parts)

    def reset(self) -> dict[str, int]:
        """Drop everything stored; returns the rows that went, by table."""
        gone = {}
        for name, table in (("points", self.points), ("ledger", self.ledger)):
            rows = table.read()
            gone[name] = 0 if rows is None else rows.count()
            table.drop()
        return gone
