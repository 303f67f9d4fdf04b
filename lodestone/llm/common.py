"""Helpers shared by the training-data operators: stage tables, row keys, per-text Arrow maps and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the contracts count it; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ROW = "_ls_row"
TEXTS_PER_CHUNK = 512
#: Bytes of text in a slice of an Arrow batch, unless one text is longer.
SLICE_BYTES = 8 << 20
#: Rows of narrow keys, at most, that are broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs locally, a temporary one for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Folders of stage tables, one list per open scratch().
_OPEN: list[list[str]] = []


def cut(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: ends the lineage, survives lost executors.

    With by, the table is divided into folders by these columns, so that a filter on them reads only its part.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone/{uuid.uuid4().hex}"
    for made in _OPEN[-1:]:
        made.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ls_folder = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing that is still to run reads them."""
    for table in tables:
        delete(table.sparkSession, table._ls_folder)


@contextmanager
def scratch(spark: SparkSession):
    """What cut() writes inside is deleted at the end; results must have been written elsewhere by then."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            delete(spark, path)


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs is columns and rows of one file scan, each row once."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns


def with_rows(docs: DataFrame) -> DataFrame:
    """docs and ROW, a key that is the same whenever docs is read: null or repeated document ids can't confuse rows.

    Rows of a file scan are known by file and place in it (128-bit hash of the path, then the row's number), without a copy of the table.
    Rows of any other plan get a number in a table that is written once.
    """
    if _is_scan(docs):
        place = F.unhex(F.lpad(F.hex(F.col("_metadata.row_index")), 16, "0"))
        try:
            return docs.withColumn(ROW, F.concat(F.unhex(F.md5(F.col("_metadata.file_path"))), place))
        except AnalysisException:
            # Formats without row numbers.
            pass
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()))


def small(table: DataFrame) -> DataFrame:
    """A written table as a join side: broadcast if it has at most BROADCAST_ROWS rows, else left to a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows (with ROW) but those whose key is in the narrow table dropped; the key goes too."""
    return rows.join(small(cut(dropped.select(ROW))), ROW, "left_anti").drop(ROW)


def text_slices(part: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about size bytes in all (at least one row each)."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(part.column(column)).cast(pa.int64()), 0)).to_numpy()
    at = 0
    while at < part.num_rows:
        limit = (int(ends[at - 1]) if at else 0) + size
        upto = max(at + 1, int(ends.searchsorted(limit, side="right")))
        yield part.slice(at, upto - at)
        at = upto


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    work: Callable[[list[str]], Sequence[Sequence]],
) -> DataFrame:
    """Columns keep and, for each row, what work makes of its text (null counts as empty): one sequence per field.

    Arrow batches are taken in slices of TEXTS_PER_CHUNK texts so that only a slice is held as Python objects.
    """
    df = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_ls_text"))
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    names = [f.name for f in schema.fields]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for part in parts:
            for at in range(0, part.num_rows, TEXTS_PER_CHUNK):
                piece = part.slice(at, TEXTS_PER_CHUNK)
                made = work(piece.column(len(keep)).to_pylist())
                own = [pa.array(list(x), k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(keep))), *own], names)

    return df.mapInArrow(batches, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node.

    Alternating large and small stars: minima are combined before each shuffle, and every round's edges go to the shared
    folder (the round before is deleted then), so a lost executor costs a round at most. A hub's edges meet one row of minima:
    adaptive execution splits such a key's partition, or broadcasts the minima where they are few.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    sizes = _state(now)
    while sizes[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small_star = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b")))
        after = cut(small_star.where("a != b").distinct())
        free(now, large)
        now = after
        before, sizes = sizes, _state(now)
        if before == sizes:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and sums of hashes: equal from one round to the next only if the edges are."""
    h = F.xxhash64("a", "b")
    row = edges.agg(
        F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32)), F.bit_xor(h)
    ).first()
    return tuple(row)
