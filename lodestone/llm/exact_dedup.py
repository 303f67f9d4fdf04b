"""Exact duplicates: group by a 128-bit content hash, keep the smallest stable id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ROW, SPACE, cut, with_rows, without


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts. Of repeated rows with equal id and text one stays. A null id ranks after
    all others, so keep_id is null only where no row of the group has an id. An empty table gives no rows.
    """
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    return _grouped(rows, id_col, text_col, {"text_sha256": F.unhex(F.sha2("t", 256))}).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str, more: dict[str, Column]) -> DataFrame:
    """id, row, keep_id, group_size, kept and more (columns over the normalised text t) of docs with ROW.

    The hash alone is shuffled with ids; texts are shuffled once, already combined within each task, to
    count the different texts behind a hash. Only where a hash has several (a collision) are
    its rows grouped by their bytes as well. Only groups of several rows are joined back; a large group is a hot key
    of the rows' side alone, which adaptive execution splits where the groups aren't few enough to be broadcast.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(ROW).alias("row"), normalised(text_col).alias("t"))
    narrow = cut(texts.select("id", "row", F.unhex(F.md5("t")).alias("h"), *(c.alias(k) for k, c in more.items())))
    by_bytes = texts.groupBy(F.unhex(F.md5("t")).alias("h"), "t").agg(F.lit(1).alias("one"))
    clashes = cut(by_bytes.groupBy("h").count().where("count > 1").select("h"))
    # The part tells texts apart within a hash: empty unless the hash has a collision.
    rows = narrow.withColumn("part", F.lit(b""))
    if not clashes.isEmpty():
        clear = rows.join(clashes, "h", "left_anti")
        again = texts.withColumn("h", F.unhex(F.md5("t"))).join(clashes, "h", "left_semi")
        again = again.select("id", "row", "h", *(c.alias(k) for k, c in more.items()), F.encode("t", "utf-8").alias("part"))
        rows = cut(clear.unionByName(again))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = rows.groupBy("h", "part").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    groups = cut(groups.select("h", "part", "n", F.col("first.id").alias("keep"), F.col("first.row").alias("keep_row")))
    alone = F.col("n").isNull()
    return rows.join(groups, ["h", "part"], "left").select(
        "id",
        "row",
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        *more,
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops; the columns stay."""
    rows = with_rows(docs)
    return without(rows, _grouped(rows, id_col, text_col, {}).where("not kept").select(F.col("row").alias(ROW)))
