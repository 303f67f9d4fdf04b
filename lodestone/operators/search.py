"""Dense and keyword search: exact cosine top-k, BM25 top-k, prefetch with rerank, always filtered before the cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.facets import matches
from lodestone.functions.vectors import dot_literal, norm, tokens

#: Fixed constants of the keyword score.
K1, B, AVERAGE = 1.2, 0.75, 256.0
PREFETCH, LIMIT = 80, 10


def filtered(points: DataFrame, facets: Mapping | None = None, exclude: Mapping | None = None, column: str = "facets") -> DataFrame:
    return points.where(matches(F.col(column), facets, exclude)) if facets or exclude else points


def top(df: DataFrame, limit: int, key: str, score: str = "score") -> DataFrame:
    """Best limit rows by score, ties by key. One TakeOrdered: each task passes on limit rows at most."""
    return df.orderBy(F.desc(score), key).limit(limit)


def dense_topk(points: DataFrame, query: Sequence[float], limit: int = LIMIT, key: str = "point_id", vector: str = "dense", facets: Mapping | None = None, exclude: Mapping | None = None, digits: int | None = None) -> DataFrame:
    """points with score, the cosine to query, best first. The query's numbers are literals, so scoring stays in the scan's stage."""
    length = sum(float(x) * float(x) for x in query) ** 0.5
    v = F.col(vector)
    size = norm(v) * F.lit(length)
    score = F.when((size > 0) & (F.size(v) == len(query)), dot_literal(v, query) / size)
    score = F.round(score, digits) if digits is not None else score
    return top(filtered(points, facets, exclude).withColumn("score", score).where("score IS NOT NULL"), limit, key)


def blocks(rows: DataFrame, key: str, vector: str, size: int, id_name: str, matrix: str) -> DataFrame:
    """Rows packed where they are into blocks of size: (id_name array, matrix array<double>, unit vectors). Those without length go."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, size):
                piece = part.slice(at, size)
                found: dict[int, tuple[list, list]] = {}
                for i, v in zip(piece.column(0).to_pylist(), piece.column(1), strict=True):
                    values = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64) if v.is_valid else np.zeros(0)
                    length = np.sqrt((values * values).sum())
                    if length > 0:
                        own = found.setdefault(len(values), ([], []))
                        own[0].append(i)
                        own[1].append(values / length)
                ids = [x[0] for x in found.values()]
                flat = [np.concatenate(x[1]).tolist() for x in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(ids, pa.list_(piece.schema.field(0).type)), pa.array(flat, pa.list_(pa.float64()))], ["dim", id_name, matrix])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(pack, f"dim int, {id_name} array<{kind}>, {matrix} array<double>")


def dense_topk_batch(points: DataFrame, queries: DataFrame, limit: int = LIMIT, key: str = "point_id", vector: str = "dense", query_key: str = "query_id", query_vector: str = "query_vector", digits: int = 6, query_block: int = 256, point_block: int = 4096) -> DataFrame:
    """(query, key, score, rank) of each query's best points. queries is a stated set, compared with all rows block by block.

    Spark pairs blocks, not rows, and needs no side to fit in memory; each pair is one matrix product and passes on limit
    rows per query.
    """
    q = blocks(queries, query_key, query_vector, query_block, "q_ids", "q")
    p = blocks(points, key, vector, point_block, "p_ids", "p")
    pairs = p.crossJoin(q.withColumnRenamed("dim", "q_dim")).where("dim = q_dim").select("dim", "q_ids", "q", "p_ids", "p")
    kinds = [points.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()]

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                dim, q_ids, q_flat, p_ids, p_flat = (part.column(c)[i] for c in range(5))
                left = q_flat.values.to_numpy().reshape(-1, dim.as_py())
                right = p_flat.values.to_numpy().reshape(-1, dim.as_py())
                found = np.round(left @ right.T, digits)
                names = p_ids.values
                order = np.argsort(np.asarray(names.to_pylist(), dtype=object), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                best = np.lexsort((np.broadcast_to(rank, found.shape), -found), axis=1)[:, :limit]
                row = np.repeat(np.arange(len(left)), best.shape[1])
                yield pa.RecordBatch.from_arrays([q_ids.values.take(pa.array(row)), names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(found, best, 1).ravel())], [query_key, key, "score"])

    best = pairs.mapInArrow(score, f"{query_key} {kinds[1]}, {key} {kinds[0]}, score double")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def postings(docs: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """(key, term, tf, doc_len) of each row of docs; one without terms gives none. Nothing is shuffled: a row's words are sorted and their runs counted where it is."""
    words = docs.select(*key, F.sort_array(tokens(F.col(text))).alias("w")).where(F.size("w") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: ~F.get("w", i).eqNullSafe(F.get("w", i - 1)))
    runs = words.select(*key, "w", first.alias("a"))
    after = F.concat(F.slice("a", F.lit(2), F.size("a")), F.array(F.size("w")))
    found = F.zip_with("a", after, lambda a, b: F.struct(F.get("w", a).alias("term"), (b - a).cast("long").alias("tf")))
    return runs.select(*key, F.size("w").alias("doc_len"), F.explode(found).alias("p")).select(*key, "doc_len", "p.term", "p.tf")


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) over docs. Counts are combined by task: what is shuffled is one row per task and term."""
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_weight() -> Column:
    tf, size = F.col("tf").cast("double"), F.col("doc_len").cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / AVERAGE))


def bm25_scores(docs: DataFrame, query: str, key: Sequence[str], total: DataFrame, text: str = "text", keep: Column | None = None) -> DataFrame:
    """(key, score) of documents with a query term, of those only where keep holds. total: one row, n.

    Only the query's terms are found, in the scan itself: no posting list is built or shuffled for other words. Frequencies
    count all documents; they need no lengths, so each text is cut into words once, and only if it has a term.
    """
    terms = sorted(set(_query_terms(query)))
    if not terms:
        return docs.select(*key, F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.col(text))
    whole = f"(?<![a-z0-9_])(?:{'|'.join(terms)})(?![a-z0-9_])"
    found = docs.where(F.rlike(low, F.lit(whole))).select(
        *key,
        (F.lit(True) if keep is None else keep).alias("_keep"),
        F.size(tokens(F.col(text))).alias("doc_len"),
        F.regexp_extract_all(low, F.lit(whole), F.lit(0)).alias("w"),
    )
    times = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    hits = F.filter(F.array(*(F.struct(F.lit(t).alias("term"), times(t).alias("tf")) for t in terms)), lambda h: h["tf"] > 0)
    own = found.select(*key, "_keep", "doc_len", F.explode(hits).alias("h")).select(*key, "_keep", "doc_len", "h.*")
    freq = own.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    weighted = own.where("_keep").join(F.broadcast(freq), "term").withColumn("s", term_weight() * idf(F.col("df"), F.col("n")))
    return weighted.groupBy(*key).agg(F.sum("s").alias("score"))


def _query_terms(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9_]+", query.lower())


def bm25_topk(points: DataFrame, query: str, limit: int = LIMIT, key: str = "point_id", text: str = "text", facets: Mapping | None = None, exclude: Mapping | None = None, digits: int = 6) -> DataFrame:
    """(key, score) best first. Document frequencies are those of all points; the filter applies before the cut."""
    total = points.agg(F.count("*").alias("n"))
    keep = matches(F.col("facets"), facets, exclude) if facets or exclude else None
    scored = bm25_scores(points, query, [key], total, text, keep)
    return top(scored.withColumn("score", F.round("score", digits)), limit, key)


def candidates_for(limit: int, prefetch: int = PREFETCH) -> int:
    return max(prefetch, 4 * limit)


def rerank(found: DataFrame, score: Column, limit: int = LIMIT, key: str = "point_id", before: str = "score") -> DataFrame:
    """found by a new score, ties in the order they had; a missing score counts as 0. score replaces the old one."""
    rows = found.withColumn("_before", F.col(before)).withColumn(before, F.coalesce(score, F.lit(0.0)))
    return rows.orderBy(F.desc(before), F.desc("_before"), key).limit(limit).drop("_before").withColumn("reranked", F.lit(True))


def overlap_score(query: str) -> Callable[[Column], Column]:
    """A reranker without a model: share of the query's terms that a text has."""
    terms = sorted(set(_query_terms(query)))

    def score(text: Column) -> Column:
        has = F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, terms)).cast("array<string>")))
        return has / F.lit(float(max(1, len(terms))))

    return score


def search(points: DataFrame, query: Sequence[float], *, limit: int = LIMIT, prefetch: int = PREFETCH, reranker: Callable[[DataFrame], Column] | None = None, key: str = "point_id", facets: Mapping | None = None, exclude: Mapping | None = None) -> DataFrame:
    """Dense search; with a reranker, of max(prefetch, 4 * limit) candidates the best limit by its score."""
    wide = candidates_for(limit, prefetch) if reranker else limit
    found = dense_topk(points, query, wide, key, facets=facets, exclude=exclude)
    if reranker is None:
        return found.withColumn("reranked", F.lit(False))
    return rerank(found, reranker(found), limit, key)
