"""The registered queries over the driver's tables and their SQL.

Documents stand for files: path `source/doc_id.md`, facets lang and source. Embeddings stand for dense points.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import facets as fc
from lodestone.functions import text as tx
from lodestone.functions import vectors as vc
from lodestone.operators import batches, corpus, events, facet_counts, files, search
from lodestone.operators.chunk import MAX_CHARS, MIN_CHARS, chunk_files, min_chars_filter
from lodestone.operators.chunk_text import OVERLAP
from lodestone.sources.globs import to_regex
from lodestone.sources.tables import Table, shared_folder
from lodestone.streaming.watch import upsert_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.withColumn("path", path).withColumn("facets", F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array("source")))


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.col("embedding").alias("dense"), F.create_map(F.lit("label"), F.array(F.col("label").cast("string"))).alias("facets"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


FIRST = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
SCORE = "round(list_cosine_similarity(embedding::DOUBLE[], q), 6)"


# Search.


@query(f"SELECT vec_id, {SCORE} AS score FROM embeddings, {FIRST} ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_topk(vector_points(spark, sf_dir), first_vector(spark, sf_dir), 10, "vec_id", digits=6).select("vec_id", "score")


@query(f"SELECT vec_id, {SCORE} AS score FROM embeddings, {FIRST} WHERE label IN (1, 2, 3) AND NOT label IN (3) ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.dense_topk(vector_points(spark, sf_dir), first_vector(spark, sf_dir), 10, "vec_id", facets={"label": ["1", "2", "3"]}, exclude={"label": ["3"]}, digits=6)
    return found.select("vec_id", "score")


@query("""
WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10
""")
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    points = vector_points(spark, sf_dir)
    queries = points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("dense").alias("query_vector"))
    return search.dense_topk_batch(points, queries, 10, "vec_id").select("query_id", "vec_id", "score", "rank")


@query(f"""
WITH c AS (SELECT vec_id, {SCORE} AS dense_score FROM embeddings, {FIRST} ORDER BY dense_score DESC, vec_id LIMIT 80)
SELECT vec_id, coalesce(quality, 0)::DOUBLE AS score, true AS reranked
FROM c LEFT JOIN labels ON doc_id = vec_id ORDER BY score DESC, dense_score DESC, vec_id LIMIT 10
""")
def dense_prefetch_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = search.dense_topk(vector_points(spark, sf_dir), first_vector(spark, sf_dir), search.candidates_for(10), "vec_id", digits=6)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    found = wide.join(labels, "vec_id", "left")
    return search.rerank(found, F.col("quality").cast("double"), 10, "vec_id").select("vec_id", "score", "reranked")


TERMS = "the of nicht para"
POSTINGS = """
w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
p AS (SELECT doc_id, lang, doc_len, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, lang, len(w)::INT AS doc_len, unnest(w) AS term FROM w) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM documents)"""
BM25 = """
s AS (SELECT doc_id, lang, sum(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / 256)) * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) AS score
  FROM p JOIN f USING (term), n WHERE term IN ('the', 'of', 'nicht', 'para') GROUP BY ALL)
SELECT doc_id, round(score, 6) AS score FROM s"""


@query(f"WITH {POSTINGS},{BM25} ORDER BY 2 DESC, 1 LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_topk(doc_files(spark, sf_dir), TERMS, 10, "doc_id")


@query(f"WITH {POSTINGS},{BM25} WHERE lang IN ('de', 'es') ORDER BY 2 DESC, 1 LIMIT 10")
def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_topk(doc_files(spark, sf_dir), TERMS, 10, "doc_id", facets={"lang": ["de", "es"]})


@query(f"WITH {POSTINGS} SELECT doc_id, term, tf, doc_len FROM p")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "term", "tf", "doc_len")


@query(f"WITH {POSTINGS} SELECT term, df, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM f, n")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.count("*").cast("double").alias("n"))
    freq = search.document_frequency(docs).crossJoin(F.broadcast(total))
    return freq.select("term", "df", F.round(search.idf(F.col("df"), F.col("n")), 6).alias("idf"))


HASHED = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::BIGINT % 64)::INT AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM b"""


@query(HASHED)
def hash_embed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vc.hash_buckets(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return made.withColumn("value", F.round("value", 6))


@query("""
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
h AS (SELECT ceil(abs(x) * 10000)::BIGINT AS k, count(*) AS n FROM x GROUP BY 1),
c AS (SELECT k, sum(n) OVER (ORDER BY k) AS upto, sum(n) OVER () AS al FROM h),
q AS (SELECT min(k) / 10000::DOUBLE AS scale FROM c WHERE upto >= 0.99::DOUBLE * al)
SELECT vec_id, list(round(greatest(-1, least(1, x / scale)) * 127)::TINYINT ORDER BY i)::VARCHAR AS q8 FROM x, q GROUP BY vec_id
""")
def q8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """int8 codes, clipped at the 0.99 quantile of all components."""
    points = vector_points(spark, sf_dir)
    codes = vc.quantize(F.col("dense"), F.lit(vc.clip_scale(points, "dense")))
    shown = F.concat(F.lit("["), F.array_join(F.transform(codes, lambda x: x.cast("string")), ", "), F.lit("]"))
    return points.select("vec_id", shown.alias("q8"))


# Facets.


@query("SELECT key, count(*)::BIGINT AS points FROM (SELECT unnest(['lang', 'source']) AS key FROM documents) GROUP BY key")
def facet_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_counts.facet_keys(doc_files(spark, sf_dir))


@query("SELECT source AS value, count(*)::BIGINT AS points FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10000")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_counts.facet_values(doc_files(spark, sf_dir), "source")


def conversation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per conversation; its roles are a facet of several values."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.count("*").alias("n"))
    long = F.when(F.col("n") > 4, "long").otherwise("short")
    return turns.select("conv_id", F.create_map(F.lit("role"), "roles", F.lit("length"), F.array(long)).alias("facets"))


@query("SELECT role AS value, count(DISTINCT conv_id)::BIGINT AS points FROM conversations GROUP BY role")
def facet_values_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_counts.facet_values(conversation_points(spark, sf_dir), "role")


@query("""
WITH p AS (SELECT 'source' AS key, source AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS r FROM p)
SELECT key, sum(n)::BIGINT AS points, count(*)::BIGINT AS distinct_values, string_agg(value, ',' ORDER BY r) FILTER (r <= 5) AS values, count(*) > 5 AS truncated FROM r GROUP BY key
""")
def facet_overview_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_counts.facet_overview(doc_files(spark, sf_dir), 5).withColumn("values", F.array_join("values", ","))


DECLARED = [("docs", "lang", "en"), ("docs", "lang", "it"), ("docs", "team", "core"), ("docs", "source", "src0"), ("other", "lang", "en")]


@query(f"""
WITH d(space, key, value) AS (VALUES {", ".join(map(str, DECLARED))}),
s AS (SELECT 'docs' AS space, 'lang' AS key, lang AS value, count(*) AS points FROM documents GROUP BY 3 UNION ALL SELECT 'docs', 'source', source, count(*) FROM documents GROUP BY 3),
b AS (SELECT space, key, value, CASE WHEN (space, key) IN (SELECT (space, key) FROM s) THEN coalesce(points, 0)::BIGINT END AS points,
  CASE WHEN d.space IS NOT NULL AND s.space IS NOT NULL THEN 'both' WHEN d.space IS NOT NULL THEN 'declared' ELSE 'stored' END AS source
  FROM d FULL JOIN s USING (space, key, value)),
z AS (SELECT space, key, count(*)::BIGINT AS distinct_values, sum(points)::BIGINT AS total FROM b GROUP BY ALL)
SELECT b.space, b.key, value, points, source, distinct_values FROM b JOIN z USING (space, key) WHERE distinct_values <= 10
UNION ALL SELECT space, key, NULL, total, NULL, distinct_values FROM z WHERE distinct_values > 10
""")
def facets_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame(DECLARED, "space string, key string, value string")
    stored = facet_counts.facet_pairs(doc_files(spark, sf_dir).withColumn("space", F.lit("docs")), "space")
    return facet_counts.facets_report(declared, stored, 10)


@query("""
WITH m(key, meaning) AS (VALUES ('lang', 'The language'), ('team', 'Who owns it'))
SELECT k.key, points, meaning FROM (SELECT unnest(['lang', 'source']) AS key, count(*)::BIGINT AS points FROM documents GROUP BY 1) k LEFT JOIN m USING (key)
""")
def facet_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys with what the project says they mean."""
    return facet_counts.with_meanings(facet_counts.facet_keys(doc_files(spark, sf_dir)), {"lang": "The language", "team": "Who owns it"})


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'de')")
def facet_filter_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(doc_files(spark, sf_dir), {"lang": ["fr", "de"]}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT coalesce(lang IN ('fr', 'de'), false)")
def facet_filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(doc_files(spark, sf_dir), None, {"lang": ["fr", "de"], "absent": ["x"]}).select("doc_id")


@query("""
WITH c AS (SELECT conv_id, list(DISTINCT role) AS roles, CASE WHEN count(*) > 4 THEN 'long' ELSE 'short' END AS length FROM conversations GROUP BY conv_id)
SELECT conv_id FROM c WHERE list_has_any(roles, ['system', 'user']) AND length = 'long' AND NOT list_has_any(roles, ['system'])
""")
def facet_filter_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(conversation_points(spark, sf_dir), {"role": ["system", "user"], "length": ["long"]}, {"role": ["system"]}).select("conv_id")


@query("SELECT doc_id, 'lang=' || lang || ', source=' || source || '|copy, group=docs' AS line FROM documents")
def facet_merge_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group facets below chunk facets below the group's name, then as a line."""
    own = F.create_map(F.lit("source"), F.array(F.col("source"), F.lit("copy"), F.col("source")))
    both = fc.with_facet(fc.clean(fc.merged(F.col("facets"), own)), "group", F.array(F.lit("docs")))
    return doc_files(spark, sf_dir).select("doc_id", fc.facets_line(both).alias("line"))


# Files, claims and ledgers.

GROUPS = [
    ("all", "docs", 1, ["**/*.md"], [], True),
    ("first", "docs", 10, ["src{0,1,2}/**"], ["**/*7.md"], True),
    ("also", "docs", 10, ["src1/*.md"], [], True),
    ("off", "docs", 99, ["**"], [], False),
    ("wide", "other", 5, ["src[0-4]/?.md", "src5/**"], [], True),
]


def groups_frame(spark: SparkSession) -> DataFrame:
    rows = [(n, s, p, list(map(to_regex, i)), list(map(to_regex, e)), on) for n, s, p, i, e, on in GROUPS]
    return spark.createDataFrame(rows, "name string, space string, priority int, include array<string>, exclude array<string>, enabled boolean")


@query(r"""
WITH f AS (SELECT source || '/' || doc_id || '.md' AS path FROM documents),
g AS (
  SELECT path, 'docs' AS space, 'all' AS name, 1 AS priority FROM f
  UNION ALL SELECT path, 'docs', 'first', 10 FROM f WHERE regexp_matches(path, '^src[012]/') AND path NOT LIKE '%7.md'
  UNION ALL SELECT path, 'docs', 'also', 10 FROM f WHERE path LIKE 'src1/%'
  UNION ALL SELECT path, 'other', 'wide', 5 FROM f WHERE regexp_matches(path, '^src[0-4]/[^/]\.md$') OR path LIKE 'src5/%'
), r AS (SELECT *, row_number() OVER (PARTITION BY space, path ORDER BY priority DESC, name) AS r FROM g)
SELECT path, space, name, priority::INT AS priority FROM r WHERE r = 1
""")
def claim_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.claim(doc_files(spark, sf_dir).select("path"), groups_frame(spark)).select("path", "space", "name", "priority")


def ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files as they are and as an earlier run saw them: some new, some touched, some edited, one in ten gone since."""
    now = doc_files(spark, sf_dir).select("doc_id", "path", F.col("n_chars").alias("size"), (F.col("doc_id") * 1000 + 1).alias("mtime_ns"), F.sha2("text", 256).alias("sha256"), F.lit("markdown").alias("language"))
    seen = now.where("doc_id % 7 != 3").withColumn("mtime_ns", F.expr("mtime_ns + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END"))
    seen = seen.withColumn("sha256", F.expr("CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE sha256 END"))
    return now.where("doc_id % 10 != 4"), seen


PLAN = """
WITH n AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, n_chars AS size, doc_id * 1000 + 1 AS mtime, sha256(text) AS sha FROM documents),
m AS (SELECT path, size, mtime + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END AS mtime, CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE sha END AS sha FROM n WHERE doc_id % 7 != 3),
f AS (SELECT * FROM n WHERE doc_id % 10 != 4),
plan AS (SELECT coalesce(f.path, m.path) AS path,
  CASE WHEN f.path IS NULL THEN 'deleted' WHEN f.size > 20000 THEN 'skip_large' WHEN m.path IS NULL THEN 'new'
  WHEN f.mtime = m.mtime AND f.size = m.size THEN 'skip_stat' WHEN f.sha = m.sha THEN 'skip_hash' ELSE 'changed' END AS outcome
  FROM f FULL JOIN m ON f.path = m.path)"""


@query(f"{PLAN} SELECT path, outcome FROM plan")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, seen = ledger(spark, sf_dir)
    return files.incremental(now, seen, max_bytes=20_000)


@query(f"{PLAN} SELECT DISTINCT path FROM plan WHERE outcome NOT IN ('skip_stat', 'skip_large') OR path IN (SELECT path FROM f JOIN m USING (path) WHERE f.mtime != m.mtime)")
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a watcher hands on: files that differ from the ledger in any space."""
    now, seen = ledger(spark, sf_dir)
    both = lambda df: df.withColumn("space", F.explode(F.array(F.lit("docs"), F.lit("other"))))
    return files.changed_paths(both(now), both(seen), max_bytes=20_000)


@query(f"{PLAN} SELECT path FROM plan WHERE outcome = 'deleted'")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, seen = ledger(spark, sf_dir)
    return files.deleted(now, seen).select("path")


@query(f"{PLAN} SELECT path, outcome FROM plan WHERE path LIKE 'src3/%'")
def watch_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, seen = ledger(spark, sf_dir)
    wanted = doc_files(spark, sf_dir).where("source = 'src3'").select("path")
    return files.incremental(now, seen, wanted, max_bytes=20_000)


@query("SELECT source || '/' || doc_id || '.md' AS path, CASE WHEN n_chars > 8000 AND doc_id % 5 != 0 THEN 'skip_large' ELSE 'read' END AS outcome FROM documents")
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against a cap of 8000; one in five is an OpenAPI file, which has none."""
    language = F.when(F.col("doc_id") % 5 == 0, "openapi").otherwise("markdown")
    large = files.too_large(F.col("n_chars"), language, 8000)
    return doc_files(spark, sf_dir).select("path", F.when(large, "skip_large").otherwise("read").alias("outcome"))


UUID5 = """
WITH k AS (SELECT doc_id, source || '/' || doc_id || '.md:0:' || n_chars AS k FROM documents),
h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(k)) AS h FROM k)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h"""


@query(UUID5)
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("path", F.lit(":0:"), F.col("n_chars").cast("string"))
    return doc_files(spark, sf_dir).select("doc_id", tx.point_id(key).alias("point_id"))


@query("SELECT doc_id, sha256(text) AS content_sha256, strlen(text)::BIGINT AS bytes, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS newlines FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("content_sha256"), F.octet_length(t).cast("long").alias("bytes"), tx.newline_count(t).cast("long").alias("newlines"))


@query("SELECT doc_id, sha256('File: ' || source || '/' || doc_id || '.md' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Symbol: s' || doc_id || chr(10) ELSE '' END || 'Kind: file' || chr(10) || 'Facets: lang=' || lang || ', source=' || source || chr(10) || chr(10) || text) AS embed_sha256 FROM documents")
def embed_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_files(spark, sf_dir)
    symbol = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("s"), F.col("doc_id").cast("string"))).otherwise(F.lit(""))
    text = tx.embed_text(F.col("path"), symbol, F.lit("file"), F.lit(None).cast("string"), F.col("facets"), F.col("text"))
    return rows.select("doc_id", F.sha2(text, 256).alias("embed_sha256"))


def as_code(rows: DataFrame) -> DataFrame:
    """Files of several kinds by id."""
    ext = F.element_at(F.array(*map(F.lit, (".md", ".ts", ".py", ".txt", ".json"))), (F.col("doc_id") % 5).cast("int") + 1)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return rows.withColumn("path", path).withColumn("language", tx.language(path))


CODE_FILES = "c AS (SELECT doc_id, lang, text, source || '/' || doc_id || (['.md', '.ts', '.py', '.txt', '.json'])[doc_id % 5 + 1] AS path, (['markdown', 'typescript', 'python', NULL, 'json'])[doc_id % 5 + 1] AS language, (['', 'ts', 'python', '', 'json'])[doc_id % 5 + 1] AS fence FROM documents)"


@query(f"WITH {CODE_FILES} SELECT path, language, CASE WHEN language IN ('typescript', 'python') THEN 'code' ELSE coalesce(language, 'lines') END AS chunker, 'local' AS embed FROM c")
def file_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_code(doc_files(spark, sf_dir))
    embed = tx.embed_strategy(F.lit("bge-small"), F.lit("local"))
    return rows.select("path", "language", tx.chunker(F.col("language")).alias("chunker"), embed.alias("embed"))


@query(f"WITH {CODE_FILES} SELECT doc_id, sha256(CASE WHEN language = 'markdown' THEN text ELSE '# ' || path || chr(10) || chr(10) || '```' || fence || chr(10) || text || chr(10) || '```' || chr(10) END) AS body_sha256 FROM c")
def prepared_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_code(doc_files(spark, sf_dir))
    return rows.select("doc_id", F.sha2(tx.prepared_body(F.col("path"), F.col("language"), F.col("text")), 256).alias("body_sha256"))


@query(f"""WITH {CODE_FILES}
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'external/' || lang || '/' || doc_id || '/' || split_part(path, '/', 2)
ELSE 'internal/current/default/' || path || CASE WHEN language IS DISTINCT FROM 'markdown' AND language IS NOT NULL THEN '.md' ELSE '' END END AS corpus_key FROM c""")
def corpus_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_code(doc_files(spark, sf_dir))
    scope = F.when(F.col("doc_id") % 3 == 0, "external").otherwise("internal")
    facets = F.create_map(F.lit("scope"), F.array(scope), F.lit("vendor"), F.array("lang"))
    return rows.select("doc_id", tx.corpus_key(F.col("path"), F.col("language"), facets).alias("corpus_key"))


@query("""
WITH p AS (SELECT doc_id, 'apis/vendor' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN '--' ELSE '-' END || 'orders' || doc_id || '.openapi.json' AS rel,
  'Title > ' || (['GET', 'POST', 'Notes', 'PUT'])[doc_id % 4 + 1] || ' /items/' || doc_id || ' > Responses' AS heading,
  '**Operation ID**: `op' || doc_id || '`' || chr(10) || '**Tags**: A, `B`, A' AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'orders' || doc_id END AS slug,
  CASE WHEN doc_id % 4 != 2 THEN (['GET', 'POST', '', 'PUT'])[doc_id % 4 + 1] END AS method,
  CASE WHEN doc_id % 4 != 2 THEN '/items/' || doc_id END AS api_path, 'op' || doc_id AS operation_id, 'A|B' AS tags FROM p
""")
def openapi_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, doc = F.col("doc_id"), F.col("doc_id").cast("string")
    rel = F.concat(F.lit("apis/vendor"), (n % 3).cast("string"), F.when(n % 2 == 0, "--").otherwise("-"), F.lit("orders"), doc, F.lit(".openapi.json"))
    method = F.element_at(F.array(*map(F.lit, ("GET", "POST", "Notes", "PUT"))), (n % 4).cast("int") + 1)
    heading = F.concat(F.lit("Title > "), method, F.lit(" /items/"), doc, F.lit(" > Responses"))
    text = F.concat(F.lit("**Operation ID**: `op"), doc, F.lit("`\n**Tags**: A, `B`, A"))
    op = fc.operation(heading)
    return table(spark, sf_dir, "documents").select("doc_id", fc.spec_slug(rel).alias("slug"), op["method"].alias("method"), op["path"].alias("api_path"), fc.operation_id(text).alias("operation_id"), F.array_join(fc.operation_tags(text), "|").alias("tags"))


@query("""
SELECT doc_id, greatest(1, floor(n_chars / 4))::BIGINT AS tokens, greatest(1, floor(n_chars / 2))::BIGINT AS context_tokens,
  CASE WHEN n_chars < 1000 THEN n_chars || ' B' ELSE (n_chars + 50) // 1000 || '.' || (n_chars + 50) // 100 % 10 || ' KB' END AS size,
  CASE doc_id % 4 WHEN 0 THEN 90.0 WHEN 1 THEN 300.0 WHEN 2 THEN 7200.0 END::DOUBLE AS seconds FROM documents
""")
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("90s", "5m", "2h", "soon"))), (F.col("doc_id") % 4).cast("int") + 1)
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(n).alias("tokens"), tx.estimate_tokens(n, 2).alias("context_tokens"), tx.bytes_text(n).alias("size"), tx.duration_seconds(text).alias("seconds"))


@query("SELECT path FROM (SELECT source || '/' || (['src', 'dist', '.git', 'builds'])[doc_id % 4 + 1] || '/' || doc_id AS path, doc_id FROM documents) WHERE doc_id % 4 NOT IN (1, 2)")
def hard_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("src", "dist", ".git", "builds"))), (F.col("doc_id") % 4).cast("int") + 1)
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", folder, F.col("doc_id").cast("string")).alias("path"))
    return rows.where(~tx.hard_excluded(F.col("path")))


SIDECAR = """'{' || chr(10) || '  "metadataAttributes": {' || chr(10) || '    "group": [' || chr(10) || '      "docs"' || chr(10) || '    ],' || chr(10) || '    "lang": [' || chr(10) || '      "' || lang || '"' || chr(10) || '    ],' || chr(10) || '    "source": [' || chr(10) || '      "' || source || '"' || chr(10) || '    ]' || chr(10) || '  }' || chr(10) || '}' || chr(10)"""


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(doc_files(spark, sf_dir).withColumn("language", F.lit("markdown")).withColumn("grp", F.lit("docs")))


@query(f"SELECT 'internal/current/default/' || source || '/' || doc_id || '.md' AS corpus_key, sha256(text) AS content_sha256, sha256({SIDECAR}) AS sidecar_sha256 FROM documents")
def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_rows(spark, sf_dir).select("corpus_key", "content_sha256", "sidecar_sha256")


@query("""
SELECT 'internal/current/default/' || source || '/' || doc_id || '.md' AS corpus_key, CASE WHEN lang = 'fr' THEN 'prune' ELSE 'write' END AS action
FROM documents WHERE lang = 'fr' OR doc_id % 4 = 0
""")
def corpus_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a corpus where one document in four has older content, and French ones are no longer kept."""
    made = corpus_rows(spark, sf_dir).withColumn("fr", F.col("sidecar").contains('"fr"')).withColumn("id", F.regexp_extract("corpus_key", r"(\d+)\.md$", 1).cast("long"))
    stored = made.withColumn("content_sha256", F.when(F.col("id") % 4 == 0, F.lit("old")).otherwise(F.col("content_sha256")))
    keep = made.where("NOT fr")
    write = corpus.to_write(keep, stored).select("corpus_key", F.lit("write").alias("action"))
    return write.unionByName(corpus.to_prune(stored, keep).select("corpus_key", F.lit("prune").alias("action")))


@query("SELECT source || '/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def stale_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose rendering is missing (one in three) or older (one in five)."""
    now = doc_files(spark, sf_dir).select("doc_id", "path", F.sha2("text", 256).alias("sha256"))
    cache = now.where("doc_id % 3 != 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("sha256")))
    return corpus.stale_specs(now, cache).select("path")


@query("""
SELECT user_id AS point_id, arg_max(event_type, ts) AS event_type, max(ts) AS version FROM events GROUP BY user_id
""")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("point_id"), "event_type", F.col("ts").alias("version"))
    return files.last_write(rows)


@query("SELECT 'lang' AS key, lang AS value FROM documents WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT 'source', source FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def distinct_facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_counts.facet_pairs(doc_files(spark, sf_dir)).select("key", "value")


@query("""
SELECT CASE WHEN regexp_matches(e, 'error|failed') THEN 'error' WHEN regexp_matches(e, 'skip|retry|busy|stopped') THEN 'warn' ELSE 'info' END AS level, count(*)::BIGINT AS n
FROM (SELECT CASE event_type WHEN 'view' THEN 'skip_stat' WHEN 'error' THEN 'embed_failed' ELSE event_type END AS e FROM events) GROUP BY 1
""")
def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "view", "skip_stat").when(kind == "error", "embed_failed").otherwise(kind)
    return table(spark, sf_dir, "events").groupBy(tx.event_level(name).alias("level")).agg(F.count("*").alias("n"))


@query(f"""
WITH {POSTINGS}, c AS (SELECT * FROM (WITH {BM25.strip()}) ORDER BY score DESC, doc_id LIMIT 10)
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, '{{"path":"' || source || '/' || doc_id || '.md","facets":{{"lang":["' || documents.lang || '"],"source":["' || source || '"]}}}}' AS hit FROM c JOIN documents USING (doc_id)
""")
def hits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's hits as ranked JSON payloads."""
    docs = doc_files(spark, sf_dir)
    found = search.bm25_topk(docs, TERMS, 10, "doc_id").join(docs.select("doc_id", "path", "facets"), "doc_id")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    return found.select(rank.cast("long").alias("rank"), F.to_json(F.struct("path", "facets")).alias("hit"))


# Conversations.


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question
FROM conversations
""")
def chat_turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    question = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", question.alias("question"))


@query("SELECT role, lpad((turn + 1)::VARCHAR, 2, '0') AS day, count(*)::BIGINT AS points FROM conversations GROUP BY ALL")
def chat_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the facets of a transcript: role and day, counted."""
    rows = table(spark, sf_dir, "conversations")
    at = F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    facets = F.create_map(F.lit("at"), F.array(at), F.lit("day"), F.array(F.substring(at, 1, 10)), F.lit("role"), F.array("role"))
    one = rows.select(facets.alias("f")).select(F.get("f.role", F.lit(0)).alias("role"), F.substring(F.get("f.day", F.lit(0)), 9, 2).alias("day"))
    return one.groupBy("role", "day").agg(F.count("*").alias("points"))


# Batches. Sources are cut into segments of ids, so that no task gathers a whole source.

SEGMENT = 4096

def _pack_sql(total: int, items: int, size: str) -> str:
    return f"""
WITH RECURSIVE i AS (SELECT source, doc_id, {size} AS n, doc_id // {SEGMENT} AS segment, row_number() OVER (PARTITION BY source, doc_id // {SEGMENT} ORDER BY doc_id) AS k FROM documents),
b AS (
  SELECT source, segment, doc_id, n, k, 0 AS batch, n AS total, 1 AS items FROM i WHERE k = 1
  UNION ALL
  SELECT i.source, i.segment, i.doc_id, i.n, i.k, CASE WHEN b.total + i.n > {total} OR b.items >= {items} THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.total + i.n > {total} OR b.items >= {items} THEN i.n ELSE b.total + i.n END,
    CASE WHEN b.total + i.n > {total} OR b.items >= {items} THEN 1 ELSE b.items + 1 END
  FROM b JOIN i ON i.source = b.source AND i.segment = b.segment AND i.k = b.k + 1
)
SELECT source, doc_id, batch::INT AS batch FROM b"""


@query(_pack_sql(40_000, 64, "n_chars"))
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / SEGMENT).alias("segment"), "doc_id", "n_chars")
    return batches.packed(rows, ["source", "segment"], "doc_id", "n_chars").select("source", "doc_id", "batch")


@query(_pack_sql(20_000, 16_000, "greatest(1, floor(n_chars / 2))::BIGINT"))
def pack_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / SEGMENT).alias("segment"), "doc_id", tx.estimate_tokens(F.col("n_chars"), 2).alias("tokens"))
    return batches.packed(rows, ["source", "segment"], "doc_id", "tokens", batches.SPAN_TOKENS, batches.SPAN_ITEMS).select("source", "doc_id", "batch")


@query(f"""
WITH {POSTINGS}, c AS (SELECT * FROM (WITH {BM25.strip()}) ORDER BY score DESC, doc_id LIMIT 200),
r AS (SELECT doc_id, row_number() OVER w AS k, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM c JOIN documents USING (doc_id) WINDOW w AS (ORDER BY score DESC, doc_id))
SELECT doc_id, running::BIGINT AS running FROM r WHERE running <= 60000 OR k = 1
""")
def rerank_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 candidates of a search, cut where they pass a budget."""
    docs = doc_files(spark, sf_dir)
    found = search.bm25_topk(docs, TERMS, 200, "doc_id").join(docs.select("doc_id", "n_chars"), "doc_id")
    return batches.within_budget(found, "n_chars", 60_000, [F.desc("score"), F.col("doc_id")]).select("doc_id", "running")


# Chunks.


#: Line ends and white space as Python's str has them.
_ENDS, _BLANK = "\\n\\v\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}", "\\t-\\r\\x1c-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, unnest(l) AS l, unnest(range(1, len(l) + 1)) AS k, len(l) AS last
  FROM (SELECT doc_id, CASE WHEN length(t) <= {MAX_CHARS} THEN [t] ELSE regexp_extract_all(t, '[^\r{_ENDS}]*(?:\r\n|[\r{_ENDS}])|[^\r{_ENDS}]+') END AS l FROM d)),
x AS (SELECT *, length(l) AS n, strlen(l) AS b, length(l) - length(replace(l, chr(10), '')) AS nl FROM u),
c AS MATERIALIZED (SELECT *, coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(b) OVER w, 0) AS b0, coalesce(sum(nl) OVER w, 0) AS nl0 FROM x
  WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS MATERIALIZED (SELECT *, min(k) OVER v AS back, min(n0) OVER v AS back0 FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY n0 RANGE BETWEEN {OVERLAP} PRECEDING AND CURRENT ROW)),
r AS (
  SELECT doc_id, k, last, 1::BIGINT AS begun, NULL::BIGINT AS a, NULL::BIGINT AS z, n0 AS from0 FROM s WHERE k = 1
  UNION ALL
  SELECT doc_id, k, last, CASE WHEN filled THEN greatest(begun, back) ELSE begun END, CASE WHEN filled THEN begun END, CASE WHEN filled THEN k - 1 END, CASE WHEN filled THEN greatest(from0, back0) ELSE from0 END
  FROM (SELECT s.*, begun, from0, s.n0 + s.n - from0 > {MAX_CHARS} AS filled FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k + 1)),
w AS (SELECT doc_id, a, z FROM r WHERE a IS NOT NULL UNION ALL SELECT doc_id, begun, last FROM r WHERE k = last),
p AS (SELECT doc_id, a, z, string_agg(l, '' ORDER BY k) AS text, min(b0) AS b0, sum(b) AS b, min(nl0) AS nl0, sum(nl) AS nl FROM w JOIN s USING (doc_id) WHERE k BETWEEN a AND z GROUP BY ALL),
q AS (SELECT *, max(length(text)) OVER (PARTITION BY doc_id) >= {MIN_CHARS} AS any_long FROM p WHERE regexp_matches(text, '[^{_BLANK}]'))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY z) - 1)::INT AS ordinal, 'file' AS kind, (1 + nl0)::INT AS start_line, (1 + nl0 + nl)::INT AS end_line,
  b0::BIGINT AS start_byte, (b0 + b)::BIGINT AS end_byte, sha256(text) AS text_sha256
FROM q WHERE length(text) >= {MIN_CHARS} OR NOT any_long
""")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by lines."""
    made = chunk_files(doc_files(spark, sf_dir).select("doc_id", "path", F.lit(None).cast("string").alias("language"), "text"))
    return made.select("doc_id", "ordinal", "kind", "start_line", "end_line", "start_byte", "end_byte", F.sha2("text", 256).alias("text_sha256"))


@query(r"""
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' ELSE 'user' END AS role, '2024-01-01T00:' || lpad(turn::VARCHAR, 2, '0') || ':00Z' AS ts,
  substr(regexp_replace(text, '[\s<>]+', ' ', 'g'), 1, 60) AS preview, text FROM conversations),
b AS (SELECT *, '<details><summary>' || ts || ' - ' || role || ': ' || preview || '</summary>' || chr(10) || chr(10) || text || chr(10) || '</details>' || chr(10) AS b FROM t),
l AS (SELECT *, length(b) - length(replace(b, chr(10), '')) AS n, row_number() OVER w - 1 AS k, last_value(CASE WHEN role = 'user' THEN b END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT *, 4 + 2 * k + coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line, trim(preview) AS said FROM l)
SELECT conv_id, k::INT AS ordinal, 'turn' AS kind, said AS symbol, 'Chat > ' || ts || ' - ' || role || ': ' || said AS heading_path, line::INT AS start_line, (line + n)::INT AS end_line,
  'at=' || ts || ', day=2024-01-01, role=' || role AS facets, sha256(CASE WHEN role = 'agent' AND asked IS NOT NULL THEN rtrim(asked, chr(10)) || chr(10) || chr(10) || b ELSE b END) AS text_sha256
FROM m
""")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts of one Markdown file each."""
    turns = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "assistant", "agent").otherwise("user")
    at = F.concat(F.lit("2024-01-01T00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00Z"))
    preview = F.substring(F.regexp_replace("text", r"[\s<>]+", " "), 1, 60)
    block = F.concat(F.lit("<details><summary>"), at, F.lit(" - "), role, F.lit(": "), preview, F.lit("</summary>\n\n"), F.col("text"), F.lit("\n</details>\n"))
    docs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs"))
    text = F.concat(F.lit("# Chat\n\n---\n"), F.array_join(F.transform("bs", lambda b: b["b"]), "\n---\n"))
    made = chunk_files(docs.select("conv_id", F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.lit("markdown").alias("language"), text.alias("text")))
    return made.select("conv_id", "ordinal", "kind", "symbol", "heading_path", "start_line", "end_line", fc.facets_line(F.col("chunk_facets")).alias("facets"), F.sha2("text", 256).alias("text_sha256"))


@query(r"""
WITH p AS (SELECT p_partkey::VARCHAR AS k, p_partkey % 2 = 1 AS odd, regexp_replace(p_name, '\W+', '_', 'g') AS name, p_retailprice::VARCHAR AS price, p_size::VARCHAR AS size FROM part),
t AS (SELECT *, 'import { base } from "./base";' AS t0, concat_ws(chr(10), '/** Price of ' || name || '. */', 'export class P' || k || ' {', '  price = ' || price || ';', '  size() { return ' || size || '; }', '}') AS t1,
  concat_ws(chr(10), 'export function make' || k || '() {', '  return new P' || k || '();', '}') AS t2,
  concat_ws(chr(10), '# Price of ' || name, 'def price_' || k || '():', '    return ' || price) AS y0, concat_ws(chr(10), 'class P' || k || ':', '    size = ' || size) AS y1 FROM p),
u AS (
  SELECT 'lib/' || k || '.ts' AS path, 0 AS ordinal, 'block' AS kind, NULL AS symbol, 1 AS start_line, 0 AS start_byte, t0 AS text FROM t WHERE odd
  UNION ALL SELECT 'lib/' || k || '.ts', 1, 'export', 'P' || k, 3, strlen(t0) + 2, t1 FROM t WHERE odd
  UNION ALL SELECT 'lib/' || k || '.ts', 2, 'export', 'make' || k, 9, strlen(t0) + strlen(t1) + 4, t2 FROM t WHERE odd
  UNION ALL SELECT 'lib/' || k || '.py', 0, 'function', 'price_' || k, 4, 14, y0 FROM t WHERE NOT odd
  UNION ALL SELECT 'lib/' || k || '.py', 1, 'class', 'P' || k, 9, strlen(y0) + 17, y1 FROM t WHERE NOT odd)
SELECT path, ordinal, kind, symbol, start_line, (start_line + len(string_split(text, chr(10))) - 1)::INT AS end_line, start_byte::BIGINT AS start_byte, (start_byte + strlen(text))::BIGINT AS end_byte, text FROM u
""")
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as generated TypeScript and Python modules."""
    part = table(spark, sf_dir, "part")
    name = F.regexp_replace("p_name", r"\W+", "_")
    key = F.col("p_partkey").cast("string")
    ts = F.concat(F.lit('import { base } from "./base";\n\n/** Price of '), name, F.lit(". */\nexport class P"), key, F.lit(" {\n  price = "), F.col("p_retailprice").cast("string"), F.lit(";\n  size() { return "), F.col("p_size").cast("string"), F.lit("; }\n}\n\nexport function make"), key, F.lit("() {\n  return new P"), key, F.lit("();\n}\n"))
    py = F.concat(F.lit("import base\n\n\n# Price of "), name, F.lit("\ndef price_"), key, F.lit("():\n    return "), F.col("p_retailprice").cast("string"), F.lit("\n\n\nclass P"), key, F.lit(":\n    size = "), F.col("p_size").cast("string"), F.lit("\n"))
    odd = F.col("p_partkey") % 2 == 1
    rows = part.select(F.concat(F.lit("lib/"), key, F.when(odd, ".ts").otherwise(".py")).alias("path"), F.when(odd, "typescript").otherwise("python").alias("language"), F.when(odd, ts).otherwise(py).alias("text"))
    return chunk_files(rows, 800, 20).select("path", "ordinal", "kind", "symbol", "start_line", "end_line", "start_byte", "end_byte", "text")


@query(r"""
WITH s AS (SELECT s_suppkey::VARCHAR AS k, s_suppkey % 2 = 0 AS even, s_name AS name, s_acctbal::VARCHAR AS v FROM supplier),
t AS (SELECT *, k || CASE WHEN even THEN '/package.json' ELSE '/data.json' END AS path FROM s)
SELECT path, 0 AS ordinal, CASE WHEN even THEN 'package-json' ELSE 'json' END AS kind, CASE WHEN even THEN name ELSE 'data.json' END AS symbol, 1 AS start_line, CASE WHEN even THEN 9 ELSE 12 END AS end_line,
  CASE WHEN even THEN concat_ws(chr(10), '# package.json `' || name || '`', '', '- File: `' || path || '`', '- Version: 1.0.0', '', '## Dependencies', '', '- `' || name || '`: ' || v, '')
  ELSE concat_ws(chr(10), '# `' || path || '`', '', '```json', '{', '  "name": "' || name || '",', '  "version": "1.0.0",', '  "dependencies": {', '    "' || name || '": "' || v || '"', '  }', '}', '```', '') END AS text
FROM t
""")
def chunk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as package.json files, others as plain JSON."""
    rows = table(spark, sf_dir, "supplier")
    text = F.to_json(F.struct(F.col("s_name").alias("name"), F.lit("1.0.0").alias("version"), F.create_map(F.col("s_name"), F.col("s_acctbal").cast("string")).alias("dependencies")))
    name = F.when(F.col("s_suppkey") % 2 == 0, "package.json").otherwise("data.json")
    made = chunk_files(rows.select(F.concat_ws("/", F.col("s_suppkey").cast("string"), name).alias("path"), F.lit("json").alias("language"), text.alias("text")))
    return made.select("path", "ordinal", "kind", "symbol", "start_line", "end_line", "text")


@query(r"""
WITH n AS (SELECT n_name AS n, 'specSlug=' || n_name AS spec FROM nation),
t AS (SELECT *, spec || ', method=GET, apiPath=/' || n || ', operationId=get' || n || ', apiTag=Read|All' AS g, spec || ', method=POST, apiPath=/' || n || ', operationId=add' || n AS p FROM n),
u AS (SELECT n, unnest([
  {'o': 0, 'h': n || ' API', 'f': spec, 'x': ['# ' || n || ' API', '', '', '', '']},
  {'o': 1, 'h': 'Base URL', 'f': spec, 'x': ['# Base URL', '', '| URL | Description |', '|---|---|', '| https://example.com |  |', '', '']},
  {'o': 2, 'h': 'APIs > GET /' || n, 'f': g, 'x': ['## GET /' || n, '', '**Operation ID**: `get' || n || '`', '', '**Tags**: Read, All', '', 'Reads.', '', '']},
  {'o': 3, 'h': 'APIs > GET /' || n || ' > Parameters', 'f': g, 'x': ['### Parameters', '', '| Name | Type | Required | Description |', '|---|---|---|---|', '| id | string | True |  |', '', '']},
  {'o': 4, 'h': 'APIs > GET /' || n || ' > Responses', 'f': g, 'x': ['### Responses', '', '']},
  {'o': 5, 'h': 'APIs > GET /' || n || ' > Responses > 200', 'f': g, 'x': ['#### 200', '', 'Fine', '', '']},
  {'o': 6, 'h': 'APIs > POST /' || n, 'f': p, 'x': ['## POST /' || n, '', '**Operation ID**: `add' || n || '`', '', '']},
  {'o': 7, 'h': 'APIs > POST /' || n || ' > Responses', 'f': p, 'x': ['### Responses', '', '']},
  {'o': 8, 'h': 'APIs > POST /' || n || ' > Responses > 201', 'f': p, 'x': ['#### 201', '', 'Made', '']}]) AS c FROM t)
SELECT 'apis/world--' || n || '.openapi.json' AS path, c.o::INT AS ordinal, c.h AS heading_path, c.f AS facets, array_to_string(c.x, chr(10)) AS text FROM u
""")
def chunk_openapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as OpenAPI specs of two operations each, rendered, chunked and labelled."""
    rows = table(spark, sf_dir, "nation")
    n = F.col("n_name")
    spec = F.concat(
        F.lit('{"openapi": "3.1.0", "info": {"title": "'), n, F.lit(' API", "version": "1"}, "servers": [{"url": "https://example.com"}], "paths": {"/'), n,
        F.lit('": {"get": {"operationId": "get'), n, F.lit('", "tags": ["Read", "All"], "summary": "Reads.", "parameters": [{"$ref": "#/components/parameters/id"}], "responses": {"200": {"description": "Fine"}}}, "post": {"operationId": "add'), n,
        F.lit('", "responses": {"201": {"description": "Made"}}}}}, "components": {"parameters": {"id": {"name": "id", "required": true, "schema": {"type": "string"}}}}}'),
    )
    made = chunk_files(rows.select(F.concat(F.lit("apis/world--"), n, F.lit(".openapi.json")).alias("path"), F.lit("openapi").alias("language"), spec.alias("text")), 2400, 10)
    return made.select("path", "ordinal", "heading_path", fc.facets_line(F.col("chunk_facets")).alias("facets"), "text")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
b AS (SELECT doc_id, t, length(t) >= 400 AS long FROM l WHERE trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) != ''),
a AS (SELECT *, max(long) OVER (PARTITION BY doc_id) AS has_long FROM b)
SELECT doc_id, count(*)::BIGINT AS chunks, sum(length(t))::BIGINT AS chars FROM a WHERE long OR NOT has_long GROUP BY doc_id
""")
def min_chars_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks: those of 400 characters, or all of a document that has none."""
    rows = doc_files(spark, sf_dir).select("doc_id", "path", F.explode(F.split("text", "\n")).alias("text"))
    return min_chars_filter(rows, 400).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("text")).cast("long").alias("chars"))


# Events and status.

KINDS = ["signup", "error", "click", "view", "purchase"]


@query(f"SELECT user_id, count(*)::BIGINT AS events, {', '.join(f'''count(*) FILTER (event_type = '{k}')::BIGINT AS n_{k}''' for k in KINDS)} FROM events GROUP BY user_id")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.stage_counts(table(spark, sf_dir, "events"), "user_id", KINDS, "event_type")


@query("""
SELECT event_id, count(*) OVER w AS requests, (sum((props->>'k')::BIGINT) OVER w)::BIGINT AS weight FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)
""")
def rate_window_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.rate_window(rows, "event_type", "ts", "k").select("event_id", "requests", "weight")


@query("""
SELECT event_id, coalesce(max(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), false) AS waiting FROM events
""")
def rate_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("throttled", F.col("event_type") == "error")
    return events.cooldown(rows, "user_id", "ts", "throttled", 3600).select("event_id", "waiting")


@query("""
SELECT event_type, sum(value > 50)::BIGINT AS n_large, sum(1)::BIGINT AS n, bool_or(value > 200) AS stopped, count(*) FILTER (user_id = 7)::BIGINT AS n_errors FROM events GROUP BY event_type
""")
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs' counters, merged by type."""
    error = F.when(F.col("user_id") == 7, F.array(F.col("event_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    runs = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 50).cast("long").alias("n_large"), F.lit(1).cast("long").alias("n"), (F.col("value") > 200).alias("stopped"), error.alias("errors"))
    return events.merged_stats(runs, ["n_large", "n"], ["event_type"])


NOW = "2024-01-20 00:00:00"


@query(f"""
WITH p AS (SELECT c_custkey::VARCHAR AS name, c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'off' WHEN 1 THEN '2h' WHEN 2 THEN '' ELSE NULL END AS o FROM customer),
e AS (SELECT name, k, coalesce(nullif(o, ''), CASE WHEN k % 8 < 4 THEN '90s' END, '5m') AS every FROM p),
s AS (SELECT user_id::VARCHAR AS name, max(ts) AS last_finish FROM events WHERE event_type = 'purchase' GROUP BY 1),
d AS (SELECT e.name, every, coalesce(epoch_us(last_finish) / 1e6 + CASE every WHEN '2h' THEN 7200 WHEN '90s' THEN 90 ELSE 300 END, 0)::DOUBLE AS due_at FROM e LEFT JOIN s USING (name) WHERE every != 'off')
SELECT name, every, round(due_at, 3) AS due_at FROM d WHERE due_at <= epoch_us(TIMESTAMP '{NOW}') / 1e6
""")
def schedule_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects, their last purchases as last runs."""
    n = F.col("c_custkey")
    override = F.when(n % 4 == 0, "off").when(n % 4 == 1, "2h").when(n % 4 == 2, "")
    own = F.when(n % 8 < 4, "90s")
    projects = table(spark, sf_dir, "customer").select(n.cast("string").alias("name"), override.alias("o"), own.alias("p"), F.lit("5m").alias("d"))
    state = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").cast("string").alias("name")).agg(F.max("ts").alias("last_finish"))
    found = events.due(events.effective_every(projects, "o", "p", "d"), state, NOW)
    return found.select("name", "every", F.round("due_at", 3).alias("due_at"))


@query("""
SELECT coalesce(source, lang) AS space, sum(ceil(n_chars / 2400))::BIGINT AS points, count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS bytes, max(doc_id) AS indexed_at FROM documents GROUP BY 1
""")
def space_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as spaces: a point for every 2400 characters, a ledger row for every document."""
    docs = table(spark, sf_dir, "documents").withColumn("space", F.coalesce("source", "lang"))
    points = docs.select("space", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n_chars") / 2400))))
    seen = docs.select("space", F.col("n_chars").alias("size"), F.col("doc_id").alias("indexed_at"))
    return events.space_overview(points, seen)


@query("""
WITH e AS (SELECT o_orderkey AS k, 4 AS expected FROM orders), s AS (SELECT l_orderkey AS k, count(*) AS stored FROM lineitem GROUP BY 1)
SELECT k::VARCHAR AS path, coalesce(stored, 0)::BIGINT AS stored, expected::INT AS expected, coalesce(stored, 0) = expected AS complete FROM e LEFT JOIN s USING (k)
""")
def file_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files that expect four chunks, line items as the chunks stored."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(4).alias("expected"))
    return files.complete_files(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path")), expected)


@query("SELECT source AS name, length(source)::INT AS priority, count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS bytes, max(doc_id)::DOUBLE AS glob_ms FROM documents GROUP BY source")
def group_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_files(spark, sf_dir).select(F.col("source").alias("name"), F.length("source").alias("priority"), "path", F.col("n_chars").alias("size"), F.col("doc_id").cast("double").alias("glob_ms"))
    return events.group_timings(rows)


@query("SELECT source || '/' || lang AS key FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION SELECT lang FROM documents WHERE lang IS NOT NULL")
def keep_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus keys that any of two spaces still needs."""
    docs = table(spark, sf_dir, "documents")
    return files.kept_keys(docs.select(F.concat("source", F.lit("/"), "lang").alias("key")).where("key IS NOT NULL"), docs.select(F.col("lang").alias("key")).where("key IS NOT NULL"))


@query("SELECT doc_id, text FROM documents WHERE doc_id % 3 != 0 UNION ALL SELECT doc_id, upper(lang) FROM documents WHERE doc_id % 3 = 0")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files written anew: their points are replaced."""
    rows = doc_files(spark, sf_dir).select("doc_id", "path", "text", "lang")
    new = rows.where("doc_id % 3 = 0").withColumn("text", F.upper("lang"))
    return files.upsert(rows, new, new.select("path")).select("doc_id", "text")


@query("SELECT user_id AS point_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_watch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of writes, upserted by user in micro-batches: each user's last event stays."""
    work = f"{shared_folder(spark)}/lodestone/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("point_id"), "ts", "event_type", "event_id")
    rows.write.parquet(f"{work}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{work}/in")
    target = Table(spark, f"{work}/points", ("point_id",))

    def last(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("point_id").agg(F.max_by(F.struct("ts", "event_type", "event_id"), F.struct("ts", "event_id")).alias("r"))
        upsert_batches(target)(newest.select("point_id", "r.*"), number)

    query = stream.writeStream.option("checkpointLocation", f"{work}/state").foreachBatch(last).trigger(availableNow=True).start()
    query.awaitTermination()
    return target.read().select("point_id", "event_id", "event_type")

