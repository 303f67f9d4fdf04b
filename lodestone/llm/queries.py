"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.lm_scoring import pseudo_likelihood

    return pseudo_likelihood(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import quality_report

    return quality_report(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import packed

    return packed(documents(spark, sf_dir), tokenizer_path())


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.bpe import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_path())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.exact_dedup import exact_groups

    return exact_groups(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.licenses import license_report

    return license_report(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import near_groups

    return near_groups(documents(spark, sf_dir))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import hilbert_shards

    return hilbert_shards(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secrets import secret_report

    return secret_report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_quality_rules,
        op3_packing,
        op4_bpe_round_trip,
        op5_exact_dedup,
        op6_license_scan,
        op7_toxicity,
        op8_simhash_near_dedup,
        op9_hilbert_sharding,
        op10_secret_scan,
    )
}


def quality_sql() -> str:
    """op2 in SQL, with the module's constants."""
    from lodestone.llm import quality as q

    own, wide = f"f.n >= {q.MIN_GROUP}", f"m.n >= {q.MIN_GROUP}"
    pick = lambda c: f"CASE WHEN {own} THEN f.{c} WHEN {wide} THEN m.{c} ELSE t.{c} END"
    away = lambda r: f"{q.WIDTH} * coalesce({pick('d_' + r)}, m.d_{r}, t.d_{r})"
    fences = [f"(({pick('q50_' + r)}) {sign} {away(r)})::BIGINT AS {side}_{r}" for sign, side in (("-", "min"), ("+", "max")) for r in q.TWO_SIDED]
    fences += [f"(2 * ({pick('q99_' + r)}) - ({pick('q50_' + r)}))::BIGINT AS max_{r}" for r in q.ABOVE]

    def quantiles(by: str) -> str:
        keys = f"{by}, " if by else ""
        cut = ", ".join(f"min(bucket) FILTER (rate = '{r}' AND 100 * upto >= {k} * al) AS q{k}_{r}" for r, levels in q.LEVELS.items() for k in levels)
        spread = ", ".join(f"nullif(least(q50_{r} - q10_{r}, q90_{r} - q50_{r}), 0) AS d_{r}" for r in q.TWO_SIDED)
        return f"""(SELECT *, {spread} FROM (SELECT {keys}max(al) FILTER (rate = '{next(iter(q.RATES))}') AS n, {cut} FROM (
  SELECT *, sum(n) OVER (PARTITION BY {keys}rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}rate) AS al
  FROM (SELECT {keys}rate, bucket, sum(n) AS n FROM s GROUP BY {keys}rate, bucket)) {"GROUP BY " + by if by else ""}))"""

    rate = lambda a, b, k: f"CASE WHEN {b} > 0 THEN {k} * {a} // {b} ELSE 0 END"
    rates = ", ".join(f"{rate(*parts)} AS {r}" for r, parts in q.RATES.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} AS x FROM e" for r in q.RATES)
    out = " OR ".join([*(f"coalesce({r} > max_{r}, false)" for r in q.RATES), *(f"coalesce({r} < min_{r}, false)" for r in q.TWO_SIDED)])
    base = f"(n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words)"
    metrics = ", ".join(q.METRICS)
    count = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))::BIGINT"
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
v AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
c AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS n FROM v) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i)::BIGINT AS n FROM c GROUP BY doc_id),
b AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, {count(r"[\x20\x09-\x0D]+")} AS word_chars, {count(f"[^{q.SYMBOLS}]")} AS n_symbols,
  {count(q.PUNCTUATION.replace("[", "[^", 1))} AS n_punct, len(list_filter(w, lambda x: length(x) <= {q.SHORT_WORD}))::BIGINT AS n_short,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (doc_id)),
r AS (SELECT *, {rates} FROM b),
e AS (SELECT DISTINCT lang, source, {metrics}, {", ".join(q.RATES)} FROM r WHERE NOT {base}),
x AS ({long}),
s AS (SELECT lang, source, rate, (x >> k) << k AS bucket, count(*) AS n FROM (SELECT *, greatest(length(bin(x)) - {q.DIGITS}, 0) AS k FROM x) GROUP BY ALL),
h AS (SELECT f.lang AS k_lang, f.source AS k_source, CASE WHEN {own} THEN 'source' WHEN {wide} THEN 'lang' ELSE 'all' END AS level, {", ".join(fences)}
  FROM {quantiles("lang, source")} f LEFT JOIN {quantiles("lang")} m ON f.lang IS NOT DISTINCT FROM m.lang, {quantiles("")} t)
SELECT doc_id, {metrics}, {base} AS base_failed, NOT {base} AND NOT ({out}) AS kept, {", ".join(q.RATES)}, {", ".join(q.FENCES)}, level
FROM r LEFT JOIN h ON lang IS NOT DISTINCT FROM k_lang AND source IS NOT DISTINCT FROM k_source
"""


def license_sql() -> str:
    """op6 in SQL, over the same digests."""
    from lodestone.llm import licenses as li

    def norm(x: str) -> str:
        out = f"lower(regexp_replace({x}, '{li.COPYRIGHT}', ' ', 'g'))"
        out = f"trim(regexp_replace({out}, '{li.PUNCTUATION}', ' ', 'g'), ' ')"
        for pattern, to in li.SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
        return out

    values = ", ".join(f"('{d}', '{i}', {str(p).lower()})" for d, i, p in li.known())
    lengths = ", ".join(f"('{o}', {n})" for o, ns in li.runs().items() for n in ns)
    return rf"""
WITH k(digest, license, free) AS (VALUES {values}),
o(opening, length) AS (VALUES {lengths}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, regexp_split_to_array(t, '{li.BLANK_LINE}') AS b FROM d),
n AS (SELECT doc_id, list_filter(list_transform(b, lambda x: {norm("x")}), lambda x: x <> '') AS n FROM b),
p AS (SELECT doc_id, array_to_string(n, ' ') AS whole, unnest(n) AS p, unnest(range(1, len(n) + 1)) AS i FROM n),
s AS (SELECT *, 1 + sum(length(p) + 1) OVER w - length(p) - 1 AS start, sum(length(p) + 1) OVER w AS stop FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT a.doc_id, substr(a.whole, a.start::BIGINT, o.length) AS x FROM s a JOIN o ON substr(a.whole, a.start::BIGINT, {li.OPENING}) = o.opening
  JOIN s z ON z.doc_id = a.doc_id AND z.i > a.i AND z.stop = a.start + o.length),
u AS (SELECT doc_id, 0 AS kind, array_to_string(n, ' ') AS x FROM n UNION ALL SELECT doc_id, 1, {norm("x")} FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
  UNION ALL SELECT doc_id, 1, {norm("x")} FROM (SELECT doc_id, unnest(b) AS x FROM b) WHERE contains(trim(x, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) UNION ALL SELECT doc_id, 1, x FROM r),
h AS (SELECT doc_id, kind, license, free FROM (SELECT doc_id, kind, sha256(x) AS digest FROM u) JOIN k USING (digest)),
g AS (SELECT doc_id, max(license) FILTER (kind = 0) AS whole, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) FILTER (kind = 1) AS n, bool_or(NOT free) AS restricted FROM h GROUP BY doc_id)
SELECT doc_id, whole, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_notices, coalesce(restricted, false) AS restricted FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_sql(),
    "op6_license_scan": license_sql(),
    "op5_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM t
""",
}
