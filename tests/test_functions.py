"""Facet rules, globs, configuration, durations and other driver-side functions."""

from __future__ import annotations

import sys
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import facets as fc
from lodestone.functions import text as tx
from lodestone.functions import vectors as vc
from lodestone.operators import batches, search
from lodestone.sources import config, globs


def test_normalize_facets():
    assert fc.normalize({"lang": " en ", "team": ["a", " a", "b"]}) == {"lang": ["en"], "team": ["a", "b"]}
    for bad in (["x"], {"1a": "x"}, {"a b": "x"}, {"a": []}, {"a": [" "]}, {"a": [1]}, {"a": 3}):
        with pytest.raises(fc.FacetError):
            fc.normalize(bad)
    with pytest.raises(fc.FacetError, match="role"):
        fc.check_not_reserved({"role": ["x"]})
    fc.check_not_reserved({"path": ["x"], "language": ["y"]})
    assert fc.parse_flags(["a=1", "b=2", "a=3"]) == {"a": ["1", "3"], "b": ["2"]}
    with pytest.raises(fc.FacetError):
        fc.parse_flags(["a"])
    groups = [{"name": "g", "facets": {"k": ["b", "a"]}}, {"name": "off", "enabled": False, "facets": {"z": ["1"]}}]
    assert fc.distinct_values(groups) == {"group": ["g"], "k": ["a", "b"]}


TRUTH = [
    ({}, {}, True),
    ({"lang": ["en"]}, {}, True),
    ({"lang": ["fr", "en"]}, {}, True),
    ({"lang": ["fr"]}, {}, False),
    ({"lang": ["en"], "team": ["b"]}, {}, True),
    ({"lang": ["en"], "absent": ["x"]}, {}, False),
    ({}, {"team": ["a"]}, False),
    ({}, {"absent": ["a"]}, True),
    ({"lang": ["en"]}, {"team": ["c"]}, True),
    ({}, {"team": ["c"], "lang": ["en"]}, False),
]


@pytest.mark.parametrize(("wanted", "excluded", "want"), TRUTH)
def test_facet_filter(spark, wanted, excluded, want):
    have = {"lang": ["en"], "team": ["a", "b"]}
    assert fc.matches_literal(have, wanted, excluded) is want
    assert spark.range(1).select(fc.matches(fc.facet_map(have), wanted, excluded)).first()[0] is want


def test_globs():
    hit = lambda p, *paths: [x for x in paths if globs.matches_any(x, (p,))]
    assert hit("libs/**/src/**/*.{ts,tsx,mts}", "libs/a/src/x.ts", "libs/a/b/src/c/d.tsx", "libs/a/x.ts", "apps/a/src/x.ts") == ["libs/a/src/x.ts", "libs/a/b/src/c/d.tsx"]
    assert hit("**/*.md", "a.md", "x/y/.b.md", "a.mdx") == ["a.md", "x/y/.b.md"]
    assert hit("a/*", "a/b", "a/b/c", "a/.x") == ["a/b", "a/.x"]
    assert hit("f?o[a-c].{x,{y,z}}", "fooa.x", "fobb.z", "food.y", "f/oa.x") == ["fooa.x"]
    assert hit("[!a]+(1).ts", "b+(1).ts", "a+(1).ts") == ["b+(1).ts"]
    assert not hit("", "a")


def test_globs_are_alike_in_spark(spark):
    paths = [(p,) for p in ("a/b.ts", "a.ts", "x/y/z.tsx", "d.e/f", "{a}", "a/.hid")]
    df = spark.createDataFrame(paths, "p string")
    for pattern in ("**/*.ts", "*.{ts,tsx}", "**", "d.e/*", "{a}", "[xa]*/**", "?.ts"):
        got = {r.p for r in df.where(F.col("p").rlike(globs.to_regex(pattern))).collect()}
        assert got == {p for (p,) in paths if globs.matches_any(p, (pattern,))}, pattern


CONFIG = """{
  // spaces
  "defaultSpace": "docs", /* one
  comment */
  "spaces": {
    "docs": {"dense": {"provider": "local", "model": "BAAI/bge-small"}, "rerank": {"model": "r"}, "chunk": {"maxChars": 800}},
    "code": {"dense": {"provider": "voyage", "model": "voyage-code"}}
  },
  "groups": [
    {"name": "notes", "include": ["**/*.md"], "facets": {"url": "http://x//y"}, "priority": 50},
    {"name": "src", "include": ["src/**"], "space": "code", "priority": 40}
  ]
}"""


def test_config():
    project = config.parse(CONFIG)
    assert project.groups[0].facets == {"url": ["http://x//y"]} and project.space_named("docs").chunk.max_chars == 800
    assert project.space_named(None) is project.spaces["docs"]
    with pytest.raises(config.ConfigError, match="unknown space: zzz"):
        project.space_named("zzz")
    assert config.unknown_filter(project, ["src", "nope"]) == "unknown group: nope"
    assert config.unknown_filter(project, ["src"], ["code"]) is None
    assert config.backend_id("code", project.spaces["code"]) == "code--exact--voyage-code--d1024--bm25--c2400"
    assert config.table_name("/x/My App", "docs", project.spaces["docs"]).startswith("my-app_docs_exact_")
    for bad in ('{"defaultSpace": "a", "spaces": {}}', "{", CONFIG.replace('"src", "include"', '"notes", "include"'), CONFIG.replace('"priority": 40', '"odd": 40'), CONFIG.replace('"url"', '"role"'), CONFIG.replace("800", "5")):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_groups_command(tmp_path):
    run = lambda code, s=20: config.command_groups(tmp_path, [sys.executable, "-c", code], s)
    assert run("""print('{"groups": [{"name": "x", "include": ["*"]}]}')""")[0]["name"] == "x"
    for code, message in (("exit(3)", "failed"), ("print(1)", "no groups"), ("print('{')", "no groups"), ("""print('{"groups": 1}')""", "no list")):
        with pytest.raises(config.ConfigError, match=message):
            run(code)
    with pytest.raises(config.ConfigError, match="took over"):
        run("import time; time.sleep(9)", 0.3)
    with pytest.raises(config.ConfigError, match="not found"):
        config.command_groups(tmp_path, ["no-such-program-here"])


def test_nearest_project(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    projects = [{"name": "o", "root": str(tmp_path)}, {"name": "i", "root": str(tmp_path / "a")}]
    assert config.nearest_project(projects, str(inner))["name"] == "i"
    assert config.nearest_project(projects, "/nowhere") is None


def test_durations(spark):
    assert [tx.parse_duration(t) for t in ("5m", "90s", "2h", "45", "1.5m")] == [300, 90, 7200, 45, 90]
    bad = ("", "0", "-5m", "5d", "m", "1h30m", "soon")
    for t in bad:
        with pytest.raises(ValueError, match="duration"):
            tx.parse_duration(t)
    df = spark.createDataFrame([(t,) for t in ("5m", "45", *bad)], "t string")
    assert [r[0] for r in df.select(tx.duration_seconds(df.t)).collect()] == [300, 45, *[None] * len(bad)]


def test_text_columns(spark):
    row = spark.range(1).select(
        tx.point_id(F.lit("src/a.ts:0:10")),
        tx.embed_text(F.lit("p"), F.lit(""), F.lit("file"), F.lit(None).cast("string"), fc.facet_map({"b": ["1", "2"], "a": ["3"]}), F.lit("body")),
        tx.language(F.lit("x/Y.TSX")),
        tx.language(F.lit(".md")),
        tx.hard_excluded(F.lit("a/node_modules/b")),
        tx.masked(F.lit("abcdefghijkl")),
        tx.seconds_text(F.lit(3725.0)),
        tx.embed_strategy(F.lit("voyage-context-4"), F.lit("voyage")),
        tx.event_level(F.lit("embed_failed")),
        tx.corpus_key(F.lit("apis/acme--orders.openapi.json"), F.lit("json"), fc.facet_map({"scope": ["external"], "provider": ["acme"]})),
        fc.spec_slug(F.lit("openapi-md/acme--orders/spec.md")),
    ).first()
    assert tuple(row) == (
        str(uuid.uuid5(uuid.NAMESPACE_URL, "src/a.ts:0:10")),
        "File: p\nKind: file\nFacets: b=1|2, a=3\n\nbody",
        "tsx",
        None,
        True,
        "****ijkl",
        "1h 2m",
        "contextual",
        "error",
        "external/acme/orders/acme--orders.openapi.json",
        "orders",
    )


def test_point_ids_are_uuids(spark):
    df = spark.range(200).select(F.col("id"), tx.point_id(F.col("id").cast("string")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, str(r.id))) for r in df.collect())


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.dense for r in vc.hash_embeddings(df, ["id"], "text").collect()}
    assert set(got) == {1} and abs(sum(x * x for x in got[1]) - 1) < 1e-6
    one = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = one.select(vc.cosine(F.col("a"), F.col("b")), vc.cosine(F.col("a"), F.col("z")), vc.cosine(F.col("b"), F.col("b")), vc.quantize(F.col("b"), F.lit(1.0))).first()
    assert tuple(row) == (0.0, None, 1.0, [0, 127])


@pytest.mark.parametrize("sizes", [[], [5], [50, 1], [10, 10, 10, 1], [3] * 9])
def test_greedy_bins(spark, sizes):
    got = spark.createDataFrame([(sizes,)], "x array<long>").select(batches.greedy_bins(F.col("x"), 20, 4)).first()[0]
    want, number, total, n = [], 0, 0, 0
    for s in sizes:
        if n and (total + s > 20 or n >= 4):
            number, total, n = number + 1, 0, 0
        total, n = total + s, n + 1
        want.append(number)
    assert got == want


def test_prefetch_and_rerank(spark):
    assert [search.candidates_for(3, 5), search.candidates_for(10), search.candidates_for(50)] == [12, 80, 200]
    points = spark.createDataFrame([(f"p{i}", [1.0 - i / 10, i / 10], f"w{i} common") for i in range(5)], "point_id string, dense array<float>, text string")
    plain = search.search(points, [1.0, 0.0], limit=3).collect()
    assert [r.point_id for r in plain] == ["p0", "p1", "p2"] and not plain[0].reranked
    best = search.search(points, [1.0, 0.0], limit=3, prefetch=5, reranker=lambda found: F.substring("point_id", 2, 1).cast("double")).collect()
    assert [r.point_id for r in best] == ["p4", "p3", "p2"] and best[0].score == 4.0 and best[0].reranked
    ties = search.search(points, [1.0, 0.0], limit=3, reranker=lambda found: F.lit(None).cast("double")).collect()
    assert [r.point_id for r in ties] == ["p0", "p1", "p2"]
    words = search.search(points, [1.0, 0.0], limit=1, reranker=lambda found: search.overlap_score("w3")(found["text"])).collect()
    assert words[0].point_id == "p3"


def test_topk_plan_has_no_wide_shuffle(spark):
    points = spark.createDataFrame([("a", [1.0])], "point_id string, dense array<float>")
    plan = search.dense_topk(points, [1.0])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_event_lines_and_tokens(spark):
    rows = [
        ("file_complete", {"space": "code", "path": "a.ts", "chunks": "3"}, 999),
        ("error", {"path": "b.md", "message": "not utf-8"}, 1500),
        ("done", dict.fromkeys(("scanned", "indexed", "unchanged", "deleted", "chunks", "errors"), "1"), 2_500_000),
        ("retry", {"n": "2", "after": "5"}, None),
        ("odd", None, 0),
    ]
    df = spark.createDataFrame(rows, "event string, fields map<string,string>, n long")
    got = df.select(tx.event_line(F.col("event"), F.col("fields")), tx.tokens_text(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        ("indexed code a.ts: 3 chunks", "999"),
        ("error b.md: not utf-8", "1.5k"),
        ("done: scanned 1, indexed 1, unchanged 1, deleted 1, chunks 1, errors 1", "2.50M"),
        ("retry after=5 n=2", "-"),
        ("odd", "0"),
    ]


def test_postings_shuffle_nothing(spark):
    rows = [(1, "b a b_1, A"), (2, ""), (3, None), (4, "é"), (1, "b")]
    made = search.postings(spark.createDataFrame(rows, "id int, text string"), ["id"])
    assert sorted(tuple(r) for r in made.collect()) == [(1, 1, "b", 1), (1, 4, "a", 2), (1, 4, "b", 1), (1, 4, "b_1", 1)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.df) for r in search.document_frequency(spark.createDataFrame(rows, "id int, text string")).collect()} == {("a", 1), ("b", 2), ("b_1", 1)}
