"""Corpus documents, model providers, the registry and the scheduler."""

from __future__ import annotations

import hashlib
import json
import stat
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions.facets import facet_map
from lodestone.operators import corpus, models, search
from lodestone.sources import registry
from lodestone.streaming import schedule


def test_corpus_documents(spark):
    rows = [("docs/a.md", "markdown", "# A\n", "notes"), ("src/x.ts", "typescript", "let x;", None)]
    files = spark.createDataFrame(rows, "path string, language string, text string, grp string").withColumn("facets", facet_map({"team": ["b", 'q"x'], "lifecycle": ["next"]}))
    made = {r.path: r for r in corpus.documents(files, "shop").collect()}
    assert made["docs/a.md"].corpus_key == "internal/next/shop/docs/a.md" and made["docs/a.md"].body == "# A\n"
    assert made["src/x.ts"].corpus_key == "internal/next/shop/src/x.ts.md" and made["src/x.ts"].body == "# src/x.ts\n\n```ts\nlet x;\n```\n"
    meta = {"lifecycle": ["next"], "team": ["b", 'q"x']}
    assert made["src/x.ts"].sidecar == json.dumps({"metadataAttributes": meta}, indent=2) + "\n"
    full = {"group": ["notes"], **meta}
    assert made["docs/a.md"].sidecar == json.dumps({"metadataAttributes": full}, indent=2) + "\n"
    assert made["docs/a.md"].content_sha256 == hashlib.sha256(b"# A\n").hexdigest()
    stored = corpus.documents(files, "shop")
    assert corpus.to_write(stored, stored).count() == 0
    assert corpus.to_write(stored, stored.limit(0)).count() == 2
    keep = stored.where("path = 'docs/a.md'")
    assert [r.corpus_key for r in corpus.to_prune(stored, keep).collect()] == ["internal/next/shop/src/x.ts.md"]
    assert corpus.merged(stored, stored.limit(1), keep).count() == 1


def test_patience_and_halving():
    waits, seen = [], []

    def call(texts):
        seen.append(len(texts))
        if len(seen) < 3:
            raise models.Busy(seconds=7 if len(seen) == 1 else None)
        if len(texts) > 2:
            raise models.TooLong
        return [t.upper() for t in texts]

    assert models.split_calls(call, ["a", "b", "c", "d", "e"], sleep=waits.append) == list("ABCDE")
    assert waits[0] == 7 and len(waits) == 2
    with pytest.raises(models.Busy):
        models.patient(lambda: (_ for _ in ()).throw(models.Busy()), attempts=3, sleep=lambda s: None)
    assert [len(b) for b in models.text_batches(["x" * 30, "y" * 90, "z"] + ["w"] * 5, 100, 4)] == [1, 4, 3]
    assert models.by_index([{"index": 2, "relevance_score": 0.5}, {"index": 0, "relevance_score": 0.9}, {"index": 7}], 4) == [0.9, 0.0, 0.5, 0.0]


class Lengths:
    def embed(self, texts, query=False):
        return [[float(len(t)), 1.0] for t in texts]


def test_embedders_and_rerankers(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", "y" * 50_000)], "point_id string, embed_text string")
    assert {r.point_id: r.dense for r in models.embedder(Lengths)(rows).collect()} == {"a": [2.0, 1.0], "b": [50_000.0, 1.0]}
    chunks = spark.createDataFrame([("p", 1, "b", "2"), ("p", 0, "aa", "1"), ("q", 0, "c", "3")], "path string, ordinal int, text string, point_id string")
    ordered = models.contextual(chunks, lambda texts: [[float(i), float(len("".join(texts)))] for i in range(len(texts))])
    assert {r.point_id: r.dense for r in ordered.collect()} == {"1": [0.0, 3.0], "2": [1.0, 3.0], "3": [0.0, 1.0]}
    points = spark.createDataFrame([(f"p{i}", [1.0, i / 9], "x" * i) for i in range(5)], "point_id string, dense array<float>, text string")
    longest = models.reranker(lambda: lambda q, texts: [float(len(t)) for t in texts], "q")
    assert [r.point_id for r in search.search(points, [1.0, 0.0], limit=2, reranker=longest).collect()] == ["p4", "p3"]


def test_registry(spark, tmp_path):
    projects = registry.Projects(tmp_path / "projects.json")
    (tmp_path / "x" / "App").mkdir(parents=True)
    (tmp_path / "y" / "app").mkdir(parents=True)
    assert [projects.add(str(tmp_path / p))["name"] for p in ("x/App", "y/app", "x/App")] == ["app", "app-2", "app"]
    projects.set_every("app", "5m")
    with pytest.raises(ValueError, match="duration"):
        projects.set_every("app", "often")
    assert projects.find(str(tmp_path / "y" / "app"))["name"] == "app-2"
    with pytest.raises(registry.RegistryError, match="known: app, app-2"):
        projects.find("zzz")
    assert projects.frame(spark).count() == 2
    (tmp_path / "y" / "app").rmdir()
    assert [p["name"] for p in projects.living()] == ["app"] and projects.remove("app")["every"] == "5m"
    (tmp_path / "projects.json").write_text("{")
    with pytest.raises(registry.RegistryError):
        projects.all()


def test_settings(tmp_path):
    settings = registry.Settings(tmp_path / "s.json", {"every": ("EVERY", "1h", registry.parse_duration), "key": (None, None, None)})
    assert settings.get("every", {}) == ("1h", "default")
    settings.put("every", "5m")
    settings.put("key", "secret")
    assert settings.get("every", {}) == ("5m", "file") and settings.get("every", {"EVERY": "9s"}) == ("9s", "environment")
    assert stat.S_IMODE((tmp_path / "s.json").stat().st_mode) == 0o600
    settings.drop("every")
    assert settings.get("every", {})[1] == "default"
    for bad in (lambda: settings.put("every", "x"), lambda: settings.get("nope")):
        with pytest.raises(ValueError):
            bad()
    assert [registry.resolve_every(*x) for x in (("off", "5m", "1h"), (None, "5m", "1h"), ("", "", "1h"), (None, None, None))] == [(None, "override"), (300.0, "project"), (3600.0, "global"), (None, "none")]


def test_schedule(spark):
    now = datetime(2024, 5, 1, 12)
    state = {"a": {"last_finish": datetime(2024, 5, 1, 11)}, "b": {"last_finish": datetime(2024, 5, 1, 9)}, "c": {"last_finish": datetime(2024, 5, 1, 11, 59)}}

    def run(name):
        if name == "b":
            raise schedule.BusyIndex("held")
        if name == "a":
            raise ValueError("bad")

    done = schedule.run_due([("a", 1800), ("b", 60), ("c", 3600), ("d", 5), ("off", None)], state, run, now)
    assert done == ["d", "b", "a"]
    assert {n: s.get("result") for n, s in state.items()} == {"a": "error", "b": "busy", "c": None, "d": "ok"}
    assert state["b"]["last_finish"] == datetime(2024, 5, 1, 9) and state["a"]["last_finish"] == now
    assert {r.name for r in schedule.failures(schedule.state_frame(spark, state)).collect()} == {"a", "b"}


def test_queries_are_encoded_as_queries():
    class Both:
        def embed(self, texts, query=False):
            return [[float(query), float(len(t))] for t in texts]

    assert models.query_vector(Both(), "abc") == [1.0, 3.0]


def test_a_reranker_is_made_once_per_task(spark, tmp_path):
    marks = str(tmp_path)

    def make():
        import uuid
        from pathlib import Path

        (Path(marks) / uuid.uuid4().hex).touch()
        return lambda query, texts: [float(len(t)) for t in texts]

    rows = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(2000)], "id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = rows.select("id", models.reranker(make, "q")(rows).alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(r.s == r.id % 7 for r in got) and len(list(tmp_path.iterdir())) == 1


def test_merged_runs_errors_and_snapshots(spark):
    from lodestone.operators import events

    runs = spark.createDataFrame([("a", 1, False, ["x", "y"]), ("a", 2, True, []), ("b", 5, False, None)], "kind string, files long, stopped boolean, errors array<string>")
    whole = events.merged_stats(runs, ["files"]).first()
    assert (whole.files, whole.stopped, whole.n_errors) == (8, True, 2)
    assert {(r.kind, r.files) for r in events.merged_stats(runs, ["files"], ["kind"]).collect()} == {("a", 3), ("b", 5)}
    assert sorted((r.kind, r.error) for r in events.run_errors(runs, ["kind"]).collect()) == [("a", "x"), ("a", "y")]
    windows = spark.createDataFrame([("k", 1, 5), ("k", 3, 9)], "key string, requests long, weight long")
    assert tuple(events.rate_snapshot(windows, ["key"]).first()) == ("k", 2, 3, 9)


def test_clip_scale(spark):
    import numpy as np

    from lodestone.functions.vectors import clip_scale

    rnd = np.random.default_rng(1)
    xs = rnd.normal(0, 0.1, (300, 16))
    got = clip_scale(spark.createDataFrame([(x.tolist(),) for x in xs], "v array<double>"), "v")
    exact = np.quantile(np.abs(xs), 0.99, method="inverted_cdf")
    assert exact <= got <= exact + 1e-4


def test_cool_down_is_shared():
    now, waits = [100.0], []

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    cool = models.CoolDown(lambda: now[0])
    answers = [models.failure(429, "slow down", "7"), models.failure(503), "fine"]

    def call():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert models.patient(call, sleep=sleep, cool=cool) == "fine"
    assert waits[0] == 7 and 0 < waits[1] <= 1
    cool.begin(None)
    cool.begin(None)
    answers.append("again")
    assert models.patient(call, sleep=sleep, cool=cool) == "again" and waits[2] == 2 and cool.pause == 1


def test_failures_by_status():
    assert isinstance(models.failure(400, "Too many tokens in batch"), models.TooLong)
    assert isinstance(models.failure(401, "no key"), models.Refused)
    busy = models.failure(502, "", "soon")
    assert isinstance(busy, models.Busy) and busy.seconds is None and not busy.limited


def test_corpus_files(spark, tmp_path):
    rows = [("internal/a/x.md", "one é", "{}\n"), ("internal/b/y.md", "two", "{}\n"), ("internal/b/z.md", "", "{}\n")]
    made = spark.createDataFrame(rows, "corpus_key string, body string, sidecar string")
    wrote = lambda df: sorted(tuple(r) for r in corpus.export(df, str(tmp_path)).collect())
    assert wrote(made) == [(k, True, True) for k, *_ in rows]
    assert (tmp_path / "internal/a/x.md").read_text() == "one é" and (tmp_path / f"internal/b/z.md{corpus.SIDECAR}").read_text() == "{}\n"
    changed = made.withColumn("body", F.when(F.col("body") == "two", "2").otherwise(F.col("body")))
    assert wrote(changed) == [("internal/a/x.md", False, False), ("internal/b/y.md", True, False), ("internal/b/z.md", False, False)]
    gone = corpus.prune_files(made.where("body = 'one é'"), str(tmp_path)).collect()
    assert sorted(r.path for r in gone) == sorted(f"internal/b/{n}.md{e}" for n in "yz" for e in ("", corpus.SIDECAR))
    assert not (tmp_path / "internal/b").exists() and (tmp_path / "internal/a/x.md").exists()
    assert corpus.prune_files(made, str(tmp_path)).count() == 0
