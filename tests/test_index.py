"""Files to a stored index and back: sources, ledgers, tables, search and the watching stream."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lodestone.plans import query
from lodestone.plans.index import Index, claimed_files
from lodestone.sources.config import ConfigError, parse
from lodestone.sources.files import FileTree, listing
from lodestone.sources.tables import Table, TableError
from lodestone.streaming.watch import changes, upsert_batches, watch

PROJECT = """{"defaultSpace": "docs", "spaces": {
  "docs": {"dense": {"model": "hash"}, "rerank": {"model": "words"}},
  "code": {"dense": {"model": "hash"}}},
 "groups": [
  {"name": "notes", "include": ["**/*.md"], "facets": {"team": ["core"]}},
  {"name": "low", "include": ["**/*"], "priority": -1, "space": "code"},
  {"name": "src", "include": ["src/**"], "space": "code", "priority": 5, "facets": {"part": ["lib"]}}]}"""


@pytest.fixture
def root(tmp_path):
    files = {"a.md": "# Alpha\n\nhow to index a folder of files quickly", ".hidden/b.md": "# Beta\n\nsearching by keywords and by vectors", "src/x.ts": "export function alpha() { return 1; }\n", "src/y.py": "def beta():\n    return 2\n", "node_modules/z.md": "# no", "bin.dat": "?"}
    for name, text in files.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "root" / "bad.md").write_bytes(b"\xff\xfe\x00")
    return tmp_path / "root"


def test_file_source(spark, root):
    assert [p for p, *_ in listing(str(root))] == [".hidden/b.md", "a.md", "bad.md", "bin.dat", "src/x.ts", "src/y.py"]
    spark.dataSource.register(FileTree)
    got = {r.path: r for r in spark.read.format("file_tree").option("path", str(root)).option("maxBytes", "45").load().collect()}
    assert got["bad.md"].error == "not utf-8" and got["a.md"].error == "too large" and got["src/x.ts"].text.startswith("export")
    empty = root / "none"
    empty.mkdir()
    assert spark.read.format("file_tree").option("path", str(empty)).load().count() == 0


def test_claims(spark, root):
    got = {(r.space, r.path): (r.name, r.language) for r in claimed_files(spark, str(root), parse(PROJECT)).collect()}
    assert got[("docs", "a.md")] == ("notes", "markdown") and got[("code", "a.md")] == ("low", "markdown")
    assert got[("code", "src/x.ts")] == ("src", "typescript") and ("code", "bin.dat") not in got


def test_index_runs(spark, root, tmp_path):
    project, index = parse(PROJECT), Index(spark, str(tmp_path / "store"))
    first = index.run(str(root), project)
    assert first.counts == {"new": 6, "error": 2} and first.rebuilt and first.errors == [("bad.md", "not utf-8")]
    (root / "bad.md").unlink()
    stored = sorted(os.listdir(tmp_path / "store" / "points"))
    assert index.run(str(root), project).counts == {"skip_stat": 6}
    assert sorted(os.listdir(tmp_path / "store" / "points")) == stored
    os.utime(root / "a.md", ns=(1, 1))
    assert index.run(str(root), project).counts == {"skip_stat": 4, "skip_hash": 2}
    assert index.run(str(root), project).counts == {"skip_stat": 6}
    (root / "src" / "x.ts").write_text("export function gamma() { return 3; }\n")
    (root / "src" / "y.py").unlink()
    before = {r.point_id for r in index.points.read().where("path = 'a.md'").collect()}
    assert index.run(str(root), project).counts == {"skip_stat": 4, "changed": 1, "deleted": 1}
    points = index.points.read()
    assert {r.symbol for r in points.where("path LIKE 'src/%'").collect()} == {"gamma"}
    assert {r.point_id for r in points.where("path = 'a.md'").collect()} == before
    assert points.count() == points.select("point_id").distinct().count()
    (root / "a.md").unlink()
    wanted = spark.createDataFrame([("src/x.ts",)], "path string")
    assert index.run(str(root), project, wanted=wanted).counts == {"skip_stat": 1}
    assert index.points.read().where("path = 'a.md'").count() > 0
    assert index.run(str(root), project, force=True).counts == {"changed": 3, "deleted": 2}
    assert index.reset()["ledger"] == 3 and index.points.read() is None
    assert index.run(str(root), project).counts == {"new": 3}


def test_files_that_fail_keep_their_points(spark, root, tmp_path):
    """A file that becomes unreadable or too large is reported; what is stored of it stays, and others go on."""
    project, index = parse(PROJECT), Index(spark, str(tmp_path / "store"))
    (root / "bad.md").unlink()
    index.run(str(root), project)
    before = index.points.read().count()
    (root / "a.md").write_bytes(b"\xff\xfe\x00")
    (root / ".hidden" / "b.md").write_text("# Beta\n" + "long line of words\n" * 460_000)
    (root / "src" / "x.ts").write_text("export function gamma() { return 3; }\n")
    report = index.run(str(root), project)
    assert report.counts == {"error": 2, "skip_large": 2, "changed": 1, "skip_stat": 1}
    assert report.errors == [("a.md", "not utf-8")]
    assert index.points.read().count() == before
    assert index.points.read().where("path IN ('a.md', '.hidden/b.md')").count() > 0
    (root / "a.md").write_text("# Alpha again\n\nreadable once more, with enough words to keep")
    assert index.run(str(root), project).counts["changed"] == 2


def test_all_files_gone(spark, root, tmp_path):
    project, index = parse(PROJECT), Index(spark, str(tmp_path / "store"))
    (root / "bad.md").unlink()
    index.run(str(root), project)
    for f in list(root.rglob("*")):
        if f.is_file():
            f.unlink()
    assert index.run(str(root), project).counts == {"deleted": 6}
    assert index.points.read().count() == 0 and index.ledger.read().count() == 0
    assert index.run(str(root), project).counts == {}


def test_a_part_is_written_alone(spark, root, tmp_path):
    project, index = parse(PROJECT), Index(spark, str(tmp_path / "store"))
    index.run(str(root), project)
    parts = lambda: index.points._current()["parts"]
    before = parts()
    (root / "src" / "x.ts").write_text("export function gamma() { return 3; }\n")
    index.run(str(root), project)
    assert sum(before.get(p) != f for p, f in parts().items()) == 1


def test_large_openapi_files_are_read(spark, tmp_path):
    from lodestone.plans.index import read_claimed

    root = tmp_path / "specs"
    root.mkdir()
    (root / "v--big.openapi.json").write_text('{"openapi": "3.1.0", "info": {"title": "Big", "version": "1", "description": "' + "x" * 8_100_000 + '"}, "paths": {"/a": {"get": {"summary": "Reads."}}}}')
    project = parse('{"defaultSpace": "s", "spaces": {"s": {"dense": {"model": "hash"}}}, "groups": [{"name": "api", "include": ["**/*.json"], "kind": "openapi"}]}')
    files = claimed_files(spark, str(root), project)
    assert [r.error for r in read_claimed(files, str(root)).collect()] == [None]
    assert Index(spark, str(tmp_path / "store")).run(str(root), project).counts == {"new": 1}


def test_lookups(spark, root, tmp_path):
    from lodestone.operators.files import changed_paths, lookup
    from lodestone.plans.index import chunks_of_path, claimed_file

    project = parse(PROJECT)
    claimed = claimed_files(spark, str(root), project)
    wanted = spark.createDataFrame([("a.md",), ("src/x.ts",), ("none.md",)], "path string")
    assert [(r.path, r.priority) for r in lookup(claimed, wanted, "code").collect()] == [("src/x.ts", 5), ("a.md", -1)]
    one = {(r.space, r.name) for r in claimed_file(spark, str(root), project, "a.md").collect()}
    assert one == {(r.space, r.name) for r in claimed.where("path = 'a.md'").collect()}
    assert claimed_file(spark, str(root), project, "none.md").count() == 0
    assert {r.symbol for r in chunks_of_path(spark, str(root), project, "src/x.ts").collect()} == {"alpha"}
    index = Index(spark, str(tmp_path / "store"))
    (root / "bad.md").unlink()
    index.run(str(root), project)
    assert changed_paths(claimed_files(spark, str(root), project), index.ledger.read()).count() == 0
    (root / "a.md").unlink()
    (root / "src" / "y.py").write_text("def delta():\n    return 4\n")
    assert {r.path for r in changed_paths(claimed_files(spark, str(root), project), index.ledger.read()).collect()} == {"a.md", "src/y.py"}


def test_changed_paths_of_large_files(spark):
    """A file above the cap is handed on for another time than the ledger's only, whatever its size; OpenAPI files have no cap."""
    from lodestone.operators.files import changed_paths

    schema = "space string, path string, size long, mtime_ns long, language string"
    now = [("new", 99, 1, "markdown"), ("touched", 99, 2, "markdown"), ("resized", 99, 1, "markdown"), ("same", 99, 1, None), ("spec", 99, 1, "openapi"), ("edge", 10, 1, "markdown"), ("unknown", None, 1, "markdown"), ("zero", 99, 0, "markdown"), ("zero_new", 99, 0, "markdown")]
    seen = [("touched", 99, 1), ("resized", 50, 1), ("same", 99, 1), ("unknown", None, 1), ("zero", 99, 0), ("gone", 99, 1)]
    claimed = spark.createDataFrame([(s, *r) for r in now for s in ("a", "b")], schema)
    ledger = spark.createDataFrame([("a", *r, None) for r in seen] + [("b", *r, None) for r in seen if r[0] != "touched"], schema).drop("language")
    assert sorted(r.path for r in changed_paths(claimed, ledger, max_bytes=10).collect()) == ["edge", "gone", "spec", "touched", "unknown", "zero"]
    assert {r.path for r in changed_paths(claimed, ledger).collect()} == {p for p, *_ in now if p != "same"} | {"gone"}


def test_event_log(spark, tmp_path):
    from lodestone.operators.events import append_log

    rows = spark.createDataFrame([("2024-01-01T00:00:00Z", "info", "begin", {"event": "run"})], "timestamp string, level string, message string, meta map<string,string>")
    for run in ("a", "b", "b"):
        append_log(rows, str(tmp_path / "log"), run)
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["a", "b"]


def test_query_plans(spark, root, tmp_path):
    project, index = parse(PROJECT), Index(spark, str(tmp_path / "store"))
    index.run(str(root), project)
    points = index.points.read()
    vector = list(points.where("path = 'a.md' AND space = 'docs'").first().dense)
    hits = query.search(points, project, "index folder", vector).collect()
    assert hits[0].path == "a.md" and hits[0].reranked and {h.space for h in hits} == {"docs"}
    words = query.search(points, project, "keywords", sparse=True, facets={"team": ["core"]}).collect()
    assert [h.path for h in words] == [".hidden/b.md"]
    assert query.search(points, project, "x", vector, exclude={"group": ["notes"]}).count() == 0
    with pytest.raises(query.QueryError, match="unknown facet key: nope"):
        query.search(points, project, "x", vector, facets={"nope": ["1"]})
    with pytest.raises(ConfigError, match="unknown space"):
        query.search(points, project, "x", vector, space="zzz")
    listed = {r.key: r for r in query.facets(points, project).collect()}
    assert listed["team"].values == ["core"] and listed["group"].points == 2
    assert [tuple(r) for r in query.facets(points, project, "code", "part").collect()] == [("lib", 2)]


def test_search_over_projects(spark, root, tmp_path):
    project = parse(PROJECT)
    one, two, broken = (Index(spark, str(tmp_path / n)) for n in ("one", "two", "broken"))
    one.run(str(root), project)
    broken.run(str(root), project)
    (tmp_path / "broken" / "points" / "CURRENT").write_text("junk")
    for f in (tmp_path / "broken" / "points").glob(".CURRENT.crc"):
        f.unlink()
    known = {"one": (one, project), "two": (two, project), "broken": (broken, project), "again": (one, project)}
    vector = list(one.points.read().where("path = 'a.md' AND space = 'docs'").first().dense)
    answer = query.search_projects(known, ["one", "two", "broken", "again"], "index folder", vector, limit=3)
    hits = answer.hits.collect()
    assert [h.project for h in hits[:2]] == ["again", "one"] and hits[0].path == "a.md" and len(hits) == 3 and answer.hint is None
    assert answer.failed["two"] == "not indexed yet" and "pointer" in answer.failed["broken"]
    none = query.search_projects(known, ["one"], "zzzzqq", sparse=True)
    assert none.hint == query.NO_HITS and none.hits.count() == 0
    assert query.search_projects(known, ["two"], "x", vector).hits is None
    with pytest.raises(query.QueryError, match="unknown project: nope; known: again, broken, one, two"):
        query.search_projects(known, ["nope"], "x", vector)
    listed = {r.key: r.meaning for r in query.facets(one.points.read(), project, meanings={"team": "Who owns it", "gone": "-"}).collect()}
    assert listed["team"] == "Who owns it" and listed["group"] is None and "gone" not in listed


def test_selection_and_dimensions(spark, root, tmp_path):
    from lodestone.sources.config import selected

    project = parse(PROJECT)
    claimed = claimed_files(spark, str(root), project)
    assert {r.path for r in selected(claimed, project, ["src"]).collect()} == {"src/x.ts", "src/y.py"}
    assert {r.space for r in selected(claimed, project, spaces=["docs"]).collect()} == {"docs"}
    assert selected(claimed, project, ["src"], ["docs"]).count() == 0
    with pytest.raises(ConfigError, match="unknown group: nope"):
        selected(claimed, project, ["src", "nope"])
    other = parse(PROJECT.replace('{"model": "hash"}}}', '{"model": "hash"}, "dimensions": 32}}'))
    with pytest.raises(Exception, match="other than 32 numbers"):
        Index(spark, str(tmp_path / "store")).run(str(root), other)


def test_tables(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.replace(spark.range(3))
    t.replace(t.read().where("id > 0").union(spark.range(9, 10)))
    assert sorted(r.id for r in t.read().collect()) == [1, 2, 9]
    # A reader of the version before goes on; older versions are gone.
    opened = t.read()
    t.replace(spark.range(5))
    assert opened.count() == 3 and t.read().count() == 5
    assert len([p for p in os.listdir(tmp_path / "t") if p.startswith("v-")]) == 2
    t.replace(spark.range(0))
    assert t.read().columns == ["id"] and t.read().count() == 0
    (tmp_path / "t" / "CURRENT").write_text("junk")
    for f in (tmp_path / "t").glob(".CURRENT.crc"):
        f.unlink()
    with pytest.raises(TableError):
        t.read()
    assert t.drop()


def test_watch(spark, root, tmp_path):
    seen: list[set[str]] = []
    state = str(tmp_path / "state")

    def batch(df, number):
        seen.append({r.path for r in df.collect()})

    for _ in range(2):
        watch(changes(spark, str(root)), state, batch).awaitTermination()
    assert seen[0] == {".hidden/b.md", "a.md", "bad.md", "bin.dat", "src/x.ts", "src/y.py"}
    assert not set().union(*seen[1:])
    (root / "a.md").write_text("# Changed\n")
    watch(changes(spark, str(root)), state, batch).awaitTermination()
    assert seen[-1] == {"a.md"}


def test_watch_sees_copies_with_old_times(spark, root, tmp_path):
    from lodestone.sources.config import groups_table

    seen: list[set[str]] = []
    state = str(tmp_path / "state")
    groups = groups_table(spark, parse(PROJECT)).where("name = 'notes'")
    run = lambda: watch(changes(spark, str(root), groups=groups), state, lambda df, n: seen.append({r.path for r in df.collect()})).awaitTermination()
    run()
    assert seen == [{".hidden/b.md", "a.md", "bad.md"}]
    (root / "old.md").write_text("# Old\n")
    os.utime(root / "old.md", ns=(1, 1))
    (root / "also.txt").write_text("claimed by no group of these")
    run()
    assert seen[-1] == {"old.md"}


@pytest.mark.parametrize("by", [(), ("point_id",)])
def test_upsert_batches_are_idempotent(spark, tmp_path, by):
    apply = upsert_batches(Table(spark, str(tmp_path / "u"), by))
    one = spark.createDataFrame([("a", 1), ("b", 1)], "point_id string, v int")
    two = spark.createDataFrame([("b", 2)], "point_id string, v int")
    for df, n in ((one, 0), (two, 1), (two, 1)):
        apply(df, n)
    got = Table(spark, str(tmp_path / "u")).read()
    assert {r.point_id: r.v for r in got.collect()} == {"a": 1, "b": 2}


def test_min_chars_window_equals_the_chunker_rule(spark):
    from lodestone.operators.chunk import min_chars_filter

    rows = [("a", "x" * 50), ("a", "y"), ("b", "z"), ("b", " "), ("b", "w")]
    got = min_chars_filter(spark.createDataFrame(rows, "path string, text string"), 40)
    assert sorted((r.path, r.text[0]) for r in got.collect()) == [("a", "x"), ("b", "w"), ("b", "z")]


def test_facet_report_points(spark):
    from lodestone.operators.facet_counts import facets_report

    declared = spark.createDataFrame([("s", "k", "a"), ("s", "k", "b"), ("s", "q", "z")], "space string, key string, value string")
    stored = spark.createDataFrame([("s", "k", "a", 4), ("s", "k", "c", 2)], "space string, key string, value string, points long")
    got = {(r.key, r.value): (r.points, r.source) for r in facets_report(declared, stored).collect()}
    assert got == {("k", "a"): (4, "both"), ("k", "b"): (0, "declared"), ("k", "c"): (2, "stored"), ("q", "z"): (None, "declared")}
    wide = facets_report(declared, stored, 2).where(F.col("key") == "k").collect()
    assert [(r.value, r.points, r.distinct_values) for r in wide] == [(None, 6, 3)]
