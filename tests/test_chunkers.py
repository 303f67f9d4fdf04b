"""Chunkers on hand-written files, and line windows against brute force."""

from __future__ import annotations

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import openapi
from lodestone.operators.chunk import chunk_files, pieces_of
from lodestone.operators.chunk_text import chunk_lines, chunk_markdown, halves, split_text


def windows_by_hand(text, limit, overlap=200):
    if len(text) <= limit:
        return [text]
    parts, held = [], []
    for line in text.splitlines(keepends=True):
        if held and sum(map(len, held)) + len(line) > limit:
            parts.append("".join(held))
            keep = next((k for k in range(len(held), -1, -1) if k == 0 or sum(map(len, held[len(held) - k :])) <= overlap), 0)
            held = held[len(held) - keep :] if keep else []
        held.append(line)
    return parts + ["".join(held)] * bool(held)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é\x1c", max_size=90), max_size=60), st.integers(20, 400))
def test_split_text(lines, limit):
    text = "\n".join(lines)
    parts = split_text(text, limit)
    assert [p for _, p in parts] == windows_by_hand(text, limit)
    assert all(text[at : at + len(p)] == p for at, p in parts)
    covered = 0
    for at, p in parts:
        assert at <= covered
        covered = max(covered, at + len(p))
    assert covered == len(text)


def test_line_offsets():
    text = "é line\n" * 900
    for p in chunk_lines(text, 800):
        assert text.encode()[p.start_byte : p.end_byte].decode() == p.text
        assert text.splitlines(keepends=True)[p.start_line - 1] == p.text.splitlines(keepends=True)[0]


def test_markdown_headings():
    text = "intro\n\n# A\n\nbody a\n\n## B\n\nbody b\n\n## C\n\nbody c\n"
    made = pieces_of("a.md", "markdown", text, 4000, 5)
    assert [(p.kind, p.heading_path, p.symbol) for p in made] == [("prose", None, None), ("heading", "A", "A"), ("heading", "A > B", "B"), ("heading", "A > C", "C")]
    for p in made:
        assert text.encode()[p.start_byte : p.end_byte].decode() == p.text


def test_fences_hide_headings_and_rules():
    text = "# Only\n\n```md\n# no\n---\n~~~\n```\n\n    # code\n\n~~~~\n## no\n~~~\n~~~~\nend\n"
    assert len(pieces_of("a.md", "markdown", text, 4000, 1)) == 1
    assert len(chunk_markdown("``` `x`\n# yes\n", 4000)) == 2


def test_rules_split_and_are_dropped():
    rule = "-" * 72
    made = pieces_of("a.md", "markdown", f"first part\n\n  {rule}\n\nsecond part\n\n* * *\nthird\n___\n", 4000, 1)
    assert [p.text.strip() for p in made] == ["first part", "second part", "third"]


CHAT = "# Talk\n\n---\n<details><summary>2024-05-06T07:08:09Z - user: How do  I\npack?</summary>\n\nHow do I pack {0}?\n\n</details>\n---\n<details><summary>2024-05-06T07:09:09Z - agent: Like this</summary>\n\n{1}\n</details>\n"


def test_transcript():
    made = [p for p in pieces_of("t.md", "markdown", CHAT.format("boxes", "Use bins."), 4000, 1) if p.kind == "turn"]
    assert [p.facets["role"] for p in made] == [["user"], ["agent"]]
    assert made[0].facets["day"] == ["2024-05-06"] and made[0].symbol == "How do I pack?"
    assert made[1].heading_path == "Talk > 2024-05-06T07:09:09Z - agent: Like this"
    assert "How do I pack boxes?" in made[1].text and "Use bins." in made[1].text


def test_long_turn_repeats_its_context():
    made = [p for p in pieces_of("t.md", "markdown", CHAT.format("boxes", "\n".join(f"step {i}" for i in range(500))), 800, 1) if p.facets.get("role") == ["agent"]]
    assert len(made) > 2 and made[0].text.startswith("<details><summary>2024-05-06T07:08:09Z")
    assert all("Like this" in p.text for p in made) and "User: How do I pack?" in made[1].text


TS = """import { a } from "./a";

/** The limit. */
export const LIMIT = 3;

/**
 * A store; it has a "}" in a comment.
 */
export class Store {
  /** items */
  items: string[] = [];
  add(x: string) { const s = `}${x}`; return this.items.push(s); }
}

export async function load(name: string): Promise<string> {
  return "{" + name;
}

type Row = { a: number };
"""


def test_typescript():
    made = pieces_of("s.ts", "typescript", TS, 8000, 1)
    by = {p.symbol: p for p in made if p.symbol}
    assert set(by) == {"LIMIT", "Store", "load", "Row"}
    assert by["LIMIT"].text.startswith("/** The limit. */") and by["Store"].text.startswith("/**\n * A store")
    assert by["load"].kind == "export" and by["load"].text.endswith("}") and by["Row"].kind == "type"
    for p in made:
        assert TS.encode()[p.start_byte : p.end_byte].decode() == p.text


ODD_TS = r"""const brace = /[/}]{2}\/\{/g;

export function half(a: number, b: number) { return a / 2 / b; }

function strip(s: string) {
  return s.replace(/\/\*.*"/, "").split(`}${[1].map((x) => `{${x / 2}}` + "}").join("`")}`);
}

const arrow = (s: string) => /`{/.test(s);

export class Last { m() { return typeof /'/; } }
"""


def test_patterns_and_nested_templates():
    made = pieces_of("o.ts", "typescript", ODD_TS, 8000, 1)
    assert [(p.kind, p.symbol) for p in made] == [("binding", "brace"), ("export", "half"), ("function", "strip"), ("binding", "arrow"), ("export", "Last")]
    assert made[2].text.endswith("}") and made[4].text.startswith("export class Last")


def test_unclosed_template_ends_with_the_text():
    assert [p.text for p in pieces_of("o.ts", "typescript", "const a = `x ${ {\nfunction b() {}\n", 8000, 1)] == ["const a = `x ${ {\nfunction b() {}"]


def test_long_files_in_linear_time():
    begun = time.perf_counter()
    text = "".join(f"// é {i}\nfunction f{i}() {{ return `${{{i}}}`; }}\n" for i in range(20_000))
    made = pieces_of("l.ts", "typescript", text, 400, 1)
    assert len(made) == 20_000 and made[-1].end_byte == len(text.encode()) - 1 and made[-1].start_line == 39_999
    assert len(chunk_lines(text * 10, 400)) > 10_000 and time.perf_counter() - begun < 30


def test_openapi_examples():
    body = {"schema": {"properties": {"n": {"type": "integer"}}}, "examples": {"one": {"description": "The first", "value": {"n": 1}}}}
    text = openapi.render(json.dumps({"paths": {"/a": {"post": {"requestBody": {"content": {"application/json": body}}}}}}))
    assert "### Request Body\n\n| Field" in text and "Examples\n\nThe first\n\n```json\n{\n  \"n\": 1\n}\n```" in text


def test_long_class_is_cut_by_members():
    body = "\n".join(f"  method{i}() {{ return {i}; }}" for i in range(60))
    made = pieces_of("b.ts", "typescript", f"class Big {{\n{body}\n}}\n", 400, 1)
    assert {"method0", "method59"} <= {p.symbol for p in made} and all(len(p.text.encode()) <= 400 for p in made)


def test_python_and_broken_python():
    text = "import os\n\n# about f\n@wraps\ndef f():\n    return 'é'\n\n\nclass A:\n    def m(self):\n        pass\n"
    made = pieces_of("a.py", "python", text, 4000, 1)
    assert [(p.kind, p.symbol) for p in made] == [("block", None), ("definition", "f"), ("class", "A")]
    assert made[1].text.startswith("# about f\n@wraps")
    assert [p.kind for p in pieces_of("a.py", "python", "def (:\n", 4000, 1)] == ["file"]


def test_vue():
    made = pieces_of("a.vue", "vue", "<template>\n<p/>\n</template>\n<script>\nexport default {};\n</script>\n", 4000, 1)
    assert [p.kind for p in made] == ["template_element", "script_element"]


def test_json():
    data = {"name": "pkg", "version": "1.2.0", "dependencies": {"left": "^1"}, "scripts": {"test": "run"}}
    made = pieces_of("x/package.json", "json", json.dumps(data), 4000, 1)
    assert made[0].kind == "package-json" and made[0].symbol == "pkg"
    assert all(s in made[0].text for s in ("`left`: ^1", "## Scripts", "Version: 1.2.0"))
    nx = pieces_of("x/project.json", "json", json.dumps({"name": "p", "tags": ["a", "b"], "targets": {"build": {"executor": "e"}}}), 4000, 1)
    assert nx[0].kind == "nx-project" and "Tags: a, b" in nx[0].text and "- `build` (`e`)" in nx[0].text
    assert pieces_of("x/d.json", "json", "[1, 2]", 4000, 1)[0].text == "# `x/d.json`\n\n```json\n[\n  1,\n  2\n]\n```\n"
    assert pieces_of("x/d.json", "json", "{nope", 4000, 1)[0].kind == "json"
    assert len(pieces_of("x/d.json", "json", json.dumps(list(range(2000))), 800, 1)) > 1


def test_short_chunks_stay_if_alone():
    assert len(pieces_of("a.md", "markdown", "# A\n\nx\n\n# B\n\n" + "long text " * 9, 4000, 40)) == 1
    assert len(pieces_of("a.md", "markdown", "# A\n\nx\n\n# B\n\ny\n", 4000, 40)) == 2
    assert pieces_of("a.md", "markdown", " \n", 4000, 40) == []


def test_halves_have_their_own_offsets():
    text = "word word\n" * 400
    parts = halves(chunk_lines(text, 10_000)[0], 500)
    assert "".join(p.text for p in parts) == text and all(len(p.text) <= 500 for p in parts)
    assert len({(p.start_byte, p.end_byte) for p in parts}) == len(parts)


SPEC = {
    "openapi": "3.1.0",
    "info": {"title": "Shop", "version": "1"},
    "paths": {"/items": {"get": {"operationId": "listItems", "tags": ["Read", "Items"], "summary": "List", "parameters": [{"$ref": "#/components/parameters/limit"}], "responses": {"200": {"description": "Fine"}}}, "post": {"responses": {"201": {"description": "Made"}}}}},
    "webhooks": {"sold": {"post": {"summary": "Sold"}}},
    "components": {"parameters": {"limit": {"name": "limit", "required": False, "schema": {"type": "integer"}, "description": "How many"}}, "schemas": {"Node": {"properties": {"next": {"$ref": "#/components/schemas/Node"}}}}},
}


@pytest.mark.parametrize("dump", [json.dumps, lambda s: __import__("yaml").safe_dump(s)])
def test_openapi(dump):
    text = openapi.render(dump(SPEC))
    assert openapi.operation_count(text) == 3
    for part in ("## GET /items", "**Operation ID**: `listItems`", "**Tags**: Read, Items", "| limit | integer | False | How many |", "## POST sold", "# Webhooks"):
        assert part in text
    made = pieces_of("apis/acme--shop.openapi.json", "openapi", dump(SPEC), 2400, 1)
    get = [p for p in made if p.facets.get("method") == ["GET"]]
    assert len(get) > 1 and all(p.facets["operationId"] == ["listItems"] and p.facets["apiTag"] == ["Read", "Items"] for p in get)
    assert all(p.facets["specSlug"] == ["shop"] for p in made) and made[0].facets == {"specSlug": ["shop"]}
    post = [p for p in made if p.facets.get("apiPath") == ["/items"] and p.facets["method"] == ["POST"]]
    assert post and all("operationId" not in p.facets for p in post)


def test_chunk_files(spark):
    rows = [("a.md", "markdown", "# A\n\ntext here", 1), ("b.openapi.json", "openapi", "[]", 2), ("c.txt", None, None, None), ("d.bin", None, "x" * 9000, 4)]
    got = chunk_files(spark.createDataFrame(rows, "path string, language string, text string, extra long"), 2400, 5, budget=4000).orderBy("path", "ordinal").collect()
    assert [(r.path, r.extra, r.error is None) for r in got] == [("a.md", 1, True), ("b.openapi.json", 2, False), *[("d.bin", 4, True)] * 4]
    assert chunk_files(spark.createDataFrame([], "path string, language string, text string")).count() == 0
