"""OpenAPI specs rendered as Markdown with references inlined, and the facets of their chunks."""

from __future__ import annotations

import json
import re
from dataclasses import replace

import yaml

from lodestone.operators.chunk_text import Piece

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


class SpecError(ValueError):
    """The text isn't an OpenAPI object."""


def load(text: str) -> dict:
    try:
        data = json.loads(text)
    except ValueError:
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise SpecError(str(e)) from e
    if not isinstance(data, dict):
        raise SpecError("not an OpenAPI object")
    return data


def resolve(node: object, root: dict, above: tuple[str, ...] = ()) -> object:
    """node with local references replaced by what they name; a reference inside itself becomes a plain object."""
    if isinstance(node, list):
        return [resolve(x, root, above) for x in node]
    if not isinstance(node, dict):
        return node
    ref = node.get("$ref")
    if not isinstance(ref, str) or not ref.startswith("#/"):
        return {k: resolve(v, root, above) for k, v in node.items()}
    if ref in above:
        return {"type": "object", "title": ref.rsplit("/", 1)[-1]}
    target: object = root
    for key in ref[2:].split("/"):
        key = key.replace("~1", "/").replace("~0", "~")
        target = target.get(key) if isinstance(target, dict) else None
    return resolve(target, root, (*above, ref)) if target is not None else {}


def _mapping(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _text(x: object) -> str:
    return "" if x is None else str(x)


def _table(head: tuple[str, ...], rows: list[tuple]) -> list[str]:
    cell = lambda xs: "| " + " | ".join(_text(x).replace("\n", " ") for x in xs) + " |"
    return [cell(head), "|" + "|".join("---" for _ in head) + "|", *map(cell, rows), ""] if rows else []


def _content(content: object) -> list[str]:
    out: list[str] = []
    for body in _mapping(content).values():
        body = _mapping(body)
        fields = _mapping(_mapping(body.get("schema")).get("properties"))
        out += _table(("Field", "Type", "Description"), [(k, _mapping(v).get("type"), _mapping(v).get("description")) for k, v in fields.items()])
        examples = _mapping(body.get("examples"))
        out += ["Examples", ""] if examples else []
        for example in map(_mapping, examples.values()):
            out += [_text(example.get("description")), "", "```json", json.dumps(example.get("value"), indent=2, ensure_ascii=False, default=str), "```", ""]
    return out


def _operation(method: str, path: str, op: dict) -> list[str]:
    out = [f"## {method.upper()} {path}", ""]
    if op.get("operationId"):
        out += [f"**Operation ID**: `{op['operationId']}`", ""]
    if op.get("tags"):
        out += ["**Tags**: " + ", ".join(map(str, op["tags"])), ""]
    for part in dict.fromkeys((op.get("summary"), op.get("description"))):
        out += [_text(part), ""] if part else []
    params = [p for p in map(_mapping, op.get("parameters") or []) if p]
    if params:
        rows = [(p.get("name"), _mapping(p.get("schema")).get("type"), p.get("required"), p.get("description")) for p in params]
        out += ["### Parameters", "", *_table(("Name", "Type", "Required", "Description"), rows)]
    if op.get("requestBody"):
        out += ["### Request Body", "", *_content(_mapping(op["requestBody"]).get("content"))]
    if isinstance(op.get("responses"), dict):
        out += ["### Responses", ""]
        for status, response in op["responses"].items():
            if isinstance(response, dict):
                out += [f"#### {status}", "", _text(response.get("description")), "", *_content(response.get("content"))]
    return out


def render(text: str) -> str:
    """Markdown of one spec: title, servers, authentication, operations, webhooks, schemas."""
    raw = load(text)
    spec = _mapping(resolve(raw, raw))
    info = _mapping(spec.get("info"))
    out = [f"# {_text(info.get('title'))}", "", _text(info.get("description")), "", "# Base URL", ""]
    out += _table(("URL", "Description"), [(_mapping(s).get("url"), _mapping(s).get("description")) for s in spec.get("servers") or []])
    parts = _mapping(spec.get("components"))
    schemes = _mapping(parts.get("securitySchemes"))
    if schemes:
        keys = ("type", "description", "scheme", "bearerFormat")
        rows = [(name, *(_mapping(s).get(k) for k in keys)) for name, s in schemes.items()]
        out += ["# Authentication", "", "## Security Schemes", "", *_table(("Name", "Type", "Description", "Scheme", "Bearer Format"), rows)]
    for title, key in (("APIs", "paths"), ("Webhooks", "webhooks")):
        if key == "paths" or spec.get(key):
            out += [f"# {title}", ""]
        for path, methods in _mapping(spec.get(key)).items():
            for method, op in _mapping(methods).items():
                if method in METHODS and isinstance(op, dict):
                    out += _operation(method, path, op)
    if parts.get("schemas"):
        out += ["# Components", ""]
        for name, schema in _mapping(parts["schemas"]).items():
            fields = _mapping(_mapping(schema).get("properties"))
            rows = [(k, _mapping(v).get("type"), _mapping(v).get("description")) for k, v in fields.items()]
            out += [f"## {name}", "", _text(_mapping(schema).get("description")), "", *_table(("Field", "Type", "Description"), rows)]
    return "\n".join(out).rstrip() + "\n"


def operation_count(markdown: str) -> int:
    return len(re.findall(rf"(?m)^## (?:{'|'.join(m.upper() for m in METHODS)})\b", markdown))


def slug_of(rel: str) -> str | None:
    parts = rel.split("/")
    name = parts[-2] if parts[-1] in ("spec.md", "INDEX.md") and len(parts) > 1 else parts[-1]
    name = re.sub(r"(?i)\.json$", "", re.sub(r"(?i)\.openapi(\.json)?$", "", name))
    return name.partition("--")[2] or None


_OPERATION = re.compile(rf"({'|'.join(m.upper() for m in METHODS)})\s+(\S+)")


def enrich(rel: str, pieces: list[Piece]) -> list[Piece]:
    """Pieces of a spec with the facets of their operation; those hold below its sub-headings, until another operation."""
    base = {"specSlug": [slug]} if (slug := slug_of(rel)) else {}
    now, facets, out = None, dict(base), []
    for p in pieces:
        found = next((m for part in (p.heading_path or "").split(" > ") if (m := _OPERATION.fullmatch(part.strip()))), None)
        here = found and (found[1], found[2])
        if here != now:
            facets = {**base, "method": [here[0]], "apiPath": [here[1]]} if here else dict(base)
            now = here
        if here:
            if m := re.search(r"\*\*Operation ID\*\*:\s*`([^`]+)`", p.text):
                facets["operationId"] = [m[1]]
            if m := re.search(r"\*\*Tags\*\*:\s*(.+)", p.text):
                tags = [t.strip().strip("`").strip() for t in m[1].split(",")]
                facets["apiTag"] = list(dict.fromkeys(filter(None, tags))) or facets.get("apiTag", [])
        out.append(replace(p, facets={**p.facets, **facets}))
    return out
