"""Project configuration: JSON with comments, checked spaces and groups, groups from a command, names of stored tables."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Sequence
from pathlib import Path

from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator
from pydantic.alias_generators import to_camel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.facets import check_not_reserved, normalize
from lodestone.sources.globs import to_regex

COMMAND_SECONDS = 180


class ConfigError(ValueError):
    """A configuration that can't be used."""


_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.DOTALL)


def strip_comments(text: str) -> str:
    """JSON without its comments; those inside strings stay, and line numbers too."""
    return _COMMENT.sub(lambda m: m[1] or "\n" * m[0].count("\n"), text)


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", alias_generator=to_camel, populate_by_name=True)


class Model(_Strict):
    provider: str = "local"
    model: str


class Chunking(_Strict):
    max_chars: int = Field(2400, ge=200, le=80_000)
    min_chars: int = Field(40, ge=0, le=2000)


class Retrieval(_Strict):
    prefetch: int = Field(80, ge=1, le=400)
    limit: int = Field(10, ge=1, le=50)
    rerank: bool = True


class Space(_Strict):
    dense: Model
    sparse: Model = Model(model="bm25")
    rerank: Model | None = None
    dimensions: int | None = None
    chunk: Chunking = Chunking()
    retrieve: Retrieval = Retrieval()


class Group(_Strict):
    name: str
    facets: dict[str, list[str]] = {}
    include: list[str]
    exclude: list[str] = []
    priority: int = 0
    kind: str = "auto"
    enabled: bool = True
    space: str | None = None

    @field_validator("facets", mode="before")
    @classmethod
    def _facets(cls, value):
        found = normalize(value, "group")
        check_not_reserved(found, "group")
        return found

    @field_validator("kind")
    @classmethod
    def _kind(cls, value):
        if value not in ("auto", "openapi"):
            raise ValueError(f"unknown kind: {value}")
        return value


class Project(_Strict):
    default_space: str
    spaces: dict[str, Space]
    groups: list[Group] = []
    groups_command: list[str] | None = None
    exclude: list[str] = []

    @model_validator(mode="after")
    def _known_spaces(self):
        for name in {self.default_space, *(g.space for g in self.groups if g.space)}:
            if name not in self.spaces:
                raise ValueError(f"unknown space: {name}")
        names = [g.name for g in self.groups]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"duplicate group: {', '.join(twice)}")
        return self

    def space_named(self, name: str | None) -> Space:
        try:
            return self.spaces[name or self.default_space]
        except KeyError:
            raise ConfigError(f"unknown space: {name}; known: {', '.join(sorted(self.spaces))}") from None


def parse(text: str, root: str | Path = ".", run_commands: bool = True) -> Project:
    """A checked project; groups of its command are added to its own."""
    try:
        data = json.loads(strip_comments(text))
        project = Project.model_validate(data)
        if project.groups_command and run_commands:
            data["groups"] = [*data.get("groups", []), *command_groups(root, project.groups_command)]
            project = Project.model_validate(data)
    except ValueError as e:
        raise ConfigError(str(e)) from e
    return project


def command_groups(root: str | Path, argv: Sequence[str], seconds: float = COMMAND_SECONDS) -> list[dict]:
    """Groups that a command prints as {"groups": [...]}; every failure names the command."""
    what = " ".join(argv)
    try:
        ran = subprocess.run(argv, cwd=root, capture_output=True, text=True, timeout=seconds, check=False)
    except FileNotFoundError:
        raise ConfigError(f"groups command not found: {what}") from None
    except subprocess.TimeoutExpired:
        raise ConfigError(f"groups command took over {seconds:g} s: {what}") from None
    if ran.returncode:
        raise ConfigError(f"groups command failed ({ran.returncode}): {what}: {ran.stderr.strip()[-500:]}")
    try:
        groups = json.loads(ran.stdout)["groups"]
    except (ValueError, KeyError, TypeError):
        raise ConfigError(f"groups command printed no groups object: {what}") from None
    if not isinstance(groups, list):
        raise ConfigError(f"groups command's groups are no list: {what}")
    return groups


def groups_table(spark: SparkSession, project: Project) -> DataFrame:
    """The groups as a table for claims: patterns as regular expressions, the project's excludes in each group's."""
    rows = [
        (g.name, g.space or project.default_space, g.priority, list(map(to_regex, g.include)), list(map(to_regex, [*g.exclude, *project.exclude])), g.enabled, g.kind, g.facets)
        for g in project.groups
    ]
    return spark.createDataFrame(rows, "name string, space string, priority int, include array<string>, exclude array<string>, enabled boolean, kind string, group_facets map<string,array<string>>")


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def backend_id(space: str, config: Space, mode: str = "exact") -> str:
    """What a stored index depends on; the least chunk size isn't part of it."""
    dims = config.dimensions or (1024 if config.dense.provider == "voyage" else 0)
    return f"{slug(space)}--{mode}--{slug(config.dense.model)}--d{dims}--{slug(config.sparse.model)}--c{config.chunk.max_chars}"


def table_name(root: str, space: str, config: Space, mode: str = "exact") -> str:
    digest = hashlib.sha1(backend_id(space, config, mode).encode()).hexdigest()[:10]
    return f"{slug(Path(root).name)}_{slug(space)}_{mode}_{digest}"


def unknown_filter(project: Project, groups: Sequence[str] = (), spaces: Sequence[str] = ()) -> str | None:
    """The first group or space asked for that the project doesn't have."""
    known = {g.name for g in project.groups}
    bad = [f"unknown group: {g}" for g in groups if g not in known] + [f"unknown space: {s}" for s in spaces if s not in project.spaces]
    return bad[0] if bad else None


def selected(claimed: DataFrame, project: Project, groups: Sequence[str] = (), spaces: Sequence[str] = ()) -> DataFrame:
    """Claimed files of any of the groups and any of the spaces; none given means all. An unknown name is an error that names it."""
    if fault := unknown_filter(project, groups, spaces):
        raise ConfigError(fault)
    rows = claimed.where(F.col("name").isin(*groups)) if groups else claimed
    return rows.where(F.col("space").isin(*spaces)) if spaces else rows


def nearest_project(projects: Sequence[dict], path: str) -> dict | None:
    """The registered project whose root is path or the nearest folder above it."""
    at = Path(path).resolve()
    above = [p for p in projects if at == Path(p["root"]) or Path(p["root"]) in at.parents]
    return max(above, key=lambda p: len(p["root"]), default=None)
