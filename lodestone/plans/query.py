"""Searching a stored index: checks of space and facet keys, then a lazy result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.facets import normalize
from lodestone.operators import search as op
from lodestone.operators.facet_counts import ONE_KEY, OVERVIEW, facet_keys, facet_overview, facet_values, with_meanings
from lodestone.plans.index import Index
from lodestone.sources.config import ConfigError, Project
from lodestone.sources.tables import TableError


class QueryError(ValueError):
    """An unknown project, space or facet key."""


@dataclass(frozen=True)
class Answer:
    """What a search over projects gives: hits with the project they are from, projects that failed with the reason, and a hint."""

    hits: DataFrame | None
    failed: dict[str, str]
    hint: str | None


#: Said where a search finds nothing.
NO_HITS = "no hits: try other words, fewer facets, or a keyword search"


def _points(points: DataFrame, project: Project, space: str | None, facets: Mapping, exclude: Mapping, check_keys: bool = True) -> DataFrame:
    project.space_named(space)
    rows = points.where(F.col("space") == (space or project.default_space))
    asked = set(facets) | set(exclude)
    if asked and check_keys:
        known = {r.key for r in facet_keys(rows).select("key").collect()}
        if known and asked - known:
            raise QueryError(f"unknown facet key: {', '.join(sorted(asked - known))}; known: {', '.join(sorted(known))}")
    return rows


def search(points: DataFrame, project: Project, query: str, vector: Sequence[float] | None = None, *, space: str | None = None, limit: int | None = None, use_rerank: bool | None = None, facets: Mapping | None = None, exclude: Mapping | None = None, sparse: bool = False) -> DataFrame:
    """Hits of one space, best first: by keywords if sparse, else by vector, reranked by the query's words if that is on."""
    facets, exclude = normalize(facets or {}), normalize(exclude or {})
    config = project.space_named(space)
    final = limit or config.retrieve.limit
    rows = _points(points, project, space, facets, exclude)
    if sparse:
        return op.bm25_topk(rows, query, final, facets=facets, exclude=exclude).join(rows, "point_id").orderBy(F.desc("score"), "point_id")
    if vector is None:
        raise QueryError("a dense search needs the query's vector")
    wanted = config.retrieve.rerank if use_rerank is None else use_rerank
    score = op.overlap_score(query)
    reranker = (lambda found: score(found["text"])) if wanted and config.rerank else None
    return op.search(rows, vector, limit=final, prefetch=config.retrieve.prefetch, reranker=reranker, facets=facets, exclude=exclude)


def search_projects(projects: Mapping[str, tuple[Index, Project]], names: Sequence[str], query: str, vector: Sequence[float] | None = None, *, limit: int | None = None, **options) -> Answer:
    """The best hits of several projects together. An unknown name is an error; a project that is broken or not yet indexed is named, and others go on.

    Scores compare where the projects share a model; ties go by project, then by point.
    """
    unknown = [n for n in names if n not in projects]
    if unknown:
        raise QueryError(f"unknown project: {', '.join(unknown)}; known: {', '.join(sorted(projects))}")
    found, failed = [], {}
    for name in names:
        index, project = projects[name]
        try:
            points = index.points.read()
            if points is None:
                failed[name] = "not indexed yet"
                continue
            found.append(search(points, project, query, vector, limit=limit, **options).withColumn("project", F.lit(name)))
        except (TableError, ConfigError, QueryError) as e:
            failed[name] = str(e)
    if not found:
        return Answer(None, failed, NO_HITS)
    most = limit or max(projects[n][1].space_named(options.get("space")).retrieve.limit for n in names if n not in failed)
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    hits = both.orderBy(F.desc("score"), "project", "point_id").limit(most)
    return Answer(hits, failed, NO_HITS if hits.isEmpty() else None)


def facets(points: DataFrame, project: Project, space: str | None = None, key: str | None = None, meanings: Mapping[str, str] | None = None) -> DataFrame:
    """All keys with their first values and, if given, meanings; or one key's values with counts."""
    rows = _points(points, project, space, {key: []} if key else {}, {})
    if key:
        return facet_values(rows, key, ONE_KEY)
    listed = facet_overview(rows, OVERVIEW)
    return (listed if meanings is None else with_meanings(listed, meanings)).orderBy("key")
