"""Models as operators: providers of vectors and rerank scores, in Arrow batches, with retries and splitting inside the task."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS, LONGEST_WAIT = 12, 30.0
BATCH_CHARS, BATCH_TEXTS = 40_000, 64
#: Limits of a batch for models of code behind an API.
CODE_BATCH_CHARS, CODE_BATCH_TEXTS = 480_000, 256


class Provider(Protocol):
    """What a dense model offers; queries may be encoded unlike documents."""

    def embed(self, texts: Sequence[str], query: bool = False) -> list[list[float]]: ...


class Busy(Exception):
    """A call to be tried again, after seconds if given. If limited, the provider has had too many calls, and others must wait as well."""

    def __init__(self, message: str = "busy", seconds: float | None = None, limited: bool = False):
        super().__init__(message)
        self.seconds, self.limited = seconds, limited


class TooLong(Exception):
    """A batch over the model's limit; it is halved."""


class Refused(Exception):
    """A call that won't do better if tried again."""


#: Fixed HTTP statuses: those of passing faults, and that of too many calls.
PASSING, LIMITED = (408, 429, 500, 502, 503, 504), 429


def failure(status: int, message: str = "", retry_after: str | None = None) -> Exception:
    """What a provider raises for an HTTP answer of status; retry_after is the header as it came."""
    if "too many tokens" in message.lower() and status not in PASSING:
        return TooLong(message)
    if status not in PASSING:
        return Refused(f"{status}: {message}")
    try:
        seconds = max(0.0, float(retry_after)) if retry_after else None
    except ValueError:
        seconds = None
    return Busy(f"{status}: {message}", seconds, status == LIMITED)


class CoolDown:
    """A moment before which no call of this process goes out: one limited call makes all of them wait."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.until, self.pause = clock, 0.0, 1.0

    def wait(self, sleep: Callable[[float], None]) -> None:
        if (left := self.until - self.clock()) > 0:
            sleep(left)

    def begin(self, seconds: float | None) -> None:
        """Wait for seconds if given, between 1 and 60; otherwise for twice the pause before."""
        pause = self.pause if seconds is None else seconds
        self.until = max(self.until, self.clock() + min(max(pause, 1.0), 60.0))
        self.pause = min(2 * self.pause, 60.0)

    def over(self) -> None:
        self.pause = 1.0


#: Shared by the calls of one Python worker.
COOL_DOWN = CoolDown()


def patient(call: Callable, *args, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, cool: CoolDown = COOL_DOWN):
    """call until it isn't Busy; waits double up to LONGEST_WAIT, or follow what the answer asks for. Limited calls start the shared cool-down."""
    for n in range(attempts):
        cool.wait(sleep)
        try:
            answer = call(*args)
        except Busy as e:
            if n == attempts - 1:
                raise
            if e.limited:
                cool.begin(e.seconds)
            else:
                sleep(e.seconds if e.seconds is not None else min(LONGEST_WAIT, 0.5 * 2**n) * random.uniform(0.8, 1.0))
        else:
            cool.over()
            return answer


def split_calls(call: Callable[[Sequence[str]], list], texts: Sequence[str], **options) -> list:
    """call over texts, halving a batch that is TooLong; a single text that is too long raises."""
    try:
        return patient(call, texts, **options)
    except TooLong:
        if len(texts) < 2:
            raise
        half = len(texts) // 2
        return split_calls(call, texts[:half], **options) + split_calls(call, texts[half:], **options)


def text_batches(texts: Sequence[str], chars: int = BATCH_CHARS, count: int = BATCH_TEXTS) -> Iterator[list[str]]:
    """Runs of texts within both limits; a long text stands alone."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and (size + len(t) > chars or len(held) >= count):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def embedder(make: Callable[[], Provider], chars: int = BATCH_CHARS, count: int = BATCH_TEXTS) -> Callable[[DataFrame], DataFrame]:
    """An embed function for index runs: (point_id, embed_text) to (point_id, dense). The provider is made once per task."""

    def embed(rows: DataFrame) -> DataFrame:
        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            provider = make()
            for part in parts:
                vectors = [v for b in text_batches(part.column(1).to_pylist(), chars, count) for v in split_calls(provider.embed, b)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["point_id", "dense"])

        return rows.select("point_id", "embed_text").mapInArrow(work, "point_id string, dense array<float>")

    return embed


def query_vector(provider: Provider, text: str) -> list[float]:
    """A query's vector; models may encode queries unlike documents."""
    return split_calls(lambda texts: provider.embed(texts, query=True), [text])[0]


def contextual(rows: DataFrame, call: Callable[[list[str]], list[list[float]]], by: str = "path", order: str = "ordinal", text: str = "text", key: str = "point_id") -> DataFrame:
    """Vectors of chunks that a model reads document by document: call gets a document's chunks in order."""

    def work(doc: pa.Table) -> pa.Table:
        doc = doc.sort_by(order)
        vectors = split_calls(call, doc.column(text).to_pylist())
        return pa.table({key: doc.column(key), "dense": pa.array(vectors, pa.list_(pa.float32()))})

    return rows.select(by, order, text, key).groupBy(by).applyInArrow(work, f"{key} string, dense array<float>")


def reranker(make: Callable[[], Callable[[str, Sequence[str]], list[float]]], query: str, text: str = "text") -> Callable:
    """A score column for search(): the model is made once per task and sees the candidates only, batch by batch."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series([s for b in text_batches([t or "" for t in texts]) for s in patient(model, query, b)], dtype="float64")

    return lambda found: score(found[text])


def by_index(answers: Sequence[dict], count: int, field: str = "relevance_score", missing: float = 0.0) -> list[float]:
    """Answers with an index, back in the order asked; those that are missing get a fixed value."""
    out = [missing] * count
    for a in answers:
        if 0 <= a.get("index", -1) < count:
            out[a["index"]] = float(a.get(field, missing))
    return out
