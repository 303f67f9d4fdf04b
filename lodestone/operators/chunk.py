"""The chunking operator: files to chunk rows, text by text on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import CODE
from lodestone.operators import openapi
from lodestone.operators.chunk_code import chunk_code, chunk_json
from lodestone.operators.chunk_text import Piece, chunk_lines, chunk_markdown, halves, long_enough

MAX_CHARS, MIN_CHARS, CONTEXT_CHARS = 2400, 40, 40_000
FIELDS = "ordinal int, kind string, symbol string, heading_path string, start_line int, end_line int, start_byte long, end_byte long, text string, chunk_facets map<string,array<string>>"


def pieces_of(rel: str, language: str | None, text: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> list[Piece]:
    """Chunks of one file by its language; unknown ones by lines."""
    if language == "markdown":
        made = chunk_markdown(text, max_chars)
    elif language == "openapi":
        made = openapi.enrich(rel, chunk_markdown(openapi.render(text), max_chars))
    elif language == "json":
        made = chunk_json(rel, text, max_chars)
    elif language in CODE:
        made = chunk_code(text, language, max_chars)
    else:
        made = chunk_lines(text, max_chars)
    return long_enough(made, min_chars)


def chunk_files(files: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, budget: int | None = None) -> DataFrame:
    """Chunk rows of files(path, language, text, ...): the other columns, then FIELDS and error.

    A file that can't be chunked gives one row with error set and no text, so that a run can report it. With
    budget, longer chunks are halved. Each file is chunked where its row is: nothing is shuffled.
    """
    keep = [c for c in files.columns if c != "text"]
    own = T._parse_datatype_string(FIELDS + ", error string")
    schema = T.StructType([*(files.schema[c] for c in keep), *own.fields])
    at = {c: i for i, c in enumerate([*keep, "text"])}

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for part in parts:
            for begin in range(0, part.num_rows, 128):
                some = part.slice(begin, 128)
                cols = [some.column(at[c]).to_pylist() for c in ("path", "language", "text")]
                rows, source = [], []
                for i, (path, language, text) in enumerate(zip(*cols, strict=True)):
                    try:
                        made = [q for p in pieces_of(path or "", language, text or "", max_chars, min_chars) for q in (halves(p, budget) if budget else [p])]
                    except openapi.SpecError as e:
                        rows.append((None,) * 10 + (str(e),))
                        source.append(i)
                        continue
                    for k, p in enumerate(made):
                        rows.append((k, p.kind, p.symbol, p.heading_path, p.start_line, p.end_line, p.start_byte, p.end_byte, p.text, list(p.facets.items()), None))
                        source.append(i)
                picked = [some.column(at[c]).take(pa.array(source, pa.int64())) for c in keep]
                made = list(zip(*rows, strict=True)) if rows else [[]] * len(own.fields)
                typed = [pa.array(list(x), shape.field(len(keep) + j).type) for j, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([a.cast(shape.field(j).type) for j, a in enumerate([*picked, *typed])], schema.names)

    return files.select(*keep, "text").mapInArrow(work, schema)


def min_chars_filter(chunks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The per-file rule as a window: chunks of min_chars, or all with text where a file has none that long."""
    from pyspark.sql import Window

    some = chunks.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    long = F.char_length("text") >= min_chars
    any_long = F.max(long).over(Window.partitionBy("path"))
    return some.withColumn("_long", any_long).where(long | ~F.col("_long")).drop("_long")
