"""What a deployment plugs in: readers of PDF, models and generators. Each runs on the executors, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.session import ship


class DocumentParser(Protocol):
    """Reads one document's bytes into rows of characters, tables and images, as dictionaries with the columns of the schemas below."""

    def __call__(self, file_id: str, data: bytes) -> Iterable[tuple[str, dict]]: ...


class Embedder(Protocol):
    """Texts to vectors of one length."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Tokenizer(Protocol):
    """Text to tokens."""

    def __call__(self, text: str) -> list[str]: ...


class Generator(Protocol):
    """A prompt to the parts of an answer, as they come."""

    def __call__(self, prompt: str) -> Iterator[str]: ...


SCHEMA = (
    "kind string, file_id string, page_num int, page_height double, char_seq int, text string, x0 double, x1 double, top double, bottom double, width double, "
    "table_idx int, y0 double, y1 double, grid array<array<string>>, idx int, url string, error string"
)


def parsed(stored: DataFrame, parser: DocumentParser) -> DataFrame:
    """One frame of all a parser finds (kind: char, table, image or error); ``of_kind`` takes it apart. Write it before it is read more than once."""
    schema = stored.sparkSession.createDataFrame([], SCHEMA).schema
    names = schema.names

    def each(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = []
            for f, data in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows += [{"kind": kind, "file_id": f} | row for kind, row in parser(f, data)]
                except Exception as e:  # noqa: BLE001
                    rows.append({"kind": "error", "file_id": f, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], arrow)

    return stored.select("file_id", "content").mapInArrow(each, schema)


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    columns = {
        "char": ["file_id", "page_num", "page_height", "char_seq", "text", "x0", "x1", "top", "bottom", "width"],
        "table": ["file_id", "page_num", "table_idx", "x0", "y0", "x1", "y1", "grid"],
        "image": ["file_id", "page_num", "idx", "url"],
        "error": ["file_id", "error"],
    }[kind]
    return found.where(found["kind"] == kind).select(*columns)


ship(__name__)
