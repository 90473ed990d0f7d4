"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter (a path every executor can read)."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.session import schema_with, ship

VOCABULARY = os.environ.get("DOCWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Fixed value: how the public byte-level BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Sizes(dict):
    """Sizes of stretches between blanks; tokens never reach over a stretch, so sizes add up. The memory is bounded."""

    def __init__(self, vocabulary: str, most: int = 400_000):
        import base64
        import re

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut, self.most = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall, most
        self.odd = re.compile("[\x1c-\x1f\x85]").search  # blanks to one of the two engines only

    def __missing__(self, part: str) -> int:
        if len(self) > self.most:
            self.clear()
        n = self[part] = len(self.encode(part))
        return n

    def of(self, text: str) -> int:
        return len(self.encode(text)) if self.odd(text) else sum(map(self.__getitem__, self.cut(text)))


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the text column replaced by its size in tokens; NULL has none (NULL), empty text 0."""
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    kept = [c for c in df.columns if c != text]
    schema = schema_with(df, kept, out, "long")

    def each(batches):
        sizes = Sizes(vocabulary)
        for batch in batches:
            n = [None if t is None else sizes.of(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(n, pa.int64())], [*kept, out])

    return df.mapInArrow(each, schema)


ship(__name__)
