"""Splitting with large limits and texts without blanks."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.llm import split


@pytest.mark.parametrize("limit", [700, 2_000, 20_000])
def test_large_limits(spark, limit):
    rng = random.Random(5)
    text = "".join(rng.choice(["word", "끝.", "x", "😀b"]) + rng.choice([" ", "  ", "\n", "\r\n\r\n", "　"]) for _ in range(60_000))
    d = spark.createDataFrame([(1, text), (2, "a " * 60_000)], "i int, t string")
    by = {}
    for r in split.split_oversized(d, "t", limit, 100, only_oversized=True).orderBy("i", "piece_no").collect():
        by.setdefault(r.i, []).append(r)
    for i, t in ((1, text), (2, "a " * 60_000)):
        end = 0
        for p in by[i]:
            assert t[p.start : p.start + len(p.piece)] == p.piece and len(p.piece.split()) <= limit
            assert p.piece_no == 1 or len(t[p.start : end].split()) == 100
            end = p.start + len(p.piece)
        assert end == len(t) and len(by[i]) >= 60_000 // limit


@pytest.mark.parametrize("unit", ["word", "char"])
def test_a_text_without_blanks_falls_back_to_characters(spark, unit):
    t = "😀가나다" * 25_000
    d = spark.createDataFrame([(t,)], "t string")
    limit, longest = (10, 1_000) if unit == "word" else (20_000, 1)
    rows = split.split_oversized(d, "t", limit, 3, unit, longest=longest).orderBy("piece_no").collect()
    end = 0
    for p in rows:
        assert t[p.start : p.start + len(p.piece)] == p.piece and len(p.piece) <= limit * longest
        assert p.piece_no == 1 or end - p.start == 3 * longest
        end = p.start + len(p.piece)
    assert end == len(t) and len(rows) > 4
    words = "w " * 8 + "y" * 5_000
    few = spark.createDataFrame([(words,)], "t string")
    assert split.split_oversized(few, "t", 10, 3, longest=1_000, only_oversized=True).count() == 0
    full = spark.createDataFrame([("w " * 10 + "y" * 2_000,)], "t string")  # eleven words, the last as long as two units
    assert split.split_oversized(full, "t", 10, 3, longest=1_000, only_oversized=True).count() > 1
    assert split.split_oversized(few, "t", 10, 3, longest=1_000).select(F.max("piece_no")).first()[0] == 2
