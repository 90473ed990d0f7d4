"""Packed fields against a scanner written another way, and the defined edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.functions import packed


def scan(s):
    out, i, n = [], 0, len(s)

    def sep(i):
        return i < n and (s[i] in packed.HARD or (s[i] in packed.SOFT and 0 < i < n - 1 and s[i - 1].isspace() and s[i + 1].isspace()))

    while i <= n:
        j = i
        while j < n and s[j].isspace() and not sep(j):
            j += 1
        if j < n and s[j] in packed.QUOTES:
            close, k, body, ok = packed.QUOTES[s[j]], j + 1, "", False
            while k < n:
                if s[k] == close:
                    if s[k + 1 : k + 2] == close:
                        body, k = body + close, k + 2
                        continue
                    e = k + 1
                    while e < n and s[e].isspace() and not sep(e):
                        e += 1
                    ok = e >= n or sep(e)
                    break
                body += s[k]
                k += 1
            if ok:
                out += [body] if body.strip() else []
                i = e + 1
                continue
        e = i
        while e < n and not sep(e):
            e += 1
        out += [s[i:e].strip()] if s[i:e].strip() else []
        i = e + 1
    return out


CASES = ["a, b;c|d", "a / b/c · d", '"x, y" ; z', '"a ""b"" c", d', "“등급 \"가\" 부품”，냉각", "operator's note, 'cold, start'", '"a', '"a, b" c, d', ",, ;", " 정기점검 ", "a\tb\nc\r\nd", "a、b，c", "x" * 5000]


def values(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", packed.split_packed(packed.F.col("t")).alias("v")).collect()
    return {r.i: r.v for r in rows}


def test_against_scanner(spark):
    got = values(spark, CASES)
    assert [got[i] for i in range(len(CASES))] == [scan(t) for t in CASES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab ,;/·\"'“”|", max_size=14), min_size=40, max_size=40))
def test_random_plain_and_single_quotes(spark, texts):
    texts = [t for t in texts if sum(t.count(q) for q in "\"'“”") <= 2]  # with more, a failed quote may hide another, which neither side defines
    got = values(spark, texts)
    assert [got[i] for i in range(len(texts))] == [scan(t) for t in texts]


def test_nulls_empty_extra_columns_and_clash(spark):
    d = spark.createDataFrame([("f", "a,b", 7), ("g", None, 8), ("h", " ", 9), ("f", "a,b", 7)], "k string, t string, n int")
    rows = sorted(map(tuple, packed.explode_packed(d, "t", "tag", "tag_no").collect()))
    assert rows == [("f", 7, 1, "a"), ("f", 7, 1, "a"), ("f", 7, 2, "b"), ("f", 7, 2, "b")]
    assert packed.explode_packed(d.limit(0), "t").count() == 0
    with pytest.raises(ValueError):
        packed.explode_packed(d, "t", "n", "tag_no")
