"""All pairs of similar texts, without loss: a pigeonhole join over segments of equal information.

A pair of similarity (1 - edit distance / length of the longer) above the threshold is at most ``most_edits`` edits apart, a number that follows from the longer text alone.
The longer text is cut into one disjoint segment more than that; an edit spoils at most one of them, so one stands unchanged in the shorter text,
moved by no more places than there are edits. Any such cut is without loss. So that segments are rare, their ends follow the information of the characters
(a model of character pairs, fitted on some ``SAMPLE`` texts drawn by hash; it sets how much work there is, not what is found): a segment is the shortest run from its first character on that holds so many bits, and the bits are the
most of ``BITS`` at which the text has enough segments. What the run is depends on nothing around it, so the shorter text offers one run a place and number
of bits. Candidates are verified by the texts themselves. Equal texts of a scope are one; nothing is capped.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import similarity
from docweave.session import materialize, ship, spread, strip_blanks

BITS = (40, 32, 28, 24, 20, 18, 16, 14, 12, 10, 8, 6, 4, 0)
SAMPLE = 8192
UNIT = 16  # information is counted in whole sixteenths of a bit: sums don't depend on what stands before


def most_edits(length: int, threshold: float) -> int:
    """The most edits at which two texts, the longer of this length, are still above the threshold."""
    n = math.ceil(length * (1 - threshold)) + 1
    while n > 0 and not 1 - n / length > threshold:
        n -= 1
    return n


def model(texts: list[str]) -> tuple[dict, dict]:
    """Sixteenths of a bit of a character by itself, and after another."""
    one, two = Counter(), Counter()
    for t in texts:
        one.update(t)
        two.update(zip(t, t[1:], strict=False))
    n = sum(one.values())
    return {c: round(UNIT * math.log2(n / k)) for c, k in one.items()}, {a + b: round(UNIT * math.log2(one[a] / k)) for (a, b), k in two.items()}


def run_ends(text: str, bits, first: dict, after: dict):
    """For each number of bits and each place, where the shortest run from there ends that holds them (past the end: none does)."""
    import numpy as np

    own = np.array([first.get(c, 20 * UNIT) for c in text], np.int64)
    total = np.cumsum([0, *(max(0, after.get(text[i : i + 2], 12 * UNIT)) for i in range(len(text) - 1))])
    need = np.array(bits, np.int64)[:, None] * UNIT - own + total
    return np.maximum(np.searchsorted(total, need.ravel()).reshape(need.shape), np.arange(len(text))) + 1


def segments(text: str, edits: int, first: dict, after: dict) -> tuple[int, list[tuple[int, int]]]:
    """The bits, and edits + 1 disjoint runs that hold them."""
    ends = run_ends(text, BITS, first, after)
    for bits, end in zip(BITS, ends.tolist(), strict=True):
        at, found = 0, []
        while at < len(text) and end[at] <= len(text) and len(found) <= edits:
            found.append((at, end[at]))
            at = end[at]
        if len(found) > edits:
            return bits, found
    raise AssertionError("a text has more characters than edits")


def _postings(threshold: float, first: dict, after: dict, probe: list[int] | None):
    """(run, id, place, length, edits, bits) of the runs a text is cut into, or with ``probe`` of all runs of so many bits."""

    def each(batches):
        import numpy as np

        rng = np.random.default_rng(11)
        base = np.uint64(rng.integers(1, 2**63) * 2 + 1)
        salt = rng.integers(1, 2**63, 3, dtype=np.uint64) | np.uint64(1)
        power = np.cumprod(np.r_[np.uint64(1), np.full(4095, base)])

        def hashed(text, start, end, bits, scope):
            nonlocal power
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
            c = (c ^ (c >> np.uint64(7))) * salt[0]
            c ^= c >> np.uint64(29)
            if len(c) >= len(power):
                power = np.cumprod(np.r_[np.uint64(1), np.full(2 * len(c), base)])
            # Sums of characters times powers by place, made independent of the place by the power that is missing to the text's length.
            total = np.r_[np.uint64(0), np.cumsum(c * power[: len(c)])]
            h = (total[end] - total[start]) * power[len(c) - start]
            h = h * inverse_power(len(c)) + bits.astype(np.uint64) * salt[1] + np.uint64(scope * int(salt[2]) & (2**64 - 1))
            h ^= h >> np.uint64(31)
            return (h * salt[0]).view(np.int64)

        inverse = pow(int(base), -1, 2**64)
        kept = {}

        def inverse_power(n):
            if n not in kept:
                kept[n] = np.uint64(pow(inverse, n, 2**64))
            return kept[n]

        for batch in batches:
            out = [[] for _ in range(6)]
            for at, text, scope in zip(*(batch.column(x).to_pylist() for x in ("id", "text", "scope")), strict=True):
                edits = most_edits(len(text), threshold) if text else 0
                if not text:
                    continue
                if probe is None:
                    if not edits:
                        continue
                    b, found = segments(text, edits, first, after)
                    start, end = (np.array(x) for x in zip(*found, strict=True))
                    bits = np.full(len(start), b)
                else:
                    ends = run_ends(text, probe, first, after)
                    bits, start = (x.ravel() for x in np.meshgrid(np.array(probe), np.arange(len(text)), indexing="ij"))
                    end = ends.ravel()
                    some = end <= len(text)
                    bits, start, end = bits[some], start[some], end[some]
                n = len(start)
                for x, y in zip(out, (hashed(text, start, end, bits, scope), np.full(n, at), start.astype(np.int32), np.full(n, len(text), np.int32), np.full(n, edits, np.int32), bits.astype(np.int32)), strict=True):
                    x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["run", "id", "place", "length", "edits", "bits"])

    return each


def _merged(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """a joined to b with both laid out by the key. Left to estimates, a side goes through the driver as a broadcast when its table is small as stored; but a stored name offers some two hundred runs,
    and names pack many times over."""
    return a.join(b.hint("merge"), on, how)


POSTING = "run bigint, id bigint, place int, length int, edits int, bits int"


def similar_pairs(df: DataFrame, key: str, text: str, by: list, threshold: float = 0.85) -> DataFrame:
    """(key_a, text_a, key_b, text_b, similarity) of every two rows that agree in ``by`` (columns) and whose texts, in lower case and without blanks at the ends, are more similar
    than the threshold; a is the first by (text, key). Repeated rows count once; NULL texts have no partners."""
    names = [f"_by{i}" for i in range(len(by))]
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), *(c.alias(n) for c, n in zip(by, names, strict=True))).distinct()
    rows = rows.withColumn("scope", F.xxhash64(F.lit("scope"), *names)).withColumn("plain", F.lower(strip_blanks(F.col("text"))))
    rows = materialize(rows.withColumn("id", F.xxhash64("scope", "plain")), "names")
    texts = spread(rows.select("id", "scope", F.col("plain").alias("text")).dropDuplicates(["id"]))
    drawn = F.pmod(F.col("id"), F.lit(2**40)) < F.lit(min(2**40, 2**40 * SAMPLE // max(1, rows.count())))  # ids are hashes: some SAMPLE rows in all, of every task its part
    first, after = model([r.text for r in texts.where(drawn).select("text").collect()])
    cut = materialize(texts.mapInArrow(_postings(threshold, first, after, None), POSTING), "segments")
    probe = sorted(r.bits for r in cut.select("bits").distinct().collect())
    offered = texts.mapInArrow(_postings(threshold, first, after, probe), POSTING)
    x = cut.select("run", F.col("id").alias("a"), F.col("place").alias("pa"), F.col("length").alias("la"), "edits")
    y = offered.select("run", F.col("id").alias("b"), F.col("place").alias("pb"), F.col("length").alias("lb"))
    near = (F.abs(F.col("pa") - F.col("pb")) <= F.col("edits")) & (F.col("la") - F.col("lb") <= F.col("edits")) & ((F.col("lb") < F.col("la")) | (F.col("lb") == F.col("la")) & (F.col("a") < F.col("b")))
    met = _merged(x, y, "run").where(near).select("a", "b").distinct()
    plain = rows.select("id", "plain").dropDuplicates(["id"])
    met = _merged(_merged(met, plain.select(F.col("id").alias("a"), F.col("plain").alias("ta")), "a"), plain.select(F.col("id").alias("b"), F.col("plain").alias("tb")), "b")
    alike = met.where(similarity(F.col("ta"), F.col("tb")) > threshold).select("a", "b")
    alike = materialize(alike, "alike")
    left, right = (rows.select(F.col("id").alias(i), *(F.col(c).alias(f"{c}_{i}") for c in ("key", "text", *names))) for i in "ab")
    pairs = _merged(_merged(alike, left, "a"), right, "b")
    many = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    same = _merged(rows, many, "id", "left_semi")
    same = _merged(same.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("key", "text", *names))), same.select(F.col("id").alias("a"), F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("key", "text", *names))), "a")
    columns = [f"{c}_{i}" for i in "ab" for c in ("key", "text")]
    order_a, order_b = (F.struct(f"text_{i}", f"key_{i}") for i in "ab")
    agree = F.lit(True)
    for n in names:
        agree = agree & F.col(f"{n}_a").eqNullSafe(F.col(f"{n}_b"))
    same = same.where(agree & (order_a < order_b)).select(*columns)
    turned = [F.when(order_a < order_b, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_a") for c in ("key", "text")] + [F.when(order_a < order_b, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_b") for c in ("key", "text")]
    pairs = pairs.where(agree).select(*turned).select(*columns).union(same)
    return pairs.withColumn("similarity", similarity(F.col("text_a"), F.col("text_b")))


ship(__name__)
