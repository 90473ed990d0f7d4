"""Groups that hold a large part of all rows: copies of one text, long posting lists, one form in many spellings."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.llm import form, neardup


def test_copies_cost_one_set(spark):
    d = spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("one text of some seven words here").alias("t")).union(spark.createDataFrame([("a", "one text of some seven words there"), ("b", "nothing at all like the others")], "k string, t string"))
    s = neardup.signed(d, "k", "t", 5)
    c = neardup.classes(s, neardup.similar_sets(s, 0.4))
    assert c.groupBy("class_id", "links", "copies").count().orderBy("count").select("links", "copies", "count").collect() == [(0, 0, 1), (1, 0, 1), (1, 99_999, 100_000)] or {tuple(r)[1:] for r in c.groupBy("class_id", "links", "copies").count().collect()} == {(1, 99_999, 100_000), (1, 0, 1), (0, 0, 1)}


def test_one_long_list_makes_no_pairs(spark):
    """20,000 sets that agree in one coordinate, and two that agree in a second one besides."""
    own = [F.xxhash64("id", F.lit(i)) for i in range(3)]
    sig = F.array(F.lit(7).cast("long"), F.when(F.col("id") < 2, F.lit(8).cast("long")).otherwise(own[0]), *own[1:])
    s = spark.range(20_000).select(F.col("id").alias("set_id"), F.lit(0).alias("side"), sig.alias("sig"))
    got = neardup.colliding(s)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 2)]


@pytest.mark.parametrize("longest", [2, 3, 512])
@pytest.mark.parametrize("two_sided", [False, True])
def test_collisions_are_counted_as_all_pairs_would(spark, longest, two_sided):
    rng = random.Random(longest)
    sets = {i: {rng.choice([1, 1, 2, 3, rng.randrange(40)]) for _ in range(5)} for i in range(60)}
    side = {i: i % 2 if two_sided else 0 for i in sets}
    s = spark.createDataFrame([(i, side[i], sorted(x)) for i, x in sets.items()], "set_id long, side int, sig array<bigint>")
    got = {tuple(r)[:2] for r in neardup.colliding(s, two_sided, longest).where(F.col("matches") >= 2).collect()}
    want = {(a, b) for a in sets for b in sets if (side[a] < side[b] if two_sided else a < b) and len(sets[a] & sets[b]) >= 2}
    assert got == want


def test_blocks_give_all_pairs(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i}", "g" if i < 20 else "h", f"t{i % 3}") for i in range(25)], "k string, f string, t string")
    pairs = form.paired(rows, ["f"], 4).where("x.k < y.k").select("x.k", "y.k")
    assert pairs.count() == pairs.distinct().count() == 20 * 19 // 2 + 5 * 4 // 2
    both = form.crossed(rows, rows.select("f", F.col("k").alias("o")), ["f"], 4)
    assert both.count() == both.distinct().count() == 400 + 25
    whole = form.variant_pairs(rows, "k").collect()
    monkeypatch.setattr(form.variant_pairs, "__defaults__", form.variant_pairs.__defaults__)
    assert len(whole) == sum(1 for i in range(25) for j in range(i) if i % 3 != j % 3 and (i < 20) == (j < 20))


def test_copies_in_blocks_give_the_same_pairs(spark, monkeypatch):
    texts = ["a b c d e f g"] * 9 + ["a b c d e f h"] * 7 + ["x y z w v u t"] * 3
    d = spark.createDataFrame([(f"k{i:02}", t) for i, t in enumerate(texts)], "k string, t string")
    s = neardup.signed(d, "k", "t", 5)
    sets = neardup.similar_sets(s, 0.4)
    want = {(f"k{i:02}", f"k{j:02}") for i in range(19) for j in range(i + 1, 19) if (i < 16) == (j < 16)}
    assert {tuple(r) for r in neardup.record_pairs(s, sets).collect()} == want
    monkeypatch.setattr(neardup, "GROUP", 3)
    assert {tuple(r) for r in neardup.record_pairs(s, sets).collect()} == want


def test_classes_of_forms(spark):
    d = spark.createDataFrame([("a", "x y"), ("b", "x  y"), ("c", "ｘ y"), ("d", "x y"), ("a", "x y"), ("e", None), ("f", "z"), (None, "x y")], "k string, t string")
    assert sorted(map(tuple, form.look_classes(d, "k", "t").collect())) == [("a", "a", 3, 4), ("b", "a", 3, 4), ("c", "a", 3, 4), ("d", "a", 3, 4), ("f", "f", 1, 1)]
    assert form.look_classes(d.limit(0), "k", "t").count() == 0
    many = spark.range(50_000).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit(" "), (F.col("id") % 500).cast("int")).alias("t"))
    assert form.look_classes(many, "k", "t").select("spellings", "records").distinct().collect() == [(500, 50_000)]


def test_few_vectors_need_no_cells(spark):
    import numpy as np

    from docweave.llm import knn

    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    d = spark.createDataFrame([(f"v{i}", (base + 0.1 * rng.normal(size=64)).tolist()) for i in range(12)], "k string, e array<float>")
    assert knn.nearest(d, "k", "e").count() == 60
