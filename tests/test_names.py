"""Similar names against all pairs."""

import random

from pyspark.sql import functions as F

from docweave.functions.text import similarity
from docweave.operators import names
from docweave.plans import queries


def edited(rng, name):
    s = list(name)
    for _ in range(rng.randint(0, 7)):
        i = rng.randrange(len(s) + 1)
        s[i : i + rng.randint(0, 1)] = rng.choices("가나bc_ -é", k=rng.randint(0, 1))
    return "".join(s)


def test_similar_names_against_all_pairs(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        name = "_".join(rng.sample(["점검표", "시험성적", "도면", "relay", f"TR-{rng.randrange(10**6)}", "수신기", f"AB{rng.randrange(10**4)}"], rng.randint(1, 6))) + rng.choice([".pdf", ".hwpx", ""])
        variants = [name, name, name.upper(), "사본 " + name, "[공유]" + name, " " + name, name.replace("a", "а"), *(edited(rng, name) for _ in range(4))]
        rows += [(f"f{i}-{j}", v, "A" if j % 2 else " A", rng.choice(["s", "s ", "t", None]) if i < 20 else "s") for j, v in enumerate(variants)]
    rows += [("e1", "", "A", "s"), ("e2", " ", "A", "s"), ("n", None, "A", "s"), ("u", "ab", None, "s"), ("w", "ab", None, "s"), (None, "ab", None, "s"), rows[0]]
    d = spark.createDataFrame(rows, "file_id string, original_filename string, sosok string, site string")
    d.write.parquet(str(tmp_path / "chunks.parquet"))
    got = [tuple(r) for r in queries.similar_names(spark, str(tmp_path)).select("file_id", "before_id", "similarity").collect()]
    c = d.where("site IS NOT NULL").select("file_id", "original_filename", F.coalesce(F.trim("sosok"), F.lit("")).alias("o"), F.trim("site").alias("p")).distinct()
    a, b = c.alias("a"), c.alias("b")
    every = a.join(b, ["o", "p"]).where("struct(a.original_filename, a.file_id) < struct(b.original_filename, b.file_id)")
    want = [tuple(r) for r in every.select("b.file_id", "a.file_id", similarity(F.col("a.original_filename"), F.col("b.original_filename")).alias("s")).where("s > 0.85").collect()]
    assert len(want) > 300 and sorted(map(str, got)) == sorted(map(str, want))


def test_no_text_has_fewer_segments_than_needed():
    first, after = names.model(["aaaa", "ab"])
    for n in (7, 14, 40, 100):
        e = names.most_edits(n, 0.85)
        assert 1 - e / n > 0.85 >= 1 - (e + 1) / n
        _, s = names.segments("a" * n, e, first, after)
        assert len(s) == e + 1 and all(x[1] <= y[0] for x, y in zip(s, s[1:], strict=False))


def test_no_join_goes_through_the_driver_by_an_estimate(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("가나다라abcdefgh0123456789", k=40)) for _ in range(1500)]
    texts += [t[:20] + "-" + t[20:] for t in texts[:300]] + texts[300:1500]
    rows = [("k" * 3000 + str(i), t, "s") for i, t in enumerate(texts)]  # small as stored: keys pack well, and a text offers many runs
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "6m")
    try:
        got = names.similar_pairs(spark.createDataFrame(rows, "key string, text string, site string"), "key", "text", [F.col("site")]).selectExpr("substr(key_a, 3001)", "substr(key_b, 3001)").collect()
    finally:
        spark.conf.set(limit, before)
    want = [{i, 1500 + i} for i in range(1500)]
    assert sorted(sorted(map(int, r)) for r in got) == sorted(map(sorted, want))
