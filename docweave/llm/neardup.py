"""Near-duplicate records by a signature-coordinate inverted join.

1. Each text becomes the set of its runs of ``size`` successive words (or characters), and the set a signature of ``COORDINATES``
   values, each made of ``ROWS`` minima under random hashes. Rows of one set share a set id; only sets are compared, so copies cost nothing.
2. Sets are posted under each coordinate-value pair. A sorted stream over the postings skips values that one set
   has alone (nearly all) and emits the pairs of the others; lists too long for that are joined block by block. Prefix merging: with
   the lists ordered by length, sets that share ``LEAST`` = 2 of them share one that isn't the longest of either. So a set's longest list, if it is
   too long for the stream, makes no pairs; it is looked up (skipped to) only for pairs met elsewhere. Sets that have but one long list in common cost nothing.
3. Collisions are counted by pair; a value's place among a set's coordinates is part of the posted key, so a pair
   meets at most once a coordinate. Merging skips what cannot count: lists of one set, and repeated postings of a set.
4. Pairs with at least ``LEAST`` of ``COORDINATES`` matches are verified by the sets themselves.

With 3 minima a coordinate two sets of similarity s agree in one with s^3; at s = 0.6 fewer than 2 of 48 agree with
a probability of 1.2e-4, at 0.8 of under 1e-12. The verification compares 32-bit hashes of the runs, so a similarity can be off by
one run in some 10^5 pairs of usual texts.

Defined results: NULL texts, and texts of fewer than ``size`` words, have no partners (``short="whole"``: a short text is its
own run, so that equal ones are partners). A repeated key counts once. No partner is dropped, no list capped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.form import GROUP, bodies, crossed, paired, requested_names, stored_names, with_form
from docweave.session import materialize, once, ship, table

COORDINATES, ROWS, LEAST = 48, 3, 2
LIST = 512
SEED = 20_251


@once
def hash_factors():
    import numpy as np

    return np.random.default_rng(SEED).integers(1, 2**63, COORDINATES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(text: str, size: int, unit: str, short: str, words: dict):
    """The sorted distinct 64-bit hashes of a text's runs."""
    import numpy as np
    import xxhash

    if unit == "char":
        h = mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    else:
        if len(words) > 300_000:
            words.clear()
        ids = []
        for w in text.split(" ") if text else ():
            at = words.get(w)
            if at is None:
                at = words[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            ids.append(at)
        h = np.array(ids, np.uint64)
    n = len(h) - size + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint64) if short == "whole" and text else np.empty(0, np.uint64)
    s = h[:n]
    for i in range(1, size):
        s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(s)


def signature(s, salt: int):
    """The postings of a set: of each coordinate a hash of the coordinate, its minima and the salt."""
    import numpy as np

    a, low = hash_factors(), None
    for i in range(0, len(s), 4096):
        part = (s[None, i : i + 4096] * a[:, None]).min(1)
        low = part if low is None else np.minimum(low, part)
    v = np.arange(COORDINATES, dtype=np.uint64) + np.uint64(salt)
    for r in range(ROWS):
        v = mixed(v * np.uint64(0x9E3779B97F4A7C15) + low[r * COORDINATES : (r + 1) * COORDINATES])
    return v


def signed(df: DataFrame, key: str, text: str, size: int = 5, unit: str = "word", short: str = "none", scope: str | None = None, side: str | None = None) -> DataFrame:
    """(key, set_id, side, sig, runs), written to the shared folder; sig and runs once a partition and set. Rows of different scope never match; text is in one form, lower case."""
    cols = [F.col(key).alias("key"), F.col(text).alias("text"), (F.col(scope) if scope else F.lit(0)).cast("long").alias("scope"), (F.col(side) if side else F.lit(0)).cast("int").alias("side")]

    def each(batches):
        import numpy as np
        import xxhash

        words, seen = {}, set()
        for batch in batches:
            keys, ids, sides, sigs, sets = [], [], [], [], []
            for k, t, sc, sd in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "scope", "side")), strict=True):
                s = runs(t, size, unit, short, words)
                if not len(s):
                    continue
                salt = (sc * 2 + 1) & (2**64 - 1)
                at = int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed=(salt ^ sd << 1) & (2**63 - 1)))))
                keys.append(k)
                ids.append(at)
                sides.append(sd)
                if at in seen:
                    sigs.append(None)
                    sets.append(None)
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(at)
                sigs.append(signature(s, salt).view(np.int64))
                sets.append((s >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(sides, pa.int32()), pa.array(sigs, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))], ["key", "set_id", "side", "sig", "runs"])

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(*cols)
    return materialize(rows.mapInArrow(each, "key string, set_id bigint, side int, sig array<bigint>, runs array<int>"), "signed")


def _pairs_of_postings(two_sided: bool, longest: int):
    """A stream over postings sorted by (key, id): pairs (a, b) of the lists of 2 to ``longest`` ids; rows of longer lists as (a, NULL, key, side)."""

    def each(batches):
        import numpy as np

        left = None
        long_key = None

        def done(key, ids, side):
            nonlocal long_key
            out_a, out_b, hot = [], [], []
            if not len(key):
                return
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids, side = key[new], ids[new], side[new]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[start, len(key)])
            is_long = (length > longest) | (key[start] == long_key if long_key is not None else False)
            for n in np.unique(length[~is_long & (length > 1)]):
                at = start[~is_long & (length == n)]
                i, j = np.triu_indices(n, 1)
                a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                if two_sided:
                    cross = side[a] != side[b]
                    a, b = a[cross], b[cross]
                    a, b = np.where(side[a] == 0, a, b), np.where(side[a] == 0, b, a)
                out_a.append(ids[a])
                out_b.append(ids[b])
            for at, n in zip(start[is_long], length[is_long], strict=True):
                hot.append(np.arange(at, at + n))
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                for i in range(0, len(a), 100_000):
                    n = len(a[i : i + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(a[i : i + n]), pa.array(b[i : i + n]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], ["a", "b", "key", "side"])
            if hot:
                h = np.concatenate(hot)
                yield pa.RecordBatch.from_arrays([pa.array(ids[h]), pa.nulls(len(h), pa.int64()), pa.array(key[h]), pa.array(side[h])], ["a", "b", "key", "side"])

        for batch in batches:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "side"))
            if not len(now[0]):
                continue
            if left is not None:
                now = tuple(np.concatenate(x) for x in zip(left, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1]))  # where the last, perhaps unfinished, list begins
            yield from done(*(x[:cut] for x in now))
            left = tuple(x[cut:] for x in now)
            if len(left[0]) > 4 * longest:  # too long for sure: let it go at once
                long_key = left[0][-1]
                yield from done(*left)
                left = None
        if left is not None:
            yield from done(*left)

    return each


def colliding(signed_rows: DataFrame, two_sided: bool = False, longest: int = LIST) -> DataFrame:
    """(a, b): set ids that collide in at least one coordinate, with the number of their collisions."""
    posts = signed_rows.where("sig IS NOT NULL").select(F.explode("sig").alias("key"), F.col("set_id").alias("id"), *(["side"] if two_sided else []))
    posts = posts.repartition("key").sortWithinPartitions("key", "id")
    out = materialize((posts if two_sided else posts.withColumn("side", F.lit(0))).mapInArrow(_pairs_of_postings(two_sided, longest), "a bigint, b bigint, key bigint, side int"), "pairs")
    pairs = out.where("b IS NOT NULL").select("a", "b")
    if out.where("b IS NULL").isEmpty():
        return pairs.groupBy("a", "b").agg(F.count("*").alias("matches"))
    hot = out.where("b IS NULL").select("key", F.col("a").alias("id"), "side").distinct()
    hot = materialize(hot.join(hot.groupBy("key").agg(F.count("*").alias("n")), "key"), "hot")
    last = hot.groupBy("id").agg(F.max_by("key", F.struct("n", "key")).alias("last"))
    first = hot.join(last, "id").where("key <> last")  # a set's longest list makes no pairs
    met = paired(first.select("key", "id", "side"), ["key"], longest)
    met = met.where("x.side = 0 AND y.side = 1" if two_sided else "x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    met = materialize(pairs.union(met).groupBy("a", "b").agg(F.count("*").alias("matches")), "met")
    # What two sets have in a list left out by one of them, counted where it decides: the list is looked up among the other's.
    few = met.where(F.col("matches") < LEAST)
    posts = hot.select("key", "id")
    looked = []
    for one, other in (("a", "b"), ("b", "a")):
        asked = few.join(last.select(F.col("id").alias(one), F.col("last").alias("key")), one).select("a", "b", "key")
        looked.append(asked.join(posts.withColumnRenamed("id", other), ["key", other], "left_semi").select("a", "b", "key"))
    more = looked[0].union(looked[1]).distinct().select("a", "b", F.lit(1).cast("long").alias("matches"))
    return met.union(more).groupBy("a", "b").agg(F.sum("matches").alias("matches"))


def similar_sets(signed_rows: DataFrame, threshold: float = 0.8, two_sided: bool = False) -> DataFrame:
    """(a, b, similarity) of the sets whose similarity is at least the threshold."""
    found = materialize(colliding(signed_rows, two_sided).where(F.col("matches") >= LEAST).select("a", "b"), "candidates")
    ids = found.select(F.col("a").alias("set_id")).union(found.select(F.col("b").alias("set_id"))).distinct()
    sets = signed_rows.where("runs IS NOT NULL").select("set_id", "runs").join(ids, "set_id", "left_semi").dropDuplicates(["set_id"])
    sets = materialize(sets, "sets")
    both = found.join(sets.select(F.col("set_id").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("runs").alias("rb")), "b")
    shared = F.size(F.array_intersect("ra", "rb"))
    both = both.select("a", "b", shared.alias("shared"), (F.size(F.array_distinct("ra")) + F.size(F.array_distinct("rb")) - shared).alias("either"))
    return both.where(F.col("shared") >= F.lit(threshold) * F.col("either") - 1e-9).select("a", "b", (F.col("shared") / F.col("either")).alias("similarity"))


def record_pairs(signed_rows: DataFrame, sets: DataFrame, two_sided: bool = False) -> DataFrame:
    """Pairs of keys: the members of similar sets and, on one side, the members of one set."""
    members = signed_rows.select("key", "set_id")  # a key may come again: the pairs are made distinct at the end
    a, b = members.select(F.col("set_id").alias("a"), F.col("key").alias("x")), members.select(F.col("set_id").alias("b"), F.col("key").alias("y"))
    many = materialize(signed_rows.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1"), "many")
    if many.where(F.col("n") > GROUP).isEmpty():
        pairs = sets.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    else:  # the copies of one text are more than a task should meet: blocks of them meet one by one
        left = materialize(crossed(a, sets.select("a", "b"), ["a"]).select("b", "x"), "left")
        pairs = crossed(left, b, ["b"]).select("x", "y")
    if not two_sided:
        m = members.join(many.select("set_id"), "set_id", "left_semi").distinct()
        pairs = pairs.union(paired(m, ["set_id"]).where("x.key < y.key").select(F.col("x.key").alias("x"), F.col("y.key").alias("y")))
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def classes(signed_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per key: class_id (the smallest key of its connected class), links (similar other texts) and copies (other records of the same text)."""
    pairs = materialize(sets.select("a", "b"), "links")
    edges = materialize(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(edges.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")), "labels")
    while True:  # each round takes the least label around, then the label's own label: the rounds are logarithmic in the diameter
        around = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").select(F.col("a").alias("v"), "label")
        least = around.union(labels.select("v", "label")).groupBy("v").agg(F.min("label").alias("label"))
        jump = least.alias("l").join(labels.select(F.col("v").alias("label"), F.col("label").alias("further")), "label").select("v", F.least("label", "further").alias("label"))
        new = materialize(jump, "labels")
        if new.join(labels.withColumnRenamed("label", "old"), "v").where("label <> old").isEmpty():
            break
        labels = new
    degree = edges.groupBy(F.col("a").alias("set_id")).agg(F.count("*").alias("links"))
    members = signed_rows.select("key", "set_id").distinct().join(signed_rows.groupBy("set_id").agg((F.countDistinct("key") - 1).alias("copies"), F.min("key").alias("least")), "set_id")
    members = members.join(labels.select(F.col("v").alias("set_id"), "label"), "set_id", "left").join(degree, "set_id", "left")
    members = members.select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "set_id").alias("class"), "least")
    names = members.groupBy("class").agg(F.min("least").alias("class_id"))
    return members.join(names, "class").select("key", "class_id", "links", "copies")


def signed_bodies(chunks: DataFrame, size: int, short: str = "none") -> DataFrame:
    return signed(with_form(bodies(chunks), "body", "form", "lower(form)", keep_text=False), "doc_id", "form", size, short=short)


def p2_found(spark, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    texts = signed_bodies(chunks, 3)
    found = record_pairs(texts, similar_sets(texts, 0.6))
    names = stored_names(chunks).withColumn("side", F.lit(0)).union(requested_names(table(spark, sf_dir, "duplicate_requests")).withColumn("side", F.lit(1)))
    names = names.select("key", "name", "side", F.xxhash64("s.sosok", "s.site").alias("scope"))
    names = signed(with_form(names, "name", "form", "lower(form)", keep_text=False), "key", "form", 3, "char", "whole", "scope", "side")
    named = record_pairs(names, similar_sets(names, 0.6, two_sided=True), two_sided=True)
    return found.select(F.lit("content").alias("field_name"), "key_a", "key_b").union(named.select(F.lit("filenames").alias("field_name"), "key_a", "key_b"))


def p2_classes(spark, sf_dir: str) -> DataFrame:
    """Every chunk with the class of its near-duplicates: runs of five words (a shorter text is one run), similarity 0.8 or more. A chunk without text is a class of its own."""
    chunks = table(spark, sf_dir, "chunks")
    texts = signed_bodies(chunks, 5, "whole")
    found = classes(texts, similar_sets(texts, 0.8)).withColumnRenamed("key", "doc_id")
    rest = chunks.where("doc_id IS NOT NULL").select("doc_id").distinct().join(texts.select(F.col("key").alias("doc_id")), "doc_id", "left_anti")
    return found.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("copies")))


ship(__name__)
