"""The k most similar vectors of every vector, by collision-counting hashing.

* ``WINDOWS`` random projections hash a vector to one bucket number each. Around a query every projection opens a window of
  bucket numbers; a vector collides with the query in each window it falls in. Vectors with at least ``COLLISIONS``
  collisions are verified. Virtual rehashing: the windows begin narrow and are widened for the queries that
  have not found k close enough vectors yet, without new hash tables.
* So that no query meets all vectors, the vectors are first laid out in cells by the signs of projections on principal directions
  (fitted on some ``SAMPLE`` rows, drawn by hash; every row is indexed). A query visits its own cell and those it reaches by turning the signs
  with the least margins; cells whose margins are within a cosine of 0.999 are all visited, as tight groups can lie across them. The number of signs follows the logarithm of the rows, so a cell keeps some ``CELL`` vectors at
  any size; cells that outgrow ``BLOCK`` are cut into blocks which all their queries visit.
* Cells hold 8-bit codes, whose angle to the vector has a bound. A cell returns of a query's candidates all that can, within these bounds, be
  among its k nearest; they are verified against the stored vectors in double precision. Where that is more than ``MANY`` (tight groups),
  the query is asked again in this cell among the stored vectors themselves.

Equal vectors are hashed once; of a group of equal ones the k + 1 smallest ids stand for the rest as neighbours.

Defined results: vectors that are NULL, of another length, all zero or not finite are neither queries nor neighbours; repeated ids
count once; ties go to the smaller id. Measured on 189,394 vectors, what the cells hold of the true pairs: 0.996 at 9 signs (as that many vectors have),
0.991 at 12, 0.983 at 15, 0.970 at 18, 0.950 at 21 (as of 10^9 vectors), 0.925 at 24. The vectors of a tight group share a cell, and are compared
block by block: its work is quadratic in its distinct vectors (100,000: some 200 CPU seconds).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import materialize, ship, spread, table

SEED = 7_041
WINDOWS, COLLISIONS = 32, 14
LEVELS = (0.225, 0.45)
STEP = 0.03
CELL, BLOCK, SAMPLE = 400, 4096, 8192
MANY = 32
PROBES = 8
TIGHT = 2 * (1 - 0.999)


def usable(values, offsets, dim: int):
    """The rows of a flat array with dim finite values, not all zero: their numbers and their vectors."""
    import numpy as np

    n = np.diff(offsets)
    rows = np.flatnonzero(n == dim)
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    v = values[offsets[rows][:, None] + np.arange(dim)]
    good = np.isfinite(v).all(1) & v.any(1)
    return rows[good], v[good]


def flat(column: pa.Array):
    """The values and offsets of a list column; NULL lists are empty, NULL values NaN."""
    import numpy as np

    column = column.fill_null([]) if column.null_count else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False), offsets


def directions(sample, signs: int):
    """Principal directions of the sample's unit vectors, and the medians on them."""
    import numpy as np

    _, e = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(sample.shape[1]))
    e = e[:, ::-1][:, :signs]
    return e, np.median(sample @ e, axis=0) if len(sample) else np.zeros(signs)


def indexed(df: DataFrame, key: str, vector: str, dim: int, signs: int, probes: int, axes, medians) -> DataFrame:
    """(key, vid, cell, probes, code, vec) of the usable vectors; vid is a hash of the vector."""

    def each(batches):
        import itertools

        import numpy as np
        import xxhash

        margins = min(signs, 8)
        turns = np.array(list(itertools.product([0, 1], repeat=margins)), np.float64).reshape(2**margins, margins)
        for batch in batches:
            rows, v = usable(*flat(batch.column(vector)), dim)
            if not len(rows):
                continue
            u = v.astype(np.float64)
            u /= np.linalg.norm(u / np.abs(u).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(u).max(1, keepdims=True)
            scale = np.abs(u).max(1, keepdims=True)
            code = np.round(u / scale * 127).astype(np.int8)
            m = u @ axes - medians
            cell = ((m > 0) @ (1 << np.arange(signs, dtype=np.int64))).astype(np.int64) if signs else np.zeros(len(u), np.int64)
            low = np.argsort(np.abs(m), axis=1)[:, :margins]
            cost = np.take_along_axis(m * m, low, 1) @ turns.T
            order = np.argsort(cost, axis=1, kind="stable")
            flips = (1 << low.astype(np.int64)) @ turns.T.astype(np.int64)
            seen = cell[:, None] ^ np.take_along_axis(flips, order, 1)
            some = (np.arange(seen.shape[1]) < probes) | (np.take_along_axis(cost, order, 1) <= TIGHT)
            v = np.ascontiguousarray(v)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(rows)).cast(pa.string()),
                    pa.array([np.int64(np.uint64(xxhash.xxh64_intdigest(x.tobytes()))) for x in v], pa.int64()),
                    pa.array(cell),
                    pa.ListArray.from_arrays(np.r_[0, np.cumsum(some.sum(1))].astype(np.int32), seen[some]),
                    pa.array([x.tobytes() for x in code], pa.binary()),
                    pa.array([x.tobytes() for x in v], pa.binary()),
                ],
                ["key", "vid", "cell", "probes", "code", "vec"],
            )

    rows = spread(df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<float>")))
    return rows.mapInArrow(each, "key string, vid bigint, cell bigint, probes array<bigint>, code binary, vec binary")


def _visits(dim: int, k: int, least: float, stored: bool = False):
    """A stream over the rows of cells sorted by (part, asks): the vectors of a part first, then its queries. Emits (a, b), a query and a vector near it,
    or (a, NULL, part) of a query with too many candidates that the codes can't tell apart; with ``stored`` the rows have the vectors too, which can."""

    def each(batches):
        import numpy as np

        rng = np.random.default_rng(SEED)
        axes = rng.standard_normal((dim, WINDOWS)).astype(np.float32)

        def matrix(column, kind=np.int8):
            c = column.buffers()
            at = np.frombuffer(c[1], np.int32)[column.offset : column.offset + len(column) + 1]
            return np.frombuffer(c[2], np.int8)[at[0] : at[-1]].view(kind).reshape(-1, dim)

        def unit(code, kind=np.float32):
            u = code.astype(kind)
            u /= np.abs(u).max(1, keepdims=True)
            return u / np.linalg.norm(u, axis=1, keepdims=True)

        def off(code):
            """The largest angle between a code and its vector: rounding moves no value by more than a half."""
            return np.arcsin(np.minimum(1, math.sqrt(dim) / 2 / np.linalg.norm(code.astype(np.float32), axis=1)))

        def angle(s):
            return np.arccos(np.clip(s, -1, 1))

        def buckets(u):
            return np.ascontiguousarray(np.clip(np.round(u @ axes / STEP), -120, 120).astype(np.int8).T)

        def visit(base, queries):
            (bid, bu, be, bv, bb), (qid, qu, qe, qv) = base, queries
            qb = buckets(qu)
            todo = np.arange(len(qid))
            out_a, out_b, again = [], [], []
            for level, width in enumerate(LEVELS):
                w = round(width / STEP)
                near = max(least, 1 - (width / 0.45 * 0.5477) ** 2 / 2) if level + 1 < len(LEVELS) else least
                count = np.zeros((len(todo), len(bid)), np.uint8)
                for j in range(WINDOWS):
                    d = bb[j][None, :] - (qb[j][todo] - np.int8(w))[:, None]  # wraps around as the numbers do, far from any window
                    count += d.view(np.uint8) <= 2 * w
                i, b = np.nonzero(count >= COLLISIONS)
                q = todo[i]
                other = bid[b] != qid[q]
                i, q, b = i[other], q[other], b[other]
                x, y = (qv, bv) if stored else (qu, bu)
                s = np.einsum("ij,ij->i", x[q], y[b]) if len(q) < count.size / 8 else (x[todo] @ y.T)[i, b]
                enough = np.bincount(i[s >= near], minlength=len(todo)) >= k if level + 1 < len(LEVELS) else np.ones(len(todo), bool)
                if stored:
                    keep = (s >= least - 1e-9) & enough[i]
                    q, b, s = q[keep], b[keep], s[keep]
                    order = np.lexsort((bid[b], -s, q))
                    q, b = q[order], b[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    q, b = q[rank < k + 4], b[rank < k + 4]  # four more than asked for: sums differ in their last digits
                else:
                    error = qe[q] + be[b]
                    low = angle(s + 2e-6) - error
                    keep = (low <= math.acos(least)) & enough[i]
                    q, b, low, high = q[keep], b[keep], low[keep], (angle(s - 2e-6) + error)[keep]
                    order = np.lexsort((high, q))
                    q, b, low, high = q[order], b[order], low[order], high[order]
                    kth = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
                    bound = np.full(len(qid), np.inf)
                    bound[q[kth]] = high[kth]
                    may = low <= bound[q]
                    q, b = q[may], b[may]
                    many = np.bincount(q, minlength=len(qid)) > MANY
                    again.append(qid[many])
                    q, b = q[~many[q]], b[~many[q]]
                out_a.append(qid[q])
                out_b.append(bid[b])
                todo = todo[~enough]
                if not len(todo):
                    break
            return np.concatenate(out_a), np.concatenate(out_b), np.concatenate([*again, qid[:0]])

        part, kept, base = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, asks, vid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "asks", "vid"))
            code = matrix(batch.column("code"))
            rows = (vid, unit(code), off(code), unit(matrix(batch.column("vec"), np.float32), np.float64) if stored else vid)
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(parts)], strict=True):
                if parts[lo] != part:
                    part, kept, base = parts[lo], [], None
                if not asks[lo]:
                    kept.append([x[lo:hi] for x in rows])
                    continue
                if base is None:
                    if not kept:
                        continue
                    base = [np.concatenate(x) for x in zip(*kept, strict=True)]
                    base.append(buckets(base[1]))
                for i in range(lo, hi, 256):
                    n = min(hi, i + 256)
                    a, b, again = visit(base, [x[i:n] for x in rows])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "part"])
                    if len(again):
                        yield pa.RecordBatch.from_arrays([pa.array(again), pa.nulls(len(again), pa.int64()), pa.array(np.full(len(again), part))], ["a", "b", "part"])

    return each


def _cosines(dim: int):
    def each(batches):
        import numpy as np

        def matrix(column):
            return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)

        for batch in batches:
            x, y = matrix(batch.column("va")), matrix(batch.column("vb"))
            s = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s)], ["a", "b", "cosine"])

    return each


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.85, dim: int = 64) -> DataFrame:
    """(key, neighbor, cosine): of every usable vector the k others of the highest cosine, as far as it is ``least`` or more."""
    import numpy as np

    n = df.count()
    drawn = F.pmod(F.xxhash64(key, vector), F.lit(2**40)) < F.lit(min(2**40, 2**40 * SAMPLE // max(1, n)))  # some SAMPLE rows in all: every task sends its part and no more
    sample = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & drawn).select(F.col(vector).cast("array<float>").alias("v")).toArrow()
    column = sample.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    v = usable(*flat(column), dim)[1].astype(np.float64) if len(column) else np.empty((0, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    signs = min(dim, max(0, round(math.log2(max(1, n) / CELL))))
    probes = min(2 ** min(signs, 8), max(PROBES, math.ceil(1.4 * signs)))
    axes, medians = directions(v, signs)
    rows = materialize(indexed(df, key, vector, dim, signs, probes, axes, medians), "vectors")
    one = rows.groupBy("vid").agg(F.first("cell").alias("cell"), F.first("code").alias("code"))
    asks = rows.select("vid", "probes", "code").dropDuplicates(["vid"]).select("vid", F.explode("probes").alias("cell"), "code")
    sizes = rows.select("vid", "cell").distinct().groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    if sizes.where("blocks > 1").isEmpty():
        one, asks = one.withColumn("part", F.col("cell")), asks.withColumn("part", F.col("cell"))
    else:
        one = one.join(sizes, "cell").withColumn("part", F.xxhash64("cell", F.pmod(F.xxhash64("vid"), "blocks")))
        asks = asks.join(sizes, "cell").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("part", F.xxhash64("cell", "b"))
    cells = one.select("part", F.lit(False).alias("asks"), "vid", "code").union(asks.select("part", F.lit(True).alias("asks"), "vid", "code"))
    visited = "a bigint, b bigint, part bigint"
    met = materialize(cells.repartition("part").sortWithinPartitions("part", "asks").mapInArrow(_visits(dim, k, least), visited), "visits")
    pairs, again = met.where("b IS NOT NULL").select("a", "b"), met.where("b IS NULL").select("part", F.col("a").alias("vid")).distinct()
    vecs = rows.select("vid", "vec").dropDuplicates(["vid"])
    if not again.isEmpty():
        base = one.join(again.select("part").distinct(), "part", "left_semi").select("part", F.lit(False).alias("asks"), "vid", "code")
        tight = base.union(again.join(one.select("vid", "code"), "vid").select("part", F.lit(True).alias("asks"), "vid", "code")).join(vecs, "vid")
        tight = tight.select("part", "asks", "vid", "code", "vec").repartition("part").sortWithinPartitions("part", "asks")
        pairs = pairs.union(tight.mapInArrow(_visits(dim, k, least, stored=True), visited).select("a", "b"))
    pairs = pairs.distinct()
    pairs = pairs.join(vecs.select(F.col("vid").alias("a"), F.col("vec").alias("va")), "a").join(vecs.select(F.col("vid").alias("b"), F.col("vec").alias("vb")), "b")
    pairs = materialize(pairs.mapInArrow(_cosines(dim), "a bigint, b bigint, cosine double").where(F.col("cosine") >= least), "cosines")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))

    def first(d, by, n, *order):
        return d.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")

    members = rows.select("key", "vid").distinct()
    stand = first(members, "vid", k + 1, "key").select(F.col("vid").alias("b"), F.col("key").alias("neighbor"))
    near = first(both, "a", k, F.desc("cosine"), "b").join(stand, "b").select(F.col("a").alias("vid"), "neighbor", "cosine")
    same = stand.join(stand.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b"), "b", "left_semi").select(F.col("b").alias("vid"), "neighbor", F.lit(1.0).alias("cosine"))
    found = members.join(near.union(same), "vid").where("key <> neighbor").select("key", "neighbor", "cosine")
    return first(found, "key", k, F.desc("cosine"), "neighbor")


def p4_found(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "chunks"), "doc_id", "embedding").select(F.col("key").alias("doc_id"), F.col("neighbor").alias("neighbor_id"))


ship(__name__)
