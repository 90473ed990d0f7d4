"""Items packed into containers of fixed capacity by non-negative least squares over their length histogram.

A text longer than the capacity is cut: its full pieces fill a container each, the rest is an item like any other. Items are counted
by length in at most ``BINS`` bins (rounded up, so that a container never overflows). Over this histogram, whose size doesn't
follow the data, the driver enumerates the combinations of up to ``DEPTH`` lengths that fill a container, solves for how
often each is to be used (non-negative least squares), rounds as far as the counts allow, and packs what is left greedily, longest first, each gap
with the longest length that fits. The result is a list of patterns with repeat counts.

Items find their container without coming together anywhere: an item's rank among those of its length is the offset of its bucket plus
its rank in the bucket, of which there are so many that one holds some ``BUCKET`` items of a length however often it comes; ranks are laid over the patterns by bisection.

Defined results: NULL and empty texts (no tokens) are in no container; repeated rows are packed each; equal lengths are ranked by key.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.tokens import VOCABULARY, with_tokens
from docweave.session import materialize, ship, spread, table

BINS, DEPTH, BUCKET = 512, 3, 20_000


def combinations(lengths, capacity: int):
    """Index triples (-1: none) of the lengths that fill the capacity exactly, or miss it by no more than any length could fill."""
    import numpy as np

    n, where = len(lengths), {int(v): i for i, v in enumerate(lengths)}
    out = [(where[capacity], -1, -1)] if capacity in where else []
    for i in range(n):
        a = int(lengths[i])
        if (b := capacity - a) in where and b <= a:
            out.append((i, where[b], -1))
        for j in range(i + 1):
            c = capacity - a - int(lengths[j])
            if 0 < c <= lengths[j] and c in where:
                out.append((i, j, where[c]))
    return np.array(out, np.int64).reshape(-1, 3)


def least_squares(combos, counts, rounds: int = 200, at_once: int = 16):
    """Repeats x >= 0 of the combinations, the least squares fit of their lengths to the counts; an active-set method, so that few x are not 0."""
    import numpy as np

    n, m = len(counts), len(combos)
    x, active = np.zeros(m), np.empty(0, np.int64)
    used, at, counts = combos >= 0, np.maximum(combos, 0), np.asarray(counts, float)
    inside, columns = np.zeros(m, bool), np.empty((n, 0))
    for _ in range(rounds if m else 0):
        rest = counts - columns @ x[active]
        gain = np.where(used, rest[at], 0).sum(1) / np.sqrt(used.sum(1))
        gain[inside] = -1
        taken, new = np.zeros(n, bool), []
        for k in np.argsort(-gain, kind="stable")[: 64 * at_once]:  # the best that have no length in common
            if gain[k] <= max(0.25, 1e-6 * counts.max()) or len(new) == at_once:
                break
            if not taken[combos[k][used[k]]].any():
                taken[combos[k][used[k]]] = True
                new.append(k)
        if not new:
            break
        active = np.concatenate([active, new])
        inside[new] = True
        columns = np.column_stack([columns, *(np.bincount(combos[k][used[k]], minlength=n).astype(float) for k in new)])
        while len(active):
            z = np.linalg.solve(columns.T @ columns + 1e-6 * np.eye(len(active)), columns.T @ counts)
            bad = z <= 1e-9
            if not bad.any():
                x[active] = z
                break
            old = x[active]
            if (stuck := bad & (old <= 1e-9)).any():
                drop = stuck
            else:
                step = np.min(old[bad] / (old[bad] - z[bad]))
                x[active] = np.maximum(old + step * (z - old), 0)
                drop = bad & (x[active] <= 1e-9)
            x[active[drop]] = 0
            inside[active[drop]] = False
            active, columns = active[~drop], columns[:, ~drop]
    return x


def greedy(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeat, {length: how many}) patterns for all items: longest first, each gap with the longest that fits."""
    import bisect

    left, out = dict(counts), []
    order = sorted(k for k, v in left.items() if v)
    while order:
        gap, pattern = capacity, {}
        while gap and (at := bisect.bisect_right(order, gap)):
            while at and left[order[at - 1]] <= pattern.get(order[at - 1], 0):
                at -= 1
            if not at:
                break
            k = order[at - 1]
            n = min(gap // k, left[k] - pattern.get(k, 0))
            pattern[k] = pattern.get(k, 0) + n
            gap -= n * k
        repeat = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= repeat * n
            if not left[k]:
                order.remove(k)
        out.append((repeat, pattern))
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeat, {length: how many}) that use every counted item exactly once."""
    import numpy as np

    left = {k: int(v) for k, v in counts.items() if v > 0}
    lengths = np.array(sorted(left), np.int64)
    combos = combinations(lengths, capacity)
    x = least_squares(combos, np.array([left[int(k)] for k in lengths]))
    out = []
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        need: dict[int, int] = {}
        for i in combos[k]:
            if i >= 0:
                need[int(lengths[i])] = need.get(int(lengths[i]), 0) + 1
        n = min([round(float(x[k])), *(left[length] // c for length, c in need.items())])
        if n > 0:
            out.append((n, need))
            for length, c in need.items():
                left[length] -= n * c
    return out + greedy(left, capacity)


def pack(items: DataFrame, key: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """One row per piece: the other columns, spec_name, piece_no, token_start, piece_tokens, container_id and the container's capacity."""
    import numpy as np

    names = list(capacities)
    spec = F.explode(F.array(*(F.struct(F.lit(i).alias("spec"), F.lit(n).alias("spec_name"), F.lit(capacities[n]).cast("long").alias("capacity")) for i, n in enumerate(names)))).alias("s")
    d = items.where(F.col(size) > 0).select("*", spec).select("*", "s.*").drop("s")
    full = F.floor(F.col(size) / F.col("capacity"))
    d = d.withColumn("_full", F.when(F.col(size) % F.col("capacity") == 0, full - 1).otherwise(full))
    rest = d.withColumn("piece_no", F.col("_full") + 1).withColumn("token_start", F.col("_full") * F.col("capacity")).withColumn("piece_tokens", F.col(size) - F.col("token_start")).drop("_full")
    whole = d.where("_full > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("long"), "_full"))).withColumn("token_start", (F.col("piece_no") - 1) * F.col("capacity"))
    whole = whole.withColumn("piece_tokens", F.col("capacity")).withColumn("container_id", F.concat_ws(":", F.lit("d"), F.col(key).cast("string"), F.col("piece_no").cast("string"))).drop("_full")
    width = F.ceil(F.col("capacity") / BINS)
    rest = rest.withColumn("_bin", F.ceil(F.col("piece_tokens") / width))
    rows = rest.groupBy("spec", "_bin").agg(F.count("*").alias("n")).collect()  # at most BINS rows a spec
    buckets = max([1, *(-(-int(r["n"]) // BUCKET) for r in rows)])
    rest = rest.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = materialize(rest.groupBy("spec", "_bin", "_bucket").agg(F.count("*").alias("n")), "sizes")
    codes = {"base": [], "each": [], "code": []}
    for i, name in enumerate(names):
        c = capacities[name]
        units = c // -(-c // BINS)
        counts = {int(r["_bin"]): int(r["n"]) for r in rows if r["spec"] == i}
        base, at = 0, dict.fromkeys(counts, 0)
        for repeat, need in patterns({k: v for k, v in counts.items() if k <= units}, units):
            for length, k in need.items():
                codes["code"].append((i * (BINS + 2) + length) * 2**40 + at[length])
                codes["base"].append(base)
                codes["each"].append(k)
                at[length] += repeat * k
            base += repeat
        for length in counts:  # a bin rounded up beyond the capacity holds one item a container
            if length > units:
                codes["code"].append((i * (BINS + 2) + length) * 2**40)
                codes["base"].append(base)
                codes["each"].append(1)
                base += counts[length]
    order = np.argsort(np.array(codes["code"], np.int64), kind="stable")
    code, base, each_ = (np.array(codes[c], np.int64)[order] for c in ("code", "base", "each"))
    offsets = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("spec", "_bin").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = rest.withColumn("_rank", F.row_number().over(Window.partitionBy("spec", "_bin", "_bucket").orderBy(key)) - 1)
    ranked = ranked.join(offsets.select("spec", "_bin", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before")), ["spec", "_bin", "_bucket"])
    ranked = ranked.withColumn("_code", (F.col("spec") * (BINS + 2) + F.col("_bin")).cast("long") * F.lit(2**40) + F.col("_rank") + F.col("_before"))
    kept = [c for c in ranked.columns if c not in ("_code", "_rank", "_before", "_bin", "_bucket")]

    def place(batches):
        for batch in batches:
            c = batch.column("_code").to_numpy(zero_copy_only=False)
            i = np.searchsorted(code, c, side="right") - 1
            number = base[i] + (c - code[i]) // each_[i] if len(c) else c
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array([f"c:{n}" for n in number], pa.string())], [*kept, "container_id"])

    schema = ranked.select(*kept, F.lit("").alias("container_id")).schema
    return ranked.mapInArrow(place, schema).unionByName(whole).drop("spec")


def sized_documents(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return materialize(with_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "text", vocabulary=vocabulary), "sizes")


def p7_packed(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container, for each of the specs."""
    specs = {r["spec_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_specs").collect()}
    return pack(sized_documents(spark, sf_dir).select("doc_id", "n_tokens"), "doc_id", "n_tokens", specs).select("spec_name", "container_id", "doc_id", "piece_no", "token_start", "piece_tokens")


def p7_report(spark, sf_dir: str) -> DataFrame:
    """Of each spec the containers, the tokens in them and the share of space used."""
    specs = table(spark, sf_dir, "pack_specs")
    used = p7_packed(spark, sf_dir).groupBy("spec_name", "container_id").agg(F.sum("piece_tokens").alias("t")).groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return used.join(specs, "spec_name").withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p7_checked(spark, sf_dir: str) -> DataFrame:
    """Of each spec whether the packing keeps to its rules: documents placed, and counts, all 0, of containers over their capacity, of documents whose pieces leave out or repeat a token, and of documents cut that would fit."""
    sized = sized_documents(spark, sf_dir).select("doc_id", "n_tokens")
    specs = table(spark, sf_dir, "pack_specs")
    p = pack(sized, "doc_id", "n_tokens", {r["spec_name"]: r["capacity_tokens"] for r in specs.collect()})
    over = p.groupBy("spec_name", "container_id").agg(F.sum("piece_tokens").alias("t")).join(specs, "spec_name").groupBy("spec_name").agg(F.count(F.when(F.col("t") > F.col("capacity_tokens"), 1)).alias("overfull"))
    docs = p.groupBy("spec_name", "doc_id").agg(F.count("*").alias("k"), F.sum("piece_tokens").alias("t"), F.max("n_tokens").alias("n"), F.max("capacity").alias("capacity"), F.sum("token_start").alias("at"))
    gaps = (F.col("t") != F.col("n")) | (F.col("at") != F.col("capacity") * F.col("k") * (F.col("k") - 1) / 2)  # pieces start at 0, capacity, 2 x capacity ...
    docs = docs.groupBy("spec_name").agg(F.count("*").alias("documents"), F.count(F.when(gaps, 1)).alias("torn"), F.count(F.when((F.col("k") > 1) & (F.col("n") <= F.col("capacity")), 1)).alias("cut_in_vain"))
    return docs.join(over, "spec_name").select("spec_name", "documents", "overfull", "torn", "cut_in_vain")


ship(__name__)
