"""Sources mixed to target shares by Poisson replication.

A record is used as often as a Poisson distribution says that is inverted at a number hashed from its key and its source's seed: the counts
need no coordination, and repeat from run to run. The mean is its source's rate, chosen so that the expected count, cut at the source's
``max_repeats``, gives the source its share of the total. What a source really gets is then measured for a grid of seeds and means, in
one pass over the sizes a partition at a time, and again for finer means; the seed and mean that come closest are taken. Records are
exploded by their counts and shuffled globally by a second hash.

The total is a parameter (in units of size). By default it is the largest that every source with records can supply at ``HEADROOM`` of its cap, so that
every mean is finite. Where records are too few and too large for all shares of that total to be met, the source that allows
least is taken as short, and so on: it gives what it can, and the total is the largest that the others allow. Of these mixtures the one with the
fewest sources over a point off their targets is taken. It reports, of every target:

* ``reached``: its share is within ``TOLERANCE`` of its goal; the goal is its target, or its part of what short and missing sources leave;
* ``short``: it can't supply its target at this total; ``coarse``: its records are too large to come that near;
* ``no records``: nothing to use, share 0.

Defined results: records of NULL or untargeted sources, and without tokens, are not used; a NULL or non-positive cap or share gives 0.
Repeated keys of one source share their count. Several targets of one source are refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.pack import sized_documents
from docweave.session import ship, table

SEED, SEEDS, HEADROOM, TOLERANCE = 90_217, 8, 0.95, 0.01
SPREADS, GRID = (0.6, 0.04), 25


def cut_points(mean: float, cap: int) -> list[float]:
    """P(Poisson(mean) <= k) for k below the cap: a hashed number's count is how many of them it exceeds."""
    if mean <= 0:
        return [1.0] * cap
    out, term, total = [], math.exp(-mean), 0.0
    for k in range(cap):
        total += term
        out.append(total)
        term *= mean / (k + 1)
    return out


def expected(mean: float, cap: int) -> float:
    return sum(1 - p for p in cut_points(mean, cap))


def mean_for(rate: float, cap: int) -> float:
    """The Poisson mean whose counts, cut at cap, have the mean ``rate``; the rate is taken to be below the cap."""
    low, high = 0.0, 1.0
    while expected(high, cap) < rate and high < 700:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid, cap) < rate else (low, mid)
    return high


def uniform(key, seed: int):
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**53)).cast("double") / float(2**53)


@dataclass
class Recipe:
    """Of each source the seed and mean of its counts, its goal in units of size, and how near that comes."""

    total: float = 0.0
    draws: dict[str, tuple[int, float]] = field(default_factory=dict)
    goals: dict[str, float] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)
    have: dict[str, int] = field(default_factory=dict)


def measured(usable: DataFrame, key: str, source: str, size: str, tries: dict[str, list[tuple[int, list[float]]]]) -> dict[str, list[int]]:
    """Of each source the size it would get by each try (seed, cut points), all in one pass; a partition sends a row a source."""

    def each(batches):
        import numpy as np

        total = {s: np.zeros(len(t), np.int64) for s, t in tries.items()}
        cuts = {s: (np.array([x for x, _ in t]), np.array([c for _, c in t])) for s, t in tries.items()}
        for batch in batches:
            names = np.array(batch.column("source").to_pylist(), object)
            n = batch.column("size").to_numpy()
            u = np.stack([c.to_numpy() for c in batch.columns[2:]], 1)
            for s in set(names.tolist()):
                seed, cut = cuts[s]
                for i in np.array_split(rows := np.flatnonzero(names == s), len(rows) // 2048 + 1):
                    mine = u[i][:, seed]
                    count = sum((mine > cut[:, k]).astype(np.int64) for k in range(cut.shape[1]))
                    total[s] += n[i] @ count
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.int64()))], ["source", "got"])

    u = [uniform(key, SEED + i).alias(f"u{i}") for i in range(SEEDS)]
    rows = usable.where(F.col(source).isin(list(tries))).select(F.col(source).cast("string").alias("source"), F.col(size).cast("long").alias("size"), *u)
    parts = rows.mapInArrow(each, "source string, got array<bigint>").select("source", F.posexplode("got").alias("i", "got"))
    out = {s: [0] * len(t) for s, t in tries.items()}
    for r in parts.groupBy("source", "i").agg(F.sum("got").alias("got")).collect():  # targets x SEEDS x GRID rows
        out[r["source"]][r["i"]] = int(r["got"])
    return out


def plan(sized: DataFrame, key: str, source: str, size: str, targets: list[tuple[str, float, int]], total: float | None = None) -> Recipe:
    """How each source is to be drawn."""
    if len({t[0] for t in targets}) < len(targets):
        raise ValueError("several targets of one source")
    want = {s: (share, cap) for s, share, cap in targets if s is not None and (share or 0) > 0 and (cap or 0) > 0}
    usable = sized.where(F.col(source).isin(list(want)) & (F.col(size) > 0))
    have = {r[0]: int(r[1]) for r in usable.groupBy(source).agg(F.sum(size)).collect()}  # a row a target
    want = {s: v for s, v in want.items() if s in have}
    if not want:
        return Recipe()
    most = {s: HEADROOM * cap * have[s] for s, (_, cap) in want.items()}
    whole = sum(share for share, _ in want.values())

    def goals(short: frozenset, total: float | None) -> tuple[float, dict[str, float]]:
        """Short sources give the most they can, the others share the rest."""
        shares = {s: want[s][0] / whole for s in want}
        given = sum(most[s] for s in short)
        free = sum(shares[s] for s in want if s not in short)
        if len(short) == len(want):
            return given, {s: most[s] for s in want}
        if total is None:
            total = min((most[s] * free / shares[s] for s in want if s not in short), default=0.0) + given
        return total, {s: most[s] if s in short else max(0.0, total - given) * shares[s] / free for s in want}

    def drawn(short: frozenset, total: float, goal: dict[str, float]) -> tuple[Recipe, tuple[int, float]]:
        best = {s: (0, mean_for(min(goal[s], most[s]) / have[s], want[s][1])) for s in want}
        for turn, spread in enumerate(SPREADS):
            seeds = {s: range(SEEDS) if not turn else [best[s][0]] for s in want}
            steps = [1 + spread * (2 * i / (GRID - 1) - 1) for i in range(GRID)]
            grid = {s: [(i, m) for i in seeds[s] for m in ([best[s][1]] if s in short else [best[s][1] * x for x in steps])] for s in want}
            got = measured(usable, key, source, size, {s: [(i, cut_points(m, want[s][1])) for i, m in g] for s, g in grid.items()})
            near = {s: min(range(len(g)), key=lambda i, s=s, g=g: (abs(got[s][i] - goal[s]), abs(g[i][1] - best[s][1]), i)) for s, g in grid.items()}
            best = {s: grid[s][near[s]] for s in want}
        reached = {s: got[s][near[s]] for s in want}
        every = sum(reached.values()) or 1
        off = {s: abs(reached[s] / every - goal[s] / total) for s in want}
        status = {s: "short" if s in short else "reached" if off[s] <= TOLERANCE else "coarse" for s in want}
        missed = {s: abs(reached[s] / every - want[s][0] / whole) for s in want}
        return Recipe(total, best, goal, status, have), (sum(v > TOLERANCE for v in missed.values()), sum(missed.values()))

    if total:
        short = frozenset()
        while more := {s for s, g in goals(short, total)[1].items() if s not in short and most[s] < g}:
            short |= more
        return drawn(short, *goals(short, total))[0]
    found = []
    short = frozenset()
    while len(short) < len(want):
        found.append(drawn(short, *goals(short, None)))
        if not found[-1][1][0]:
            break
        short |= {min((s for s in want if s not in short), key=lambda s: most[s] / want[s][0])}
    return min(found, key=lambda r: r[1])[0]  # the fewest sources that miss their target, by the least


def mix(sized: DataFrame, key: str, source: str, size: str, targets: list[tuple[str, float, int]], total: float | None = None, recipe: Recipe | None = None) -> DataFrame:
    """The mixture: a row per use, with copy_no from 1 and shuffle_key, in the order of shuffle_key."""
    recipe = recipe or plan(sized, key, source, size, targets, total)
    caps = {s: c for s, _, c in targets}
    if not recipe.draws:
        return sized.where("false").select("*", F.lit(1).alias("copy_no"), F.lit(0).cast("long").alias("shuffle_key"))
    seed = F.create_map(*(x for s, (i, _) in recipe.draws.items() for x in (F.lit(s), F.lit(SEED + i))))[F.col(source)]
    cut = F.create_map(*(x for s, (_, m) in recipe.draws.items() for x in (F.lit(s), F.array(*map(F.lit, cut_points(m, caps[s]))))))[F.col(source)]
    u = F.pmod(F.xxhash64(key, seed), F.lit(2**53)).cast("double") / float(2**53)
    used = sized.where(F.col(source).isin(list(recipe.draws)) & (F.col(size) > 0)).withColumn("_n", F.size(F.filter(cut, lambda p: p < u)))
    copies = used.where("_n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")
    return copies.withColumn("shuffle_key", F.xxhash64(F.col(key), F.col("copy_no"), F.lit(SEED - 1))).orderBy("shuffle_key", key)


def shares(sized: DataFrame, mixed: DataFrame, source: str, size: str, key: str, targets: DataFrame, recipe: Recipe) -> DataFrame:
    """Of each target what was at hand, what was reached, and how that stands to its goal."""
    got = mixed.groupBy(source).agg(F.sum(size).alias("tokens"), F.count("*").alias("uses"), F.countDistinct(key).alias("records_used"), F.max("copy_no").alias("most_repeats"))
    have = sized.where(F.col(size) > 0).groupBy(source).agg(F.count("*").alias("records_at_hand"), F.sum(size).alias("tokens_at_hand"))
    out = targets.join(got, source, "left").join(have, source, "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # a row a target
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "uses", "records_used", "most_repeats", "records_at_hand", "tokens_at_hand")]
    goal, status = F.lit(0.0), F.lit("no records")
    for s in recipe.draws:
        goal = F.when(F.col(source) == s, F.lit(recipe.goals[s] / recipe.total)).otherwise(goal)
        status = F.when(F.col(source) == s, F.lit(recipe.status[s])).otherwise(status)
    return out.select(source, "target_share", "max_repeats", *filled, F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), goal.alias("goal_share"), status.alias("status"))


def _targets(spark, sf_dir: str) -> list[tuple[str, float, int]]:
    return [tuple(r) for r in table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").collect()]


FIELDS = ("doc_id", "source", "n_tokens")


def p8_mixed(spark, sf_dir: str, total: float | None = None) -> DataFrame:
    """The mixture of the documents; ``total`` is its size in tokens, by default the largest at which the shares can be met."""
    return mix(sized_documents(spark, sf_dir), *FIELDS, _targets(spark, sf_dir), total)


def p8_shares(spark, sf_dir: str, total: float | None = None) -> DataFrame:
    sized, targets = sized_documents(spark, sf_dir), _targets(spark, sf_dir)
    recipe = plan(sized, *FIELDS, targets, total)
    mixed = mix(sized, *FIELDS, targets, recipe=recipe)
    return shares(sized, mixed, "source", "n_tokens", "doc_id", table(spark, sf_dir, "mix_targets"), recipe)


def p8_checked(spark, sf_dir: str) -> DataFrame:
    """Of each target whether the mixture keeps to its rules: uses beyond the cap, uses of records of no tokens, and whether a source called reached is off its goal by over a point; all 0."""
    sized, targets = sized_documents(spark, sf_dir), _targets(spark, sf_dir)
    recipe = plan(sized, *FIELDS, targets)
    mixed, t = mix(sized, *FIELDS, targets, recipe=recipe), table(spark, sf_dir, "mix_targets")
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("copies"), F.max("copy_no").alias("last")).join(t, "source")
    wrong = uses.groupBy("source").agg(F.count(F.when((F.col("n") > F.col("max_repeats")) | (F.col("n") != F.col("copies")) | (F.col("n") != F.col("last")), 1)).alias("wrong_uses"))
    s = shares(sized, mixed, "source", "n_tokens", "doc_id", t, recipe).join(wrong, "source", "left")
    off = F.when((F.col("status") == "reached") & (F.abs(F.col("actual_share") - F.col("goal_share")) > TOLERANCE), 1).otherwise(0)
    return s.select("source", "records_at_hand", F.coalesce("wrong_uses", F.lit(0)).alias("wrong_uses"), off.alias("off_goal"))


ship(__name__)
