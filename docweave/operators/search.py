"""Exact vector search with metadata filters, and the prompt made of what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import sse_frame
from docweave.operators.access import Principal, can_see
from docweave.operators.catalog import has_all_tags, named, split_request, where_equal
from docweave.session import ship, spread

TOP = 4


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine in double precision: 0 of an empty vector, NULL where it is undefined (NULL, other length, zero norm, not finite)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm_q = sum(x * x for x in query) ** 0.5
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n"))
    both = F.zip_with(F.transform(vector, lambda x: x.cast("double")), q, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    sums = F.aggregate(both, start, lambda s, v: F.struct((s.d + v.x * v.y).alias("d"), (s.n + v.x * v.x).alias("n")), lambda s: F.when((s.n > 0) & (s.n < float("inf")), s.d / (F.sqrt(s.n) * F.lit(norm_q))))
    return F.when(F.size(vector) == 0, F.lit(0.0)).when(F.size(vector) == len(query), sums)


def scored(df: DataFrame, query: list[float], vector: str = "embedding", top: int | None = None) -> DataFrame:
    """df with ``score`` in place of the vector, for the vectors that have one; the same values as ``cosine``, a batch at a time as matrix products.

    With ``top`` a partition gives only the rows of its ``top`` best doc_ids (ties: the smaller), which hold those of all partitions: what is left to sort doesn't grow with the rows. Rows without doc_id are left out then."""
    kept = [c for c in df.columns if c != vector]
    schema = df.select(*(F.col(f"`{c}`") for c in kept), F.lit(0.0).alias("score")).schema

    def each(batches):
        import numpy as np
        import pyarrow as pa

        q = np.array(query, np.float64)
        best: dict[str, float] = {}
        for b in batches:
            v = b.column(vector)
            v = v.fill_null([]) if v.null_count else v
            at, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            n = np.diff(at)
            rows = np.flatnonzero(n == len(q))
            m = values[at[rows][:, None] + np.arange(len(q))] if len(rows) else np.empty((0, len(q)))
            with np.errstate(all="ignore"):
                s = (m @ q) / (np.sqrt((m * m).sum(1)) * np.sqrt(q @ q))
            good = np.isfinite(s)
            rows, s = rows[good], s[good]
            if top is not None:
                for i, x in zip(b.column("doc_id").take(pa.array(rows)).to_pylist(), s.tolist(), strict=True):
                    if i is not None:
                        best[i] = max(x, best.get(i, x))
                best = dict(sorted(best.items(), key=lambda r: (-r[1], r[0]))[:top])
                continue
            yield pa.RecordBatch.from_arrays([*b.select(kept).take(pa.array(rows)).columns, pa.array(s)], [*kept, "score"])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array(list(best.values()), pa.float64())], ["doc_id", "score"])

    if top is not None and kept != ["doc_id"]:
        raise ValueError("the best rows are those of a doc_id alone")
    return df.where(F.size(vector) == len(query)).withColumn(vector, F.col(vector).cast("array<double>")).mapInArrow(each, schema)


def matching(chunks: DataFrame, who: Principal, tags: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows that the caller may see, with all tags and one of the names."""
    return chunks.where(can_see(who.stripped()) & has_all_tags(split_request(tags)) & named(split_request(names)))


def search(chunks: DataFrame, query: list[float], who: Principal, tags: list[str] | None = None, names: list[str] | None = None, n: int = TOP) -> DataFrame:
    """The n most similar matching chunks; ties go to the smaller doc_id. Only ids and scores are sorted before the rest is looked at."""
    found = best_of(scored(spread(matching(chunks, who, tags, names).select("doc_id", "embedding")), query, top=n), n)
    best = {r["doc_id"]: r["score"] for r in found.collect()}  # n rows
    fields = ["doc_id", "file_id", "original_filename", "tags", "sosok", "site", "section_title", "section_id", "page_number", "content"]
    rows = chunks.where(F.col("doc_id").isin(list(best))).select(*fields).dropDuplicates(["doc_id"])  # pushed down: groups of rows without these ids are not read
    score = F.lit(None).cast("double")
    for i, x in best.items():
        score = F.when(F.col("doc_id") == i, F.lit(x)).otherwise(score)
    return rows.withColumn("_score", score).orderBy(F.desc("_score"), "doc_id").select(*fields, F.round("_score", 4).alias("score"))


def best_of(found: DataFrame, n: int, name: str = "score") -> DataFrame:
    return found.groupBy("doc_id").agg(F.max("score").alias(name)).orderBy(F.desc(name), "doc_id").limit(n)


def similar(chunks: DataFrame, query: list[float], filters: dict | None = None, n: int = 10) -> DataFrame:
    """The n most similar chunks under metadata equalities: (doc_id, similarity_score)."""
    return best_of(scored(spread(where_equal(chunks, filters or {}).select("doc_id", "embedding")), query, top=n), n, "similarity_score")


def search_counts(chunks: DataFrame, who: Principal, tags: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """How many chunks match, with a vector or not."""
    return matching(chunks, who, tags, names).agg(F.countDistinct("doc_id").alias("total_matched"), F.countDistinct(F.when(F.size("embedding") > 0, F.col("doc_id"))).alias("with_vector"))


NOTHING = "관련 문서를 찾을 수 없습니다."


def prompt(found: DataFrame, question: str, instruction: str = "다음 문서를 근거로 질문에 답하십시오.") -> DataFrame:
    """One row: the context (contents by score, an empty line between) and the ChatML prompt; NULL where nothing was found."""
    parts = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "content")))
    context = F.array_join(F.transform(parts, lambda p: p.content), "\n\n")
    text = F.concat(F.lit(f"<|im_start|>system\n{instruction}<|im_end|>\n<|im_start|>user\n"), F.col("context"), F.lit(f"\n\n{question}<|im_end|>\n<|im_start|>assistant\n"))
    return found.agg(F.nullif(context, F.lit("")).alias("context")).withColumn("prompt", text)


def answer(found: DataFrame, question: str, generate) -> DataFrame:
    """Server-sent events (seq, frame) of what ``generate(prompt)`` yields; its failure is an event too; the last frame is [DONE]."""

    def parts_of(p):
        try:
            yield from generate(p) if p else [NOTHING]
        except Exception as e:  # noqa: BLE001
            yield f"[error] {e}"

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            for p in batch.column("prompt").to_pylist():
                for i, part in enumerate(parts_of(p)):  # each part goes on as it comes
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.string())], ["seq", "text"])

    frames = prompt(found, question).select("prompt").mapInArrow(each, "seq int, text string").select("seq", sse_frame(F.col("text")).alias("frame"))
    return frames.union(frames.sparkSession.range(1).select(F.lit(2**31 - 1).alias("seq"), F.lit("data: [DONE]\n\n").alias("frame")))


ship(__name__)
