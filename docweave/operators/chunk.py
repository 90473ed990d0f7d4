"""Token windows over pages, and section records ready to be embedded."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import ship, strip_blanks

WINDOW, OVERLAP = 700, 100


def tokenized(pages: DataFrame, tokenizer: Callable[[str], list[str]]) -> DataFrame:
    """(file_id, page_num, t) with the tokens a tokenizer gives, in Arrow batches; NULL text has none."""

    def each(batches):
        for b in batches:
            t = [tokenizer(x) if x else [] for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("page_num"), pa.array(t, pa.list_(pa.string()))], ["file_id", "page_num", "t"])

    d = pages.select("file_id", "page_num", "text")
    return d.mapInArrow(each, d.select("file_id", "page_num", F.array(F.lit("")).alias("t")).schema)


def token_windows(pages: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, tokenizer: Callable[[str], list[str]] | None = None, joiner: str = " ") -> DataFrame:
    """Windows of tokens over each file's pages (file_id, page_num, text), joined in page order: what stands between blanks, or what ``tokenizer`` gives, put together by ``joiner``.

    (file_id, seq from 1, start_token, start_page, n_tokens, content). A file without tokens has none; the last window may lie
    within the one before. The page is where the window's first token stands.
    """
    stride = window - overlap
    if tokenizer:
        p = tokenized(pages, tokenizer)
    else:
        p = pages.select("file_id", "page_num", F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda t: t != "").alias("t"))
    f = p.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "t"))).alias("p"))
    f = f.select("file_id", F.flatten(F.transform("p", lambda x: x.t)).alias("t"), F.transform("p", lambda x: F.struct(x.page_num.alias("page"), F.size(x.t).alias("n"))).alias("p"))
    ends = F.aggregate("p", F.expr("CAST(array() AS ARRAY<STRUCT<page: INT, until: INT>>)"), lambda a, x: F.concat(a, F.array(F.struct(x.page.cast("int").alias("page"), (x.n + F.coalesce(F.try_element_at(a, F.lit(-1)).until, F.lit(0))).alias("until")))))
    f = f.where(F.size("t") > 0).withColumn("ends", ends).select("file_id", "t", "ends", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(stride))).alias("i", "start_token"))
    page = F.coalesce(F.get(F.filter("ends", lambda e: e.until > F.col("start_token")), 0).page, F.lit(1))
    piece = F.slice("t", F.col("start_token") + 1, window)
    return f.select("file_id", (F.col("i") + 1).alias("seq"), "start_token", page.alias("start_page"), F.size(piece).alias("n_tokens"), F.array_join(piece, joiner).alias("content"))


def page_chunks(pages: DataFrame) -> DataFrame:
    """(file_id, seq, start_page, content): every page with text is a chunk, numbered by its page."""
    return pages.where(F.length(strip_blanks(F.col("text"))) > 0).select("file_id", F.col("page_num").alias("seq"), F.col("page_num").alias("start_page"), F.col("text").alias("content"))


def section_records(sections: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Chunk rows of sections (file_id, original_filename, seq, title, section_id, content, page_number, start_page, …): empty sections are left
    out but numbered, the content gets its header, ids are hashes, and vectors come from ``embed`` a batch at a time."""
    s = sections.withColumn("section_number", F.col("seq")).where(F.length(strip_blanks(F.col("content"))) > 0)
    s = s.withColumn("section_id", F.coalesce("section_id", F.col("seq").cast("string"))).withColumn("page_number", F.coalesce("page_number", "start_page"))
    s = s.withColumn("content", F.concat(F.lit("문서: "), "original_filename", F.lit("\n<h2>"), "title", F.lit("</h2>\n"), "content"))
    s = s.select(F.sha2(F.concat_ws("\x1f", "file_id", F.col("section_number").cast("string")), 256).alias("doc_id"), "file_id", "original_filename", F.col("title").alias("section_title"), "section_id", "section_number", "page_number", "content")
    return embedded(s, embed or hashing_embedder) if embed is not False else s


def hashing_embedder(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A stand-in for a model: signed hashes of words, unit length."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in t.split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h & 1 << 16 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "content") -> DataFrame:
    schema = df.select("*", F.array(F.lit(0.0).cast("float")).alias("embedding")).schema

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(embed(b.column(text).to_pylist()), pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    return df.mapInArrow(each, schema)


ship(__name__)
