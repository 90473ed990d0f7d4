"""From stored files to chunk rows: parse, clean pages, cut into sections or windows, embed, append, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import original_name, tag_list
from docweave.operators import chunk, layout, sections, tables
from docweave.operators.catalog import is_manual
from docweave.session import materialize
from docweave.sources import office
from docweave.sources.chunkstore import SCHEMA, ChunkStore

CROPPED = "[CROPPING FAILED]"


def clean_pages(chars: DataFrame, grids: DataFrame | None = None, images: DataFrame | None = None, top: float = 0.0, bottom: float = 0.0, detect: bool = True) -> DataFrame:
    """(file_id, page_num, text) of characters: margins found from repeated lines, else as given; tables in their places, images after the text. A page of which nothing is left says so."""
    chars = materialize(chars, "chars")
    heights = chars.groupBy("file_id", "page_num").agg(F.max("page_height").alias("page_height"))
    if detect:
        pages = heights.groupBy("file_id").agg(F.count("*").alias("n_pages"))
        m = layout.margins(layout.repeated_edges(layout.lines(chars), pages), heights)
        m = m.select("file_id", *(F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(given)).alias(f"_{c}") for c, given in (("top", top), ("bottom", bottom))))
    else:
        m = heights.select("file_id").distinct().select("file_id", F.lit(top).alias("_top"), F.lit(bottom).alias("_bottom"))
    kept = chars.join(m, "file_id").where((F.col("top") >= F.col("page_height") * F.col("_top")) & (F.col("bottom") <= F.col("page_height") * (1 - F.col("_bottom")))).drop("_top", "_bottom")
    rendered = None
    if grids is not None:
        kept = layout.outside_boxes(kept, grids)
        rendered = tables.with_table_text(grids).select("file_id", "page_num", F.col("y0").alias("top"), "text")
    text = layout.page_texts(layout.lines(kept), rendered)
    out = heights.select("file_id", "page_num").join(text, ["file_id", "page_num"], "left").withColumn("text", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit(CROPPED)).otherwise(F.col("text")))
    return layout.with_images(out, images) if images is not None else out


def cut(pages: DataFrame) -> DataFrame:
    """Sections of (file_id, page_num, text): manuals at their headings, other files in token windows."""
    pages = materialize(pages, "pages")
    first = pages.where(F.trim("text") != "").groupBy("file_id").agg(F.min_by("text", "page_num").alias("t")).select("file_id", F.coalesce(is_manual(F.col("t")), F.lit(False)).alias("manual"))
    routed = pages.join(first, "file_id")
    by_heading = sections.sections(routed.where("manual").drop("manual")).select("file_id", "seq", "title", "section_id", "content", "start_page")
    windows = chunk.token_windows(routed.where("NOT manual").drop("manual"))
    return by_heading.union(windows.select("file_id", "seq", F.concat(F.lit("Chunk "), F.col("seq").cast("string")), F.col("seq").cast("string"), "content", "start_page"))


def chunk_rows(cut_sections: DataFrame, pages: DataFrame, tags: str, sosok: str, site: str, day: str, embed=None) -> DataFrame:
    """Rows of the chunk table. Files without pages of their own count their sections as pages."""
    totals = pages.groupBy("file_id").agg(F.max("page_num").cast("int").alias("total_pdf_pages"))
    s = cut_sections.withColumn("original_filename", original_name(F.col("file_id"))).withColumn("page_number", F.lit(None).cast("int"))
    rows = chunk.section_records(s, embed).join(totals, "file_id", "left")
    rows = rows.withColumns({"tags": F.array_join(tag_list(F.lit(tags)), ", "), "sosok": F.lit(sosok), "site": F.lit(site), "upload_date": F.to_date(F.lit(day))})
    return rows.select(*(f.split()[0] for f in SCHEMA.split(", ")))


def ingest(stored: DataFrame, store: ChunkStore, tags: str, sosok: str, site: str, day: str, embed=None) -> DataFrame:
    """Office files (file_id, content) into the store; a row per file with its outcome. A file that fails takes no other with it."""
    found = materialize(office.paragraphs(stored), "paragraphs")
    pages = office.by_page(found)
    made = cut(pages)
    rows = materialize(chunk_rows(made, pages, tags, sosok, site, day, embed), "rows")
    store.append(rows)
    done = rows.groupBy("file_id").agg(F.count("*").alias("sections"))
    errors = found.groupBy("file_id").agg(F.max("error").alias("error"))
    out = stored.select("file_id").join(errors, "file_id", "left").join(done, "file_id", "left")
    failed = F.col("error").isNotNull() | F.col("sections").isNull()
    return out.select("file_id", F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, F.coalesce("error", F.lit("no text"))).alias("message"), F.coalesce("sections", F.lit(0)).alias("sections"))
