"""Catalogue queries over the chunk table: one row a chunk in, mostly one row a file out. Rows delivered again (same doc_id) count once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import extension, section_key, tag_list
from docweave.operators.access import Principal, can_see
from docweave.session import strip_blanks


def once_each(chunks: DataFrame, *columns: str) -> DataFrame:
    """Each doc_id once, with these columns only, so that the exchange carries no content."""
    return chunks.select("doc_id", *columns).dropDuplicates(["doc_id"])


def where_equal(df: DataFrame, filters: dict) -> DataFrame:
    """AND over equalities; a list is any of its values; no filters, all rows. All of it can be pushed down to the scan."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in filters.items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def split_request(values: list[str] | None) -> list[str]:
    """A single value with commas is several; blanks at the ends and empty ones go."""
    values = values or []
    if len(values) == 1 and "," in values[0]:
        values = values[0].split(",")
    return [v.strip() for v in values if v.strip()]


def has_all_tags(wanted: list[str]):
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tag_list(F.col("tags")))) == 0 if wanted else F.lit(True)


def named(names: list[str]):
    return strip_blanks(F.col("original_filename")).isin(names) if names else F.lit(True)


def list_documents(chunks: DataFrame, who: Principal) -> DataFrame:
    """A row a file: the first section's fields, its sections, first total of pages that is not 0, and its pages in order."""
    c = once_each(chunks.where(can_see(who)), "file_id", "original_filename", "tags", "sosok", "site", "section_number", "total_pdf_pages", "page_number")
    head = F.struct(F.coalesce("section_number", F.lit(2**31 - 1)).alias("s"), F.col("doc_id").alias("d"))
    return c.groupBy("file_id").agg(
        F.min_by("doc_id", head).alias("doc_id"),
        F.min_by("original_filename", head).alias("original_filename"),
        F.min_by("tags", head).alias("tags"),
        F.min_by("sosok", head).alias("sosok"),
        F.min_by("site", head).alias("site"),
        F.count("*").alias("sections"),
        F.coalesce(F.min_by("total_pdf_pages", F.when(F.col("total_pdf_pages") != 0, head)), F.lit(0)).alias("total_pages"),
        F.sort_array(F.collect_set("page_number")).alias("pages"),
    )


def files_with_tags(chunks: DataFrame, wanted: list[str], who: Principal) -> DataFrame:
    """Files of which a visible row has all tags, with the number of all their rows, visible or not."""
    c = once_each(chunks, "file_id", "original_filename", "tags", "sosok", "site", "section_number")
    hit = F.when(can_see(who) & has_all_tags(wanted), F.struct(F.coalesce("section_number", F.lit(2**31 - 1)).alias("s"), F.col("doc_id").alias("d")))
    found = c.groupBy("file_id").agg(*(F.min_by(x, hit).alias(x) for x in ("original_filename", "tags", "sosok", "site")), F.count("*").alias("sections"), F.count(hit).alias("_hits"))
    return found.where("_hits > 0").drop("_hits")


def list_tags(chunks: DataFrame, who: Principal) -> DataFrame:
    return chunks.where(can_see(who)).select(F.explode(tag_list(F.col("tags"))).alias("tag")).distinct().orderBy("tag")


def stored_duplicates(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested names (request_id, sosok, site, filenames) that a stored file of just that sosok and site has, composed alike (NFC) on both sides; a repeated request repeats its rows."""
    from docweave.functions.nfc import nfc

    files = chunks.select("file_id", "original_filename", "sosok", "site", "tags").where("file_id IS NOT NULL").groupBy("file_id").agg(*(F.min(x).alias(x) for x in ("original_filename", "sosok", "site", "tags")))
    files = files.withColumn("name", nfc("original_filename"))
    asked = requests.select("request_id", F.col("sosok").alias("s"), F.col("site").alias("t"), F.posexplode("filenames").alias("place", "name"))
    asked = asked.withColumn("name", nfc("name"))
    j = asked.join(files, (asked.name == files.name) & (asked.s == files.sosok) & (asked.t == files.site))
    return j.select("request_id", (F.col("place") + 1).alias("place"), "file_id", "original_filename", "tags")


def page_content(chunks: DataFrame, file_id: str, page: str, who: Principal) -> DataFrame:
    """A page's sections in the order of their dotted numbers."""
    c = chunks.where((F.col("file_id") == file_id) & (F.col("page_number").cast("string") == page) & can_see(who)).dropDuplicates(["doc_id"])
    return c.select("doc_id", "section_id", "section_title", "content", section_key(F.col("section_id")).alias("k")).orderBy("k", "doc_id").drop("k")


def by_section_key(chunks: DataFrame) -> DataFrame:
    """Every chunk's place among those of its file and page, by dotted section number."""
    c = once_each(chunks, "file_id", "page_number", "section_id")
    w = Window.partitionBy("file_id", "page_number").orderBy(section_key(F.col("section_id")), "doc_id")
    return c.select("doc_id", "section_id", F.row_number().over(w).alias("place"))


ALLOWED = ("pdf", "hwpx", "docx", "pptx")


def admitted(uploads: DataFrame, name: str = "original_filename") -> tuple[DataFrame, DataFrame]:
    """Uploads of a known kind, and the others as failures."""
    ok = extension(F.col(name)).isin(*ALLOWED)
    return uploads.where(ok), uploads.where(~ok | ok.isNull()).withColumn("status", F.lit("failed")).withColumn("message", F.lit("unsupported type"))


def is_manual(first_page: str):
    """Whether a document's first page begins with the words of a maintenance manual, blanks aside."""
    return F.regexp_replace(F.split(F.regexp_replace(first_page, r"(?U)^\s+", ""), "\n")[0], r"(?U)\s+", "").startswith("유지보수교범")


def retagged(chunks: DataFrame, file_id: str, tags: str, who: Principal) -> DataFrame:
    """The table with a file's tags replaced. LookupError where there is no such file, PermissionError where a row of it may not be seen."""
    own = chunks.where(F.col("file_id") == file_id).agg(F.count("*").alias("n"), F.count(F.when(~can_see(who), 1)).alias("hidden")).first()
    if not own["n"]:
        raise LookupError(file_id)
    if own["hidden"]:
        raise PermissionError(file_id)
    new = ", ".join(t.strip() for t in tags.split(",") if t.strip())
    return chunks.withColumn("tags", F.when(F.col("file_id") == file_id, F.lit(new)).otherwise(F.col("tags")))


def without_documents(chunks: DataFrame, who: Principal, file_id: str | None = None, filename: str | None = None) -> DataFrame:
    """The table without a file's rows, by id, else by name; rows that may not be seen stay."""
    if not file_id and not filename:
        raise ValueError("a file_id or a filename is needed")
    match = F.col("file_id") == file_id if file_id else strip_blanks(F.col("original_filename")) == filename.strip()
    return chunks.where(~F.coalesce(match & can_see(who), F.lit(False)))


def without_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the rows of these doc_ids."""
    return chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
