"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import extension, original_name, tag_list
from docweave.operators.access import Principal, can_see
from docweave.operators.catalog import once_each

UNKNOWN = "Unknown"


def files(chunks: DataFrame, who: Principal) -> DataFrame:
    """A row a visible file: its first row's fields, its sections and its first day."""
    c = chunks.where(can_see(who)).select("doc_id", "file_id", "sosok", "site", "tags", "original_filename", "section_number", "upload_date")
    c = c.groupBy("doc_id").agg(*(F.first(x).alias(x) for x in ("file_id", "sosok", "site", "tags", "original_filename", "section_number")), F.min("upload_date").alias("upload_date"))
    head = F.struct(F.coalesce("section_number", F.lit(2**31 - 1)).alias("s"), F.col("doc_id").alias("d"))
    return c.where("file_id <> ''").groupBy("file_id").agg(*(F.min_by(x, head).alias(x) for x in ("sosok", "site", "original_filename")), F.count("*").alias("sections"), F.min("upload_date").alias("upload_date"))


def totals(chunks: DataFrame, who: Principal) -> DataFrame:
    """Sections, documents, sections a document."""
    c = once_each(chunks.where(can_see(who)), "file_id")
    t = c.agg(F.count("*").alias("total_sections"), F.countDistinct(F.nullif("file_id", F.lit(""))).alias("total_documents"))
    return t.withColumn("average_sections", F.coalesce(F.round(F.try_divide("total_sections", "total_documents"), 1), F.lit(0.0)))


def facets(chunks: DataFrame, who: Principal) -> DataFrame:
    """Documents by file type, sosok and site in one pass: grouping sets over the file rows."""
    f = files(chunks, who).select(extension(original_name(F.col("file_id"))).alias("ext"), F.coalesce("sosok", F.lit(UNKNOWN)).alias("sosok"), F.coalesce("site", F.lit(UNKNOWN)).alias("site"))
    g = f.groupingSets([["ext"], ["sosok"], ["site"]], "ext", "sosok", "site").agg(F.grouping_id().alias("g"), F.count("*").alias("documents"))
    facet = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "sosok").otherwise("site")
    return g.select(facet.alias("facet"), F.coalesce("ext", "sosok", "site").alias("value"), "documents").where("value <> ''")


def popular_tags(chunks: DataFrame, who: Principal, n: int = 10, by: str = "chunk") -> DataFrame:
    """The n most used tags, counted by chunk or by file."""
    c = once_each(chunks.where(can_see(who)), "file_id", "tags")
    c = c if by == "chunk" else c.select("file_id", "tags").distinct()
    return c.select(F.explode(tag_list(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "tag").limit(n)


def recent_uploads(chunks: DataFrame, who: Principal, n: int = 10) -> DataFrame:
    f = files(chunks, who).where("upload_date IS NOT NULL")
    return f.select("file_id", "original_filename", "sosok", "site", "sections", F.date_format("upload_date", "yyyyMMdd").alias("upload_date")).orderBy(F.desc("upload_date"), "file_id").limit(n)


def uploads_by_date(chunks: DataFrame, who: Principal, as_of: str, days: int = 30) -> DataFrame:
    """Files by day over the days before ``as_of``, days without any as 0. The window opens within its first day, which therefore counts none."""
    end = F.to_date(F.lit(as_of))
    day = chunks.where(can_see(who) & (F.col("file_id") != "")).select("file_id", "upload_date").where((F.col("upload_date") > F.date_sub(end, days)) & (F.col("upload_date") < end))
    counts = day.groupBy("upload_date").agg(F.countDistinct("file_id").alias("n"))
    spine = chunks.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days), F.date_sub(end, 1))).alias("upload_date"))
    return spine.join(counts, "upload_date", "left").select(F.date_format("upload_date", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("uploads"))


def upload_days(chunks: DataFrame, stored: DataFrame, who: Principal, today: str | None = None) -> DataFrame:
    """(file_id, day as yyyyMMdd): eight digits in the id of the file's first row, else its upload date, else when the stored file was last written, else ``today`` (NULL where that is not given)."""
    c = once_each(chunks.where(can_see(who) & (F.col("file_id") != "")), "file_id", "upload_date", "section_number")
    head = F.struct(F.coalesce("section_number", F.lit(2**31 - 1)).alias("s"), F.col("doc_id").alias("d"))
    f = c.groupBy("file_id").agg(F.min_by("doc_id", head).alias("id"), F.min("upload_date").alias("upload_date"))
    written = stored.select(F.substring_index("path", "/", -1).alias("file_id"), "modificationtime").groupBy("file_id").agg(F.max("modificationtime").alias("at"))
    day = F.coalesce(F.nullif(F.regexp_extract("id", r"\d{8}", 0), F.lit("")), F.date_format("upload_date", "yyyyMMdd"), F.date_format("at", "yyyyMMdd"), F.lit(today).cast("string"))
    return f.join(written, "file_id", "left").select("file_id", day.alias("day"))


RESTRICTED = "Storage statistics are only available for administrators"


def storage_for(stored: DataFrame, who: Principal) -> DataFrame:
    """``storage`` with access_level and message: to an administrator the figures, to anyone else one row that says why there are none."""
    if who.level == "admin":
        return storage(stored).withColumn("access_level", F.lit("admin")).withColumn("message", F.lit(None).cast("string"))
    return storage(stored.where("false")).where("false").unionByName(stored.sparkSession.range(1).select(F.lit("restricted").alias("access_level"), F.lit(RESTRICTED).alias("message")), allowMissingColumns=True)


def storage(stored: DataFrame) -> DataFrame:
    """Files, bytes and megabytes by extension, and of all (extension NULL). Repeated rows count once."""
    f = stored.select("path", "length").distinct().select(extension(F.col("path")).alias("extension"), F.coalesce("length", F.lit(0)).alias("length"))
    g = f.rollup("extension").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return g.withColumn("mb", F.round(F.col("bytes") / 1048576, 2)).withColumn("average", F.round(F.col("bytes") / F.col("files"), 2))


def unreferenced(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored files that no chunk refers to: the name after the folder is the file_id, so a plain anti-join does."""
    s = stored.select("path", "length").distinct().withColumn("file_id", F.substring_index("path", "/", -1))
    return s.join(chunks.select("file_id").distinct(), "file_id", "left_anti").select("path", "length")


def vector_counts(chunks: DataFrame) -> DataFrame:
    """Vectors and documents of the collection, and the vector size."""
    c = chunks.select("doc_id", "file_id", F.size("embedding").alias("n")).dropDuplicates(["doc_id"])
    return c.agg(F.count(F.when(F.col("n") > 0, 1)).alias("vectors"), F.countDistinct("file_id").alias("documents"), F.max("n").alias("vector_size"))


def upload_outcomes(results: DataFrame) -> DataFrame:
    """Attempts by outcome, spellings of failure taken together."""
    failed = F.lower(F.trim("status")).isin("failed", "실패", "fail", "error", "failure", "오류")
    return results.groupBy(F.when(failed, "failed").otherwise("done").alias("outcome")).agg(F.count("*").alias("attempts"), F.countDistinct("original_filename").alias("names"), F.sum(F.coalesce("num_pages", F.lit(0))).alias("pages"))
