"""Office files packed on the executors from the test tables' chunks, and read back: what a reader gives, with its SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import catalog
from docweave.plans.queries import ONCE, chunks, query, strip
from docweave.session import materialize, ship
from docweave.sources import office


def docx(titles: list[str]) -> dict[str, str]:
    """Every title as a paragraph of two runs, and an empty paragraph after each."""
    p = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t[:2])}</w:t></w:r><w:r><w:t xml:space="preserve">{escape(t[2:])}</w:t></w:r></w:p><w:p/>' for t in titles)
    return {"word/document.xml": f'<w:document xmlns:w="w"><w:body>{p}</w:body></w:document>'}


def pptx(titles: list[str]) -> dict[str, str]:
    """Every title on a slide of its own; the slides stand in the file in the order of their names."""
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sld>'
    return {name: body for name, body in sorted((f"ppt/slides/slide{i}.xml", slide.format(escape(t))) for i, t in enumerate(titles, 1))}


def hwpx(titles: list[str]) -> dict[str, str]:
    """Every title on a page of its own, under a header, with a picture after the first."""
    head = "<hp:header><hp:p><hp:run><hp:t>head</hp:t></hp:run></hp:p></hp:header><hp:footer><hp:p><hp:run><hp:t>foot</hp:t></hp:run></hp:p></hp:footer>"
    body = "".join(f'<hp:p pageBreak="{int(i > 0)}"><hp:run><hp:t>{escape(t)}</hp:t></hp:run></hp:p>' + '<hp:p><hp:run><hp:pic><hc:img binaryItemIDRef="image1"/></hp:pic></hp:run></hp:p>' * (i == 0) for i, t in enumerate(titles))
    return {"Contents/section0.xml": f'<hs:sec xmlns:hp="hp" xmlns:hs="hs" xmlns:hc="hc"><hp:secDef/>{head}{body}</hs:sec>', "BinData/image1.png": "png"}


def packed(lists: DataFrame, kind: str) -> DataFrame:
    """(file_id, content) of files of that kind, one a row of (file_id, titles); a kind that isn't known gives bytes that no reader can take."""

    def each(batches):
        write = {"docx": docx, "pptx": pptx, "hwpx": hwpx}.get(kind)
        for b in batches:
            files = []
            for titles in b.column("titles").to_pylist():
                data = io.BytesIO()
                if write:
                    with zipfile.ZipFile(data, "w") as z:
                        for name, text in write(titles).items():
                            z.writestr(name, text)
                files.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{f}.{kind}" for f in b.column("file_id").to_pylist()], pa.string()), pa.array(files, pa.binary())], ["file_id", "content"])

    return lists.mapInArrow(each, "file_id string, content binary")


PLAIN = r"^[^\x00-\x1f\x7f-\x9f]*$"  # XML has no control characters


def titles_of(spark, d: str) -> DataFrame:
    c = catalog.once_each(chunks(spark, d).where(F.col("file_id").isNotNull() & F.col("section_title").rlike(PLAIN) & F.col("section_title").rlike(r"(?U)\S")), "file_id", "section_title")
    return c.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "section_title"))), lambda x: x.section_title).alias("titles"))


TITLES = rf"{ONCE}, t AS (SELECT file_id, {strip('section_title')} AS text, row_number() OVER (PARTITION BY file_id ORDER BY doc_id)::INT AS i FROM c WHERE file_id IS NOT NULL AND regexp_full_match(section_title, '[^\x00-\x1f\x7f-\x9f]*') AND regexp_matches(section_title, '[^\s\x0b\x{{85}}\p{{Z}}]'))"

PARAGRAPHS = rf"""WITH {TITLES}, h AS (SELECT file_id || '.hwpx' AS file_id, i, 0 AS k, i AS page_num, text FROM t UNION ALL
        SELECT file_id || '.hwpx', 1, 1, 1, '<img src="' || substring(md5(file_id || '.hwpx_None_0'), 1, 8) || '.png" style="max-width:100%;">' FROM t WHERE i = 1)
    SELECT file_id || '.docx' AS file_id, i AS seq, NULL::INT AS page_num, text, false AS failed FROM t UNION ALL SELECT file_id || '.pptx', i, NULL, text, false FROM t
    UNION ALL SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY i, k)::INT, page_num + 1, text, false FROM h UNION ALL SELECT DISTINCT file_id || '.pdf', 1, NULL::INT, NULL, true FROM t"""


@query("office_paragraphs", PARAGRAPHS)
def office_paragraphs(spark, d):
    """Every file's titles as a DOCX, a PPTX and an HWPX file, read back as paragraphs; and as a file that has no reader, which gives one row with its error."""
    t = titles_of(spark, d)
    stored = materialize(packed(t, "docx").union(packed(t, "pptx")).union(packed(t, "hwpx")).union(packed(t, "pdf")), "packages")
    return office.paragraphs(stored).select("file_id", "seq", "page_num", "text", F.col("error").isNotNull().alias("failed"))


@query("office_images", rf"WITH {TITLES} SELECT file_id || '.hwpx' AS file_id, substring(md5(file_id || '.hwpx_None_0'), 1, 8) || '.png' AS name, 3 AS size FROM t WHERE i = 1")
def office_images(spark, d):
    """The pictures of the HWPX files."""
    return office.images(packed(titles_of(spark, d), "hwpx")).select("file_id", "name", F.length("data").alias("size"))


@query("office_pages", rf"WITH {TITLES} SELECT file_id || '.pptx' AS file_id, 1 AS page_num, string_agg(text, chr(10) ORDER BY i) AS text FROM t GROUP BY file_id")
def office_pages(spark, d):
    """The slides' paragraphs brought together: a file without page numbers is one page."""
    return office.by_page(office.paragraphs(packed(titles_of(spark, d), "pptx")))


@query("ingest_files", rf"WITH {TITLES} SELECT file_id || '.docx' AS file_id, 'success' AS status, count(*)::INT AS rows FROM t GROUP BY file_id UNION ALL SELECT DISTINCT file_id || '.pdf', 'failed', 0 FROM t")
def ingest_files(spark, d):
    """Good and bad files through the batch function of the incremental ingest: what is reported of each."""
    from docweave import streaming

    t = titles_of(spark, d)
    stored, seen = materialize(packed(t, "docx").union(packed(t, "pdf")), "packages"), []
    streaming.ingest_batch(office.paragraphs, lambda good: materialize(good, "appended"), lambda report: seen.append(materialize(report, "reports")))(stored, 0)
    return seen[0].select("file_id", "status", F.col("rows").cast("int").alias("rows"))


ship(__name__)
