"""The core queries over a folder of tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave import streaming
from docweave.functions import packed
from docweave.functions.text import clean_cell, is_number, sse_frame, uptime_text
from docweave.operators import catalog, chunk, layout, names, search, sections, stats, tables
from docweave.operators.access import ADMIN, Principal, can_see
from docweave.session import site_key, spread, strip_blanks, table
from docweave.sources import office

ANYONE = Principal(ADMIN, ADMIN)
DEPARTMENT = Principal("항로지원부", "항로지원부_전체")
SITE = Principal("탐지운용부", "가온레이더소")
TAGS = ["레이더", "정기점검"]
AS_OF = "2024-12-01"
VECTOR = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]

QUERIES: dict = {}
SQL: dict[str, str] = {}

BLANK = r"[\s\x0b\x{85}\p{Z}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


ONCE = "c AS (SELECT DISTINCT ON (doc_id) * FROM chunks ORDER BY doc_id, upload_date)"
SEES_DEPARTMENT = f"coalesce({strip('sosok')}, '') = '항로지원부'"
SEES_SITE = f"coalesce({strip('sosok')}, '') = '탐지운용부' AND coalesce({strip('site')}, '') = '가온레이더소'"
TAG_LIST = f"list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda t: {strip('t')}), lambda t: t <> '')"
HAS_TAGS = f"list_has_all({TAG_LIST}, ['레이더', '정기점검'])"
Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in VECTOR) + "]"
USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def chunks(spark, d: str) -> DataFrame:
    return table(spark, d, "chunks")


def _access(name: str, who: Principal, where: str) -> None:
    @query(f"access_{name}", f"SELECT DISTINCT doc_id, file_id, sosok, site FROM chunks WHERE {where}")
    def run(spark, d: str) -> DataFrame:
        return catalog.once_each(chunks(spark, d).where(can_see(who)), "file_id", "sosok", "site")


_access("admin", ANYONE, "true")
_access("department", DEPARTMENT, SEES_DEPARTMENT)
_access("site", SITE, SEES_SITE)


@query("equality_filter", "SELECT DISTINCT doc_id, section_id FROM chunks WHERE sosok IN ('통신정비부', '시설관리부') AND section_number = 2")
def equality_filter(spark, d):
    return catalog.once_each(catalog.where_equal(chunks(spark, d), {"sosok": ["통신정비부", "시설관리부"], "section_number": 2}), "section_id")


@query("tag_filter_all", f"SELECT DISTINCT doc_id, tags FROM chunks WHERE {HAS_TAGS}")
def tag_filter_all(spark, d):
    return catalog.once_each(chunks(spark, d).where(catalog.has_all_tags(TAGS)), "tags")


@query("name_filter", f"WITH n AS (SELECT DISTINCT unnest(filenames) AS name FROM duplicate_requests) SELECT DISTINCT doc_id, original_filename FROM chunks WHERE {strip('original_filename')} IN (SELECT {strip('name')} FROM n)")
def name_filter(spark, d):
    asked = table(spark, d, "duplicate_requests").select(F.explode("filenames").alias("name")).select(strip_blanks(F.col("name")).alias("name")).distinct()
    return catalog.once_each(chunks(spark, d).withColumn("name", strip_blanks(F.col("original_filename"))).join(asked, "name", "left_semi"), "original_filename")


@query("cosine_topk", f"WITH s AS (SELECT DISTINCT doc_id, round(list_cosine_similarity(embedding::DOUBLE[], {Q}), 4) AS score FROM (SELECT * FROM chunks WHERE {USABLE})) SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def cosine_topk(spark, d):
    s = search.scored(spread(chunks(spark, d).select("doc_id", "embedding")), VECTOR)
    return s.groupBy("doc_id").agg(F.max(F.round("score", 4)).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(
    "similar_with_filters",
    f"WITH s AS (SELECT DISTINCT doc_id, round(list_cosine_similarity(embedding::DOUBLE[], {Q}), 6) AS similarity_score FROM (SELECT * FROM chunks WHERE {USABLE} AND sosok IN ('통신정비부', '시설관리부') AND section_number = 1)) SELECT * FROM s ORDER BY similarity_score DESC, doc_id LIMIT 10",
)
def similar_with_filters(spark, d):
    s = search.similar(chunks(spark, d), VECTOR, {"sosok": ["통신정비부", "시설관리부"], "section_number": 1})
    return s.select("doc_id", F.round("similarity_score", 6).alias("similarity_score"))


def _found(where: str, n: int = 4) -> str:
    return f"""WITH u AS (SELECT * FROM chunks WHERE {USABLE} AND {where}),
        s AS (SELECT DISTINCT ON (doc_id) *, list_cosine_similarity(embedding::DOUBLE[], {Q}) AS score FROM u ORDER BY doc_id)
        SELECT doc_id, file_id, original_filename, tags, sosok, site, section_title, section_id, page_number, content, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT {n}"""


@query("search_with_metadata", _found(SEES_DEPARTMENT))
def search_with_metadata(spark, d):
    return search.search(chunks(spark, d), VECTOR, DEPARTMENT)


@query("search_by_tags", _found(f"{SEES_SITE} AND {HAS_TAGS}"))
def search_by_tags(spark, d):
    return search.search(chunks(spark, d), VECTOR, SITE, tags=[",".join(TAGS)])


@query("search_counts", f"SELECT count(DISTINCT doc_id) AS total_matched, count(DISTINCT CASE WHEN len(embedding) > 0 THEN doc_id END) AS with_vector FROM chunks WHERE {SEES_DEPARTMENT} AND {HAS_TAGS}")
def search_counts(spark, d):
    return search.search_counts(chunks(spark, d), DEPARTMENT, TAGS)


@query(
    "answer_prompt",
    f"""WITH f AS ({_found(SEES_DEPARTMENT)}), x AS (SELECT string_agg(content, chr(10) || chr(10) ORDER BY score DESC, doc_id) AS context FROM f)
    SELECT context, '<|im_start|>system' || chr(10) || '다음 문서를 근거로 질문에 답하십시오.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || context || chr(10) || chr(10) || '점검 주기는?<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM x""",
)
def answer_prompt(spark, d):
    return search.prompt(search.search(chunks(spark, d), VECTOR, DEPARTMENT), "점검 주기는?")


@query(
    "answer_stream",
    rf"""WITH f AS ({_found(SEES_SITE)}), x AS (SELECT string_agg(content, chr(10) || chr(10) ORDER BY score DESC, doc_id) AS context FROM f),
    p AS (SELECT '<|im_start|>system' || chr(10) || '다음 문서를 근거로 질문에 답하십시오.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || context || chr(10) || chr(10) || '점검 주기는?<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM x),
    w AS (SELECT list_filter(regexp_split_to_array(prompt, '{BLANK}+'), lambda t: t <> '') AS w FROM p), o AS (SELECT unnest(w) AS word, unnest(range(0, len(w)))::INT AS seq FROM w)
    SELECT seq, 'data: ' || json_object('content', word)::VARCHAR || chr(10) || chr(10) AS frame FROM o UNION ALL SELECT 2147483647, 'data: [DONE]' || chr(10) || chr(10)""",
)
def answer_stream(spark, d):
    """Frames of a stand-in generator that repeats the prompt's words."""
    return search.answer(search.search(chunks(spark, d), VECTOR, SITE), "점검 주기는?", lambda p: p.split())


FIRST = "coalesce(section_number, 2147483647), doc_id"


@query(
    "list_documents",
    f"""WITH {ONCE} SELECT file_id, arg_min(doc_id, ROW({FIRST})) AS doc_id, arg_min(original_filename, ROW({FIRST})) AS original_filename, arg_min(tags, ROW({FIRST})) AS tags,
    count(*) AS sections, coalesce(arg_min(total_pdf_pages, ROW({FIRST})) FILTER (total_pdf_pages <> 0), 0) AS total_pages,
    coalesce(string_agg(DISTINCT page_number::VARCHAR, ',' ORDER BY page_number::VARCHAR), '') AS pages FROM c WHERE {SEES_DEPARTMENT} GROUP BY file_id""",
)
def list_documents(spark, d):
    f = catalog.list_documents(chunks(spark, d), DEPARTMENT)
    return f.select("file_id", "doc_id", "original_filename", "tags", "sections", "total_pages", F.array_join(F.sort_array(F.transform("pages", lambda p: p.cast("string"))), ",").alias("pages"))


@query(
    "filter_documents_by_tags",
    f"""WITH {ONCE} SELECT file_id, arg_min(original_filename, ROW({FIRST})) FILTER ({HAS_TAGS} AND {SEES_DEPARTMENT}) AS original_filename, count(*) AS sections FROM c
    GROUP BY file_id HAVING count(*) FILTER ({HAS_TAGS} AND {SEES_DEPARTMENT}) > 0""",
)
def filter_documents_by_tags(spark, d):
    return catalog.files_with_tags(chunks(spark, d), TAGS, DEPARTMENT).select("file_id", "original_filename", "sections")


@query("list_tags", f"SELECT DISTINCT unnest({TAG_LIST}) AS tag FROM chunks WHERE {SEES_DEPARTMENT}")
def list_tags(spark, d):
    return catalog.list_tags(chunks(spark, d), DEPARTMENT)


@query("popular_tags", f"WITH {ONCE} SELECT tag, count(*) AS uses FROM (SELECT unnest({TAG_LIST}) AS tag FROM c) GROUP BY tag ORDER BY uses DESC, tag LIMIT 10")
def popular_tags(spark, d):
    return stats.popular_tags(chunks(spark, d), ANYONE)


@query("popular_tags_by_file", f"SELECT tag, count(*) AS uses FROM (SELECT unnest({TAG_LIST}) AS tag FROM (SELECT DISTINCT file_id, tags FROM chunks)) GROUP BY tag ORDER BY uses DESC, tag LIMIT 10")
def popular_tags_by_file(spark, d):
    return stats.popular_tags(chunks(spark, d), ANYONE, by="file")


@query(
    "check_duplicate",
    f"""WITH f AS (SELECT file_id, min(original_filename) AS original_filename, min(sosok) AS sosok, min(site) AS site, min(tags) AS tags FROM chunks WHERE file_id IS NOT NULL GROUP BY file_id),
    r AS (SELECT request_id, sosok, site, unnest(filenames) AS name, generate_subscripts(filenames, 1) AS place FROM duplicate_requests)
    SELECT request_id, place, file_id, original_filename, tags FROM r JOIN f ON {strip("nfc_normalize(name)")} = {strip("nfc_normalize(original_filename)")} AND r.sosok = f.sosok AND r.site = f.site""",
)
def check_duplicate(spark, d):
    return catalog.stored_duplicates(chunks(spark, d), table(spark, d, "duplicate_requests"))


SECTION_KEY = r"CASE WHEN regexp_extract(section_id, '^(\d+(?:\.\d+)*)', 1) = '' THEN [999] ELSE list_transform(string_split(regexp_extract(section_id, '^(\d+(?:\.\d+)*)', 1), '.'), lambda x: x::INT) END"


@query("section_order", f"WITH {ONCE} SELECT doc_id, section_id, row_number() OVER (PARTITION BY file_id, page_number ORDER BY {SECTION_KEY}, doc_id) AS place FROM c")
def section_order(spark, d):
    return catalog.by_section_key(chunks(spark, d))


@query(
    "page_content",
    f"WITH {ONCE}, f AS (SELECT min(file_id) AS file_id FROM c WHERE page_number IS NOT NULL) SELECT doc_id, section_id, section_title, content FROM c WHERE file_id = (SELECT file_id FROM f) AND page_number::VARCHAR = (SELECT min(page_number)::VARCHAR FROM c WHERE file_id = (SELECT file_id FROM f))",
)
def page_content(spark, d):
    c = chunks(spark, d)
    f = c.where("page_number IS NOT NULL").agg(F.min(F.struct("file_id", "page_number")).alias("m")).first()["m"]
    return catalog.page_content(c, f["file_id"], str(f["page_number"]), ANYONE)


@query("stats_totals", f"WITH {ONCE} SELECT count(*) AS total_sections, count(DISTINCT nullif(file_id, '')) AS total_documents, round(count(*) / count(DISTINCT nullif(file_id, '')), 1) AS average_sections FROM c")
def stats_totals(spark, d):
    return stats.totals(chunks(spark, d), ANYONE)


FILES = f"""{ONCE}, f AS (SELECT file_id, arg_min(sosok, ROW({FIRST})) AS sosok, arg_min(site, ROW({FIRST})) AS site, arg_min(original_filename, ROW({FIRST})) AS original_filename, count(*) AS sections, min(upload_date) AS upload_date FROM c WHERE file_id <> '' GROUP BY file_id)"""


@query(
    "stats_facets",
    f"""WITH {FILES}, x AS (SELECT regexp_extract(lower(regexp_replace(file_id, '^[a-f0-9]{{32}}_', '')), '\\.([^./\\\\]+)$', 1) AS ext, coalesce(sosok, 'Unknown') AS sosok, coalesce(site, 'Unknown') AS site FROM f)
    SELECT * FROM (SELECT 'type' AS facet, ext AS value, count(*) AS documents FROM x GROUP BY ext UNION ALL SELECT 'sosok', sosok, count(*) FROM x GROUP BY sosok UNION ALL SELECT 'site', site, count(*) FROM x GROUP BY site) WHERE value <> ''""",
)
def stats_facets(spark, d):
    return stats.facets(chunks(spark, d), ANYONE)


@query("recent_uploads", f"WITH {FILES} SELECT file_id, original_filename, sosok, site, sections, strftime(upload_date, '%Y%m%d') AS upload_date FROM f WHERE upload_date IS NOT NULL ORDER BY upload_date DESC, file_id LIMIT 10")
def recent_uploads(spark, d):
    return stats.recent_uploads(chunks(spark, d), ANYONE)


@query(
    "uploads_by_date",
    f"""WITH s AS (SELECT (DATE '{AS_OF}' - n::INT)::DATE AS day FROM range(1, 31) t(n)), u AS (SELECT upload_date AS day, count(DISTINCT file_id) AS n FROM chunks WHERE file_id <> '' AND upload_date > DATE '{AS_OF}' - 30 AND upload_date < DATE '{AS_OF}' GROUP BY 1)
    SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(u.n, 0) AS uploads FROM s LEFT JOIN u ON s.day = u.day""",
)
def uploads_by_date(spark, d):
    return stats.uploads_by_date(chunks(spark, d), ANYONE, AS_OF)


@query(
    "storage_by_extension",
    r"""WITH f AS (SELECT DISTINCT path, length FROM files), x AS (SELECT regexp_extract(lower(path), '\.([^./\\]+)$', 1) AS extension, coalesce(length, 0) AS length FROM f)
    SELECT extension, count(*) AS files, sum(length)::BIGINT AS bytes, round(sum(length) / 1048576, 2) AS mb, round(sum(length) / count(*), 2) AS average FROM x GROUP BY ROLLUP (extension)""",
)
def storage_by_extension(spark, d):
    return stats.storage(table(spark, d, "files"))


@query("unreferenced_files", "SELECT DISTINCT path, length FROM files WHERE regexp_extract(path, '([^/]*)$', 1) NOT IN (SELECT file_id FROM chunks WHERE file_id IS NOT NULL)")
def unreferenced_files(spark, d):
    return stats.unreferenced(table(spark, d, "files"), chunks(spark, d))


@query("vector_counts", f"WITH {ONCE} SELECT count(*) FILTER (len(embedding) > 0) AS vectors, count(DISTINCT file_id) AS documents, max(len(embedding))::INT AS vector_size FROM c")
def vector_counts(spark, d):
    return stats.vector_counts(chunks(spark, d))


@query(
    "upload_outcomes",
    "SELECT CASE WHEN lower(trim(status)) IN ('failed', '실패', 'fail', 'error', 'failure', '오류') THEN 'failed' ELSE 'done' END AS outcome, count(*) AS attempts, count(DISTINCT original_filename) AS names, sum(coalesce(num_pages, 0))::BIGINT AS pages FROM ingest_result GROUP BY 1",
)
def upload_outcomes(spark, d):
    return stats.upload_outcomes(table(spark, d, "ingest_result"))


@query("admitted_uploads", r"SELECT original_filename, CASE WHEN regexp_extract(lower(original_filename), '\.([^./\\]+)$', 1) IN ('pdf', 'hwpx', 'docx', 'pptx') THEN 'admitted' ELSE 'failed' END AS verdict FROM ingest_result")
def admitted_uploads(spark, d):
    good, bad = catalog.admitted(table(spark, d, "ingest_result").select("original_filename"))
    return good.select("original_filename", F.lit("admitted").alias("verdict")).union(bad.select("original_filename", F.lit("failed")))


WINDOWS = f"""t AS (SELECT file_id, page_num, unnest(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda x: x <> '')) AS token, unnest(range(1, len(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda x: x <> '')) + 1)) AS i FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page_num, i) - 1 AS pos FROM t), n AS (SELECT file_id, max(pos) AS last FROM o GROUP BY file_id),
    w AS (SELECT file_id, unnest(range(0, last + 1, 600)) AS start_token FROM n)
    SELECT w.file_id, (start_token // 600 + 1)::INT AS seq, start_token::INT AS start_token, arg_min(page_num, pos)::INT AS start_page, count(*)::INT AS n_tokens, string_agg(token, ' ' ORDER BY pos) AS content
    FROM w JOIN o ON w.file_id = o.file_id AND pos >= start_token AND pos < start_token + 700 GROUP BY w.file_id, start_token"""


@query("token_windows", f"WITH p AS (SELECT doc_id::VARCHAR AS file_id, 1 AS page_num, text FROM documents), {WINDOWS}")
def token_windows(spark, d):
    return chunk.token_windows(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.lit(1).alias("page_num"), "text"))


PAGES = f"{ONCE}, p AS (SELECT file_id, dense_rank() OVER (PARTITION BY file_id ORDER BY section_number NULLS LAST, doc_id)::INT AS page_num, content AS text FROM c WHERE file_id IS NOT NULL)"


def file_pages(spark, d) -> DataFrame:
    """A file's chunks as its pages."""
    c = chunks(spark, d).select("doc_id", "file_id", "section_number", "content").where("file_id IS NOT NULL").dropDuplicates(["doc_id"])
    w = Window.partitionBy("file_id").orderBy(F.col("section_number").asc_nulls_last(), "doc_id")
    return c.select("file_id", F.row_number().over(w).alias("page_num"), F.col("content").alias("text"))


@query("token_windows_with_pages", f"WITH {PAGES}, {WINDOWS}")
def token_windows_with_pages(spark, d):
    return chunk.token_windows(file_pages(spark, d))


@query(
    "pages_joined",
    f"WITH {ONCE} SELECT file_id, coalesce(page_number, 1) AS page_num, string_agg(section_title, chr(10) ORDER BY section_number, section_title) AS text FROM c WHERE section_title IS NOT NULL AND section_number IS NOT NULL GROUP BY file_id, coalesce(page_number, 1)",
)
def pages_joined(spark, d):
    """Paragraphs brought together by page, as for files whose reader gives page numbers."""
    c = catalog.once_each(chunks(spark, d).where("section_number IS NOT NULL"), "file_id", "section_number", "page_number", "section_title")
    return office.by_page(c.select("file_id", F.col("section_number").alias("seq"), F.col("page_number").alias("page_num"), F.col("section_title").alias("text")))


@query("manual_routing", rf"SELECT doc_id, coalesce(starts_with(regexp_replace(string_split(regexp_replace(text, '^{BLANK}+', ''), chr(10))[1], '{BLANK}+', '', 'g'), '유지보수교범'), false) AS manual FROM documents")
def manual_routing(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(catalog.is_manual(F.col("text")), F.lit(False)).alias("manual"))


@query("usable_vectors", f"SELECT DISTINCT doc_id FROM chunks WHERE {USABLE}")
def usable_vectors(spark, d):
    return search.scored(chunks(spark, d).select("doc_id", "embedding"), VECTOR).select("doc_id").distinct()


@query(
    "embedded_sections",
    rf"""WITH {PAGES} SELECT sha256(file_id || chr(31) || page_num) AS doc_id, file_id, file_id AS original_filename, '' AS section_title, page_num::VARCHAR AS section_id, page_num AS section_number, page_num AS page_number,
    '문서: ' || file_id || chr(10) || '<h2></h2>' || chr(10) || text AS content, 64 AS vector_size, true AS unit FROM p WHERE regexp_matches(text, '[^\s\x0b\x{{85}}\p{{Z}}]')""",
)
def embedded_sections(spark, d):
    """Every page as a section ready to be stored; of its vector the length and whether it has norm 1."""
    p = file_pages(spark, d)
    s = p.select("file_id", F.col("file_id").alias("original_filename"), F.col("page_num").alias("seq"), F.lit("").alias("title"), F.lit(None).cast("string").alias("section_id"), F.col("text").alias("content"), F.lit(None).cast("int").alias("page_number"), F.col("page_num").alias("start_page"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return chunk.section_records(s).withColumns({"vector_size": F.size("embedding"), "unit": F.abs(norm - 1) < 1e-5}).drop("embedding")


@query("repeated_first_lines", "WITH l AS (SELECT source, string_split(text, chr(10))[1] AS line FROM documents WHERE source IS NOT NULL), n AS (SELECT source, count(*) AS docs FROM l GROUP BY source) SELECT source, line, count(*) AS n FROM l JOIN n USING (source) WHERE trim(line) <> '' GROUP BY source, line, docs HAVING count(*) >= 2 AND count(*) / docs >= 0.01")
def repeated_first_lines(spark, d):
    lines = table(spark, d, "documents").where("source IS NOT NULL").select("source", F.split("text", "\n")[0].alias("line"))
    n = lines.groupBy("source").agg(F.count("*").alias("docs"))
    c = lines.where(F.trim("line") != "").groupBy("source", "line").agg(F.count("*").alias("n"))
    return c.join(n, "source").where((F.col("n") >= 2) & (F.col("n") / F.col("docs") >= 0.01)).select("source", "line", "n")


# The engine's distance counts bytes, so the characters of a pair become single bytes first: its n-th different character the n-th code.
CODES = "".join(chr(i) for i in range(1, 128) if chr(i) != "'")


@query(
    "similar_names",
    f"""WITH c AS (SELECT DISTINCT file_id, original_filename AS name, coalesce({strip('sosok')}, '') AS o, {strip('site')} AS p, lower({strip('original_filename')}) AS plain FROM chunks WHERE site IS NOT NULL AND original_filename IS NOT NULL),
    j AS (SELECT a.file_id AS before_id, a.name AS before, b.file_id, b.name AS original_filename, a.plain AS x, b.plain AS y, array_to_string(list_distinct(string_split(a.plain || b.plain, '')), '') AS chars, greatest(length(a.plain), length(b.plain)) AS n
        FROM c a JOIN c b ON a.o = b.o AND a.p = b.p AND ROW(a.name, a.file_id) < ROW(b.name, b.file_id) WHERE abs(length(a.plain) - length(b.plain)) <= 0.15 * greatest(length(a.plain), length(b.plain))),
    s AS (SELECT *, CASE WHEN x = y THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE 1 - levenshtein(translate(x, chars, '{CODES}'), translate(y, chars, '{CODES}')) / n END AS similarity FROM j)
    SELECT before_id, before, file_id, original_filename, similarity::DOUBLE AS similarity FROM s WHERE similarity > 0.85""",
)
def similar_names(spark, d):
    """Every two files of a site that are named nearly alike; before is the earlier name of the two."""
    c = chunks(spark, d).where("site IS NOT NULL")
    pairs = names.similar_pairs(c, "file_id", "original_filename", [site_key(F.col("sosok"), F.col("site"))])
    return pairs.select(F.col("key_b").alias("file_id"), F.col("text_b").alias("original_filename"), F.col("key_a").alias("before_id"), F.col("text_a").alias("before"), "similarity")


@query("sha256_dedupe", f"SELECT sha256({strip('text')}) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def sha256_dedupe(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(strip_blanks(F.col("text")), 256).alias("hash"))
    return t.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


SPACES = "".join(map(chr, (0xA0, 0x2002, 0x2009, 0x200B, 0x202F, 0x3000)))
CLEAN_NAME = rf"regexp_replace({strip(f"translate(original_filename, '{SPACES}', '{' ' * len(SPACES)}')")}, '{BLANK}+', ' ', 'g')"


@query("clean_names", f"SELECT DISTINCT file_id, {CLEAN_NAME} AS name FROM chunks WHERE original_filename IS NOT NULL")
def clean_names(spark, d):
    return chunks(spark, d).where("original_filename IS NOT NULL").select("file_id", clean_cell(F.col("original_filename")).alias("name")).distinct()


@query("sse_frames", f"WITH {ONCE} SELECT doc_id, 'data: ' || json_object('content', section_title)::VARCHAR || chr(10) || chr(10) AS frame FROM c WHERE section_title IS NOT NULL")
def sse_frames(spark, d):
    return catalog.once_each(chunks(spark, d).where("section_title IS NOT NULL"), "section_title").select("doc_id", sse_frame(F.col("section_title")).alias("frame"))


@query("latest_status", "SELECT task_id, max(trim(sosok)) AS sosok, max(trim(site)) AS site, arg_max(status, ROW(ts, status)) AS status, count(DISTINCT ROW(ts, status)) AS events FROM tasks GROUP BY task_id")
def latest_status(spark, d):
    return streaming.latest_status(table(spark, d, "tasks")).drop("ts")


@query(
    "task_durations",
    """WITH t AS (SELECT task_id, floor(epoch(max(ts)) - epoch(min(ts)))::BIGINT AS s FROM tasks GROUP BY task_id)
    SELECT task_id, s AS seconds, trim(CASE WHEN s >= 86400 THEN (s // 86400)::VARCHAR || '일 ' ELSE '' END || CASE WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24)::VARCHAR || '시간 ' ELSE '' END || CASE WHEN s // 60 % 60 > 0 THEN (s // 60 % 60)::VARCHAR || '분 ' ELSE '' END || CASE WHEN s % 60 > 0 OR s = 0 THEN (s % 60)::VARCHAR || '초' ELSE '' END) AS duration FROM t""",
)
def task_durations(spark, d):
    t = table(spark, d, "tasks").groupBy("task_id").agg(F.floor(F.max("ts").cast("double") - F.min("ts").cast("double")).alias("seconds"))
    return t.select("task_id", "seconds", uptime_text(F.col("seconds")).alias("duration"))


@query("stream_latest_status", "SELECT task_id, max(trim(sosok)) AS sosok, max(trim(site)) AS site, arg_max(status, ROW(ts, status)) AS status FROM tasks GROUP BY task_id")
def stream_latest_status(spark, d):
    """The status table as a stream leaves it, in update mode: of each task the row of its last batch."""
    out = streaming.run_to_table(streaming.latest_status(streaming.parquet_stream(spark, d, "tasks")), "update")
    return out.groupBy("task_id").agg(*(F.max_by(c, "batch_id").alias(c) for c in ("sosok", "site", "status")))


@query("stream_uploads_per_day", "SELECT ts::DATE AS day, count(*) AS uploads FROM tasks WHERE status = 'uploading' GROUP BY 1")
def stream_uploads_per_day(spark, d):
    """Day counts in event time, days closing two days after; update mode leaves a day's last count."""
    out = streaming.run_to_table(streaming.uploads_per_day(streaming.parquet_stream(spark, d, "tasks")), "update")
    return out.groupBy("day").agg(F.max_by("uploads", "batch_id").alias("uploads"))


@query(
    "stream_status_changes",
    """WITH e AS (SELECT concat_ws('_', trim(sosok), trim(site)) AS channel, task_id, ts, max(status) AS status FROM tasks WHERE site IS NOT NULL GROUP BY 1, 2, 3),
    l AS (SELECT *, lag(status) OVER (PARTITION BY channel, task_id ORDER BY ts) AS before FROM e)
    SELECT channel, task_id, status, epoch_us(ts) AS at_us, status IN ('uploading', 'queued', 'processing') AS active FROM l WHERE before IS DISTINCT FROM status""",
)
def stream_status_changes(spark, d):
    return streaming.run_to_table(streaming.status_changes(streaming.parquet_stream(spark, d, "tasks"))).select("channel", "task_id", "status", F.unix_micros("ts").alias("at_us"), "active")


@query("deleted_by_name", f"WITH {ONCE}, n AS (SELECT min({strip('original_filename')}) AS name FROM c WHERE {SEES_DEPARTMENT}) SELECT sosok, count(*) AS n FROM c WHERE NOT coalesce({strip('original_filename')} = (SELECT name FROM n) AND {SEES_DEPARTMENT}, false) GROUP BY sosok")
def deleted_by_name(spark, d):
    c = catalog.once_each(chunks(spark, d), "original_filename", "sosok", "site")
    name = c.where(can_see(DEPARTMENT)).agg(F.min(strip_blanks(F.col("original_filename")))).first()[0]
    return catalog.without_documents(c, DEPARTMENT, filename=name).groupBy("sosok").agg(F.count("*").alias("n"))


def title_chars(spark, d) -> DataFrame:
    """Section number and title of every chunk laid out as two lines of characters."""
    c = catalog.once_each(chunks(spark, d).where("section_title IS NOT NULL AND section_id IS NOT NULL"), "section_id", "section_title")
    two = c.select(F.col("doc_id").alias("file_id"), F.explode(F.array(F.struct(F.lit(0.0).alias("top"), F.col("section_id").alias("s")), F.struct(F.lit(14.0).alias("top"), F.col("section_title").alias("s")))).alias("r"))
    one = two.select("file_id", F.lit(1).alias("page_num"), F.col("r.top").alias("top"), F.posexplode(F.split("r.s", "")).alias("char_seq", "text")).where("text <> ''")
    return one.select("file_id", "page_num", F.lit(800.0).alias("page_height"), "char_seq", "text", (F.col("char_seq") * 7.0).alias("x0"), (F.col("char_seq") * 7.0 + 7).alias("x1"), "top", (F.col("top") + 10).alias("bottom"), F.lit(7.0).alias("width"))


@query("page_lines", f"WITH {ONCE}, t AS (SELECT doc_id AS file_id, section_id, section_title FROM c WHERE section_title IS NOT NULL AND section_id IS NOT NULL) SELECT file_id, 1 AS line_no, section_id AS text FROM t WHERE section_id <> '' UNION ALL SELECT file_id, CASE WHEN section_id = '' THEN 1 ELSE 2 END, section_title FROM t WHERE section_title <> ''")
def page_lines(spark, d):
    return layout.lines(title_chars(spark, d)).select("file_id", "line_no", "text")


def content_lines(spark, d) -> DataFrame:
    """The lines of every file's pages, fourteen points apart."""
    p = file_pages(spark, d).select("file_id", "page_num", F.posexplode(F.split("text", "\r?\n")).alias("i", "text"))
    return p.select("file_id", "page_num", (F.col("i") + 1).alias("line_no"), "text", (F.col("i") * 14.0).alias("top"), (F.col("i") * 14.0 + 10).alias("bottom"))


@query("repeated_page_edges")
def repeated_page_edges(spark, d):
    lines = content_lines(spark, d)
    return layout.repeated_edges(lines, lines.groupBy("file_id").agg(F.countDistinct("page_num").alias("n_pages"))).drop("at")


@query("page_margins")
def page_margins(spark, d):
    lines = content_lines(spark, d)
    edges = layout.repeated_edges(lines, lines.groupBy("file_id").agg(F.countDistinct("page_num").alias("n_pages")))
    return layout.margins(edges, lines.groupBy("file_id", "page_num").agg(F.max("bottom").alias("page_height")))


@query(
    "line_blocks",
    rf"""WITH {PAGES}, l AS (SELECT file_id, page_num, i AS line_no, list[i] AS text, (i - 1) * 14.0 AS top FROM (SELECT *, unnest(range(1, len(list) + 1)) AS i FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS list FROM p WHERE text IS NOT NULL)) WHERE trim(list[i]) <> ''),
    g AS (SELECT *, top - (lag(top) OVER (PARTITION BY file_id, page_num ORDER BY top) + 10) AS gap FROM l), b AS (SELECT *, 1 + count(*) FILTER (gap >= 14) OVER (PARTITION BY file_id, page_num ORDER BY top ROWS UNBOUNDED PRECEDING) AS block_no FROM g)
    SELECT file_id, page_num, block_no, string_agg(text, chr(10) ORDER BY top) AS text, min(top) AS top, max(top) + 10 AS bottom, coalesce(arg_min(gap, top), 0) > 30 AS apart FROM b GROUP BY file_id, page_num, block_no""",
)
def line_blocks(spark, d):
    """Blocks of the documents' pages, where an empty line leaves a gap."""
    return layout.block_gaps(content_lines(spark, d).where(F.trim("text") != ""), block=14.0, apart=30.0)


def grids(spark, d) -> DataFrame:
    """The slash-parted lines of every file as one table a page."""
    rows = content_lines(spark, d).where(F.col("text").contains(" / ")).select("file_id", "page_num", "line_no", F.split("text", " / ").alias("cells"))
    return rows.groupBy("file_id", "page_num").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "cells"))), lambda r: r.cells).alias("grid")).withColumn("table_idx", F.lit(1))


@query("table_texts")
def table_texts(spark, d):
    return tables.with_table_text(grids(spark, d)).select("file_id", "page_num", "text")


@query("numeric_cells", r"SELECT count(*) AS cells, count(*) FILTER (regexp_matches(v, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')) AS numbers FROM (SELECT regexp_replace(regexp_replace(regexp_replace(unnest(string_split(text, ' ')), '[,\s]', '', 'g'), 'PPS|pps|㎲|㎾|㎒|MHz|kW|%|원|\$', '', 'g'), '^[≤≥]', '') AS v FROM documents WHERE text IS NOT NULL)")
def numeric_cells(spark, d):
    w = table(spark, d, "documents").where("text IS NOT NULL").select(F.explode(F.split("text", " ")).alias("w"))
    return w.agg(F.count("*").alias("cells"), F.count(F.when(is_number(F.col("w")), 1)).alias("numbers"))


@query("manual_sections")
def manual_sections(spark, d):
    """The documents cut at dotted headings as flowing text, and as manuals by chapter."""
    p = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("file_id"), F.lit(1).alias("page_num"), "text")
    return sections.sections(p).withColumn("mode", F.lit("manual")).union(sections.sections(p, flowing=True).withColumn("mode", F.lit("flowing")))


# Soft delimiters become private-use characters first (twice, as two may share a blank); within quotes they are turned back.
HARD = "".join(f"\\x{{{ord(c):x}}}" for c in packed.HARD)
THIN = r"[ \x{a0}\p{Zs}]*"
MARKED = "\ue000\ue001\ue002\ue003\ue004"
SOFTENED = "tags"
for _c, _to in zip(packed.SOFT, MARKED, strict=True):
    for _ in range(2):
        SOFTENED = rf"regexp_replace({SOFTENED}, '({BLANK}){_c}({BLANK})', '\1{_to}\2', 'g')"
QUOTED = "\"(?:[^\"]|\"\")*\"|''(?:[^'']|'''')*''|“(?:[^”]|””)*”"


@query(
    "p3_found",
    rf"""WITH f AS (SELECT file_id, min(tags) AS tags FROM chunks WHERE file_id IS NOT NULL AND tags IS NOT NULL GROUP BY file_id),
    t AS (SELECT file_id, list_transform(regexp_extract_all({SOFTENED} || ',', '(?:{THIN}(?:{QUOTED}){THIN}|[^{HARD}{MARKED}]*)[{HARD}{MARKED}]'), lambda x: {strip("x[:-2]")}) AS l FROM f),
    v AS (SELECT file_id, list_filter(list_transform(l, lambda x: CASE WHEN regexp_full_match(x, '{QUOTED}') THEN translate(replace(x[2:-2], CASE WHEN x[1] = '“' THEN '””' ELSE x[1] || x[1] END, CASE WHEN x[1] = '“' THEN '”' ELSE x[1] END), '{MARKED}', '{packed.SOFT}') ELSE x END), lambda x: {strip("x")} <> '') AS l FROM t)
    SELECT file_id, unnest(l) AS tag, generate_subscripts(l, 1)::INT AS tag_no FROM v""",
)
def p3_found(spark, d):
    return packed.p3_found(spark, d)
