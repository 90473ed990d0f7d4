"""Queries over pages of characters, tables, stored states and event lines that are laid out from the test tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave import streaming
from docweave.functions import maps
from docweave.functions.text import normalized
from docweave.operators import catalog, chunk, layout, stats, tables
from docweave.operators.access import Principal
from docweave.plans.queries import ANYONE, BLANK, CODES, DEPARTMENT, ONCE, PAGES, SEES_DEPARTMENT, SQL, chunks, content_lines, file_pages, query, strip
from docweave.session import scratch_dir, strip_blanks, table
from docweave.sources import chunkstore, office

# Titles as characters 7 points wide, with 3 points more before every fifth; of three successive ones the tops are 0, 3 and 6 points down.
TITLES = f"{ONCE}, t AS (SELECT doc_id AS file_id, section_title AS s FROM c WHERE section_title IS NOT NULL)"
CHARS = f"""{TITLES}, k AS (SELECT file_id, s[i] AS text, i - 1 AS seq, (i - 1) * 7.0 + (i - 1) // 5 * 3.0 AS x0, (i - 1) % 3 * 3.0 AS top FROM (SELECT file_id, s, unnest(range(1, length(s) + 1)) AS i FROM t))"""


def laid_out(spark, d: str) -> DataFrame:
    c = catalog.once_each(chunks(spark, d).where("section_title IS NOT NULL"), "section_title")
    k = c.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("section_title", "")).alias("i", "text")).where("text <> ''")
    x0 = F.col("i") * 7.0 + F.floor(F.col("i") / 5) * 3.0
    return k.select("file_id", F.lit(1).alias("page_num"), F.lit(100.0).alias("page_height"), F.col("i").alias("char_seq"), "text", x0.alias("x0"), (x0 + 7.0).alias("x1"), (F.col("i") % 3 * 3.0).alias("top"), (F.col("i") % 3 * 3.0 + 10.0).alias("bottom"), F.lit(7.0).alias("width"))


@query(
    "lines_of_characters",
    f"""WITH {CHARS}, l AS (SELECT *, CASE WHEN top <= 3 THEN 1 ELSE 2 END AS line_no FROM k), g AS (SELECT *, x0 - (lag(x0) OVER w + 7) > 2.1 AS gap FROM l WINDOW w AS (PARTITION BY file_id, line_no ORDER BY x0))
    SELECT file_id, line_no, string_agg(CASE WHEN gap THEN ' ' || text ELSE text END, '' ORDER BY x0) AS text, min(x0) AS x0, max(x0) + 7 AS x1, min(top) AS top, max(top) + 10 AS bottom FROM g GROUP BY file_id, line_no""",
)
def lines_of_characters(spark, d):
    """Tops 0 and 3 are one line, as they are within the tolerance of its first; 6 begins the next, though it is within that of 3. Gaps of more than 0.3 widths are blanks."""
    return layout.lines(laid_out(spark, d)).select("file_id", "line_no", "text", "x0", "x1", "top", "bottom")


@query(
    "characters_and_boxes",
    f"WITH {CHARS} SELECT file_id, count(*) FILTER (x0 BETWEEN 14 AND 40 AND top BETWEEN 0 AND 3) AS inside, count(*) FILTER (NOT (x0 BETWEEN 14 AND 40 AND top BETWEEN 0 AND 3)) AS outside, count(*) FILTER (top >= 3 AND top + 10 <= 15) AS kept FROM k GROUP BY file_id",
)
def characters_and_boxes(spark, d):
    """Of each page the characters in a box, outside of all, and within margins of 3 and 85 %."""
    k = laid_out(spark, d)
    boxes = k.select("file_id", "page_num").distinct().select("*", F.lit(1).alias("table_idx"), F.lit(14.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(3.0).alias("y1"))
    parts = [layout.in_boxes(k, boxes).select("file_id", F.lit("inside").alias("part")), layout.outside_boxes(k, boxes).select("file_id", F.lit("outside").alias("part")), layout.within_margins(k, 0.03, 0.85).select("file_id", F.lit("kept").alias("part"))]
    both = parts[0].union(parts[1]).union(parts[2])
    return both.groupBy("file_id").agg(*(F.count(F.when(F.col("part") == p, 1)).alias(p) for p in ("inside", "outside", "kept")))


LINES = rf"{PAGES}, l AS (SELECT file_id, page_num, i AS line_no, list[i] AS text, (i - 1) * 14.0 AS top FROM (SELECT *, unnest(range(1, len(list) + 1)) AS i FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS list FROM p WHERE text IS NOT NULL)))"


def edges_sql() -> str:
    """CTEs up to best(file_id, edge, place, text, pages, share, score) and at(..., page_num, top): the greedy groups as a fold over a list of different lines."""
    chars = "array_to_string(list_distinct(string_split(x.n || y.n, '')), '')"
    longest = "greatest(length(x.n), length(y.n))"

    def match(x: str, y: str) -> str:
        near = f"abs(length(x.n) - length(y.n)) < 0.15 * {longest} AND x.n <> '' AND y.n <> '' AND 1 - levenshtein(translate(x.n, {chars}, '{CODES}'), translate(y.n, {chars}, '{CODES}')) / {longest} > 0.85"
        return f"(x.n = y.n OR ({near}))".replace("x.n", f"{x}.n").replace("y.n", f"{y}.n")

    return f"""{LINES}, t AS (SELECT file_id, page_num, line_no, trim(text) AS text, top FROM l WHERE trim(text) <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY file_id, page_num ORDER BY line_no) AS a, row_number() OVER (PARTITION BY file_id, page_num ORDER BY line_no DESC) AS b FROM t),
    e AS MATERIALIZED (SELECT file_id, page_num, 'top' AS edge, a AS place, text, top FROM r WHERE a <= 3 UNION ALL SELECT file_id, page_num, 'bottom', b, text, top FROM r WHERE b <= 3),
    d AS (SELECT file_id, edge, place, text, min(page_num) AS first FROM e GROUP BY file_id, edge, place, text),
    g AS (SELECT file_id, edge, place, list({{'t': text, 'n': lower({strip('text')})}} ORDER BY first, text) AS texts FROM d GROUP BY file_id, edge, place),
    h AS MATERIALIZED (SELECT *, list_reduce(list_transform(texts, lambda v: [v]), lambda s, v: CASE WHEN len(list_filter(s, lambda x: {match('x', 'v[1]')})) > 0 THEN s ELSE list_concat(s, v) END) AS heads FROM g),
    f AS MATERIALIZED (SELECT file_id, edge, place, y.t AS text, list_filter(heads, lambda x: {match('x', 'y')})[1].t AS head FROM (SELECT *, unnest(texts) AS y FROM h)),
    k AS (SELECT file_id, edge, place, head AS text, count(*) AS pages, stddev_pop(top + 5) AS sd FROM e JOIN f USING (file_id, edge, place, text) GROUP BY file_id, edge, place, head),
    n AS (SELECT file_id, count(DISTINCT page_num) AS n FROM l GROUP BY file_id), z AS (SELECT *, pages / n AS share, pages / n / (1 + sd) AS score FROM k JOIN n USING (file_id) WHERE pages / n >= 0.4),
    best AS (SELECT file_id, edge, place, text, pages, share, score FROM (SELECT *, row_number() OVER (PARTITION BY file_id, edge ORDER BY score DESC, place, text) AS q FROM z) WHERE q = 1)"""


SQL["repeated_page_edges"] = f"WITH {edges_sql()} SELECT * FROM best"
SQL["page_margins"] = f"""WITH {edges_sql()}, spots AS (SELECT best.file_id, best.edge, e.page_num, e.top FROM best JOIN f ON f.file_id = best.file_id AND f.edge = best.edge AND f.place = best.place AND f.head = best.text
        JOIN e ON e.file_id = f.file_id AND e.edge = f.edge AND e.place = f.place AND e.text = f.text),
    p2 AS (SELECT file_id, page_num, max(top + 10) AS height FROM l GROUP BY file_id, page_num),
    cuts AS (SELECT file_id, edge, least(0.3, (CASE WHEN edge = 'top' THEN top + 10 + greatest(height * 0.01, 10) ELSE height - top + greatest(height * 0.01, 10) END) / height) AS cut FROM spots JOIN p2 USING (file_id, page_num)),
    m AS (SELECT file_id, avg(cut) FILTER (edge = 'top') AS top, avg(cut) FILTER (edge = 'bottom') AS bottom FROM cuts GROUP BY file_id)
    SELECT file_id, coalesce(m.top, 0) AS top, coalesce(m.bottom, 0) AS bottom FROM (SELECT DISTINCT file_id FROM p2) LEFT JOIN m USING (file_id)"""


@query(
    "page_edges",
    f"""WITH {LINES}, e AS (SELECT *, row_number() OVER (PARTITION BY file_id, page_num ORDER BY line_no) AS a, row_number() OVER (PARTITION BY file_id, page_num ORDER BY line_no DESC) AS b FROM l WHERE trim(text) <> '')
    SELECT file_id, page_num, 'top' AS edge, a AS place, text FROM e WHERE a <= 3 UNION ALL SELECT file_id, page_num, 'bottom', b, text FROM e WHERE b <= 3""",
)
def page_edges(spark, d):
    """The first and last three lines with text of every page."""
    return layout.edge_lines(content_lines(spark, d)).select("file_id", "page_num", "edge", "place", "text")


@query(
    "pages_put_together",
    f"""WITH {LINES}, i AS (SELECT file_id, page_num, string_agg('<img src="' || file_id || '-' || n || '.png">', chr(10) ORDER BY n) AS tags FROM (SELECT DISTINCT file_id, page_num FROM l WHERE page_num = 2), (VALUES (1), (2)) v(n) GROUP BY file_id, page_num),
    b AS (SELECT file_id, page_num, top, 0 AS kind, text FROM l UNION ALL SELECT DISTINCT file_id, page_num, 20.0, 1, '[표]' FROM l), x AS (SELECT file_id, page_num, string_agg(text, chr(10) ORDER BY top, kind) AS text FROM b GROUP BY file_id, page_num)
    SELECT file_id, page_num, CASE WHEN tags IS NULL THEN text ELSE text || chr(10) || tags END AS text FROM x LEFT JOIN i USING (file_id, page_num)""",
)
def pages_put_together(spark, d):
    """Every page's lines with a table's text between the second and the third, and two images after the second pages."""
    lines = content_lines(spark, d).where("text IS NOT NULL")
    pages = lines.select("file_id", "page_num").distinct()
    found = pages.select("*", F.lit(20.0).alias("top"), F.lit("[표]").alias("text"))
    images = pages.where("page_num = 2").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx")).withColumn("url", F.concat("file_id", F.lit("-"), F.col("idx").cast("string"), F.lit(".png")))
    return layout.page_texts(lines, found, images)


@query(
    "limit_tables",
    rf"""WITH {ONCE}, r AS (SELECT file_id, string_agg(CASE WHEN starts_with(n, '→') THEN '' ELSE '<br>' END || n || CASE WHEN lo <> '' THEN '<br>  하한치: ' || lo ELSE '' END || CASE WHEN hi <> '' THEN '<br>  상한치: ' || hi ELSE '' END, '<br>' ORDER BY doc_id) AS body
        FROM (SELECT doc_id, file_id, {strip(f"regexp_replace(section_title, '({BLANK}|{chr(0x200B)})+', ' ', 'g')")} AS n, section_number::VARCHAR AS lo, page_number::VARCHAR AS hi FROM c WHERE file_id IS NOT NULL AND section_number IS NOT NULL AND page_number IS NOT NULL AND regexp_matches(section_title, '[^\s\x0b\x{{85}}\p{{Z}}\x{{200b}}]')) GROUP BY file_id)
    SELECT file_id, '[표 1 - 페이지 1 시작]<br>헤더: 점검' || chr(9) || '하한치' || chr(9) || '상한치<br>' || body || '<br>[표 1 - 페이지 1 끝]' AS text FROM r""",
)
def limit_tables(spark, d):
    """A file's sections as one table of limits, rendered as an outline."""
    c = catalog.once_each(chunks(spark, d).where("file_id IS NOT NULL AND section_number IS NOT NULL AND page_number IS NOT NULL"), "file_id", "section_title", "section_number", "page_number").where(F.col("section_title").rlike(r"(?U)[^\s\u200b]"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "section_title", "section_number", "page_number"))), lambda r: F.array(r.section_title, r.section_number.cast("string"), r.page_number.cast("string")))
    grid = F.concat(F.array(F.array(F.lit("점검"), F.lit("하한치"), F.lit("상한치"))), rows)
    return tables.with_table_text(c.groupBy("file_id").agg(grid.alias("grid")).select("file_id", F.lit(1).alias("page_num"), F.lit(1).alias("table_idx"), "grid")).select("file_id", "text")


NUMBERS = "file_id IS NOT NULL AND section_number IS NOT NULL AND page_number IS NOT NULL AND total_pdf_pages IS NOT NULL"


@query(
    "record_tables",
    f"""WITH {ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY doc_id) AS i FROM c WHERE {NUMBERS})
    SELECT file_id, '[표 1 - 페이지 1 시작]<br>헤더: 번호 | 값 | Item<br>' || string_agg(chr(10) || '레코드 ' || i || ':<br>  번호: ' || section_number || '<br>  값: ' || page_number || '<br>  Item:<br>    - ' || total_pdf_pages || '<br>    - ' || section_number, '<br>' ORDER BY i) || '<br>[표 1 - 페이지 1 끝]' AS text FROM r GROUP BY file_id""",
)
def record_tables(spark, d):
    """A file's sections as one table of records; the last cell has two lines."""
    c = catalog.once_each(chunks(spark, d).where(NUMBERS), "file_id", "section_number", "page_number", "total_pdf_pages")
    cells = [F.col(x).cast("string") for x in ("section_number", "page_number")] + [F.concat_ws("\n", F.col("total_pdf_pages").cast("string"), F.col("section_number").cast("string"))]
    rows = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.array(*cells).alias("r")))), lambda x: x.r)
    grid = F.concat(F.array(F.array(F.lit("번호"), F.lit("값"), F.lit("Item"))), rows)
    return tables.with_table_text(c.groupBy("file_id").agg(grid.alias("grid")).select("file_id", F.lit(1).alias("page_num"), F.lit(1).alias("table_idx"), "grid")).select("file_id", "text")


@query(
    "store_changes",
    f"""WITH {ONCE}, v AS (SELECT * FROM c WHERE len(embedding) > 0), f AS (SELECT min(file_id) AS a, max(file_id) AS b FROM v WHERE file_id <> ''),
    t AS (SELECT *, CASE WHEN file_id = (SELECT a FROM f) THEN 'new, tags' ELSE array_to_string(list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda t: {strip('t')}), lambda t: t <> ''), ', ') END AS now FROM v WHERE file_id IS DISTINCT FROM (SELECT b FROM f) AND coalesce(section_number, 0) <> 2)
    SELECT sosok, now AS tags, count(*) AS n, max(len(embedding))::INT AS vector_size FROM t GROUP BY sosok, now""",
)
def store_changes(spark, d):
    """The chunk table created, filled by two appends, a file's tags changed, another file deleted by id, rows deleted by doc_id; then what is in it."""
    c = table(spark, d, "chunks").dropDuplicates(["doc_id"])
    store = chunkstore.ChunkStore(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    store.create()
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    store.append(c.where(first))
    store.append(c.where(~first))
    f = store.read().where("file_id <> ''").agg(F.min("file_id").alias("a"), F.max("file_id").alias("b")).first()
    store.retag(f["a"], "new,, tags ", ANYONE)
    store.delete(ANYONE, file_id=f["b"])
    store.delete(ANYONE, ids=store.read().where("section_number = 2"))
    return store.read().groupBy("sosok", "tags").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("vector_size"))


@query(
    "upload_days",
    f"""WITH {ONCE}, f AS (SELECT file_id, arg_min(doc_id, ROW(coalesce(section_number, 2147483647), doc_id)) AS id, min(upload_date) AS upload_date FROM c WHERE file_id <> '' GROUP BY file_id),
    w AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS file_id, max(modificationtime) AS written FROM files GROUP BY 1)
    SELECT f.file_id, coalesce(nullif(regexp_extract(id, '\\d{{8}}'), ''), strftime(upload_date, '%Y%m%d'), strftime(written, '%Y%m%d'), '20250101') AS day FROM f LEFT JOIN w USING (file_id)""".replace("\\\\d", "\\d"),
)
def upload_days(spark, d):
    return stats.upload_days(chunks(spark, d), table(spark, d, "files"), ANYONE, "20250101")


@query("page_chunks", f"WITH {PAGES} SELECT file_id, page_num AS seq, page_num AS start_page, text AS content FROM p WHERE {strip('text')} <> ''")
def page_chunks(spark, d):
    return chunk.page_chunks(file_pages(spark, d))


@query("storage_restricted", f"SELECT NULL::VARCHAR AS extension, NULL::BIGINT AS files, NULL::BIGINT AS bytes, NULL::DOUBLE AS mb, NULL::DOUBLE AS average, 'restricted' AS access_level, '{stats.RESTRICTED}' AS message")
def storage_restricted(spark, d):
    return stats.storage_for(table(spark, d, "files"), DEPARTMENT)


@query(
    "storage_for_admin",
    r"""WITH f AS (SELECT DISTINCT path, length FROM files), x AS (SELECT regexp_extract(lower(path), '\.([^./\\]+)$', 1) AS extension, coalesce(length, 0) AS length FROM f)
    SELECT extension, count(*) AS files, sum(length)::BIGINT AS bytes, round(sum(length) / 1048576, 2) AS mb, round(sum(length) / count(*), 2) AS average, 'admin' AS access_level, NULL::VARCHAR AS message FROM x GROUP BY ROLLUP (extension)""",
)
def storage_for_admin(spark, d):
    return stats.storage_for(table(spark, d, "files"), ANYONE)


@query("named_documents", f"WITH n AS (SELECT DISTINCT {strip('original_filename')} AS name FROM chunks WHERE original_filename IS NOT NULL AND {SEES_DEPARTMENT} ORDER BY name LIMIT 3) SELECT DISTINCT doc_id, original_filename FROM chunks WHERE {strip('original_filename')} IN (SELECT name FROM n)")
def named_documents(spark, d):
    """The chunks of three files by name."""
    c = chunks(spark, d)
    first = [r.name for r in stats.files(c, DEPARTMENT).where("original_filename IS NOT NULL").select(strip_blanks(F.col("original_filename")).alias("name")).distinct().orderBy("name").limit(3).collect()]
    return catalog.once_each(c.where(catalog.named(first)), "original_filename")


@query("access_levels", "WITH p(sosok, site) AS (VALUES ('관리자', '관리자'), ('항로지원부', '항로지원부_전체'), ('탐지운용부', '가온레이더소'), ('관리자', 'x'), (NULL, NULL)) SELECT sosok, site, CASE WHEN sosok = '관리자' AND site = '관리자' THEN 'admin' WHEN coalesce(site, '') LIKE '%\\_전체' ESCAPE '\\' THEN 'department' ELSE 'normal' END AS level FROM p".replace("\\\\", "\\"))
def access_levels(spark, d):
    who = [Principal("관리자", "관리자"), DEPARTMENT, Principal("탐지운용부", "가온레이더소"), Principal("관리자", "x"), Principal()]
    return spark.createDataFrame([(p.sosok, p.site, p.level) for p in who], "sosok string, site string, level string")


@query("normalized_titles", rf"WITH {ONCE} SELECT doc_id, {strip(f"regexp_replace(translate(section_title, '{chr(0xA0)}{chr(0x200B)}', ' '), '{BLANK}+', ' ', 'g')")} AS title FROM c WHERE section_title IS NOT NULL")
def normalized_titles(spark, d):
    return catalog.once_each(chunks(spark, d).where("section_title IS NOT NULL"), "section_title").select("doc_id", normalized(F.col("section_title")).alias("title"))


@query(
    "character_windows",
    """WITH t AS (SELECT doc_id::VARCHAR AS file_id, text FROM documents WHERE text <> ''), w AS (SELECT file_id, text, unnest(range(0, length(text), 600)) AS a FROM t)
    SELECT file_id, (a // 600 + 1)::INT AS seq, a::INT AS start_token, least(700, length(text) - a)::INT AS n_tokens, substring(text, a + 1, 700) AS content FROM w""",
)
def character_windows(spark, d):
    """Token windows with a tokenizer of the caller's, here one that gives characters."""
    p = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.lit(1).alias("page_num"), "text")
    return chunk.token_windows(p, tokenizer=list, joiner="").select("file_id", "seq", "start_token", "n_tokens", "content")


@query(
    "gpu_figures",
    "SELECT p_partkey::DOUBLE AS idx, p_name AS name, p_size::DOUBLE AS temperature, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size::DOUBLE END AS utilization, p_size::DOUBLE AS memory_used, 50.0::DOUBLE AS memory_total, NULL::DOUBLE AS power_draw, 9.5::DOUBLE AS power_limit, 0.0::DOUBLE AS fan, round(p_size * 100.0 / 50.0, 1) AS memory_percent FROM part",
)
def gpu_figures(spark, d):
    """The lines a GPU monitor would print of the parts."""
    p = table(spark, d, "part")
    share = F.when(F.col("p_size") % 3 == 0, F.lit("[N/A]")).otherwise(F.col("p_size").cast("string"))
    line = F.concat_ws(", ", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string"), share, F.col("p_size").cast("string"), F.lit("50"), F.lit("[Not Supported]"), F.lit("9.5"), F.lit("0"))
    return chunkstore.gpu_metrics(p.select(line.alias("value")))


@query(
    "model_streams",
    f"WITH {ONCE} SELECT doc_id AS stream_id, section_title AS content, 'lookup' AS tool, json_object('section', section_number)::VARCHAR AS arguments FROM c WHERE section_title IS NOT NULL AND section_number IS NOT NULL",
)
def model_streams(spark, d):
    """Every section as a model's event lines: its title in two parts, a tool call in two parts, a broken line, the end, and a late part."""
    c = catalog.once_each(chunks(spark, d).where("section_title IS NOT NULL AND section_number IS NOT NULL"), "section_title", "section_number")

    def delta(x):
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(x.alias("delta"))).alias("choices"))))

    def said(text):
        return delta(F.struct(text.alias("content")))

    def called(name, text):
        return delta(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(name.alias("name"), text.alias("arguments")).alias("function"))).alias("tool_calls")))

    args = F.to_json(F.struct(F.col("section_number").alias("section")))
    half = F.floor(F.length("section_title") / 2).cast("int")
    title = F.col("section_title")
    lines = [said(title.substr(F.lit(1), half)), F.lit("data: {broken"), called(F.lit("lookup"), F.substring(args, 1, 5)), said(title.substr(half + 1, F.length(title))), called(F.lit(None).cast("string"), args.substr(F.lit(6), F.length(args))), F.lit("data: [DONE]"), said(F.lit("late"))]
    parts = streaming.sse_parts(c.select(F.col("doc_id").alias("stream_id"), F.posexplode(F.array(*lines)).alias("seq", "line")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x.content), "")
    calls = streaming.tool_calls(parts).select("stream_id", F.col("name").alias("tool"), "arguments")
    return parts.where("content IS NOT NULL").groupBy("stream_id").agg(text.alias("content")).join(calls, "stream_id")


CHANNELS = "k AS (SELECT concat_ws('_', trim(sosok), trim(site)) AS channel, task_id, arg_max(status, ROW(ts, status)) AS status, max(ts) AS ts FROM tasks WHERE site IS NOT NULL GROUP BY 1, 2)"
ACTIVE = "status IN ('uploading', 'queued', 'processing')"


@query(
    "channel_replies",
    f"""WITH {CHANNELS}, n AS (SELECT channel, min(task_id) AS one, bool_or({ACTIVE}) AS busy, count(*) AS n, count(*) FILTER ({ACTIVE}) AS open, bool_or(task_id = m AND {ACTIVE}) AS was_open FROM (SELECT *, min(task_id) OVER (PARTITION BY channel) AS m FROM k) GROUP BY channel)
    SELECT channel, 1 AS seq, 'pong' AS reply, NULL::INT AS left_over FROM n UNION ALL SELECT channel, 2, 'task_update', n::INT FROM n UNION ALL SELECT channel, 3, 'task_update', (n - 1)::INT FROM n
    UNION ALL SELECT channel, 4, CASE WHEN open - was_open::INT > 0 THEN 'task_update' ELSE 'ping' END, CASE WHEN open - was_open::INT > 0 THEN (n - 1)::INT END FROM n
    UNION ALL SELECT channel, 5, 'task_update', (open - was_open::INT)::INT FROM n UNION ALL SELECT channel, 6, CASE WHEN open - was_open::INT > 0 THEN 'task_update' ELSE 'ping' END, CASE WHEN open - was_open::INT > 0 THEN (open - was_open::INT)::INT END FROM n""",
)
def channel_replies(spark, d):
    """On every channel a ping, a refresh, the dismissal of its first task, a heartbeat, the dismissal of all that have ended, and a heartbeat: the kind of each reply, and how many tasks it lists."""
    tasks = table(spark, d, "tasks")
    first = streaming.channels(tasks).groupBy("channel").agg(F.min("task_id").alias("one"))
    kinds = ["ping", "refresh", "dismiss_task", "heartbeat", "dismiss_all_completed", "heartbeat", "nonsense"]
    commands = first.select("channel", "one", F.posexplode(F.array(*map(F.lit, kinds))).alias("i", "type")).select("channel", (F.col("i") + 1).alias("seq"), "type", F.when(F.col("type") == "dismiss_task", F.col("one")).alias("task_id"))
    return streaming.channel_replies(tasks, commands).select("channel", "seq", "reply", F.when(F.col("tasks").isNotNull(), F.size("tasks")).alias("left_over"))


@query(
    "merged_fields",
    f"""WITH {ONCE} SELECT doc_id, CASE WHEN page_number IS NULL THEN 'page=' || coalesce(total_pdf_pages::VARCHAR, '') ELSE 'page=' || page_number END || ';section=' || coalesce(section_id, '') AS fields FROM c""",
)
def merged_fields(spark, d):
    """A file's fields overlaid by the chunk's own, where it has any."""
    c = catalog.once_each(chunks(spark, d), "page_number", "total_pdf_pages", "section_id")
    file = F.create_map(F.lit("page"), F.coalesce(F.col("total_pdf_pages").cast("string"), F.lit("")), F.lit("section"), F.lit(""))
    own = F.map_filter(F.create_map(F.lit("page"), F.col("page_number").cast("string"), F.lit("section"), F.col("section_id")), lambda _, v: v.isNotNull())
    both = F.sort_array(F.map_entries(maps.merged(file, own)))
    return c.select("doc_id", F.array_join(F.transform(both, lambda e: F.concat_ws("=", e.key, e.value)), ";").alias("fields"))


@query(
    "status_counts",
    "WITH c AS (SELECT trim(sosok) AS sosok, status, count(*) AS n FROM tasks WHERE status IS NOT NULL GROUP BY 1, 2) SELECT sosok, string_agg(status || '=' || n, ';' ORDER BY status) AS counts FROM c GROUP BY sosok",
)
def status_counts(spark, d):
    """Of each organisation how often each status comes, as a map."""
    t = maps.counted(table(spark, d, "tasks").select(F.trim("sosok").alias("sosok"), "status"), ["sosok"], "status")
    return t.select("sosok", F.array_join(F.transform(F.sort_array(F.map_entries("counts")), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ";").alias("counts"))


@query("images_worth_keeping", "SELECT n_nationkey::INT AS idx FROM nation WHERE n_nationkey % 3 = 2")
def images_worth_keeping(spark, d):
    """Of three kinds of grey images those that say something: one colour, too small, and two colours in turn."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("idx"))
    kind = F.col("idx") % 3
    width = F.when(kind == 1, 5).otherwise(20)
    data = F.when(kind == 2, F.repeat(F.lit("AB"), F.lit(200))).otherwise(F.repeat(F.lit("A"), width * 20)).cast("binary")
    return office.worth_keeping(n.select("idx", width.alias("width"), F.lit(20).alias("height"), F.lit(1).alias("channels"), data.alias("data"))).select("idx")
