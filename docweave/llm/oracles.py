"""The SQL of the queries on training data, for those that SQL can express. It is written from the statements, not from the operators: all pairs are
compared, no signature, cell or tree is used. Only the table of mapped characters is shared."""

from __future__ import annotations

from docweave.llm.form import BLANKS, _class, char_map, quoted, unsettled_class
from docweave.session import once

BLANK = r"[\s\x0b\x{85}\p{Z}]"
SOLID = r"[^\s\x0b\x{85}\p{Z}]"


@once
def _maps() -> tuple[str, str, str, str]:
    m = char_map() | dict.fromkeys(BLANKS, " ")
    one, gone, many = [c for c in m if len(m[c]) == 1], [c for c in m if not m[c]], [c for c in m if len(m[c]) > 1]
    return quoted("".join(one + gone)), quoted("".join(m[c] for c in one)), _class(many), "[" + ", ".join(f"[{quoted(c)}, {quoted(m[c])}]" for c in many) + "]"


def form(source: str, text: str) -> str:
    """A query: the rows of ``source`` with FORM(text) as form; every mapped character in one literal, expansions by a fold."""
    old, new, many, pairs = _maps()
    one = f"SELECT *, translate({text}, {old}, {new}) AS _1 FROM {source}"
    two = f"SELECT *, CASE WHEN regexp_matches(_1, '{many}') THEN list_reduce(list_prepend([_1, ''], {pairs}), lambda a, p: [replace(a[1], p[1], p[2]), ''])[1] ELSE _1 END AS _2 FROM ({one})"
    return f"SELECT * EXCLUDE (_1, _2), trim(regexp_replace(CASE WHEN regexp_matches(_2, '{unsettled_class()}') THEN nfc_normalize(_2) ELSE _2 END, ' +', ' ', 'g')) AS form FROM ({two})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


BODIES = r"SELECT DISTINCT doc_id, replace(regexp_extract(content, '(?s)^[^\n]*\n[^\n]*\n(.*)$', 1), chr(13) || chr(10), chr(10)) AS body FROM chunks WHERE content IS NOT NULL AND doc_id IS NOT NULL"
SITE = f"coalesce({strip('sosok')}, '') AS o, {strip('site')} AS p"
STORED = f"SELECT DISTINCT file_id AS key, original_filename AS name, {SITE} FROM chunks WHERE site IS NOT NULL AND original_filename IS NOT NULL AND file_id IS NOT NULL"
ASKED = f"SELECT DISTINCT 'r' || lpad(request_id::VARCHAR, 10, '0') || ':' || i AS key, name, o, p FROM (SELECT request_id, {SITE}, site, unnest(filenames) AS name, generate_subscripts(filenames, 1) AS i FROM duplicate_requests) WHERE site IS NOT NULL AND name IS NOT NULL"


def similar(units: str, size: int, least: float) -> str:
    """CTEs over t(id, form): runs r(id, run), numbers n(id, n) and the pairs m(a, b) alike by at least ``least``."""
    return rf"""r AS MATERIALIZED (SELECT DISTINCT id, run FROM (SELECT id, unnest(CASE WHEN len(u) < {size} THEN [array_to_string(u, chr(0))] ELSE list_transform(range(1, len(u) - {size - 2}), lambda i: array_to_string(u[i:i + {size - 1}], chr(0))) END) AS run FROM (SELECT id, {units} AS u FROM t))),
    n AS (SELECT id, count(*) AS n FROM r GROUP BY id), x AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM r a JOIN r b ON a.run = b.run WHERE a.id < b.id GROUP BY 1, 2),
    m AS MATERIALIZED (SELECT a, b FROM x JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE k >= {least} * (na.n + nb.n - k) - 1e-9)"""


WORDS, CHARS = "string_split(form, ' ')", "string_split(form, '')"


@once
def p1_lines() -> str:
    """CTEs up to h(doc_id, line_no, hit)."""
    lines = f"(SELECT DISTINCT doc_id, file_id, {SITE}, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM chunks WHERE site IS NOT NULL AND file_id IS NOT NULL AND doc_id IS NOT NULL)"
    return rf"""l AS (SELECT * EXCLUDE (line, form), regexp_replace(lower(form), '\p{{Nd}}+', chr(65533), 'g') AS t FROM ({form(lines, 'line')})),
    d AS (SELECT o, p, count(DISTINCT file_id) AS files FROM (SELECT {SITE}, file_id FROM chunks WHERE site IS NOT NULL AND file_id IS NOT NULL AND doc_id IS NOT NULL) GROUP BY o, p),
    bad AS (SELECT o, p, t FROM l JOIN d USING (o, p) WHERE t <> '' GROUP BY o, p, t HAVING count(DISTINCT file_id) >= greatest(3, 0.1 * any_value(files))),
    h AS (SELECT doc_id, line_no FROM l JOIN bad USING (o, p, t))"""


def _segment(at: str, limit: int) -> str:
    """Where a segment ends that begins after unit ``at``: at the end, else at the last of the strongest kind of boundary in its second half, else at the limit."""
    w = f"reverse(substring(skel, {at} + 1, {limit}))"
    at_last = " ".join(f"WHEN strpos({w}, '{s}') BETWEEN 1 AND {limit - limit // 2 + 1} THEN {at} + {limit} + 1 - strpos({w}, '{s}')" for s in "plsw")
    return f"CASE WHEN length(skel) - {at} <= {limit} THEN length(skel) {at_last} ELSE {at} + {limit} END"


CARRIED = "doc_id, file_id, original_filename, section_id, section_title, section_number, page_number, total_pdf_pages"


def p6_pieces() -> str:
    return rf"""WITH RECURSIVE c AS (SELECT DISTINCT ON (doc_id) {CARRIED}, content FROM chunks WHERE content IS NOT NULL ORDER BY doc_id),
    u AS (SELECT *, regexp_extract_all(content, '(?:\A{BLANK}+)?{SOLID}+{BLANK}*') AS w FROM c),
    k AS (SELECT *, array_to_string(list_transform(w, lambda x: CASE WHEN contains(x, chr(10)) THEN CASE WHEN regexp_matches(x, '\n{BLANK}*\n') THEN 'p' ELSE 'l' END
        WHEN regexp_matches(x, '[.!?。！？…]["''”’)\]]{{0,2}}{BLANK}*$') THEN 's' ELSE 'w' END), '') AS skel FROM u WHERE len(w) > 700),
    r AS (SELECT doc_id, 1 AS piece_no, 0 AS a, {_segment('0', 700)} AS b FROM k UNION ALL SELECT r.doc_id, piece_no + 1, b, {_segment('b', 600)} FROM r JOIN k ON r.doc_id = k.doc_id WHERE b < length(skel)),
    e AS (SELECT k.*, piece_no, CASE WHEN a > 0 THEN a - 100 ELSE 0 END AS f, b FROM r JOIN k ON r.doc_id = k.doc_id)
    SELECT {CARRIED}, piece_no, length(array_to_string(w[1:f], ''))::INT AS start, array_to_string(w[f + 1:b], '') AS piece FROM e"""


def oracle_sql() -> dict[str, str]:
    usable = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0"
    p5 = f"""b AS ({form(f"({BODIES})", 'body')}), s AS ({form(f"({STORED})", 'name')}), q AS ({form(f"({ASKED})", 'name')})"""
    return {
        "p1_found": f"WITH {p1_lines()} SELECT DISTINCT doc_id, line_no FROM h",
        "p1_clean": f"""WITH {p1_lines()}, c AS (SELECT DISTINCT doc_id, content FROM chunks), v AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM c),
            k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM v WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = v.doc_id AND h.line_no = v.line_no) GROUP BY doc_id)
            SELECT doc_id, CASE WHEN c.content IS NULL THEN NULL ELSE coalesce(k.content, '') END AS content FROM c LEFT JOIN k USING (doc_id)""",
        "p2_found": f"""WITH b AS ({form(f"({BODIES})", 'body')}), c AS (WITH t AS (SELECT doc_id AS id, lower(form) AS form FROM b WHERE len(string_split(form, ' ')) >= 3), {similar(WORDS, 3, 0.6)} SELECT a, b FROM m),
            f AS (WITH s AS (SELECT *, 0 AS side FROM ({form(f"({STORED})", 'name')}) UNION ALL SELECT *, 1 FROM ({form(f"({ASKED})", 'name')})), z AS (SELECT o || chr(1) || p AS site, key, side, lower(form) AS form FROM s WHERE form <> ''),
                t AS (SELECT DISTINCT site || chr(2) || form AS id, form FROM z), {similar(CHARS, 3, 0.6)}, both_ways AS (SELECT a, b FROM m UNION SELECT b, a FROM m UNION SELECT id, id FROM t)
                SELECT DISTINCT x.key AS a, y.key AS b FROM both_ways JOIN z x ON x.site || chr(2) || x.form = both_ways.a JOIN z y ON y.site || chr(2) || y.form = both_ways.b WHERE x.side = 0 AND y.side = 1 AND x.site = y.site)
            SELECT 'content' AS field_name, a AS key_a, b AS key_b FROM c UNION ALL SELECT 'filenames', least(a, b), greatest(a, b) FROM f""",
        "p2_classes": f"""WITH RECURSIVE b AS MATERIALIZED (SELECT doc_id, lower(form) AS form FROM ({form(f"({BODIES})", 'body')})),
            g AS MATERIALIZED (SELECT doc_id, md5(array_to_string(list_sort(list_distinct(CASE WHEN len({WORDS}) < 5 THEN [form] ELSE list_transform(range(1, len({WORDS}) - 3), lambda i: array_to_string(({WORDS})[i:i + 4], ' ')) END)), chr(0))) AS k, form FROM b WHERE form <> ''),
            t AS MATERIALIZED (SELECT k AS id, any_value(form) AS form FROM g GROUP BY k), {similar(WORDS, 5, 0.8)}, e AS MATERIALIZED (SELECT a, b FROM m UNION SELECT b, a FROM m),
            reach AS (SELECT id AS a, id AS b FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), first AS (SELECT k, min(doc_id) AS doc_id, count(*) - 1 AS copies FROM g GROUP BY k),
            label AS (SELECT reach.a AS k, min(first.doc_id) AS class_id FROM reach JOIN first ON first.k = reach.b GROUP BY reach.a), links AS (SELECT a AS k, count(*) AS links FROM e GROUP BY a)
            SELECT doc_id, class_id, coalesce(links, 0) AS links, copies FROM g JOIN label USING (k) JOIN (SELECT k, copies FROM first) USING (k) LEFT JOIN links USING (k)
            UNION ALL SELECT DISTINCT doc_id, doc_id, 0, 0 FROM chunks WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM g)""",
        "p4_found": f"""WITH u AS (SELECT DISTINCT doc_id, embedding::DOUBLE[] AS e FROM chunks WHERE doc_id IS NOT NULL AND {usable}), s AS (SELECT a.doc_id, b.doc_id AS neighbor_id, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.doc_id <> b.doc_id)
            SELECT doc_id, neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 12) DESC, neighbor_id) AS r FROM s WHERE c >= 0.85) WHERE r <= 5""",
        "p5_found": f"""WITH {p5} SELECT DISTINCT 'content' AS field_name, x.doc_id AS key_a, y.doc_id AS key_b FROM b x JOIN b y ON x.form = y.form AND x.body <> y.body AND x.doc_id < y.doc_id
            UNION ALL SELECT DISTINCT 'filenames', least(s.key, q.key), greatest(s.key, q.key) FROM s JOIN q ON s.form = q.form AND s.o = q.o AND s.p = q.p AND s.name <> q.name""",
        "p5_classes": f"""WITH b AS ({form(f"({BODIES})", 'body')}) SELECT doc_id, min(doc_id) OVER w AS class_id, count(DISTINCT body) OVER w AS spellings, count(*) OVER w AS records FROM b WINDOW w AS (PARTITION BY form)""",
        "p5_forms": f"""WITH c AS (SELECT DISTINCT doc_id, content, original_filename FROM chunks), t AS ({form('c', 'content')}), f AS ({form('c', 'original_filename')}),
            r AS (SELECT request_id, unnest(filenames) AS name, generate_subscripts(filenames, 1)::INT AS place FROM duplicate_requests), q AS ({form('r', 'name')})
            SELECT t.doc_id, t.form AS content_form, f.form AS filename_form, NULL::BIGINT AS request_id, NULL::INT AS place FROM t JOIN f USING (doc_id) UNION ALL SELECT NULL, NULL, form, request_id, place FROM q""",
        "p6_found": f"SELECT DISTINCT doc_id FROM chunks WHERE len(list_filter(regexp_split_to_array(content, '{BLANK}+'), lambda w: w <> '')) > 700",
        "p6_pieces": p6_pieces(),
        "p7_checked": "SELECT spec_name, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS overfull, 0 AS torn, 0 AS cut_in_vain FROM pack_specs",
        "p8_checked": "SELECT source, (SELECT count(*) FROM documents d WHERE d.source = t.source AND text <> '') AS records_at_hand, 0 AS wrong_uses, 0 AS off_goal FROM mix_targets t",
    }
