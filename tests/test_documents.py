"""Layout, tables, sections, office files, the chunk store and streams."""

import io
import random
import zipfile

import pytest

from docweave import streaming
from docweave.operators import layout, sections, tables
from docweave.operators.access import Principal
from docweave.sources import chunkstore, office


def chars(spark, rows):
    return spark.createDataFrame(rows, "file_id string, page_num int, page_height double, char_seq int, text string, x0 double, x1 double, top double, bottom double, width double")


def test_lines_are_anchored_at_their_first_character(spark):
    d = chars(spark, [("f", 1, 800.0, i, c, x, x + 5, t, t + 8, 5.0) for i, (c, x, t) in enumerate([("a", 0.0, 0.0), ("b", 5.0, 3.0), ("c", 12.0, 6.0), ("d", 30.0, 2.0)])])
    assert [(r.line_no, r.text) for r in layout.lines(d).orderBy("line_no").collect()] == [(1, "ab d"), (2, "c")]
    assert layout.lines(d.limit(0)).count() == 0


def test_boxes_and_margins(spark):
    d = chars(spark, [("f", 1, 100.0, i, "x", float(i), i + 1.0, t, t + 5, 1.0) for i, t in enumerate([2.0, 50.0, 96.0])])
    boxes = spark.createDataFrame([("f", 1, 1, 0.0, 40.0, 10.0, 60.0)], "file_id string, page_num int, table_idx int, x0 double, y0 double, x1 double, y1 double")
    assert [r.char_seq for r in layout.outside_boxes(d, boxes).orderBy("char_seq").collect()] == [0, 2]
    assert [(r.char_seq, r.table_idx) for r in layout.in_boxes(d, boxes).collect()] == [(1, 1)]
    assert [r.char_seq for r in layout.within_margins(d, 0.05, 0.05).collect()] == [1]


def test_repeated_edges_and_margins(spark):
    rows = [("f", p, n, t, y, y + 10.0) for p in range(1, 6) for n, (t, y) in enumerate([(f"Quarterly report page {p}" if p < 3 else f"different {p * 7919}{'z' * p}", 0.0), (f"body {p} {'q' * (p * 9)}", 50.0), ("the end of it", 90.0)], 1)]
    lines = spark.createDataFrame(rows, "file_id string, page_num int, line_no int, text string, top double, bottom double")
    pages = spark.createDataFrame([("f", 5)], "file_id string, n_pages int")
    edges = {r.edge: r for r in layout.repeated_edges(lines, pages).collect()}
    assert edges["bottom"].text == "the end of it" and edges["bottom"].share == 1.0
    heights = spark.createDataFrame([("f", p, 100.0) for p in range(1, 6)], "file_id string, page_num int, page_height double")
    m = layout.margins(layout.repeated_edges(lines, pages), heights).first()
    assert m.bottom == pytest.approx(0.2)


def test_repeated_edges_fold_as_one_by_one(spark):
    """The greedy groups of a fold over all pages' lines, from the definition."""
    from functools import lru_cache

    @lru_cache(None)
    def distance(a, b):
        return len(a) + len(b) if not a or not b else min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(2))
        want = 1 - distance(a, b) / max(len(a), len(b), 1) if a and b else float(a == b)
        assert layout.alike(a, b) == pytest.approx(want) and (layout.alike(a, b, 0.6) > 0.6) == (want > 0.6 + 1e-12)
    texts = ["".join(rng.choices("ab", k=2)) + "CDEFGHIJ" + str(rng.randrange(3)) for _ in range(30)] + ["", " x "]
    rows = [("f", p, 1, t, 0.0, 8.0) for p, t in enumerate(texts, 1)]
    lines = spark.createDataFrame(rows, "file_id string, page_num int, line_no int, text string, top double, bottom double")
    firsts, groups = [], {}
    for t in (t.strip() for t in texts if t.strip()):
        a = t.lower()
        head = next((f for f in firsts if a == f.lower() or 1 - distance(a, f.lower()) / max(len(a), len(f)) > layout.SIMILAR), None)
        if head is None:
            firsts.append(head := t)
        groups[head] = groups.get(head, 0) + 1
    got = layout.repeated_edges(lines, spark.createDataFrame([("f", 10)], "file_id string, n_pages int")).where("edge = 'top'").first()
    best = max(groups.values())
    assert got.pages == best and groups[got.text] == best and sorted(x.page_num for x in got["at"]) == sorted(set(x.page_num for x in got["at"]))


def test_marks():
    assert [tables.mark_of(x) for x in ("1) x", "TP 1", "가) x", "plain", "i) x", "- x", "-x", ">> x", "제1조", "(가) y", "", "(note) z", "TP 1 설명")] == ["number )", "capitals and number", "syllable )", None, "small letter )", "-", None, ">", "number after 제", "syllable ()", None, "()", "capitals and number first"]
    same = (("1)", "22) x"), ("(3) a", "(44)b"), ("ii) x", "xiv) y"), ("(ii) x", "(vi)"), ("10번 가", "2번"), ("ch3 x", "tp 12 y"), ("Ch 3", "tP4"), ("채널 1", "회선2"), ("[가]", "[나] x"), ("[ab] x", "[note]"), ("ㄱ. x", "ㄴ."), ("3 x", "12 y"), ("3: x", "4:"), ("①", "①x"))
    assert all(tables.mark_of(a) == tables.mark_of(b) != None for a, b in same)  # noqa: E711
    other = [tables.mark_of(x) for x in ("1)", "1.", "1-", "(1)", "[1]", "1 x", "1:", "1번", "제1조", "가)", "가.", "(가)", "[가]", "ㄱ)", "ㄱ.", "a)", "A)", "a.", "A.", "(a)", "(A)", "[a]", "[A]", "ii)", "II)", "ii.", "II.", "(ii)", "(II)", "{x}", "[xyz]", "(xyz)", "《x》", "①", "②", "TP1", "tp1", "Tp1", "채널1", "TP1 x", "tp1 x", "채널1 x")]
    assert None not in other and len(set(other)) == len(other)
    assert [tables.mark_of(x) for x in ("Tp1 x", "word", "()", "[]x", "ㄱ x", "word) x", "가나) x", "3개")] == [None] * 8
    assert [tables.is_number(x) for x in ("1,000원", "-", "≤5", "abc", "12 MHz")] == [True, False, True, False, True]


def test_table_text():
    assert tables.table_text([["번호", "값"], ["1", "2"]], 1, 3) == "[표 1 - 페이지 3 시작]<br>헤더: 번호 | 값<br>\n레코드 1:<br>  번호: 1<br>  값: 2<br>[표 1 - 페이지 3 끝]"
    assert tables.table_text([], 1, 1) == ""
    assert "  항목1:<br>    - a<br>    - b" in tables.table_text([["a\nb", None]], 1, 1)
    grid = [["점검", "하한치", "관련"], ["전원\n1) 입력\n2) 출력", "5\n6", "A-1"], ["단독", "7", ""]]
    assert tables.table_text(grid, 1, 1).split("<br>")[1:-1] == ["헤더: 점검\t하한치\t관련", "전원", "  관련: A-1", "  1) 입력", "    하한치: 5", "  2) 출력", "    하한치: 6", "", "단독", "  하한치: 7"]


def test_header_by_similarity():
    rows = [["alpha beta gamma delta epsilon", "zeta eta theta iota kappa"], ["1", "2"], ["3", "4"], ["5", "6"]]
    assert tables.first_is_header(rows) and not tables.first_is_header([["x" * 40, ""], ["y" * 40, ""], ["z" * 40, ""]])
    assert tables.row_similarity(["a", ""], ["b", ""]) == [1.0, 1.0, 1.0, 1.0, 1.0]


def test_tables_in_text(spark):
    text = "before\n온도 10\n압력 20\nafter"
    grid = [["온도", "10"], ["압력", "20"]]
    assert tables.replaced(text, [grid], 1).startswith("before\n[표 1 - 페이지 1 시작]") and tables.replaced("nothing", [grid], 1) == "nothing"
    d = spark.createDataFrame([("f", 1, 1, grid), ("f", 1, 2, None)], "file_id string, page_num int, table_idx int, grid array<array<string>>")
    assert [r.text[:4] for r in tables.with_table_text(d).orderBy("table_idx").collect()] == ["[표 1", ""]


MANUAL = ["제 1 장 차례\n제 1 장 총칙\n1.1 목적 글\n목적은\n이렇다.\n- 항목\n1.2 범위 글\n범위", "계속\n1.2.1 세부 글\n세부 내용\n9.1 다른 장 글\n버림\n제 3 장 운용\n3.1 개요 글\n개요\n3.1.1 깊은 글\n깊이\n첨부 1\n붙임"]


def test_sections():
    got = sections.split_sections(MANUAL, "책")
    assert [s["section_id"] for s in got] == ["제 1 장", "1.1", "1.2", "1.2.1", "제 3 장", "3.1"]
    assert got[1]["content"].endswith("목적은 이렇다.\n- 항목") and "📄 책\n▷ 제 1 장\n    ▶ 1.1 목적 글" in got[1]["content"]
    assert "계속" in got[2]["content"] and got[3]["title"] == "1.2 범위 글" and got[3]["start_page"] == 2
    assert "깊이" in got[-1]["content"]
    assert [s["section_id"] for s in sections.split_sections(MANUAL, compat=True)] == ["제 1 장", "1.2", "1.2.1", "제 3 장"]
    assert sections.split_sections([]) == [] and sections.split_sections(["plain"]) == []


def test_flowing_sections_and_joining(spark):
    assert [s["section_id"] for s in sections.split_outline("1.1 a b\n1.1.1 first x\nbody\n1.1.2 second y\nmore\n1.1.9 late z\nrest")] == ["1.1.1", "1.1.2"]
    assert sections.join_wrapped(["a", "b", "", "1. c", "d"]) == "a b\n\n1. c\nd"
    d = spark.createDataFrame([("m", i + 1, t) for i, t in enumerate(MANUAL)] + [("n", 1, None)], "file_id string, page_num int, text string")
    assert [r.section_id for r in sections.sections(d).orderBy("seq").collect()][:3] == ["제 1 장", "1.1", "1.2"]


def package(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return b.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="w"'
    docx = package({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>"})
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sld>'
    pptx = package({f"ppt/slides/slide{i}.xml": slide.format(t) for i, t in ((10, "last"), (2, "first"))})
    h = 'xmlns:hp="hp" xmlns:hs="hs" xmlns:hc="hc"'
    hwpx = package(
        {
            "Contents/section0.xml": f'<hs:sec {h}><hp:secDef/><hp:header><hp:p><hp:run><hp:t>no</hp:t></hp:run></hp:p></hp:header><hp:p><hp:run><hp:t>yes</hp:t></hp:run></hp:p><hp:p pageBreak="1"><hp:run><hp:pic><hc:img binaryItemIDRef="image1"/></hp:pic></hp:run></hp:p></hs:sec>',
            "BinData/image1.png": b"png",
        }
    )
    d = spark.createDataFrame([("a.docx", docx), ("b.pptx", pptx), ("c.hwpx", hwpx), ("d.docx", b"bad"), ("e.pdf", b"")], "file_id string, content binary")
    rows = office.paragraphs(d).collect()
    assert [(r.file_id, r.page_num, r.text) for r in rows if r.error is None][:4] == [("a.docx", None, "one two"), ("b.pptx", None, "first"), ("b.pptx", None, "last"), ("c.hwpx", 2, "yes")]
    assert [r.page_num for r in rows if r.text and r.text.startswith("<img")] == [3]
    assert {r.file_id for r in rows if r.error} == {"d.docx", "e.pdf"}
    assert [(r.file_id, bytes(r.data)) for r in office.images(d).collect()] == [("c.hwpx", b"png")]
    assert {(r.file_id, r.page_num): r.text for r in office.by_page(office.paragraphs(d)).collect()}[("b.pptx", 1)] == "first\nlast"


def test_pixels():
    assert not office.pixels_say_something(9, 20, 1, bytes(180)) and not office.pixels_say_something(20, 20, 3, b"\xff" * 1200)
    assert office.pixels_say_something(20, 20, 3, random.Random(1).randbytes(1200))


def test_chunk_store(spark, tmp_path):
    s = chunkstore.ChunkStore(spark, f"file://{tmp_path}/t")
    s.create()
    rows = spark.createDataFrame([("a", "x", [1.0], "n", "p,, q ", "S", "s", "f", 1, "t", "1", 1, 1, None), ("b", "x", None, "n", "p", "S", "s", "f", 1, "t", "1", 1, 1, None)], chunkstore.SCHEMA)
    s.append(rows)
    s.append(rows)
    assert [r.tags for r in s.read().collect()] == ["p, q", "p, q"] and s.info().first().points == 2
    s.replace(s.read().limit(1))
    assert s.read().count() == 1 and s.exists()
    v, one = s.version(), s.read()
    s.append(rows)
    with pytest.raises(chunkstore.Conflict):  # the append would be lost
        s.replace(one, v)
    assert s.read().count() == 2
    s.retag("f", "z", Principal())
    assert {r.tags for r in s.read().collect()} == {"z"}
    s.delete(Principal(), ids=spark.createDataFrame([("b",)], "doc_id string"))
    assert s.read().count() == 2
    s.delete(Principal(), file_id="f")
    assert s.read().count() == 0 and s.info().first().points == 0
    assert not s._commit(s.version(), [])  # a number is taken once
    s.create(recreate=True)
    assert s.read().count() == 0
    g = chunkstore.gpu_metrics(spark.createDataFrame([("0, X, 50, [N/A], 100, 200, 1.5, 2, 3",)], "value string")).first()
    assert (g.utilization, g.memory_percent, g.name) == (None, 50.0, "X")


@pytest.fixture
def task_dir(spark, tmp_path):
    rows = [("t1", "A", "s", "uploading", "2024-01-01 00:00:00"), ("t1", "A", "s", "completed", "2024-01-01 00:05:00"), ("t1", "A", "s", "queued", "2024-01-01 00:01:00"), ("t2", "A", "s", "uploading", "2024-01-02 00:00:00"), ("t2", "A", "s", "uploading", "2024-01-02 00:00:00"), ("t3", "A", None, "failed", "2024-01-02 00:00:00")]
    d = spark.createDataFrame(rows, "task_id string, sosok string, site string, status string, ts string").selectExpr("task_id", "sosok", "site", "status", "to_timestamp(ts) AS ts")
    d.repartition(3).write.parquet(f"{tmp_path}/tasks.parquet")
    return str(tmp_path)


def test_streams_leave_what_a_batch_gives(spark, task_dir):
    batch = {(r.task_id, r.status) for r in streaming.latest_status(spark.read.parquet(f"{task_dir}/tasks.parquet")).collect()}
    out = streaming.run_to_table(streaming.latest_status(streaming.parquet_stream(spark, task_dir, "tasks")), "update")
    last = out.groupBy("task_id").agg({"batch_id": "max"}).withColumnRenamed("max(batch_id)", "batch_id").join(out, ["task_id", "batch_id"])
    assert {(r.task_id, r.status) for r in last.collect()} == batch == {("t1", "completed"), ("t2", "uploading"), ("t3", "failed")}
    days = streaming.run_to_table(streaming.uploads_per_day(streaming.parquet_stream(spark, task_dir, "tasks"), "30 days"), "update")
    assert {str(r.day): r["max(uploads)"] for r in days.groupBy("day").agg({"uploads": "max"}).collect()} == {"2024-01-01": 1, "2024-01-02": 2}
    changes = streaming.run_to_table(streaming.status_changes(streaming.parquet_stream(spark, task_dir, "tasks"))).collect()
    assert {c.task_id for c in changes} == {"t1", "t2"} and ("t1", "completed") in {(c.task_id, c.status) for c in changes}


def events(spark, rows):
    return spark.createDataFrame(rows, "task_id string, sosok string, site string, status string, ts string").selectExpr("task_id", "sosok", "site", "status", "to_timestamp(ts) AS ts")


def written_in_turn(spark, path, *parts):
    """A table of one file a part, read in this order."""
    import os

    for i, rows in enumerate(parts):
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/tasks.parquet")
        for f in (path / "tasks.parquet").glob("part-*.parquet"):
            if not f.name.startswith("part-9"):
                os.utime(f.rename(f.with_name(f"part-9{i}.parquet")), (i + 1, i + 1))
    return streaming.parquet_stream(spark, str(path), "tasks")


def test_changes_over_several_files(spark, tmp_path):
    day = "2024-01-{:02} 00:00:00".format
    stream = written_in_turn(
        spark, tmp_path,
        [("t1", "A", "s", "uploading", day(1)), ("t1", "A", "s", "processing", day(3))],
        [("t1", "A", "s", "queued", day(2)), ("t1", "A", "s", "completed", day(4)), ("t2", "A", "s", "uploading", day(20))],  # queued comes after what followed it
        [("t2", "A", "s", "completed", day(21))],
        [("t1", "A", "s", "failed", day(3)), ("t2", "A", "s", "completed", day(22)), ("t3", "A", "s", "queued", day(1))],  # the first and the last are later than the watermark of the batch before
    )
    got = sorted((r.task_id, r.status, r.active) for r in streaming.run_to_table(streaming.status_changes(stream, "7 days")).collect())
    assert got == [("t1", "completed", False), ("t1", "processing", True), ("t1", "uploading", True), ("t2", "completed", False), ("t2", "uploading", True)]


def test_days_close_with_the_watermark(spark, tmp_path):
    day = "2024-01-{:02} 06:00:00".format
    up = [("t", "A", "s", "uploading")]
    stream = written_in_turn(spark, tmp_path, [(*x, day(1)) for x in up * 2] + [(*up[0], day(2))], [(*up[0], day(2)), (*up[0], day(9))], [(*up[0], day(9))], [(*up[0], day(8)), (*up[0], day(1)), (*up[0], day(20))])
    out = streaming.run_to_table(streaming.uploads_per_day(stream, "2 days"))  # append: a day comes once, when it is closed
    assert {str(r.day)[-2:]: r.uploads for r in out.collect()} == {"01": 2, "02": 2, "08": 1, "09": 2}  # what came for the first day after its end is left out


def test_changes_are_pushed_by_channel(spark, tmp_path):
    import json

    stream = written_in_turn(spark, tmp_path / "in", [("t1", "A", "s", "uploading", "2024-01-01 00:00:00"), ("t1", "A", "s", "completed", "2024-01-01 00:01:00"), ("t2", "B", "s", "failed", "2024-01-01 00:00:00")])
    out = str(tmp_path)

    def send(channel, frames):
        with open(f"{out}/{channel}", "a") as f:
            f.writelines(x + "\n" for x in frames)

    streaming.pushed(streaming.status_changes(stream), send, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [json.loads(x)["status"] for x in open(f"{out}/A_s")] == ["uploading", "completed"] and json.loads(open(f"{out}/B_s").read())["active"] is False


def test_replies_to_commands(spark):
    t = events(spark, [("t1", "A", "s", "completed", "2024-01-01 00:00:00"), ("t2", "A", "s", "queued", "2024-01-02 00:00:00"), ("t3", "A", "s", "failed", "2024-01-03 00:00:00"), ("t4", "B", "s", "failed", "2024-01-03 00:00:00")])
    kinds = [("ping", None), ("refresh", None), ("dismiss_task", "t2"), ("heartbeat", None), ("dismiss_all_completed", None), ("refresh", None), ("what", None)]
    c = spark.createDataFrame([("A_s", i, k, x) for i, (k, x) in enumerate(kinds)] + [("C_s", 0, "refresh", None)], "channel string, seq int, type string, task_id string")
    got = {(r.channel, r.seq): (r.reply, r.tasks and [x.task_id for x in r.tasks]) for r in streaming.channel_replies(t, c).collect()}
    assert got == {("A_s", 0): ("pong", None), ("A_s", 1): ("task_update", ["t3", "t2", "t1"]), ("A_s", 2): ("task_update", ["t3", "t1"]), ("A_s", 3): ("ping", None), ("A_s", 4): ("task_update", []), ("A_s", 5): ("task_update", []), ("C_s", 0): ("task_update", [])}


def test_headings_begin_their_lines():
    text = "1.1.1 First thing\nbody refers to 1.1.2 Second of them\n  1.1.2 Radio Aids\nmore\n1.1.3 Third\n"
    assert [s["section_id"] for s in sections.split_outline(text)] == ["1.1.1", "1.1.2", "1.1.3"]
    assert [s["section_id"] for s in sections.split_outline(text, not_headings=("Radio Aids",))] == ["1.1.1"]


def test_model_stream(spark):
    lines = ['data: {"choices":[{"delta":{"content":"he"}}]}', "data: broken", 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"f","arguments":"{\\"a\\""}}]}}]}', 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":": 1}"}}]}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}']
    p = streaming.sse_parts(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream_id string, seq int, line string"))
    assert [r.content for r in p.orderBy("seq").collect() if r.content] == ["he"]
    assert [(r.name, r.arguments) for r in streaming.tool_calls(p).collect()] == [("f", '{"a": 1}')]


def test_incremental_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.docx").write_bytes(b"bad")
    (tmp_path / "in" / "ok.docx").write_bytes(package({"word/document.xml": '<d xmlns="w"><p><t>hi</t></p></d>'}))
    s = streaming.landed_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/done").select("file_id", "content")
    good, reports = [], []
    q = streaming.incremental_ingest(s, office.paragraphs, lambda d: good.extend(d.collect()), lambda d: reports.extend(d.collect()))
    q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [r.text for r in good] == ["hi"] and {r.file_id: r.status for r in reports} == {"bad.docx": "failed", "ok.docx": "success"}
