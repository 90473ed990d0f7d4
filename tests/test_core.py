"""Access, catalogue, search, statistics and text functions on small inputs with results worked out by hand."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import maps, text
from docweave.operators import catalog, chunk, search, stats
from docweave.operators.access import ADMIN, Principal, can_see

COLUMNS = "doc_id string, file_id string, original_filename string, tags string, sosok string, site string, section_id string, section_title string, section_number int, page_number int, total_pdf_pages int, content string, embedding array<float>, upload_date date"


def row(doc_id, file_id="f", name="f.pdf", tags="a, b", sosok="A", site="s1", section="1", number=1, page=1, pages=3, content="x", vector=(1.0, 0.0), day=None):
    return (doc_id, file_id, name, tags, sosok, site, section, "t", number, page, pages, content, list(vector) if vector is not None else None, day)


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(
        [
            row("d1"),
            row("d2", section="1.10", number=2, vector=(0.6, 0.8)),
            row("d3", section="1.2", number=3, page=2, vector=(0.0, 0.0)),
            row("d3", section="1.2", number=3, page=2, vector=(0.0, 0.0)),
            row("d4", "g", "g.docx", "b", "A ", "s2", vector=None, pages=0),
            row("d5", "h", "h.hwpx", None, "B", "s1", vector=(math.nan, 1.0), page=None),
            row("d6", "h", "h.hwpx", None, "B", None, number=2, vector=()),
        ],
        COLUMNS,
    )


@pytest.mark.parametrize(("who", "n"), [(Principal(ADMIN, ADMIN), 3), (Principal("A", "A_전체"), 2), (Principal("A", "s1"), 1), (Principal("A"), 2), (Principal(), 3), (Principal(None, "s1"), 2)])
def test_access(spark, who, n):
    assert spark.createDataFrame([("A", "s1"), ("A ", "s2"), ("B", "s1")], "sosok string, site string").where(can_see(who)).count() == n


def test_admin_predicate_folds_away(chunks):
    assert "Filter" not in chunks.where(can_see(Principal(ADMIN, ADMIN)))._jdf.queryExecution().optimizedPlan().toString()


def test_catalogue(chunks):
    docs = {r.file_id: r for r in catalog.list_documents(chunks, Principal()).collect()}
    assert (docs["f"].sections, docs["f"].pages, docs["f"].total_pages, docs["f"].doc_id) == (3, [1, 2], 3, "d1")
    assert (docs["g"].total_pages, docs["h"].pages) == (0, [1])
    assert [r.tag for r in catalog.list_tags(chunks, Principal()).collect()] == ["a", "b"]
    assert {r.file_id: r.sections for r in catalog.files_with_tags(chunks, ["a", "b"], Principal()).collect()} == {"f": 3}
    assert catalog.files_with_tags(chunks, ["a", "c"], Principal()).count() == 0
    assert [r.section_id for r in catalog.page_content(chunks, "f", "1", Principal()).collect()] == ["1", "1.10"]
    assert catalog.where_equal(chunks, {"sosok": ["A", "B"], "file_id": "h"}).count() == 2
    assert catalog.split_request([" a , b,"]) == ["a", "b"]


def test_mutations(chunks):
    who = Principal("A", "A_전체")
    assert {r.tags for r in catalog.retagged(chunks, "g", "x,, y ", who).where("file_id = 'g'").collect()} == {"x, y"}
    with pytest.raises(PermissionError):
        catalog.retagged(chunks, "h", "x", who)
    with pytest.raises(LookupError):
        catalog.retagged(chunks, "none", "x", who)
    assert catalog.without_documents(chunks, Principal(), file_id="f").count() == 3
    assert catalog.without_documents(chunks, Principal("B"), filename="f.pdf").count() == 7
    with pytest.raises(ValueError):
        catalog.without_documents(chunks, who)
    assert catalog.without_ids(chunks, chunks.where("doc_id = 'd3'")).count() == 5


def test_duplicates_compare_composed(spark, chunks):
    import unicodedata

    name = "점검표.pdf"
    c = spark.createDataFrame([row("x", "k", unicodedata.normalize("NFD", name))], COLUMNS)
    r = spark.createDataFrame([(1, [name, name, "other"], "A", "s1"), (2, [name], "A", "s2"), (3, None, "A", "s1")], "request_id long, filenames array<string>, sosok string, site string")
    assert sorted((x.request_id, x.place, x.file_id) for x in catalog.stored_duplicates(c, r).collect()) == [(1, 1, "k"), (1, 2, "k")]


def test_search(spark, chunks):
    found = search.search(chunks, [1.0, 0.0], Principal()).collect()
    assert [(r.doc_id, r.score) for r in found] == [("d1", 1.0), ("d2", 0.6)]
    counts = search.search_counts(chunks, Principal("A")).first()
    assert (counts.total_matched, counts.with_vector) == (4, 3)
    p = search.prompt(search.search(chunks, [1.0, 0.0], Principal()), "q").first()
    assert p.context == "x\n\nx" and p.prompt.endswith("assistant\n")
    frames = [r.frame for r in search.answer(search.search(chunks, [1.0, 0.0], Principal("none")), "q", str.split).orderBy("seq").collect()]
    assert search.NOTHING in frames[0] and frames[-1] == "data: [DONE]\n\n"
    failed = search.answer(search.search(chunks, [1.0, 0.0], Principal()), "q", lambda p: 1 / 0).orderBy("seq").collect()
    assert "division" in failed[0].frame


def test_an_answer_is_sent_part_by_part(spark, chunks):
    def halting(p):
        yield "first"
        raise ValueError("stopped")

    frames = [r.frame for r in search.answer(search.search(chunks, [1.0, 0.0], Principal()), "q", halting).orderBy("seq").collect()]
    assert "first" in frames[0] and "stopped" in frames[1] and len(frames) == 3


def test_best_of_partitions_is_best_of_all(spark):
    rng = random.Random(3)
    rows = [(f"d{i % 60}", [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id string, embedding array<double>").repartition(7)
    whole = search.best_of(search.scored(d, [1.0, 0.5]), 9).collect()
    assert search.best_of(search.scored(d, [1.0, 0.5], top=9), 9).collect() == whole
    assert search.scored(d, [1.0, 0.5], top=9).count() <= 63
    none = d.union(spark.createDataFrame([(None, [1.0, 0.5]), (None, [2.0, 1.0]), ("d0", [2.0, 1.0])], "doc_id string, embedding array<double>"))
    assert search.best_of(search.scored(none, [1.0, 0.5], top=1), 1).first().doc_id == "d0"


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from docweave import session

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster())


def test_days_and_storage(spark, chunks):
    f = spark.createDataFrame([("uploads/f", dt.datetime(2024, 5, 6)), ("uploads/g", None)], "path string, modificationtime timestamp")
    c = chunks.withColumn("doc_id", F.when(F.col("file_id") == "h", F.concat(F.lit("20240102_"), "doc_id")).otherwise(F.col("doc_id")))
    assert {r.file_id: r.day for r in stats.upload_days(c, f, Principal(), "20250101").collect()} == {"f": "20240506", "g": "20250101", "h": "20240102"}
    assert stats.storage_for(spark.createDataFrame([("u/a.pdf", 10)], "path string, length long"), Principal("A")).collect()[0].access_level == "restricted"


def test_maps(spark):
    d = spark.sql("SELECT * FROM VALUES (1, map('a', '1', 'b', '2'), map('b', '3')), (2, NULL, map('x', '1')), (3, map('a', '1'), NULL) AS t(i, a, b)")
    assert {r.i: r.m for r in d.select("i", maps.merged(F.col("a"), F.col("b")).alias("m")).collect()} == {1: {"a": "1", "b": "3"}, 2: {"x": "1"}, 3: {"a": "1"}}
    c = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "y"), ("h", None)], "k string, v string")
    assert {r.k: r.counts for r in maps.counted(c, ["k"], "v").collect()} == {"g": {"x": 2, "y": 1}}
    assert maps.counted(c.limit(0), ["k"], "v").count() == 0


def test_windows_of_given_tokens(spark):
    d = spark.createDataFrame([("f", 1, "가나다라"), ("f", 2, None), ("f", 3, "마바")], "file_id string, page_num int, text string")
    got = chunk.token_windows(d, 4, 1, tokenizer=list, joiner="").orderBy("seq").collect()
    assert [(r.content, r.start_page) for r in got] == [("가나다라", 1), ("라마바", 1)]


def test_both_cosines_agree(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)] + [(50, None), (51, []), (52, [0.0] * 8), (53, [1.0]), (54, [math.inf] + [0.0] * 7)], "i int, embedding array<float>")
    q = [rng.gauss(0, 1) for _ in range(8)]
    a = {r.i: r.s for r in d.select("i", search.cosine(F.col("embedding"), q).alias("s")).collect()}
    b = {r.i: r.score for r in search.scored(d, q).collect()}
    assert sorted(b) == list(range(50)) and all(abs(a[i] - b[i]) < 1e-12 for i in b)
    assert (a[50], a[51], a[52], a[53], a[54]) == (None, 0.0, None, None, None)


def test_uploads_by_date(spark):
    days = [row(f"d{i}", f"f{i}", day=dt.date(2024, 1, i)) for i in (28, 29, 30, 31)]
    got = stats.uploads_by_date(spark.createDataFrame(days, COLUMNS), Principal(), "2024-01-31", 3).orderBy("day").collect()
    assert [(r.day, r.uploads) for r in got] == [("2024-01-28", 0), ("2024-01-29", 1), ("2024-01-30", 1)]


def test_statistics(spark, chunks):
    t = stats.totals(chunks, Principal()).first()
    assert (t.total_sections, t.total_documents, t.average_sections) == (6, 3, 2.0)
    assert {(r.facet, r.value): r.documents for r in stats.facets(chunks, Principal()).collect() if r.facet == "sosok"} == {("sosok", "A"): 1, ("sosok", "A "): 1, ("sosok", "B"): 1}
    assert [(r.tag, r.uses) for r in stats.popular_tags(chunks, Principal()).collect()] == [("b", 4), ("a", 3)]
    assert [(r.tag, r.uses) for r in stats.popular_tags(chunks, Principal(), by="file").collect()] == [("b", 2), ("a", 1)]
    f = spark.createDataFrame([("u/a.pdf", 10), ("u/a.pdf", 10), ("u/b.PDF", None), ("u/c", 5)], "path string, length long")
    assert {r.extension: (r.files, r.bytes) for r in stats.storage(f).collect()} == {"pdf": (2, 10), "": (1, 5), None: (3, 15)}
    empty = stats.totals(chunks.limit(0), Principal()).first()
    assert (empty.total_sections, empty.average_sections) == (0, 0.0)


@pytest.mark.parametrize(("n", "starts"), [(0, []), (1, [0]), (600, [0]), (601, [0, 600]), (700, [0, 600]), (1201, [0, 600, 1200])])
def test_token_windows(spark, n, starts):
    words = [f"w{i}" for i in range(n)]
    d = spark.createDataFrame([("f", 1, " ".join(words[:650])), ("f", 2, "\n".join(words[650:]))], "file_id string, page_num int, text string")
    got = chunk.token_windows(d).orderBy("seq").collect()
    assert [r.start_token for r in got] == starts
    assert [r.start_page for r in got] == [1 if s < 650 else 2 for s in starts]
    assert all(r.content.split() == words[r.start_token : r.start_token + 700] for r in got)


def test_section_records(spark):
    d = spark.createDataFrame([("f", "f.pdf", 1, "t", None, " ", None, 1), ("f", "f.pdf", 2, "t", None, "body", None, 4)], "file_id string, original_filename string, seq int, title string, section_id string, content string, page_number int, start_page int")
    (r,) = chunk.section_records(d).collect()
    assert (r.section_number, r.section_id, r.page_number, r.content) == (2, "2", 4, "문서: f.pdf\n<h2>t</h2>\nbody") and len(r.embedding) == 64


def test_text_functions(spark):
    d = spark.createDataFrame([("a  b\t　c ", "kitten", "sitting", 93784, "1,000원"), (None, "", "x", 0, "-"), ("a\n b", "A ", "a", 60, "≤5"), ("", None, None, None, "abc")], "t string, a string, b string, s long, n string")
    r = d.select(text.clean_cell(F.col("t")).alias("c"), text.clean_cell(F.col("t"), True).alias("l"), text.similarity(F.col("a"), F.col("b")).alias("m"), text.uptime_text(F.col("s")).alias("u"), text.is_number(F.col("n")).alias("k")).collect()
    assert [x.c for x in r] == ["a b c", "", "a b", ""]
    assert r[2].l == "a\nb"
    assert [x.m for x in r] == [pytest.approx(4 / 7), 0.0, 1.0, None]
    assert [x.u for x in r] == ["1일 2시간 3분 4초", "0초", "1분", None]
    assert [x.k for x in r] == [True, False, True, False]
    m = spark.range(1).select(text.chat_messages(F.lit("<|im_start|>system\nbe\n<|im_end|>\n<|im_start|>user\nq1\nq2<|im_end|>\n<|im_start|>assistant\n")).alias("m")).first().m
    assert [tuple(x) for x in m] == [("system", "be"), ("user", "q1\nq2")]
    keys = spark.createDataFrame([("1.10",), ("1.2",), ("1",), ("1.2.1",), ("제 1 장",)], "s string").orderBy(text.section_key(F.col("s"))).collect()
    assert [x.s for x in keys] == ["1", "1.2", "1.2.1", "1.10", "제 1 장"]


def test_materialized_tables_can_be_cleared(spark):
    from pathlib import Path

    from docweave.session import clear_shared, materialize, scratch_dir

    assert materialize(spark.range(3)).count() == 3 and spark.sparkContext.applicationId in scratch_dir(spark)
    clear_shared(spark)
    assert not Path(scratch_dir(spark).removeprefix("file://")).exists() and materialize(spark.range(2)).count() == 2
