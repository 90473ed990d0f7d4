"""Ingest from files to the chunk table, and pages from a plugged-in reader."""

import io
import zipfile

from docweave.plans import ingest
from docweave.session import ship
from docweave.sources import adapters
from docweave.sources.chunkstore import ChunkStore


def docx(*paragraphs):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<d xmlns='w'>" + "".join(f"<p><t>{p}</t></p>" for p in paragraphs) + "</d>")
    return b.getvalue()


def test_ingest(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/t")
    store.create()
    hexed = "0" * 32
    d = spark.createDataFrame([(f"{hexed}_a.docx", docx(*(f"word{i}" for i in range(701)))), (f"{hexed}_m.docx", docx("유지보수 교범", "제 1 장 차례", "제 1 장 총칙", "1.1 목적 글", "본문")), (f"{hexed}_bad.docx", b"x"), (f"{hexed}_empty.docx", docx())], "file_id string, content binary")
    out = {r.file_id[33:]: (r.status, r.sections) for r in ingest.ingest(d, store, "a,, b", "S", "s", "2024-05-01").collect()}
    assert out == {"a.docx": ("success", 2), "m.docx": ("success", 2), "bad.docx": ("failed", 0), "empty.docx": ("failed", 0)}
    rows = store.read().orderBy("original_filename", "section_number").collect()
    assert [(r.original_filename, r.section_id, r.tags, r.page_number) for r in rows] == [("a.docx", "1", "a, b", 1), ("a.docx", "2", "a, b", 1), ("m.docx", "제 1 장", "a, b", 1), ("m.docx", "1.1", "a, b", 1)]
    assert str(rows[0].upload_date) == "2024-05-01" and len(rows[0].embedding) == 64 and len({r.doc_id for r in rows}) == 4


def reader(file_id, data):
    if data == b"bad":
        raise ValueError("broken")
    for page in (1, 2, 3):
        for n, (line, top) in enumerate([("HEADER", 0.0), (f"text{page}", 40.0), ("in box", 60.0)]):
            for i, c in enumerate(line):
                yield "char", {"page_num": page, "page_height": 100.0, "char_seq": n * 100 + i, "text": c, "x0": i * 5.0, "x1": i * 5.0 + 5, "top": top, "bottom": top + 8, "width": 5.0}
        yield "table", {"page_num": page, "table_idx": 1, "x0": -1.0, "y0": 55.0, "x1": 99.0, "y1": 70.0, "grid": [["번호", "값"], ["1", str(page)]]}
    yield "image", {"page_num": 2, "idx": 1, "url": "u.png"}


def test_pages_from_characters(spark):
    d = spark.createDataFrame([("f.pdf", b"ok"), ("g.pdf", b"bad")], "file_id string, content binary")
    found = adapters.parsed(d, reader)
    kinds = {k: adapters.of_kind(found, k) for k in ("char", "table", "image", "error")}
    assert [r.error for r in kinds["error"].collect()] == ["ValueError: broken"]
    pages = {r.page_num: r.text for r in ingest.clean_pages(kinds["char"], kinds["table"], kinds["image"]).collect()}
    assert pages[1].startswith("text1\n[표 1 - 페이지 1 시작]") and "HEADER" not in pages[1] and "in box" not in pages[1]
    assert pages[2].endswith('<img src="u.png">')
    assert set(r.text for r in ingest.clean_pages(kinds["char"], top=0.99, detect=False).collect()) == {ingest.CROPPED}


ship(__name__)  # a reader travels to the workers with its module
