"""Office files as rows: paragraphs, page numbers and images of DOCX, PPTX and HWPX packages, read on the executors from binary rows.

Input is (path or file_id, content BINARY), as Spark's binaryFile source gives it; the standard library's zip and XML readers do the rest.
A file that can't be read gives one row with its error and no paragraph.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import ship

IMAGES = (".jpg", ".jpeg", ".bmp", ".png", ".gif", ".wmf", ".emf")
ASIDE = ("header", "footer", "ctrl")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _numbered(names: list[str], pattern: str) -> list[str]:
    """The names that match, by the number in them."""
    found = [m for n in names if (m := re.fullmatch(pattern, n))]
    return [m[0] for m in sorted(found, key=lambda m: int(m[1]))]


def docx_paragraphs(data: bytes) -> Iterator[tuple[int | None, str]]:
    """Paragraphs of the body with text, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for p in (x for x in root.iter() if local(x.tag) == "p"):
        text = "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(local(x.tag), "") for x in p.iter())
        if text.strip():
            yield None, text.strip()


def pptx_paragraphs(data: bytes) -> Iterator[tuple[int | None, str]]:
    """The lines of each shape's text, slide by slide."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"):
            for shape in (x for x in ElementTree.fromstring(z.read(name)).iter() if local(x.tag) == "txBody"):
                text = "\n".join("".join({"t": x.text or "", "br": "\n"}.get(local(x.tag), "") for x in p.iter()) for p in shape if local(p.tag) == "p")
                for line in text.strip().splitlines():
                    yield None, line


def image_id(file_id: str, page: int | None, index: int) -> str:
    """Eight hex digits that depend on nothing but the image's place."""
    return hashlib.md5(f"{file_id}_{page}_{index}".encode()).hexdigest()[:8]


def hwpx_images(data: bytes, file_id: str) -> dict[str, tuple[str, bytes]]:
    """Of each picture its stem: (file name, bytes)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if n.startswith("BinData/") and posixpath.splitext(n)[1].lower() in IMAGES)
        return {posixpath.splitext(posixpath.basename(n))[0]: (image_id(file_id, None, i) + posixpath.splitext(n)[1].lower(), z.read(n)) for i, n in enumerate(names)}


def hwpx_paragraphs(data: bytes, images: dict[str, str]) -> Iterator[tuple[int | None, str]]:
    """Paragraphs outside headers, footers and controls, with running page numbers: a section definition and a page break begin a page. A run with a picture is its image tag."""
    page = 1
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)):
            root = ElementTree.fromstring(z.read(name))
            page += sum(local(x.tag) == "secDef" for x in root.iter())

            def walk(node):
                for child in node:
                    if local(child.tag) not in ASIDE:
                        if local(child.tag) == "p":
                            yield child
                        yield from walk(child)

            for p in walk(root):
                page += p.get("pageBreak") == "1"
                parts = []
                for run in (x for x in p if local(x.tag) == "run"):
                    refs = [x.get("binaryItemIDRef") for x in run.iter() if local(x.tag) == "img"] if any(local(x.tag) == "pic" for x in run) else None
                    if refs is not None:
                        parts += [f'<img src="{images[r]}" style="max-width:100%;">' for r in refs if r in images]
                    else:
                        parts += [x.text or "" for x in run if local(x.tag) == "t"]
                if text := "".join(parts).strip():
                    yield page, text


def parsed_rows(file_id: str, data: bytes | None) -> Iterator[tuple[str, int, int | None, str | None, str | None]]:
    """(file_id, seq, page_num, text, error)."""
    kind, n = file_id.rpartition(".")[2].lower(), 0
    try:
        if kind not in ("docx", "pptx", "hwpx"):
            raise ValueError(f"no reader for .{kind}")
        rows = {"docx": docx_paragraphs, "pptx": pptx_paragraphs}[kind](data) if kind != "hwpx" else hwpx_paragraphs(data, {k: v[0] for k, v in hwpx_images(data, file_id).items()})
        for page, text in rows:
            n += 1
            yield file_id, n, page, text, None
    except Exception as e:  # noqa: BLE001
        yield file_id, n + 1, None, None, f"{type(e).__name__}: {e}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, length, modificationTime, content) of the files under a folder; unread columns cost nothing."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select(F.substring_index("path", "/", -1).alias("file_id"), "length", "modificationTime", "content")


def paragraphs(stored: DataFrame) -> DataFrame:
    """(file_id, seq, page_num, text, error) of (file_id, content)."""

    def each(batches):
        for b in batches:
            rows = [r for f, d in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist(), strict=True) for r in parsed_rows(f, d)]
            names = ["file_id", "seq", "page_num", "text", "error"]
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return stored.select("file_id", "content").mapInArrow(each, "file_id string, seq int, page_num int, text string, error string")


def images(stored: DataFrame) -> DataFrame:
    """(file_id, idx, name, data) of the pictures in HWPX packages."""

    def each(batches):
        for b in batches:
            rows = []
            for f, d in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows += [(f, i, *v) for i, v in enumerate(hwpx_images(d, f).values())]
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary())], ["file_id", "idx", "name", "data"])

    return stored.where(F.lower("file_id").endswith(".hwpx")).select("file_id", "content").mapInArrow(each, "file_id string, idx int, name string, data binary")


def by_page(rows: DataFrame) -> DataFrame:
    """(file_id, page_num, text): paragraphs of a page joined by line ends; files without pages are one."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda r: r.text), "\n")
    return rows.where("text IS NOT NULL").groupBy("file_id", F.coalesce("page_num", F.lit(1)).alias("page_num")).agg(text.alias("text"))


def pixels_say_something(width: int, height: int, channels: int, data: bytes) -> bool:
    """Whether raw 8-bit pixels (1 or 3 channels) are an image worth keeping: at least 10 x 10, more than one colour, not nearly all white (or black).

    RGB is judged by up to 100 pixels at fixed steps, so the answer repeats.
    """
    import numpy as np

    if width < 10 or height < 10:
        return False
    p = np.frombuffer(data, np.uint8).reshape(-1, channels)
    if channels == 1:
        return len(np.unique(p)) > 1 and (p == 255).mean() <= 0.99 and (p == 0).mean() <= 0.99
    if (p == p[0]).all():
        return False
    sample = p[:: max(1, len(p) // min(100, max(1, len(p) // 10)))]
    return len(np.unique(sample, axis=0)) > 2 and (sample > 250).all(1).mean() <= 0.95


def worth_keeping(images: DataFrame) -> DataFrame:
    """The rows (…, width, height, channels, data) whose raw pixels say something, in Arrow batches; rows without pixels go."""

    def each(batches):
        for b in batches:
            pixels = zip(*(b.column(c).to_pylist() for c in ("width", "height", "channels", "data")), strict=True)
            yield b.filter(pa.array([None not in p and pixels_say_something(*p) for p in pixels], pa.bool_()))

    return images.mapInArrow(each, images.schema)


ship(__name__)
