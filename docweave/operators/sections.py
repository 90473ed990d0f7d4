"""Manuals cut at their headings: chapters, appendices and dotted numbers, with the tree above each section in its text."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.session import ship

# Forms of headings and of lines that stay by themselves.
HEADING = re.compile(r"^[ \t]*(?P<head>제\s*\d{1,3}\s*장|첨부\s*\d{1,3}|\d{1,2}(?:\.\d{1,2}){1,3}\.?\s+(?P<name>[^\s\d].+))", re.M)
ITEM = re.compile(r"\s*(?:[-*•⦁●∙·‣▪►☐・]|[0-9]+\.|\([0-9]+\)|\[[^\]]+\])\s*")
TABLE_MARK = re.compile(r"\[표\s+\d+\s+-\s+페이지\s+\d+\s+(시작|끝)\]$")
TABLE = re.compile(r"\[표\s+\d+\s+-\s+페이지\s+\d+\s+시작\].*?\[표\s+\d+\s+-\s+페이지\s+\d+\s+끝\]", re.S)
RULE = "─" * 50


def join_wrapped(lines: list[str]) -> str:
    """Wrapped lines joined to paragraphs; items, empty lines and tables part them."""
    out: list[str] = []
    open_paragraph, table = False, False
    for raw in lines:
        line = raw.strip()
        if m := TABLE_MARK.match(line):
            table = m.group(1) == "시작"
            out.append(raw)
            open_paragraph = False
        elif table:
            out.append(raw)
        elif not line or ITEM.match(line):
            out.append(line)
            open_paragraph = False
        elif open_paragraph:
            out[-1] += " " + line
        else:
            out.append(line)
            open_paragraph = True
    return "\n".join(out)


class Heading:
    """A found heading: its place, its text, what kind it is and its number."""

    def __init__(self, page: int, start: int, found: str):
        self.page, self.start, self.end = page, start, start + len(found)
        self.title = re.sub(r"\s+", " ", found.strip())
        kind = re.match(r"(제|첨부)\s*(\d{1,3})", self.title)
        self.kind = {"제": "chapter", "첨부": "appendix"}[kind[1]] if kind else "number"
        if kind:
            self.id, self.number = (f"제 {int(kind[2])} 장" if kind[1] == "제" else f"첨부 {int(kind[2])}"), [int(kind[2])]
        else:
            self.id = re.match(r"\d{1,2}(?:\.\d{1,2}){0,3}", self.title)[0]
            self.number = [int(x) for x in self.id.split(".")]
        self.depth = 0 if kind else len(self.number)


def heads_of(text: str, not_headings: tuple[str, ...] = ()):
    """The headings of a text as matches: each begins its line. A numbered one whose name begins with one of ``not_headings`` (a title that is set in every page's head, say) is none."""
    return (m for m in HEADING.finditer(text) if not (m["name"] and m["name"].startswith(not_headings)))


def headings(pages: list[str], not_headings: tuple[str, ...] = ()) -> list[Heading]:
    """All headings outside tables, in order. The very first chapter heading, if it is the first chapter's, belongs to the contents page."""
    out, chapters = [], 0
    for n, page in enumerate(pages):
        for m in heads_of(TABLE.sub("", page), not_headings):
            head = m["head"]
            if re.match(r"제\s*\d{1,3}\s*장", head):
                chapters += 1
                if chapters == 1 and re.match(r"제\s*1\s*장", head):
                    continue
            if (at := page.find(m[0])) >= 0:
                out.append(Heading(n, at + m.start("head") - m.start(), head))
    return sorted(out, key=lambda h: (h.page, h.start))


def body(pages: list[str], h: Heading, following: Heading | None) -> str:
    last, end = (following.page, following.start) if following else (len(pages) - 1, None)
    parts = [pages[i][h.end if i == h.page else 0 : end if i == last else None] for i in range(h.page, last + 1)]
    return join_wrapped([line for p in parts for line in p.splitlines()])


def follows(before: list[int] | None, number: list[int]) -> bool:
    """Whether a number is the next in order: the next sibling, the first child, or the next of a level above with first children only."""
    if not before:
        return True
    if len(number) == len(before) + 1:
        return number == [*before, 1]
    same = next((i for i, (a, b) in enumerate(zip(before, number, strict=False)) if a != b), None)
    return same is not None and number[same] == before[same] + 1 and all(x == 1 for x in number[same + 1 :]) and (len(number) != len(before) or same == len(number) - 1)


def late(number: list[int], taken: set[tuple[int, ...]]) -> bool:
    """Whether a number should have come before some taken one: its child, or a later sibling."""
    n = tuple(number)
    return any((len(t) > len(n) and t[: len(n)] == n) or (len(t) == len(n) and t[:-1] == n[:-1] and t[-1] > n[-1]) for t in taken)


def split_sections(pages: list[str], title: str | None = None, compat: bool = False, not_headings: tuple[str, ...] = ()) -> list[dict]:
    """The sections of one document's pages.

    Collection begins with the first chapter. Within a chapter its numbers are taken; late ones, and numbers of chapter 3 with more than two levels, go
    to the section before, each text once. Numbers of other chapters are left out, appendices count from chapter 6 on. By default the first
    number after a chapter heading is a section of its own; ``compat=True`` joins it to the chapter (or drops it, where its number comes again).
    """
    found = headings(pages, not_headings)
    counts = Counter(h.id for h in found)
    out: list[dict] = []
    merged: set[str] = set()
    tree: dict[int, tuple[str, str]] = {}
    chapter, first, taken, before = None, False, set(), None

    def merge(text: str) -> None:
        key = hashlib.sha256(text.strip().encode()).hexdigest()
        if out and key not in merged:
            merged.add(key)
            out[-1]["content"] += "\n\n" + text

    for h, following in zip(found, [*found[1:], None], strict=False):
        text = body(pages, h, following)
        if h.kind == "chapter":
            if chapter is None and h.number != [1]:
                continue
            chapter, first, taken, before = h.number[0], True, set(), None
        elif chapter is None or (h.kind == "appendix" and chapter < 6):
            continue
        elif h.kind == "number":
            if h.number[0] != chapter:
                if first:
                    continue
                if not follows(before, h.number):
                    if counts[h.id] == 1:
                        merge(f"{h.title}\n{text}")
                    continue
            elif late(h.number, taken) or tuple(h.number) in taken:
                merge(f"{h.title}\n{text}")
                continue
            if h.number[0] == 3 and len(h.number) > 2:
                merge(text)
                continue
            taken.add(tuple(h.number))
            was_first, first, before = first, False, h.number
            if compat and was_first:
                if counts[h.id] == 1:
                    merge(f"{h.title}\n{text}")
                continue
        tree = {d: t for d, t in tree.items() if d < h.depth} | {h.depth: (h.id, h.title)}
        if not text.strip() and h.kind == "number" and len(h.number) >= 3:
            continue
        path = [f"📄 {title}"] if title else []
        path += [f"{'  ' * d}{'▶' if d == h.depth else '▷'} {t}" for d, (_, t) in sorted(tree.items())]
        out.append(
            {
                "title": tree[h.depth - 1][1] if h.depth > 1 and h.depth - 1 in tree else h.title,
                "section_id": h.id,
                "content": "\n".join(path) + f"\n{RULE}\n\n{h.title}\n{text.strip()}".rstrip(),
                "start_page": h.page + 1,
            }
        )
    return out


def split_outline(text: str, not_headings: tuple[str, ...] = ()) -> list[dict]:
    """Sections of flowing text (word-processor and slide files): collection begins at 1.1.1; a heading out of order joins the section before, each text once."""
    heads = [Heading(0, m.start("head"), m["head"]) for m in heads_of(text, not_headings)]
    out: list[dict] = []
    seen: set[str] = set()
    before = None
    for h, following in zip(heads, [*heads[1:], None], strict=False):
        if h.kind != "number" or (before is None and h.number != [1, 1, 1]):
            continue
        content = body([text], h, following)
        key = hashlib.sha256(content.strip().encode()).hexdigest()
        if before is None or follows(before, h.number):
            out.append({"title": h.title, "section_id": h.id, "content": content.strip(), "start_page": 1})
            before = h.number
        elif out and key not in seen:
            out[-1]["content"] += f"\n\n{h.title}\n{content}"
        seen.add(key)
    return out


def sections(pages: DataFrame, compat: bool = False, flowing: bool = False, not_headings: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, seq, title, section_id, content, start_page) of pages (file_id, page_num, text): state runs over a document's headings, so pages stream by document, one document in memory at a time."""

    def rows(file_id: str, texts: list[str]):
        found = split_outline("\n".join(texts), not_headings) if flowing else split_sections(texts, compat=compat, not_headings=not_headings)
        return [(file_id, i, s["title"], s["section_id"], s["content"], s["start_page"]) for i, s in enumerate(found, 1)]

    def each(batches):
        file_id, texts = None, []

        def batch_of(out):
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["file_id", "seq", "title", "section_id", "content", "start_page"])

        for b in batches:
            out = []
            for f, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if f != file_id:
                    out += rows(file_id, texts) if texts else []
                    file_id, texts = f, []
                texts.append(t or "")
            yield batch_of(out)
        if texts:
            yield batch_of(rows(file_id, texts))

    p = pages.where("file_id IS NOT NULL").select("file_id", "page_num", "text").repartition("file_id").sortWithinPartitions("file_id", "page_num")
    return p.mapInArrow(each, "file_id string, seq int, title string, section_id string, content string, start_page int")


ship(__name__)
