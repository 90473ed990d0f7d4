"""Pages from characters: lines, margins of repeated lines, tables in their places, images after the text.

``chars`` is (file_id, page_num, page_height, char_seq, text, x0, x1, top, bottom, width); ``boxes`` (file_id, page_num, x0, y0, x1, y1).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import ship

TOLERANCE, GAP, SIMILAR, PAGES, LARGEST = 3.0, 0.3, 0.85, 0.4, 0.3

PAGE = ["file_id", "page_num"]


def inside(c: str = "c", b: str = "b"):
    return F.expr(f"{c}.x0 BETWEEN {b}.x0 AND {b}.x1 AND {c}.top BETWEEN {b}.y0 AND {b}.y1")


def outside_boxes(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """Characters in no box of their page: an anti-join on the page with the ranges as its condition."""
    c, b = chars.alias("c"), boxes.alias("b")
    return c.join(b, (F.col("c.file_id") == F.col("b.file_id")) & (F.col("c.page_num") == F.col("b.page_num")) & inside(), "left_anti")


def in_boxes(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """Characters with the number of the box that holds them (boxes need table_idx)."""
    c, b = chars.alias("c"), boxes.alias("b")
    return c.join(b, (F.col("c.file_id") == F.col("b.file_id")) & (F.col("c.page_num") == F.col("b.page_num")) & inside()).select("c.*", "b.table_idx")


def within_margins(chars: DataFrame, top: float, bottom: float) -> DataFrame:
    """Characters wholly between the margins, given as shares of the page height."""
    return chars.where((F.col("top") >= F.col("page_height") * top) & (F.col("bottom") <= F.col("page_height") * (1 - bottom)))


def lines(chars: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(file_id, page_num, line_no, text, x0, x1, top, bottom).

    A line begins where a character's top is more than the tolerance away from that of the line's first one. That anchor makes it a fold, which no window
    function expresses: it runs over a stream of characters sorted by page and place. Within a line everything is window functions.
    """

    def anchored(batches):
        page, anchor, n = None, 0.0, 0
        for b in batches:
            numbers = []
            for f, p, top in zip(*(b.column(c).to_pylist() for c in (*PAGE, "top")), strict=True):
                if (f, p) != page:
                    page, anchor, n = (f, p), top, 1
                elif abs(top - anchor) > tolerance:
                    anchor, n = top, n + 1
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int32())], [*columns, "line_no"])

    columns = [*PAGE, "char_seq", "text", "x0", "x1", "top", "bottom", "width"]
    ordered = chars.select(*columns).repartition(*PAGE).sortWithinPartitions(*PAGE, "top", "x0", "char_seq")
    numbered = ordered.mapInArrow(anchored, ordered.select("*", F.lit(0).alias("line_no")).schema)
    w = Window.partitionBy(*PAGE, "line_no").orderBy("x0", "char_seq")
    spaced = numbered.withColumn("piece", F.when(F.col("x0") - F.lag("x1").over(w) > F.col("width") * GAP, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "char_seq", "piece"))), lambda c: c.piece), "")
    return spaced.groupBy(*PAGE, "line_no").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def edge_lines(page_lines: DataFrame, n: int = 3) -> DataFrame:
    """The first and last n lines with text of each page: (…, edge, place)."""
    t = page_lines.where(F.trim("text") != "")
    up, down = Window.partitionBy(*PAGE).orderBy("line_no"), Window.partitionBy(*PAGE).orderBy(F.desc("line_no"))
    t = t.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).where((F.col("a") <= n) | (F.col("b") <= n))
    ends = [F.when(F.col(c) <= n, F.struct(F.lit(edge).alias("edge"), F.col(c).alias("place"))) for edge, c in (("top", "a"), ("bottom", "b"))]
    return t.withColumn("_end", F.explode(F.filter(F.array(*ends), lambda x: x.isNotNull()))).select(*page_lines.columns, "_end.edge", "_end.place")


class Heads:
    """The first lines of the groups of one place. A line joins the first group whose first line is more than ``SIMILAR`` to it, else it begins a group.

    A line met before is only looked up. Others are compared at once with all first lines by their lengths and by the counts of their characters (in ``WIDTH`` classes),
    which bound the edit distance from below; the few that are left are compared in full.
    """

    WIDTH = 32

    def __init__(self):
        self.known, self.plain, self.names = {}, [], []
        self.counts = self.lengths = None

    def of(self, text: str) -> str:
        head = self.known.get(text)
        if head is None:
            head = self.known[text] = self._placed(text)
        return head

    def _placed(self, text: str) -> str:
        import numpy as np

        plain = text.strip().lower()
        own = np.bincount(np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32) % self.WIDTH, minlength=self.WIDTH)
        k = len(self.names)
        if k:
            most = (1 - SIMILAR) * np.maximum(self.lengths[:k], len(plain))
            more = own - self.counts[:k]
            least = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
            for i in np.flatnonzero(least <= most):
                if alike(plain, self.plain[i], SIMILAR) > SIMILAR:
                    return self.names[i]
        if self.counts is None or k == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)]) if k else np.zeros((8, self.WIDTH), np.int64)
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)]) if k else np.zeros(8, np.int64)
        self.counts[k], self.lengths[k] = own, len(plain)
        self.plain.append(plain)
        self.names.append(text)
        return text


def alike(a: str, b: str, least: float = 0.0) -> float:
    """1 - Levenshtein distance / longer length; any value up to ``least`` may come out as 0 without being counted out: only a band around the diagonal is worked out."""
    if a == b or not a or not b:
        return float(a == b)
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        last, row[lo - 1] = row[lo - 1], (i if lo == 1 else far)
        for j in range(lo, hi + 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != b[j - 1]))
        if hi < len(b):
            row[hi + 1] = far
        if min(row[lo - 1 : hi + 1]) > most:
            return 0.0
    return 1 - row[-1] / n if row[-1] <= most else 0.0


def repeated_edges(page_lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Of each file and edge the line that repeats best: (file_id, edge, place, text, pages, share, score) and the pages' (page_num, y0, y1) as ``at``.

    Lines of one place are grouped greedily by similarity to a group's first, a fold over a stream sorted by place and page (see ``Heads``); groups on 40 % of the pages score
    by share and steadiness of position. ``pages`` is (file_id, n_pages).
    """

    def grouped(batches):
        group, heads = None, Heads()
        for b in batches:
            out = []
            for *key, text in zip(*(b.column(c).to_pylist() for c in ("file_id", "edge", "place", "text")), strict=True):
                if key != group:
                    group, heads = key, Heads()
                out.append(heads.of(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "head"])

    e = edge_lines(page_lines).select(*PAGE, "edge", "place", F.trim("text").alias("text"), "top", "bottom")
    e = e.repartition("file_id", "edge", "place").sortWithinPartitions("file_id", "edge", "place", "page_num", "text")
    g = e.mapInArrow(grouped, e.select("*", F.lit("").alias("head")).schema).groupBy("file_id", "edge", "place", F.col("head").alias("text"))
    g = g.agg(F.count("*").alias("pages"), F.stddev_pop((F.col("top") + F.col("bottom")) / 2).alias("sd"), F.collect_list(F.struct("page_num", F.col("top").alias("y0"), F.col("bottom").alias("y1"))).alias("at"))
    g = g.join(pages, "file_id").withColumn("share", F.col("pages") / F.col("n_pages")).where(F.col("share") >= PAGES).withColumn("score", F.col("share") / (1 + F.col("sd")))
    best = Window.partitionBy("file_id", "edge").orderBy(F.desc("score"), "place", "text")
    return g.withColumn("r", F.row_number().over(best)).where("r = 1").select("file_id", "edge", "place", "text", "pages", "share", "score", "at")


def margins(edges: DataFrame, heights: DataFrame) -> DataFrame:
    """(file_id, top, bottom): the mean share of the height to cut at either edge, at most 0.3 a page, 0 where nothing repeats. ``heights`` is (file_id, page_num, page_height)."""
    at = edges.select("file_id", "edge", F.explode("at").alias("p")).select("file_id", "edge", "p.*").join(heights, PAGE)
    room = F.greatest(F.col("page_height") * 0.01, F.lit(10.0))
    cut = F.when(F.col("edge") == "top", F.col("y1") + room).otherwise(F.col("page_height") - F.col("y0") + room) / F.col("page_height")
    m = at.withColumn("cut", F.least(F.lit(LARGEST), cut)).groupBy("file_id").agg(F.avg(F.when(F.col("edge") == "top", F.col("cut"))).alias("top"), F.avg(F.when(F.col("edge") == "bottom", F.col("cut"))).alias("bottom"))
    return heights.select("file_id").distinct().join(m, "file_id", "left").fillna(0.0, ["top", "bottom"])


def block_gaps(page_lines: DataFrame, block: float = 15.0, apart: float = 30.0) -> DataFrame:
    """Blocks of lines (a gap of 15 points breaks one), and whether 30 points part a block from the one above."""
    w = Window.partitionBy(*PAGE).orderBy("top", "line_no")
    t = page_lines.withColumn("gap", F.col("top") - F.lag("bottom").over(w)).withColumn("block_no", F.sum(F.when(F.col("gap") >= block, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", "line_no", "text"))), lambda x: x.text), "\n")
    return t.groupBy(*PAGE, "block_no").agg(text.alias("text"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.coalesce(F.max_by("gap", -F.col("top")) > apart, F.lit(False)).alias("apart"))


def page_texts(page_lines: DataFrame, table_texts: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(file_id, page_num, text): lines and rendered tables (file_id, page_num, top, text) by their tops, images (file_id, page_num, idx, url) after them."""
    blocks = page_lines.select(*PAGE, "top", F.lit(0).alias("kind"), F.col("line_no").alias("seq"), "text")
    if table_texts is not None:
        blocks = blocks.union(table_texts.select(*PAGE, "top", F.lit(1), F.lit(0), "text"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", "kind", "seq", "text"))), lambda b: b.text), "\n")
    out = blocks.groupBy(*PAGE).agg(body.alias("text"))
    return with_images(out, images) if images is not None else out


def with_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Page texts with their images' tags after them, in order."""
    tags = images.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "url"))), lambda i: F.concat(F.lit('<img src="'), i.url, F.lit('">'))), "\n").alias("tags"))
    return pages.join(tags, PAGE, "left").withColumn("text", F.concat_ws("\n", "text", "tags")).drop("tags")


ship(__name__)
