"""Lines repeated across the documents of one source: templates in token trees, merged across partitions, and removed.

Every line is put into one form and cut into tokens, in which each run of digits is a wildcard slot, so that page marks and time
stamps share a template. A partition parses its lines down a token tree of fixed depth (source, number of tokens, the first ``DEPTH`` tokens); the leaf there
holds the templates that end in it, each with the documents (files) it has been seen in. The trees are put out leaf by leaf, once a template and document, and merged:
leaves of one path and template become one, which counts its documents. Templates that cover at least ``least`` documents and ``share``
of their source's are the repeated ones. Each line was put out as its template, and the documents' lines lose the repeated ones.

Two lines of one template are the same line but for digits: the statement asks for that sameness, so the merge opens no further slots. Counting
is by (source, template, document), which has no hot key, then by (source, template) with a map-side sum; a large source's lines meet its repeated templates in ``SALT`` parts.

Defined results: rows without source have no repeated lines; NULL content stays NULL; blank lines are never repeated
lines; a repeated doc_id counts once; lines are numbered from 1, split at LF.
"""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.form import connect, pieces, run_forms
from docweave.session import materialize, ship, site_key, spread, table

DEPTH, SALT = 4, 16
SLOT = "\ufffd"
DIGITS = regex.compile(r"\p{Nd}+")

#: One form keeps no line ends, so they travel as a private-use character; where a text has that one itself, it becomes the other.
MARK, OTHER = "\ue000", "\ue001"


class TokenTree:
    """Templates under source, number of tokens and the first ``depth`` tokens, each with the documents it has been seen in. A template's id is a hash of its whole path, so
    trees of other partitions know it by the same; a tree of more than ``most`` templates is put out and begun anew."""

    def __init__(self, depth: int = DEPTH, most: int = 50_000):
        self.depth, self.most, self.size, self.root = depth, most, 0, {}

    def add(self, source: int, line: str, document: int) -> int:
        """The id of the line's template, which now covers the document."""
        tokens = DIGITS.sub(SLOT, line).split(" ")
        node = self.root.setdefault((source, len(tokens)), {})
        for t in tokens[: self.depth]:
            node = node.setdefault(t, {})
        rest = " ".join(tokens[self.depth :])
        leaf = node.get(rest)
        if leaf is None:
            path = f"{source} {' '.join(tokens)}"
            leaf = node[rest] = (int.from_bytes(blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) or 1, set())
            self.size += 1
        leaf[1].add(document)
        return leaf[0]

    def full(self) -> bool:
        return self.size > self.most

    def put_out(self) -> list[tuple[int, int, int]]:
        """(source, template, document) of every leaf; the tree is empty then."""
        out = []
        for (source, n), node in self.root.items():
            level = [node]
            for _ in range(min(self.depth, n)):
                level = [child for x in level for child in x.values()]
            out += [(source, template, d) for x in level for template, documents in x.values() for d in documents]
        self.root, self.size = {}, 0
        return out


def parsed(chunks: DataFrame, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """Two kinds of rows: (doc, source, file_id, templates) with the template of each line of a document, 0 where it is blank; and
    (source, file_id, template), the leaves of the partition's trees. Rows need source BIGINT and file_id."""
    schema = f"{doc} string, source bigint, file_id bigint, templates array<bigint>, template bigint"
    names = [doc, "source", "file_id", "templates", "template"]

    def each(batches):
        con, tree = connect(), TokenTree()

        def leaves():
            out = tree.put_out()
            for i in range(0, len(out), 100_000):
                source, template, document = (pa.array(x, pa.int64()) for x in zip(*out[i : i + 100_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(source), pa.string()), source, document, pa.nulls(len(source), pa.list_(pa.int64())), template], names)

        for batch in batches:
            for part in pieces(batch):
                r = run_forms(con, part, text, f"replace(replace({text}, '{MARK}', '{OTHER}'), chr(10), '{MARK}')", f"{doc}, source, file_id, lower(form) AS form")
                out = []
                for source, file_id, form in zip(*(r.column(c).to_pylist() for c in ("source", "file_id", "form")), strict=True):
                    out.append([tree.add(source, s, file_id) if (s := line.strip(" ")) else 0 for line in (form or "").split(MARK)])
                yield pa.RecordBatch.from_arrays([*(r.column(c).combine_chunks() for c in (doc, "source", "file_id")), pa.array(out, pa.list_(pa.int64())), pa.nulls(len(out), pa.int64())], names)
                if tree.full():
                    yield from leaves()
        yield from leaves()

    return spread(chunks.select(doc, "source", "file_id", text)).mapInArrow(each, schema)


def repeated_templates(parsed_rows: DataFrame, least: int = 3, share: float = 0.1) -> DataFrame:
    """(source, template) of the templates that, all trees merged, cover at least ``least`` and ``share`` of the source's documents."""
    all_files = parsed_rows.where("templates IS NOT NULL").select("source", "file_id").distinct().groupBy("source").agg(F.count("*").alias("files"))
    merged = parsed_rows.where("template IS NOT NULL").select("source", "template", "file_id").distinct().groupBy("source", "template")
    cover = merged.agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return cover.join(all_files, "source").where(F.col("n") >= share * F.col("files")).select("source", "template")


def source_ids(chunks: DataFrame) -> DataFrame:
    """Rows of a site, with 64-bit ids of the site and the file; such short keys keep the shuffles small."""
    s = chunks.withColumn("s", site_key(F.col("sosok"), F.col("site"))).where("s IS NOT NULL AND doc_id IS NOT NULL AND file_id IS NOT NULL")
    return s.select("doc_id", F.xxhash64("s.sosok", "s.site").alias("source"), F.xxhash64("file_id").alias("file_id"), "content")


def repeated_lines(chunks: DataFrame, least: int = 3, share: float = 0.1) -> DataFrame:
    """(doc_id, lines): of each document the numbers of its repeated lines, without documents that have none."""
    rows = materialize(parsed(source_ids(chunks)), "lines")
    bad = repeated_templates(rows, least, share).groupBy("source").agg(F.collect_set("template").alias("bad"))  # at most 1 / share times the lines of a mean document
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    lines = rows.where("templates IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    hit = lines.join(bad, ["source", "salt"]).withColumn("hit", F.array_intersect("templates", "bad")).where(F.size("hit") > 0)
    numbers = F.filter(F.transform("templates", lambda t, i: F.when(F.array_contains("hit", t), i + 1)), lambda n: n.isNotNull())
    return hit.groupBy("doc_id").agg(F.first(numbers).alias("lines"))


def without_repeated_lines(chunks: DataFrame, least: int = 3, share: float = 0.1) -> DataFrame:
    """The rows, content without its repeated lines; nothing else changes."""
    found = repeated_lines(chunks, least, share).withColumnRenamed("lines", "_repeated")
    kept = F.array_join(F.filter(F.split("content", "\n", -1), lambda _, i: ~F.array_contains("_repeated", i + 1)), "\n")
    return chunks.join(found, "doc_id", "left").withColumn("content", F.when(F.col("_repeated").isNull(), F.col("content")).otherwise(kept)).drop("_repeated")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "chunks")).select("doc_id", F.explode("lines").alias("line_no"))


def p1_clean(spark, sf_dir: str) -> DataFrame:
    """Every chunk without its site's repeated lines."""
    return without_repeated_lines(table(spark, sf_dir, "chunks").dropDuplicates(["doc_id"])).select("doc_id", "content")


ship(__name__)
