"""The chunk table on storage: creation, append, atomic rewrite, and what is in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import tag_list
from docweave.operators.access import Principal
from docweave.operators.catalog import retagged, without_documents, without_ids

SCHEMA = (
    "doc_id string, content string, embedding array<float>, original_filename string, tags string, sosok string, site string, file_id string, "
    "total_pdf_pages int, section_title string, section_id string, section_number int, page_number int, upload_date date"
)

COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Conflict(RuntimeError):
    """The table has changed since the rows of a rewrite were read."""


class ChunkStore:
    """A Parquet table partitioned by organisation, so that a permission filter prunes.

    A state is a numbered list of folders; its file is written under another name and renamed to its number, which is the commit. Nothing is deleted or
    overwritten, so a reader sees one whole state at any time, a crash leaves the state before, and two writers can't both take a number. An append adds a
    folder, and tries again on the state that came between; a rewrite that was made from an older state raises ``Conflict``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The number of the current state, 0 where there is none."""
        fs, at = _fs(self.spark, f"{self.path}/_states")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max([0, *(int(n) for n in names if n.isdecimal())])

    def _folders(self, version: int) -> list[str]:
        return [r.value for r in self.spark.read.text(f"{self.path}/_states/{version:012}").collect() if r.value] if version else []

    def _commit(self, version: int, folders: list[str]) -> bool:
        """Whether this became the state of that number."""
        fs, new = _fs(self.spark, f"{self.path}/_states/.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray("".join(f"{f}\n" for f in folders).encode()))
        out.close()
        _, at = _fs(self.spark, f"{self.path}/_states/{version:012}")
        if not fs.exists(at) and fs.rename(new, at):
            return True
        fs.delete(new, False)
        return False

    def _written(self, rows: DataFrame) -> str:
        name = f"part=p{uuid.uuid4().hex}"
        rows.write.partitionBy("sosok").parquet(f"{self.path}/{name}")
        return name

    def exists(self) -> bool:
        return self.version() > 0

    def create(self, recreate: bool = False) -> None:
        """An empty table; with recreate in place of any other."""
        if recreate or not self.exists():
            self._commit(self.version() + 1, [])

    def read(self) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in self._folders(self.version())]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*folders).select(*COLUMNS)

    def append(self, rows: DataFrame) -> None:
        """Rows with a vector are added; tags are normalised. Several writers may append at once."""
        rows = rows.where(F.size("embedding") > 0).withColumn("tags", F.array_join(tag_list(F.col("tags")), ", "))
        new = self._written(rows.select(*COLUMNS))
        while not self._commit((v := self.version()) + 1, [*self._folders(v), new]):
            pass

    def replace(self, rows: DataFrame, since: int | None = None) -> None:
        """The table becomes these rows, all at once; ``since`` is the version they were made from, by default the current one."""
        since = self.version() if since is None else since
        if not self._commit(since + 1, [self._written(rows)]):
            raise Conflict(f"version {since} of {self.path} is no longer the last")

    def retag(self, file_id: str, tags: str, who: Principal) -> None:
        v = self.version()
        self.replace(retagged(self.read(), file_id, tags, who), v)

    def delete(self, who: Principal, file_id: str | None = None, filename: str | None = None, ids: DataFrame | None = None) -> None:
        """Without the rows of these doc_ids, or of a file by id or name as far as the caller may see it."""
        v = self.version()
        self.replace(without_ids(self.read(), ids) if ids is not None else without_documents(self.read(), who, file_id, filename), v)

    def info(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("points"), F.max(F.size("embedding")).alias("vector_size"))


def gpu_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of the nine-field CSV a GPU monitor prints: [N/A] is NULL, shares to one place."""
    names = ["idx", "name", "temperature", "utilization", "memory_used", "memory_total", "power_draw", "power_limit", "fan"]
    parts = F.split(F.col(column), r"\s*,\s*")
    cells = [F.when(~F.get(parts, i).rlike(r"\[(N/A|Not Supported)\]"), F.trim(F.get(parts, i))) for i in range(len(names))]
    typed = [c.alias(n) if n == "name" else c.try_cast("double").alias(n) for n, c in zip(names, cells, strict=True)]
    return lines.select(*typed).withColumn("memory_percent", F.round(F.try_divide(F.col("memory_used") * 100, "memory_total"), 1))
