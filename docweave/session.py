"""Session helpers: shared scratch storage, lineage cuts, and shipping Python code to executors."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def once(make):
    """make() is called once a process; unlike functools' caches this can be pickled by value."""
    kept = []

    def get():
        if not kept:
            kept.append(make())
        return kept[0]

    return get


ship(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A folder of this machine is made only in local mode where none is named, as in tests; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


_marked: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    where = f"{shared_dir(spark)}/docweave/{spark.sparkContext.applicationId}"
    if where not in _marked:
        fs, path = _path(spark, where)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(where)
    return where


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, columns stay prunable, and lost executors cost nothing."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Delete what ``materialize`` has written in this application, once no result that reads it is needed any more."""
    fs, path = _path(spark, scratch_dir(spark))
    fs.delete(path, True)


def schema_with(df: DataFrame, kept: list[str], name: str, kind: str):
    """The schema of df's kept columns and a new one, which may hold NULL."""
    return df.select(*(F.col(f"`{c}`") for c in kept)).schema.add(name, kind, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores (small, or one file) laid out over all of them, before work that Python does row by row. Larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip_blanks(col):
    """Both ends without blanks of any kind."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def site_key(sosok, site):
    """(sosok, site) without blanks at the ends as one value; NULL where site is NULL."""
    return F.when(site.isNotNull(), F.struct(F.coalesce(strip_blanks(sosok), F.lit("")).alias("sosok"), strip_blanks(site).alias("site")))
