"""Maps of metadata and of counts as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(first: Column, second: Column) -> Column:
    """One map of both; where both have a key the second's value stands. A NULL map is an empty one."""
    none = F.create_map().cast("map<string,string>")
    first, second = F.coalesce(first, none), F.coalesce(second, none)
    own = F.filter(F.map_entries(first), lambda e: ~F.map_contains_key(second, e.key))
    return F.map_from_entries(F.concat(own, F.map_entries(second)))


def counted(df: DataFrame, by: list[str], value: str, out: str = "counts") -> DataFrame:
    """Of each group a map of value to how often it comes, counted before it is put together: what is collected is one entry a different value. NULL values are not counted."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return c.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value).alias("k"), F.col("_n").alias("v"))))).alias(out))
