"""Counts by folder and short previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import ancestors


def by_folder(files: DataFrame, path: str = "path", value: str | None = None) -> DataFrame:
    """folder, level, files and, with a value column, its sum: over every folder above each file."""
    total = [F.sum(value).cast("long").alias(value)] if value else []
    rows = files.withColumn("folder", F.explode(ancestors(F.col(path))))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), *total).withColumn("level", F.size(F.split("folder", "/")))


def preview(rows: DataFrame, by: str, item: str, order: list[str], limit: int) -> DataFrame:
    """by, the first items in order joined by commas, and how many are left out.

    Rows are numbered within their group, so no list is longer than the limit.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    numbered = rows.withColumn("__nth", nth)
    kept = F.collect_list(F.when(F.col("__nth") <= limit, F.struct("__nth", item)))
    out = numbered.groupBy(by).agg(kept.alias("__kept"), F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).cast("long").alias("omitted"))
    return out.select(by, F.array_join(F.transform(F.array_sort("__kept"), lambda x: x[item].cast("string")), ",").alias("preview"), "omitted")


def merged(rows: DataFrame, by: list[str], order: str, lists: list[str], others: Sequence[Column] = ()) -> DataFrame:
    """One row for each group: its lists one behind the other in order, each value once, and other aggregates."""
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])))
    return rows.groupBy(*by).agg(*(ordered(c).alias(c) for c in lists), *others)
