"""Keeping derived rows in step with files that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.resolve import latest


def manifest_diff(before: DataFrame, after: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """key, change: added, removed or changed; equal rows are left out."""
    a = before.select(F.col(key).alias("__a"), F.struct(*signature).alias("__old"))
    b = after.select(F.col(key).alias("__b"), F.struct(*signature).alias("__new"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return both.select(F.coalesce("__a", "__b").alias(key), change.alias("change")).filter("change IS NOT NULL")


def without_files(rows: DataFrame, gone: DataFrame, column: str = "file_path") -> DataFrame:
    """rows of none of the files in gone, by whole path: a.ts never takes a.tsx with it."""
    return rows.join(gone.select(column).distinct(), column, "left_anti")


def upserted(rows: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with those of new in place of theirs; of several new ones with a key the last in order."""
    fresh = latest(new, [key], order)
    return rows.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def relink_flags(changed: DataFrame, by: str, is_code: Column) -> DataFrame:
    """by, relink, events: for each batch of changes whether one of them can move edges between files."""
    return changed.groupBy(by).agg(F.coalesce(F.bool_or(is_code), F.lit(False)).alias("relink"), F.count(F.lit(1)).alias("events"))


def with_attribute(rows: DataFrame, values: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a derived column from values (key, name), in place of one of that name; null where there is none."""
    return rows.drop(name).join(values.select(key, name).dropDuplicates([key]), key, "left")
