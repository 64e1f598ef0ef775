"""Connected components by Spark joins: no part of the graph is held by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, written


def _drawn(rows: DataFrame) -> tuple[DataFrame, tuple]:
    """rows (u, v) written, with their number and a sum of their hashes, which the same pass gives."""
    seen = Observation()
    out = written(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), "part-links")
    return out, (seen.get["n"], seen.get["h"])


def components(links: DataFrame) -> DataFrame:
    """node, part for each node of links (columns a and b): the smallest node that links lead to.

    Stars are drawn by turns: each node hands its larger neighbours, then its smaller ones, on to the
    smallest it knows. Minima are combined before the shuffle, so a node with very many links costs one
    row a task. Each turn is written to the shared folder. The number of turns grows with the logarithm
    of the longest way. Null ends and loops are left out; no links give no rows.
    """
    now, after = _drawn(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while after[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select("u", "v", "m")
        drawn = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select("v", "m"))
        last, (now, after) = now, _drawn(drawn.distinct())
        dropped(last)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("part")).union(now.select("v", "v").distinct())
        before = after
    return now.toDF("node", "part")
