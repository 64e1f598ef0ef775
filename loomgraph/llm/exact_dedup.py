"""Exact dedup, with DataFrame operations only.

Rows are grouped by the 128-bit hash of their normalised text together with that text, so the
aggregation compares the bytes of all rows that share a hash and a collision makes two groups.
Copies are combined before the shuffle, so a text that a third of all rows share sends one row from
each task. The members then meet their group through a join of narrow rows on the hash, which Spark
splits where it is skewed; no list of a group's members is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import without_spaces


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal if they are so without white space (see SPACES). The row with the most code
    points in the original text stays, then that with the smallest id.

    Edge cases: a null text is an empty one, and all texts without other characters are equal. A
    null id counts as larger than all others, and is kept only where a group has no other. Rows that repeat an id within a group all get that
    group's keep_id and count in group_size; if it is the id that stays, they all have kept = true.
    An empty table gives no rows. Other columns of docs are not looked at.
    """
    norm = without_spaces(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"),
        norm.alias("norm"),
    ).withColumn("hash", F.unhex(F.md5(F.col("norm").cast("binary"))))
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    groups = (
        rows.groupBy("hash", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .select("hash", sha.alias("text_sha256"), "group_size", F.col("best.id").alias("keep_id"))
    )
    members = rows.select("doc_id", "n_chars", "hash", sha.alias("text_sha256"))
    return members.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.col("n_chars").cast("long").alias("n_chars")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all its columns kept; repeated rows go too.

    The row that stays is that of exact_groups(); of several with its id and as many code points, that
    with the smallest hash of the original text, and of rows that repeat id and original text any one.
    An id that comes with different texts stays with each of them. A null id is larger than all others,
    so a row without one stays only where its group has no other; of several such rows one stays.

    Rows meet their group's choice by its id and texts, so the copies of a hot group, which differ in
    their ids, go to different tasks and are gone after that join.
    """
    norm, raw = without_spaces(F.col(text_col)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = {
        "__hash": F.unhex(F.md5(norm.cast("binary"))),
        "__sha": F.sha2(norm.cast("binary"), 256),
        "__less": -F.length(raw),
        "__mark": F.unhex(F.md5(raw.cast("binary"))),
    }
    best = F.min(F.struct(F.col("__less"), F.col("id").isNull(), F.col("id"), F.col("__mark"))).alias("best")
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), *(c.alias(k) for k, c in own.items() if k != "__sha"))
    keep = rows.groupBy("__hash", "norm").agg(best).select("__hash", F.sha2(F.col("norm").cast("binary"), 256).alias("__sha"), "best.__less", F.col("best.id").alias("__kept_id"), "best.__mark")
    same = ["__hash", "__sha", "__less", "__mark"]
    keep = keep.select(F.col("__kept_id"), *(F.col(k).alias(f"{k}_of") for k in same))
    marked = docs.withColumns(own)
    on = marked[id_col].eqNullSafe(keep["__kept_id"])
    for k in same:
        on = on & (marked[k] == keep[f"{k}_of"])
    return marked.join(keep, on, "left_semi").dropDuplicates([id_col, *same]).select(*docs.columns)
