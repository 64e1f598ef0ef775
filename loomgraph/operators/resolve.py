"""Conservative resolution: ties and ambiguities stay unresolved rather than guessed."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import suffixes


def unique_target(candidates: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """One row for each group that has exactly one distinct target."""
    return candidates.groupBy(*by).agg(F.min(target).alias(target), F.max(target).alias("__most")).filter(F.col(target) == F.col("__most")).drop("__most")


def best_scored(candidates: DataFrame, by: Sequence[str], score: str, target: str) -> DataFrame:
    """Each group's target with the highest positive score, null where several share it or none is positive."""
    known, none = candidates.filter(F.col(score).isNotNull()), F.col(target).isNull()
    least, most = F.min(F.struct(-F.col(score), none, target)), F.max(F.struct(F.col(score), ~none, target))  # both of the top score; nulls count where nothing else has it
    tied = known.groupBy(*by).agg(least[target].alias("__a"), most[target].alias("__b"), most[score].alias(score))
    return tied.select(*by, F.when((F.col("__a") == F.col("__b")) & (F.col(score) > 0), F.col("__a")).alias(target), score)


def lowest_tier(candidates: DataFrame, by: Sequence[str], tier: str) -> DataFrame:
    """The candidates of each group that share its lowest tier."""
    least = candidates.groupBy(*by).agg(F.min(tier).alias("__least"))
    return candidates.join(least, list(by)).filter(F.col(tier) == F.col("__least")).drop("__least")


def statuses(asked: DataFrame, matched: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """For each row asked: resolved, ambiguous or not_found, the target if resolved, and how many match."""
    counted = matched.groupBy(*by).agg(F.countDistinct(target).alias("matches"), F.min(target).alias("__one"))
    n = F.coalesce("matches", F.lit(0))
    return asked.join(counted, list(by), "left").select(
        *asked.columns, F.when(n == 0, "not_found").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("__one")).alias(target), n.cast("long").alias("matches")
    )


def suffix_match(asked: DataFrame, wanted: str, files: DataFrame, path: str) -> DataFrame:
    """asked with each file whose path is, or ends by whole components in, the wanted one.

    Every suffix of a path is a row, so this is an equi-join; exact tells a whole match.
    """
    ends = files.select(F.col(path).alias("file"), F.explode(suffixes(F.col(path))).alias("__end"))
    return asked.join(ends, asked[wanted] == ends["__end"]).withColumn("exact", F.col("file") == F.col("__end")).drop("__end")


def unless(exact: Column) -> Column:
    return F.when(exact, 0).otherwise(1)


def first_seen(rows: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """One row for each distinct by, with the smallest seq."""
    return rows.groupBy(*by).agg(F.min(seq).alias(seq))


def conflict_to_null(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Each group's value if all its rows agree on one that isn't null; null otherwise."""
    same = (F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1)))
    return rows.groupBy(*by).agg(F.when(same, F.min(value)).alias(value))


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group in the order of the given columns."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def in_intervals(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Each point with every interval of its group that holds it, both ends included."""
    return points.join(intervals, list(by)).filter(F.col(at).between(F.col(start), F.col(end)))


def possible_callers(calls: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """Calls that could reach a target without those of callers (key) that are known to reach it or another of its name."""
    return calls.join(confirmed.select(key).distinct(), key, "left_anti")


def unresolved_calls(calls: DataFrame, known: DataFrame, call: str, noise: Column) -> DataFrame:
    """Calls that no known name (column of the same name) answers to and that aren't noise."""
    return calls.filter(~noise).join(known.select(call).distinct(), call, "left_anti")


def with_keyword(rows: DataFrame, name: str, keyword: str) -> DataFrame:
    """Rows whose name holds a keyword in any case, with rank 0 for whole matches and 1 for others."""
    word = keyword.strip().lower()
    hits = rows.filter(F.contains(F.lower(name), F.lit(word))) if word else rows.limit(0)
    return hits.withColumn("rank", F.when(F.lower(name) == word, 0).otherwise(1))


#: Rows of a group, on either side of a join that pairs all of them, that meet in one task.
SQUARE = 4096


def all_pairs(rows: DataFrame, targets: DataFrame, by: Sequence[str], square: int = SQUARE) -> DataFrame:
    """rows joined with targets of the same group (by); a large group is dealt out, so no task makes all of its pairs.

    Rows of a group are dealt to parts of about `square` rows, on both sides, and each part meets each part of the
    other side; what is copied for that is 2 / square of the pairs. A group that is small on both sides stays whole.
    """
    counted = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / square).alias(name))
    both = counted(rows, "__m").join(counted(targets, "__n"), list(by))
    tasks = both.filter("__m * __n > 1").agg(F.sum(F.col("__m") * F.col("__n")).alias("n")).first()["n"]
    if not tasks:
        return rows.join(targets, list(by))
    hot = F.broadcast(both.filter("__m * __n > 1"))  # at most one of `square` rows
    parts = lambda c: F.coalesce(c, F.lit(1).cast("long"))
    dealt = lambda df, c: F.pmod(F.xxhash64(*df.columns), parts(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), parts(c) - 1))
    mine = rows.join(hot, list(by), "left").select(*rows.columns, dealt(rows, F.col("__m")).alias("__i"), each(F.col("__n")).alias("__j"))
    theirs = targets.join(hot, list(by), "left").select(*targets.columns, dealt(targets, F.col("__n")).alias("__j"), each(F.col("__m")).alias("__i"))
    keys = [*by, "__i", "__j"]
    n = int(min(max(2 * tasks, 64), 20_000))  # as small rows make many pairs, their bytes don't tell how many tasks are needed
    return mine.repartition(n, *keys).join(theirs.repartition(n, *keys).hint("merge"), keys).drop("__i", "__j")


def or_fallback(rows: DataFrame, targets: DataFrame, by: Sequence[str], name: str, fallback: Column) -> DataFrame:
    """rows with the targets that share their group (by) and name; where fallback holds and none does, with all of the group.

    Equi-joins only: the second one takes just the rows that the first one left, and deals large groups out.
    """
    mine, theirs = rows.withColumn("__row", F.monotonically_increasing_id()), targets.withColumnRenamed(name, "__name")
    hit = mine.join(theirs, list(by)).filter(F.col(name) == F.col("__name"))
    rest = mine.filter(fallback).join(hit.select("__row").distinct(), "__row", "left_anti")
    rest = all_pairs(rest, theirs, by)
    return hit.unionByName(rest).drop("__row", "__name")


def most_alike(names: DataFrame, text: str, probe: str, cutoff: float, limit: int) -> DataFrame:
    """The rows whose text is most like probe, with like, the ratio of matching blocks; the last text of equals first.

    The ratio is at most twice the shorter length by both, so texts of other lengths never leave the JVM.
    """
    n = F.length(text)
    could = names.filter(n + len(probe) > 0).filter(2 * F.least(n, F.lit(len(probe))) / (n + len(probe)) >= cutoff)

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        m = difflib.SequenceMatcher()
        m.set_seq2(probe)

        def one(t):
            m.set_seq1(t)
            return m.ratio() if m.quick_ratio() >= cutoff else 0.0

        return texts.map(one).astype("float64")

    return could.withColumn("like", ratio(text)).filter(F.col("like") >= cutoff).orderBy(F.desc("like"), F.desc(text)).limit(limit)
