"""Interval labels of a forest: whether one class is above another, without a row for each pair of them.

The tour around a tree goes down into each node and up out of it again. As long as they are at least half of the
nodes, leaves are taken away, round by round, and leave room in the tour behind their parent; so all rounds together
are linear, and only the core that is left has its places worked out by pointer jumping: each step of the tour knows how far it is to the step that it points to, and in each round points
to where that one points; so after as many rounds as the logarithm of the tour's length all know how far it is
to the end. A node is above another if its interval of places holds the other's. Nodes with several parents
begin a tree of their own, and what is above them is kept as a closure of these few only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import traverse
from loomgraph.storage import cut

#: Children of one parent that a task puts in order; those of larger families are dealt out to several.
FAMILY = 10_000


@dataclass
class Labels:
    """intervals: node, root, first, last, depth; over: root, ancestor, distance of the roots that have several parents."""

    intervals: DataFrame
    over: DataFrame


def _siblings(children: DataFrame) -> DataFrame:
    """children (child, parent) with the next one of the same parent, and whether it is the first one."""
    size = children.groupBy("parent").agg(F.ceil(F.count(F.lit(1)) / FAMILY).alias("parts"))
    rows = children.join(size, "parent").withColumn("part", F.pmod(F.xxhash64("child"), F.col("parts")))
    own = Window.partitionBy("parent", "part").orderBy("child")
    rows = rows.withColumns({"next": F.lead("child").over(own), "nth": F.row_number().over(own)})
    heads = rows.filter("nth = 1").select("parent", "part", F.col("child").alias("head"))
    across = Window.partitionBy("parent").orderBy("part")
    heads = heads.withColumns({"following": F.lead("head").over(across), "leading": F.row_number().over(across) == 1})
    both = rows.join(heads, ["parent", "part"])
    return both.select("child", "parent", F.coalesce("next", "following").alias("next"), ((F.col("nth") == 1) & F.col("leading")).alias("first"))


def _placed(leaves: DataFrame) -> DataFrame:
    """leaves (node, parent, size, base) with offset: base, and the sizes of those of the same parent that come before.

    Of families of more than FAMILY several tasks add up parts, which are few enough to be sent to all.
    """
    large = leaves.groupBy("parent").agg(F.ceil(F.count(F.lit(1)) / FAMILY).alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    rows = leaves.join(F.broadcast(large), "parent", "left").withColumn("part", part)
    before = lambda *by: F.sum("size").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.filter("parts > 1").groupBy("parent", "part").agg(F.sum("size").alias("size"))
    sums = sums.select("parent", "part", before("parent", "part").alias("across"))
    rows = rows.withColumn("within", before("parent", "part", "node")).join(F.broadcast(sums), ["parent", "part"], "left")
    return rows.select("node", "parent", "size", (F.col("base") + F.coalesce("within", F.lit(0)) + F.coalesce("across", F.lit(0))).alias("offset"))


def _peeled(up: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The core of (node, parent), with size, the nodes that it has held of its own and itself, and what each round took away.

    A round takes all leaves, if they are at least half of the nodes, with their offset in what their parent holds.
    """
    now, rounds = cut(up.select("node", "parent", F.lit(1).cast("long").alias("size"))), []
    while True:
        inner = now.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.lit(True).alias("inner"))
        marked = cut(now.join(inner, "node", "left").withColumn("leaf", F.col("inner").isNull() & F.col("parent").isNotNull()).drop("inner"))
        gone = marked.filter("leaf").count()
        if not gone or 2 * gone < marked.count():
            return now, rounds
        rest = marked.filter("NOT leaf")
        room = rest.select(F.col("node").alias("parent"), (F.col("size") - 1).alias("base"))
        rounds.append(cut(_placed(marked.filter("leaf").select("node", "parent", "size").join(room, "parent"))))
        held = rounds[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("held"))
        now = cut(rest.join(held, "node", "left").select("node", "parent", (F.col("size") + F.coalesce("held", F.lit(0))).alias("size")))


def ranked(steps: DataFrame) -> DataFrame:
    """step, left: how far the end is from each, over lists given as (step, next) or (step, next, size); next is null at an end.

    size is how far it is to the next step, 1 where it isn't given. A round doubles how far each step looks ahead, so there are as many as the logarithm of the longest list.
    """
    size = F.col("size") if "size" in steps.columns else F.lit(1)
    now = cut(steps.select("step", "next", F.when(F.col("next").isNull(), 0).otherwise(size).cast("long").alias("left")))
    while not now.filter("next IS NOT NULL").isEmpty():
        to = now.select(F.col("step").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        now = cut(now.join(to, "next", "left").select("step", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    return now.select("step", "left")


def _roots(up: DataFrame) -> DataFrame:
    """node, root, depth of (node, parent), by pointer jumping; nodes on cycles, or below them, are left out.

    While any node below a root is open, a round settles some, those that are twice as deep as before; so
    where a round settles none, only cycles are left.
    """
    top = F.col("parent").isNull()
    now = cut(up.select("node", F.col("parent").alias("at"), F.when(top, F.col("node")).alias("root"), F.when(top, 0).otherwise(1).cast("long").alias("depth")))
    before, open_ = -1, now.filter("root IS NULL").count()
    while open_ and open_ != before:
        to = now.select(F.col("node").alias("at"), F.col("at").alias("then"), F.col("root").alias("found"), F.col("depth").alias("more"))
        both = now.join(to, "at", "left")
        now = cut(both.select("node", F.when(F.col("root").isNull(), F.col("then")).alias("at"), F.coalesce("root", "found").alias("root"), F.when(F.col("root").isNull(), F.col("depth") + F.col("more")).otherwise(F.col("depth")).alias("depth")))
        before, open_ = open_, now.filter("root IS NULL").count()
    return now.filter("root IS NOT NULL").select("node", "root", "depth")


def labels(parents: DataFrame) -> Labels:
    """Labels of all nodes of (child, parent). Repeated pairs count once, pairs of a node with itself and null ends don't.

    Nodes on cycles, and those below them by single parents only, have no interval; as what is above them isn't
    a tree, they are in no answer of above(). Rows are linear in the nodes, but for those of roots with several parents.
    """
    pairs = cut(parents.filter("child <> parent").select("child", "parent").distinct())
    several = cut(pairs.groupBy("child").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("child"))
    single = pairs.join(several, "child", "left_anti")
    every = pairs.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    core, rounds = _peeled(every.join(single.withColumnRenamed("child", "node"), "node", "left"))
    roots = cut(_roots(core))
    tree = cut(_siblings(core.filter("parent IS NOT NULL").select(F.col("node").alias("child"), "parent").join(roots.select(F.col("node").alias("child")), "child", "left_semi")))
    eldest = tree.filter("first").select(F.col("parent").alias("node"), F.col("child").alias("eldest"))
    rows = roots.join(core.select("node", "size"), "node").join(eldest, "node", "left").join(tree.select(F.col("child").alias("node"), "parent", "next"), "node", "left")
    down, up = (lambda c: F.concat(F.lit("v"), c)), (lambda c: F.concat(F.lit("^"), c))
    node, eldest, next_, parent = (F.col(c) for c in ("node", "eldest", "next", "parent"))
    there = rows.select(down(node).alias("step"), F.coalesce(down(eldest), up(node)).alias("next"), (2 * F.col("size") - 1).alias("size"))
    back = rows.select(up(node).alias("step"), F.coalesce(down(next_), up(parent)).alias("next"), F.lit(1).cast("long").alias("size"))
    place = ranked(there.union(back)).withColumn("node", F.expr("substring(step, 2)"))
    into = F.startswith("step", F.lit("v"))
    ends = place.groupBy("node").agg((-F.max(F.when(into, F.col("left")))).alias("first"), (-F.max(F.when(~into, F.col("left")))).alias("last"))
    own = cut(ends.join(roots, "node").select("node", "root", "first", "last", "depth"))
    for one in reversed(rounds):
        under = one.join(own.select(F.col("node").alias("parent"), "root", F.col("first").alias("at"), "depth"), "parent")
        first = F.col("at") + 1 + 2 * F.col("offset")
        own = own.unionByName(cut(under.select("node", "root", first.alias("first"), (first + 2 * F.col("size") - 1).alias("last"), (F.col("depth") + 1).alias("depth"))))
    over = traverse.closure(pairs, several).select(F.col("node").alias("root"), "ancestor", "distance")
    return Labels(own, over)


def above(pairs: DataFrame, of: Labels) -> DataFrame:
    """node, ancestor, distance of the pairs (node, ancestor) in which the one is above the other, at the least distance.

    Each pair meets the label of both ends and what lies over the root; nothing is walked.
    """
    asked = pairs.select("node", "ancestor").distinct()
    low = of.intervals.select("node", "root", "first", "last", "depth")
    high = of.intervals.select(F.col("node").alias("ancestor"), F.col("root").alias("a_root"), F.col("first").alias("a_first"), F.col("last").alias("a_last"), F.col("depth").alias("a_depth"))
    both = asked.join(low, "node").join(high, "ancestor", "left")
    within = (F.col("root") == F.col("a_root")) & (F.col("a_first") < F.col("first")) & (F.col("last") < F.col("a_last"))
    over = of.over.select("root", "ancestor", F.col("distance").alias("d"))
    found = both.join(over, ["root", "ancestor"], "left")
    distance = F.least(F.when(within, F.col("depth") - F.col("a_depth")), F.col("depth") + F.col("d"))
    return found.select("node", "ancestor", distance.cast("int").alias("distance")).filter("distance IS NOT NULL AND node <> ancestor")
