"""Walks over edges (src, dst, edge_class): neighbours, bounded breadth-first search, ancestor closure."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.adjacency import EXECUTABLE, Steps, steps_of
from loomgraph.storage import cut


def oriented(edges: DataFrame, direction: str, classes: Iterable[str] | None = EXECUTABLE) -> DataFrame:
    """Distinct (node, next): along the edges for 'callees', against them for 'callers'."""
    return _steps(edges, direction, classes).distinct()


def _steps(edges: DataFrame, direction: str, classes: Iterable[str] | None) -> DataFrame:
    chosen = edges if classes is None else edges.filter(F.col("edge_class").isin(*classes))
    a, b = ("src", "dst") if direction == "callees" else ("dst", "src")
    return chosen.select(F.col(a).alias("node"), F.col(b).alias("next"))


#: Edges that a task groups.
EDGES = 1 << 19


def dealt(edges: DataFrame, most: int, *keys: str) -> DataFrame:
    """edges, no more than so many, before they are grouped by keys: dealt out to tasks of EDGES each, where these are more than there are cores.

    Below that Spark's own shuffle combines and deals them out.
    """
    n = -(-most // EDGES)
    return edges.repartition(n, *keys) if n > edges.sparkSession.sparkContext.defaultParallelism else edges


def stats(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edge_class, edges, sources, targets.

    A node's edges meet in one task, which holds one row for it. most: no fewer than there are edges, where that is
    known; otherwise they are counted first.
    """
    end = lambda id, out, into: F.struct(F.col(id).alias("id"), F.lit(out).cast("long").alias("out"), F.lit(into).alias("into"))
    ends = edges.select("edge_class", F.inline(F.array(end("src", 1, False), end("dst", 0, True))))
    ends = dealt(ends, edges.count() if most is None else most, "edge_class", "id")
    nodes = ends.groupBy("edge_class", "id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    known = F.col("id").isNotNull()
    return nodes.groupBy("edge_class").agg(
        F.coalesce(F.sum("out"), F.lit(0)).alias("edges"), F.count_if(known & (F.col("out") > 0)).alias("sources"), F.count_if(known & F.col("into")).alias("targets")
    )


def around(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node: the other ends of all edges, of any class, into or out of nodes (column node)."""
    into = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    from_ = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    return into.union(from_).distinct()


def related(edges: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """What lies around nodes without those that are told of otherwise (known, column node)."""
    return around(edges, nodes).join(known.select("node").distinct(), "node", "left_anti")


def members(rows: DataFrame, parents: Sequence[str] | None, order: Sequence[Column | str]) -> DataFrame:
    """rows (id, parent, ...) that lie in one of parents, or in any, numbered within theirs as nth."""
    own = rows.filter("parent IS NOT NULL") if parents is None else rows.filter(F.col("parent").isin(*parents))
    return own.withColumn("nth", F.row_number().over(Window.partitionBy("parent").orderBy(*order)))


def neighbours(edges: DataFrame, node: str, direction: str, classes: Iterable[str] | None = EXECUTABLE) -> DataFrame:
    """Direct callers or callees of one node; dependents and dependencies with classes=None."""
    return oriented(edges, direction, classes).filter((F.col("node") == node) & (F.col("next") != node)).select(F.col("next").alias("node"))


def bfs(edges: DataFrame | Steps, seeds: DataFrame, depth: int, direction: str = "callers", classes: Iterable[str] | None = EXECUTABLE) -> DataFrame:
    """node, hop: what is reached from seeds (column node) in at most depth steps; seeds are left out.

    Each level is one join with the frontier and one anti-join with what was seen, written to the shared
    folder, so a cycle ends it and the plan doesn't grow. Over adjacency on disk only frontiers move; other
    edges are written once and then read at each level. depth 0 goes on until nothing new is found.
    """
    steps = steps_of(edges).settled()
    seen = frontier = cut(seeds.select("node", F.lit(0).alias("hop")).dropDuplicates(["node"]))
    hop = 0
    while (size := frontier.count()) and (depth == 0 or hop < depth):
        hop += 1
        next_ = steps.after(frontier.select("node"), size, direction, classes).select(F.col("next").alias("node")).distinct()
        frontier = cut(next_.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
        seen = cut(seen) if hop % 20 == 0 else seen
    return seen.filter("hop > 0")


def first_reached(edges: DataFrame | Steps, seed: str, depth: int, limit: int, direction: str = "callers", classes: Iterable[str] | None = EXECUTABLE) -> tuple[list[tuple[str, int]], bool]:
    """The first `limit` nodes that a breadth-first walk from seed meets, with their hops, and whether there are more.

    Edges have a seq. A level's nodes come in the order of their first parent, of that one's edges, and of
    their own names. The walk ends within the level in which the limit is passed, so each level asks for
    the neighbours of at most `limit` nodes, and at most so many come to the driver.
    """
    steps = steps_of(edges)
    found: list[tuple[str, int]] = []
    level = [seed]
    for hop in range(1, depth + 1):
        next_ = steps.of(level, direction, classes)
        ranks = F.broadcast(next_.sparkSession.createDataFrame(list(enumerate(level)), "rank int, node string"))
        seen = [seed, *(n for n, _ in found)]
        next_ = next_.join(ranks, "node").filter(~F.col("next").isin(*seen))
        next_ = next_.groupBy("next").agg(F.min(F.struct("rank", "seq")).alias("first")).orderBy("first", "next")
        room = limit - len(found)
        level = [r["next"] for r in next_.limit(room + 1).collect()]
        found += [(n, hop) for n in level[:room]]
        if len(level) > room:
            return found, True
        if not level:
            break
    return found, False


def shortest_path(edges: DataFrame | Steps, start: str, end: str, classes: Iterable[str] | None = EXECUTABLE) -> list[str]:
    """The nodes of a shortest way along edges, both ends included; none if there is no way.

    Both ends are extended in turn, by a join each, until they meet or one of them has nothing new; only the
    way itself comes to the driver. Of equal ways that with the smallest nodes next to the ends is taken.
    """
    if start == end:
        return [start]
    steps = steps_of(edges).settled()
    spark = steps.edges.sparkSession
    sides = {}
    for name, at, direction in (("a", start, "callees"), ("b", end, "callers")):
        seen = spark.createDataFrame([(at, 0, None)], "node string, hop int, via string")
        sides[name] = [direction, cut(seen), 0, 1]
    turn = 0
    while True:
        side = sides["ab"[turn % 2]]
        turn += 1
        direction, seen, hop, size = side
        frontier = seen.filter(F.col("hop") == hop).select("node")
        new = steps.after(frontier, size, direction, classes).groupBy(F.col("next").alias("node")).agg(F.min("node").alias("via"))
        new = cut(new.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop + 1).alias("hop"), "via"))
        if not (size := new.count()):
            return []
        seen = seen.unionByName(new)
        side[1:] = cut(seen) if hop % 20 == 19 else seen, hop + 1, size
        both = sides["a"][1].select("node", F.col("hop").alias("x")).join(sides["b"][1].select("node", F.col("hop").alias("y")), "node")
        met = both.orderBy(F.col("x") + F.col("y"), "node").first()
        if met:
            break

    def back(seen: DataFrame, node: str, hops: int) -> list[str]:
        out = []
        for _ in range(hops):
            node = seen.filter(F.col("node") == node).first()["via"]
            out.append(node)
        return out

    return [*back(sides["a"][1], met["node"], met["x"])[::-1], met["node"], *back(sides["b"][1], met["node"], met["y"])]


def beyond(edges: DataFrame | Steps, reached: DataFrame, seeds: DataFrame, depth: int, direction: str = "callers", classes: Iterable[str] | None = EXECUTABLE) -> DataFrame:
    """Nodes one step behind the last level that weren't reached: non-empty if more lies beyond the depth."""
    last = cut(reached.filter(F.col("hop") == depth).select("node").distinct())
    seen = reached.select("node").union(seeds.select("node"))
    return steps_of(edges).after(last, last.count(), direction, classes).select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")


def closure(parents: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """node, ancestor, distance over (child, parent), the shortest distance of each pair; of these nodes (child) only, if given.

    Chains may have any length: a round adds one step, until none finds a new pair, so cycles end.
    """
    up = parents.select(F.col("child"), F.col("parent")).filter("child <> parent").distinct()
    first = up if of is None else up.join(of.select("child").distinct(), "child", "left_semi")
    known = cut(first.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    level, new = 1, known
    while not new.isEmpty():
        level += 1
        new = new.join(up, new["ancestor"] == up["child"]).select("node", F.col("parent").alias("ancestor"), F.lit(level).alias("distance")).filter("node <> ancestor").distinct()
        new = cut(new.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        known = cut(known.unionByName(new)) if level % 20 == 0 else known.unionByName(new)
    return known
