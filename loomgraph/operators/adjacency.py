"""Steps of a graph: the edges out of and into nodes, read from any table or from adjacency kept on disk.

On disk, edges lie twice, by source and by target, in buckets of about equal size, sorted within. A node with
very many edges is a hub: its edges are dealt out to numbered chunks, each with a key of its own, so no bucket
holds more than a chunk of it. A walk then joins a frontier with the buckets: only the frontier moves, and
of a small frontier only those buckets and row groups are read that can hold its keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import storage

EXECUTABLE = ("executable", "generated")
#: Frontiers of up to so many keys are looked up by value, those of up to MEET are broadcast to edges that aren't on disk.
FEW, MEET = 400, 100_000
#: Edges of a node in one chunk, and edges in one bucket.
CHUNK, BUCKET = 1 << 12, 1 << 19
MARK = "\x01"


def _of(edges: DataFrame, direction: str) -> DataFrame:
    a, b = ("src", "dst") if direction == "callees" else ("dst", "src")
    return edges.select(F.col(a).alias("node"), F.col(b).alias("next"), "edge_class", *(["seq"] if "seq" in edges.columns else [F.lit(0).cast("long").alias("seq")]))


def _chosen(rows: DataFrame, classes: Iterable[str] | None) -> DataFrame:
    return rows if classes is None else rows.filter(F.col("edge_class").isin(*classes))


class Steps:
    """Steps over a table of edges (src, dst, edge_class and, if it has one, seq)."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    def of(self, nodes: Sequence[str], direction: str, classes: Iterable[str] | None = EXECUTABLE) -> DataFrame:
        """node, next, edge_class, seq of a few nodes."""
        return _chosen(_of(self.edges, direction), classes).filter(F.col("node").isin(*nodes))

    def after(self, frontier: DataFrame, size: int, direction: str, classes: Iterable[str] | None = EXECUTABLE) -> DataFrame:
        """The same for a table of `size` different nodes (column node)."""
        rows = _chosen(_of(self.edges, direction), classes)
        return rows.join(F.broadcast(frontier) if size <= MEET else frontier, "node")

    def settled(self) -> Steps:
        """The same with edges that are read from disk at each step, not worked out anew."""
        return Steps(storage.cut(self.edges.select("src", "dst", "edge_class", *(["seq"] if "seq" in self.edges.columns else []))))


class Adjacency(Steps):
    """Steps over adjacency that write() has left in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.meta = folder, json.loads(storage.read_text(spark, f"{folder}/adjacency.json") or "")
        self.tables = {d: self._bucketed(spark, d) for d in ("callees", "callers")}
        self.hubs = {d: spark.read.schema("node string, chunks long").parquet(f"{folder}/{d}-hubs") for d in self.tables}
        rows = self.tables["callees"]
        self.edges = rows.select(F.col("node").alias("src"), F.col("next").alias("dst"), "edge_class", "seq")

    def _bucketed(self, spark: SparkSession, direction: str) -> DataFrame:
        """Spark knows buckets of tables with a name only; the name goes again as soon as the table is known."""
        name = f"adjacency_{uuid.uuid4().hex}"
        path = f"{self.folder}/{direction}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} (key STRING, node STRING, next STRING, edge_class STRING, seq BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.meta['buckets']} BUCKETS LOCATION '{path}'")
        try:
            return spark.table(name)
        finally:
            spark.sql(f"DROP TABLE {name}")

    @classmethod
    def write(cls, edges: DataFrame, folder: str, chunk: int = CHUNK, bucket: int = BUCKET, least: int = 1) -> Adjacency:
        """Edges (src, dst, edge_class, seq), which are read twice for each direction, into a folder."""
        spark, total = edges.sparkSession, edges.count()
        buckets = max(least, min(-(-total // bucket), 50_000), 1)
        for direction in ("callees", "callers"):
            rows = _of(edges, direction)
            degree = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
            hubs = storage.cut(degree.select("node", F.ceil(F.col("n") / chunk).alias("chunks")), f"{folder}/{direction}-hubs")
            dealt = rows.join(hubs, "node", "left").withColumn("chunk", F.pmod(F.xxhash64("next"), F.coalesce("chunks", F.lit(1))))
            keyed = dealt.select(_key(F.col("chunk")).alias("key"), "node", "next", "edge_class", "seq")
            name = f"adjacency_{uuid.uuid4().hex}"
            keyed.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").format("parquet").option("path", f"{folder}/{direction}").saveAsTable(name)
            spark.sql(f"DROP TABLE {name}")
        storage.replace_text(spark, f"{folder}/adjacency.json", json.dumps({"buckets": buckets, "chunk": chunk, "edges": total}))
        return cls(spark, folder)

    def of(self, nodes: Sequence[str], direction: str, classes: Iterable[str] | None = EXECUTABLE) -> DataFrame:
        hubs = self.hubs[direction].filter(F.col("node").isin(*nodes)).collect() if self.meta["edges"] > self.meta["chunk"] else []
        if sum(r["chunks"] for r in hubs) > FEW:
            spark = self.hubs[direction].sparkSession
            return self._met(spark.createDataFrame([(n,) for n in nodes], "node string"), direction, classes)
        keys = [*nodes, *(f"{r['node']}{MARK}{i}" for r in hubs for i in range(1, r["chunks"]))]
        return _chosen(self.tables[direction].filter(F.col("key").isin(*keys)), classes).drop("key")

    def _met(self, frontier: DataFrame, direction: str, classes: Iterable[str] | None) -> DataFrame:
        chunked = frontier.join(self.hubs[direction], "node", "left")
        keys = chunked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"), "node").select(_key(F.col("chunk")).alias("key"))
        return _chosen(self.tables[direction], classes).join(keys, "key").drop("key")

    def after(self, frontier: DataFrame, size: int, direction: str, classes: Iterable[str] | None = EXECUTABLE) -> DataFrame:
        if size <= FEW:
            return self.of([r["node"] for r in frontier.collect()], direction, classes)
        return self._met(frontier.select("node"), direction, classes)

    def settled(self) -> Adjacency:
        return self


def _key(chunk):
    return F.when(chunk > 0, F.concat_ws(MARK, "node", chunk.cast("string"))).otherwise(F.col("node"))


def steps_of(edges: DataFrame | Steps) -> Steps:
    return edges if isinstance(edges, Steps) else Steps(edges)
