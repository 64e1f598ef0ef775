"""A durable feed of what changes in a workspace.

poll() compares the files of a workspace with those of the poll before, by a join of two tables, and adds the
difference to a folder of events. A stream reads that folder, so its offsets are numbers of files, whatever
the number of paths; and an event that has been polled isn't lost when whoever reads it stops.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators.changes import manifest_diff
from loomgraph.sources.listing import as_uri, listing_table

EVENT = "path string, action string, mtime_ns long, size long, at timestamp"


class ChangeFeed:
    """root: the workspace; folder: where events and the last listing are kept, on storage that all machines share."""

    def __init__(self, spark: SparkSession, root: str, folder: str, exclude: tuple[str, ...] = (), endings: tuple[str, ...] = ()):
        self.spark, self.root, self.folder = spark, as_uri(root), as_uri(folder)
        self.exclude, self.endings = exclude, endings

    @property
    def version(self) -> int:
        return int(json.loads(storage.read_text(self.spark, f"{self.folder}/feed.json") or '{"version": 0}')["version"])

    def poll(self) -> int:
        """Adds what has changed since the last poll: update for new and changed files, delete for those that are gone.

        A file that moves is deleted at one place and updated at the other. Returns how many events there are. The
        version counts polls that found any; it is written last, so a poll that breaks off is made again.
        """
        version = self.version
        now = listing_table(self.spark, self.root, self.exclude, self.endings)
        before = self.spark.read.parquet(f"{self.folder}/listing-{version}") if version else now.limit(0)
        change = manifest_diff(before, now, "path", ["mtime_ns", "size"])
        events = change.join(now, "path", "left").select("path", F.when(F.col("change") == "removed", "delete").otherwise("update").alias("action"), "mtime_ns", "size", F.timestamp_seconds(F.lit(time.time())).alias("at"))
        events = storage.cut(events)
        if not (n := events.count()):
            return 0
        now.write.mode("overwrite").parquet(f"{self.folder}/listing-{version + 1}")
        storage.delete(self.spark, f"{self.folder}/events/poll={version + 1}")
        events.write.parquet(f"{self.folder}/events/poll={version + 1}")
        storage.replace_text(self.spark, f"{self.folder}/feed.json", json.dumps({"version": version + 1}))
        if version > 1:
            storage.delete(self.spark, f"{self.folder}/listing-{version - 1}")
        return n

    def stream(self) -> DataFrame:
        """The events as a stream: path, action, mtime_ns, size, at, poll."""
        return self.spark.readStream.schema(f"{EVENT}, poll int").parquet(f"{self.folder}/events")
