"""The persisted index of a workspace: warm start, incremental refresh and a commit protocol.

Facts, nodes and edges of one state lie in a folder of their own; a small file names the state that counts,
and is replaced last, so that a reader sees one whole state and a crash leaves the one before. Only files
that changed are read and parsed again, and only files that the change touches are linked again, see
plans.linking. A file that can't be read as it stands keeps its last good
facts and is tried again, by later processes too. The state before the last one is kept for its readers.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph import storage
from loomgraph.operators.adjacency import Adjacency
from loomgraph.operators.changes import manifest_diff, without_files
from loomgraph.plans.code_graph import FACTS, Graph, facts, nodes_of, with_folders
from loomgraph.plans.linking import differing, link
from loomgraph.plans.questions import CodeStructure, lookup_keys, transparent
from loomgraph.sources.feed import ChangeFeed
from loomgraph.sources.languages import settings_of
from loomgraph.sources.listing import existing, listing_table
from loomgraph.sources.workspace import CODE, OWN, TEXT, read_paths, unreadable
from loomgraph.storage import cut
from loomgraph.streaming.debounce import settled

VERSION = "2"
#: File names in answers, bytes of a file up to which its content is summed, and seconds that a reader keeps a state.
FAILED, SUMMED, LEASE = 100, 64 << 20, 3600
DAMAGED = "The last state of the index is damaged ({}); answers come from the state before; refresh to mend it."


def fingerprint() -> str:
    """Changes with the shape of the facts and the kinds of files that are indexed."""
    return hashlib.sha256(json.dumps([VERSION, FACTS, CODE, TEXT]).encode()).hexdigest()[:16]


class WorkspaceIndex:
    """root: the sources; folder: where states are kept, on storage that all machines share.

    Both may be URIs of any store that pyarrow and Spark know; without a scheme they are paths. Without a folder
    that of LOOMGRAPH_INDEX is taken, and else one within the sources that isn't indexed. languages: settings of
    further ones, see sources.languages; their files are listed and read as well.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None, exclude: tuple[str, ...] = (), languages: Sequence[dict] = ()):
        self.spark, self.root, self.exclude = spark, root.rstrip("/") if "://" in root else os.path.abspath(root), exclude
        self.folder = (folder or os.environ.get("LOOMGRAPH_INDEX") or f"{self.root}/{OWN}").rstrip("/")
        self.languages = tuple(languages)
        self.endings = tuple(e for x in self.languages for e in settings_of(x)["extensions"])
        #: How many files the last refresh has linked again; None: all, or there was none.
        self.linked: int | None = None

    # the file that names the state

    @property
    def _pointer(self) -> str:
        return f"{self.folder}/index.json"

    def meta(self) -> dict | None:
        """What was published last; None if there is nothing or it can't be read."""
        try:
            found = json.loads(storage.read_text(self.spark, self._pointer) or "")
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def _write_meta(self, meta: dict) -> None:
        storage.replace_text(self.spark, self._pointer, json.dumps(meta))

    def is_stale(self) -> bool:
        """No file is fresh, one that can't be read is stale; so is one that is dirty or of another shape."""
        if not storage.exists(self.spark, self._pointer):
            return False
        meta = self.meta()
        return meta is None or bool(meta.get("dirty")) or meta.get("fingerprint") != fingerprint()

    def warnings(self) -> tuple[str, ...]:
        meta = self.meta() or {}
        n, some = meta.get("failed_count", 0), meta.get("failed", ())
        return (f"{n} files could not be refreshed and keep their last good state: {', '.join(some)}",) if n else ()

    # states

    def _table(self, state: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{state}/{name}")

    def _nodes(self, state: str) -> DataFrame:
        """The nodes of a state, with a bare one for each file that is imported but not in the workspace."""
        p = F.col("path")
        stubs = self._table(state, "stubs").select("path").distinct()
        stubs = stubs.select(p.alias("id"), F.lit("File").alias("kind"), F.element_at(F.split(p, "/"), -1).alias("name"), p.alias("qualified"), p.alias("file"))
        return self._table(state, "nodes").unionByName(stubs, allowMissingColumns=True)

    # seals and leases

    def _files(self, state: str) -> DataFrame:
        """file, length and content of the tables of a state."""
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{state}")
        return rows.select(F.substring_index("path", f"{state}/", -1).alias("file"), "length", "content")

    def _seal(self, state: str) -> None:
        """Keeps length and, up to SUMMED bytes, a checksum of each file of a state; the pointer tells how many there are."""
        rows = self._files(state)
        summed = rows.filter(F.col("length") <= SUMMED).select("file", "length", F.md5("content").alias("sum"))
        summed.unionByName(rows.filter(F.col("length") > SUMMED).select("file", "length", F.lit(None).cast("string").alias("sum"))).write.parquet(f"{self.folder}/{state}-seal")

    def damage(self, state: str, deep: bool = False) -> list[str]:
        """The first FAILED files of a state that are missing or shorter or longer than they were; with deep, that have other bytes."""
        if not storage.exists(self.spark, f"{self.folder}/{state}-seal"):
            return [f"{state}-seal"]
        seal = self.spark.read.schema("file string, length long, sum string").parquet(f"{self.folder}/{state}-seal")
        if not storage.exists(self.spark, f"{self.folder}/{state}"):
            return [state]
        rows = self._files(state)
        now = rows.select("file", F.col("length").alias("n"))
        if deep:
            now = now.join(rows.filter(F.col("length") <= SUMMED).select("file", F.md5("content").alias("now")), "file", "left")
        other = F.col("n").isNull() | (F.col("n") != F.col("length"))
        other = other | (F.col("sum").isNotNull() & ~F.col("sum").eqNullSafe(F.col("now"))) if deep else other
        return [r["file"] for r in seal.join(now, "file", "left").filter(other).select("file").orderBy("file").limit(FAILED).collect()]

    def _leases(self) -> dict[str, float]:
        """Until when each state is read by others, as they have said."""
        out: dict[str, float] = {}
        for name in storage.names(self.spark, f"{self.folder}/leases"):
            state, _, until = name.rpartition("=")[0].rpartition("=")
            if until.isdigit():
                out[state] = max(out.get(state, 0.0), float(until))
        return out

    def usable(self) -> tuple[str, tuple[str, ...]]:
        """The last state that is whole, and a warning if that is the one before; it isn't removed for LEASE seconds."""
        meta = self.meta() or {}
        damaged: list[str] = []
        for state in filter(None, (meta.get("state"), meta.get("before"))):
            if not (found := self.damage(state)):
                lease = f"{state}={int(time.time() + LEASE)}={uuid.uuid4().hex[:8]}"
                storage.replace_text(self.spark, f"{self.folder}/leases/{lease}", "")
                return state, (DAMAGED.format(", ".join(damaged[:5])),) if damaged else ()
            damaged += found
        raise IndexError(DAMAGED.format(", ".join(damaged[:5])) if damaged else "there is no state yet")

    def graph(self, state: str | None = None) -> Graph:
        state = state or self.usable()[0]
        named = self._table(state, "named"), Adjacency(self.spark, f"{self.folder}/{state}/steps"), self._table(state, "keys")
        return Graph(self._nodes(state), self._table(state, "edges"), self._table(state, "facts").filter("error IS NOT NULL").select("path", "error"), named)

    def structure(self) -> CodeStructure:
        state, damaged = self.usable()
        return CodeStructure(self.graph(state), self.root, self.is_stale(), self.warnings() + damaged)

    def stats(self) -> dict:
        """Numbers of nodes and edges; before the first refresh there are none of the one and the other aren't built."""
        return self.structure().stats() if (self.meta() or {}).get("state") else {"nodes": 0, "edges": "not built"}

    def refresh(self) -> dict:
        """Brings the index up to the files: mode (cold, warm or incremental), parsed, removed and failed.

        failed names the first FAILED of the files that couldn't be read as they stand; the state has all of them.
        """
        meta, now = self.meta(), listing_table(self.spark, self.root, self.exclude, self.endings)
        usable = bool(meta) and not self.is_stale() and not self.damage(meta["state"])
        state = f"state-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        if usable:
            again = self._table(meta["state"], "failed").join(now.select("path"), "path", "left_semi")
            diff = manifest_diff(self._table(meta["state"], "manifest"), now, "path", ["mtime_ns", "size"]).union(again.select("path", F.lit("changed")))
            diff = cut(diff.groupBy("path").agg(F.min("change").alias("change")))
        else:
            diff = now.select("path", F.lit("added").alias("change"))
        changed, removed = diff.filter("change <> 'removed'").select("path"), diff.filter("change = 'removed'").select("path")
        n_removed = removed.count() if usable else 0
        if usable and not n_removed and changed.isEmpty():
            return {"mode": "warm", "parsed": 0, "removed": 0, "failed": []}
        if meta:
            self._write_meta(meta | {"dirty": True})
        fresh = facts(read_paths(changed, self.root).filter("NOT torn"), self.languages)
        fresh.write.parquet(f"{self.folder}/{state}/fresh")
        fresh = self._table(state, "fresh")
        unread = F.startswith("error", F.lit("not UTF-8"))
        good = fresh.filter(F.col("error").isNull() | ~unread)
        failed = cut(changed.join(good.select("path"), "path", "left_anti"), f"{self.folder}/{state}/failed")
        n_failed, names = failed.count(), [r["path"] for r in failed.orderBy("path").limit(FAILED).collect()]
        before = (lambda name: self._table(meta["state"], name)) if usable else None
        replaced = cut(changed.union(removed).join(failed, "path", "left_anti")) if usable else None
        whole = without_files(before("facts"), replaced, "path").unionByName(good) if usable else good
        whole.write.parquet(f"{self.folder}/{state}/facts")
        own = self._table(state, "facts")
        nodes = nodes_of(good)
        if usable:
            nodes = without_files(before("nodes").filter("kind <> 'Folder'").drop("full_url"), replaced.withColumnRenamed("path", "file"), "file").unionByName(nodes)
            moved = differing(before("facts").select("path"), own.select("path"))
            changes = {"old": before, "changed": replaced.withColumnRenamed("path", "owner"), "moved": cut(moved)}
        keep = lambda name, rows: cut(rows, f"{self.folder}/{state}/{name}")
        changes = changes if usable else {}
        edges, self.linked = link(own, with_folders(nodes, own), keep, there=lambda paths: existing(paths, self.root), **changes)
        edges.write.parquet(f"{self.folder}/{state}/edges")
        nodes = self._nodes(state)
        named, steps = transparent(Graph(nodes, self._table(state, "edges"), nodes.limit(0)))
        named.repartitionByRange("file", "id").sortWithinPartitions("file", "id").write.parquet(f"{self.folder}/{state}/named")
        keys = lookup_keys(self._table(state, "named"))
        keys.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.folder}/{state}/keys")
        Adjacency.write(storage.cut(steps, f"{self.folder}/{state}/named-edges"), f"{self.folder}/{state}/steps")
        now.join(failed, "path", "left_anti").write.parquet(f"{self.folder}/{state}/manifest")
        parsed = fresh.count()
        self._seal(state)
        self._write_meta({"fingerprint": fingerprint(), "indexed_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "supported_extensions": [*CODE, *TEXT, *self.endings], "node_count": nodes.count(), "dirty": False, "files": now.count(), "failed_count": n_failed, "failed": names[:5], "state": state, "before": (meta or {}).get("state")})
        self._clear(kept={state, (meta or {}).get("state")})
        return {"mode": "incremental" if usable else "cold", "parsed": parsed, "removed": n_removed, "failed": names}

    def _clear(self, kept: set) -> None:
        """Removes states but these and those that someone still reads."""
        now, leases = time.time(), self._leases()
        for name in storage.names(self.spark, self.folder):
            state = name.removesuffix("-seal")
            if name.startswith("state-") and state not in kept and leases.get(state, 0) < now:
                storage.delete(self.spark, f"{self.folder}/{name}")
        for name in storage.names(self.spark, f"{self.folder}/leases"):
            if (until := name.split("=")[1] if name.count("=") == 2 else "0").isdigit() and float(until) < now:
                storage.delete(self.spark, f"{self.folder}/leases/{name}")

    def drain(self, changes: DataFrame, checkpoint: str) -> list[dict]:
        """Takes what the stream of changes holds by now, one refresh for each batch that has any."""
        done: list[dict] = []
        batch = lambda df, _: done.append(self.refresh()) if not df.isEmpty() else None
        changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return done

    def feed(self, folder: str) -> ChangeFeed:
        """A durable feed of what changes in the workspace."""
        return ChangeFeed(self.spark, self.root, folder, self.exclude, self.endings)

    def follow(self, feed: ChangeFeed, checkpoint: str, gap: float = 0.5, retry: float = 0.5, every: float = 0.2, done=lambda got: None) -> StreamingQuery:
        """A running stream that refreshes once for each batch of bursts that have settled, and calls done with the result.

        Bursts and files that can't be taken yet wait in the stream's state, see streaming.settled(); stopped and started
        with the same checkpoint it goes on with them.
        """
        root = self.root
        events = settled(feed.stream(), lambda path: unreadable(root, path), gap, retry)
        batch = lambda df, _: done(self.refresh()) if df.count() else None  # noqa: E731  counted, so that every state is committed
        return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every} seconds").start()
