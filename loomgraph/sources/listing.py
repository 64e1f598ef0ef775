"""Listing a workspace by tasks: which files it has, as a table, wherever it lies.

Folders are dealt out to tasks. A task walks down from its folders until it has met a number of entries,
and hands back the folders that it didn't get to; the next round deals those out again. So a large tree is
listed by all machines, a small one in one round, and no list of paths is ever held by the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources import workspace
from loomgraph.storage import cut, reachable

#: Entries that a task lists before it hands folders back.
AT_ONCE = 20_000


def as_uri(root: str) -> str:
    """A root as a URI; one without a scheme is a path of this machine."""
    return root.rstrip("/") if re.match(r"[a-z][a-z0-9+.-]*:/", root) else "file://" + os.path.abspath(root)


def _left_out(store: fs.FileSystem, name: str, path: str, excluded: frozenset[str]) -> bool:
    there = lambda p: store.get_file_info(p).type != fs.FileType.NotFound
    return workspace.excluded_dir(name, path, excluded, there)


def walked(store: fs.FileSystem, base: str, folders: list[str], excluded: frozenset[str], endings: tuple[str, ...], at_once: int) -> Iterator[tuple[str, bool, int, int]]:
    """(path, is_folder, mtime_ns, size): files to index below folders, and folders that are left to others."""
    open_, met = list(reversed(folders)), 0
    while open_:
        folder = open_.pop()
        if met >= at_once:
            yield folder, True, 0, 0
            continue
        try:
            entries = store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
        except FileNotFoundError:
            continue
        met += len(entries)
        for e in sorted(entries, key=lambda x: x.base_name, reverse=True):
            path = f"{folder}/{e.base_name}" if folder else e.base_name
            if e.type == fs.FileType.Directory:
                if not _left_out(store, e.base_name, e.path, excluded):
                    open_.append(path)
            elif e.type == fs.FileType.File and e.base_name.endswith(endings) and not e.base_name.endswith(".d.ts"):
                yield path, False, e.mtime_ns, e.size


def listing_table(spark: SparkSession, root: str, extra: tuple[str, ...] = (), endings: tuple[str, ...] = (), at_once: int = AT_ONCE) -> DataFrame:
    """path, mtime_ns, size of every file to index; endings: further ones than the engine's own. A missing root has none."""
    uri, excluded = as_uri(root), workspace.EXCLUDED | set(extra) | set(workspace.from_environment())
    wanted = (*workspace.CODE, *workspace.TEXT, *endings)

    def run(batches):
        store, base = workspace.store_of(uri)
        folders = [f for b in batches for f in b.column(0).to_pylist()]
        found, kinds = walked(store, base, folders, excluded, wanted, at_once), (pa.string(), pa.bool_(), pa.int64(), pa.int64())
        while rows := [r for _, r in zip(range(4096), found, strict=False)]:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "is_folder", "mtime_ns", "size"])

    reachable(spark)
    level, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        rows = cut(level.mapInArrow(run, "path string, is_folder boolean, mtime_ns long, size long"))
        files = rows.filter("NOT is_folder").drop("is_folder")
        out = files if out is None else out.unionByName(files)
        left = rows.filter("is_folder").select("path")
        if not (n := left.count()):
            return out
        level = left.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path")


def existing(paths: DataFrame, root: str) -> DataFrame:
    """path of those files (path) that exist below root, left-out folders included; looked up by tasks."""
    uri = as_uri(root)

    def run(batches):
        store, base = workspace.store_of(uri)
        for batch in batches:
            infos = store.get_file_info([f"{base}/{p}" for p in batch.column(0).to_pylist()])
            there = pa.array([i.type == fs.FileType.File for i in infos], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(there)], ["path"])

    reachable(paths.sparkSession)
    return paths.select("path").mapInArrow(run, "path string")
