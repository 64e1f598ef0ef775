"""A folder of source files as a table, and its changes as a stream.

Spark's own file readers skip names that start with an underscore, such as package files, and can't leave
out folders by a rule; this source walks the folder itself, so bytes of left-out folders are never read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from loomgraph.storage import reachable

# Folders that hold no sources of the workspace's own.
EXCLUDED = frozenset(
    "node_modules venv env .venv .env __pycache__ target dist build out dist-electron electron assets migrations alembic "
    ".git .idea .vscode coverage htmlcov .pytest_cache .hypothesis .next .nuxt storybook-static .nyc_output esm cjs "
    "route_detection_tests fixtures test_fixtures test_data".split()
)
#: Names that are left out only where they hold an interpreter.
ENVIRONMENTS = frozenset(("venv", "env"))
MARKERS = ("pyvenv.cfg", "bin/python", "bin/python3", "Scripts/python.exe")
CODE = (".py", ".js", ".jsx", ".ts", ".tsx")
TEXT = (".json", ".md", ".html", ".css", ".yml", ".yaml", ".toml", ".txt", ".sql")
OWN = "_loomgraph"


def excluded_dir(name: str, path: str, excluded: frozenset[str], there: Callable[[str], bool] = os.path.exists) -> bool:
    """Whether a folder is left out; there tells whether a path exists."""
    if name.startswith(".") or name == OWN:
        return True
    if name in ENVIRONMENTS and name in excluded:
        return any(there(f"{path}/{m}") for m in MARKERS)
    return name in excluded


def from_environment() -> tuple[str, ...]:
    """Further names to leave out, from the comma list in LOOMGRAPH_EXCLUDE."""
    return tuple(filter(None, map(str.strip, os.environ.get("LOOMGRAPH_EXCLUDE", "").split(","))))


def listing(root: str, extra: tuple[str, ...] = ()) -> dict[str, tuple[int, int]]:
    """rel_path to (mtime_ns, size) of every file to index, in order of path; files that vanish are left out."""
    excluded, found = EXCLUDED | set(extra) | set(from_environment()), {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not excluded_dir(d, os.path.join(folder, d), excluded))
        for name in names:
            if name.endswith(CODE + TEXT) and not name.endswith(".d.ts"):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:
                    continue
                found[os.path.relpath(path, root).replace(os.sep, "/")] = (stat.st_mtime_ns, stat.st_size)
    return dict(sorted(found.items()))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


SCHEMA = "path string, mtime_ns long, size long, content binary, torn boolean"


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder of a root: a path of this machine, or a URI."""
    uri = root if "://" in root else "file://" + os.path.abspath(root)
    store, base = fs.FileSystem.from_uri(uri)
    return store, base.rstrip("/")


def read_one(store: fs.FileSystem, base: str, path: str) -> tuple | None:
    """A row of SCHEMA for a file; None if it is gone. torn: it changed while it was read."""
    full = f"{base}/{path}"
    try:
        before = store.get_file_info(full)
        with store.open_input_stream(full, compression=None) as f:
            content = f.read()
        after = store.get_file_info(full)
    except OSError:
        return None
    torn = (before.mtime_ns, before.size) != (after.mtime_ns, after.size) or len(content) != after.size
    return path, after.mtime_ns, after.size, content, torn


def unreadable(root: str, path: str) -> str | None:
    """Why a file can't be taken as it stands: it is being written, or code that isn't UTF-8; None if it can, or is gone."""
    row = read_one(*store_of(root), path)
    if row is None:
        return None
    if row[4]:
        return "changed while it was read"
    try:
        row[3].decode("utf-8")
    except UnicodeDecodeError as e:
        return f"not UTF-8: {e}" if path.endswith(CODE) else None
    return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.at_once = options["path"], int(options.get("files", 64))
        self.extra = tuple(filter(None, options.get("exclude", "").split(",")))

    def partitions(self):
        paths = list(listing(self.root, self.extra))
        return [_Files(paths[i : i + self.at_once]) for i in range(0, len(paths), self.at_once)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, base = store_of(self.root)
        yield from filter(None, (read_one(store, base, path) for path in partition.paths))


class _Changes(SimpleDataSourceStreamReader):
    """Differences between listings; an offset is the listing itself."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.extra = tuple(filter(None, options.get("exclude", "").split(",")))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _between(self, a: dict, b: dict) -> list[tuple[str, str]]:
        return sorted([(p, "update") for p in b if list(a.get(p, ())) != list(b[p])] + [(p, "delete") for p in a if p not in b])

    def read(self, start: dict):
        now = {p: list(s) for p, s in listing(self.root, self.extra).items()}
        return iter(self._between(start["files"], now)), {"files": now}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._between(start["files"], end["files"]))


class WorkspaceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "path string, action string" if self.options.get("changes") else SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Changes(self.options)


def read_workspace(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, mtime_ns, size, content and torn (changed while it was read) of every file to index."""
    reachable(spark)
    spark.dataSource.register(WorkspaceSource)
    return spark.read.format("workspace").option("exclude", ",".join(exclude)).load(os.path.abspath(root))


def read_paths(paths: DataFrame, root: str) -> DataFrame:
    """Rows of SCHEMA for the files named in paths (column path); no others are opened."""

    def run(batches):
        store, base = store_of(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [r for p in batch.column(0).slice(at, 64) if (r := read_one(store, base, p.as_py()))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "mtime_ns", "size", "content", "torn"])

    reachable(paths.sparkSession)
    return paths.select("path").mapInArrow(run, SCHEMA)


def read_changes(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A stream of (path, action): update for new and changed files, delete for those that are gone."""
    reachable(spark)
    spark.dataSource.register(WorkspaceSource)
    return spark.readStream.format("workspace").option("changes", "1").option("exclude", ",".join(exclude)).load(os.path.abspath(root))
