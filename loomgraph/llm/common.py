"""Small helpers that the operators of this package share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that the text operators treat as white space, in code point order.
SPACES = "\x09\x0a\x0b\x0c\x0d\x20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Python workers are told where this package lies, however they were started."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a local folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")
    spark.sparkContext.setCheckpointDir(folder) if not spark.sparkContext.getCheckpointDir() else None
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs nothing.

    What reads the table may be asked for at any time, so it goes with the session; dropped() is for
    tables that nothing reads any more.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    deleted(df.sparkSession, path, at_end=True)
    return out


def deleted(spark: SparkSession, path: str, at_end: bool = False) -> None:
    """Removes a folder through Hadoop's file system, wherever it lies, now or when the driver ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(p) if at_end else store.delete(p, True)


def dropped(*tables: DataFrame | None) -> None:
    """Removes tables that written() returned and that nothing will read again."""
    for t in tables:
        if t is not None:
            deleted(t.sparkSession, t.written_to)


def without_spaces(text):
    """The column without the characters of SPACES; six plain replacements beat a regular expression."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out
