"""Where intermediate results go that must outlive an executor."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")
    return folder.rstrip("/")


#: Bytes on disk up to which a table that cut() has written may be sent to all executors, through the driver.
SMALL = 1 << 18


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and it is computed once.

    Without a path of its own the table goes when the driver ends. Its number of rows is read from the files' footers.
    Spark takes a table to be as large as its files, which can be some thirty times smaller than its rows, and would
    send it through the driver at each join; so one of more than SMALL bytes is joined by shuffles.
    """
    own = path or f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(own)
    if not path:
        at_end(df.sparkSession, own)
    rows = df.sparkSession.read.schema(df.schema).parquet(own)
    return rows.hint("merge") if signature(df.sparkSession, own)[1] > SMALL else rows


def at_end(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver ends."""
    store, p = _at(spark, path)
    store.deleteOnExit(p)


def reachable(spark: SparkSession) -> None:
    """Tells Python workers where this package lies, however the session was started."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def _at(spark: SparkSession, path: str):
    """A path and the file system that holds it, whichever Hadoop knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(conf)
    store.setVerifyChecksum(False)
    store.setWriteChecksum(False)
    return store, p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _at(spark, path)
    return store.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    store, p = _at(spark, path)
    store.delete(p, True)


def signature(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a file or folder has changed last, and its bytes."""
    store, p = _at(spark, path)
    return store.getFileStatus(p).getModificationTime(), store.getContentSummary(p).getLength()


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, which is meant for few of them; none if there is no such folder."""
    store, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(p)) if store.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it isn't there or is no UTF-8."""
    store, p = _at(spark, path)
    if not store.exists(p):
        return None
    stream = store.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    except UnicodeDecodeError:
        return None
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file in one step: readers see the old text or the new one."""
    store, mine = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = store.create(mine, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.hsync() if hasattr(stream, "hsync") else stream.flush()
    stream.close()
    sc = spark.sparkContext
    rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(mine.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(mine), store.makeQualified(sc._jvm.org.apache.hadoop.fs.Path(path)), how)
