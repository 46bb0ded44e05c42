"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, with a folder of the application's own in it.

    Where nothing is configured, a temporary folder serves a session on one machine; on a cluster, whose executors would
    each write to their own disk, that raises. clear_shared deletes the application's folder.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="addrspark-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/addrspark-{context.applicationId}"


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs a reread only."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


#: What keeps staged tables for later, and is emptied with them.
_memos: list[dict] = []


def memo() -> dict:
    """A dictionary for staged tables that clear_shared empties."""
    _memos.append({})
    return _memos[-1]


def clear_shared(spark: SparkSession) -> None:
    """Delete all that this application has staged, and forget what was kept; call it when no result is read any more."""
    _delete(spark, shared_folder(spark))
    for kept in _memos:
        kept.clear()
