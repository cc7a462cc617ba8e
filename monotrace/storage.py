"""The folder that driver and executors share, and what is kept there for a while."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Where none is set, a session on one machine gets a temporary one; on a cluster, whose machines do not
    see each other's temporary folders, that is a RuntimeError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return folder or current.get()
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder, so that a lost executor takes nothing with it.

    Spark removes them once they are unreachable if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is there when the session's JVM ends is deleted."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, where = _of(spark, path)
    system.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again; deleted when the session's JVM ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _of(spark, path)
    system.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _of(spark, path)
    return system.exists(where)


def write_json(spark: SparkSession, path: str, what: dict) -> None:
    """A small file, in place of an older one; readers see it whole or not at all."""
    system, where = _of(spark, path)
    new = where.suffix(".new")
    out = system.create(new, True)
    out.write(bytearray(json.dumps(what).encode()))
    out.close()
    system.delete(where, False)
    system.rename(new, where)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """What write_json wrote; None where nothing is."""
    if not exists(spark, path):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def _of(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
