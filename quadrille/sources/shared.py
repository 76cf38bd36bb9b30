"""Tables in the folder that the cluster shares: how iterative operators cut their lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one on a local master.

    On a cluster an unset folder is an error: executors would each write to a folder of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/quadrille-{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder through the file system that Spark uses for it."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or jsc is None or jsc.sc().isStopped():
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is gone; the cluster's own cleaning of the folder remains
        return


def written(frame: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write a frame once as Parquet in the shared folder and read it back.

    Each partition is computed once, and any executor can reread the files after another is lost. The path is
    kept in the attribute ``quadrille_path`` so that a loop can drop the table of the round before; what is
    left goes when the driver ends.
    """
    spark = frame.sparkSession
    path = new_path(spark, label)
    frame.write.parquet(path)
    back = spark.read.schema(frame.schema).parquet(path)
    back.quadrille_path = path
    atexit.register(_remove_quietly, spark, path)
    return back


def drop_written(frame: DataFrame) -> None:
    """Remove a table made by written(); nothing may read it afterwards."""
    remove(frame.sparkSession, frame.quadrille_path)
