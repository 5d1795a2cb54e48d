"""Results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of SparkContext.setCheckpointDir, which all machines of a cluster see.

    Where neither is set, a session of one machine, as in tests, gets a folder of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not folder and not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return (folder or context.getCheckpointDir().get()).rstrip("/")


#: What an application has written to the shared folder.
_WRITTEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which sweep() takes away."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Delete what this application has written to the shared folder so far, and say how many tables. Only once the results that read them have been written."""
    paths, jvm = _WRITTEN.pop(spark.sparkContext.applicationId, []), spark.sparkContext._jvm
    for p in paths:
        for end in ("", "-state"):
            path = jvm.org.apache.hadoop.fs.Path(p + end)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what comes before runs once, however often the result is read, and lost executors cost no more than the current step.

    The table stays until sweep(), as a result that reads it may be read at any time.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
