"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset a local folder is set, but only on a local master: on a
    cluster each executor would write to a disk of its own, and rows would be lost."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glintframe-"))
    return sc._jsc.sc().getCheckpointDir().get()


_written: dict[str, list[str]] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: computed once, and lost executors cost nothing.

    DataFrame.checkpoint would run the plan twice, once to count it and once to write it.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written(spark: SparkSession) -> int:
    """How many tables ``checkpointed`` has written for this application and not deleted: a mark for ``forget_tables``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def forget_tables(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the tables that this application wrote by ``checkpointed`` after the mark, but for those that keep reads,
    once no other DataFrame that reads them is needed; returns their number."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    gone = [p for p in paths[since:] if p.rpartition("/")[2] not in read]
    _written[spark.sparkContext.applicationId] = paths[:since] + [p for p in paths[since:] if p not in gone]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in gone:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(gone)
