"""Cutting the lineage of loops and of tables that several steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Folders made for sessions on one machine, by application.
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the context's checkpoint folder, which driver and executors share.

    A session on one machine, as in tests, gets a folder of its own where none is set; on a
    cluster that is an error, as files on an executor's own disk are seen by nobody else. The
    session's settings are left as they are.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _OWN.get(context.applicationId)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
