"""Cuts of lineage: tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quire-")
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to that folder and read back, so that a lost executor costs no recomputation of what is before it."""
    path = f"{shared_dir(df.sparkSession)}/pages-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
