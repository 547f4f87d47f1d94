"""Page relations as streams.

Operators that look at one row (rotate, crop, place, replace, inject, with the
number of pages as a column) run on a stream as they are. What needs a document's
other pages waits until the document is complete: a page says how many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of pages as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _stamped(rows: DataFrame, time: str) -> DataFrame:
    """Times without a zone count in the session's: only those with one carry a watermark."""
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def changes_by_window(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of changes by kind and time window; changes later than that are dropped by the watermark."""
    at = _stamped(events, time).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind)
    return at.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def complete_documents(pages: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """doc_id and its number of pages, when all of them have come; documents that stay incomplete leave with the watermark."""
    seen = _stamped(pages, time).withWatermark(time, late).groupBy("doc_id", F.window(time, late))
    return seen.agg(F.max("n_pages").alias("n_pages"), F.count(F.lit(1)).alias("n")).filter("n = n_pages").select("doc_id", "n_pages")
