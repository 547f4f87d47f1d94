"""What several operators share: written cuts of lineage, table readers, bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One batch of rows that goes to a Python worker at once, in bytes.
BATCH_BYTES = 16 << 20
#: Folders of local sessions that name none.
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes: rows may hold very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Where none is set a local session gets one of its own; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quire-")
    return at.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a
    lost executor costs no recomputation. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clean(*frames: DataFrame) -> None:
    """Remove what cut() wrote for these frames; they can't be read after that."""
    for df in frames:
        roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for root in roots:
            if "/quire-" in root:
                _remove(df.sparkSession, root)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean_all() -> None:
    for spark, path in _written:
        try:
            if spark._jsc.sc().isStopped():
                continue
            _remove(spark, path)
        except Exception:  # the JVM may be gone by now
            return


def unit_hash(*cols) -> Column:
    """A number from 0 to 1 that only the columns' values decide."""
    return (F.xxhash64(*cols) / F.lit(2.0**64)) + F.lit(0.5)


def crc_of_id(col="doc_id") -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


#: A key that more than one in HOT rows have, and more than LEAST_HOT, is hot: there are fewer than HOT such keys.
HOT = 1_000
LEAST_HOT = 1_000


def hot_keys(counted: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame | None:
    """The keys that are hot, of a written table with one row a key and its number of rows; None where none is."""
    total, most = counted.agg(F.sum(n), F.max(n)).first()
    bound = max((total or 0) / HOT, LEAST_HOT)
    return counted.filter(F.col(n) > bound).select(*keys) if (most or 0) > bound else None


def spread_join(rows: DataFrame, of_key: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """rows joined with of_key, which has one row a key; rows of hot keys aren't gathered, as their keys come to them."""
    if hot is None:
        return rows.join(of_key, list(keys))
    few = F.broadcast(hot)
    near = rows.join(F.broadcast(of_key.join(few, list(keys), "left_semi")), list(keys))
    return near.unionByName(rows.join(few, list(keys), "left_anti").join(of_key, list(keys)))


def within(df: DataFrame, order: str, size: str, limit: int) -> DataFrame:
    """The rows that come first by order, as many whole ones as have no more than limit of size together.

    For samples whose number of rows is bounded: the two columns come to the driver.
    """
    total, last = 0, None
    for r in sorted(df.select(order, size).collect()):
        total += r[1]
        if total > limit:
            break
        last = r[0]
    else:
        return df
    return df.filter(F.col(order) <= last) if last is not None else df.limit(0)


def agreed_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """doc_id and label (an int) of each document whose labels are 0 or 1 and agree; contradicting ones teach nothing."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    found = known.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("most"))
    return found.filter("label = most").drop("most")


def labelled_texts(docs: DataFrame, sample: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """doc_id, label, text and more columns: one row for each document of a bounded sample.

    Of rows that share a doc_id, the one of the least text teaches, so a hot id is one row.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select("doc_id", F.struct(text.alias("text"), *more).alias("r")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("r").alias("r"), F.first("label").alias("label")).select("doc_id", "label", "r.*")
