"""Bundles of relations on disk, stanza and form-data files, and the driver's tables as relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators.pages import dealt, in_shares
from ..registry import Bundle

RELATIONS = ("documents", "docinfo", "pages", "page_labels", "outlines", "dests", "annots", "fields", "layers", "layer_off", "attachments")


def read(spark: SparkSession, path: str) -> Bundle:
    """Every relation that the folder has."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {n: in_shares(spark.read.parquet(f"{path}/{n}")) for n in RELATIONS if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"))}
    if not found:
        raise InvalidArgument(f"no relation in {path}")
    return Bundle(found)


def write(bundle: Bundle, path: str, compression: str | None = None, ordered: bool = False) -> None:
    """Every relation as a table; ordered: pages by document and number within each file."""
    for name, frame in bundle.relations.items():
        if ordered and name == "pages":
            frame = frame.repartition("doc_id").sortWithinPartitions("doc_id", "page_no")
        writer = frame.write.mode("overwrite")
        (writer.option("compression", compression) if compression else writer).parquet(f"{path}/{name}")


def stanza_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, line_no, line of text files, one document a file."""
    rows = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.split("value", "\r?\n").alias("lines"))
    return rows.select("doc_id", F.posexplode("lines").alias("line_no", "line"))


def fdf_values(text: DataFrame) -> DataFrame:
    """doc_id, fq_name, value of FDF text (doc_id, fdf): its /T and /V pairs."""
    pairs = F.regexp_extract_all("fdf", F.lit(r"/T \(((?:\\.|[^\\)])*)\)\s*/V \(((?:\\.|[^\\)])*)\)"), F.lit(0))
    rows = text.select("doc_id", F.posexplode(pairs).alias("seq", "pair"))
    plain = lambda n: F.regexp_replace(F.regexp_extract("pair", r"/T \(((?:\\.|[^\\)])*)\)\s*/V \(((?:\\.|[^\\)])*)\)", n), r"\\(.)", "$1")
    return rows.select("doc_id", "seq", plain(1).alias("fq_name"), plain(2).alias("value"))


def xfdf_values(text: DataFrame) -> DataFrame:
    """doc_id, seq, fq_name, value of XFDF text (doc_id, xfdf): names of nested fields joined by dots; a field without a value is
    left out, an empty value is an empty text. Each file is parsed once, in an Arrow step; what isn't XML fails the job."""

    def run(batches):
        import xml.etree.ElementTree as ET

        import pyarrow as pa

        def found(root):
            stack = [(root, ())]
            while stack:
                node, above = stack.pop()
                own = above
                if node.tag.rsplit("}", 1)[-1] == "field":
                    own = (*above, node.get("name", ""))
                    for child in node:
                        if child.tag.rsplit("}", 1)[-1] == "value":
                            yield ".".join(own), "".join(child.itertext())
                            break
                stack += [(child, own) for child in reversed(node)]

        for batch in batches:
            rows = [(doc, i, *pair) for doc, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if xml for i, pair in enumerate(found(ET.fromstring(xml)))]
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "seq", "fq_name", "value"])

    kind = text.schema["doc_id"].dataType.simpleString()
    return text.select("doc_id", "xfdf").mapInArrow(run, f"doc_id {kind}, seq int, fq_name string, value string")


#: Folders that tables of many small files are dealt over.
BUCKETS = 64


def bucketed(frame: DataFrame, path: str, *names: str) -> None:
    """frame as Parquet in BUCKETS folders by the hash of names, sorted by them: the number of folders doesn't grow with
    the documents, and a reader that knows a name reads one folder. A clashing column `bucket` is replaced."""
    rows = frame.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int"))
    rows.repartition(BUCKETS, "bucket", *names).sortWithinPartitions("bucket", *names).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_each(pages: DataFrame, path: str, name: str = "file_name") -> None:
    """The single-page documents that burst has named."""
    bucketed(pages, path, name)


def write_lines(lines: DataFrame, path: str) -> None:
    """Report lines (doc_id, section, seq, line_no, line) as text, one folder for each document, in order."""
    rows = F.sort_array(F.collect_list(F.struct("section", "seq", "line_no", "line")))
    text = lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("value"))
    text.write.mode("overwrite").partitionBy("doc_id").text(path)


def file_arguments(words: list[str]) -> list:
    """A single `@name` stands for the JSON (or YAML, where a reader is there) in that file."""
    if len(words) != 1 or not words[0].startswith("@"):
        return words
    import json

    with open(words[0][1:], encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise InvalidArgument(f"{words[0]} isn't JSON") from None
        return yaml.safe_load(text)


def split_arguments(text: str) -> list[str]:
    """Words of a command line, quotes kept together."""
    return [a or b or c for a, b, c in re.findall(r'"([^"]*)"|\'([^\']*)\'|(\S+)', text)]


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages."""
    rows = in_shares(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "role", F.col("text").alias("content"))


def lineitem_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as pages: width, height, rotation and a box that starts at 0. One exchange on doc_id serves all that is done by document."""
    names = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    rows = dealt(in_shares(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).select(F.col("l_orderkey").alias("doc_id"), *names), "doc_id")
    # numbered first: what is worked out from the columns isn't shuffled, and all readers share the exchange
    out = rows.withColumn("page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*names))).select(
        "doc_id",
        "page_no",
        ((F.col("l_linenumber") % 4) * 90).cast("int").alias("rotation"),
        F.col("l_quantity").alias("width"),
        (F.col("l_extendedprice") / 100).alias("height"),
        F.col("l_linenumber").alias("line"),
    )
    return out.select("*", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
