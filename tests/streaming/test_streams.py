from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import content, pages
from quire.streaming import pages as streams
from tests.conftest import SMALL


def test_row_operators_and_windows(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/events.parquet").select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page_no"), F.count("*").over(Window.partitionBy("user_id")).cast("int").alias("n_pages"), F.lit(0).alias("rotation"), F.col("event_type").alias("content"), "ts")
    path = f"file://{tmp_path}/in"
    rows.repartition(3).write.parquet(path)
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def collect(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = streams.read(spark, path, schema, 1)
    assert stream.isStreaming
    turned = content.replace(pages.rotate(stream, ["right"]).withColumn("n_pages", F.lit(1)), "-/c/C/")
    got = collect(turned.select("doc_id", "rotation", "content"), "turned", "append")
    want = rows.select("doc_id", F.lit(90).alias("rotation"), F.replace("content", F.lit("c"), F.lit("C")))
    assert got.exceptAll(want).isEmpty() and got.count() == rows.count()
    counts = collect(streams.changes_by_window(stream, "ts", "content", late="1000 days"), "counts", "complete")
    assert counts.agg(F.sum("n")).first()[0] == rows.count()
    done = collect(streams.complete_documents(stream.select("doc_id", "n_pages", "ts"), "ts", "1000 days"), "done", "complete")
    assert done.count() == rows.select("doc_id").distinct().count()
