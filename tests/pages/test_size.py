"""Windows of large inputs: documents dealt over tasks by the size of the files, and no more exchanges and sorts than are needed."""

import os

import pytest
from pyspark.sql import functions as F

from quire import queries
from quire.functions import text as T
from quire.operators import geometry, info, pages, relations
from tests.conftest import SMALL
from tests.pages.test_queries import db, rows  # noqa: F401


@pytest.fixture
def large(monkeypatch):
    """The small tables count as large ones."""
    monkeypatch.setattr(pages, "SHARE", 1 << 10)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def same(frame, db, name):  # noqa: F811
    found = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    return rows(tuple(r) for r in frame.select(*names).collect()) == rows(found.fetchall())


def test_stanza_lines_dealt(spark, db, large):  # noqa: F811
    got = queries.info_stanza_round_trip(spark, SMALL)
    assert plan(got).count("Exchange hashpartitioning") == plan(got).count("REPARTITION_BY_NUM") == 1
    assert same(got, db, "info_stanza_round_trip")


def test_lines_of_files_dealt(spark, large, tmp_path):
    lines = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("line_no"), F.concat(F.lit("PdfID0: "), F.col("id").cast("string")).alias("line"))
    lines.write.parquet(f"{tmp_path}/lines")
    got = info.read_stanzas(spark.read.parquet(f"{tmp_path}/lines"))
    assert "REPARTITION_BY_NUM" in plan(got)
    assert sorted((r.doc_id, r.value) for r in got.collect()) == [(i, str(i)) for i in range(400)]
    assert "REPARTITION_BY_NUM" not in plan(info.read_stanzas(spark.createDataFrame([(1, 0, "InfoBegin")], "doc_id long, line_no int, line string")))


def test_small_inputs_left_alone(spark):
    assert "REPARTITION_BY_NUM" not in plan(queries.geo_chop_cols(spark, SMALL)) + plan(queries.info_stanza_round_trip(spark, SMALL))


def test_pieces_are_not_sorted(spark, db, large):  # noqa: F811
    got = queries.geo_chop_cols(spark, SMALL)
    assert plan(got).count("Exchange hashpartitioning") == plan(got).count("REPARTITION_BY_NUM") == 1
    assert plan(got).index("Generate") < plan(got).index("Sort [")  # upside down: pieces are made after the last sort
    assert same(got, db, "geo_chop_cols")


def test_pieces_of_several_rules_are_numbered(spark):
    df = spark.createDataFrame([(d, p, 0.0, 0.0, 8.0, 4.0) for d in (1, 2) for p in range(1, 5 - d)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    got = geometry.chop(df, ["evencols3", "3rows(1,1d,fill)"])
    assert dict(got.dtypes)["page_no"] == "int" and got.columns[-1] == "page_no"
    found = sorted((r.doc_id, r.page_no, r.src_page, r.piece) for r in got.collect())
    assert found == [(1, 1, 1, 0), (1, 2, 2, 1), (1, 3, 2, 2), (1, 4, 2, 3), (1, 5, 3, 1), (1, 6, 3, 3), (2, 1, 1, 0), (2, 2, 2, 1), (2, 3, 2, 2), (2, 4, 2, 3)]


def test_icons_need_no_window(spark, db, large):  # noqa: F811
    got = queries.attach_icons(spark, SMALL)
    assert plan(got).count("Exchange hashpartitioning") == plan(got).count("Sort [") == 1
    assert same(got, db, "attach_icons")


def test_icons_pass_over_other_pages(spark):
    df = spark.createDataFrame([(1, p, 5.0, 0.0, 100.0, 200.0) for p in (1, 2)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    got = relations.attach_files(df, [("a", "odd", None), ("b", None, None), ("c", "1-end", "Data"), ("d", "2", None)])
    found = sorted(((r.page_no, r.name, r.left, r.top) for r in got.collect()), key=repr)
    assert found == [(1, "a", 15.0, 190.0), (1, "c", 45.0, 160.0), (2, "c", 15.0, 190.0), (2, "d", 45.0, 160.0), (None, "b", None, None)]


def test_stages_share_an_exchange(spark, db, large):  # noqa: F811
    got = queries.pipe_cat_rotate_crop(spark, SMALL)
    assert plan(got).count("Exchange hashpartitioning") == plan(got).count("REPARTITION_BY_NUM") == 1
    assert same(got, db, "pipe_cat_rotate_crop")


def test_tasks_read_few_shares(spark, db, large):  # noqa: F811
    """A task that deals to more than 200 others keeps what it has read in memory, so that mustn't be a split of 128 MB."""
    setting = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, table in (("pipe_cat_rotate_crop", "lineitem"), ("info_stanza_round_trip", "orders")):
        spark.sparkContext.setJobGroup(name, name)
        got = queries.QUERIES[name](spark, SMALL)
        assert same(got, db, name)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        status = spark.sparkContext.statusTracker()
        tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup(name) for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)]
        size = os.path.getsize(f"{SMALL}/{table}.parquet")
        assert -(-size // (4 << 10)) in tasks, tasks
        assert got.sparkSession is spark and spark.conf.get("spark.sql.files.maxPartitionBytes") == setting


def test_only_files_are_read_in_shares(spark):
    made = spark.range(3)
    assert pages.in_shares(made) is made
    read = spark.read.parquet(f"{SMALL}/orders.parquet")
    filtered = read.filter("o_orderkey > 0")
    assert pages.in_shares(filtered) is filtered
    got = pages.in_shares(read)
    assert got.schema == read.schema and sorted(map(str, got.collect())) == sorted(map(str, read.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert pages.in_shares(read) is read  # the caller's smaller parts stay
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reports_share_an_exchange(spark, db, large):  # noqa: F811
    got = queries.info_dump_data(spark, SMALL)
    assert same(got, db, "info_dump_data")
    done = queries.info_dump_data(spark, SMALL)
    done.collect()
    assert plan(done).count("ReusedExchange") >= 2


def test_short_ways_of_text(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, -0.0, -1.0, 999.0, -999.0, 1000.0, -1000.0, 999.5, -0.5, 1e15, None)], "x double")
    assert [r[0] for r in df.select(T.number_text(F.col("x"))).collect()] == ["0", "0", "-1", "999", "-999", "1,000", "-1,000", "999.5", "-0.5", "1,000,000,000,000,000", None]
    df = spark.createDataFrame([(x,) for x in ("", "<3>", "a&'\"", "é<", "\x7f", "\x01\x1f", "\u0085x", "a\tb\nc", None)], "x string")
    assert [r[0] for r in df.select(T.xml_encode(F.col("x"))).collect()] == ["", "&lt;3&gt;", "a&amp;&apos;&quot;", "&#233;&lt;", "&#127;", "", "&#133;x", "ab\nc", None]
