"""The page engine's queries over the driver's tables, each beside the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import content, geometry, info, pages, relations, repair
from .plans import stages
from .registry import Bundle
from .sources.bundles import conversation_pages, lineitem_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions that all queries may use.
C = "c AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no, role, text AS content, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS n FROM conversations)"
L = """l AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS INTEGER) AS page_no,
        CAST((l_linenumber % 4) * 90 AS INTEGER) AS rotation, l_quantity AS width, l_extendedprice / 100 AS height, l_linenumber AS line, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n FROM lineitem)"""


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _six(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded to six places; minus zero is zero."""
    for n in names:
        df = df.withColumn(n, F.round(F.col(n), 6) + F.lit(0.0))
    return df


# ---- page order

_RN = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {}) AS INTEGER)"


@query(f"WITH {C} SELECT doc_id, {_RN.format('p DESC')} AS page_no, p AS src_page, role FROM (SELECT *, page_no AS p FROM c WHERE page_no % 2 = 0)")
def pg_cat_reverse(spark, d):
    out = pages.cat(conversation_pages(spark, d), ["end-1even"])
    return out.select("doc_id", "page_no", "src_page", "role")


@query(f"WITH {C} SELECT doc_id, {_RN.format('page_no')} AS page_no, page_no AS src_page, role, content FROM c WHERE page_no % 2 = 0 AND page_no <> n")
def pg_cat_even_omit(spark, d):
    return pages.cat(conversation_pages(spark, d), ["1-endeven~r1"]).select("doc_id", "page_no", "src_page", "role", "content")


@query(f"WITH {C} SELECT doc_id, {_RN.format('page_no')} AS page_no, page_no AS src_page, content FROM c WHERE page_no % 2 = 1 AND page_no <> 3")
def pg_cat_range(spark, d):
    return pages.cat(conversation_pages(spark, d), ["1-endodd~3"]).select("doc_id", "page_no", "src_page", "content")


@query(f"""WITH {C}, p AS (SELECT doc_id, page_no, n, role, 0 AS s, page_no AS pos FROM c UNION ALL SELECT doc_id, page_no, n, role, 1, n - page_no FROM c UNION ALL SELECT doc_id, page_no, n, role, 2, 0 FROM c WHERE page_no = 1),
    o AS (SELECT *, {_RN.format('s, pos')} AS out_page FROM p)
    SELECT doc_id, out_page AS page_no, page_no AS src_page, role, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY out_page) - 1 AS INTEGER) AS instance_num FROM o""")
def pg_cat_repeat(spark, d):
    return pages.cat(conversation_pages(spark, d), ["1-end", "end-1", "1"]).select("doc_id", "page_no", "src_page", "role", "instance_num")


def _sets(spark, d) -> DataFrame:
    rows = conversation_pages(spark, d)
    return rows.withColumn("set_id", F.expr("doc_id div 2")).withColumn("handle", F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B"))


@query(f"""WITH {C}, p AS (SELECT doc_id // 2 AS set_id, doc_id, page_no, n, role, CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END AS s, CASE WHEN doc_id % 2 = 1 THEN page_no ELSE n - page_no END AS pos FROM c)
    SELECT set_id, doc_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY s, pos, doc_id) AS INTEGER) AS page_no, page_no AS src_page, role FROM p""")
def pg_cat_multi_handle(spark, d):
    out = pages.cat(_sets(spark, d), ["B", "Aend-1"], by=("set_id",), handles={"A": 0, "B": 1})
    return out.select("set_id", "doc_id", "page_no", "src_page", "role")


@query(f"""WITH {C} SELECT doc_id // 2 AS set_id, doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 2 ORDER BY page_no, doc_id % 2) AS INTEGER) AS page_no, page_no AS src_page, role FROM c""")
def pg_shuffle_two(spark, d):
    return pages.shuffle(_sets(spark, d), ["A", "B"], by=("set_id",), handles={"A": 0, "B": 1}).select("set_id", "doc_id", "page_no", "src_page", "role")


@query(f"""WITH {C}, p AS (SELECT doc_id, page_no, page_no AS pos, 0 AS s, role FROM c UNION ALL SELECT doc_id, page_no, n - page_no + 1, 1, role FROM c UNION ALL SELECT doc_id, page_no, page_no // 2, 2, role FROM c WHERE page_no % 2 = 0)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, s) AS INTEGER) AS page_no, page_no AS src_page, role FROM p""")
def pg_shuffle_uneven(spark, d):
    return pages.shuffle(conversation_pages(spark, d), ["1-end", "end-1", "even"]).select("doc_id", "page_no", "src_page", "role")


@query(f"WITH {C} SELECT doc_id, {_RN.format('page_no')} AS page_no, role, content FROM c WHERE NOT (page_no BETWEEN 2 AND 3) AND NOT (page_no = n AND n % 2 = 1)")
def pg_delete_spec(spark, d):
    return pages.delete(conversation_pages(spark, d), ["2-3", "r1odd"]).select("doc_id", "page_no", "role", "content")


@query(f"WITH {C} SELECT doc_id, {_RN.format('page_no')} AS page_no, role FROM c WHERE page_no > n - 2")
def pg_keep_last(spark, d):
    return pages.delete(conversation_pages(spark, d), ["1-end~r2-r1"]).select("doc_id", "page_no", "role")


@query(f"WITH {C} SELECT doc_id, page_no, role FROM c WHERE page_no <= 2")
def pg_first(spark, d):
    return pages.select_first(conversation_pages(spark, d), 2).select("doc_id", "page_no", "role")


@query(f"""WITH {C}, m AS (SELECT *, page_no % 2 = 0 AS src, CASE WHEN n >= 3 THEN least(3, n) ELSE NULL END AS a FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN src THEN 1 WHEN page_no < 1 THEN 0 ELSE 2 END, page_no) AS INTEGER) AS page_no, role, content FROM m""")
def pg_move_before(spark, d):
    return pages.move(conversation_pages(spark, d), "even", "before", "1").select("doc_id", "page_no", "role", "content")


@query(f"""WITH {C} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page_no = 1 THEN 1 WHEN page_no < n + 1 THEN 0 ELSE 2 END, page_no) AS INTEGER) AS page_no, role, content FROM c""")
def pg_move_after(spark, d):
    return pages.move(conversation_pages(spark, d), "1", "after", "end").select("doc_id", "page_no", "role", "content")


@query(f"""WITH {L}, p AS (SELECT doc_id, page_no AS pos, 1 AS side, 0 AS copy, width, height, false AS is_blank FROM l UNION ALL SELECT doc_id, page_no, 2, k, 595.0, 842.0, true FROM l, range(1, 3) r(k) WHERE page_no % 2 = 1)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, side, copy) AS INTEGER) AS page_no, width, height, is_blank FROM p""")
def pg_insert_blank(spark, d):
    return pages.insert(lineitem_pages(spark, d), 2, "after", "odd", (595, 842)).select("doc_id", "page_no", "width", "height", "is_blank")


@query(f"""WITH {L}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS o FROM l),
    m AS (SELECT doc_id, page_no - 1 AS m, width, height, least(n, 2) AS k FROM l WHERE page_no <= 2),
    p AS (SELECT doc_id, page_no AS pos, 1 AS side, width, height, false AS is_blank FROM l UNION ALL SELECT t.doc_id, t.page_no, 0, m.width, m.height, true FROM t JOIN m ON t.doc_id = m.doc_id AND m.m = t.o % m.k)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, side) AS INTEGER) AS page_no, width, height, is_blank FROM p""")
def pg_insert_model(spark, d):
    return pages.insert(lineitem_pages(spark, d), 1, "before", "1-end", model="1-2").select("doc_id", "page_no", "width", "height", "is_blank")


@query(f"WITH {C} SELECT doc_id, page_no, printf('pg_%06d.pdf', row_number() OVER (ORDER BY doc_id, page_no)) AS file_name FROM c")
def pg_burst_names(spark, d):
    return pages.burst(conversation_pages(spark, d), "pg_%06d.pdf").select("doc_id", "page_no", "file_name")


@query(f"""WITH {L}, a AS (SELECT *, CASE WHEN page_no % 2 = 0 THEN (rotation + 90) % 360 ELSE rotation END AS r1 FROM l)
    SELECT doc_id, page_no, CAST(CASE WHEN page_no = n THEN 180 WHEN page_no BETWEEN 2 AND n AND n >= 2 THEN (r1 + 270) % 360 WHEN n = 1 AND page_no BETWEEN 1 AND 2 THEN (r1 + 270) % 360 ELSE r1 END AS INTEGER) AS rotation FROM a""")
def pg_rotate_accumulate(spark, d):
    return pages.rotate(lineitem_pages(spark, d), ["evenright", "2-endleft", "endsouth"]).select("doc_id", "page_no", "rotation")


@query(f"""WITH {L} SELECT doc_id, page_no, round(width * f, 6) + 0.0 AS width, round(height * f, 6) + 0.0 AS height
    FROM (SELECT *, CASE WHEN page_no % 2 = 1 THEN 1.5 * pow(sqrt(CAST(2 AS DOUBLE)), -1) ELSE CAST(1 AS DOUBLE) END AS f FROM l)""")
def pg_scale_zoom(spark, d):
    return _six(pages.rotate(lineitem_pages(spark, d), ["oddx1.5z-1"]).select("doc_id", "page_no", "width", "height"), "width", "height")


# ---- geometry

_BOX = "round({}, 6) + 0.0 AS x0, round({}, 6) + 0.0 AS y0, round({}, 6) + 0.0 AS x1, round({}, 6) + 0.0 AS y1"


@query(f"""WITH {L}, a AS (SELECT *, page_no % 2 = 0 AS e, page_no = 1 AS f FROM l),
    b AS (SELECT *, CASE WHEN f THEN 10.0 WHEN e THEN 1.0 ELSE 0.0 END AS le, CASE WHEN f THEN height * CAST(0.1 AS DOUBLE) WHEN e THEN CAST(72 AS DOUBLE) * 0.05 ELSE 0.0 END AS t, CASE WHEN f THEN 10.0 WHEN e THEN 1.0 ELSE 0.0 END AS r, CASE WHEN f THEN 5.0 WHEN e THEN CAST(72 AS DOUBLE) * 0.05 ELSE 0.0 END AS bo FROM a),
    k AS (SELECT *, width - r > le AND height - t > bo AS ok FROM b)
    SELECT doc_id, page_no, {_BOX.format('CASE WHEN ok THEN le ELSE 0.0 END', 'CASE WHEN ok THEN bo ELSE 0.0 END', 'CASE WHEN ok THEN width - r ELSE width END', 'CASE WHEN ok THEN height - t ELSE height END')} FROM k""")
def geo_crop_margin(spark, d):
    return _six(geometry.crop(lineitem_pages(spark, d), ["even(1,0.05in)", "1(10,10%,10,5pt)"]).select("doc_id", "page_no", *geometry.BOX), *geometry.BOX)


@query(f"""WITH {L} SELECT doc_id, page_no, {_BOX.format('(width - 420) / 2', '(height - 595) / 2', 'width - (width - 420) / 2', 'height - (height - 595) / 2')} FROM l""")
def geo_crop_paper(spark, d):
    return _six(geometry.crop(lineitem_pages(spark, d), ["(a5)"]).select("doc_id", "page_no", *geometry.BOX), *geometry.BOX)


@query(f"""WITH {L}, g AS (SELECT *, page_no >= 2 AND n >= 2 OR n = 1 AS hit FROM l)
    SELECT doc_id, page_no, {_BOX.format('CASE WHEN hit THEN -2.0 ELSE 0.0 END', 'CASE WHEN hit THEN -2.0 ELSE 0.0 END', 'CASE WHEN hit THEN max(width) FILTER (hit) OVER (PARTITION BY doc_id) + 2 ELSE width END', 'CASE WHEN hit THEN max(height) FILTER (hit) OVER (PARTITION BY doc_id) + 2 ELSE height END')} FROM g""")
def geo_fit_group(spark, d):
    return _six(geometry.fit_group(lineitem_pages(spark, d), "2-end", 2.0).select("doc_id", "page_no", *geometry.BOX), *geometry.BOX)


@query(f"""WITH {L}, p AS (SELECT l.*, k FROM l, range(1, 4) r(k))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, k) AS INTEGER) AS page_no, page_no AS src_page, CAST(k AS INTEGER) AS piece, round((k - 1) * (width / 3), 6) AS origin_x, round(width / 3, 6) AS x1, round(height, 6) AS y1 FROM p""")
def geo_chop_cols(spark, d):
    return _six(geometry.chop(lineitem_pages(spark, d), ["cols3"]).select("doc_id", "page_no", "src_page", "piece", "origin_x", "x1", "y1"), "origin_x", "x1", "y1")


@query(f"""WITH {L}, p AS (SELECT l.*, k, 1.0 AS a, height * CAST(0.25 AS DOUBLE) AS b, (height - (1.0 + height * CAST(0.25 AS DOUBLE))) / 1 AS f FROM l, range(0, 3) r(k) WHERE page_no % 2 = 1 AND k <> 1 OR page_no % 2 = 0 AND k = 0)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, k) AS INTEGER) AS page_no, CAST(CASE WHEN page_no % 2 = 0 THEN 0 ELSE k + 1 END AS INTEGER) AS piece,
           round(CASE WHEN page_no % 2 = 0 THEN 0.0 WHEN k = 0 THEN height - a ELSE height - a - b - f END, 6) + 0.0 AS origin_y, round(CASE WHEN page_no % 2 = 0 THEN height WHEN k = 0 THEN a ELSE f END, 6) AS y1 FROM p""")
def geo_chop_fill(spark, d):
    return _six(geometry.chop(lineitem_pages(spark, d), ["oddrows(1,25%d,fill)"]).select("doc_id", "page_no", "piece", "origin_y", "y1"), "origin_y", "y1")


_PLACE = "m_a", "m_b", "m_c", "m_d", "m_e", "m_f"


@query(f"""WITH {L} SELECT doc_id, page_no, CAST(CASE WHEN e THEN 2 ELSE 1 END AS DOUBLE) AS m_a, CAST(0 AS DOUBLE) AS m_b, CAST(0 AS DOUBLE) AS m_c, CAST(CASE WHEN e THEN 2 ELSE 1 END AS DOUBLE) AS m_d,
    round(CASE WHEN e THEN 20 - width / 2 ELSE 0 END, 6) + 0.0 AS m_e, round(CASE WHEN e THEN height * CAST(0.1 AS DOUBLE) * 2 - height / 2 ELSE 0 END, 6) + 0.0 AS m_f FROM (SELECT *, page_no % 2 = 0 AS e FROM l)""")
def geo_place_shift_scale(spark, d):
    return _six(geometry.place(lineitem_pages(spark, d), ["even(shift=10,10%;scale=2:center)"]).select("doc_id", "page_no", *_PLACE), *_PLACE)


@query(f"""WITH {L}, t AS (SELECT *, cos(radians(30)) AS c, sin(radians(30)) AS s FROM l)
    SELECT doc_id, page_no, round(least(0, -height * s), 6) + 0.0 AS bx0, round(0.0, 6) AS by0, round(width * c, 6) + 0.0 AS bx1, round(width * s + height * c, 6) + 0.0 AS by1 FROM t""")
def geo_place_aabb(spark, d):
    names = ("bx0", "by0", "bx1", "by1")
    return _six(geometry.place(lineitem_pages(spark, d), ["(spin=30:0,0)"]).select("doc_id", "page_no", *names), *names)


@query(f"""WITH {L}, m AS (SELECT *, page_no % 2 = 0 AS e FROM l)
    SELECT doc_id, page_no, CAST(CASE WHEN e THEN 2 ELSE 1 END AS DOUBLE) AS m_a, CAST(CASE WHEN e THEN 20 ELSE 10 END AS DOUBLE) AS m_e FROM m""")
def geo_place_rules_add_up(spark, d):
    return _six(geometry.place(lineitem_pages(spark, d), ["(shift=10,0)", "even(scale=2:0,0)"]).select("doc_id", "page_no", "m_a", "m_e"), "m_a", "m_e")


def _over(spark, d, n: int) -> DataFrame:
    return _read(spark, d, "region").filter(f"r_regionkey < {n}").select((F.col("r_regionkey") + 1).cast("int").alias("over_page"), (F.lit(100.0) + 10 * F.col("r_regionkey")).alias("ow"), F.lit(210.0).alias("oh"))


_OV = "round(least(width / ow, height / oh), 6) AS fit, round((width - ow * least(width / ow, height / oh)) / 2, 6) + 0.0 AS dx, round((height - oh * least(width / ow, height / oh)) / 2, 6) + 0.0 AS dy"


def _ov_sql(join: str, z: int) -> str:
    return f"WITH {L}, o AS (SELECT CAST(r_regionkey + 1 AS INTEGER) AS over_page, CAST(100 + 10 * r_regionkey AS DOUBLE) AS ow, CAST(210 AS DOUBLE) AS oh FROM region WHERE r_regionkey < 3) SELECT doc_id, page_no, over_page, CAST({z} AS INTEGER) AS z_order, {_OV} FROM l JOIN o ON {join}"


def _overlaid(spark, d, multi: bool, top: bool) -> DataFrame:
    out = geometry.overlay(lineitem_pages(spark, d), _over(spark, d, 3), multi, top)
    return _six(out.select("doc_id", "page_no", "over_page", "z_order", "fit", "dx", "dy"), "fit", "dx", "dy")


@query(_ov_sql("over_page = 1", 1))
def ov_stamp(spark, d):
    return _overlaid(spark, d, False, True)


@query(_ov_sql("over_page = least(page_no, 3)", 1))
def ov_multistamp(spark, d):
    return _overlaid(spark, d, True, True)


@query(_ov_sql("over_page = 1", -1))
def ov_background(spark, d):
    return _overlaid(spark, d, False, False)


@query(_ov_sql("over_page = least(page_no, 3)", -1))
def ov_multibackground(spark, d):
    return _overlaid(spark, d, True, False)


@query(f"WITH {L} SELECT doc_id, page_no, printf('page_%d.png', page_no) AS file_name, CAST(ceil(width * (CAST(150 AS DOUBLE) / 72)) AS INTEGER) AS px_width, CAST(ceil(height * (CAST(150 AS DOUBLE) / 72)) AS INTEGER) AS px_height FROM l")
def render_sizes(spark, d):
    return relations.render(lineitem_pages(spark, d))


# ---- metadata


def _docinfo(spark, d, lines: bool = False) -> DataFrame:
    """Three entries an order; for lines of a document in order, orders are dealt out before entries and lines are made of them."""
    orders = _read(spark, d, "orders")
    return info.unpivot(pages.dealt(pages.in_shares(orders), "o_orderkey", times=9) if lines else orders, "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])


_DI = "di AS (SELECT o_orderkey AS doc_id, k AS key, v AS value FROM (SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey']) AS k, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) AS v FROM orders) WHERE v IS NOT NULL)"


@query(f"WITH {_DI} SELECT * FROM di")
def info_docinfo_unpivot(spark, d):
    return _docinfo(spark, d)


@query(f"""WITH {_DI}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY key) AS INTEGER) AS seq FROM di)
    SELECT doc_id, CAST(1 AS INTEGER) AS section, seq, CAST(k AS INTEGER) AS line_no, CASE k WHEN 0 THEN 'InfoBegin' WHEN 1 THEN 'InfoKey: ' || key ELSE 'InfoValue: ' || value END AS line FROM s, range(0, 3) r(k)
    UNION ALL SELECT l_orderkey, 3, 1, 0, 'NumberOfPages: ' || count(*) FROM lineitem GROUP BY l_orderkey""")
def info_stanza_lines(spark, d):
    return info.dump_data(_docinfo(spark, d, lines=True), lineitem_pages(spark, d).select("doc_id", "page_no"))


@query(f"WITH {_DI} SELECT doc_id, '[' || string_agg('{{\"key\":' || to_json(key) || ',\"value\":' || to_json(value) || '}}', ',' ORDER BY key) || ']' AS info FROM di GROUP BY doc_id")
def info_json(spark, d):
    return info.dump_json(_docinfo(spark, d))


@query(f"""WITH {_DI}, n AS (SELECT o_orderkey AS doc_id, 'o_orderstatus' AS key, lower(o_orderstatus) AS value FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'added', 'yes' FROM orders WHERE o_orderkey % 5 = 0)
    SELECT doc_id, key, CASE WHEN n.key IS NOT NULL THEN n.value ELSE di.value END AS value FROM di FULL JOIN n USING (doc_id, key)""")
def info_update_upsert(spark, d):
    orders = _read(spark, d, "orders")
    new = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("o_orderstatus").alias("key"), F.lower("o_orderstatus").alias("value"))
    new = new.unionByName(orders.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("added").alias("key"), F.lit("yes").alias("value")))
    return info.update_docinfo(_docinfo(spark, d), new)


@query(f"""WITH {_DI} SELECT doc_id, key, value FROM di""")
def info_stanza_round_trip(spark, d):
    rows = info.docinfo_lines(_docinfo(spark, d, lines=True)).withColumn("line_no", F.col("seq") * 10 + F.col("line_no"))
    read = info.read_stanzas(rows.select("doc_id", "line_no", "line"))
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    return read.groupBy("doc_id", "record").agg(value("Key").alias("key"), value("Value").alias("value")).drop("record")


@query(f"""WITH {C}, m AS (SELECT *, last_value(CASE WHEN role = 'user' THEN page_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no) AS i FROM c)
    SELECT doc_id, page_no, CASE WHEN i IS NULL THEN CAST(page_no AS VARCHAR) ELSE 'u-' || CAST(page_no - i + 5 AS VARCHAR) END AS label FROM m""")
def info_page_labels(spark, d):
    rows = conversation_pages(spark, d)
    labels = rows.filter("role = 'user'").select("doc_id", F.col("page_no").alias("new_index"), F.lit(5).alias("start"), F.lit("u-").alias("prefix"), F.lit("DecimalArabicNumerals").alias("num_style"))
    return info.label_pages(rows, labels).select("doc_id", "page_no", "label")


@query(f"""WITH {L} SELECT doc_id, page_no, format('{{:,}}', CAST(floor(height) AS BIGINT)) || CASE WHEN height = floor(height) THEN '' ELSE regexp_extract(CAST(height AS VARCHAR), '[.][0-9]+$') END AS h FROM l""")
def info_number_text(spark, d):
    return lineitem_pages(spark, d).select("doc_id", "page_no", T.number_text(F.col("height")).alias("h"))


_LINES = """doc_id, CAST(section AS INTEGER) AS section, CAST(seq AS INTEGER) AS seq, CAST(line_no AS INTEGER) AS line_no, line"""


@query(f"""WITH {L}, s AS (SELECT 2 AS section, 1 AS seq, k AS line_no, o_orderkey AS doc_id, 'PdfID' || k || ': ' || md5(CAST(o_orderkey + k AS VARCHAR)) AS line FROM orders, range(0, 2) r(k)
        UNION ALL SELECT 3, 1, 0, doc_id, 'NumberOfPages: ' || n FROM (SELECT DISTINCT doc_id, n FROM l)
        UNION ALL SELECT 4, page_no, k, doc_id, CASE k WHEN 0 THEN 'BookmarkBegin' WHEN 1 THEN 'BookmarkTitle: &lt;' || line || '&gt;' WHEN 2 THEN 'BookmarkLevel: 1' ELSE 'BookmarkPageNumber: ' || page_no END FROM l, range(0, 4) r(k)
        UNION ALL SELECT 5, page_no, k, doc_id, CASE k WHEN 0 THEN 'PageMediaBegin' WHEN 1 THEN 'PageMediaNumber: ' || page_no WHEN 2 THEN 'PageMediaRotation: ' || rotation
            WHEN 3 THEN 'PageMediaRect: 0 0 ' || CAST(width AS INTEGER) || ' ' || CAST(2 * line AS INTEGER) WHEN 4 THEN 'PageMediaDimensions: ' || CAST(width AS INTEGER) || ' ' || CAST(2 * line AS INTEGER) ELSE 'PageMediaCropRect: 1 0 ' || CAST(width AS INTEGER) || ' ' || CAST(2 * line AS INTEGER) END
            FROM l, range(0, 6) r(k) WHERE k < 5 OR page_no = 1
        UNION ALL SELECT 6, 1, k, doc_id, CASE k WHEN 0 THEN 'PageLabelBegin' WHEN 1 THEN 'PageLabelNewIndex: 1' WHEN 2 THEN 'PageLabelStart: 3' ELSE 'PageLabelNumStyle: NoNumber' END FROM (SELECT DISTINCT doc_id FROM l), range(0, 4) r(k))
    SELECT {_LINES} FROM s""")
def info_dump_data(spark, d):
    rows = lineitem_pages(spark, d).withColumn("y1", (2 * F.col("line")).cast("double"))
    first = F.col("page_no") == 1
    rows = rows.withColumns({f"crop_{c}": F.when(first, F.col(c) + (1 if c == "x0" else 0)).otherwise(F.col(c)) for c in geometry.BOX})
    ids = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("id0"), F.md5((F.col("o_orderkey") + 1).cast("string").cast("binary")).alias("id1"))
    marks = rows.select("doc_id", F.col("page_no").alias("seq"), F.concat(F.lit("<"), F.col("line").cast("string"), F.lit(">")).alias("title"), F.lit(1).alias("level"), "page_no")
    labels = rows.select("doc_id").distinct().select("doc_id", F.lit(1).alias("new_index"), F.lit(3).alias("start"), F.lit("").alias("prefix"), F.lit("NoNumber").alias("num_style"))
    out = stages.run(stages.parse(["in", "dump_data"]), {"in": Bundle({"documents": ids, "pages": rows, "outlines": marks, "page_labels": labels})}).report
    return out.select("doc_id", "section", "seq", "line_no", "line")


# ---- annotations, destinations, links

_HREF = "x AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS uri, CAST(generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS INTEGER) AS annot_idx FROM pages)"


def _annots(spark, d) -> DataFrame:
    return relations.links_of(_read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), "html"))


@query(f"WITH {_HREF} SELECT doc_id, CAST(1 AS INTEGER) AS page_no, annot_idx, uri, 'Link' AS subtype FROM x")
def an_dump_links(spark, d):
    return _annots(spark, d)


@query(f"WITH {_HREF} SELECT doc_id, CAST(1 AS INTEGER) AS page_no, annot_idx, 'AnnotSubtype: Link' || chr(10) || 'AnnotRect: 0 ' || annot_idx || ' 10.5 ' || (annot_idx + 8) || chr(10) || 'AnnotPageNumber: 1' AS block FROM x UNION ALL SELECT page_id, 0, 0, 'NumberOfPages: 1' FROM pages")
def an_report(spark, d):
    at = F.col("annot_idx").cast("double")
    annots = _annots(spark, d).withColumns({"ax0": F.lit(0.0), "ay0": at, "ax1": F.lit(10.5), "ay1": at + 8})
    own = _read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"))
    return stages.run(stages.parse(["in", "dump_data_annots"]), {"in": Bundle({"annots": annots, "pages": own})}).report


@query("SELECT event_id AS doc_id, event_type AS subtype, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'")
def an_filter_subtype(spark, d):
    rows = _read(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("subtype"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return relations.of_subtype(rows, "click")


def _event_annots(spark, d) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.row_number().over(order).alias("page_no"), F.col("event_type").alias("subtype"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("id"), F.col("event_id").cast("string")).alias("props"))
    return rows, rows.select("doc_id", "page_no")


_EV = "e AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS page_no, CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS n, event_type AS subtype, json_extract_string(props, '$.k') AS k, CAST(event_id AS VARCHAR) AS id FROM events)"


@query(f"WITH {_EV} SELECT doc_id, page_no, subtype, CASE WHEN page_no % 2 = 1 AND subtype = 'click' THEN NULL ELSE k END AS k, CASE WHEN page_no = n THEN 'last' END AS mark FROM e")
def an_modify_set(spark, d):
    rows, at = _event_annots(spark, d)
    out = relations.modify_annots(rows, ["odd/click(k=null)", "end(mark=(last))"], at)
    return out.select("doc_id", "page_no", "subtype", F.try_element_at("props", F.lit("k")).alias("k"), F.try_element_at("props", F.lit("mark")).alias("mark"))


@query(f"WITH {_EV} SELECT doc_id, page_no, subtype FROM e WHERE NOT (page_no % 2 = 0) AND page_no <> n")
def an_delete(spark, d):
    rows, at = _event_annots(spark, d)
    return relations.delete_annots(rows, "even,end", at).select("doc_id", "page_no", "subtype")


@query("""WITH d AS (SELECT p_size AS doc_id, p_brand AS name, max(p_partkey) AS dest_page FROM part GROUP BY ALL)
    SELECT p_size AS doc_id, p_partkey AS link, dest_page FROM part p LEFT JOIN d ON p.p_size = d.doc_id AND d.name = CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_brand END""")
def dest_resolve(spark, d):
    rows = _read(spark, d, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("page_no"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq"))
    links = rows.select("doc_id", F.col("page_no").alias("link"), F.when(F.col("page_no") % 3 == 0, "none").otherwise(F.col("name")).alias("action_dest"))
    return relations.resolve(links, rows).select("doc_id", "link", "dest_page")


@query("SELECT p_size AS doc_id, p_partkey AS link, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'remap' WHEN 2 THEN 'copy' ELSE 'copy_and_warn' END AS handling FROM part")
def an_dispatch(spark, d):
    at = F.col("p_partkey") % 4
    kind = F.when(at == 1, "GoTo").when(at == 2, "URI").when(at == 3, F.when(F.col("p_size") % 2 == 0, "JavaScript").otherwise("Unheard"))
    rows = _read(spark, d, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("link"), kind.alias("action_type"))
    return repair.dispatch(rows).select("doc_id", "link", "handling")


_TWICE = f"""{C}, p AS (SELECT doc_id, page_no, n, 0 AS s FROM c UNION ALL SELECT doc_id, page_no, n, 1 FROM c WHERE page_no = 1 OR page_no = n AND n > 1),
    o AS (SELECT doc_id, page_no AS src_page, {_RN.format('s, page_no')} AS out_page, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY s) - 1 AS INTEGER) AS instance_num FROM p)"""


def _twice(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = conversation_pages(spark, d)
    return rows, pages.plan(pages.documents_of(rows), pages._specs(["1-end", "1", "end~1"]))


@query(f"""WITH {_TWICE}, r AS (SELECT doc_id, max(instance_num) > 0 AS r FROM o GROUP BY doc_id)
    SELECT doc_id, out_page, CASE WHEN r THEN CAST(instance_num AS VARCHAR) || '-d' || src_page ELSE 'd' || src_page END AS new_name FROM o JOIN r USING (doc_id)""")
def dest_remap_rename(spark, d):
    rows, chosen = _twice(spark, d)
    dests = rows.select("doc_id", "page_no", F.concat(F.lit("d"), F.col("page_no").cast("string")).alias("name"))
    return repair.rename_dests(dests, chosen).select("doc_id", "out_page", "new_name")


@query(f"""WITH {_TWICE}, k AS (SELECT doc_id, page_no, CASE WHEN page_no = n THEN 1 ELSE page_no + 1 END AS t FROM c)
    SELECT k.doc_id, a.out_page, k.t AS target_page, b.out_page AS out_target, b.out_page IS NULL AS broken FROM k JOIN o a ON a.doc_id = k.doc_id AND a.src_page = k.page_no LEFT JOIN o b ON b.doc_id = k.doc_id AND b.src_page = k.t AND b.instance_num = a.instance_num""")
def link_broken_report(spark, d):
    rows, chosen = _twice(spark, d)
    links = pages.with_total(rows).select("doc_id", "page_no", F.lit(0).alias("annot_idx"), F.when(F.col("page_no") == F.col("n_pages"), 1).otherwise(F.col("page_no") + 1).alias("target_page"))
    return repair.remap_links(links, chosen).select("doc_id", "out_page", "target_page", "out_target", "broken")


def _followed(spark, d, *words: str) -> Bundle:
    """A command over documents whose every page has a link to the next page, a destination, a bookmark and a field; inputs: in and again."""
    rows = pages.with_total(conversation_pages(spark, d))
    name = lambda x: F.concat(F.lit(x), F.col("page_no").cast("string"))
    bundle = Bundle({
        "pages": rows.drop("n_pages"),
        "annots": rows.select("doc_id", "page_no", F.lit(0).alias("annot_idx"), F.when(F.col("page_no") < F.col("n_pages"), F.col("page_no") + 1).otherwise(1).alias("target_page")),
        "dests": rows.select("doc_id", name("d").alias("name"), "page_no"),
        "outlines": rows.select("doc_id", F.col("page_no").alias("seq"), (2 - F.col("page_no") % 2).alias("level"), "page_no"),
        "fields": rows.select("doc_id", name("f").alias("fq_name"), "page_no"),
    })
    return stages.run(stages.parse(words), {"in": bundle, "again": bundle})


def _referring(out: Bundle) -> DataFrame:
    """Everything that refers to pages, in one shape."""
    return (
        out["annots"].select("doc_id", F.lit("link").alias("kind"), "page_no", F.coalesce(F.col("target_page").cast("string"), F.lit("broken")).alias("value"))
        .unionByName(out["dests"].select("doc_id", F.lit("dest").alias("kind"), "page_no", F.col("name").alias("value")))
        .unionByName(out["outlines"].select("doc_id", F.lit("mark").alias("kind"), "page_no", F.col("seq").cast("string").alias("value")))
        .unionByName(out["fields"].select("doc_id", F.lit("field").alias("kind"), "page_no", F.col("fq_name").alias("value")))
    )


@query(f"""WITH {C}, p AS (SELECT doc_id, page_no, n, 0 AS s FROM c WHERE page_no % 2 = 0 OR page_no = n UNION ALL SELECT doc_id, page_no, n, 1 FROM c WHERE page_no = n),
    o AS (SELECT doc_id, page_no AS src, n, {_RN.format('s, page_no')} AS out_page, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY s) - 1 AS INTEGER) AS i FROM p)
    SELECT a.doc_id, 'link' AS kind, a.out_page AS page_no, coalesce(CAST(b.out_page AS VARCHAR), 'broken') AS value FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.i = a.i AND b.src = CASE WHEN a.src < a.n THEN a.src + 1 ELSE 1 END
    UNION ALL SELECT doc_id, 'dest', out_page, i || '-d' || src FROM o
    UNION ALL SELECT doc_id, 'mark', out_page, CAST(src AS VARCHAR) FROM o WHERE i = 0
    UNION ALL SELECT doc_id, 'mark', out_page, CAST(src + n + 1 AS VARCHAR) FROM o WHERE i = 1
    UNION ALL SELECT c.doc_id, 'mark', NULL, CAST(c.page_no AS VARCHAR) FROM c WHERE page_no % 2 = 1 AND page_no <> n
    UNION ALL SELECT c.doc_id, 'mark', NULL, CAST(n - 1 + n + 1 AS VARCHAR) FROM c WHERE page_no = n AND n % 2 = 0
    UNION ALL SELECT doc_id, 'field', out_page, 'f' || src || CASE WHEN i > 0 THEN '_' || i ELSE '' END FROM o""")
def repair_after_cat(spark, d):
    return _referring(_followed(spark, d, "in", "cat", "1-endeven~end", "end", "end"))


@query(f"""WITH {C}, o AS (SELECT doc_id, page_no AS src, page_no AS out_page, n, 1 AS i FROM c UNION ALL SELECT doc_id, 1, n + 1, n, 0 FROM c WHERE page_no = 1)
    SELECT a.doc_id, 'link' AS kind, a.out_page AS page_no, coalesce(CAST(b.out_page AS VARCHAR), 'broken') AS value FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.i = a.i AND b.src = CASE WHEN a.src < a.n THEN a.src + 1 ELSE 1 END
    UNION ALL SELECT doc_id, 'dest', out_page, i || '-0-d' || src FROM o
    UNION ALL SELECT doc_id, 'mark', out_page, CAST(CASE WHEN i = 1 THEN src ELSE src + n + 1 END AS VARCHAR) FROM o
    UNION ALL SELECT doc_id, 'field', out_page, 'f' || src FROM o""")
def repair_after_cat_two(spark, d):
    return _referring(_followed(spark, d, "A=in", "B=again", "cat", "B", "A1"))


@query(f"""WITH {C}, o AS (SELECT doc_id, page_no AS src, n, {_RN.format('page_no')} AS out_page FROM c WHERE page_no <> 2)
    SELECT a.doc_id, 'link' AS kind, a.out_page AS page_no, coalesce(CAST(b.out_page AS VARCHAR), 'broken') AS value FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.src = CASE WHEN a.src < a.n THEN a.src + 1 ELSE 1 END
    UNION ALL SELECT c.doc_id, 'dest', out_page, 'd' || page_no FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND src = page_no
    UNION ALL SELECT c.doc_id, 'mark', out_page, CAST(page_no AS VARCHAR) FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND src = page_no
    UNION ALL SELECT doc_id, 'field', out_page, 'f' || src FROM o""")
def repair_after_delete(spark, d):
    return _referring(_followed(spark, d, "in", "delete", "2"))


@query("SELECT p_name AS name, last_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page_no FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1")
def dest_last_wins(spark, d):
    rows = _read(spark, d, "part").select(F.lit(1).alias("doc_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("page_no"))
    return repair.last_by_name(rows, "page_no").select("name", "page_no")


@query(f"""WITH {L} SELECT doc_id, page_no, round(CASE rotation WHEN 90 THEN height - 7 WHEN 180 THEN width - 3 WHEN 270 THEN 7 ELSE 3 END, 6) + 0.0 AS x, round(CASE rotation WHEN 90 THEN 3 WHEN 180 THEN height - 7 WHEN 270 THEN width - 3 ELSE 7 END, 6) + 0.0 AS y FROM l""")
def dest_turn_point(spark, d):
    rows = lineitem_pages(spark, d).withColumn("px", F.lit(3.0)).withColumn("py", F.lit(7.0))
    x, y = repair.turn_point("px", "py", "width", "height", "rotation")
    return _six(rows.select("doc_id", "page_no", x.alias("x"), y.alias("y")), "x", "y")


# ---- outlines

_CH = f"""{L}, k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY page_no) AS b FROM l)
    SELECT doc_id, page_no, CAST(sum(CASE WHEN b IS NOT NULL AND line <> b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS chunk FROM k"""


@query(f"WITH {_CH}")
def out_chunks(spark, d):
    return repair.outline_chunks(lineitem_pages(spark, d), ["page_no"], page="line").select("doc_id", "page_no", "chunk")


def _tree(spark, d) -> DataFrame:
    r = _read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    n = _read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"))
    c = _read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("title"))
    return r.unionByName(n).unionByName(c)


_TR = "t AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"


@query(f"""WITH RECURSIVE {_TR}, w AS (SELECT node_id, 1 AS level, title AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, w.level + 1, w.path || '/' || t.title FROM t JOIN w ON t.parent_id = w.node_id)
    SELECT node_id, CAST(level AS INTEGER) AS level, path FROM w""")
def out_tree_levels(spark, d):
    return repair.tree_levels(_tree(spark, d), depth=3)


@query(f"""WITH RECURSIVE {_TR}, k AS (SELECT node_id FROM t WHERE node_id LIKE 'c%7' UNION SELECT t.parent_id FROM t JOIN k USING (node_id) WHERE t.parent_id IS NOT NULL) SELECT t.* FROM t WHERE node_id IN (SELECT node_id FROM k)""")
def out_prune(spark, d):
    nodes = _tree(spark, d)
    return repair.prune_outline(nodes, nodes.filter("node_id LIKE 'c%7'"), depth=3)


@query(f"""WITH {L}, k AS (SELECT doc_id, page_no AS seq, 1 + line % 3 AS level FROM l)
    SELECT a.doc_id, a.seq, CAST(a.level AS INTEGER) AS level, CAST(max(b.seq) AS INTEGER) AS parent_seq FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level = a.level - 1 GROUP BY ALL""")
def out_bookmark_parents(spark, d):
    rows = lineitem_pages(spark, d).select("doc_id", F.col("page_no").alias("seq"), (1 + F.col("line") % 3).cast("int").alias("level"), "page_no")
    return info.bookmark_tree(rows).select("doc_id", "seq", "level", "parent_seq")


# ---- forms


@query("""SELECT o_orderkey AS doc_id, o_orderpriority AS fq_name, CASE WHEN k THEN CASE WHEN v IN ('yes', 'on', 'true', '1') THEN 'Yes' ELSE 'Off' END ELSE o_orderstatus END AS value
    FROM orders LEFT JOIN (SELECT user_id, true AS k, lower(arg_max(CAST(event_id % 2 AS VARCHAR), event_id)) AS v FROM events GROUP BY user_id) e ON user_id = o_orderkey""")
def form_fill(spark, d):
    fields = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("fq_name"), F.lit("Checkbox").alias("type"), F.col("o_orderstatus").alias("value"))
    values = _read(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 2).cast("string").alias("value"), F.col("event_id").alias("seq"))
    values = values.join(fields.select("doc_id", "fq_name"), "doc_id")
    return relations.fill_form(fields, values).select("doc_id", "fq_name", "value")


@query(f"WITH {_TWICE} SELECT doc_id, out_page, CASE WHEN instance_num > 0 THEN 'f' || src_page || '_' || instance_num ELSE 'f' || src_page END AS fq_name FROM o")
def form_rename_clash(spark, d):
    _, chosen = _twice(spark, d)
    return repair.rename_fields(chosen.withColumn("fq_name", F.concat(F.lit("f"), F.col("src_page").cast("string")))).select("doc_id", "out_page", "fq_name")


@query("SELECT 'c' || c_custkey AS node_id, r_name || '.' || n_name || '.' || c_name AS fq_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def form_fqn(spark, d):
    nodes = _tree(spark, d).select(F.lit(1).alias("doc_id"), "node_id", "parent_id", F.col("title").alias("name"), F.col("node_id").startswith("c").alias("is_field"))
    return relations.field_tree(nodes, depth=2).select("node_id", "fq_name")


@query("SELECT o_orderkey AS doc_id, o_orderpriority || ' <é>' AS fq_name, 'FieldType: Text' || chr(10) || 'FieldName: ' || o_orderpriority || ' &lt;&#233;&gt;' || chr(10) || 'FieldFlags: 0' || chr(10) || 'FieldValue: ' || o_orderstatus || chr(10) || 'FieldJustification: Center' || chr(10) || 'FieldStateOption: a' || chr(10) || 'FieldStateOptionDisplay: A' AS block FROM orders")
def form_dump(spark, d):
    name = F.concat("o_orderpriority", F.lit(" <é>"))
    options = F.array(F.struct(F.lit("a").alias("export"), F.lit("A").alias("display")))
    fields = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), name.alias("fq_name"), F.lit("Text").alias("type"), F.col("o_orderstatus").alias("value"), F.lit(1).alias("justification"), options.alias("options"))
    return stages.run(stages.parse(["in", "dump_data_fields"]), {"in": Bundle({"fields": fields})}).report


@query("""SELECT o_orderkey AS doc_id, '%FDF-1.2' || chr(10) || '1 0 obj' || chr(10) || '<<' || chr(10) || '/FDF' || chr(10) || '<<' || chr(10) || '/Fields [' || chr(10) || '<<' || chr(10) || '/T (' || o_orderpriority || ')' || chr(10) || '/V (' || o_orderstatus || ')' || chr(10) || '>>' || chr(10) || ']' || chr(10)
    || '>>' || chr(10) || '>>' || chr(10) || 'endobj' || chr(10) || 'trailer' || chr(10) || chr(10) || '<<' || chr(10) || '/Root 1 0 R' || chr(10) || '>>' || chr(10) || '%%EOF' || chr(10) AS fdf FROM orders""")
def form_fdf(spark, d):
    return relations.generate_fdf(_read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("fq_name"), F.col("o_orderstatus").alias("value")))


# ---- layers and attachments


@query("SELECT d.doc_id, d.source AS name, CASE WHEN l.doc_id IS NULL THEN 'ON' ELSE 'OFF' END AS default_state FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)")
def layer_state(spark, d):
    layers = _read(spark, d, "documents").select("doc_id", F.lit(1).alias("obj_id"), F.col("source").alias("name"))
    off = _read(spark, d, "labels").filter("toxic = 1").select("doc_id", F.lit(1).alias("obj_id"))
    return relations.dump_layers(layers, off).select("doc_id", "name", "default_state")


@query("SELECT doc_id, source AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents")
def attach_sizes(spark, d):
    return relations.dump_files(_read(spark, d, "documents").select("doc_id", F.col("source").alias("name"), "text"), "text")


@query(f"""WITH {L}, p AS (SELECT doc_id, page_no, height, k, CASE k WHEN 0 THEN 'a.txt' ELSE 'b.txt' END AS name FROM l, range(0, 2) r(k) WHERE k = 0 OR page_no % 2 = 0)
    SELECT doc_id, page_no, name, CASE WHEN name = 'a.txt' THEN 'Data' END AS relationship, CAST(10 + 30 * (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY k) - 1) AS DOUBLE) AS "left", round(height - 10 - 30 * (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY k) - 1), 6) + 0.0 AS top FROM p""")
def attach_icons(spark, d):
    out = relations.attach_files(lineitem_pages(spark, d), [("a.txt", "1-end", "Data"), ("b.txt", "even", None)])
    return _six(out.select("doc_id", "page_no", "name", "relationship", "left", "top"), "left", "top")


# ---- content


@query("SELECT doc_id, regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g') AS content FROM documents")
def txt_replace_regex(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", F.lit(1).alias("page_no"), F.lit(1).alias("n_pages"), F.col("text").alias("content"))
    return content.replace(rows, r"-/([a-z])([A-Z])/\1 \2/").select("doc_id", "content")


@query("SELECT doc_id, regexp_replace(regexp_replace(content, 'e', 'E'), 'e', 'E') AS content, page_no FROM (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no, text AS content FROM conversations)")
def txt_replace_count(spark, d):
    return content.replace(conversation_pages(spark, d), "-/e/E/2").select("doc_id", "page_no", "content")


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no, regexp_replace(text, '^(.)', '<\\1>') AS content FROM conversations")
def txt_replace_anchored(spark, d):
    return content.replace(conversation_pages(spark, d), r"-/^(.)/<\1>/2").select("doc_id", "page_no", "content")


@query("""SELECT doc_id, regexp_replace(list_aggregate(list_transform(string_split(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'), ''),
    lambda ch: CASE WHEN unicode(ch) > 126 THEN '&#' || unicode(ch) || ';' ELSE ch END), 'string_agg', ''), '[\\x00-\\x09\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS text FROM documents""")
def txt_xml_encode(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.xml_encode(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x09\\x0B\\x0C\\x0E-\\x1F\\x{80}-\\x{9F}]', '', 'g') AS text FROM documents")
def txt_xml_round_trip(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.xml_decode(T.xml_encode(F.col("text"))).alias("text"))


@query("SELECT conv_id AS doc_id, string_agg(regexp_replace(coalesce(text, ''), '[\\x00-\\x09\\x0B\\x0C\\x0E-\\x1F\\x{80}-\\x{9F}]', '', 'g'), chr(10) || chr(12) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def txt_dump(spark, d):
    return content.dump_text(conversation_pages(spark, d))


@query(f"WITH {C} SELECT doc_id, page_no, printf('B-%06d of %d, %d left {{}}', page_no + 99, n, n - page_no) AS text FROM c")
def txt_bates(spark, d):
    rows = pages.with_total(conversation_pages(spark, d))
    return rows.select("doc_id", "page_no", content.template("B-{page+99:06d} of {total}, {total-page} left {{}}", rows.columns).alias("text"))


@query("SELECT doc_id, 'lang ' || lang || ': ' || coalesce(source, '') AS text FROM documents")
def txt_template_meta(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", F.create_map(F.lit("Lang"), "lang", F.lit("Source"), "source").alias("meta"))
    return rows.select("doc_id", content.template("lang {meta:Lang}: {meta:Source}", rows.columns).alias("text"))


@query(f"""WITH {C} SELECT doc_id, page_no, CASE WHEN page_no = n THEN 'H2 ' ELSE '' END || CASE WHEN page_no % 2 = 1 THEN 'H1 ' ELSE '' END || content || CASE WHEN page_no <= 2 AND n >= 2 OR n = 1 THEN ' T' ELSE '' END AS content FROM c""")
def txt_inject(spark, d):
    rules = [("odd", "head", "H1 "), ("1-2", "tail", " T"), ("end", "head", "H2 ")]
    return content.inject(conversation_pages(spark, d), rules).select("doc_id", "page_no", "content")


@query(f"""WITH {L}, t AS (SELECT *, 0 AS rule FROM l UNION ALL SELECT *, 1 FROM l WHERE page_no = n)
    SELECT doc_id, page_no, CAST(rule AS INTEGER) AS rule, CASE rule WHEN 0 THEN 'p' || page_no ELSE 'end' END AS text, round(CASE rule WHEN 0 THEN width ELSE width / 2 END, 6) AS x, round(CASE rule WHEN 0 THEN height - 12 ELSE 0 END, 6) + 0.0 AS y, CASE rule WHEN 0 THEN 'right' ELSE 'center' END AS align FROM t""")
def txt_add_text(spark, d):
    return _six(content.add_text(lineitem_pages(spark, d), [("", "p{page}", "top-right"), ("end", "end", "bottom-center")]), "x", "y")


@query(None)
def txt_normalize(spark, d):
    rows = conversation_pages(spark, d)
    return content.normalize(rows).select("doc_id", "page_no", "content")


# ---- several stages


@query(f"""WITH {L}, a AS (SELECT doc_id, {_RN.format('page_no DESC')} AS page_no, rotation, width, height FROM l)
    SELECT doc_id, page_no, CAST(CASE WHEN page_no % 2 = 0 THEN (rotation + 90) % 360 ELSE rotation END AS INTEGER) AS rotation, round(x, 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1 FROM
    (SELECT *, CASE WHEN width - 1 > 1 AND height - 1 > 1 THEN 1.0 ELSE 0.0 END AS x, CASE WHEN width - 1 > 1 AND height - 1 > 1 THEN width - 1 ELSE width END AS x1 FROM a)""")
def pipe_cat_rotate_crop(spark, d):
    rows = lineitem_pages(spark, d)
    out = stages.run(stages.parse(["in", "cat", "end-1", "---", "rotate", "evenright", "---", "crop", "(1)"]), {"in": Bundle({"pages": rows})})
    return _six(out["pages"].select("doc_id", "page_no", "rotation", "x0", "x1"), "x0", "x1")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every page from the second on but the last, if its number is even."""
    return pg_cat_even_omit(spark, d)
