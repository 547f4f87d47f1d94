"""Small parsers and text functions."""

import pytest
from pyspark.sql import functions as F

from quire.errors import InvalidArgument
from quire import registry
from quire.functions import text
from quire.functions.dimensions import PAPER, length, lengths, paper
from quire.operators import content, geometry, info, pages, relations, repair
from quire.registry import Bundle


def test_paper():
    assert len(PAPER) == 158 and paper("a10") == (73.0, 105.0) and paper("7x9") == (504.0, 648.0)
    assert paper("A4") == (595.0, 842.0) and paper("a4_l") == (842.0, 595.0) and paper("2x3") == (144.0, 216.0)
    with pytest.raises(InvalidArgument):
        paper("b17")


def test_split_escaped():
    assert text.split_escaped(r"a/b\/c/d", "/") == ["a", "b/c", "d"]


def test_errors(spark):
    df = spark.createDataFrame([(1, 1, "x")], "doc_id long, page_no int, content string")
    for bad in (
        lambda: length("5 ells"),
        lambda: length("5%"),
        lambda: pages.burst(df, "page"),
        lambda: pages.move(df, "1", "near", "2"),
        lambda: pages.insert(df, 0, "after", "1"),
        lambda: content.replace(df, "12"),
        lambda: content.replace(df, "a/b/"),
        lambda: content.template("{nothing}", df.columns),
        lambda: content.template("{page", df.columns),
        lambda: content.template("{page:?}", df.columns),
        lambda: content.inject(df, [("1", "middle", "x")]),
        lambda: geometry.chop(df.select("*", *(F.lit(1.0).alias(c) for c in geometry.BOX)), ["diagonals2"]),
        lambda: geometry.pieces("0", F.lit(1.0)),
        lambda: relations.optimize_images(quality=101),
    ):
        with pytest.raises(InvalidArgument):
            bad()


def test_lengths_and_numbers(spark):
    row = spark.range(1).select(
        length("2.54cm").alias("cm"), length("25.4mm").alias("mm"), length("1in").alias("inch"), length("10%", F.lit(50.0)).alias("part"), length("").alias("none"),
        text.number_text(F.lit(1234567.0)).alias("whole"), text.number_text(F.lit(1234.5)).alias("half"), text.number_text(F.lit(0.123456)).alias("long"),
        text.rectangle_text(F.lit(5.0), F.lit(9.0), F.lit(1.0), F.lit(2.5)).alias("box"),
        text.xml_decode(F.lit("&amp;lt; &#233;&#128512; &apos;")).alias("decoded"), text.xml_decode(F.lit("&#38;lt; & &x; &#9")).alias("once"),
        text.number_text(F.lit(-12345678.25)).alias("less"), text.number_text(F.lit(-0.0)).alias("zero"), text.short_number(F.lit(1234.56789)).alias("four"), text.short_number(F.lit(-7.0)).alias("seven"),
        text.compact_json(F.lit('{"a": [ 1,\n  2 ],\n "b": "x"}')).alias("json"),
    ).first()
    assert (round(row.cm, 9), round(row.mm, 9), row.inch, row.part, row.none) == (72, 72, 72, 5, 0)
    assert (row.whole, row.half, row.long, row.box) == ("1,234,567", "1,234.5", "0.123456", "1 2.5 5 9")
    assert row.decoded == "&lt; é😀 '" and row.once == "&lt; & &x; &#9"
    assert (row.less, row.zero, row.four, row.seven) == ("-12,345,678.25", "0", "1234.5679", "-7")
    assert row.json == '{"a": [1, 2], "b": "x"}'


def test_mojibake_and_nested_decoding(spark):
    df = spark.createDataFrame([(1, bytearray("é".encode())), (2, bytearray(b"\x93x")), (3, bytearray(b"\x81")), (4, None)], "i int, b binary")
    assert {r.i: r.b for r in text.fix_mojibake(df, "b").collect()} == {1: "é", 2: "“x", 3: "\x81", 4: None}
    df = spark.createDataFrame([(1, "x"), (2, "cafÃ©"), (3, "café"), (4, "日本"), (5, None), (6, "")], "i int, b string")
    got = {r.i: r.b for r in text.fix_mojibake(df, "b").collect()}
    assert [got[i] for i in range(1, 7)] == ["x", "café", "café", "日本", None, ""]
    df = spark.createDataFrame([("&lt;", ["&gt;"], {"k": "&amp;"}, 1)], "a string, b array<string>, c map<string,string>, d int")
    assert tuple(text.decode_all(df).first()) == ("<", [">"], {"k": "&"}, 1)


def test_selection_out_of_range_fails(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "doc_id long, page_no int, content string")
    with pytest.raises(Exception, match="out of range"):
        pages.cat(df, ["3"]).collect()
    assert pages.cat(df, ["3"], strict=False).count() == 0
    with pytest.raises(Exception, match="selects no page"):
        pages.move(df, "1", "after", "7").collect()
    assert [r.content for r in pages.move(df, "7", "after", "1").orderBy("page_no").collect()] == ["x", "y"]


def test_trees_are_walked_to_their_end(spark):
    """Nodes below the levels that are planned at once are there all the same; a cycle is an error."""
    rows = [(1, i, i - 1 if i else None, f"n{i}", i == 10) for i in range(11)] + [(1, 20, 0, "leaf", True)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, title string, is_field boolean").coalesce(1)
    assert {(r.node_id, r.level, r.path.count("/")) for r in repair.tree_levels(nodes, 4).collect()} == {*((i, i + 1, i) for i in range(11)), (20, 2, 1)}
    assert {r.node_id for r in repair.prune_outline(nodes, nodes.filter("node_id = 10"), 4).collect()} == set(range(11))
    found = relations.field_tree(nodes.withColumnRenamed("title", "name"), 3).collect()
    assert {r.fq_name for r in found} == {".".join(f"n{i}" for i in range(11)), "n0.leaf"}
    again = nodes.union(nodes.filter("node_id = 1").selectExpr("doc_id", "node_id", "10L", "title", "false"))
    with pytest.raises(InvalidArgument):
        repair.tree_levels(again, 4)
    assert repair.prune_outline(again, again.filter("node_id = 10"), 4).count() == 12


def brute_lines(text):
    """Instructions of a stream without comments and images, by a reader that goes character by character."""
    out, line, word, depth, inside = [], [], "", 0, False
    for c in text + " ":
        if inside:
            word += c
            inside = not (c == ")" and word.count("(") == word.count(")"))
            continue
        if c in " \n" or c in "([]":
            if word:
                line.append(word)
                if word[0].isalpha() and not depth:
                    out.append(" ".join(line))
                    line = []
                word = ""
            if c == "(":
                word, inside = c, True
            elif c in "[]":
                depth += 1 if c == "[" else -1
                line.append(c)
        else:
            word += c
    return "\n".join(out)


def test_normalize_keeps_strings_whole(spark):
    streams = ["q 1 0 0 1 5 5 cm (a (b (c)) d  e) Tj\n[(x y) 3 (())] TJ Q", "BT /F1 12 Tf (one) Tj ET", "", "1 2 m 3 4 l S"]
    df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate([*streams, None])], "doc_id long, page_no int, content string")
    got = {r.page_no: r.content for r in content.normalize(df).collect()}
    assert [got[i + 1] for i in range(4)] == [brute_lines(s) for s in streams] and got[5] is None
    assert content.normalized("<</K [1 true]>> BDC % gone\n(a\\)b) ' BI /W 1 ID \x01 Q( EI Q") == "<< /K [ 1 true ] >> BDC\n(a\\)b) '\nBI /W 1 ID \x01 Q( EI\nQ"
    assert content.normalized(content.normalized(streams[0])) == content.normalized(streams[0])


def test_replace_counts_in_context(spark):
    """A counted replacement sees the whole text: anchors hold once, look-around and word edges see what is before."""
    df = spark.createDataFrame([(1, 1, "aab ab a"), (1, 2, None)], "doc_id long, page_no int, content string")
    new = lambda spec: [r.content for r in content.replace(df, spec).orderBy("page_no").collect()]
    assert new("-/^a/X/2") == ["Xab ab a", None] and new(r"-/(?<=a)b/X/1") == ["aaX ab a", None]
    assert new(r"-/\ba/X/2") == ["Xab Xb a", None] and new(r"2/a/X/1") == ["aab ab a", None] and new(r"-/(a)(b)/\2\1/1") == ["aba ab a", None]
    assert [r.content for r in content.replace(df, "-/a/X/", normalize=True).orderBy("page_no").collect()] == ["XXb\nXb\nX", None]


def test_chop_and_place_grammar(spark):
    box = spark.createDataFrame([(1, i, 0.0, 0.0, 120.0, 60.0) for i in range(1, 7)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")

    def parts(*words):
        return [(r.src_page, r.piece, round(r.origin_x, 3), round(r.origin_y, 3), round(r.x1, 3), round(r.y1, 3)) for r in geometry.chop(box, words).filter("src_page in (1, 4)").orderBy("page_no").collect()]

    one, four = [(1, 0, 0, 0, 120, 60)], [(4, 0, 0, 0, 120, 60)]
    assert parts("1cols3") == [(1, k + 1, 40 * k, 0, 40, 60) for k in range(3)] + four
    assert parts("evencols(1:2)") == one + [(4, 1, 0, 0, 40, 60), (4, 2, 40, 0, 80, 60)]
    assert parts("even", "3-endrows") == one + [(4, 1, 0, 30, 120, 30), (4, 2, 0, 0, 120, 30)]
    assert parts("odd", "1-endrows(10,fill,10d)") == [(1, 1, 0, 50, 120, 10), (1, 2, 0, 10, 120, 40)] + four
    for bad in ("(diag 3)", "1-2", "odd"):
        with pytest.raises(InvalidArgument):
            geometry.chop(box, [bad])
    placed = geometry.place(box.limit(1), ["(shift=50%+1in,-2pt+10%)"]).first()
    assert (placed.m_e, placed.m_f) == (132.0, 4.0)
    row = spark.range(1).select(lengths("1in-2pt+50%", F.lit(10.0)).alias("a"), lengths("", F.lit(1.0)).alias("b")).first()
    assert (row.a, row.b) == (75.0, 0.0)
    with pytest.raises(InvalidArgument):
        geometry.overlay(box, spark.createDataFrame([], "over_page int, ow double, oh double"))
    with pytest.raises(Exception, match="selects no page"):
        pages.insert(box.withColumn("width", F.lit(1.0)).withColumn("height", F.lit(1.0)), 1, "after", "1", model="9").collect()


def test_bookmarks(spark):
    rows = [(1, 1, 1, 1), (1, 2, 0, 1), (1, 3, 2, 9), (1, 4, 3, 1), (1, 5, 2, 2), (1, 6, 3, 2), (1, 7, 1, 3), (1, 8, 3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, level int, page_no int")
    kept = info.skip_jumps(df, spark.createDataFrame([(1, 3)], "doc_id long, n_pages int"))
    assert {(r.seq, r.parent_seq) for r in info.bookmark_tree(kept).collect()} == {(1, None), (5, 1), (6, 5), (7, None)}
    gone = df.withColumn("page_no", F.when(F.col("seq").isin(6, 8), 1)).filter("level > 0")
    assert {r.seq for r in repair.kept_bookmarks(gone).collect()} == {1, 5, 6, 7, 8}


def test_burst_of_text_ids(spark):
    df = spark.createDataFrame([(f"d{i:04d}", p) for i in range(700) for p in (1, 2)], "doc_id string, page_no int").repartition(3)
    got = [(r.doc_id, r.page_no, r.counter) for r in pages.burst(df).orderBy("counter").collect()]
    assert got == [(f"d{i:04d}", p, 2 * i + p) for i in range(700) for p in (1, 2)]


def test_folders_do_not_grow_with_documents(spark, tmp_path):
    from quire.sources import bundles

    df = spark.createDataFrame([(d, 1, f"x{d}") for d in range(300)], "doc_id long, page_no int, content string")
    bundles.write_each(pages.burst(df), f"file://{tmp_path}/each")
    got = spark.read.parquet(f"file://{tmp_path}/each")
    assert got.select("bucket").distinct().count() <= bundles.BUCKETS and {(r.file_name, r.content) for r in got.collect()} == {(f"pg_{d + 1:04d}.pdf", f"x{d}") for d in range(300)}
    files = Bundle({"attachments": spark.createDataFrame([(1, "a", "x"), (2, "a", None)], "doc_id long, name string, data string")})
    registry.call("unpack_files", files, f"file://{tmp_path}/files")
    assert {(r.doc_id, r.name, r.data and bytes(r.data)) for r in spark.read.parquet(f"file://{tmp_path}/files").collect()} == {(1, "a", b"x"), (2, "a", None)}
