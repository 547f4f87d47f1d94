"""Every query that has SQL against DuckDB; the pipeline's front ends and errors."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire import api, queries, registry
from quire.errors import DuplicateArgument, InvalidArgument, InvalidCommand, MissingArgument, Requires
from quire.plans import stages
from quire.registry import Bundle
from quire.sources import bundles
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(frame):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_duckdb(spark, db, name):
    got = queries.QUERIES[name](spark, SMALL)
    names = sorted(got.columns)
    found = db.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    assert rows(tuple(r) for r in got.select(*names).collect()) == rows(tuple(r[i] for i in at) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_normalize(spark):
    df = spark.createDataFrame([(1, 1, "q 1 0 0 1 5 5 cm (a (b) c) Tj\n[(x y) 3] TJ Q", 1)], "doc_id long, page_no int, content string, n_pages int")
    out = registry.call("normalize", Bundle({"pages": df}))["pages"].first().content
    assert out.split("\n")[0] == "q" and out.split("\n")[-1] == "Q" and "1 0 0 1 5 5 cm" in out.split("\n")


def test_stage_parser():
    a, b = stages.parse(["A=x.pdf", "B=y.pdf", "cat", "A1-3", "B", "---", "rotate", "right", "output", "z", "allow", "Printing", "FillIn", "compress"])
    assert (a.operation, a.inputs, a.handles, a.args) == ("cat", ["x.pdf", "y.pdf"], {"A": "x.pdf", "B": "y.pdf"}, ["A1-3", "B"])
    assert (b.inputs, b.args, b.options) == (["_"], ["right"], {"output": "z", "allow": ["Printing", "FillIn"], "compress": True})
    assert stages.parse(["x", "output", "y"])[0].operation == "filter" and stages.parse(["x", "y", "output", "z"])[0].operation == "cat"
    for words, error in ((["x", "---"], InvalidCommand), (["x", "output"], MissingArgument), (["x", "output", "a", "output", "b"], DuplicateArgument), (["x", "cat", "output", "a", "1-2"], InvalidCommand)):
        with pytest.raises(error):
            stages.parse(words)


def test_encryption():
    assert stages.encryption({}) is None
    assert stages.encryption({"user_pw": "x"}) == {"method": "encrypt_aes128", "permissions": ["all"], "metadata": True}
    assert stages.encryption({"encrypt_128bit": True, "allow": ["fillin"]})["permissions"] == ["modify_form"]
    with pytest.raises(InvalidCommand):
        stages.encryption({"encrypt_40bit": True, "encrypt_aes256": True})
    with pytest.raises(InvalidCommand):
        stages.encryption({"encrypt_40bit": True, "no_encrypt_metadata": True})


def test_fronts(spark, tmp_path):
    pages = bundles.conversation_pages(spark, SMALL)
    bundle = Bundle({"pages": pages})
    fluent = api.pipeline(bundle).delete("even").move("1", "after", "end")
    assert fluent.bundle["pages"].count() == pages.filter("page_no % 2 = 1").count()
    assert fluent.dump_text().count() == pages.select("doc_id").distinct().count()
    assert api.dump_text(bundle).columns == ["doc_id", "text"]
    two = stages.run(stages.parse(["A=a", "B=b", "cat", "B1", "A1"]), {"a": bundle, "b": bundle})["pages"]
    assert two.count() == 2 * pages.select("doc_id").distinct().count()
    fluent.save(f"file://{tmp_path}/x")
    assert bundles.read(spark, f"file://{tmp_path}/x")["pages"].count() == fluent.bundle["pages"].count()
    with pytest.raises(AttributeError):
        api.no_such_thing  # noqa: B018
    with pytest.raises(InvalidCommand):
        registry.call("no_such_thing", bundle)
    with pytest.raises(MissingArgument):
        registry.call("fill_form", bundle, None)


def test_all_forty_operations_are_there(spark):
    names = set(
        "cat shuffle burst delete move insert rotate crop chop place stamp multistamp background multibackground add_text replace normalize inject filter dump_data dump_data_utf8 "
        "update_info update_info_utf8 dump_data_fields dump_data_fields_utf8 fill_form generate_fdf dump_annots dump_data_annots modify_annots delete_annots dump_dests dump_layers "
        "dump_signatures dump_text dump_files unpack_files attach_files optimize_images render".split()
    )
    assert names == set(registry.OPERATIONS) and len(stages.OPTIONS) == 25
    assert registry.catalog(spark).count() == 40 and "rotate" in registry.help_text("tag:pages")
    for name in ("dump_signatures", "optimize_images"):
        with pytest.raises(Requires):
            registry.call(name, Bundle({}))


def test_user_operations(tmp_path):
    (tmp_path / "mine.py").write_text("from quire.registry import operation\n@operation('mine')\ndef f(bundle):\n    'Mine.'\n    return bundle\n")
    (tmp_path / "broken.py").write_text("1 / 0\n")
    assert registry.load_user_operations(tmp_path) == ["mine"]
    assert registry.OPERATIONS.pop("mine").description == "Mine."


def test_form_data_round_trip(spark):
    fields = spark.createDataFrame([(1, "a.b", "x (y) \\ z"), (1, "c", None)], "doc_id long, fq_name string, value string")
    fdf = registry.call("generate_fdf", Bundle({"fields": fields})).report
    assert {(r.fq_name, r.value) for r in bundles.fdf_values(fdf).collect()} == {("a.b", "x (y) \\ z"), ("c", "")}
    x = spark.createDataFrame([(1, '<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields><field name="a"><value>1</value></field><field name="b"><value>2</value></field></fields></xfdf>')], "doc_id long, xfdf string")
    assert [(r.fq_name, r.value) for r in bundles.xfdf_values(x).orderBy("seq").collect()] == [("a", "1"), ("b", "2")]


def test_nested_form_data(spark):
    """Names of nested fields are joined, parents without a value have none, and an empty value shifts nothing."""
    xml = '<xfdf><fields><field name="a"><field name="b"><value>1</value></field><field name="c"/></field><field name="d"><value></value></field><field name="e"><value>2</value></field></fields></xfdf>'
    x = spark.createDataFrame([(1, xml), (2, None)], "doc_id long, xfdf string")
    assert [(r.doc_id, r.fq_name, r.value) for r in bundles.xfdf_values(x).orderBy("seq").collect()] == [(1, "a.b", "1"), (1, "d", ""), (1, "e", "2")]


def test_operands_on_the_command_line(spark, tmp_path):
    pages = spark.createDataFrame([(1, i, 0, 0.0, 0.0, 100.0, 200.0) for i in (1, 2, 3)], "doc_id long, page_no int, rotation int, x0 double, y0 double, x1 double, y1 double").withColumn("content", F.lit("a b"))
    fields = spark.createDataFrame([(1, "n", "old"), (1, "m", "old")], "doc_id long, fq_name string, value string")
    b = Bundle({"pages": pages, "fields": fields, "docinfo": spark.createDataFrame([(1, "Title", "t")], "doc_id long, key string, value string")})
    x = Bundle({"xfdf": spark.createDataFrame([(1, '<xfdf><fields><field name="n"><value>new</value></field></fields></xfdf>')], "doc_id long, xfdf string")})
    lines = Bundle({"lines": spark.createDataFrame([(1, i, v) for i, v in enumerate(["InfoBegin", "InfoKey: Title", "InfoValue: other"])], "doc_id long, line_no int, line string")})
    inputs = {"in": b, "over": Bundle({"pages": pages.filter("page_no < 3")}), "x": x, "lines": lines}
    run = lambda *words: stages.run(stages.parse(words), inputs)
    assert {(r.page_no, r.over_page, r.z_order) for r in run("in", "multistamp", "over")["overlays"].collect()} == {(1, 1, 1), (2, 2, 1), (3, 2, 1)}
    assert {(r.page_no, r.over_page, r.z_order) for r in run("in", "background", "over")["overlays"].collect()} == {(i, 1, -1) for i in (1, 2, 3)}
    assert {(r.fq_name, r.value) for r in run("in", "fill_form", "x")["fields"].collect()} == {("n", "new"), ("m", "old")}
    assert run("in", "update_info", "lines")["docinfo"].first().value == "other"
    text = run("in", "add_text", "odd", "-|p{page}|(position=top-left, offset-x=1in, size=10, color=1 0 0)")["texts"].orderBy("page_no").collect()
    assert [(r.page_no, r.text, r.x, r.y, r.align, r.size, r.color) for r in text] == [(i, f"p{i}", 72.0, 190.0, "left", 10.0, [1.0, 0.0, 0.0]) for i in (1, 3)]
    assert run("in", "replace", "1/a/x/", "-/b/y/")["pages"].orderBy("page_no").first().content == "x\ny"
    (tmp_path / "w.json").write_text('["1-2"]')
    assert run("in", "delete", f"@{tmp_path}/w.json")["pages"].count() == 1
    for words in (("in", "stamp", "nowhere"), ("in", "add_text", "no delimiter")):
        with pytest.raises((MissingArgument, InvalidArgument)):
            run(*words)
    whole = run("in", "dump_data", "json").report.first().info
    assert '"Info":[{"Key":"Title","Value":"t"}]' in whole and '"NumberOfPages":3' in whole and '"Dimensions":["100","200"]' in whole


def test_later_stages_keep_the_pipeline(spark):
    s = stages.parse(["A=x", "cat", "A1", "---", "B=y", "cat", "_1-2", "B", "compress", "compress", "allow", "Printing", "allow", "FillIn"])
    assert s[1].inputs == ["_", "y"] and s[1].options["allow"] == ["Printing", "FillIn"]
    assert stages.writer_options(s[1].options) == {"compression": "zstd"} and stages.writer_options({"linearize": True}) == {"ordered": True}
    with pytest.raises(InvalidCommand):
        stages.writer_options({"compress": True, "uncompress": True})
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_no int")
    ids = spark.createDataFrame([(1, 0, "a")], "doc_id long, input_idx int, id0 string")
    out = stages.run(stages.parse(["in", "filter", "keep_first_id", "---", "filter", "user_pw", "x"]), {"in": Bundle({"pages": pages, "documents": ids})})
    assert "output_ids" not in out.relations and out["encryption_plan"].first().method == "encrypt_aes128"
    two = stages.run(stages.parse(["in", "filter", "---", "B=more", "cat", "B1", "_2"]), {"in": Bundle({"pages": pages}), "more": Bundle({"pages": pages})})["pages"]
    assert two.count() == 2


def test_several_inputs_are_followed(spark):
    """What refers to pages follows the pages of every input; what comes out is a document that further stages select from."""

    def made(name, n):
        rows = spark.createDataFrame([(1, i, f"{name}{i}") for i in range(1, n + 1)], "doc_id long, page_no int, content string")
        annots = rows.select("doc_id", "page_no", F.lit(0).alias("annot_idx"), (F.col("page_no") % n + 1).alias("target_page"), F.concat(F.lit("d"), "page_no").alias("action_dest"))
        return Bundle({"pages": rows, "annots": annots, "dests": rows.select("doc_id", F.concat(F.lit("d"), "page_no").alias("name"), "page_no"), "outlines": rows.select("doc_id", F.col("page_no").alias("seq"), F.lit(1).alias("level"), "page_no", F.col("content").alias("title"))})

    inputs = {"a": made("a", 2), "b": made("b", 3)}
    run = lambda *words: stages.run(stages.parse(words), inputs)
    out = run("A=a", "B=b", "cat", "B2-3", "A", "A2")
    assert [(r.doc_id, r.page_no, r.content, r.src_handle) for r in out["pages"].orderBy("page_no").collect()] == [(1, 1, "b2", "B"), (1, 2, "b3", "B"), (1, 3, "a1", "A"), (1, 4, "a2", "A"), (1, 5, "a2", "A")]
    assert {(r.page_no, r.target_page, r.broken, r.action_dest) for r in out["annots"].collect()} == {(1, 2, False, "1-0-d2"), (2, None, True, "1-0-d3"), (3, 4, False, "0-0-d1"), (4, 3, False, "0-0-d2"), (5, None, True, "0-1-d2")}
    assert {(r.name, r.page_no) for r in out["dests"].collect()} == {("1-0-d2", 1), ("1-0-d3", 2), ("0-0-d1", 3), ("0-0-d2", 4), ("0-1-d2", 5)}
    assert [(r.title, r.page_no) for r in out["outlines"].orderBy("seq").collect()] == [("b2", 1), ("b3", 2), ("a1", 3), ("a2", 4), ("a2", 5)]
    again = run("A=a", "B=b", "cat", "B2-3", "A", "---", "cat", "end-2", "---", "delete", "1")
    assert [(r.page_no, r.content) for r in again["pages"].orderBy("page_no").collect()] == [(1, "a1"), (2, "b3")]
    assert {(r.name, r.page_no) for r in again["dests"].collect()} == {("1-0-d3", 2), ("0-0-d1", 1), ("0-0-d2", None)}
    more = run("A=a", "B=b", "cat", "A1", "B1", "---", "C=b", "shuffle", "_", "C1-2")
    assert [r.content for r in more["pages"].orderBy("page_no").collect()] == ["a1", "b1", "b1", "b2"]
    assert {(r.title, r.page_no) for r in more["outlines"].collect()} == {("a1", 1), ("b1", 3), ("b1", 2), ("b2", 4)}


def test_attach_grammar(spark):
    pages = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 200.0), (1, 2, 0.0, 0.0, 100.0, 200.0)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    out = registry.call("attach_files", Bundle({"pages": pages}), "a", "b", "to_page", "1", "c", "relation", "Data")["attached"]
    assert {(r.name, r.page_no, r.relationship, r.left, r.top) for r in out.collect()} == {("a", 1, "Data", 10.0, 190.0), ("b", 1, "Data", 40.0, 160.0), ("c", None, "Data", None, None)}
    with pytest.raises(InvalidArgument):
        registry.call("inject", Bundle({"pages": pages}), "1", "head", "x", "2")


def test_update_info(spark):
    lines = "InfoBegin\nInfoKey: Title\nInfoValue: a &amp; b &#233;\nNumberOfPages: 3\nBookmarkBegin\nBookmarkTitle: x".split("\n")
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    old = spark.createDataFrame([(1, "Title", "old"), (1, "Author", "me")], "doc_id long, key string, value string")
    out = registry.call("update_info", Bundle({"docinfo": old}), df)["docinfo"]
    assert {(r.key, r.value) for r in out.collect()} == {("Title", "a & b é"), ("Author", "me")}


def test_update_all_sections(spark, tmp_path):
    lines = "PdfID0: abc\nBookmarkBegin\nBookmarkTitle: a\nBookmarkLevel: 1\nBookmarkPageNumber: 1\nBookmarkBegin\nBookmarkTitle: jump\nBookmarkLevel: 3\nBookmarkPageNumber: 1\nBookmarkBegin\nBookmarkTitle: b\nBookmarkLevel: 2\nBookmarkPageNumber: 1\nPageMediaBegin\nPageMediaNumber: 1\nPageMediaRotation: 90\nPageMediaRect: 0 0 1,200.5 30\nPageLabelBegin\nPageLabelNewIndex: 0\nPageLabelNumStyle: NoNumber\nPageLabelBegin\nPageLabelNewIndex: 2\nPageLabelStart: 4\nPageLabelNumStyle: LowercaseRomanNumerals".split("\n")
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    pages = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 5.0, 5.0), (1, 2, 0, 0.0, 0.0, 5.0, 5.0), (1, 3, 0, 0.0, 0.0, 5.0, 5.0)], "doc_id long, page_no int, rotation int, x0 double, y0 double, x1 double, y1 double")
    outlines = spark.createDataFrame([(1, 1, "old", 1, 1), (2, 1, "kept", 1, 1)], "doc_id long, seq int, title string, level int, page_no int")
    labels = spark.createDataFrame([], "doc_id long, new_index int, start int, prefix string, num_style string")
    documents = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, id0 string")
    out = registry.call("update_info", Bundle({"pages": pages, "outlines": outlines, "page_labels": labels, "documents": documents}), df)
    assert {(r.doc_id, r.title) for r in out["outlines"].collect()} == {(1, "a"), (1, "b"), (2, "kept")}
    assert [(r.rotation, r.x1, r.y1) for r in out["pages"].orderBy("page_no").collect()] == [(90, 1200.5, 30.0), (0, 5.0, 5.0), (0, 5.0, 5.0)]
    assert {(r.doc_id, r.id0) for r in out["documents"].collect()} == {(1, "abc"), (2, "y")}
    from quire.operators import geometry, info

    assert [r.label for r in info.label_pages(pages, out["page_labels"]).orderBy("page_no").collect()] == ["1", "iv", "v"]
    shown = geometry.crop(pages, ["1(1)", "preview"]).orderBy("page_no").first()
    assert (shown.x0, shown.preview_x0, shown.preview_x1) == (0.0, 1.0, 4.0)
    annots = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 2.0, [0.0, 0.0, 1.0, 2.0])], "doc_id long, page_no int, ax0 double, ay0 double, ax1 double, ay1 double, quads array<double>")
    moved = geometry.place_annots(annots, geometry.place(pages, ["(spin=90:0,0;shift=10,0)"])).first()
    assert [round(v, 9) for v in (moved.ax0, moved.ay0, moved.ax1, moved.ay1)] == [8, 0, 10, 1] and [round(v, 9) for v in moved.quads] == [10, 0, 8, 1]
    lines_out = registry.call("dump_data", out).report
    bundles.write_lines(lines_out, f"file://{tmp_path}/lines")
    assert spark.read.text(f"file://{tmp_path}/lines").filter("value = 'BookmarkTitle: kept'").count() == 1
    (tmp_path / "args.json").write_text('["1-2", "4"]')
    assert bundles.file_arguments([f"@{tmp_path}/args.json"]) == ["1-2", "4"] and bundles.file_arguments(["a"]) == ["a"]


def test_passwords():
    s = stages.parse(["A=x", "B=y", "z", "input_pw", "B=two", "one", "cat", "A"])[0]
    assert s.passwords == {"y": "two", "x": "one"} and s.inputs == ["x", "y", "z"]


def test_empty_and_null_pages(spark):
    none = bundles.lineitem_pages(spark, SMALL).limit(0)
    b = Bundle({"pages": none})
    for call in (("delete", "1"), ("cat", "-"), ("shuffle", "1-end"), ("rotate", "left"), ("crop", "(1)"), ("chop", "cols2"), ("place", "(shift=1,1)"), ("move", "1", "after", "end"), ("insert", "2", "after", "1"), ("burst",)):
        assert registry.call(call[0], b, *call[1:])["pages"].count() == 0
