"""What must follow when pages move: links, destinations, outlines, form names; all of it keyed joins and windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..lineage import cut


def remap_links(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Explicit links after a selection: every copy of a page has its links, and each leads to the copy
    of its target with the same instance number; a link whose target is gone is broken.

    links: doc_id, page_no, annot_idx, target_page. chosen: a plan of pages.
    """
    at = chosen.select("doc_id", F.col("src_page").alias("page_no"), "out_page", "instance_num")
    to = chosen.select("doc_id", F.col("src_page").alias("target_page"), "instance_num", F.col("out_page").alias("out_target"))
    out = links.join(at, ["doc_id", "page_no"]).join(to, ["doc_id", "target_page", "instance_num"], "left")
    return out.withColumn("broken", F.col("out_target").isNull())


def rename_dests(dests: DataFrame, chosen: DataFrame, several_sources: bool = False) -> DataFrame:
    """Named destinations after a selection: `instance-name` if pages repeat, with the input's index before it
    if there are several inputs; the name stays if neither is so.

    dests: doc_id, name, page_no (and input_idx).
    """
    at = chosen.select("doc_id", F.col("src_page").alias("page_no"), "out_page", "instance_num", (F.max("instance_num").over(Window.partitionBy("doc_id")) > 0).alias("_repeats"))
    out = dests.join(at, ["doc_id", "page_no"])
    numbered = F.concat_ws("-", F.col("instance_num").cast("string"), "name")
    name = F.concat_ws("-", F.col("input_idx").cast("string"), numbered) if several_sources else F.when(F.col("_repeats"), numbered).otherwise(F.col("name"))
    return out.withColumn("new_name", name).drop("_repeats")


def last_by_name(dests: DataFrame, order: str = "seq") -> DataFrame:
    """Of several destinations of one name, the last."""
    return dests.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def turn_point(x: str, y: str, width: str, height: str, angle: str):
    """Coordinates of a destination on a page that was turned by a multiple of 90."""
    a = F.pmod(F.col(angle), F.lit(360))
    w, h, px, py = F.col(width), F.col(height), F.col(x), F.col(y)
    return F.when(a == 90, h - py).when(a == 180, w - px).when(a == 270, py).otherwise(px), F.when(a == 90, px).when(a == 180, h - py).when(a == 270, w - px).otherwise(py)


def outline_chunks(rows: DataFrame, order: Sequence[str], doc: str = "doc_id", page: str = "src_page", instance: str | None = None) -> DataFrame:
    """Runs of pages in which document, instance and contiguity hold: chunk, numbered from 0 in each document."""
    by = Window.partitionBy(doc).orderBy(*order)
    broke = (F.col(page) != F.lag(page).over(by) + 1) if instance is None else ((F.col(page) != F.lag(page).over(by) + 1) | (F.col(instance) != F.lag(instance).over(by)))
    out = rows.withColumn("_new", F.when(F.lag(page).over(by).isNull(), 0).when(broke, 1).otherwise(0))
    return out.withColumn("chunk", F.sum("_new").over(by).cast("int")).drop("_new")


def walk(first: DataFrame, following: Callable[[DataFrame, int], DataFrame], planned: int, nodes: DataFrame) -> DataFrame:
    """first and every level after it, until one is empty: so many levels in one plan, and if there are more,
    again so many, with the lineage cut in between. More levels than nodes are a cycle and an error.

    following: the next level, of a level and the next one's number (first has 1).
    """
    out = level = first
    d, most = 1, None
    while True:
        for _ in range(planned):
            d += 1
            level = following(level, d)
            out = out.unionByName(level)
        if following(level, d + 1).isEmpty():
            return out
        most = nodes.count() if most is None else most
        if d >= most:
            raise InvalidArgument("not a tree: its levels don't end")
        out, level, planned = cut(out), cut(level), max(planned, 1)


def tree_levels(nodes: DataFrame, depth: int = 16) -> DataFrame:
    """node_id, level (from 1) and path of a tree (node_id, parent_id, title), level by level; depth: levels that are planned at once."""

    def following(level: DataFrame, d: int) -> DataFrame:
        above = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("above"))
        return nodes.join(above, "parent_id").select("node_id", F.lit(d).alias("level"), F.concat_ws("/", "above", "title").alias("path"))

    first = nodes.filter("parent_id is null").select("node_id", F.lit(1).alias("level"), F.col("title").alias("path"))
    return walk(first, following, depth - 1, nodes)


def prune_outline(nodes: DataFrame, kept: DataFrame, depth: int = 16) -> DataFrame:
    """Nodes that are kept or have a kept descendant: parents are followed up, level by level, until none is new; depth: levels that are planned at once."""
    alive = front = kept.select("node_id").distinct()
    planned = depth - 1

    def parents(front: DataFrame) -> DataFrame:
        return nodes.join(front, "node_id", "left_semi").filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()

    while True:
        for _ in range(planned):
            front = parents(front)
            alive = alive.unionByName(front)
        front = parents(front).join(alive, "node_id", "left_anti")
        if front.isEmpty():
            return nodes.join(alive.distinct(), "node_id", "left_semi")
        front = cut(front)
        alive = cut(alive.unionByName(front).distinct())


def rename_fields(fields: DataFrame) -> DataFrame:
    """Fields of copied pages: `name_instance` from the second copy on."""
    return fields.withColumn("fq_name", F.when(F.col("instance_num") > 0, F.concat_ws("_", "fq_name", F.col("instance_num").cast("string"))).otherwise(F.col("fq_name")))


def first_widgets(widgets: DataFrame, key: str = "fq_name", order: Sequence[str] = ("page_no", "annot_idx")) -> DataFrame:
    """The form's index: of each field the first widget in page order."""
    return widgets.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", key).orderBy(*order))).filter("_n = 1").drop("_n")


def kept_bookmarks(outlines: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """outlines (doc_id, seq, level, page_no) without those that lead nowhere, unless one below them leads somewhere: one fold per document (by), from the end."""
    rows = F.reverse(F.sort_array(F.collect_list(F.struct("seq", "level", F.col("page_no").isNotNull().alias("leads")))))
    start = F.struct(F.lit(0).alias("under"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, b):
        # under: the level of the last one kept; what comes before it and is above that is its parent
        keep = b["leads"] | (b["level"] < acc["under"])
        under = F.when(keep, b["level"].cast("int")).otherwise(acc["under"])
        return F.struct(under.alias("under"), F.when(keep, F.array_append(acc["kept"], b["seq"].cast("bigint"))).otherwise(acc["kept"]).alias("kept"))

    kept = outlines.groupBy(*by).agg(F.aggregate(rows, start, step, lambda acc: acc["kept"]).alias("kept"))
    return outlines.join(kept.select(*by, F.explode("kept").alias("seq")), [*by, "seq"], "left_semi")


def turned(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    """Points x, y of XYZ destinations on pages that a selection has turned or scaled; frame has out_page, chosen angle, scale, width and height."""
    if not {"x", "y", "fit_type"} <= set(frame.columns) or not {"angle", "scale", "width", "height"} <= set(chosen.columns):
        return frame
    at = chosen.select("doc_id", "out_page", F.col("angle").alias("_angle"), F.col("scale").alias("_scale"), (F.col("width") / F.col("scale")).alias("_w"), (F.col("height") / F.col("scale")).alias("_h"))
    names = frame.columns
    out = frame.join(at, ["doc_id", "out_page"], "left")
    x, y = turn_point("x", "y", "_w", "_h", "_angle")
    moved = (F.col("fit_type") == "XYZ") & ((F.pmod(F.col("_angle"), F.lit(360)) != 0) | (F.col("_scale") != 1))
    return out.withColumns({"x": F.when(moved, x * F.col("_scale")).otherwise(F.col("x")), "y": F.when(moved, y * F.col("_scale")).otherwise(F.col("y"))}).select(*names)


#: What becomes of an action when its page is copied. Fixed names.
ACTIONS = {"remap": ("GoTo",), "copy": ("GoToR", "Launch", "URI", "Sound"), "copy_and_warn": ("JavaScript", "SubmitForm", "ResetForm", "ImportData")}


def dispatch(annots: DataFrame) -> DataFrame:
    """annots with handling: remap, copy, or copy_and_warn, which unknown actions have, too; null without an action."""
    kind = F.col("action_type")
    out = F.when(kind.isNull(), F.lit(None).cast("string"))
    for how, kinds in ACTIONS.items():
        out = out.when(kind.isin(*kinds), F.lit(how))
    return annots.withColumn("handling", out.otherwise(F.lit("copy_and_warn")))


def follow(relations: Mapping[str, DataFrame], chosen: DataFrame, new_document: bool) -> dict[str, DataFrame]:
    """The relations that refer to pages, after these have moved.

    chosen: doc_id, src_page, out_page, instance_num, and for sets of several inputs
    input_idx and out_doc, the document that pages have come to; relations then have
    input_idx, too. annots go with every copy of their page; a target_page leads to the
    copy of the same instance, or is null and broken. In a new document (a selection)
    destinations whose page is gone go, every copy of an input's pages has the bookmarks
    that lead to it, names of destinations and fields tell copies and inputs apart, and
    labels of pages aren't taken over; in place, destinations and bookmarks stay and lose
    their page.
    """
    out = dict(relations)
    source = ["doc_id", *(c for c in ("input_idx",) if c in chosen.columns)]
    if "out_doc" not in chosen.columns:
        chosen = chosen.withColumn("out_doc", F.col("doc_id"))
    chosen = chosen.withColumn("_mark", _name_mark("input_idx" in source) if new_document else F.lit(""))
    at = chosen.select(*source, F.col("src_page").alias("page_no"), "out_page", "out_doc", "instance_num", "_mark")

    def placed(moved: DataFrame, names: Sequence[str]) -> DataFrame:
        return moved.select(F.col("out_doc").alias("doc_id"), F.col("out_page").alias("page_no"), *(c for c in names if c not in ("doc_id", "page_no", "input_idx")))

    if "annots" in out:
        own = out["annots"]
        names = list(own.columns)
        moved = own.join(at, [*source, "page_no"])
        if "target_page" in names:
            to = chosen.select(*source, "out_doc", F.col("src_page").alias("target_page"), "instance_num", F.col("out_page").alias("_target"))
            moved = moved.join(to, [*source, "out_doc", "target_page", "instance_num"], "left").withColumn("broken", F.col("target_page").isNotNull() & F.col("_target").isNull()).withColumn("target_page", F.col("_target"))
            names += [] if "broken" in names else ["broken"]
        if "action_dest" in names:
            moved = moved.withColumn("action_dest", F.concat("_mark", "action_dest"))
        out["annots"] = placed(moved, names)
    if "dests" in out:
        own = out["dests"]
        if new_document:
            moved = own.join(at, [*source, "page_no"]).withColumn("name", F.concat("_mark", "name")).withColumn("doc_id", F.col("out_doc"))
            out["dests"] = placed(turned(moved, chosen.withColumn("doc_id", F.col("out_doc"))), own.columns).select(*(c for c in own.columns if c != "input_idx"))
        else:
            out["dests"] = _at_first(own, chosen)
    if "outlines" in out:
        out["outlines"] = copied_bookmarks(out["outlines"], chosen, source) if new_document else _at_first(out["outlines"], chosen)
    if "fields" in out and "page_no" in out["fields"].columns:
        own = out["fields"]
        moved = own.join(at, [*source, "page_no"])
        moved = rename_fields(moved) if new_document else moved
        out["fields"] = placed(moved, own.columns).select(*(c for c in own.columns if c != "input_idx"))
    if new_document:
        out.pop("page_labels", None)
    return out


def _name_mark(inputs: bool) -> Column:
    """What comes before the names of destinations: the input's index and the copy's where a document has several inputs, else the copy's if pages repeat."""
    by = Window.partitionBy("out_doc")
    copy = F.concat(F.col("instance_num").cast("string"), F.lit("-"))
    mark = F.when(F.max("instance_num").over(by) > 0, copy).otherwise(F.lit(""))
    if not inputs:
        return mark
    several = F.min("input_idx").over(by) != F.max("input_idx").over(by)
    return F.when(several, F.concat(F.col("input_idx").cast("string"), F.lit("-"), copy)).otherwise(mark)


def copied_bookmarks(outlines: DataFrame, chosen: DataFrame, source: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The bookmarks of a new document: for each input and each copy of its pages those that lead there, and their parents.

    Copies come in order of their first page; seq of the first copy is as it was, those of
    later ones go on beyond the greatest seq of the document's inputs.
    """
    names = [c for c in outlines.columns if c != "input_idx"]
    group = ["out_doc", *source, "instance_num"]
    copies = chosen.groupBy(*group).agg(F.min("out_page").alias("_first"))
    copies = copies.withColumn("_rank", F.row_number().over(Window.partitionBy("out_doc").orderBy("_first")) - 1)
    at = chosen.select(*group, F.col("src_page").alias("page_no"), "out_page")
    rows = outlines.join(copies, list(source)).join(at, [*group, "page_no"], "left").withColumn("page_no", F.col("out_page"))
    seq = F.col("seq") + F.col("_rank") * (F.max("seq").over(Window.partitionBy("out_doc")) + 1)
    rows = rows.withColumn("_seq", seq.cast(outlines.schema["seq"].dataType))
    return kept_bookmarks(rows, group).withColumn("doc_id", F.col("out_doc")).withColumn("seq", F.col("_seq")).select(*names)


def _at_first(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    """frame with page_no of the page's first copy; null where there is none."""
    first = chosen.filter("instance_num = 0").select("doc_id", F.col("src_page").alias("page_no"), "out_page")
    return frame.join(first, ["doc_id", "page_no"], "left").withColumn("page_no", F.col("out_page")).select(*frame.columns)
