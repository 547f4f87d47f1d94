"""Metadata: reports as stanzas or JSON, their reader, updates, page labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_text, rectangle_text, xml_decode, xml_encode
from .pages import dealt

#: What a record of each stanza kind may hold, in order. Fixed names.
SECTIONS = {"Info": ("Key", "Value"), "Bookmark": ("Title", "Level", "PageNumber"), "PageMedia": ("Number", "Rotation", "Rect", "Dimensions", "CropRect", "TrimRect", "BleedRect"), "PageLabel": ("NewIndex", "Start", "Prefix", "NumStyle")}


def _say(text, escape: bool):
    return xml_encode(text) if escape else text


def docinfo_lines(docinfo: DataFrame, escape: bool = True) -> DataFrame:
    """doc_id, section, seq, line_no, line: three lines for each entry, keys sorted."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))
    lines = F.array(F.lit("InfoBegin"), F.concat(F.lit("InfoKey: "), "key"), F.concat(F.lit("InfoValue: "), _say(F.col("value"), escape)))
    return dealt(docinfo.filter("value is not null"), "doc_id", times=3).withColumn("seq", seq).select("doc_id", F.lit(1).alias("section"), "seq", F.posexplode(lines).alias("line_no", "line"))


def outline_lines(outlines: DataFrame, escape: bool = True) -> DataFrame:
    lines = F.array(F.lit("BookmarkBegin"), F.concat(F.lit("BookmarkTitle: "), _say(F.col("title"), escape)), F.concat(F.lit("BookmarkLevel: "), F.col("level").cast("string")), F.concat(F.lit("BookmarkPageNumber: "), F.col("page_no").cast("string")))
    return outlines.select("doc_id", F.lit(4).alias("section"), "seq", F.posexplode(lines).alias("line_no", "line"))


def page_media_lines(pages: DataFrame) -> DataFrame:
    """Number, rotation, box and size of each page; crop, trim and bleed boxes (crop_x0 to bleed_y1) where they differ from the box that stands in for them."""
    corner = lambda kind: [F.col(f"{kind}{c}").cast("double") for c in ("x0", "y0", "x1", "y1")]
    said = lambda name, value: F.concat(F.lit(f"PageMedia{name}: "), value)
    x0, y0, x1, y1 = media = corner("")
    lines = [F.lit("PageMediaBegin"), said("Number", F.col("page_no").cast("string")), said("Rotation", F.coalesce(F.col("rotation"), F.lit(0)).cast("string"))]
    lines += [said("Rect", rectangle_text(*media)), said("Dimensions", F.concat_ws(" ", number_text(F.abs(x1 - x0)), number_text(F.abs(y1 - y0))))]
    own = F.array(*media)
    stand_in = own
    for name in ("crop", "trim", "bleed"):
        if {f"{name}_{c}" for c in ("x0", "y0", "x1", "y1")} <= set(pages.columns):
            box = corner(f"{name}_")
            given = box[0].isNotNull()
            lines.append(F.when(given & (F.array(*box) != stand_in), said(f"{name.title()}Rect", rectangle_text(*box))))
            stand_in = F.when(given, F.array(*box)).otherwise(own) if name == "crop" else stand_in
    return pages.select("doc_id", F.lit(5).alias("section"), F.col("page_no").alias("seq"), F.posexplode(F.array_compact(F.array(*lines))).alias("line_no", "line"))


def document_lines(documents: DataFrame, extra: bool = False) -> DataFrame:
    """PdfID0 and PdfID1; before all else, with extra, File, PDF version and Encrypted."""
    said = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) if c in documents.columns else F.lit(None).cast("string")
    parts = [(2, [said("PdfID0", "id0"), said("PdfID1", "id1")])]
    if extra:
        parts.append((0, [said("File", "path"), said("PDF version", "version"), said("Encrypted", "encrypted")]))
    rows = F.flatten(F.array(*(F.transform(F.array_compact(F.array(*lines)), lambda x, i: F.struct(F.lit(n).alias("section"), F.lit(1).alias("seq"), (i + 0).alias("line_no"), x.alias("line"))) for n, lines in parts)))  # noqa: B023
    return documents.select("doc_id", F.inline(rows))


def page_label_lines(labels: DataFrame) -> DataFrame:
    prefix = F.when(F.coalesce(F.col("prefix"), F.lit("")) != "", F.concat(F.lit("PageLabelPrefix: "), "prefix"))
    lines = F.array_compact(F.array(F.lit("PageLabelBegin"), F.concat(F.lit("PageLabelNewIndex: "), F.col("new_index").cast("string")), F.concat(F.lit("PageLabelStart: "), F.col("start").cast("string")), prefix, F.concat(F.lit("PageLabelNumStyle: "), "num_style")))
    return labels.select("doc_id", F.lit(6).alias("section"), F.col("new_index").alias("seq"), F.posexplode(lines).alias("line_no", "line"))


def dump_data(docinfo: DataFrame | None = None, pages: DataFrame | None = None, outlines: DataFrame | None = None, labels: DataFrame | None = None, escape: bool = True, documents: DataFrame | None = None, extra: bool = False) -> DataFrame:
    """doc_id, section, seq, line_no, line: sort by these to print. Sections: 0 the file, 1 Info, 2 ids, 3 number of pages, 4 bookmarks, 5 page media, 6 page labels."""
    parts = []
    if documents is not None:
        parts.append(document_lines(documents, extra))
    if docinfo is not None:
        parts.append(docinfo_lines(docinfo, escape))
    if pages is not None:
        count = pages.groupBy("doc_id").agg(F.max("page_no").alias("n"))
        parts.append(count.select("doc_id", F.lit(3).alias("section"), F.lit(1).alias("seq"), F.lit(0).alias("line_no"), F.concat(F.lit("NumberOfPages: "), F.col("n").cast("string")).alias("line")))
        if {"x0", "rotation"} <= set(pages.columns):
            parts.append(page_media_lines(pages))
    if outlines is not None:
        parts.append(outline_lines(outlines, escape))
    if labels is not None:
        parts.append(page_label_lines(labels))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dump_json(docinfo: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """doc_id and its entries as a JSON array in order of the keys."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return docinfo.groupBy("doc_id").agg(F.to_json(rows).alias("info"))


def dump_whole_json(docinfo: DataFrame | None = None, pages: DataFrame | None = None, outlines: DataFrame | None = None, labels: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """doc_id and all its metadata as one JSON object; what a document hasn't is left out."""

    def listed(rows: DataFrame, order: str, name: str, **fields) -> DataFrame:
        one = F.struct(F.col(order).alias("_o"), F.struct(*(v.alias(k) for k, v in fields.items())).alias("r"))
        return rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["r"]).alias(name))

    parts = []
    if docinfo is not None:
        parts.append(listed(docinfo.filter("value is not null"), "key", "Info", Key=F.col("key"), Value=F.col("value")))
    if documents is not None:
        ids = [F.col(c) for c in ("id0", "id1") if c in documents.columns]
        if ids:
            parts.append(documents.select("doc_id", F.array_compact(F.array(*ids)).alias("PdfID")))
    if pages is not None:
        parts.append(pages.groupBy("doc_id").agg(F.max("page_no").alias("NumberOfPages")))
        if {"x0", "rotation"} <= set(pages.columns):
            media = F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
            size = F.array(number_text(F.abs(F.col("x1") - F.col("x0"))), number_text(F.abs(F.col("y1") - F.col("y0"))))
            parts.append(listed(pages, "page_no", "PageMedia", PageNumber=F.col("page_no"), Rotation=F.coalesce("rotation", F.lit(0)), MediaRect=media, Dimensions=size))
    if outlines is not None:
        parts.append(listed(outlines, "seq", "Bookmarks", Title=F.col("title"), Level=F.col("level"), PageNumber=F.col("page_no")))
    if labels is not None:
        parts.append(listed(labels, "new_index", "PageLabels", NewIndex=F.col("new_index"), Start=F.col("start"), Prefix=F.col("prefix"), NumStyle=F.col("num_style")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "doc_id", "full_outer")
    return out.select("doc_id", F.to_json(F.struct(*(c for c in out.columns if c != "doc_id"))).alias("info"))


def read_stanzas(lines: DataFrame, decode: bool = True) -> DataFrame:
    """doc_id, kind, record, field, value of stanza lines (doc_id, line_no, line).

    A `...Begin` line opens a record; fields belong to the last record before them if it
    is of their kind, and stand alone (record 0) if they have none: a running count.
    """
    name, value = F.regexp_extract("line", r"^([A-Za-z0-9]+):? ?(.*)$", 1), F.regexp_extract("line", r"^[A-Za-z0-9]+: ?(.*)$", 1)
    by = Window.partitionBy("doc_id").orderBy("line_no")
    out = dealt(lines, "doc_id").withColumn("name", name).withColumn("value", value)
    begins = F.col("name").endswith("Begin")
    out = out.withColumn("record", F.sum(begins.cast("int")).over(by)).withColumn("kind", F.last(F.when(begins, F.regexp_replace("name", "Begin$", "")), ignorenulls=True).over(by))
    out = out.filter(~begins & (F.col("name") != ""))
    inside = F.col("kind").isNotNull() & F.col("name").startswith(F.col("kind"))
    decoded = xml_decode(F.col("value")) if decode else F.col("value")
    return out.select("doc_id", F.when(inside, F.col("kind")).otherwise(F.lit("Document")).alias("kind"), F.when(inside, F.col("record")).otherwise(0).cast("int").alias("record"), F.when(inside, F.expr("substring(name, length(kind) + 1)")).otherwise(F.col("name")).alias("field"), decoded.alias("value"))


def update_docinfo(docinfo: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key; a new value wins."""
    n = new.select("doc_id", "key", F.col("value").alias("_new"), F.lit(True).alias("_given"))
    out = docinfo.join(n, ["doc_id", "key"], "full_outer")
    return out.select("doc_id", "key", F.when(F.col("_given"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def replace_all(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bookmarks and labels: a document in new loses all that it had."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages and label: the definition in force is that of the last new_index up to the page.

    labels: doc_id, new_index (from 1), start, prefix, num_style (Decimal, upper or lower letters or roman numerals, or none).
    """
    valid = labels.filter("new_index >= 1").select("doc_id", F.col("new_index").alias("page_no"), F.struct("new_index", "start", "prefix", "num_style").alias("_d"))
    by = Window.partitionBy("doc_id").orderBy("page_no")
    out = pages.join(valid, ["doc_id", "page_no"], "left").withColumn("_d", F.last("_d", ignorenulls=True).over(by))
    n = F.col("page_no") - F.col("_d.new_index") + F.coalesce("_d.start", F.lit(1))
    style = F.coalesce("_d.num_style", F.lit("NoNumber"))
    letters = F.expr("repeat(chr(int(65 + pmod(n_ - 1, 26))), int((n_ - 1) div 26) + 1)")
    out = out.withColumn("n_", F.coalesce(n, F.col("page_no")))
    number = F.when(style == "NoNumber", F.lit("")).when(style == "UppercaseLetters", letters).when(style == "LowercaseLetters", F.lower(letters)).when(style == "UppercaseRomanNumerals", roman("n_")).when(style == "LowercaseRomanNumerals", F.lower(roman("n_"))).otherwise(F.col("n_").cast("string"))
    text = F.when(F.col("_d").isNull(), F.col("page_no").cast("string")).otherwise(F.concat(F.coalesce("_d.prefix", F.lit("")), number))
    return out.withColumn("label", text).drop("_d", "n_")


def roman(column: str):
    """Roman numerals of numbers below 4000."""
    out, rest = F.lit(""), F.col(column)
    for n, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, rest = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / n).cast("int"))), rest % n
    return out


def skip_jumps(outlines: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Without bookmarks that are more than one level below the last one kept, whose level is below 1, or whose page is beyond
    the last (totals: doc_id, n_pages); what is skipped is no parent either: a fold over each document's list."""
    outlines = outlines.filter("level >= 1")
    if totals is not None:
        names = outlines.columns
        outlines = outlines.join(totals.select("doc_id", F.col("n_pages").alias("_n")), "doc_id", "left").filter("_n is null or page_no is null or page_no <= _n").select(*names)
    rows = F.sort_array(F.collect_list(F.struct("seq", "level")))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, b):
        fits = b["level"] <= acc["depth"] + 1
        return F.struct(F.when(fits, b["level"].cast("int")).otherwise(acc["depth"]).alias("depth"), F.when(fits, F.array_append(acc["kept"], b["seq"].cast("bigint"))).otherwise(acc["kept"]).alias("kept"))

    kept = outlines.groupBy("doc_id").agg(F.aggregate(rows, start, step, lambda acc: acc["kept"]).alias("kept"))
    return outlines.join(kept.select("doc_id", F.explode("kept").alias("seq")), ["doc_id", "seq"], "left_semi")


#: Numbering styles that a label may have. Fixed names.
STYLES = ("DecimalArabicNumerals", "UppercaseRomanNumerals", "LowercaseRomanNumerals", "UppercaseLetters", "LowercaseLetters", "NoNumber")


def records(stanzas: DataFrame, kind: str) -> DataFrame:
    """A row for each record of a kind, its fields as columns."""
    own = stanzas.filter(F.col("kind") == kind)
    return own.groupBy("doc_id", "record").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in SECTIONS[kind]))


def updates(stanzas: DataFrame, totals: DataFrame | None = None) -> dict[str, DataFrame]:
    """docinfo, outlines, page_labels, page_media and ids that the stanzas set. Numbers may have separators. totals: doc_id, n_pages."""
    whole = lambda c: F.expr(f"try_cast(replace({c}, ',', '') as int)")
    marks = records(stanzas, "Bookmark").select("doc_id", F.col("record").alias("seq"), F.col("Title").alias("title"), whole("Level").alias("level"), whole("PageNumber").alias("page_no"))
    labels = records(stanzas, "PageLabel").select("doc_id", whole("NewIndex").alias("new_index"), F.coalesce(whole("Start"), F.lit(1)).alias("start"), F.col("Prefix").alias("prefix"), F.col("NumStyle").alias("num_style"))
    media = records(stanzas, "PageMedia").select("doc_id", whole("Number").alias("page_no"), whole("Rotation").alias("new_rotation"), F.split("Rect", " +").alias("r"))
    corners = [F.expr(f"try_cast(replace(try_element_at(r, {i}), ',', '') as double)").alias(f"new_{c}") for i, c in enumerate(("x0", "y0", "x1", "y1"), 1)]
    return {
        "docinfo": records(stanzas, "Info").select("doc_id", F.col("Key").alias("key"), F.col("Value").alias("value")),
        "outlines": skip_jumps(marks, totals),
        "page_labels": labels.filter((F.col("new_index") >= 1) & F.col("num_style").isin(*STYLES)),
        "page_media": media.select("doc_id", "page_no", "new_rotation", *corners),
        "ids": stanzas.filter("kind = 'Document' and field = 'PdfID0'").select("doc_id", F.col("value").alias("id0")),
    }


def set_media(pages: DataFrame, media: DataFrame) -> DataFrame:
    """New rotations and boxes by page; what isn't given stays."""
    out = pages.join(media, ["doc_id", "page_no"], "left")
    for c in ("rotation", "x0", "y0", "x1", "y1"):
        if c in pages.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"new_{c}"), F.col(c)))
    return out.select(*pages.columns)


def bookmark_tree(outlines: DataFrame, total: str = "n_pages") -> DataFrame:
    """outlines (doc_id, seq, level, page_no) with parent_seq: the last bookmark before it that is one level up.

    Bookmarks beyond the last page are left out. A bookmark stands once under its level,
    as a parent, and once under the one above, as a child, so one window finds all parents.
    """
    out = outlines.filter(F.col("page_no") <= F.col(total)) if total in outlines.columns else outlines
    parents = out.select("doc_id", "seq", F.col("level").cast("int").alias("_at"), F.col("seq").cast("int").alias("_up"))
    children = out.withColumn("_at", F.col("level").cast("int") - 1).withColumn("_child", F.lit(True))
    by = Window.partitionBy("doc_id", "_at").orderBy("seq")
    found = children.unionByName(parents, allowMissingColumns=True).withColumn("parent_seq", F.last("_up", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    return found.filter("_child").drop("_at", "_up", "_child")


def unpivot(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """docinfo from columns: doc_id, key, value."""
    rows = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.col(key).alias("doc_id"), F.inline(rows)).filter("value is not null")
