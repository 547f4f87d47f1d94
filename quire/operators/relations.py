"""Annotations, destinations, form fields, layers, attachments: reports and edits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument, Requires
from ..functions.text import short_number, xml_encode
from ..pagespec import any_match, parse
from .pages import with_total
from .repair import walk

#: Subtypes of annotations that the report has. Fixed values.
REPORTED = ("FreeText", "Link", "Popup", "Square", "Text", "URI", "Widget", "FileAttachment")


def resolve(links: DataFrame, dests: DataFrame, name: str = "action_dest") -> DataFrame:
    """links with page and fit type of the named destination; null where the name is unknown. Of several of one name the last counts."""
    seq = F.col("seq") if "seq" in dests.columns else F.lit(0)
    fit = F.col("fit_type") if "fit_type" in dests.columns else F.lit(None).cast("string")
    known = dests.groupBy("doc_id", F.col("name").alias(name)).agg(F.max_by(F.struct(F.col("page_no").alias("dest_page"), fit.alias("dest_fit")), seq).alias("_d"))
    return links.join(known, ["doc_id", name], "left").select(*links.columns, "_d.*")


def of_subtype(annots: DataFrame, *kinds: str) -> DataFrame:
    """The annotations of these subtypes."""
    return annots.filter(F.col("subtype").isin(*kinds))


def links_of(pages: DataFrame, html: str = "html") -> DataFrame:
    """doc_id, page_no, annot_idx, subtype and uri of every link in a page's markup."""
    found = F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("doc_id", "page_no", F.posexplode(found).alias("annot_idx", "uri")).withColumn("subtype", F.lit("Link"))


def dump_annots(annots: DataFrame, dests: DataFrame | None = None) -> DataFrame:
    """One JSON record for each annotation; a named destination is resolved to its page."""
    if dests is not None:
        known = dests.select("doc_id", F.col("name").alias("action_dest"), F.col("page_no").alias("ResolvedDestination"))
        annots = annots.join(known, ["doc_id", "action_dest"], "left")
    keys = [c for c in annots.columns if c not in ("doc_id", "annot_idx")]
    return annots.select("doc_id", "page_no", "annot_idx", F.to_json(F.struct(*keys)).alias("record"))


def dump_data_annots(annots: DataFrame, pages: DataFrame | None = None, documents: DataFrame | None = None, escape: bool = True) -> DataFrame:
    """A report's blocks, in order of page_no and annot_idx: of the reported subtypes, without JavaScript, the subtype and the box
    (ax0 to ay1), lines descending, and the page number last.

    With pages, the first block of each document (page_no 0) is its number of pages and,
    if documents has it, the base of its addresses (uri_base).
    """
    rows = annots.filter(F.col("subtype").isin(*REPORTED))
    if "action_type" in rows.columns:
        rows = rows.filter(F.coalesce(F.col("action_type"), F.lit("")) != "JavaScript")
    say = xml_encode if escape else lambda c: c
    lines = [F.concat(F.lit("AnnotSubtype: "), say(F.col("subtype")))]
    if "ax0" in rows.columns:
        lines.append(F.concat(F.lit("AnnotRect: "), F.concat_ws(" ", *(short_number(F.col(c)) for c in ("ax0", "ay0", "ax1", "ay1")))))
    own = F.array_append(F.sort_array(F.array_compact(F.array(*lines)), asc=False), F.concat(F.lit("AnnotPageNumber: "), F.col("page_no").cast("string")))
    out = rows.select("doc_id", "page_no", "annot_idx", F.array_join(own, "\n").alias("block"))
    if pages is None:
        return out
    head = pages.groupBy("doc_id").agg(F.concat(F.lit("NumberOfPages: "), F.max("page_no").cast("string")).alias("block"))
    if documents is not None and "uri_base" in documents.columns:
        head = head.join(documents.select("doc_id", "uri_base"), "doc_id", "left")
        head = head.select("doc_id", F.concat_ws("\n", "block", F.concat(F.lit("PdfUriBase: "), say(F.col("uri_base")))).alias("block"))
    return head.select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("annot_idx"), "block").unionByName(out)


def _selector(text: str) -> tuple[str, str | None]:
    """`pages/Type`: either may be missing."""
    pages, _, kind = text.partition("/")
    return pages or "-", kind or None


def _literal(text: str) -> Column:
    """null, true, false, (text), /Name, a number or plain text, as text; null deletes."""
    text = text.strip()
    if text == "null":
        return F.lit(None).cast("string")
    if text.startswith("(") and text.endswith(")"):
        return F.lit(text[1:-1])
    return F.lit(text)


def _without(props: Column, key: str) -> Column:
    return F.map_filter(props, lambda k, _: k != key)


def modify_annots(annots: DataFrame, rules: Sequence[str], pages: DataFrame) -> DataFrame:
    """`selector(Key=Value, ...)` in order, on the map column props; a null value deletes its key."""
    totals = pages.groupBy("doc_id").agg(F.max("page_no").cast("int").alias("n_pages"))
    out = annots.join(totals, "doc_id")
    props = F.col("props")
    for text in rules:
        m = re.fullmatch(r"\s*([^()]*)\((.*)\)\s*", text, re.S)
        if not m:
            raise InvalidArgument(f"not a rule: {text!r}")
        where, kind = _selector(m[1])
        hit = any_match(parse(where), F.col("page_no"), F.col("n_pages"))
        if kind:
            hit = hit & (F.col("subtype") == kind)
        for pair in re.findall(r'(?:[^,"]|"[^"]*")+', m[2]):
            key, eq, value = pair.partition("=")
            if not eq:
                raise InvalidArgument(f"no value: {pair!r}")
            key, value = key.strip(), value.strip().strip('"')
            without = _without(props, key)
            changed = without if value == "null" else F.map_concat(without, F.create_map(F.lit(key), _literal(value)))
            props = F.when(hit, changed).otherwise(props)
    return out.withColumn("props", props).drop("n_pages")


def delete_annots(annots: DataFrame, specs: str, pages: DataFrame) -> DataFrame:
    """Without the annotations of the selected pages."""
    gone = with_total(pages).filter(any_match(parse(specs), F.col("page_no"), F.col("n_pages"))).select("doc_id", "page_no")
    return annots.join(gone, ["doc_id", "page_no"], "left_anti")


def dump_dests(dests: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, name, value (JSON) and error: null, or why a destination can't be read; in order of the names."""
    ok = F.col("page_no").isNotNull() & F.col("name").isNotNull()
    value = F.to_json(F.struct("page_no", *(c for c in ("fit_type",) if c in dests.columns)))
    return dests.select("doc_id", "name", F.when(ok, value).alias("value"), F.when(~ok, F.lit("no page")).alias("error")).orderBy("doc_id", "name")


def field_tree(nodes: DataFrame, depth: int = 16) -> DataFrame:
    """Fully qualified names of a tree of form nodes (doc_id, node_id, parent_id, name, is_field), root first.

    A recognised field is a leaf: what hangs below it is not walked. Levels are joined
    one by one, as many as the tree is deep; depth: levels that are planned at once.
    """

    def following(level: DataFrame, d: int) -> DataFrame:
        above = level.filter(~F.col("is_field")).select("doc_id", F.col("node_id").alias("parent_id"), F.col("fq_name").alias("prefix"))
        return nodes.join(above, ["doc_id", "parent_id"]).select("doc_id", "node_id", F.concat_ws(".", "prefix", "name").alias("fq_name"), "is_field")

    first = nodes.filter("parent_id is null").select("doc_id", "node_id", F.col("name").alias("fq_name"), "is_field")
    return walk(first, following, depth, nodes).filter("is_field")


def dump_data_fields(fields: DataFrame, escape: bool = True, extra: bool = False) -> DataFrame:
    """Type, name, flags, value, default, justification and options of each field as a block of lines; all but the type are left out where they are empty.

    Buttons of all kinds are `Button`; a checkbox or radio group without a value is Off;
    a number is a place in Left, Center and Right. options: an array of texts or of
    structs of what is exported and what is shown. seq, the place in the form's tree from
    its root, depth first, stays as it is: sort by it to print. extra: the kind of button, too.
    """
    have = set(fields.columns)
    say = xml_encode if escape else lambda c: c
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    kind = F.coalesce(text("type"), F.lit(""))
    button = F.lower(kind).isin("checkbox", "radio", "radiobuttongroup", "pushbutton", "button")
    value = F.coalesce(text("value"), F.when(button & ~F.lower(kind).isin("pushbutton", "button"), F.lit("Off")))
    place = text("justification")
    side = F.when(place.isNull() | (place == "0"), F.lit("Left")).when(place == "1", F.lit("Center")).when(place == "2", F.lit("Right")).when(place.isin("Left", "Center", "Right"), place).otherwise(F.lit("Left"))
    said = [("FieldSubType", kind)] if extra else []
    said += [("FieldName", text("fq_name")), ("FieldNameAlt", text("name_alt")), ("FieldFlags", F.coalesce(text("flags"), F.lit("0"))), ("FieldValue", value), ("FieldValueDefault", text("value_default")), ("FieldJustification", side)]
    first = F.concat(F.lit("FieldType: "), say(F.when(button, F.lit("Button")).otherwise(kind)))
    lines = F.array(first, *(F.when(c != "", F.concat(F.lit(f"{k}: "), say(c))) for k, c in said))
    if "options" in have:
        pairs = "struct" in dict(fields.dtypes)["options"]
        plain = lambda name, c: F.concat(F.lit(f"{name}: "), say(c))
        listed = F.transform("options", lambda o: F.array(plain("FieldStateOption", o["export"]), plain("FieldStateOptionDisplay", o["display"])) if pairs else F.array(plain("FieldStateOption", o)))
        lines = F.concat(lines, F.coalesce(F.flatten(listed), F.array().cast("array<string>")))
    order = ["seq"] if "seq" in have else []
    return fields.select("doc_id", *order, "fq_name", F.array_join(F.array_compact(lines), "\n").alias("block"))


def fill_form(fields: DataFrame, values: DataFrame) -> DataFrame:
    """New values by fully qualified name: a checkbox is true for yes, on, true and 1; Off clears a button; the last value of a name counts.

    values: doc_id and fq_name or fq_name alone, value, and seq where names repeat.
    """
    keys = ["doc_id", "fq_name"] if "doc_id" in values.columns else ["fq_name"]
    seq = F.col("seq") if "seq" in values.columns else F.lit(0)
    new = values.groupBy(*keys).agg(F.max_by("value", seq).alias("new"), F.lit(True).alias("given"))
    out = fields.join(new, keys, "left")
    kind = F.col("type") if "type" in fields.columns else F.lit("Text")
    yes = F.lower("new").isin("yes", "on", "true", "1")
    button = F.when(F.lower("new") == "off", F.lit("Off")).when(kind == "Checkbox", F.when(yes, F.lit("Yes")).otherwise(F.lit("Off"))).otherwise(F.col("new"))
    value = F.when(kind.isin("Checkbox", "Radio"), button).otherwise(F.col("new"))
    return out.withColumn("value", F.when(F.coalesce("given", F.lit(False)), value).otherwise(F.col("value"))).drop("new", "given")


def generate_fdf(fields: DataFrame) -> DataFrame:
    """doc_id and an FDF document with every field's value or default."""
    esc = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\()])", r"\\$1")
    value = F.coalesce("value", "value_default") if "value_default" in fields.columns else F.col("value")
    one = F.concat(F.lit("<<\n/T ("), esc(F.col("fq_name")), F.lit(")\n/V ("), esc(value), F.lit(")\n>>"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fq_name", one.alias("f")))), lambda r: r["f"]), "\n")
    head, tail = "%FDF-1.2\n1 0 obj\n<<\n/FDF\n<<\n/Fields [\n", "\n]\n>>\n>>\nendobj\ntrailer\n\n<<\n/Root 1 0 R\n>>\n%%EOF\n"
    return fields.groupBy("doc_id").agg(F.concat(F.lit(head), rows, F.lit(tail)).alias("fdf"))


def dump_layers(layers: DataFrame, off: DataFrame) -> DataFrame:
    """layers with default_state: OFF for the ids that the default configuration's list has."""
    out = layers.join(off.select("doc_id", "obj_id").distinct().withColumn("_off", F.lit(True)), ["doc_id", "obj_id"], "left")
    return out.withColumn("default_state", F.when(F.col("_off"), F.lit("OFF")).otherwise(F.lit("ON"))).drop("_off")


def dump_files(attachments: DataFrame, data: str = "data") -> DataFrame:
    return attachments.select("doc_id", "name", F.octet_length(F.coalesce(F.col(data).cast("binary"), F.lit("").cast("binary"))).cast("long").alias("size"))


def unpack_files(attachments: DataFrame, data: str = "data") -> DataFrame:
    """doc_id, name and bytes of every attachment."""
    return attachments.select("doc_id", "name", F.col(data).cast("binary").alias("data"))


def attach_files(pages: DataFrame, files: Sequence[tuple[str, str | None, str | None]]) -> DataFrame:
    """(name, pages or None, relationship or None): one row for each attachment; on a page, with its icon's corner.

    The icon is 27 points wide, 30 further right and down for every icon already there.
    """
    pages = with_total(pages)
    made = []
    for i, (name, where, relation) in enumerate(files):
        if where is not None:
            hit = any_match(parse(where), F.col("page_no"), F.col("n_pages"))
            made.append(F.when(hit, F.struct(F.lit(i).alias("seq"), F.lit(name).alias("name"), F.lit(relation).cast("string").alias("relationship"))))
    documents = pages.select("doc_id").distinct()
    at_doc = [F.struct(F.lit(i).alias("seq"), F.lit(n).alias("name"), F.lit(r).cast("string").alias("relationship")) for i, (n, w, r) in enumerate(files) if w is None]
    none = F.lit(None)
    out = None
    if made:
        # a page's files stand in its list in order, so that their places need no window
        rows = pages.select("doc_id", "page_no", "x0", "y1", F.posexplode(F.array_compact(F.array(*made))).alias("k", "_f"))
        out = rows.select("doc_id", "page_no", "x0", "y1", "k", "_f.*").select("doc_id", "page_no", "seq", "name", "relationship", (F.col("x0") + 10 + 30 * F.col("k")).alias("left"), (F.col("y1") - 10 - 30 * F.col("k")).alias("top"))
    if at_doc:
        rows = documents.select("doc_id", none.cast("int").alias("page_no"), F.inline(F.array(*at_doc))).withColumn("left", none.cast("double")).withColumn("top", none.cast("double"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise InvalidArgument("no files")
    return out


def dump_signatures(*_: object) -> DataFrame:
    raise Requires("dump_signatures", "a library that validates signatures")


def optimize_images(*_: object, level: int = 1, quality: int | None = None, jobs: int = 0) -> DataFrame:
    if quality is not None and not 0 <= quality <= 100:
        raise InvalidArgument(f"a quality of 0 to 100, not {quality}")
    if jobs < 0:
        raise InvalidArgument(f"jobs of 0 or more, not {jobs}")
    raise Requires("optimize_images", "an image codec")


def render(pages: DataFrame, dpi: int = 150, pattern: str = "page_%d.png", pixels: bool = False) -> DataFrame:
    """Names and sizes in pixels of the pages' images; the images themselves need a renderer."""
    if pixels:
        raise Requires("render", "a renderer")
    side = lambda a, b: F.ceil((F.col(b) - F.col(a)) * (dpi / 72)).cast("int")
    return pages.select("doc_id", "page_no", F.format_string(pattern, F.col("page_no")).alias("file_name"), side("x0", "x1").alias("px_width"), side("y0", "y1").alias("px_height"))
