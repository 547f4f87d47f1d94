"""Geometry of pages: crop, chop, place, and overlay layout.

A page has a box x0, y0, x1, y1 in points. All of it is column arithmetic.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.dimensions import length, lengths, paper
from ..pagespec import PageSpec, any_match, parse
from .pages import with_total

BOX = ("x0", "y0", "x1", "y1")
MAX_PIECES = 10_000
#: Pages of an overlay, which is broadcast.
MAX_OVERLAY = 100_000


def _split_rule(text: str) -> tuple[list[PageSpec], str]:
    """`pages(rule)`; without pages the rule is for all."""
    m = re.fullmatch(r"\s*([^()]*)\((.*)\)\s*", text, re.S)
    if not m:
        raise InvalidArgument(f"not a rule: {text!r}")
    return parse(m[1] or "-"), m[2].strip()


def _hits(specs: list[PageSpec]) -> Column:
    return any_match(specs, F.col("page_no"), F.col("n_pages"))


def _last_match(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the last rule that selects the page."""
    out = None
    for hit, value in reversed(rules):
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return otherwise if out is None else out.otherwise(otherwise)


def margins(text: str, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """left, top, right, bottom of `l`, `l,t`, `l,t,r` or `l,t,r,b`, or what centres a paper size."""
    try:
        w, h = paper(text)
        side, up = (width - w) / 2, (height - h) / 2
        return side, up, side, up
    except InvalidArgument:
        pass
    parts = [p.strip() for p in text.split(",")]
    if not 1 <= len(parts) <= 4:
        raise InvalidArgument(f"one to four margins, not {text!r}")
    left = parts[0]
    top = parts[1] if len(parts) > 1 else left
    right = parts[2] if len(parts) > 2 else left
    bottom = parts[3] if len(parts) > 3 else top
    return length(left, width), length(top, height), length(right, width), length(bottom, height)


def crop(pages: DataFrame, rules: Sequence[str], preview: bool = False) -> DataFrame:
    """`pages(margins or paper)`: the box of the last rule that selects the page; a box without area is left as it was.

    With preview (or the last rule being that word) boxes stay, and preview_x0 to preview_y1 say what they would be.
    """
    if rules and rules[-1] == "preview":
        rules, preview = rules[:-1], True
    pages = with_total(pages)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    made = []
    for text in rules:
        specs, rule = _split_rule(text)
        left, top, right, bottom = margins(rule, w, h)
        made.append((_hits(specs), F.struct((F.col("x0") + left).alias("x0"), (F.col("y0") + bottom).alias("y0"), (F.col("x1") - right).alias("x1"), (F.col("y1") - top).alias("y1"))))
    own = F.struct(*BOX)
    out = pages.withColumn("_box", _last_match(made, own))
    fits = (F.col("_box.x1") > F.col("_box.x0")) & (F.col("_box.y1") > F.col("_box.y0"))
    out = out.withColumn("_box", F.when(fits, F.col("_box")).otherwise(own))
    for c in BOX:
        out = out.withColumn(f"preview_{c}" if preview else c, F.col(f"_box.{c}"))
    return out.drop("_box", "n_pages")


def fit_group(pages: DataFrame, specs: str = "-", padding: float = 0.0) -> DataFrame:
    """The selected pages get the union of their content boxes (ink x0 to y1), plus padding."""
    pages = with_total(pages)
    hit = any_match(parse(specs), F.col("page_no"), F.col("n_pages"))
    by = Window.partitionBy("doc_id")
    for c, union, pad in (("x0", F.min, -padding), ("y0", F.min, -padding), ("x1", F.max, padding), ("y1", F.max, padding)):
        pages = pages.withColumn(f"_{c}", union(F.when(hit, F.col(c))).over(by) + pad)
    for c in BOX:
        pages = pages.withColumn(c, F.when(hit, F.col(f"_{c}")).otherwise(F.col(c))).drop(f"_{c}")
    return pages.drop("n_pages")


def pieces(text: str, whole: Column) -> list[tuple[Column, bool]]:
    """Sizes along one side and whether each is kept: a number of equal parts, ratios `a:b`, or a list with `fill`."""
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        n = int(text)
        if not 1 <= n <= MAX_PIECES:
            raise InvalidArgument(f"1 to {MAX_PIECES} pieces, not {n}")
        return [(whole / n, True)] * n
    if ":" in text and "," not in text:
        ratios = [float(x) for x in text.split(":")]
        return [(whole * (r / sum(ratios)), True) for r in ratios]
    sizes, fills = [], 0
    for part in text.split(","):
        part = part.strip()
        drop = part.endswith("d")
        part = part[:-1] if drop else part
        fills += part == "fill"
        sizes.append((None if part == "fill" else length(part, whole), not drop))
    fixed = sum((s for s, _ in sizes if s is not None), F.lit(0.0))
    rest = F.when(fixed > whole + 1e-9, F.raise_error(F.lit(f"{text!r} is longer than the page")).cast("double")).otherwise((whole - fixed) / max(fills, 1))
    return [(rest if s is None else s, keep) for s, keep in sizes]


def _chop_rules(words: Sequence[str]) -> list[tuple[Column, str, str]]:
    """Which pages, cols or rows, and sizes, of `1-10cols2`, `evenrows(1:2)` or `odd`, `4-endcols3`; two halves where no size is given."""
    out, only = [], None
    for word in words:
        if word.lower() in ("even", "odd") and only is None:
            only = word.lower()
            continue
        m = re.fullmatch(r"(.*?)(cols|rows)(.*)", word.strip(), re.S)
        if not m:
            raise InvalidArgument(f"cols or rows are missing: {word!r}")
        sizes = m[3].strip()
        sizes = sizes[1:-1] if sizes.startswith("(") and sizes.endswith(")") else sizes
        hit = _hits(parse(m[1].strip() or "-"))
        if only is not None:
            hit = hit & (F.col("page_no") % 2 == (0 if only == "even" else 1))
        out.append((hit, m[2], sizes or "2"))
        only = None
    if only is not None:
        raise InvalidArgument(f"no rule after {only!r}")
    return out


def chop(pages: DataFrame, rules: Sequence[str]) -> DataFrame:
    """`<pages>cols<sizes>` or `<pages>rows<sizes>`: pages cut into pieces, columns from the left, rows from the top.

    Adds piece, and origin_x and origin_y of the piece in the page; boxes start at 0.
    Of several rules for a page the last counts; pages that no rule selects pass as they are.
    """
    pages = with_total(pages)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    made = []
    for hit, kind, sizes in _chop_rules(rules):
        at, parts = F.lit(0.0), []
        for i, (size, keep) in enumerate(pieces(sizes, w if kind == "cols" else h)):
            if keep:
                x, y = (F.col("x0") + at, F.col("y0")) if kind == "cols" else (F.col("x0"), F.col("y1") - at - size)
                parts.append(F.struct(F.lit(i + 1).alias("piece"), x.alias("ox"), y.alias("oy"), (size if kind == "cols" else w).alias("w"), (h if kind == "cols" else size).alias("h")))
            at = at + size
        made.append((hit, F.array(*parts), F.lit(len(parts))))
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("h")))
    # a piece's number is its place on the page after the pieces of the pages before: pages are sorted, not pieces
    before = F.sum(_last_match([(hit, n) for hit, _, n in made], F.lit(1))).over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    out = pages.withColumn("_before", F.coalesce(before, F.lit(0)))
    out = out.select("*", F.posexplode(_last_match([(hit, parts) for hit, parts, _ in made], whole)).alias("_i", "_p"))
    cut = F.col("_p.piece") > 0
    out = out.withColumn("piece", F.col("_p.piece")).withColumn("origin_x", F.col("_p.ox")).withColumn("origin_y", F.col("_p.oy"))
    out = out.withColumn("x1", F.when(cut, F.col("_p.w")).otherwise(F.col("x1"))).withColumn("y1", F.when(cut, F.col("_p.h")).otherwise(F.col("y1")))
    out = out.withColumn("x0", F.when(cut, 0.0).otherwise(F.col("x0"))).withColumn("y0", F.when(cut, 0.0).otherwise(F.col("y0")))
    out = out.withColumnRenamed("page_no", "src_page").withColumn("page_no", (F.col("_before") + F.col("_i") + 1).cast("int"))
    return out.drop("_p", "_i", "_before", "n_pages")


Matrix = tuple[Column, Column, Column, Column, Column, Column]


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """Row vectors: first m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def shift_by(x: Column, y: Column) -> Matrix:
    one, zero = F.lit(1.0), F.lit(0.0)
    return (one, zero, zero, one, x, y)


def about(m: Matrix, x: Column, y: Column) -> Matrix:
    return multiply(multiply(shift_by(-x, -y), m), shift_by(x, y))


def anchor(text: str) -> tuple[Column, Column]:
    """`center`, `top-left` and so on, or `x,y` from the box's corner."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    if "," in text:
        x, y = text.split(",")
        return x0 + lengths(x, x1 - x0), y0 + lengths(y, y1 - y0)
    words = set(text.split("-"))
    x = x0 if "left" in words else x1 if "right" in words else (x0 + x1) / 2
    y = y0 if "bottom" in words else y1 if "top" in words else (y0 + y1) / 2
    return x, y


def placement(ops: str) -> Matrix:
    """`shift=10,5; scale=2:center; spin=30:top-left`, applied in order; spin turns counter-clockwise."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    m = shift_by(F.lit(0.0), F.lit(0.0))
    for op in filter(None, (x.strip() for x in ops.split(";"))):
        name, _, arg = op.partition("=")
        arg, _, where = arg.partition(":")
        x, y = anchor(where or "center")
        if name == "shift":
            dx, dy = arg.split(",")
            step = shift_by(lengths(dx, w), lengths(dy, h))
        elif name == "scale":
            k, zero = F.lit(float(arg)), F.lit(0.0)
            step = about((k, zero, zero, k, zero, zero), x, y)
        elif name == "spin":
            c, s, zero = math.cos(math.radians(float(arg))), math.sin(math.radians(float(arg))), F.lit(0.0)
            step = about((F.lit(c), F.lit(s), F.lit(-s), F.lit(c), zero, zero), x, y)
        else:
            raise InvalidArgument(f"shift, scale or spin, not {name!r}")
        m = multiply(m, step)
    return m


def bounds(m: Matrix, corners: Sequence[Column]) -> tuple[Column, Column, Column, Column]:
    """The upright box around a box that the matrix has moved."""
    a, b, c, d, e, f = m
    x0, y0, x1, y1 = corners
    xs = [x * a + y * c + e for x in (x0, x1) for y in (y0, y1)]
    ys = [x * b + y * d + f for x in (x0, x1) for y in (y0, y1)]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


MATRIX = ("m_a", "m_b", "m_c", "m_d", "m_e", "m_f")


def place(pages: DataFrame, rules: Sequence[str]) -> DataFrame:
    """`pages(operations)`: adds the matrix m_a to m_f of each page and the box that its content then has.

    Rules add up: what a rule has placed, the next one for the page places again.
    """
    pages = with_total(pages)
    named = lambda values: F.struct(*(v.alias(n) for n, v in zip(MATRIX, values, strict=True)))
    out = pages.withColumn("_m", named([F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]))
    now = tuple(F.col(f"_m.{n}") for n in MATRIX)
    for text in rules:
        specs, ops = _split_rule(text)
        out = out.withColumn("_m", F.when(_hits(specs), named(multiply(now, placement(ops)))).otherwise(F.col("_m")))
    box = bounds(now, [F.col(c) for c in BOX])
    own = [c for c in pages.columns if c != "n_pages"]
    return out.select(*own, "_m.*", *(v.alias(f"b{c}") for c, v in zip(BOX, box, strict=True)))


def place_annots(annots: DataFrame, placed: DataFrame) -> DataFrame:
    """Annotations of placed pages: ax0 to ay1 become the box around the moved rectangle, and each point of
    quads (an array of x, y, x, y, ...) is moved; their drawn appearance no longer fits and goes."""
    m = tuple(F.col(c) for c in MATRIX)
    out = annots.join(placed.select("doc_id", "page_no", *MATRIX), ["doc_id", "page_no"])
    box = bounds(m, [F.col(c) for c in ("ax0", "ay0", "ax1", "ay1")])
    out = out.withColumns(dict(zip(("_0", "_1", "_2", "_3"), box, strict=True)))
    if "quads" in annots.columns:
        a, b, c, d, e, f = m
        q = F.col("quads")
        moved = F.transform(q, lambda v, i: F.when(i % 2 == 0, v * a + F.get(q, i + 1) * c + e).otherwise(F.get(q, i - 1) * b + v * d + f))
        out = out.withColumn("quads", moved)
    for i, c in enumerate(("ax0", "ay0", "ax1", "ay1")):
        out = out.withColumn(c, F.col(f"_{i}")).drop(f"_{i}")
    return out.drop("appearance", *MATRIX)


def overlay(pages: DataFrame, over: DataFrame, multi: bool = False, on_top: bool = True) -> DataFrame:
    """Layout of an overlay's page on every page, fitted to the page's box and centred.

    over: over_page (from 1, without gaps), ow, oh: one document of at most MAX_OVERLAY
    pages; none at all is an error. multi: its page i on page i, the last one on all
    further pages; else its first page. Adds over_page, z_order, fit (the scale), dx and dy.
    """
    n = over.count()
    if not 1 <= n <= MAX_OVERLAY:
        raise InvalidArgument(f"an overlay of 1 to {MAX_OVERLAY} pages, not {n}")
    out = pages.withColumn("over_page", F.least(F.col("page_no"), F.lit(n)) if multi else F.lit(1)).join(F.broadcast(over), "over_page")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = out.withColumn("fit", F.least(w / F.col("ow"), h / F.col("oh"))).withColumn("z_order", F.lit(1 if on_top else -1))
    return out.withColumn("dx", F.col("x0") + (w - F.col("ow") * F.col("fit")) / 2).withColumn("dy", F.col("y0") + (h - F.col("oh") * F.col("fit")) / 2)
