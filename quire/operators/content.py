"""Content: replace, normalize, inject, add_text, dump_text."""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.dimensions import lengths
from ..functions.text import drop_nonprinting, split_escaped
from ..pagespec import any_match, parse
from .pages import with_total

# executors need no copy of the package: what runs there is pickled by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: The characters that content streams read as white space, and those that end a token. Fixed values.
_WHITE = "\0\t\n\f\r "
_ENDS = "()<>[]{}/%"


def tokens(text: str) -> list[str]:
    """The tokens of a content stream: strings with nested brackets, hex strings, arrays' and dictionaries' marks, names, numbers, operators.

    Comments go. An inline image's data, up to its EI, is one token, as it stands.
    """
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        start = i
        if c in _WHITE:
            i += 1
            continue
        if c == "%":
            while i < n and text[i] not in "\r\n":
                i += 1
            continue
        if c == "(":
            depth = 0
            while i < n:
                depth += {"(": 1, ")": -1}.get(text[i], 0)
                i += 2 if text[i] == "\\" else 1
                if not depth:
                    break
        elif text[i : i + 2] in ("<<", ">>"):
            i += 2
        elif c == "<":
            i = text.find(">", i) + 1 or n
        elif c in "[]{})>":
            i += 1
        else:
            i += 1
            while i < n and text[i] not in _WHITE and text[i] not in _ENDS:
                i += 1
        out.append(text[start:i])
        if out[-1] == "ID":
            end = re.compile(r"\sEI(?=[\0\t\n\f\r ]|$)").search(text, i)
            out.append(text[i + 1 : end.start() if end else n])
            i = end.start() if end else n
    return out


def normalized(text: str) -> str:
    """One operator with its operands a line; arrays and dictionaries with spaces inside their marks."""
    lines, line, depth = [], [], 0
    own = iter(tokens(text))
    for t in own:
        line.append(t)
        depth += {"[": 1, "<<": 1, "]": -1, ">>": -1}.get(t, 0)
        if t == "BI" and not depth:
            # an inline image is one instruction
            for u in own:
                line.append(u)
                if u == "EI":
                    break
            lines.append(" ".join(line))
            line = []
        elif depth <= 0 and t not in ("true", "false", "null", "]", ">>") and (t[0].isalpha() or t[0] in "'\""):
            lines.append(" ".join(line))
            line, depth = [], 0
    return "\n".join([*lines, *([" ".join(line)] if line else [])])


def _rewritten(pages: DataFrame, column: str, hit: Column, change) -> DataFrame:
    """pages with change(text) where hit is true and the content isn't null: an Arrow step on the bare column."""
    rows = pages.withColumn("_hit", F.coalesce(hit & F.col(column).isNotNull(), F.lit(False))).drop("n_pages")
    schema = rows.drop("_hit").schema
    at, names = rows.columns.index(column), rows.drop("_hit").columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            *own, marks = batch.columns
            own[at] = pa.array([change(t) if m else t for t, m in zip(own[at].to_pylist(), marks.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(own, names=names)

    return rows.mapInArrow(run, schema)


def replace(pages: DataFrame, spec: str, column: str = "content", normalize: bool = False) -> DataFrame:
    """`pages/from/to/count`: the last character but digits is the delimiter; count 0 or none: all.

    Back references are written \\1; an empty from leaves the text as it is. With
    normalize, content is brought to one operator a line before and after, as the
    operation of that name on the command line has it. Without that and without a
    count the JVM's expressions do the work; else the pattern is compiled in an
    Arrow step, so that anchors and look-around see the whole text.
    """
    m = re.fullmatch(r"(.*?)(\D)(\d*)", spec, re.S)
    if not m:
        raise InvalidArgument(f"no delimiter: {spec!r}")
    parts = split_escaped(m[1], m[2])
    if len(parts) != 3:
        raise InvalidArgument(f"pages, from and to: {spec!r}")
    where, old, new = parts
    count = int(m[3] or 0)
    pages = with_total(pages)
    hit = any_match(parse(where or "-"), F.col("page_no"), F.col("n_pages"))
    if not old and not normalize:
        return pages.drop("n_pages")
    if not normalize and not count:
        java = re.sub(r"\\(\d)", r"$\1", new.replace("$", "\\$"))
        return pages.withColumn(column, F.when(hit, F.regexp_replace(column, old, java)).otherwise(F.col(column))).drop("n_pages")
    try:
        pattern = re.compile(old)
    except re.error as e:
        raise InvalidArgument(f"not a pattern: {old!r}: {e}") from None

    def change(text: str) -> str:
        text = normalized(text) if normalize else text
        text = pattern.sub(new, text, count=count) if old else text
        return normalized(text) if normalize else text

    return _rewritten(pages, column, hit, change)


def inject(pages: DataFrame, rules: Sequence[tuple[str, str, str]], column: str = "content") -> DataFrame:
    """(pages, head or tail, code) in order: heads first, each before what is there, then tails.

    A page that two specs of one rule select gets the code twice.
    """
    pages = with_total(pages)
    out = F.col(column)
    for kind in ("head", "tail"):
        for where, side, code in rules:
            if side not in ("head", "tail"):
                raise InvalidArgument(f"head or tail, not {side!r}")
            if side == kind:
                for s in parse(where):
                    hit = s.match_column(F.col("page_no"), F.col("n_pages"))
                    out = F.when(hit, F.concat(F.lit(code), out) if side == "head" else F.concat(out, F.lit(code))).otherwise(out)
    return pages.withColumn(column, out).drop("n_pages")


def normalize(pages: DataFrame, specs: str | Sequence[str] = "-", column: str = "content") -> DataFrame:
    """One operator with its operands a line on the selected pages; null content stays null."""
    pages = with_total(pages)
    chosen = parse(specs) if isinstance(specs, str) else [s for x in specs or ["-"] for s in parse(x)]
    return _rewritten(pages, column, any_match(chosen, F.col("page_no"), F.col("n_pages")), normalized)


def dump_text(pages: DataFrame, column: str = "content") -> DataFrame:
    """doc_id and the text of all its pages, joined by a form feed between line ends, without control characters."""
    rows = F.sort_array(F.collect_list(F.struct("page_no", drop_nonprinting(F.coalesce(F.col(column), F.lit(""))).alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\f\n").alias("text"))


#: Variables of text templates and the columns that hold them. Fixed names.
VARIABLES = {
    "page": "page_no",
    "total": "n_pages",
    "filename": "filename",
    "filename_base": "filename_base",
    "filepath": "filepath",
    "date": "date",
    "time": "time",
    "datetime": "datetime",
    "source_filename": "source_filename",
    "source_path": "source_path",
    "source_page": "source_page",
    "source_rotation": "source_rotation",
    "source_width": "source_width",
    "source_height": "source_height",
    "source_orientation": "source_orientation",
    "source_cropbox": "source_cropbox",
    "source_mediabox": "source_mediabox",
    "source_filesize": "source_filesize",
}
_NUMBERS = {"page", "total", "source_page", "source_rotation", "source_width", "source_height", "source_filesize"}


def template(text: str, columns: Sequence[str]) -> Column:
    """`{page+1:06d} of {total}`, `{meta:Title}` (a map column meta), `{{` and `}}` for braces; parsed once."""
    parts: list[Column] = []
    for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}|([^{}]+)|[{}]", text):
        if m[0] in ("{{", "}}"):
            parts.append(F.lit(m[0][0]))
        elif m[2] is not None:
            parts.append(F.lit(m[2]))
        elif m[1] is None:
            raise InvalidArgument(f"a lone brace in {text!r}")
        else:
            parts.append(_variable(m[1], columns))
    return F.concat(*parts) if parts else F.lit("")


def _variable(body: str, columns: Sequence[str]) -> Column:
    if body.startswith("meta:"):
        return F.coalesce(F.try_element_at("meta", F.lit(body[5:])), F.lit(""))
    m = re.fullmatch(r"(total-page|[a-z_]+?)([+-]\d+)?(?::(.+))?", body)
    if not m or (m[1] != "total-page" and m[1] not in VARIABLES):
        raise InvalidArgument(f"no such variable: {{{body}}}")
    if m[1] == "total-page":
        value, number = F.col("n_pages") - F.col("page_no"), True
    else:
        if VARIABLES[m[1]] not in columns:
            raise InvalidArgument(f"{m[1]} is unknown here")
        value, number = F.col(VARIABLES[m[1]]), m[1] in _NUMBERS
    if m[2]:
        if not number:
            raise InvalidArgument(f"{m[1]} isn't a number")
        value = value + int(m[2])
    return _formatted(value, m[3]) if m[3] else value.cast("string")


def _formatted(value: Column, spec: str) -> Column:
    """The format specs `0Nd`, `Nd`, `,`, `,d`, `<N`, `>N`, `.Nf`."""
    if m := re.fullmatch(r"0?(\d*)d", spec):
        return F.format_string(f"%{spec}", value.cast("long")) if m[1] else value.cast("string")
    if spec in (",", ",d"):
        return F.format_number(value, 0)
    if m := re.fullmatch(r"([<>])(\d+)", spec):
        text, n = value.cast("string"), int(m[2])
        padded = F.rpad(text, n, " ") if m[1] == "<" else F.lpad(text, n, " ")
        return F.when(F.length(text) >= n, text).otherwise(padded)
    if re.fullmatch(r"\.\d+f", spec):
        return F.format_string(f"%{spec}", value.cast("double"))
    raise InvalidArgument(f"no such format: {spec!r}")


def text_rule(word: str) -> tuple[str, str, dict[str, str]]:
    """`<pages>/text/(key=value, ...)`: pages, text and options. The delimiter is what stands before the options, no letter or digit."""
    word = word.strip()
    options: dict[str, str] = {}
    if word.endswith(")"):
        depth, at = 0, len(word)
        while at > 0:
            at -= 1
            depth += {")": 1, "(": -1}.get(word[at], 0)
            if not depth:
                break
        if not depth:
            for part in re.findall(r"""(?:[^,"']|"[^"]*"|'[^']*')+""", word[at + 1 : -1]):
                key, eq, value = part.partition("=")
                if not eq or not key.strip():
                    raise InvalidArgument(f"not an option: {part!r}")
                options[key.strip()] = value.strip().strip("'\"")
            word = word[:at].strip()
    if not word or word[-1].isalnum() or word[-1] in "()":
        raise InvalidArgument(f"no delimiter at the end of {word!r}")
    first = word.index(word[-1])
    if first == len(word) - 1:
        raise InvalidArgument(f"only one delimiter in {word!r}")
    return word[:first].strip() or "-", word[first + 1 : -1], options


#: Options of a text. Fixed names.
TEXT_OPTIONS = ("position", "x", "y", "offset-x", "offset-y", "rotate", "align", "font", "size", "color")


def _colour(text: str) -> list[float]:
    """One number is grey, three are red, green and blue, four have opacity."""
    try:
        parts = [float(x) for x in re.split(r"[ ,]+", text.strip())]
    except ValueError:
        raise InvalidArgument(f"not a colour: {text!r}") from None
    if len(parts) not in (1, 3, 4):
        raise InvalidArgument(f"1, 3 or 4 numbers make a colour: {text!r}")
    return parts * 3 if len(parts) == 1 else parts


def add_text(pages: DataFrame, rules: Sequence[str | tuple[str, str, str]], size: float = 12.0, styled: bool = False) -> DataFrame:
    """Rules in order, each `<pages>/text/(options)` or (pages, template, position): one row for each text of a page: rule, text, x, y, align.

    Positions are `top-left` to `bottom-right` with `mid` and `center`, or x and y,
    and offsets add to them. The width of a text depends on a font, so align says
    which of its ends stands at x. With styled: font, size, color and rotate, too.
    """
    pages = with_total(pages)
    made, qualifier = [], None
    for i, rule in enumerate(rules):
        if isinstance(rule, str):
            if rule.lower() in ("even", "odd"):
                qualifier = rule.lower()
                continue
            where, text, options = text_rule(rule)
        else:
            where, text, options = rule[0], rule[1], {"position": rule[2]}
        wrong = set(options) - set(TEXT_OPTIONS)
        if wrong:
            raise InvalidArgument(f"no such options: {sorted(wrong)}")
        words = set(options.get("position", "center").split("-"))
        points = float(options.get("size", size))
        w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        if {"x", "y"} & set(options):
            x, y = lengths(options.get("x", ""), w), lengths(options.get("y", ""), h)
            words = {"left", "bottom"}
        else:
            x = F.lit(0.0) if "left" in words else w if "right" in words else w / 2
            y = h - points if "top" in words else F.lit(0.0) if "bottom" in words else h / 2 - points / 2
        x, y = x + lengths(options.get("offset-x", ""), w), y + lengths(options.get("offset-y", ""), h)
        align = options.get("align", "left" if "left" in words else "right" if "right" in words else "center")
        hit = any_match(parse(where or "-"), F.col("page_no"), F.col("n_pages"))
        if qualifier:
            hit, qualifier = hit & (F.col("page_no") % 2 == (0 if qualifier == "even" else 1)), None
        style = []
        if styled:
            colour = F.array(*(F.lit(v) for v in _colour(options.get("color", "0"))))
            style = [F.lit(options.get("font", "Helvetica")).alias("font"), F.lit(points).alias("size"), colour.alias("color"), F.lit(float(options.get("rotate", 0))).alias("rotate")]
        made.append(F.when(hit, F.struct(F.lit(i).alias("rule"), template(text, pages.columns).alias("text"), x.alias("x"), y.alias("y"), F.lit(align).alias("align"), *style)))
    if qualifier:
        raise InvalidArgument(f"no rule after {qualifier!r}")
    return pages.select("doc_id", "page_no", F.inline(F.array_compact(F.array(*made))))
