"""Text functions of reports and metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities of XML text; the ampersand comes first. Fixed values.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def drop_nonprinting(text: Column) -> Column:
    """Without control characters, but for line feeds and carriage returns."""
    return F.regexp_replace(text, r"[\x00-\x09\x0B\x0C\x0E-\x1F\x{80}-\x{9F}]", "")


def xml_encode(text: Column) -> Column:
    """Entities for the five special characters, numbers for DEL and beyond ASCII; other control characters go."""
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    # most texts are ASCII; only the others are searched for what needs a number
    ascii_only = (F.length(text) == F.octet_length(text)) & ~F.contains(text, F.lit("\x7f"))
    others = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7E]"), F.lit(0)))
    coded = F.aggregate(others, text, lambda t, c: F.replace(t, c, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))))
    return drop_nonprinting(F.when(ascii_only, text).otherwise(coded))


def xml_decode(text: Column) -> Column:
    """The inverse, in one scan from the left, so that nothing is decoded twice."""
    parts = F.regexp_extract_all(text, F.lit(r"&#[0-9]{1,7};|&(?:amp|lt|gt|quot|apos);|[^&]+|&"), F.lit(0))

    def plain(part: Column) -> Column:
        out = F.when(part.rlike(r"^&#[0-9]{1,7};$"), _character(F.regexp_extract(part, "[0-9]+", 0)))
        for sign, entity in ENTITIES:
            out = out.when(part == entity, F.lit(sign))
        return out.otherwise(part)

    return F.when(F.instr(text, "&") == 0, text).otherwise(F.array_join(F.transform(parts, plain), ""))


def decode_all(df):
    """df with every string, and every string in arrays and map values, decoded."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "string":
            out[name] = xml_decode(F.col(name))
        elif kind == "array<string>":
            out[name] = F.transform(name, xml_decode)
        elif kind.startswith("map<") and kind.endswith(",string>"):
            out[name] = F.transform_values(name, lambda _, v: xml_decode(v))
    return df.withColumns(out) if out else df


def _character(number: Column) -> Column:
    """The character of a code point, by its bytes in UTF-32."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")


def number_text(x: Column) -> Column:
    """As few digits as tell the number apart, with thousands separators; whole numbers have no fraction."""
    small = (x > -1000) & (x < 1000) & (x == F.floor(x))  # no separators, no fraction: read off
    digits = F.abs(x).cast("string").cast("decimal(38,18)").cast("string")
    fraction = F.regexp_replace(F.substring_index(digits, ".", -1), "0+$", "")
    whole = F.format_number(F.substring_index(digits, ".", 1).cast("decimal(20,0)"), 0)
    said = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), whole, F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)))
    return F.when(small, x.cast("int").cast("string")).otherwise(said)


def short_number(x: Column) -> Column:
    """To four places, without trailing zeros and separators."""
    return F.regexp_replace(F.regexp_replace(F.round(x.cast("decimal(38,18)"), 4).cast("decimal(38,4)").cast("string"), r"0+$", ""), r"\.$", "")


def rectangle_text(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The corners of an upright box, least first."""
    return F.concat_ws(" ", *(number_text(c) for c in (F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))))


def compact_json(text: Column) -> Column:
    """Innermost arrays, then innermost objects, on one line: one space for each run of white space in them, none at their ends."""
    for start, end in ("[]", "{}"):
        simple = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\{start}[^\{start}\{end}]*\{end}"), F.lit(0)))
        line = lambda m: F.trim(F.regexp_replace(F.substring(m, 2, 1 << 30), r"\s+", " "))
        flat = lambda m: F.concat(F.lit(start), F.trim(F.regexp_replace(line(m), rf"\{end}$", "")), F.lit(end))  # noqa: E731, B023
        text = F.aggregate(simple, text, lambda t, m: F.replace(t, m, flat(m)))  # noqa: B023
    return text


def hex_id(data: Column) -> Column:
    return F.lower(F.hex(data))


def split_escaped(text: str, mark: str) -> list[str]:
    """Split at a character, but not where a backslash stands before it; on the driver."""
    out, now, i = [], "", 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] == mark:
            now, i = now + mark, i + 2
        elif text[i] == mark:
            out.append(now)
            now, i = "", i + 1
        else:
            now, i = now + text[i], i + 1
    return [*out, now]


def fix_mojibake(df, column: str):
    """Bytes as text: UTF-8 where they are that, else Windows-1252, else Latin-1; a text whose characters are such bytes is read
    again as UTF-8, where that is possible, and stays as it is elsewhere (an Arrow step)."""
    schema = df.drop(column).schema.add(column, "string")
    names = df.columns

    def run(batches):
        import pyarrow as pa

        def read(b):
            for name in ("utf-8", "cp1252"):
                try:
                    return bytes(b).decode(name)
                except UnicodeDecodeError:
                    continue
            return bytes(b).decode("latin-1")

        def again(text):
            for name in ("cp1252", "latin-1"):
                try:
                    return text.encode(name).decode("utf-8")
                except UnicodeError:
                    continue
            return text

        def fixed(value):
            return None if value is None else again(value) if isinstance(value, str) else read(value)

        at = names.index(column)
        for batch in batches:
            done = pa.array(map(fixed, batch.column(at).to_pylist()), pa.string())
            others = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*others, done], names=schema.names)

    return df.mapInArrow(run, schema)
