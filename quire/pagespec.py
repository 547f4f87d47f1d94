"""The page-selection language, parsed once on the driver and compiled to columns.

A spec is a range (`3`, `2-end`, `r3-r1`, `5-1`; empty: all pages), then any of
`even`, `odd`, a rotation word, a scale (`x1.5`, `z-1`), and omissions (`~2-3`).
`[1,3]left` deals a modifier out to several ranges and `1,3-4` lists ranges; a
letter in front names an input. Numbers that count from the end depend on the
number of pages, which is a column, so a spec compiles without reading data.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import InvalidArgument

#: word -> (angle, whether it adds to the page's own). Fixed values.
ROTATIONS = {"north": (0, False), "east": (90, False), "south": (180, False), "west": (270, False), "left": (-90, True), "right": (90, True), "down": (180, True)}

_BOUND = r"(?:(r)(?!ight))?(end|\d+)?"
_RANGE = re.compile(rf"{_BOUND}(-{_BOUND})?")


@dataclass(frozen=True)
class Bound:
    """A page counted from the first (n), or from the last (n-th from the end, 1 being the last)."""

    n: int
    from_end: bool = False

    def of(self, total: int) -> int:
        return total - self.n + 1 if self.from_end else self.n

    def column(self, total: Column) -> Column:
        return (total - (self.n - 1)) if self.from_end else F.lit(self.n)


FIRST, LAST = Bound(1), Bound(1, True)
Range = tuple[Bound, Bound]


@dataclass(frozen=True)
class PageSpec:
    start: Bound = FIRST
    end: Bound = LAST
    rotate: tuple[int, bool] | None = None
    scale: float = 1.0
    parity: frozenset[str] = frozenset()
    omissions: tuple[Range, ...] = ()
    handle: str | None = None
    text: str = field(default="", compare=False)

    def pages(self, total: int) -> list[int]:
        """The selected pages in order, on the driver; a page that isn't there is an error."""
        a, b = self.start.of(total), self.end.of(total)
        if not (1 <= a <= total and 1 <= b <= total):
            raise InvalidArgument(f"{self.text!r} selects a page out of range 1-{total}")
        return [p for p in range(a, b + (1 if a <= b else -1), 1 if a <= b else -1) if self._kept(p, total)]

    def matches(self, page: int, total: int) -> bool:
        a, b = sorted((self.start.of(total), self.end.of(total)))
        return a <= page <= b and self._kept(page, total)

    def _kept(self, page: int, total: int) -> bool:
        if "even" in self.parity and page % 2 or "odd" in self.parity and page % 2 == 0:
            return False
        return not any(min(x.of(total), y.of(total)) <= page <= max(x.of(total), y.of(total)) for x, y in self.omissions)

    def kept_column(self, page: Column, total: Column) -> Column:
        """Whether parity and omissions let the page through."""
        out = F.lit(True)
        if "even" in self.parity:
            out = out & (page % 2 == 0)
        if "odd" in self.parity:
            out = out & (page % 2 == 1)
        for x, y in self.omissions:
            a, b = x.column(total), y.column(total)
            out = out & ~page.between(F.least(a, b), F.greatest(a, b))
        return out

    def match_column(self, page: Column, total: Column) -> Column:
        """Set semantics: a page that isn't there is passed over."""
        a, b = self.start.column(total), self.end.column(total)
        return page.between(F.least(a, b), F.greatest(a, b)) & self.kept_column(page, total)

    def sequence_column(self, total: Column, strict: bool = True) -> Column:
        """The selected pages in order as an array; out of range: an error, or with strict=False nothing."""
        a, b = self.start.column(total), self.end.column(total)
        fits = a.between(1, total) & b.between(1, total)
        pages = F.filter(F.sequence(a.cast("int"), b.cast("int")), lambda p: self.kept_column(p, total))
        otherwise = F.raise_error(F.concat(F.lit(f"{self.text!r} selects a page out of range 1-"), total.cast("string"))).cast("array<int>") if strict else F.array().cast("array<int>")
        return F.when(fits, pages).otherwise(otherwise)


def _bound(reverse: str | None, word: str | None) -> Bound | None:
    if word is None:
        return None
    if word == "end":
        return FIRST if reverse else LAST
    return Bound(int(word), bool(reverse))


def _range(text: str) -> tuple[Range, str]:
    m = _RANGE.match(text)
    a, b = _bound(m[1], m[2]), _bound(m[4], m[5])
    rest = text[m.end() :]
    for x in (a, b):
        if x is not None and x.n == 0 and not x.from_end:
            raise InvalidArgument(f"page 0 in {text!r}")
    if a is None and b is not None:
        raise InvalidArgument(f"{text!r} has an end without a start")
    if a is None:
        return (FIRST, LAST), rest
    return (a, b if b is not None else a), rest


def _number(text: str, mark: str) -> tuple[float | None, str]:
    m = re.search(rf"{mark}([+-]?\d*\.?\d+)", text)
    if not m:
        return None, text
    return float(m[1]), text[: m.start()] + text[m.end() :]


def parse_one(text: str, handles: Mapping[str, object] | None = None) -> PageSpec:
    """A spec without brackets and commas."""
    s, handle = text.strip(), None
    if handles and s[:1].isalpha() and s[:1].upper() in handles and not re.match(r"(?i)(end|even|east|r\d|rend|right)", s):
        handle, s = s[0].upper(), s[1:]
    elif s[:1] == "_":
        handle, s = ("_" if handles and "_" in handles else None), s[1:]
    s = s.lower()
    (a, b), rest = _range(s)
    mods, tilde, omit = rest.partition("~")
    parity = set()
    omitted: list[Range] = []
    for part in omit.split("~") if tilde else ():
        for word in ("even", "odd"):
            if word in part:
                parity.add(word)
                part = part.replace(word, "", 1)
        if part:
            own, left = _range(part)
            if left:
                raise InvalidArgument(f"can't read {left!r} in {text!r}")
            omitted.append(own)
    for word in ("even", "odd"):
        if word in mods:
            parity.add(word)
            mods = mods.replace(word, "", 1)
    rotate = None
    for word, turn in ROTATIONS.items():
        if word in mods:
            rotate, mods = turn, mods.replace(word, "", 1)
            break
    x, mods = _number(mods, "x")
    z, mods = _number(mods, "z")
    if x is not None and x <= 0:
        raise InvalidArgument(f"a scale must be above zero: {text!r}")
    if mods.strip():
        raise InvalidArgument(f"can't read {mods!r} in {text!r}")
    return PageSpec(a, b, rotate, (x or 1.0) * math.sqrt(2) ** (z or 0.0), frozenset(parity), tuple(omitted), handle, text)


def split(text: str) -> list[str]:
    """Brackets dealt out and commas split: `[1,3]left` is `1left`, `3left`."""
    m = re.fullmatch(r"([^\[\]]*)\[([^\[\]]*)\]([^\[\]]*)", text)
    if m:
        if "," in m[3]:
            raise InvalidArgument(f"a comma after a bracket: {text!r}")
        return [f"{m[1]}{part.strip()}{m[3]}" for part in m[2].split(",")]
    if "[" in text or "]" in text:
        raise InvalidArgument(f"unbalanced brackets: {text!r}")
    return [part.strip() for part in text.split(",")]


def parse(texts: str | Sequence[str], handles: Mapping[str, object] | None = None) -> list[PageSpec]:
    """All specs of the given texts."""
    return [parse_one(p, handles) for t in ([texts] if isinstance(texts, str) else texts) for p in split(t)]


def any_match(specs: Sequence[PageSpec], page: Column, total: Column) -> Column:
    out = F.lit(False)
    for s in specs:
        out = out | s.match_column(page, total)
    return out


def fold(specs: Sequence[PageSpec], start: Column, step: Callable[[Column, PageSpec], Column], page: Column, total: Column) -> Column:
    """start, changed by step for every spec that matches the page, in order."""
    for s in specs:
        start = F.when(s.match_column(page, total), step(start, s)).otherwise(start)
    return start
