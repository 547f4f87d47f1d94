"""Splitting texts for byte-level BPE.

A text is first cut into chunks that no match of the pre-token pattern can
cross: an optional space with the non-space run after it, or a run of white
space. Chunks repeat, so each worker splits and merges a chunk once and keeps
the result in a memo of bounded size.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable

import public_tokenizers
import regex

#: The pattern that chunks and short cuts are right for.
KNOWN = public_tokenizers.PATTERN
#: White_Space of Unicode: what \s means to the tokenizer libraries. Fixed values.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Entries that a worker's memo may have; it is emptied when it is full.
MEMO = 400_000
#: Longer chunks aren't kept.
MEMO_CHARS = 64


def chunker(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into chunks; under another pattern than KNOWN a text is one chunk."""
    return re.compile(_CHUNK).findall if pattern == KNOWN else lambda text: [text]


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a chunk into its pre-tokens: findall of the pattern, with \\s and \\S as the
    libraries read them. Under the KNOWN pattern letters after an optional space, and one
    comma, full stop or such after them, need no search."""
    exact = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]")
    search = regex.compile(exact).findall
    if pattern != KNOWN:
        return search

    def split(chunk: str) -> list[str]:
        at = chunk[:1] == " "
        if chunk[at:].isalpha():
            return [chunk]
        if chunk[-1] in ",.;:!?" and chunk[at:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return search(chunk)

    return split


def speller() -> Callable[[str], str]:
    """Text -> its UTF-8 bytes in byte letters."""
    table, decode = "".join(byte_letters()), codecs.charmap_decode
    return lambda text: decode(text.encode(), "strict", table)[0]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]
