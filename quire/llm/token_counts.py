"""Operator 5: token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a linked list; a heap holds the adjacent pairs
that a merge joins, lowest rank first, leftmost among equals. Popping a pair
joins it and pushes the two pairs that the join makes. The count is the number
of initial symbols less the merges; no identifier is looked up.

Cases: a null text counts as empty: no token and no byte; special strings inside
texts count as one token each, as the library's default has it; empty texts have
no token; texts and pre-tokens of any length are counted whole; repeated rows are counted each; a
kept column whose name is that of an output column gives way to it; empty tables
give empty tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import MAX_VOCABULARY_BYTES
from .pretokens import MEMO, MEMO_CHARS, byte_letters, chunker, splitter
from .shared import bounded_batches


def read_merges(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """The merges in order of rank, and the special strings, of a tokenizer's JSON file."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    spec = json.loads(raw)
    split = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        raise ValueError(f"{path} isn't a byte-level BPE with the pattern of that kind")
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    return pairs, [t["content"] for t in spec.get("added_tokens", ())]


#: Bits of a symbol's number; a position has as many, or more where a pre-token is longer than that.
_BITS = 24


def merge_table(merges: Sequence[tuple[str, str]]) -> tuple[dict[str, int], dict[int, int]]:
    """The symbols' numbers, and pair of numbers -> rank and number of the joined symbol."""
    number: dict[str, int] = {}
    for c in byte_letters():
        number[c] = len(number)
    table: dict[int, int] = {}
    if 3 * len(merges) + len(number) > 1 << _BITS:
        raise ValueError(f"{len(merges)} merges are too many")
    for r, (a, b) in enumerate(merges):
        pair = number.setdefault(a, len(number)) << _BITS | number.setdefault(b, len(number))
        table.setdefault(pair, r << _BITS | number.setdefault(a + b, len(number)))
    return number, table


def count_symbols(symbols: Sequence[int], table: dict[int, int]) -> int:
    """How many symbols are left when no adjacent pair has a merge any more."""
    n = len(symbols)
    if n < 2:
        return n
    own = list(symbols)
    after = [*range(1, n), -1]
    before = list(range(-1, n - 1))
    find = table.get
    low = (1 << _BITS) - 1
    wide = max(_BITS, n.bit_length())  # a heap entry is a rank and then a position
    places = (1 << wide) - 1
    heap = [m >> _BITS << wide | i for i in range(n - 1) if (m := find(own[i] << _BITS | own[i + 1])) is not None]
    heapify(heap)
    left = n
    while heap:
        top = heappop(heap)
        i = top & places
        j = after[i]
        if j < 0 or own[i] < 0:
            continue
        m = find(own[i] << _BITS | own[j])
        if m is None or m >> _BITS != top >> wide:
            continue  # one of the two has been merged since
        own[i] = m & low
        own[j] = -1
        k = after[i] = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            if (m := find(own[i] << _BITS | own[k])) is not None:
                heappush(heap, m >> _BITS << wide | i)
        h = before[i]
        if h >= 0 and (m := find(own[h] << _BITS | own[i])) is not None:
            heappush(heap, m >> _BITS << wide | h)
    return left


class Counter:
    """Counts tokens; patterns and memo live in the worker."""

    def __init__(self, merges: Sequence[tuple[str, str]], special: Sequence[str], pattern: str):
        number, self.table = merge_table(merges)
        self.bytes = [number[c] for c in byte_letters()]
        self.special = list(special)
        self.pattern = pattern
        self.ready = None

    def __getstate__(self):
        return {**self.__dict__, "ready": None}

    def open(self):
        if self.ready is None:
            special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
            self.ready = chunker(self.pattern), splitter(self.pattern), self.bytes.__getitem__, {}, {}, special
        return self.ready

    def _chunk(self, chunk: str) -> int:
        _, split, number, _, known, _ = self.open()
        total = 0
        for p in split(chunk):
            n = known.get(p)
            if n is None:
                n = count_symbols(list(map(number, p.encode())), self.table)
                if len(p) <= MEMO_CHARS:
                    if len(known) >= MEMO:
                        known.clear()
                    known[p] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        cut, _, _, memo, _, _ = self.open()
        chunks = cut(text)
        if len(memo) > MEMO:
            memo.clear()
        missing = set(chunks).difference(memo)
        for c in missing:
            memo[c] = self._chunk(c)
        total = sum(map(memo.__getitem__, chunks))
        for c in missing:
            if len(c) > MEMO_CHARS:
                del memo[c]
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        special = self.open()[5]
        if special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return sum(self._plain(p) for p in special.split(text) if p) + sum(1 for _ in special.finditer(text))


def count_tokens(df: DataFrame, merges: Sequence[tuple[str, str]], special: Sequence[str], pattern: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes (UTF-8) and n_tokens."""
    spark = df.sparkSession
    bounded_batches(spark)
    kept = [c for c in keep if c.lower() not in ("n_bytes", "n_tokens")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])
    counter = spark.sparkContext.broadcast(Counter(merges, special, pattern))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        own = counter.value
        for batch in batches:
            texts = batch.column(len(kept))
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts = pa.array(map(own.count, texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], size, counts], names=schema.names)

    return df.select(*kept, df[text_col].alias("_text" if "_text" not in kept else "__text")).mapInArrow(run, schema)
