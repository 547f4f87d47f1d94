"""Operator 1: byte-level BPE encoding and decoding.

The ranks of a vocabulary become a sentencepiece BPE model, serialised here
field by field: every token is a piece of byte letters whose score is its
negative rank, and normalisation is the identity. Merging the best-scored pair
first is then merging the lowest rank first. Each pre-token is encoded by
itself; decoding maps ids back to the tokens' bytes.

Cases: a null text counts as empty (no ids, empty bytes); empty texts give no
ids; very long texts and pre-tokens go through whole; repeated rows are encoded
each; null ids decode to empty bytes; a kept column whose name is that of an
output column gives way to it; empty tables give empty tables.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pretokens import MEMO, MEMO_CHARS, byte_letters, chunker, speller, splitter
from .shared import bounded_batches

#: A vocabulary file is broadcast; larger ones are refused.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file (base64 token, space, rank)."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _blob(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose ids are the ranks; the unknown piece comes last.

    Ranks must be 0, 1, 2, ... and all 256 single bytes must be tokens, so that
    nothing is unknown.
    """
    letters = byte_letters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be gapless from 0")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must be a token")
    pieces = [_blob(1, "".join(letters[b] for b in t).encode()) + struct.pack("<Bf", 2 << 3 | 5, -float(r)) + _number(3, 1) for r, t in enumerate(tokens)]
    pieces.append(_blob(1, b"<no token>") + struct.pack("<Bf", 2 << 3 | 5, 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _blob(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(_blob(1, p) for p in pieces) + _blob(2, trainer) + _blob(3, normalizer)


class Codec:
    """Encodes and decodes; the libraries' objects and the memo live in the worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.model = piece_model(ranks)
        self.pattern = pattern
        self.ready = None

    def __getstate__(self):
        return {**self.__dict__, "ready": None}

    def open(self):
        if self.ready is None:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            self.ready = sp, chunker(self.pattern), splitter(self.pattern), speller(), {}, {}
        return self.ready

    def _learn(self, chunks: list[str], memo: dict[str, bytes], known: dict[str, bytes]) -> None:
        """Put the packed ids of these chunks into memo, and those of their pre-tokens into known."""
        sp, _, split, spell, _, _ = self.open()
        parts = list(map(split, chunks))
        new = list(set(chain.from_iterable(parts)).difference(known))
        if len(known) + len(new) > MEMO:
            known.clear()
            new = list(set(chain.from_iterable(parts)))
        for p, ids in zip(new, sp.encode(list(map(spell, new)), num_threads=1), strict=True):
            known[p] = array("i", ids).tobytes()
        for c, own in zip(chunks, parts, strict=True):
            memo[c] = known[c] if len(own) == 1 else b"".join(map(known.__getitem__, own))
        for p in new:
            if len(p) > MEMO_CHARS:
                del known[p]

    def encode(self, text: str | None) -> bytes:
        """The ids, packed as 32-bit numbers."""
        if not text:
            return b""
        _, cut, _, _, memo, known = self.open()
        chunks = cut(text)
        missing = list(set(chunks).difference(memo))
        if missing and len(memo) + len(missing) > MEMO:
            memo.clear()
            missing = list(set(chunks))
        if missing:
            self._learn(missing, memo, known)
        out = b"".join(map(memo.__getitem__, chunks))
        if missing:
            for c in missing:
                if len(c) > MEMO_CHARS:
                    del memo[c]
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _shape(df: DataFrame, keep: Sequence[str], new: Sequence[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name.lower() for f in new}
    kept = [c for c in keep if c.lower() not in names]
    return kept, T.StructType([df.schema[c] for c in kept] + list(new))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """keep columns, ids array<int>, and with decoded=True the bytes that decoding the ids gives."""
    spark = df.sparkSession
    bounded_batches(spark)
    new = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        new.append(T.StructField("decoded", T.BinaryType(), False))
    kept, schema = _shape(df, keep, new)
    codec = spark.sparkContext.broadcast(Codec(ranks, pattern))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = codec.value
        for batch in batches:
            packed = [own.encode(t) for t in batch.column(len(kept)).to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            cols = [*batch.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(offsets), values)]
            if decoded:
                cols.append(pa.array([own.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select(*kept, df[text_col].alias("_text" if "_text" not in kept else "__text")).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep columns and decoded: the bytes of the ids. An id outside the vocabulary fails the job."""
    spark = df.sparkSession
    bounded_batches(spark)
    kept, schema = _shape(df, keep, [T.StructField("decoded", T.BinaryType(), False)])
    tokens = spark.sparkContext.broadcast(sorted(ranks, key=ranks.__getitem__))

    def run(batches):
        import pyarrow as pa

        own = tokens.value
        for batch in batches:
            out = [b"".join(map(own.__getitem__, ids or ())) for ids in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.binary())], names=schema.names)

    return df.select(*kept, df[ids_col].alias("_ids" if "_ids" not in kept else "__ids")).mapInArrow(run, schema)
