"""Operators 1 and 5 against the libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe, queries, token_counts
from tests.conftest import SMALL

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
CODEC = bpe.Codec(RANKS, P.PATTERN)
COUNTER = token_counts.Counter(*token_counts.read_merges(P.path("byte_bpe_50k.json")), P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 '’sdtll.,19½²the"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_as_the_libraries(text):
    own = ids(CODEC.encode(text))
    assert own == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(own) == text.encode()
    assert COUNTER.count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_special_strings_and_long_pretokens():
    rng = random.Random(3)
    for text in ("<|endoftext|>a <|endoftext|><|endoftext|>", "a" * 20_000, "ab " * 7_000 + " " * 3_000, "".join(rng.choice("aeiouthn ") for _ in range(30_000))):
        assert ids(CODEC.encode(text)) == LIBRARY.encode_ordinary(text)
        assert COUNTER.count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_positions_beyond_a_symbols_bits(monkeypatch):
    """A pre-token of more symbols than a symbol's number has values is counted whole."""
    whole = token_counts.count_symbols([0] * 3_000, {0: 1, 1 << 24 | 1: 1 << 24 | 2})
    assert whole == 3_000 // 4
    monkeypatch.setattr(token_counts, "_BITS", 9)
    assert token_counts.count_symbols([0] * 3_000, {0: 1, 1 << 9 | 1: 1 << 9 | 2}) == whole
    with pytest.raises(ValueError):
        token_counts.merge_table([("a", "b")] * 200)


def test_other_patterns():
    """Chunks and short cuts hold for one pattern only; others split whole texts."""
    pattern = r"[ab]+|\S|\s+"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    codec = bpe.Codec(RANKS, pattern)
    for text in ("abba there, and  abab!", "hello. abcab", ""):
        assert ids(codec.encode(text)) == own.encode_ordinary(text)


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        bpe.piece_model({bytes([b]): b for b in range(255)})
    with pytest.raises(ValueError):
        bpe.piece_model({bytes([b]): b + 1 for b in range(256)})


def test_queries(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op1_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in queries.op5_token_counts(spark, SMALL).collect():
        n = len(TOKENIZER.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_odd_rows(odd, none):
    out = bpe.encode(odd, RANKS, P.PATTERN, keep=("doc_id", "text", "n_tokens"), decoded=True)
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    back = bpe.decode(out.drop("decoded"), RANKS, keep=("text",)).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    counts = token_counts.count_tokens(odd, *token_counts.read_merges(P.path("byte_bpe_50k.json")), P.PATTERN, keep=("text", "n_tokens")).collect()
    assert all(r.n_tokens == len(TOKENIZER.encode(r.text or "").ids) for r in counts)
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, *token_counts.read_merges(P.path("byte_bpe_50k.json")), P.PATTERN).count() == 0
