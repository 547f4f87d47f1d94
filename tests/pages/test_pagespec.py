"""The page-selection language: truth tables, equivalences, and compiled columns against plain Python."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.errors import InvalidArgument
from quire.pagespec import any_match, parse, parse_one, split


@pytest.mark.parametrize(
    "spec, total, start, end, rotate, scale, parity, omitted",
    [
        ("1-5", 10, 1, 5, None, 1, set(), []),
        ("", 10, 1, 10, None, 1, set(), []),
        ("end", 7, 7, 7, None, 1, set(), []),
        ("r3-end", 9, 7, 9, None, 1, set(), []),
        ("6-2", 9, 6, 2, None, 1, set(), []),
        ("rend-r1", 4, 1, 4, None, 1, set(), []),
        ("r0", 10, 11, 11, None, 1, set(), []),
        ("3-", 10, 3, 3, None, 1, set(), []),
        ("-", 10, 1, 10, None, 1, set(), []),
        ("oddeast", 10, 1, 10, (90, False), 1, {"odd"}, []),
        ("2right", 10, 2, 2, (90, True), 1, set(), []),
        ("1-4x0.5z2", 10, 1, 4, None, 1, set(), []),
        ("z-1", 10, 1, 10, None, 1 / math.sqrt(2), set(), []),
        ("r5-r1evenleftx2~7~9-8", 10, 6, 10, (-90, True), 2, {"even"}, [(7, 7), (9, 8)]),
    ],
)
def test_parse(spec, total, start, end, rotate, scale, parity, omitted):
    s = parse_one(spec)
    assert (s.start.of(total), s.end.of(total), s.rotate, s.parity) == (start, end, rotate, parity)
    assert s.scale == pytest.approx(scale) and [(a.of(total), b.of(total)) for a, b in s.omissions] == omitted


@pytest.mark.parametrize("spec", ["0", "0-5", "-5", "3foo", "1~x", "x0", "x-1", "[1,2", "[1]even,3"])
def test_errors(spec):
    with pytest.raises(InvalidArgument):
        parse(spec)


def test_groups_and_handles():
    assert split("[1,3-4]left") == ["1left", "3-4left"] and split("1,3-4") == ["1", "3-4"]
    a, b, c = parse(["A2", "b", "_3"], {"A": 0, "B": 0})
    assert (a.handle, b.handle, c.handle) == ("A", "B", None) and c.start.of(9) == 3
    assert parse_one("east", {"E": 0}).rotate == (90, False)


@pytest.mark.parametrize("one, other", [("~4-5", ["1-3", "6-8"]), ("2-end~4-5~end", ["2-3", "6-7"]), ("2-7even", ["2", "4", "6"]), ("1-3,6", ["1-3", "6"])])
def test_equivalences(one, other):
    pages = lambda specs: [p for s in parse(specs) for p in s.pages(8)]
    assert pages(one) == pages(other)


def test_out_of_range():
    with pytest.raises(InvalidArgument):
        parse_one("9").pages(8)
    assert not any(parse_one("9").matches(p, 8) for p in range(1, 9))


bound = st.one_of(st.integers(1, 12).map(str), st.integers(1, 12).map(lambda n: f"r{n}"), st.just("end"), st.just("rend"))
ranges = st.one_of(st.just(""), bound, st.tuples(bound, bound).map("-".join))
specs = st.tuples(ranges, st.sampled_from(["", "even", "odd"]), st.sampled_from(["", "left", "south"]), st.lists(st.tuples(bound, bound).map(lambda x: "~" + "-".join(x)), max_size=2).map("".join)).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(specs, min_size=1, max_size=12))
def test_columns_as_python(spark, texts):
    parsed = [parse_one(t) for t in texts]
    docs = spark.range(1, 11).select(F.col("id").cast("int").alias("n"))
    row = docs.select("n", *(s.sequence_column(F.col("n"), strict=False).alias(f"s{i}") for i, s in enumerate(parsed))).collect()
    hits = docs.select("n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("p")).select("n", "p", any_match(parsed, F.col("p"), F.col("n")).alias("hit")).collect()
    for r in row:
        for i, s in enumerate(parsed):
            try:
                want = s.pages(r.n)
            except InvalidArgument:
                want = []
            assert list(r[f"s{i}"]) == want
    assert all(r.hit == any(s.matches(r.p, r.n) for s in parsed) for r in hits)
