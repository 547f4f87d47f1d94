import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, score string, shard string, label string, rule int"

#: Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns with names that the operators use themselves.
ODD = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "src1"),
    (1, "one two three four five six seven eight nine ten eleven", "en", "src1"),
    (2, None, None, None),
    (None, "no id here but words enough to be a text of some length", "de", ""),
    (None, None, None, None),
    (3, "", "en", "src2"),
    (4, " \n\t ", "en", "src2"),
    (5, "x", "fr", "x"),
    (6, "words " * 30_000, "en", "src1"),
    (7, "a" * 50_000, "en", "src9"),
    (8, "naïve café – 日本語 😀 <|endoftext|> #$% it's", "fr", "src3"),
    (9, "one two three four five six seven eight nine ten eleven", "en", "src3"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "w", 3) for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
