"""The scalar layer against golden tables."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import text
from textmill.functions.analyzer import STOP_WORDS, Analyzer


def value(spark, column, x):
    return spark.createDataFrame([(x,)], "x string").select(column).first()[0]


@pytest.mark.parametrize(
    ("given", "tokens"),
    [
        ("Learn C++ in 24_hours", ["learn", "c", "in", "24_hours"]),
        ("café Über-cool", ["caf", "ber", "cool"]),
        ("It's 4.50", ["it", "s", "4", "50"]),
        ("   ", []),
        ("", []),
        ("Kelvin a_1-B", ["elvin", "a_1", "b"]),
        (None, None),
    ],
)
def test_tokenize(spark, given, tokens):
    assert value(spark, text.tokenize("x"), given) == tokens


def test_other_tokenizers(spark):
    assert value(spark, text.tokenize_unicode("x"), "Café Ü_b-9") == ["café", "ü_b", "9"]
    assert value(spark, text.tokenize_legacy("x"), "Café Ü_b-9") == ["café", "Ü", "b", "9"]


STEMS = """running run run|flying fl fly|studying stud study|dying dy dy|tried tri tri|flies fly fly|carried carri carri
glass glas glass|cats cat cat|quickly quick quick|worked work work|this thi thi|was was was|falling fall fall|string str str|bed bed bed|king king king"""


@pytest.mark.parametrize("row", STEMS.replace("\n", "|").split("|"))
def test_stemmers(spark, row):
    word, plain, fast = row.split()
    assert value(spark, text.stem("x"), word) == plain
    assert value(spark, text.stem_fast("x"), word) == fast


@pytest.mark.parametrize(("number", "shown"), [(5.0, "5"), (299.99, "299.99"), (1e10, "10000000000"), (1e-5, "0.00001"), (0.1, "0.1"), (100.0, "100"), (-2.5, "-2.5"), (0.0, "0")])
def test_num_to_text(spark, number, shown):
    assert spark.createDataFrame([(number,)], "x double").select(text.num_to_text("x")).first()[0] == shown


def test_numbers_of_texts(spark):
    assert value(spark, text.to_number("x"), "4.5") == 4.5
    assert value(spark, text.to_number("x"), "abc") is None


def test_within(spark):
    def near(a, b, k):
        return spark.range(1).select(text.within(F.lit(a), F.lit(b), k)).first()[0]

    assert near("machne", "machine", 1) and near("same", "same", 0)
    assert not near("machne", "machine", 0) and not near("a", "abcd", 2)


def test_stop_words_and_stems(spark):
    assert len(STOP_WORDS) == 37
    assert value(spark, Analyzer().tokens(F.col("x")), "The cat and this DOG") == ["cat", "dog"]
    # stop words are compared after stemming
    assert value(spark, Analyzer.make(stem=True).tokens(F.col("x")), "this running") == ["thi", "run"]
    assert value(spark, Analyzer.make(stop_words=["Cat"]).tokens(F.col("x")), "the cat") == ["the"]
    assert value(spark, Analyzer.make(tokenizer=lambda c: F.split(c, ",")).tokens(F.col("x")), "A b, c,the") == ["a b", "c"]
