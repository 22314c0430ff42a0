import pytest
from pyspark.sql import functions as F

from leafscan.functions import similarity
from leafscan.functions.colors import channels
from leafscan.functions.tokens import box_of_title, cache_hash, split_words, without_markers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def words(text):
    return split_words(F.lit(text))


@pytest.mark.parametrize(("a", "b", "expected"), [("hello world", "hello world", 1.0), ("hello world", "hello universe", 0.5), ("a b", "a b c d", 0.5), ("", "", 1.0), ("", "a", 0.0)])
def test_positional(spark, a, b, expected):
    assert value(spark, similarity.positional(words(a), words(b))) == expected


@pytest.mark.parametrize(("a", "b", "expected"), [("abc", "abc", 1.0), ("abc", "xabcx", 0.8), ("abcd", "dcxa", 0.75), ("zz", "az", 1.0)])
def test_word_similarity(spark, a, b, expected):
    assert value(spark, similarity.word_similarity(F.lit(a), F.lit(b))) == pytest.approx(expected)


def test_fuzzy_sequence(spark):
    found = value(spark, similarity.fuzzy_similarity(words("voltag regulatr circit"), words("voltage regulator circuit")))
    assert found == pytest.approx(0.848)


@pytest.mark.parametrize(("word", "wanted", "expected"), [("Hello,", "hello", True), ("of", "o", True), ("offers", "o", False), ("circuits", "circuit", True), ("it", "circuit", True), ("xy", "circuit", False), ("regulatox", "regulator", True)])
def test_words_match(spark, word, wanted, expected):
    assert value(spark, similarity.words_match(F.lit(word), F.lit(wanted))) == expected


def test_markers(spark):
    text = "[[PARAGRAPH]] [[LINE 1 2 3 4]] hello world [[LINE 5 6 7 8]]"
    assert value(spark, without_markers(F.lit(text))) == "hello world [[LINE 5 6 7 8]]"


@pytest.mark.parametrize(("text", "expected"), [("", "0"), ("hello world", "to5x38"), ("voltage regulator", "62co8v")])
def test_cache_hash(spark, text, expected):
    assert value(spark, cache_hash(F.lit(text))) == expected


def test_box_of_title(spark):
    assert tuple(value(spark, box_of_title(F.lit("bbox 100 200 300 400; x_wconf 9")))) == (100, 200, 300, 400)
    assert value(spark, box_of_title(F.lit("none"))["x1"]) is None


@pytest.mark.parametrize(("color", "expected"), [("#ff0000", (1, 0, 0)), ("#f00", (1, 0, 0)), ("blue", (0, 0, 1)), ("invalid", None), ("#12", None)])
def test_colors(spark, color, expected):
    found = value(spark, channels(F.lit(color)))
    assert (tuple(found) if found else None) == expected
