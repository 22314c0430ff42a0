"""Similarities of words and word sequences, as columns.

Lengths are counted in code points.  Sequences are arrays of words; both empty counts as equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafscan.functions.tokens import let


def chars(text: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def positional(a: Column, b: Column) -> Column:
    """Share of positions with equal members, of the longer array's length."""
    longest = F.greatest(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(longest == 0, F.lit(1.0)).otherwise(same / longest)


def char_similarity(a: Column, b: Column) -> Column:
    """Share of positions with equal characters."""
    return positional(chars(a), chars(b))


def word_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one contains the other, else the share of a's characters that occur in b."""
    occurring = F.size(F.filter(chars(a), lambda c: F.contains(b, c)))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when(F.contains(a, b) | F.contains(b, a), F.lit(0.8)).otherwise(occurring / longest)


def sequence_similarity(a: Column, b: Column) -> Column:
    """Sum of word similarities at equal positions, of the longer sequence's length; 0 if just one is empty."""
    longest = F.greatest(F.size(a), F.size(b))
    aligned = F.zip_with(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), F.lit(0.0)).otherwise(word_similarity(x, y)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.aggregate(aligned, F.lit(0.0), lambda s, x: s + x) / longest)


def truncated(value: Column) -> Column:
    """A similarity cut to three decimals."""
    return F.floor(value * 1000) / 1000


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """The better of the sequence similarity and the character similarity of the joined words, both truncated."""
    joined = lambda ws: F.array_join(ws, "")
    return F.greatest(truncated(sequence_similarity(a, b)), truncated(char_similarity(joined(a), joined(b))))


def words_match(word: Column, wanted: Column) -> Column:
    """Whether a page's word counts as a wanted word: equal, containing or alike, after ASCII cleaning."""
    clean = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9_]", "")
    return let(
        F.struct(clean(word).alias("w"), clean(wanted).alias("s")),
        lambda p: F.when(p["w"] == p["s"], F.lit(True))
        .when(F.length(p["s"]) <= 2, F.contains(p["w"], p["s"]) & (F.length(p["w"]) <= F.length(p["s"]) + 3))
        .when(F.contains(p["w"], p["s"]) | F.contains(p["s"], p["w"]), F.lit(True))
        .when(F.length(p["w"]) <= 2, F.lit(False))
        .otherwise(char_similarity(p["w"], p["s"]) > 0.8),
    )
