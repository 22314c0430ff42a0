"""Words of texts and the markers of marker text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_words(text: Column) -> Column:
    """The words of a text: what stands between white space, none empty; null gives null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def without_markers(text: Column) -> Column:
    """Marker text without its ``[[...]]`` markers; a marker goes only with the space after it."""
    return F.regexp_replace(text, r"\[\[.*?\]\] ", "")


def line_marker(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The marker that opens a line with its box."""
    box = F.concat_ws(" ", *[c.cast("int").cast("string") for c in (x1, y1, x2, y2)])
    return F.concat(F.lit("[[LINE "), box, F.lit("]]"))


def box_of_title(title: Column) -> Column:
    """struct(x1, y1, x2, y2) of ``bbox a b c d`` in a title attribute; nulls where there is none."""
    found = lambda k: F.nullif(F.regexp_extract(title, r"bbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)", k), F.lit("")).cast("int")
    return F.struct(*[found(k + 1).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def cache_hash(text: Column) -> Column:
    """The 31-multiplier hash of a text's UTF-16 units in 32 bits, absolute, in base 36 (``0`` for an empty text)."""
    wrapped = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    units = F.hex(F.encode(text, "UTF-16BE"))
    places = F.when(F.length(units) > 0, F.sequence(F.lit(1), F.length(units), F.lit(4))).otherwise(F.expr("array()").cast("array<int>"))
    unit = lambda at: F.conv(F.substr(units, at, F.lit(4)), 16, 10).cast("long")
    total = F.aggregate(places, F.lit(0).cast("long"), lambda h, at: wrapped(h * 31 + unit(at)))
    return F.lower(F.conv(F.abs(total).cast("string"), 10, 36))


def hocr_key(doc_uid: Column, page_number: Column, url: Column) -> Column:
    """Cache key of a recognised page."""
    return F.concat_ws(":", F.lit("hocr"), doc_uid.cast("string"), page_number.cast("string"), cache_hash(url))


def match_key(doc_uid: Column, page_number: Column, query: Column, tolerance: Column) -> Column:
    """Cache key of a query's matches on a page."""
    return F.concat_ws(":", F.lit("match"), doc_uid.cast("string"), page_number.cast("string"), cache_hash(query), tolerance.cast("string"))


def pdf_key(doc_uid: Column, url: Column) -> Column:
    """Cache key of a target document."""
    return F.concat_ws(":", F.lit("pdf"), doc_uid.cast("string"), cache_hash(url))
