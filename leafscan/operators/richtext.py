"""Rich-text queries: parsing, merging into search queries, duplicates.

A segment is ``struct(ord, text, bold, italic, underline, strikethrough, color, background_color, font_size,
font_family)``.  HTML is read by the standard library's parser in Arrow batches; all else are expressions.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = "array<struct<ord:int,text:string,bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,color:string,background_color:string,font_size:double,font_family:string>>"
_FORMAT = ("bold", "italic", "underline", "strikethrough", "color", "background_color", "font_size", "font_family")
_FLAG_TAGS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "s": "strikethrough", "strike": "strikethrough"}
_VOID = {"br", "hr", "img", "input", "meta", "link"}


def style_properties(style: str) -> dict[str, object]:
    """Formatting that a style attribute sets."""
    found: dict[str, object] = {}
    for name, _, value in (part.partition(":") for part in style.split(";")):
        name, value = name.strip().lower(), value.strip()
        number = re.match(r"[\d.]+", value)
        if name == "color":
            found["color"] = value
        elif name in ("background", "background-color"):
            found["background_color"] = value
        elif name == "font-weight" and (value == "bold" or number and float(number[0]) >= 600):
            found["bold"] = True
        elif name == "font-style" and value == "italic":
            found["italic"] = True
        elif name == "text-decoration":
            found |= {flag: True for word, flag in (("underline", "underline"), ("line-through", "strikethrough")) if word in value}
        elif name == "font-size" and number:
            found["font_size"] = float(number[0])
        elif name == "font-family":
            found["font_family"] = value.strip("'\"")
    return found


class _Segments(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict]] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _VOID:
            flags = {_FLAG_TAGS[tag]: True} if tag in _FLAG_TAGS else {}
            self.open.append((tag, flags | style_properties(dict(attrs).get("style") or "")))

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break

    def handle_data(self, data: str) -> None:
        merged: dict = {}
        for _, own in self.open:
            merged |= own
        self.found.append({"text": data, **merged})


def html_segments(html: str | None) -> list[dict]:
    """The text pieces of an HTML fragment with the formatting that holds for them."""
    reader = _Segments()
    reader.feed(html or "")
    reader.close()
    return [{"ord": k, **{f: s.get(f) if f in ("color", "background_color", "font_size", "font_family") else bool(s.get(f)) for f in _FORMAT}, "text": s["text"]} for k, s in enumerate(reader.found)]


def parsed_html(html: Column) -> Column:
    """Segments of HTML fragments."""

    def read(texts: pd.Series) -> pd.Series:
        return texts.map(html_segments)

    return F.pandas_udf(read, SEGMENTS)(html)


#: Control words of RTF that set a flag.
RTF_FLAGS = {"bold": "b", "italic": "i", "underline": "ul", "strikethrough": "strike"}


def parsed_rtf(rtf: Column) -> Column:
    """One segment of an RTF text: its control words, groups and escapes taken out; flags hold for all of it."""
    plain = F.regexp_replace(rtf, r"\{\\(fonttbl|colortbl|stylesheet|info)[^{}]*(\{[^{}]*\}[^{}]*)*\}", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\\par[d]?(?![a-z])", " "), r"\\[a-z]+-?[0-9]* ?", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[{}]|\\'[0-9a-f]{2}|\\\*", ""), r"\s+", " "))
    flag = lambda word: F.rlike(rtf, F.lit(r"\\" + word + r"(?![a-z0-9])"))
    size = F.nullif(F.regexp_extract(rtf, r"\\fs([0-9]+)", 1), F.lit("")).cast("double") / 2
    values = [F.lit(0).alias("ord"), plain.alias("text"), *[flag(w).alias(f) for f, w in RTF_FLAGS.items()]]
    none = F.lit(None).cast("string")
    return F.array(F.struct(*values, none.alias("color"), none.alias("background_color"), size.alias("font_size"), none.alias("font_family")))


def plain_segment(text: Column) -> Column:
    """One segment without formatting."""
    return F.array(F.struct(F.lit(0).alias("ord"), text.alias("text"), *[F.lit(None).cast("string" if f in ("color", "background_color", "font_family") else "double" if f == "font_size" else "boolean").alias(f) for f in _FORMAT]))


def detected_format(text: Column) -> Column:
    """rtf, html or plain."""
    return F.when(F.startswith(F.trim(text), F.lit("{\\rtf")), "rtf").when(F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")), "html").otherwise("plain")


def annotation_type(strikethrough: Column, underline: Column, background: Column) -> Column:
    """Type of annotation that formatting asks for."""
    return F.when(strikethrough, "strikethrough").when(underline, "underline").when(background.isNotNull(), "highlight").otherwise("rectangle")


def merged_runs(segments: DataFrame, group: str, order: str, same: list[str], text: str = "text") -> DataFrame:
    """Consecutive segments with equal values of ``same`` as one: group, run_no, those values, first, n, text joined by spaces."""
    reading = Window.partitionBy(group).orderBy(order)
    values = F.struct(*same)
    begins = (~values.eqNullSafe(F.lag(values).over(reading))).cast("int")
    runs = segments.withColumn("_b", begins).withColumn("run_no", F.sum("_b").over(reading))
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    joined = F.array_join(F.transform(pieces, lambda p: p[text]), " ")
    return runs.groupBy(group, "run_no", *same).agg(F.min(order).alias("first"), F.count("*").alias("n"), joined.alias(text))


def search_queries(parsed: DataFrame, query_set: str) -> DataFrame:
    """Search queries from rows of (query_set, segments): equal neighbours merged, empty ones dropped."""
    rows = parsed.select(query_set, F.inline("segments")).where(F.trim("text") != "")
    merged = merged_runs(rows, query_set, "ord", list(_FORMAT))
    kind = annotation_type(F.coalesce("strikethrough", F.lit(False)), F.coalesce("underline", F.lit(False)), F.col("background_color"))
    return merged.select(query_set, "run_no", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), kind.alias("annotation_type"), "color", "background_color")


def first_of_equal(queries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys with the first ``order`` of those that share them: keep-first removal of duplicates, combined map-side."""
    return queries.groupBy(*keys).agg(F.min(order).alias(order))


def html_query(text: Column, bold: Column, italic: Column, color: Column, background: Column, size: Column) -> Column:
    """An HTML query from flags."""
    styles = F.array_compact(F.array(F.concat(F.lit("color: "), color), F.concat(F.lit("background-color: "), background), F.concat(F.lit("font-size: "), size.cast("int").cast("string"), F.lit("px"))))
    out = F.when(F.size(styles) > 0, F.concat(F.lit('<span style="'), F.array_join(styles, "; "), F.lit('">'), text, F.lit("</span>"))).otherwise(text)
    for flag, tag in ((italic, "em"), (bold, "strong")):
        out = F.when(flag, F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    return out
