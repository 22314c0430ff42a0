"""Boxes of matches: union boxes, words in an area, lines and their quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.plans.shared import taken_apart

#: Pixels around a box in which words still belong to it, and of height in which words share a line.
PADDING, LINE_TOLERANCE = 50.0, 10.0


def union_box() -> list[Column]:
    """Aggregates of the smallest box around all boxes of a group."""
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def matched_words(matches: DataFrame, words: DataFrame) -> DataFrame:
    """The words of every match's window: page_id, query_id, pos, word, box."""
    spans = matches.select("page_id", "query_id", "start_index", "end_index")
    inside = (F.col("pos") >= F.col("start_index")) & (F.col("pos") < F.col("end_index"))
    return spans.join(words, "page_id").where(inside).select("page_id", "query_id", "pos", "word", "x1", "y1", "x2", "y2")


def match_boxes(matches: DataFrame, words: DataFrame) -> DataFrame:
    """Matches with the union box of their words."""
    boxes = matched_words(matches, words).groupBy("page_id", "query_id").agg(*union_box())
    return matches.join(boxes, ["page_id", "query_id"])


def usable_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes that are there and not all zero."""
    return boxes.where("x1 is not null and not (x1 = 0 and y1 = 0 and x2 = 0 and y2 = 0)")


def words_in_area(boxes: DataFrame, words: DataFrame, padding: float = PADDING) -> DataFrame:
    """Words that overlap a match's padded box, edges included: page_id, query_id, pos, word, box."""
    areas = boxes.select("page_id", "query_id", *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    across = (F.col("x2") >= F.col("ax1") - padding) & (F.col("x1") <= F.col("ax2") + padding)
    down = (F.col("y2") >= F.col("ay1") - padding) & (F.col("y1") <= F.col("ay2") + padding)
    return areas.join(words, "page_id").where(across & down).select("page_id", "query_id", "pos", "word", "x1", "y1", "x2", "y2")


def clustered_lines(words: Column, tolerance: float = LINE_TOLERANCE) -> Column:
    """Lines of words (array of structs with cy, in the order they come): array of struct(s, n, at).

    A word joins the first line whose mean centre is within the tolerance of its own, else it begins one; ``at`` are its
    words' places in the array, ``s`` / ``n`` its mean centre.
    """
    none = F.expr("cast(array() as array<struct<s:double,n:int,at:array<int>>>)")
    made = lambda s, n, at: F.struct(s.cast("double").alias("s"), n.cast("int").alias("n"), at.cast("array<int>").alias("at"))

    def joined(lines: Column, k: Column) -> Column:
        cy = F.get(words, k)["cy"]
        fits = F.array_position(F.transform(lines, lambda g: F.abs(cy - g["s"] / g["n"]) <= tolerance), True)
        grown = F.transform(lines, lambda g, i: F.when(i + 1 == fits, made(g["s"] + cy, g["n"] + 1, F.concat(g["at"], F.array(k)))).otherwise(g))
        return F.when(fits > 0, grown).otherwise(F.concat(lines, F.array(made(cy, F.lit(1), F.array(k)))))

    return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), none, joined)


def line_quads(words: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """One quad for each line of a match: page_id, query_id, line_index, box, n_words, text.

    Lines are those of ``clustered_lines``, words taken in page order; they are numbered by their mean centre, and a line's
    words stand from left to right.
    """
    placed = words.select("page_id", "query_id", F.struct("pos", ((F.col("y1") + F.col("y2")) / 2).alias("cy"), "x1", "y1", "x2", "y2", "word").alias("w"))
    held = placed.groupBy("page_id", "query_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    lines = held.select("page_id", "query_id", "ws", clustered_lines(F.col("ws"), tolerance).alias("lines"))
    ordered = F.array_sort(F.transform("lines", lambda g, i: F.struct((g["s"] / g["n"]).alias("mean"), i.alias("i"), g["at"].alias("at"))))
    each = taken_apart(lines, ordered, "line_index", "line", "page_id", "query_id", "ws")
    own = each.withColumn("own", F.transform("line.at", lambda k: F.get("ws", k)))
    side = lambda pick, name: pick(F.transform("own", lambda w: w[name])).alias(name)
    spoken = F.array_sort(F.transform("own", lambda w: F.struct(w["x1"].alias("x1"), w["pos"].alias("pos"), w["word"].alias("word"))))
    text = F.array_join(F.transform(spoken, lambda w: w["word"]), " ")
    sides = [side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2")]
    return own.select("page_id", "query_id", "line_index", *sides, F.size("own").cast("long").alias("n_words"), text.alias("text"))


def quad_points(quads: DataFrame) -> DataFrame:
    """page_id, query_id, quad_points (8 numbers a line, in line order), rect (the box around all)."""
    eight = F.array("x1", "y2", "x2", "y2", "x1", "y1", "x2", "y1")
    points = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_index", eight.alias("q")))), lambda s: s["q"]))
    rect = F.array(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2"))
    return quads.groupBy("page_id", "query_id").agg(points.alias("quad_points"), rect.alias("rect"))


def line_boxes(matches: DataFrame, words: DataFrame) -> DataFrame:
    """Matches with the box that line markers alone give, for users of that older form.

    Left and top are those of the line in which the window begins; right is the furthest of it and of the lines
    that begin inside the window, bottom that of the last of these.  A window inside one line gets 0 for both, as no line
    begins in it.
    """
    lines = words.groupBy("page_id", "line_no").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), *union_box())
    spans = matches.select("page_id", "query_id", "start_index", "end_index").join(lines, "page_id")
    touched = spans.where((F.col("last_pos") >= F.col("start_index")) & (F.col("first_pos") < F.col("end_index")))
    opening = F.col("first_pos") <= F.col("start_index")
    of = lambda name, which: F.max(F.when(which, F.col(name)))
    inside = F.count(F.when(~opening, F.lit(1)))
    last = F.max_by(F.col("y2"), F.when(~opening, F.col("first_pos")))
    found = touched.groupBy("page_id", "query_id").agg(
        of("x1", opening).alias("x1"),
        of("y1", opening).alias("y1"),
        F.when(inside > 0, F.max("x2")).otherwise(F.lit(0.0)).alias("x2"),
        F.coalesce(last, F.lit(0.0)).alias("y2"),
    )
    return found
