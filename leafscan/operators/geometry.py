"""Page geometry, styles and drawing operations, as columns and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.functions.colors import channels

#: Size of recognised pages and of target pages.
PAGE_WIDTH, PAGE_HEIGHT, TARGET_WIDTH, TARGET_HEIGHT = 2560.0, 3300.0, 612.0, 792.0
#: Annotation type -> border r, g, b; fill r, g, b; opacity; border width; font size; font r, g, b.
STYLES = {
    "rectangle": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1, 2.0, 10.0, 1.0, 0.0, 0.0),
    "highlight": (1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.3, 0.0, 10.0, 0.8, 0.8, 0.0),
    "underline": (0.0, 0.0, 1.0, None, None, None, 1.0, 2.0, 10.0, 0.0, 0.0, 1.0),
    "strikethrough": (0.5, 0.5, 0.5, None, None, None, 1.0, 2.0, 10.0, 0.5, 0.5, 0.5),
}
_STYLE_COLUMNS = "annotation_type border_r border_g border_b fill_r fill_g fill_b opacity border_width font_size font_r font_g font_b".split()


def pdf_box(x1: Column, y1: Column, x2: Column, y2: Column, width=PAGE_WIDTH, height=PAGE_HEIGHT, to_width=TARGET_WIDTH, to_height=TARGET_HEIGHT) -> dict[str, Column]:
    """x, y, width, height on the target page, whose y runs upwards; sizes may be columns or numbers."""
    sx, sy = F.lit(to_width) / F.lit(width), F.lit(to_height) / F.lit(height)
    return {"x": x1 * sx, "y": F.lit(to_height) - y2 * sy, "width": (x2 - x1) * sx, "height": (y2 - y1) * sy}


def sizes_of(pages: DataFrame, width: float, height: float) -> DataFrame:
    """page_id, width, height: one size for all pages."""
    return pages.select("page_id").distinct().select("page_id", F.lit(width).alias("width"), F.lit(height).alias("height"))


def sized_pages(pages: DataFrame, targets: DataFrame, width: float | None = None, height: float | None = None, standard_width: float = TARGET_WIDTH, standard_height: float = TARGET_HEIGHT) -> DataFrame:
    """Pages (page_id, width, height: nulls where recognition gave none) with the size to use: the option, the page's own,
    the target's from a table of sizes (page_id, width, height), the standard target's; a pair of null counts as none."""
    known = targets.select("page_id", F.struct("width", "height").alias("target"))
    whole = lambda w, h: F.when(w.isNotNull() & h.isNotNull(), F.struct(w.cast("double").alias("w"), h.cast("double").alias("h")))
    option = whole(F.lit(width), F.lit(height)) if width is not None and height is not None else F.lit(None)
    standard = whole(F.lit(standard_width), F.lit(standard_height))
    size = F.coalesce(option, whole(F.col("width"), F.col("height")), whole(F.col("target.width"), F.col("target.height")), standard)
    return pages.join(known, "page_id", "left").select("page_id", size["w"].alias("width"), size["h"].alias("height"))


def annotation_records(matches: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Matches ready to draw: missing coordinates 0, similarity 1, text empty; those on pages that their document
    (doc_uid, n_pages) doesn't have left out, pages counted from 1."""
    filled = {c: F.coalesce(c, F.lit(0.0)) for c in ("x1", "y1", "x2", "y2")} | {"similarity": F.coalesce("similarity", F.lit(1.0)), "text": F.coalesce("text", F.lit(""))}
    there = matches.join(page_counts.select("doc_uid", "n_pages"), "doc_uid").where(F.col("page_number").between(1, F.col("n_pages")))
    return there.withColumns(filled).drop("n_pages")


def valid_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether coordinates are finite and the box has an area."""
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (x, y, width, height)]
    return finite[0] & finite[1] & finite[2] & finite[3] & (width > 0) & (height > 0)


def styles(spark: SparkSession) -> DataFrame:
    """The four default styles, a row for each annotation type."""
    rows = [F.struct(*[F.lit(v).cast("string" if c == "annotation_type" else "double").alias(c) for c, v in zip(_STYLE_COLUMNS, (name, *values), strict=True)]) for name, values in STYLES.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def styled(annotations: DataFrame, color: str = "color", background: str = "background_color") -> DataFrame:
    """Annotations with their type's style (an unknown type: rectangle), overridden by valid colours of their own.

    A colour changes the border and, at 0.8, the font; a background colour the fill.
    """
    known = F.broadcast(styles(annotations.sparkSession))  # four rows
    kind = F.when(F.col("annotation_type").isin(*STYLES), F.col("annotation_type")).otherwise("rectangle")
    joined = annotations.withColumn("annotation_type", kind).join(known, "annotation_type")
    joined = joined.withColumn("_own", channels(F.col(color))).withColumn("_fill", channels(F.col(background)))
    for c in "rgb":
        joined = joined.withColumn(f"border_{c}", F.coalesce(F.col(f"_own.{c}"), F.col(f"border_{c}")))
        joined = joined.withColumn(f"font_{c}", F.coalesce(F.col(f"_own.{c}") * 0.8, F.col(f"font_{c}")))
        joined = joined.withColumn(f"fill_{c}", F.coalesce(F.col(f"_fill.{c}"), F.col(f"fill_{c}")))
    return joined.drop("_own", "_fill")


def custom_style(border: Column, fill: Column, opacity: Column, border_width: Column) -> Column:
    """A style from colours; null if the border's colour is no colour; without a fill colour it is filled like the border."""
    b = channels(border)
    return F.when(b.isNotNull(), F.struct(b.alias("border"), F.coalesce(channels(fill), b).alias("fill"), opacity.alias("opacity"), border_width.alias("border_width")))


def draw_ops(annotations: DataFrame) -> DataFrame:
    """What is drawn for each annotation: op, and the line or rectangle (dx1, dy1) to (dx2, dy2)."""
    kind, x, y = F.col("annotation_type"), F.col("x"), F.col("y")
    level = F.when(kind == "underline", y).when(kind == "strikethrough", y + F.col("height") / 2)
    op = F.when(kind == "highlight", "fill").when(kind.isin("underline", "strikethrough"), "line").otherwise("square")
    return annotations.select("*", op.alias("op"), x.alias("dx1"), F.coalesce(level, y).alias("dy1"), (x + F.col("width")).alias("dx2"), F.coalesce(level, y + F.col("height")).alias("dy2"))


def label_position(x: Column, y: Column, height: Column) -> Column:
    """Where the label of a rectangle goes: left edge, just above."""
    return F.struct(x.alias("x"), (y + height + 5).alias("y"), F.lit(12).alias("size"))


def annotation_subtype(kind: Column) -> Column:
    """Annotation subtype of a section's type."""
    return F.when(kind == "strikethrough", "StrikeOut").when(kind == "underline", "Underline").otherwise("Highlight")


#: What a markup annotation's contents begin with, and its opacity where none (or 0) is asked for.
MARKUP_LABELS = {"highlight": "Highlight: ", "strikethrough": "Strike-through: ", "underline": "Underline: "}
MARKUP_OPACITY = {"strikethrough": 0.8, "underline": 0.8}
OTHER_LABEL, OTHER_OPACITY, PRINT_FLAG = "Annotation: ", 0.5, 4


def markup_annotations(found: DataFrame) -> DataFrame:
    """Text-markup records of found texts, ready to be written, with what is wrong with each (an empty array: nothing).

    ``found``: rect, quad_points (arrays of doubles), r, g, b (0 to 255), annotation_type, opacity, text, and any other
    columns, which stay.  Added: subtype, contents, flags; rect, quad_points, opacity and color (0 to 1) are rounded to
    six places.  An opacity that is null or 0 is the type's own.
    """
    kind = F.col("annotation_type")
    of_kind = lambda values, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), kind), F.lit(other))
    six = lambda numbers: F.transform(numbers, lambda v: F.round(v, 6))
    channel = [F.col(c).cast("double") for c in "rgb"]
    shown = F.coalesce(F.nullif(F.col("opacity").cast("double"), F.lit(0.0)), of_kind(MARKUP_OPACITY, OTHER_OPACITY))
    odd_color = [F.coalesce(~(c.between(0, 255)) | F.isnan(c), F.lit(True)) for c in channel]
    odd_rect = F.exists(F.coalesce("rect", F.array(F.lit(0.0))), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    more = F.array_compact(
        F.array(
            F.when(odd_rect, "rect must be finite"),
            F.when(odd_color[0] | odd_color[1] | odd_color[2], "colours must be within 0 and 255"),
        )
    )
    made = {
        "errors": F.concat(quad_errors(F.col("quad_points"), F.col("rect"), shown), more),
        "subtype": annotation_subtype(kind),
        "contents": F.concat(of_kind(MARKUP_LABELS, OTHER_LABEL), F.coalesce("text", F.lit(""))),
        "flags": F.lit(PRINT_FLAG),
        "color": six(F.array(*[c / 255 for c in channel])),
        "rect": six(F.col("rect")),
        "quad_points": six(F.col("quad_points")),
        "opacity": F.round(shown, 6),
    }
    return found.withColumns(made)


def unscaled_rect(x1: Column, y1: Column, x2: Column, y2: Column, page_height: Column) -> Column:
    """Rectangle of a page box on a target page of the same size, whose y runs upwards: left, bottom, right, top."""
    return F.array(x1, page_height - y2, x2, page_height - y1)


def unscaled_quad(x1: Column, y1: Column, x2: Column, y2: Column, page_height: Column) -> Column:
    """The same box as quad points: upper left, upper right, lower left, lower right."""
    return F.array(x1, page_height - y1, x2, page_height - y1, x1, page_height - y2, x2, page_height - y2)


def quad_errors(quad: Column, rect: Column, opacity: Column) -> Column:
    """What is wrong with an annotation's numbers; an empty array if nothing."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.size(rect), F.lit(0)) != 4, "rect needs 4 numbers"),
            F.when((F.coalesce(F.size(quad), F.lit(0)) == 0) | (F.size(quad) % 8 != 0), "quad points come in eights"),
            F.when(F.exists(F.coalesce(quad, F.array(F.lit(0.0))), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "quad points must be finite"),
            F.when(~opacity.between(0, 1), "opacity must be within 0 and 1"),
        )
    )
