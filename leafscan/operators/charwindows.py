"""Boxes from line markers alone, for texts searched character by character in marker text.

A window ends at a character and grows to the left until it has as many characters as the text, markers not counted; a marker
that a window's end cuts stays in it as text.  Windows are tried from the right end of the page to the left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of equal characters above which a window is taken at once.
ENOUGH = 0.85
_MARKER = re.compile(r"\[\[.*?\]\] ")
#: Characters that are compared at once, about.
_AT_ONCE = 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _equal_from(page: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Equal characters of a text laid over a page at each place, the first being all of the text before the page."""
    n, m = len(page), len(wanted)
    letters, numbers = np.unique(wanted, return_inverse=True)
    kind = np.uint8 if len(letters) < 255 else np.uint32
    near = np.minimum(np.searchsorted(letters, page), len(letters) - 1)
    laid = np.full(n + 2 * m, len(letters), kind)
    laid[m : m + n] = np.where(letters[near] == page, near, len(letters))
    total = np.zeros(n + m + 1, np.int64)
    for first in range(0, m, 255):  # as many as a byte can count
        some = np.zeros(n + m + 1, np.uint8)
        for j in range(first, min(first + 255, m)):
            some += (laid[j : j + n + m + 1] == kind(numbers[j])).view(np.uint8)
        total += some
    return total


def window_of(marked: str, text: str, enough: float = ENOUGH) -> tuple[int, int, float] | None:
    """Start, end and share of equal characters of the first window above ``enough``, else of the best, the rightmost of equals.

    With running counts of the characters outside markers, where a window begins follows from where it ends: the
    count there, less the text's length, is looked up among the counts of all places.  The text is laid over what is outside
    markers at all places at once, one character after the other.  None: no window has an equal character.
    """
    page, wanted = _codes(marked), _codes(text)
    n, m = len(page), len(wanted)
    if not 0 < m < n:
        return None
    places = np.arange(n + 1)
    outside, opened, closed = np.ones(n, bool), np.full(n + 1, -1), np.full(n + 1, -1)  # of places inside a marker, its two ends
    for marker in _MARKER.finditer(marked):
        a, b = marker.span()
        outside[a:b] = False
        opened[a + 1 : b], closed[a + 1 : b] = a, b
    kept, count = np.flatnonzero(outside), np.concatenate([[0], outside.cumsum()])
    cut_left, cut_right = np.where(opened >= 0, closed - places, 0), np.where(opened >= 0, places - opened, 0)
    step, shift = n + 1, n + m
    keys = np.sort((count - cut_left + shift) * step + places)

    def begins(ends: np.ndarray) -> np.ndarray:
        value = count[ends] + cut_right[ends] - m + shift
        found = keys[np.maximum(np.searchsorted(keys, value * step + ends - m, side="right") - 1, 0)]
        at = np.where(found // step == value, found % step, -1)
        return np.where((opened[ends] >= 0) & (ends - m > opened[ends]), ends - m, at)

    ends = np.arange(n, m, -1)
    starts = begins(ends)
    ends, starts = ends[starts >= 0], starts[starts >= 0]
    if not len(ends):
        return None
    one_marker = (opened[ends] >= 0) & (starts > opened[ends])
    left = np.where(one_marker, m, cut_left[starts])
    middle = np.where(one_marker, 0, count[ends] - count[starts])
    # A window without a piece of a marker is the text's length of what is outside markers; of any other its bound is
    # what is equal there and all of its pieces of markers.  Only others that can win are compared.
    along = _equal_from(page[kept], wanted)[count[starts] - left + m]
    whole = middle == m
    equal, bound = np.where(whole, along, 0), np.minimum(along, middle) + m - middle
    above = np.flatnonzero(equal / m > enough)
    odd = np.flatnonzero(~whole & ((bound / m > enough) if len(above) else (bound >= max(1, equal.max()))))
    odd, per = odd[odd < above[0]] if len(above) else odd, max(1, _AT_ONCE // m)
    for first in range(0, len(odd), per):
        own = odd[first : first + per]
        k, begin, end, edge = np.arange(m)[None, :], starts[own][:, None], ends[own][:, None], left[own][:, None]
        inner = kept[np.clip(count[begin] + k - edge, 0, max(len(kept) - 1, 0))] if len(kept) else np.zeros((len(own), m), int)
        inside = middle[own][:, None]
        at = np.where(k < edge, begin + k, np.where(k < edge + inside, inner, opened[end] + k - edge - inside))
        equal[own] = (page[np.clip(at, 0, n - 1)] == wanted[None, :]).sum(axis=1)
        if (equal[own] / m > enough).any():
            break
    above = np.flatnonzero(equal / m > enough)
    row = int(above[0]) if len(above) else int(equal.argmax())
    return (int(starts[row]), int(ends[row]), int(equal[row]) / m) if equal[row] else None


def character_windows(texts: DataFrame, marked: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """page_id, query_id, start, end, similarity, marked of texts (page_id, query_id, text) on their pages (page_id, marked).

    Texts that are null, empty, as long as their page or without an equal character have no row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page.is_valid and window_of(page.as_py(), text.as_py(), enough) or None for page, text in zip(batch.column(2), batch.column(3), strict=True)]
            sides = [pa.array([f and f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *sides], names=["page_id", "query_id", "marked", "start", "end", "similarity"])

    asked = texts.select(F.col("page_id").cast("long"), F.col("query_id").cast("long"), "text").where("text <> ''")
    # A filter by the marker text would be worked out below the join, for pages without a text too.
    both = asked.join(marked.select(F.col("page_id").cast("long"), "marked"), "page_id")
    found = both.select("page_id", "query_id", "marked", "text").mapInArrow(rows, "page_id long, query_id long, marked string, start int, end int, similarity double")
    return found.where("start is not null")


def _lines(text: Column) -> list[Column]:
    """The four sides of every line marker in a text, as arrays."""
    pattern = F.lit(r"\[\[LINE (\d+) (\d+) (\d+) (\d+)\]\]")
    return [F.regexp_extract_all(text, pattern, F.lit(k)).cast("array<int>") for k in range(1, 5)]


def character_boxes(windows: DataFrame) -> DataFrame:
    """page_id, query_id, start, end, similarity, x1, y1, x2, y2 from the line markers before and inside each window.

    Left and top are those of the last line marker before it; right is the furthest of that line and of those
    inside it, bottom that of the last inside.  What no marker tells is 0.
    """
    before = _lines(F.substring("marked", F.lit(1), F.col("start")))
    inside = _lines(F.substring("marked", F.col("start") + 1, F.col("end") - F.col("start")))
    last = lambda sides: F.coalesce(F.try_element_at(sides, F.lit(-1)), F.lit(0))
    right = F.when(F.size(inside[2]) > 0, F.greatest(last(before[2]), F.array_max(inside[2]))).otherwise(0)
    sides = {"x1": last(before[0]), "y1": last(before[1]), "x2": right, "y2": last(inside[3])}
    return windows.select("page_id", "query_id", "start", "end", "similarity", *[side.cast("double").alias(name) for name, side in sides.items()])
