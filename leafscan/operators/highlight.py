"""Highlighting of formatted sections: sections are found among a match's words, each word used once.

Finding is sequential by nature (a section may not use words that an earlier one took), so every match is one row of
an Arrow batch; its words are those of a padded box, whatever the page's length.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_TOLERANCE, SAME_LINE, NEARLY = 10.0, 10.0, 0.7
#: Colours of sections whose tag alone gives their type.
TAG_TYPES = {"s": ("strikethrough", (255, 0, 0)), "u": ("underline", (0, 0, 255))}
SECTIONS = "array<struct<ord:int,text:string,type:string,r:int,g:int,b:int,hex_color:string>>"
FOUND = "page_id long, query_id long, ord int, type string, n_words int, n_quads int, x1 double, y1 double, x2 double, y2 double, text string, quads string"


class _Sections(HTMLParser):
    """Outermost tags that mark a section; what lies inside one belongs to it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.inside: tuple[str, str | None, tuple[int, int, int] | None] | None = None
        self.depth = 0
        self.text = ""
        self.found: list[tuple[str, str, tuple[int, int, int]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.inside:
            self.depth += tag == self.inside[0]
            return
        kind, color = TAG_TYPES.get(tag, (None, None))
        if tag in ("span", "strong"):
            style = re.search(r"background(?:-color)?\s*:\s*([^;]+)", dict(attrs).get("style") or "")
            if not style:
                return
            rgb = re.match(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", style[1].strip())
            kind, color = ("highlight", tuple(map(int, rgb.groups()))) if rgb else (None, None)
        elif not kind:
            return
        self.inside, self.depth, self.text = (tag, kind, color), 1, ""

    def handle_data(self, data: str) -> None:
        self.text += data if self.inside else ""

    def handle_endtag(self, tag: str) -> None:
        if self.inside and tag == self.inside[0]:
            self.depth -= 1
            if not self.depth:
                _, kind, color = self.inside
                if kind and self.text.strip():
                    self.found.append((self.text.strip(), kind, color))
                self.inside = None


def formatted_sections(html: str | None) -> list[dict]:
    """Sections of a formatted text in order, with type and colour."""
    reader = _Sections()
    reader.feed((html or "").replace('\\"', '"'))
    reader.close()
    return [{"ord": k, "text": text, "type": kind, "r": r, "g": g, "b": b, "hex_color": f"#{r:02x}{g:02x}{b:02x}"} for k, (text, kind, (r, g, b)) in enumerate(reader.found)]


def parsed_sections(html: Column) -> Column:
    """Sections of formatted texts."""

    def read(texts: pd.Series) -> pd.Series:
        return texts.map(formatted_sections)

    return F.pandas_udf(read, SECTIONS)(html)


def alike(a: str, b: str) -> float:
    """Share of positions with equal characters."""
    return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) if a or b else 1.0


def is_wanted(word: str, wanted: str) -> bool:
    """Whether a page's word counts as a wanted one."""
    word, wanted = (re.sub("[^a-z0-9_]", "", w.lower()) for w in (word, wanted))
    if word == wanted:
        return True
    if len(wanted) <= 2:
        return wanted in word and len(word) <= len(wanted) + 3
    return wanted in word or word in wanted or len(word) > 2 and alike(word, wanted) > 0.8


def reading_order(words: list[dict]) -> list[dict]:
    """Words from top to bottom; those of nearly one height from left to right."""

    def before(a: dict, b: dict) -> float:
        down = a["y1"] - b["y1"]
        return a["x1"] - b["x1"] if abs(down) < SAME_LINE else down

    return sorted(words, key=functools.cmp_to_key(before))


def found_section(words: list[dict], wanted: list[str]) -> list[dict]:
    """The best run of free words for a section's words; words must be in reading order, used ones left out of the run.

    A run begins with a word that matches the first wanted one and goes on while the next free word matches or is nearly
    the next wanted one.  Longer runs are better, earlier ones on ties.
    """
    if not wanted or len(words) < len(wanted):
        return []
    free = [k for k, w in enumerate(words) if not w.get("used")]
    last_start = len(words) - len(wanted)
    best: list[dict] = []
    for at, k in enumerate(free):
        if not is_wanted(words[k]["word"], wanted[0]):
            continue
        run = [words[k]]
        for nxt, want in zip(free[at + 1 :], wanted[1:], strict=False):
            if not is_wanted(words[nxt]["word"], want) and alike(words[nxt]["word"], want) <= NEARLY:
                break
            run.append(words[nxt])
        if len(run) > len(best):
            best = run
        if k >= last_start:
            break  # later runs could only begin after the last place where a whole section fits
    return best


def line_clusters(words: list[dict], tolerance: float = LINE_TOLERANCE) -> list[list[dict]]:
    """Words by lines: each joins the first line whose mean centre is near; lines top down, words left to right."""
    lines: list[list[dict]] = []
    centre = lambda w: (w["y1"] + w["y2"]) / 2
    mean = lambda line: sum(map(centre, line)) / len(line)
    for word in words:
        near = next((line for line in lines if abs(centre(word) - mean(line)) <= tolerance), None)
        if near is None:
            lines.append([word])
        else:
            near.append(word)
    return [sorted(line, key=lambda w: w["x1"]) for line in sorted(lines, key=mean)]


def box_of(words: list[dict]) -> tuple[float, float, float, float]:
    return min(w["x1"] for w in words), min(w["y1"] for w in words), max(w["x2"] for w in words), max(w["y2"] for w in words)


def highlighted(words: DataFrame, sections: DataFrame, only_highlights: bool = False) -> DataFrame:
    """``FOUND`` for each section of each match.

    ``words``: page_id, query_id, pos, word, box (as ``boxes.words_in_area`` gives them); ``sections``: query_id, ord,
    text, type.
    """

    schema = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[kind]) for name, kind in map(str.split, FOUND.split(", "))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, query, own, wanted in zip(*(batch.column(k) for k in range(4)), strict=True):
                ordered = reading_order(own.as_py())
                for section in wanted.as_py():
                    run = found_section(ordered, section["text"].lower().split())
                    for word in run:
                        word["used"] = True
                    if run:
                        lines = line_clusters(run)
                        quads = " ".join(",".join(f"{v:g}" for v in box_of(line)) for line in lines)
                        rows.append((page.as_py(), query.as_py(), section["ord"], section["type"], len(run), len(lines), *box_of(run), " ".join(w["word"] for w in run), quads))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    if only_highlights:
        sections = sections.where(F.coalesce("type", F.lit("highlight")) == "highlight")
    listed = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    own = words.groupBy("page_id", "query_id").agg(listed("pos", "word", "x1", "y1", "x2", "y2").alias("own"))
    asked = sections.groupBy("query_id").agg(listed("ord", "text", "type").alias("wanted"))
    both = own.join(asked, "query_id").select(F.col("page_id").cast("long").alias("page_id"), F.col("query_id").cast("long").alias("query_id"), "own", "wanted")
    return both.mapInArrow(found, FOUND)
