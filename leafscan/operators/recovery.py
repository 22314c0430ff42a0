"""Boxes of texts that are no exact window of their page: by marker tokens, by substring, with gaps.

``token_boxes`` and ``text_spans`` take pairs of a page and a text (page_id, query_id, text), usually matches with their
passage, and work each pair out beside its page; ``gap_boxes`` takes stretches of any pages.  ``boxes.match_boxes`` is the box
to use where a window of words is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.functions.similarity import positional
from leafscan.functions.tokens import split_words
from leafscan.operators import chain

#: A window of tokens that is this similar ends the search; a window of words must be so similar; so must single words.
TOKEN_STOP, WORDS_LEAST, WORD_LEAST = 0.85, 0.7, 0.7
#: Shares of a text's words: found before a gap may follow, found in all; and the least for joined texts.
BEFORE_GAP, FOUND, JOINED_LEAST = 0.5, 0.7, 0.6
#: Windows of the joined search: from so many words shorter to so many longer.
SHORTER, LONGER = 2, 3


def _share(a: str, b: str) -> float:
    return sum(map(str.__eq__, a, b)) / max(len(a), len(b)) if a or b else 1.0


def token_box(tokens: list[str], text: str) -> tuple[float, float, float, float] | None:
    """The box of a text among the tokens of a page's marker text."""
    k = len(text.split())
    best, at = 0.0, None
    for start in range(len(tokens) - k, -1, -1):
        window = tokens[start : start + k]
        if "[[PARAGRAPH]]" in window:
            continue
        score = _share(" ".join(window), text)
        if score > best:
            best, at = score, start
        if best > TOKEN_STOP:
            break
    if at is None:
        return None
    lines = [(j, [float(v.rstrip("]")) for v in tokens[j + 1 : j + 5]]) for j, token in enumerate(tokens[: at + k]) if token == "[[LINE"]
    x1, y1 = next((box[:2] for j, box in reversed(lines) if j + 5 <= at), (0.0, 0.0))
    inside = [box for j, box in lines if j >= at and j + 5 <= at + k]
    found = x1, y1, max([x1, *[box[2] for box in inside]]), inside[-1][3] if inside else 0.0
    return found if any(found) else None


def token_boxes(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """page_id, query_id, box from marker text (page_id, marked) alone, markers counting as the tokens they consist of.

    Windows have as many tokens as the text has words and none that is a whole marker; from the page's end backwards the
    first that is similar enough ends the search, the best so far wins.  Left and top are those of the last line opened
    before the window, right and bottom come from lines opened inside it (right: at least left; bottom: 0 if none).
    """
    rows = pairs.select("page_id", "query_id", "text").where(F.size(split_words(F.col("text"))) > 0).join(marked, "page_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [token_box(row["marked"].split(), row["text"]) for row in batch.select(["text", "marked"]).to_pylist()]
            kept = [k for k, box in enumerate(boxes) if box]
            sides = [pa.array([boxes[k][n] for k in kept], pa.float64()) for n in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept, pa.int64())) for c in ("page_id", "query_id")), *sides], names=["page_id", "query_id", "x1", "y1", "x2", "y2"])

    schema = rows.select("page_id", "query_id").schema
    for name in ("x1", "y1", "x2", "y2"):
        schema = schema.add(name, "double")
    return rows.mapInArrow(found, schema)


def text_spans(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, query_id, start_index, end_index, exact: where a text stands on its page, as words.

    The first place where the page's text (words joined by single spaces) holds the text, also within words; else the
    first of the windows with the most equal words, if more than ``WORDS_LEAST`` of them are.
    """
    joined = pairs.select("page_id", "query_id", F.trim("text").alias("text"), split_words(F.col("text")).alias("qs")).where(F.size("qs") > 0).join(pages, "page_id")
    words_in = lambda text: F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    held = joined.select("page_id", "query_id", "text", "qs", "ws", F.array_join("ws", " ").alias("page")).withColumn("at", F.instr("page", F.col("text")))
    first = words_in(F.substr("page", F.lit(1), F.col("at") - 1))
    last = words_in(F.substr("page", F.lit(1), F.col("at") + F.length("text") - 1))
    score = lambda i: F.struct(positional(F.slice("ws", i + 1, F.size("qs")), F.col("qs")).alias("s"), (-i).alias("start"))
    best = F.when(F.size("qs") <= F.size("ws"), F.array_max(F.transform(F.sequence(F.lit(0), F.size("ws") - F.size("qs")), score)))
    found = held.select("page_id", "query_id", "at", first.alias("first"), last.alias("last"), F.size("qs").alias("qn"), F.when(F.col("at") == 0, best).alias("b"))
    found = found.where((F.col("at") > 0) | (F.col("b.s") > WORDS_LEAST))
    start = F.when(F.col("at") > 0, F.col("first")).otherwise(-F.col("b.start"))
    end = F.when(F.col("at") > 0, F.col("last") + 1).otherwise(-F.col("b.start") + F.col("qn"))
    return found.select("page_id", "query_id", start.alias("start_index"), end.alias("end_index"), (F.col("at") > 0).alias("exact"))


def opening_boxes(spans: DataFrame, words: DataFrame) -> DataFrame:
    """page_id, query_id, box of spans by line boxes: left and top of the line a span begins in; right and bottom by the
    lines that begin inside it, else the same left and top (a span of one line has no area)."""
    lines = words.groupBy("page_id", "line_no").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    both = spans.select("page_id", "query_id", "start_index", "end_index").join(lines, "page_id")
    touched = both.where((F.col("last_pos") >= F.col("start_index")) & (F.col("first_pos") < F.col("end_index")))
    opening = F.col("first_pos") <= F.col("start_index")
    of = lambda name: F.max(F.when(opening, F.col(name)))
    right, bottom = F.max(F.when(~opening, F.col("x2"))), F.max_by("y2", F.when(~opening, F.col("first_pos")))
    return touched.groupBy("page_id", "query_id").agg(of("x1").alias("x1"), of("y1").alias("y1"), F.greatest(of("x1"), right).alias("x2"), F.coalesce(bottom, of("y1")).alias("y2"))


def _alike(a: str, b: str) -> float:
    return sum(c in b for c in a) / max(len(a), len(b))


def run_with_gaps(words: list[str], wanted: list[str]) -> list[int]:
    """Places of the words that make up a text on a page, in order; both cleaned, none empty.

    A run begins at a word that contains the first wanted one or lies in it.  Each next word is taken if it does so
    with the next wanted one or is like it; others are skipped, once half of the text is found.  The first run with
    enough of the text wins; without one the window whose joined words are most like the joined text, if enough.
    """
    need, n = len(wanted), len(words)
    meets = lambda k, j: words[k] in wanted[j] or wanted[j] in words[k]
    for first in range(n if n >= need else 0):
        if not meets(first, 0):
            continue
        run = [first]
        for k in range(first + 1, n):
            if len(run) == need:
                break
            if meets(k, len(run)) or _alike(words[k], wanted[len(run)]) > WORD_LEAST:
                run.append(k)
            elif len(run) < need * BEFORE_GAP:
                break
        if len(run) >= need * FOUND:
            return run
        if first >= n - need:
            break  # a later start would leave too few words for the text
    joined = "".join(wanted)
    best, place = JOINED_LEAST, range(0)
    for size in range(max(1, need - SHORTER), need + LONGER + 1):
        for first in range(n - size + 1):
            score = _share("".join(words[first : first + size]), joined)
            if score > best:
                best, place = score, range(first, first + size)
    return list(place)


#: Words before and after a stretch that are searched with it, as a share of the text's words.
AROUND = 0.3


def gap_boxes(stretches: DataFrame, queries: DataFrame, words: DataFrame) -> DataFrame:
    """page_id, query_id, n_words, chained, box of texts on pages of recognised words, with gaps and misread words allowed.

    ``stretches`` (page_id, query_id, n_found, n_wanted, start_index, end_index; ``chain.stretches``) say where a text
    stands.  In the words of a stretch and some around it ``run_with_gaps`` looks for the text, and the box is the union of
    the boxes of what it finds.  Where it finds less than the chain has (words dropped or added early in the text break its
    run), the whole stretch is the text's place and ``chained`` is true.  A task holds stretches, never pages.
    """
    around = F.ceil(F.col("n_wanted") * AROUND)
    spans = stretches.select("page_id", "query_id", "n_found", "start_index", "end_index", (F.col("start_index") - around).alias("low"), (F.col("end_index") + around).alias("high"))
    ascii_only = F.regexp_replace(F.lower("word"), "[^a-z0-9_]", "")
    own = words.where(chain.clean(F.col("word")) != "").select("page_id", "pos", ascii_only.alias("clean"), "x1", "y1", "x2", "y2")
    near = spans.join(own, "page_id").where("pos >= low AND pos < high")
    listed = F.array_sort(F.collect_list(F.struct("pos", "clean", "x1", "y1", "x2", "y2")))
    rows = near.groupBy("page_id", "query_id", "n_found", "start_index", "end_index").agg(listed.alias("own")).join(queries.select("query_id", "text"), "query_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for row in batch.select(["text", "own", "n_found", "start_index", "end_index"]).to_pylist():
                wanted = re.sub(r"[^a-z0-9_\s]", " ", (row["text"] or "").lower()).split()
                searched = [w for w in row["own"] if w["clean"]]
                run = run_with_gaps([w["clean"] for w in searched], wanted) if wanted else []
                chained = len(run) < row["n_found"]
                boxes = [w for w in row["own"] if row["start_index"] <= w["pos"] < row["end_index"]] if chained else [searched[at] for at in run]
                values.append((len(boxes), chained, min(b["x1"] for b in boxes), min(b["y1"] for b in boxes), max(b["x2"] for b in boxes), max(b["y2"] for b in boxes)))
            columns = [pa.array([v[k] for v in values], t) for k, t in enumerate((pa.int32(), pa.bool_(), *[pa.float64()] * 4))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("query_id"), *columns], names=schema.names)

    schema = rows.select("page_id", "query_id").schema.add("n_words", "integer").add("chained", "boolean")
    for name in ("x1", "y1", "x2", "y2"):
        schema = schema.add(name, "double")
    return rows.mapInArrow(found, schema)
