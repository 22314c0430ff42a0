"""Closest word windows of query passages on pages.

``pages``: page_id, ws (array of words).  ``queries``: query_id, qs (array of words).  A window is as long as its
query; its similarity is the share of equal words at equal positions.  Of all windows of a page the earliest that reaches
``EARLY_STOP`` wins, else the best, earliest on ties.

Every equal pair of a page word (position p) and a query word (position j) is a vote for the window at p - j, so all
scores come from counts of votes, page by page.  With a threshold far less has to be joined: a window that reaches
it misses few positions, so it holds one of any ``allowed misses + 1`` query positions, and the rarest words are
chosen; the few windows they name are then compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions.similarity import positional
from leafscan.functions.tokens import let
from leafscan.plans.shared import against_all, checkpointed, settled, taken_apart

EARLY_STOP, TOLERANCE = 0.95, 0.8
#: Queries of a block that goes to all pages.
BLOCK_QUERIES = 500


def _rank(similarity: Column, start: Column, early_stop: bool) -> Column:
    stopped = similarity >= EARLY_STOP
    best_first = F.struct(stopped.cast("int").alias("a"), F.when(stopped, F.lit(0.0)).otherwise(similarity).alias("b"), (-start).alias("c"))
    return best_first if early_stop else F.struct(similarity.alias("b"), (-start).alias("c"))


def _best(windows: DataFrame, early_stop: bool) -> DataFrame:
    """The winning window of every page and query, from page_id, query_id, qn, start, similarity."""
    winner = F.max_by(F.struct("start", "similarity", "qn"), _rank(F.col("similarity"), F.col("start"), early_stop))
    found = windows.groupBy("page_id", "query_id").agg(winner.alias("w"))
    return found.select(
        "page_id",
        "query_id",
        F.col("w.start").alias("start_index"),
        (F.col("w.start") + F.col("w.qn")).alias("end_index"),
        F.col("w.similarity").alias("similarity"),
    )


def _words_of(pages: DataFrame) -> DataFrame:
    return taken_apart(pages, "ws", "p", "word", "page_id", F.size("ws").alias("n"))


def _words_of_queries(queries: DataFrame) -> DataFrame:
    return queries.where(F.size("qs") > 0).select("query_id", F.size("qs").alias("qn"), F.posexplode("qs").alias("j", "word"))


def _in_page() -> Column:
    return (F.col("p") - F.col("j") >= 0) & (F.col("p") - F.col("j") + F.col("qn") <= F.col("n"))


class Votes:
    """The words of all queries with the places where they stand in them, to count equal words of every window of a page."""

    def __init__(self, queries: list[list[str]]):
        self.lengths = np.array([len(qs) for qs in queries], np.int64)
        places: dict[str, list[tuple[int, int]]] = {}
        for q, qs in enumerate(queries):
            for j, word in enumerate(qs):
                places.setdefault(word, []).append((q, j))
        self.number = {word: k for k, word in enumerate(places)}
        self.begins = np.cumsum([0, *map(len, places.values())])
        self.q, self.j = np.array([at for found in places.values() for at in found], np.int64).reshape(-1, 2).T

    def best(self, ws: list[str], early_stop: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries with an equal word in a window of the page, the best window's start and similarity."""
        at = [(p, k) for p, w in enumerate(ws) if (k := self.number.get(w)) is not None]
        p, k = np.array(at, np.int64).reshape(-1, 2).T
        counts = self.begins[k + 1] - self.begins[k]
        own = np.repeat(self.begins[k] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        q, start = self.q[own], np.repeat(p, counts) - self.j[own]
        inside = (start >= 0) & (start + self.lengths[q] <= len(ws))
        votes = np.sort(q[inside] * len(ws) + start[inside])
        first = np.flatnonzero(np.diff(votes, prepend=-1))
        named, seen = votes[first], np.diff(first, append=len(votes))
        q, start = named // max(1, len(ws)), named % max(1, len(ws))
        similarity = seen / self.lengths[q]
        stopped = (similarity >= EARLY_STOP) & early_stop
        order = np.lexsort((start, -np.where(stopped, 0.0, similarity), ~stopped, q))
        best = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
        return q[best], start[best], similarity[best]


def best_windows(pages: DataFrame, queries: DataFrame, early_stop: bool = True) -> DataFrame:
    """page_id, query_id, start_index, end_index (exclusive), similarity for all pairs with an equal word.

    As many rows as there are such pairs, so the queries should be few; they go to all pages, and a page's votes are counted
    beside it: nothing but the queries is shuffled.  ``closest_matches`` is the way for many.  Rows that share a page_id count
    as one page, and those of a query_id as one query: these few are joined and counted by their ids.
    """
    known = checkpointed(queries.where(F.size("qs") > 0).select("query_id", "qs"))
    again = settled(pages.groupBy("page_id").count().where("count > 1").select("page_id"))
    if known.groupBy("query_id").count().where("count > 1 OR query_id IS NULL").first() is not None:
        return _counted_windows(pages, known, early_stop)
    same = F.col("page_id").eqNullSafe(F.col("again"))
    twice = again.select(F.col("page_id").alias("again"))
    found = _windows_by_page(pages.join(twice, same, "left_anti"), known, early_stop)
    return found if again.first() is None else found.unionByName(_counted_windows(pages.join(twice, same, "left_semi"), known, early_stop))


def _counted_windows(pages: DataFrame, queries: DataFrame, early_stop: bool) -> DataFrame:
    """``best_windows`` by ids: votes of all pages are joined and counted."""
    votes = _words_of(pages).join(settled(_words_of_queries(queries)), "word").where(_in_page())
    counted = votes.groupBy("page_id", "query_id", "qn", (F.col("p") - F.col("j")).alias("start")).count()
    return _best(counted.withColumn("similarity", F.col("count") / F.col("qn")), early_stop)


def _windows_by_page(pages: DataFrame, queries: DataFrame, early_stop: bool) -> DataFrame:
    """``best_windows`` page by page."""
    schema = pages.select("page_id").schema.add("query_id", queries.schema["query_id"].dataType)
    for name, kind in (("start_index", "integer"), ("end_index", "integer"), ("similarity", "double")):
        schema = schema.add(name, kind)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, votes = None, None
        for batch in batches:
            for row in range(len(batch)):
                if batch.column(0)[row].as_py() != number:
                    number, texts = batch.column(0)[row].as_py(), batch.column(2)[row].as_py()
                    votes = Votes(texts)
                query_ids, page_ids, held = batch.column(1)[row].values, batch.column(3)[row].values, batch.column(4)[row].values
                for at in range(len(page_ids)):
                    q, start, similarity = votes.best(held[at].as_py(), early_stop)
                    if len(q):
                        ends = (start + votes.lengths[q]).astype(np.int32)
                        columns = [page_ids.take(pa.array([at] * len(q))), query_ids.take(pa.array(q)), pa.array(start.astype(np.int32)), pa.array(ends), pa.array(similarity)]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return against_all(pages, queries, BLOCK_QUERIES).mapInArrow(found, schema)


def closest_matches(pages: DataFrame, queries: DataFrame, threshold: float = TOLERANCE, early_stop: bool = True, votes: int = 1, pages_on: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The same, of windows that reach a threshold (at most ``EARLY_STOP``), by their rarest query words.

    ``pages_on`` gives the pages with the ids of a table; where it can choose them before their words are worked out, it
    spares that for pages without a candidate.

    With more ``votes`` that many more of the rarest words are joined and a window must hold as many of them, so
    fewer windows are compared where the threshold is low; the rows are the same.
    """
    if not 0 < threshold <= EARLY_STOP:
        raise ValueError(f"the threshold must be above 0 and at most {EARLY_STOP}")
    words, wanted = _words_of(pages), _words_of_queries(queries)
    frequency = words.join(settled(wanted.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("seen"))
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("seen", F.lit(0)), "j")
    misses = F.floor((1 - threshold) * F.col("qn") + 1e-9)
    least = F.least(F.lit(votes), F.col("qn") - misses)
    chosen = wanted.join(frequency, "word", "left").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= misses + least)
    near = words.join(settled(chosen.select("query_id", "qn", "j", "word")), "word").where(_in_page())
    # All starts of a page for a query in one row, so that the page's words are joined once.
    named = near.select("page_id", "query_id", (F.col("p") - F.col("j")).alias("start"), least.alias("least"))
    if votes > 1:
        named = named.repartition("page_id", "query_id").groupBy("page_id", "query_id", "start", "least").count().where("count >= least")
    starts = F.collect_set("start").alias("starts")
    # Passages are joined last: what is sent to the pages are a few numbers for each candidate.
    candidates = settled(named.groupBy("page_id", "query_id").agg(starts))
    own = pages_on(candidates) if pages_on else pages.select("page_id", "ws")
    both = candidates.join(own, "page_id").join(settled(queries.select("query_id", "qs")), "query_id")
    scored = lambda start: let(
        positional(F.slice("ws", start + 1, F.size("qs")), F.col("qs")),
        lambda s: F.struct(_rank(s, start, early_stop).alias("rank"), start.alias("start"), s.alias("similarity")),
    )
    best = F.array_max(F.filter(F.transform("starts", scored), lambda w: w["similarity"] >= threshold))
    found = both.select("page_id", "query_id", F.size("qs").alias("qn"), best.alias("w")).where("w is not null")
    return found.select("page_id", "query_id", F.col("w.start").alias("start_index"), (F.col("w.start") + F.col("qn")).alias("end_index"), F.col("w.similarity").alias("similarity"))


def closest_pages(pages: DataFrame, queries: DataFrame, most: int = 3, least: float = 0.4, early_stop: bool = True, votes: int = 4) -> DataFrame:
    """The ``most`` pages that are closest to each query: query_id, rank (from 1), page_id, start_index, end_index, similarity.

    Ties go to the smaller page; pages below ``least`` don't count, so a query may have fewer.  A query that has enough pages at
    ``TOLERANCE`` is done, as no page below can come before them; only the others are searched for again, at ``least``.
    """
    if not 0 < least <= TOLERANCE:
        raise ValueError(f"the least similarity must be above 0 and at most {TOLERANCE}")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "page_id")

    def closest(asked: DataFrame, threshold: float) -> DataFrame:
        found = closest_matches(pages, asked, threshold, early_stop, votes).withColumn("rank", F.row_number().over(order))
        return found.where(F.col("rank") <= most).select("query_id", "rank", "page_id", "start_index", "end_index", "similarity")

    near = checkpointed(closest(queries, TOLERANCE))
    done = settled(near.where(F.col("rank") == most).select("query_id"))
    return near.join(done, "query_id", "left_semi").unionByName(closest(queries.join(done, "query_id", "left_anti"), least))


def on_matched_pages(pages: DataFrame, matches: DataFrame) -> DataFrame:
    """The pages that have a match: only their texts need be taken apart into words."""
    return pages.join(matches.select("page_id"), "page_id", "left_semi")


def with_text(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """Matches with the text of their window."""
    joined = matches.join(pages.select("page_id", "ws"), "page_id")
    text = F.array_join(F.slice("ws", F.col("start_index") + 1, F.col("end_index") - F.col("start_index")), " ")
    return joined.select(*matches.columns, text.alias("text"))


def with_char_offsets(matches: DataFrame, words: DataFrame) -> DataFrame:
    """Matches with char_start and char_end in the page's text (words joined by single spaces)."""
    words = words.join(settled(matches.select("page_id").distinct()), "page_id", "left_semi")
    so_far = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.select("page_id", "pos", "word", F.coalesce(F.sum(F.length("word") + 1).over(so_far), F.lit(0)).alias("at"))
    joined = matches.join(placed, "page_id").where((F.col("pos") >= F.col("start_index")) & (F.col("pos") < F.col("end_index")))
    return joined.groupBy(*matches.columns).agg(F.min("at").alias("char_start"), F.max(F.col("at") + F.length("word")).alias("char_end"))


#: Pieces of marker text: white space, a marker, or a word, which ends where either begins.
PIECES = r"\s+|\[\[.*?\]\]|(?:(?!\[\[.*?\]\])\S)+"


def with_marker_offsets(matches: DataFrame, marked: DataFrame) -> DataFrame:
    """Matches with marker_start and marker_end in the page's marker text (page_id, marked).

    Two counts run along the text's pieces, words so far and characters so far; a match names words by the first, the
    second is where they stand.  Every word has a place of its own, so repeated words can't be mistaken.
    """
    marked = marked.join(settled(matches.select("page_id").distinct()), "page_id", "left_semi")
    pieces = taken_apart(marked, F.regexp_extract_all("marked", F.lit(PIECES), F.lit(0)), "k", "piece", "page_id")
    before = Window.partitionBy("page_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    is_word = ~(F.col("piece").rlike(r"^\s") | F.col("piece").rlike(r"^\[\[.*\]\]$"))
    counted = pieces.select(
        "page_id", is_word.alias("is_word"), F.length("piece").alias("size"), F.coalesce(F.sum(is_word.cast("int")).over(before), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("at")
    )
    joined = matches.join(counted.where("is_word").drop("is_word"), "page_id").where((F.col("pos") >= F.col("start_index")) & (F.col("pos") < F.col("end_index")))
    return joined.groupBy(*matches.columns).agg(F.min("at").alias("marker_start"), F.max(F.col("at") + F.col("size")).alias("marker_end"))


def top_matches(matches: DataFrame, most: int) -> DataFrame:
    """At most so many matches of each page, the most similar first, ties to the smaller query."""
    order = Window.partitionBy("page_id").orderBy(F.desc("similarity"), "query_id")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
