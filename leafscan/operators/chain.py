"""Texts on pages where words are missing, added or misread: seeds of rare words, chained in order.

A text is *on* a page if some stretch of the page holds at least ``FOUND`` of its words in order, with at most
``ADDED`` times as many words more than the text has.  So at most ``misses`` of its words are missing, and of any
``misses + SEEDS`` of them ``SEEDS`` at least are in the chain.  The rarest are chosen and joined with the pages' words by
equality; hits of one chain lie on nearby diagonals (place on the page less place in the text), so they are counted in
overlapping bands of diagonals.  Only for a band with enough different seeds the page's stretch around it is cut out, and
the longest chain of all words, seeds or not, is worked out there.  No page meets a text without these seeds, and no page
leaves its row as a whole.

Words count as they are compared: lower case, without anything but letters, digits and ``_``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions.tokens import split_words
from leafscan.plans.shared import settled, taken_apart

#: Least share of a text's words in the chain; words between them, as a share of the text's; and seeds that must be there.
FOUND, ADDED, SEEDS = 0.7, 0.5, 4


def clean(word: Column) -> Column:
    """A word as it is compared."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}_]", "")


def clean_words(text: Column) -> Column:
    """The words of a text as they are compared, none empty."""
    return F.filter(F.transform(split_words(text), clean), lambda w: w != "")


def longest_chain(words: list[str], wanted: list[str], need: int, width: int) -> tuple[int, int, int] | None:
    """(length, first, last) of the longest chain of wanted words in their order within ``width`` words, if it has ``need``.

    Of equally long ones that with the earliest last word counts, then that with the latest first.
    """
    places = defaultdict(list)
    for j, word in enumerate(wanted):
        places[word].insert(0, j)
    hits = [(p, places[w]) for p, w in enumerate(words) if w in places]
    best = None
    for k, (first, _) in enumerate(hits):
        ends: list[int] = []  # the least place in the text at which a chain of each length ends
        last = first
        for p, js in hits[k:]:
            if p >= first + width:
                break
            for j in js:
                at = bisect_left(ends, j)
                if at == len(ends):
                    ends.append(j)
                    last = p
                else:
                    ends[at] = j
        found = (len(ends), -last, first)
        if len(ends) >= need and (best is None or found > best):
            best = found
    return best and (best[0], best[2], -best[1])


def stretches(pages: DataFrame, queries: DataFrame, found: float = FOUND, added: float = ADDED, seeds: int = SEEDS, pages_on: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """page_id, query_id, n_found, n_wanted, start_index, end_index (exclusive): where texts stand on pages.

    ``pages``: page_id, ws; ``queries``: query_id, text.  Indexes are of the page's words as they are.
    ``pages_on`` gives the pages with the ids of a table; where it can choose them before their words are worked out, it spares
    that for pages without enough seeds.
    """
    asked = queries.select("query_id", clean_words(F.col("text")).alias("qs")).where(F.size("qs") > 0)
    qn = F.size("qs")
    asked = asked.withColumns({"need": F.ceil(qn * found - 1e-9).cast("int"), "width": (qn + F.floor(qn * added)).cast("int")})
    wanted = asked.select("query_id", qn.alias("qn"), "need", "width", F.posexplode("qs").alias("j", "word"))
    # The forms in which wanted words stand on pages are found first, and joined as they are: most need no cleaning to be compared,
    # and what isn't wanted is counted nowhere.  (A word that could be null would be cleaned twice, for the join's filter too.)
    raw = F.col("raw")
    word = F.coalesce(F.when(raw.rlike(r"^[a-z0-9_]+\z"), raw).otherwise(clean(raw)), F.lit("")).alias("word")
    own = pages.select(F.explode_outer("ws").alias("raw")).select("raw", word)
    forms = settled(own.join(settled(wanted.select("word").distinct()), "word").groupBy("raw", "word").agg(F.count("*").alias("n")))
    words = taken_apart(pages.select("page_id", F.filter("ws", lambda w: w.rlike(r"[\p{L}\p{N}_]")).alias("ws")), "ws", "p", "raw", "page_id")
    seen = forms.groupBy("word").agg(F.sum("n").alias("seen"))
    misses = F.col("qn") - F.col("need")
    few = F.least(F.lit(seeds), F.col("need"))
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("seen", F.lit(0)), "j")
    chosen = wanted.join(seen, "word", "left").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= misses + few)
    # A chain's diagonals lie between first - misses and first + width - need: one of two neighbouring bands holds them all.
    across = F.col("width") - F.col("need") + misses + 1
    diagonal = F.col("p") - F.col("j")
    named = chosen.select("query_id", "word", "j", across.alias("across"), few.alias("few"), (F.col("width") - F.col("need")).alias("before"), (misses + F.col("width")).alias("after"))
    hits = words.join(settled(named.join(forms.select("word", "raw"), "word")), "raw")
    hits = hits.withColumn("d", diagonal).withColumn("band", F.explode(F.array(F.floor(F.col("d") / F.col("across")), F.floor(F.col("d") / F.col("across")) - 1)))
    bands = hits.groupBy("page_id", "query_id", "band").agg(
        F.size(F.collect_set("j")).alias("n"), F.first("few").alias("few"), F.min(F.col("d") - F.col("before")).alias("low"), F.max(F.col("d") + F.col("after")).alias("high")
    )
    near = settled(bands.where("n >= few").select("page_id", "query_id", F.greatest("low", F.lit(0)).cast("int").alias("low"), "high"))
    # Only pages near a text are cleaned again, with the places of their words, to cut the stretches out.
    own_pages = pages_on(near) if pages_on else pages.join(near.select("page_id"), "page_id", "left_semi")
    marked = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("pos"), clean(w).alias("word"))), lambda s: s["word"] != "")
    held = own_pages.select("page_id", marked.alias("held"))
    cut = near.join(held, "page_id").withColumn("held", F.slice("held", F.col("low") + 1, F.greatest(F.col("high") - F.col("low"), F.lit(0)).cast("int")))
    cut = cut.where(F.size("held") > 0).join(asked, "query_id")

    schema = cut.select("page_id", "query_id").schema.add("n_found", "integer").add("n_wanted", "integer").add("start_index", "integer").add("end_index", "integer")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for k, row in enumerate(batch.select(["held", "qs", "need", "width"]).to_pylist()):
                if best := longest_chain([h["word"] for h in row["held"]], row["qs"], row["need"], row["width"]):
                    length, first, last = best
                    kept.append(k)
                    rows.append((length, len(row["qs"]), row["held"][first]["pos"], row["held"][last]["pos"] + 1))
            numbers = [pa.array([r[n] for r in rows], pa.int32()) for n in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept, pa.int64())) for c in ("page_id", "query_id")), *numbers], names=schema.names)

    made = cut.select("page_id", "query_id", "held", "qs", "need", "width").mapInArrow(chained, schema)
    order = F.struct("n_found", (-F.col("end_index")).alias("e"), "start_index")
    best = made.groupBy("page_id", "query_id").agg(F.max_by(F.struct("n_found", "n_wanted", "start_index", "end_index"), order).alias("b"))
    return best.select("page_id", "query_id", "b.*")
