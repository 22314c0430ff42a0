"""Pages are taken apart only where it is needed: those without a candidate keep their texts as they are."""

from pyspark.sql import functions as F

from leafscan.operators import chain, match
from leafscan.plans import document_queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def chosen(pages, asked):
    """The pages of ids, and what was asked for."""
    return lambda ids: asked.append(sorted({r["page_id"] for r in ids.select("page_id").collect()})) or pages.join(ids.select("page_id"), "page_id", "left_semi")


def test_pages_are_chosen_before_their_texts_are_split(spark):
    """match_character_boxes, highlight_sections: the semi-join with the found pages stands below the split."""
    text = plan(document_queries._pages_on(spark, FOLDER)(F.broadcast(spark.range(3).toDF("page_id"))))
    assert text.index("split(") < text.index("LeftSemi")


def test_only_pages_with_a_candidate_are_asked_for(spark):
    pages = spark.createDataFrame([(1, "the old house by the sea was sold".split()), (2, "nothing here".split()), (3, [])], "page_id long, ws array<string>")
    queries = spark.createDataFrame([(7, "old house by the sea".split())], "query_id long, qs array<string>")
    asked = []
    found = match.closest_matches(pages, queries, pages_on=chosen(pages, asked))
    assert asked == [[1]] and rows(found) == rows(match.closest_matches(pages, queries)) == [(1, 7, 1, 6, 1.0)]


def test_words_are_found_in_all_their_forms(spark):
    """gap_tolerant_boxes: words that clean to nothing keep their places, others are joined as they stand on the page."""
    page = "x — The OLD, house (by) -- the Sea: was sold İstanbul ΟΔΟΣ".split()
    pages = spark.createDataFrame([(1, page), (2, "other words".split()), (3, []), (4, None)], "page_id long, ws array<string>")
    texts = spark.createDataFrame([(7, "the old house by the sea"), (8, "sea was sold istanbul οδος"), (9, "...")], "query_id long, text string")
    asked = []
    found = chain.stretches(pages, texts, pages_on=chosen(pages, asked))
    assert asked == [[1]]
    assert rows(found) == rows(chain.stretches(pages, texts)) == [(1, 7, 6, 6, 2, 9), (1, 8, 5, 5, 8, 13)]
