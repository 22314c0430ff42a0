"""Sections of matches, a row each."""

from leafscan.operators import highlight


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_matches_are_rows_of_a_batch(spark):
    """highlight_sections: no group of a pandas function for each match."""
    words = spark.createDataFrame([(1, 7, k, w, 10.0 * k, 5.0, 10.0 * k + 8, 9.0) for k, w in enumerate("an old house here".split())], "page_id long, query_id long, pos int, word string, x1 double, y1 double, x2 double, y2 double")
    sections = spark.createDataFrame([(7, 1, "house", "underline"), (7, 0, "old house", "strikethrough"), (8, 0, "old", "highlight")], "query_id long, ord int, text string, type string")
    found = highlight.highlighted(words, sections)
    assert "CoGroup" not in plan(found)
    assert rows(found) == [(1, 7, 0, "strikethrough", 2, 1, 10.0, 5.0, 28.0, 9.0, "old house", "10,5,28,9")]
    assert highlight.highlighted(words, sections, only_highlights=True).count() == 0
