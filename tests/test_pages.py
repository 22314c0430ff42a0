"""Pages worked on as a whole, a row each: the same as by words and parser, without a shuffle of words."""

import random

import pyarrow as pa

from leafscan.operators import fuzzy, match
from leafscan.plans import annotate, document_queries
from leafscan.sources import hocr
from leafscan.sources.tables import word_boxes

WORD, LINE = "<span class='ocrx_word' title='bbox 1 2 3 4; x_wconf 95'>a&amp;b</span>", "<span class='ocr_line' title='bbox 5 6 7 8'>"
PIECES = [
    "<p class='ocr_par'>", "</p>", LINE, "<span class='ocr_line'>", "<span class='ocr_header' title='bbox 1 2 3 4'>", "</span>", f"</span> {LINE}", WORD, WORD, WORD, '<span class="ocrx_word" title="bbox 9 2 3 4">c</span>',
    " ", "x", "&am", "<!-- ", "-->", "<script>", "</script>", "<span class='ocrx_word' title='bbox 1 2 3 4'> </span>", "<span class='ocrx_word' id='k'><b>q</b></span>", "<span class='ocrx_word' title='bbox 1 2 3 4'>q", "<div>", "<br>", "<",
]
PAGE = f"<div class='ocr_page' title='bbox 0 0 2560 3300'><p class='ocr_par'>{LINE}{WORD} {WORD}</span></p></div>"


def test_plain_words_are_what_the_parser_reads():
    draw, plain = random.Random(5), 0
    for _ in range(3000):
        page = "".join(draw.choices(PIECES, k=draw.randint(0, 14)))
        found = hocr._parsed_plain(page)
        plain += found is not None
        assert found is None or found == hocr._parsed_whole(page), page
    assert plain > 300


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_bare_texts_are_kept_of_pages_that_are_searched(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(annotate, "checkpointed", lambda df: kept.append(df.columns) or df)
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, hocr string")
    queries = spark.createDataFrame([(1, "a&b a&b", "underline", None, None)], "query_id long, text string, annotation_type string, color string, background_color string")
    found, failed = annotate.annotate_pages(pages, queries)
    assert kept[0] == ["page_id", "text", "width", "height", "error"] and all("word" not in columns for columns in kept)
    assert [(r["page_id"], r["text"], r["x1"], r["y2"]) for r in found.collect()] == [(1, "a&b a&b", 1, 4)]
    assert [tuple(r) for r in failed.collect()] == [(2, "no words")]


def test_pages_are_rendered_as_they_are_laid_out(spark):
    words = [f"w{k}&<>" + "x" * k for k in range(23)]
    pages = spark.createDataFrame([(1, words), (2, []), (3, None), (4, ["a\0b", None, "c"])], "page_id long, ws array<string>")
    rows = {r["page_id"]: r["hocr"] for r in hocr.rendered(pages).collect()}
    assert rows[2] == "<html><body><div class='ocr_page' title='bbox 0 0 2560 3300'><p class='ocr_par'></p></div></body></html>" and rows[3] is None
    assert ">a\0b</span>" in rows[4] and ">c</span>" in rows[4]
    wanted = [tuple(r) for r in word_boxes(pages.where("page_id = 1")).orderBy("pos").select("word", "line_no", "x1", "y1", "x2", "y2").collect()]
    assert [(w["text"], w["line"], *w["box"]) for w in hocr.page_words(rows[1])] == wanted
    assert hocr.page_words(rows[1])[10]["line_box"] == (wanted[10][2], wanted[10][3], wanted[19][4], wanted[19][5])


def test_pages_are_not_taken_into_words_to_be_put_together(spark):
    """hocr_marker_text and page_errors work page by page."""
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>")], "page_id long, hocr string")
    marked, errors = hocr.marker_texts(pages), hocr.read_errors(pages)
    assert "Exchange" not in plan(marked) and "Exchange" not in plan(errors)
    assert [tuple(r) for r in marked.collect()] == [tuple(r) for r in hocr.marker_text_of(hocr.parsed_words(pages)).collect()]
    assert [tuple(r) for r in errors.collect()] == [(2, "no words")]


def test_votes_are_counted_beside_their_page(spark):
    """closest_match_best: no row for every vote is shuffled; pages and queries that share an id count as before."""
    draw = random.Random(3)
    text = lambda n: [draw.choice("abcde") for _ in range(n)]
    pages = spark.createDataFrame([(k, text(draw.randint(0, 30))) for k in range(40)], "page_id long, ws array<string>")
    queries = spark.createDataFrame([(k, text(draw.randint(0, 6))) for k in range(12)], "query_id long, qs array<string>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for early in (True, False):
        found = match.best_windows(pages, queries, early)
        assert "Exchange hashpartitioning" not in plan(found)
        assert rows(found) == rows(match._counted_windows(pages, queries, early))
        twice = pages.unionByName(pages.where("page_id % 9 = 0").withColumn("ws", pages["ws"]))
        assert rows(match.best_windows(twice, queries, early)) == rows(match._counted_windows(twice, queries, early))
    assert rows(match.best_windows(pages, queries.unionByName(queries.limit(3)))) == rows(match._counted_windows(pages, queries.unionByName(queries.limit(3)), True))


def test_bounds_of_the_fuzzy_search_leave_nothing_out():
    """fuzzy_match_fallback and fuzzy_passages: what is left out before the search has no window that reaches the threshold."""
    draw, left_out = random.Random(8), 0
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(1, 7)))
    queries = [(k, [word() for _ in range(draw.randint(1, 9))]) for k in range(25)]
    for threshold in (0.4, 0.6, 0.8):
        asked = fuzzy.Asked(queries)
        for _ in range(25):
            page = [word() for _ in range(draw.randint(1, 25))]
            for _ in range(2):  # a query with misread letters
                own = ["".join(c if draw.random() < 0.9 else draw.choice("abcxyz") for c in w) for w in draw.choice(queries)[1]]
                page[(at := draw.randint(0, len(page))) : at] = own
            assert sorted(fuzzy.page_windows(page, asked, threshold)) == sorted(fuzzy.best_windows(page, fuzzy.Asked(queries), threshold))
            left_out += (~asked.possible(page, threshold)).sum()
    assert left_out > 300


def test_a_list_of_words_is_marked_in_its_row(spark):
    """word_list_markers: words aren't shuffled to be put together again."""
    found = document_queries.word_list_markers(spark, "/root/testdata/sf0.001")
    assert "Exchange hashpartitioning" not in plan(found) and "collect_list" not in plan(found)
    pages = document_queries.pages(spark, "/root/testdata/sf0.001")
    marked = hocr.spanning_marker_text(word_boxes(pages)).selectExpr("page_id", "length(marked) AS chars", "md5(marked) AS marked_md5")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, marked.collect()))


def test_pages_without_a_near_query_are_left_out_together(monkeypatch):
    """fuzzy_passages: words are compared one by one only where a page has a window near a query, wherever parts of a run of pages end."""
    draw, read = random.Random(9), []
    word = lambda: "".join(draw.choices("aaeeinnorsthdlu.é", k=draw.randint(1, 9)))
    misread = lambda w: "".join(c if draw.random() < 0.95 else draw.choice("aexyz%") for c in w)
    queries = [(k, [word() for _ in range(draw.randint(10, 30))]) for k in range(20)]
    pages = [[word() for _ in range(draw.randint(1, 60))] for _ in range(120)]
    for page in pages[::6]:
        page[(at := draw.randint(0, len(page))) : at] = map(draw.choice([misread, lambda w: w + "%%", str]), draw.choice(queries)[1])
    wanted = {(k, *w) for k, page in enumerate(pages) for w in fuzzy.best_windows(page, fuzzy.Asked(queries), 0.8)}
    assert len(wanted) >= 12
    likeness = fuzzy.Asked.likeness
    monkeypatch.setattr(fuzzy.Asked, "likeness", lambda self, words: read.append(len(words)) or likeness(self, words))
    for part, held in ((8192, 1 << 18), (64, 128), (7, 7)):
        monkeypatch.setattr(fuzzy, "PART", part)
        monkeypatch.setattr(fuzzy, "HELD_WORDS", held)
        asked, found = fuzzy.Asked(queries), set()
        read.clear()
        for k in range(0, len(pages), 50):
            near = asked.near(pa.array(pages[k : k + 50], pa.list_(pa.string())), 0.8)
            found |= {(k + at, *w) for at, some in near.items() for w in fuzzy._windows(pages[k + at], asked, some, 0.8)}
        assert found == wanted
        assert len(read) <= 20 and sum(read) < sum(map(len, pages)) / 3
