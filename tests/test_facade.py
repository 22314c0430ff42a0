import pytest
from pyspark.sql import functions as F

import leafscan
from leafscan.operators import cache, citations, geometry
from leafscan.plans import annotate
from leafscan.sources import hocr
from tests.test_documents import PAGE

QUERIES = "query_id long, text string, annotation_type string, color string, background_color string"


def test_a_page_that_fails_is_named_and_the_others_go_on(spark, monkeypatch):
    pages = spark.createDataFrame([(5, PAGE), (6, None), (7, "<p>none</p>")], "page_id long, hocr string")
    queries = spark.createDataFrame([(1, "second line", "underline", None, None), (2, "Hello W&rld", "highlight", None, None)], QUERIES)
    found, failed = annotate.annotate_pages(pages, queries)
    assert {(r["query_id"], r["annotation_type"]) for r in found.collect()} == {(1, "underline"), (2, "highlight")}
    assert {r["page_id"]: r["error"] for r in failed.collect()} == {6: "no words", 7: "no words"}
    assert annotate.annotate_page(5, PAGE, queries).count() == 2
    with pytest.raises(ValueError, match="page 9: no words"):
        annotate.annotate_page(9, "<p></p>", queries)


def test_boxes_are_scaled_from_the_pages_own_size(spark):
    def page(size):
        return f"<div class='ocr_page'{size}><p class='ocr_par'><span class='ocr_line' title='bbox 0 0 1000 500'><span class='ocrx_word' title='bbox 0 0 1000 500'>whole</span></span></p></div>"

    pages = spark.createDataFrame([(1, page(" title='image \"x\"; bbox 0 0 1000 1000'")), (2, page(" title='bbox 0 0 2000 500'")), (3, page("")), (4, page(" title='bbox 0 0 1000 1000'"))], "page_id long, hocr string")
    queries = spark.createDataFrame([(1, "whole", "highlight", None, None)], QUERIES)
    targets = spark.createDataFrame([(3, 500.0, 1000.0), (4, 500.0, 1000.0), (2, None, 5.0)], "page_id long, width double, height double")

    def boxes(options=annotate.Options(), targets=None):
        found, _ = annotate.annotate_pages(pages, queries, options, targets)
        return {r["page_id"]: (r["x"], r["y"], r["width"], r["height"]) for r in found.collect()}

    assert boxes() == {1: (0, 396, 612, 396), 2: (0, 0, 306, 792), 3: (0, 292, 1000, 500), 4: (0, 396, 612, 396)}
    assert boxes(targets=targets) == {1: (0, 396, 612, 396), 2: (0, 0, 306, 792), 3: (0, 500, 1000, 500), 4: (0, 500, 500, 500)}
    assert boxes(annotate.Options(page_width=2000.0, page_height=1000.0))[1] == (0, 396, 306, 396)
    # Words alone tell no size: the fixed one.
    words = hocr.parsed_words(pages.where("page_id = 1"))
    assert round(annotate.annotate(words, queries).first()["width"], 3) == 239.062


def test_rich_text_queries_are_annotated_once(spark):
    pages = spark.createDataFrame([(5, PAGE)], "page_id long, hocr string")
    texts = [(1, "<u>second line</u> and <strong>more</strong>"), (2, "<u>second line</u>"), (3, "Hello W&rld"), (4, "{\\rtf1\\ansi \\strike second line\\par }")]
    found, failed = annotate.annotate_rich_text(pages, spark.createDataFrame(texts, "query_set long, text string"))
    assert sorted((r["annotation_type"], r["text"]) for r in found.collect()) == [("rectangle", "Hello W&rld"), ("strikethrough", "second line"), ("underline", "second line")]
    assert failed.count() == 0


def test_citations_over_annotations(spark):
    pages = spark.createDataFrame([(5, PAGE)], "page_id long, hocr string")
    queries = spark.createDataFrame([(1, "second line", "underline", None, None), (2, "Hello W&rld", "highlight", None, None)], QUERIES)
    sources = spark.createDataFrame([(5, "A Title", "An Author", "An Org", "http://a.b")], "page_id long, title string, author string, organization string, url string")
    day = F.lit("2024-01-15").cast("date")
    found, cited, listed = annotate.annotate_with_citations(pages, queries, sources, "mla", day)
    assert found.count() == 2
    assert {r["citation"] for r in cited.collect()} == {'An Author. "A Title." An Org, January 15, 2024, http://a.b. Accessed January 15, 2024.'}
    assert [r["line_no"] for r in listed.orderBy("line_no").collect()] == [1, 2]
    with pytest.raises(Exception, match="no page 5"):
        annotate.annotate_with_citations(pages, queries, sources.where("page_id = 0"), "mla", day)


def test_reading_and_writing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.hocr").write_text(PAGE)
    read = hocr.read_pages(spark, str(tmp_path / "in"))
    assert read.first()["hocr"] == PAGE and read.first()["path"].endswith("a.hocr")
    assert read.select(hocr.head(F.col("hocr"), 4).alias("h")).first()["h"] == "<div"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        hocr.read_pages(spark, str(tmp_path / "no.hocr")).collect()
    content = hocr.read_binary(spark, str(tmp_path / "in"))
    assert content.select(hocr.output_as(F.col("content"), "base64").alias("c")).first()["c"].startswith("PGRpdiBj")
    assert bytes(content.select(hocr.output_as(F.col("content"), "binary").alias("c")).first()["c"]) == PAGE.encode()
    with pytest.raises(ValueError, match="unsupported"):
        hocr.output_as(F.col("content"), "blob")
    marked = hocr.marker_text_of(hocr.parsed_words(read.select(F.lit(5).alias("page_id"), "hocr")))
    hocr.write_marker_text(marked, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "page_id=5")).first()["value"] == marked.first()["marked"]
    assert leafscan.__version__


def test_word_lists_formats_and_stores(spark):
    words = hocr.parsed_words(spark.createDataFrame([(5, PAGE)], "page_id long, hocr string")).where("line_class = 'ocr_line'")
    assert hocr.spanning_marker_text(words).first()["marked"] == "[[PARAGRAPH]] [[LINE 100 200 300 330]] Hello W&rld second line "
    shown = {r["format"]: r["example"] for r in citations.formats(spark).collect()}
    assert shown["apa"] == "Smith, J. (2023). Sample Document Analysis. Research Institute. Retrieved March 20, 2024, from https://example.com/document.pdf" and len(shown) == 5
    entries = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "store string, key long, data string")
    assert {tuple(r) for r in cache.without_keys(entries, entries.where("data = 'x'")).collect()} == {("a", 2, "y"), ("b", 1, "z")}
    assert cache.without_stores(entries, "a").count() == 1 and cache.without_stores(entries).count() == 0
    assert entries.select(cache.packed(F.struct("store", "key")).alias("p")).where("key is null or p like '{\"store\":%'").count() == 3


def test_sizes_styles_and_checks(spark):
    pages = spark.createDataFrame([(1, 2560.0, 3300.0), (2, None, 3300.0), (3, None, None)], "page_id long, width double, height double")
    targets = spark.createDataFrame([(2, 595.0, 842.0), (3, 10.0, None)], "page_id long, width double, height double")
    sizes = {r["page_id"]: (r["width"], r["height"]) for r in geometry.sized_pages(pages, targets).collect()}
    assert sizes == {1: (2560.0, 3300.0), 2: (595.0, 842.0), 3: (612.0, 792.0)}
    assert {(r["width"], r["height"]) for r in geometry.sized_pages(pages, targets, 7.0, 8.0).collect()} == {(7.0, 8.0)}
    box = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0), (0.0, 1.0, 0.0, 3.0), (float("nan"), 1.0, 2.0, 3.0), (0.0, None, 2.0, 3.0)], "x double, y double, w double, h double")
    assert box.where(geometry.valid_box(*[F.col(c) for c in "xywh"])).count() == 1
