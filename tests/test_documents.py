from leafscan.operators import highlight
from leafscan.plans.annotate import Options, annotate_pages, annotate_with_highlights
from leafscan.sources import hocr

PAGE = """<div class='ocr_page' title='image "x"; bbox 0 0 2560 3300'><p class='ocr_par'>
<span class='ocr_line' title="bbox 100 200 500 240"><span class='ocrx_word' title='bbox 100 200 200 230; x_wconf 90'>Hello</span>
<span class='ocrx_word' title='bbox 210 200 300 230'><strong>W&amp;rld</strong></span></span>
<span class='ocr_line' title="bbox 100 300 500 340"><span class='ocrx_word' title='bbox 100 300 200 330'>second</span>
<span class='ocrx_word' title='bbox 210 300 300 330'> line </span><span class='ocrx_word' title='bbox 310 300 320 330'> </span></span></p>
<span class='ocr_textfloat' title='bbox 1 1 9 9'><span class='ocrx_word' title='bbox 1 1 9 9'>float</span></span></div>"""


def test_parsed_words(spark):
    pages = spark.createDataFrame([(5, PAGE), (6, None), (7, "<p>none</p>")], "page_id long, hocr string")
    rows = hocr.parsed_words(pages).orderBy("pos").collect()
    assert [(r["page_id"], r["word"], r["line_no"], r["line_class"]) for r in rows] == [
        (5, "Hello", 0, "ocr_line"), (5, "W&rld", 0, "ocr_line"), (5, "second", 1, "ocr_line"), (5, "line", 1, "ocr_line"), (5, "float", 2, "ocr_textfloat"),
    ]
    assert (rows[0]["wconf"], rows[1]["wconf"], rows[1]["x2"]) == (90, None, 300.0)
    marked = hocr.marker_text_of(hocr.parsed_words(pages)).first()["marked"]
    assert marked == "[[PARAGRAPH]] [[LINE 100 200 500 240]] Hello W&rld [[LINE 100 300 500 340]] second line"
    sizes = {r["page_id"]: r["d"] for r in pages.select("page_id", hocr.page_dimensions(pages["hocr"]).alias("d")).collect()}
    assert tuple(sizes[5]) == (2560, 3300) and sizes[6] is None and sizes[7] is None


def test_annotate(spark):
    pages = spark.createDataFrame([(5, PAGE), (7, "<p>none</p>")], "page_id long, hocr string")
    queries = spark.createDataFrame([(1, "second line", "underline", "#00f", None)], "query_id long, text string, annotation_type string, color string, background_color string")
    found, errors = annotate_pages(pages, queries, Options(max_results=3))
    row = found.first()
    assert (row["x1"], row["y1"], row["x2"], row["y2"], row["text"], row["op"]) == (100, 300, 300, 330, "second line", "line")
    assert abs(row["x"] - 100 * 612 / 2560) < 1e-9 and abs(row["y"] - (792 - 330 * 0.24)) < 1e-9
    assert (row["border_r"], row["border_b"], row["font_b"]) == (0, 1, 0.8)
    assert [r["page_id"] for r in errors.collect()] == [7]


def test_sections():
    html = '<s>one two</s> plain <span style=\\"background-color: rgb(255, 0, 10)\\">three <u>four</u></span><u>five</u><span style="background-color: red">six</span>'
    found = [(s["text"], s["type"], s["hex_color"]) for s in highlight.formatted_sections(html)]
    assert found == [("one two", "strikethrough", "#ff0000"), ("three four", "highlight", "#ff000a"), ("five", "underline", "#0000ff")]


def word(text, x, y):
    return {"word": text, "x1": x, "y1": y, "x2": x + 50, "y2": y + 20}


def test_section_search_uses_words_once():
    words = highlight.reading_order([word("b", 60, 3), word("a", 0, 0), word("a", 0, 40), word("b", 60, 42), word("c", 120, 41)])
    assert [w["word"] for w in words] == ["a", "b", "a", "b", "c"]
    first = highlight.found_section(words, ["a", "b"])
    assert first == words[:2]
    for w in first:
        w["used"] = True
    assert highlight.found_section(words, ["a", "b", "c"]) == words[2:]
    assert len(highlight.line_clusters(words)) == 2
    assert highlight.found_section(words, ["zzzz"]) == []


def test_highlights_over_pages(spark):
    pages = spark.createDataFrame([(5, PAGE)], "page_id long, hocr string")
    queries = spark.createDataFrame([(1, "W&rld second line", "<s>W&amp;rld second</s> <u>line</u>")], "query_id long, text string, html string")
    rows = annotate_with_highlights(hocr.parsed_words(pages), queries).orderBy("ord").collect()
    assert [(r["type"], r["n_words"], r["n_quads"], r["text"]) for r in rows] == [("strikethrough", 2, 2, "W&rld second"), ("underline", 1, 1, "line")]
