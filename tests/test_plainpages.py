"""Plain pages read and rendered many at once: the same as page by page (hocr_roundtrip)."""

import random

import pyarrow as pa

from leafscan.sources import hocr, plainpages
from tests.test_pages import PIECES

LINE = "<span class='ocr_line' title='bbox 5 6 7 8'>"
WORDS = [
    f"<span class='ocrx_word' title='bbox 1 22 333 4444{conf}'>{text}</span>{gap}"
    for conf, text, gap in (("; x_wconf 95", "a&amp;b", " "), ("", "été", ""), ("; x_wconf 7", "  x　", " y "), ("", "&nbsp;", " "), ("", "", " "), ("", "a>b", " "), ("; x_wconf 0", " ", ""))
]
AROUND = ["<html><div class='ocr_page' title='bbox 0 0 9 9'>", "<p class='ocr_par'>", "</p>", "x", "<!--", "<script>", "&am", "</span>", "<span class='ocrx&#95;word' title='bbox 1 2 3 4'>q</span>", "<", ""]


def columns(pages):
    """Each page's words as ``hocr.page_columns`` gives them, None where the page isn't plain."""
    plain, own, made = plainpages.read(pa.array(pages, pa.string()), hocr._head, hocr._tail)
    names = [c.split()[0] for c in hocr.WORDS.split(", ")[2:]]
    values = [made[name]().to_pylist() for name in names]
    rows = [[] for _ in pages]
    for k, page in enumerate(own.tolist()):
        assert made["pos"]()[k].as_py() == len(rows[page])
        rows[page].append(tuple(v[k] for v in values))
    return [r if p else None for p, r in zip(plain.tolist(), rows, strict=True)]


def test_many_pages_read_at_once_are_what_the_parser_reads():
    draw, read = random.Random(4), 0
    for _ in range(300):
        pages = []
        for _ in range(12):
            body = "".join(LINE + "".join(draw.choices(WORDS, k=draw.randint(1, 4))) + "</span>" + draw.choice(["", " ", "z"]) for _ in range(draw.randint(1, 3)))
            page = draw.choice(AROUND[:3]) + body + draw.choice(AROUND)
            if draw.random() < 0.2:
                page = draw.choice(AROUND) + page
            if draw.random() < 0.2:
                at = draw.randint(0, len(page))
                page = page[:at] + draw.choice([*PIECES, *AROUND]) + page[at:]
            if draw.random() < 0.15:
                page = page[draw.randint(0, 60) : len(page) - draw.randint(0, 60)]
            if draw.random() < 0.2:
                page = "".join(draw.choices(PIECES, k=draw.randint(0, 14)))
            pages.append(draw.choice([None, ""]) if draw.random() < 0.03 else page)
        for page, found in zip(pages, columns(pages), strict=True):
            read += found is not None
            assert found is None or found == list(zip(*hocr._parsed_whole(page), strict=True)), page
    assert read > 1500


def test_laid_out_pages_are_read_at_once(spark, monkeypatch):
    """No page of ``rendered`` is left to be parsed by itself, and those that are give the same."""
    draw = random.Random(6)
    text = lambda: [draw.choice(["a", "été", "<b>&", "x" * 14, " n"]) for _ in range(draw.randint(1, 35))]
    pages = spark.createDataFrame([(k, text()) for k in range(60)] + [(60, []), (61, None)], "page_id long, ws array<string>")
    made = hocr.rendered(pages)
    held = {r["page_id"]: r["hocr"] for r in made.collect()}
    for row in pages.where("page_id < 60").collect():
        layout = {}
        assert f"<p class='ocr_par'>{hocr._body(row['ws'], layout)}</span></p>" in held[row["page_id"]]
    assert all(found is not None for found in columns([held[k] for k in range(60)]))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = [(k, n, *w, None) for k in range(60) for n, w in enumerate(zip(*hocr._parsed_whole(held[k]), strict=True))]
    none = [(k, *[None] * 14, "no words") for k in (60, 61)]
    assert rows(hocr.read_words(made)) == sorted([*whole, *none], key=str)
    assert rows(hocr.parsed_words(made, "page_id long, wconf int, word string")) == sorted([(w[0], w[10], w[5]) for w in whole], key=str)


def test_rows_are_dealt_into_slices():
    import numpy as np

    assert list(plainpages.slices(np.array([3, 3, 9, 0, 1]), 5)) == [(0, 2), (2, 3), (3, 5)]
    assert list(plainpages.slices(np.array([], int), 5)) == []
