"""Recognised pages (hOCR): reading, parsing into positioned words, rendering.

Pages are parsed by the standard library's HTML parser in Arrow batches, one page at a time; everything after that
is relational.  Plain word elements, nearly all of a page, are taken by one pattern, and the parser sees only what
stands between them; a page where that could differ is parsed whole.  Where words are the result, plain pages are read many
at once (``plainpages``).  Classes are matched as whole tokens.  A word keeps
the class of its line, so that searching can leave out floating text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import escape, unescape
from html.parser import HTMLParser
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.functions.tokens import box_of_title
from leafscan.sources import plainpages
from leafscan.sources.tables import LINE_WORDS, LONGEST, placed

ERRORS = "page_id long, error string"
WORDS = "page_id long, pos int, par_no int, line_no int, line_class string, word string, x1 double, y1 double, x2 double, y2 double, wconf int, lx1 double, ly1 double, lx2 double, ly2 double"
_BBOX = re.compile(r"bbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)")
_CONF = re.compile(r"x_wconf\s+(\d+)")
_LINES = ("ocr_line", "ocr_textfloat", "ocr_header", "ocr_caption")


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, hocr: one row for each file; a path that isn't there is an error."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("hocr"))


def read_binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content of whole binary files."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def output_as(content: Column, fmt: str) -> Column:
    """Binary content as ``binary`` or ``base64``."""
    if fmt not in ("binary", "base64"):
        raise ValueError(f"unsupported output format: {fmt}")
    return F.base64(content) if fmt == "base64" else content


def head(hocr: Column, chars: int = 2000) -> Column:
    """The beginning of a raw page, to look at."""
    return F.substr(hocr, F.lit(1), F.lit(chars))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []
        self.par = self.line = -1
        self.line_class = ""
        self.line_box: tuple | None = None
        self.word: dict | None = None
        self.words: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        classes, title = (named.get("class") or "").split(), named.get("title") or ""
        kind = None
        if "ocr_par" in classes:
            kind, self.par = "par", self.par + 1
        elif found := next((c for c in _LINES if c in classes), None):
            kind, self.line, self.line_class = "line", self.line + 1, found
            box = _BBOX.search(title)
            self.line_box = tuple(map(float, box.groups())) if box else None
        elif "ocrx_word" in classes:
            kind, box, conf = "word", _BBOX.search(title), _CONF.search(title)
            self.word = {"text": "", "box": tuple(map(float, box.groups())) if box else None, "wconf": int(conf[1]) if conf else None}
        if tag not in ("br", "meta", "link", "img", "hr", "input"):
            self.stack.append((tag, kind))

    def handle_data(self, data: str) -> None:
        if self.word is not None:
            self.word["text"] += data

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is None:
            return
        for _, kind in self.stack[at:]:
            if kind == "word" and self.word is not None:
                self.words.append(self.word | {"par": self.par, "line": self.line, "class": self.line_class, "line_box": self.line_box})
                self.word = None
            elif kind == "line":
                self.line_class, self.line_box = "", None
        del self.stack[at:]


def _element(name: str, more: str = "") -> str:
    return rf"<span class=(?P<q>['\"]){name}(?P=q) title=(?P=q)bbox (\d+) (\d+) (\d+) (\d+){more}(?P=q)>"


#: What stands before a plain word element; its box, confidence and text.  The end of a line and the beginning of the next.
_PLAIN = re.compile(rf"([^<]*(?:<(?!span class=['\"]ocrx_word['\"])[^<]*)*){_element('ocrx_word', r'(?:; x_wconf (\d+))?')}([^<>]*)</span>")
_NEXT_LINE = re.compile(rf"\s*</span>\s*{_element('ocr_line')}\s*")

#: A page's words, a list each of paragraph, line, class, text, four sides, confidence, and four sides of the line.
Columns = tuple[list, ...]


def _parsed_whole(hocr: str) -> Columns:
    reader = _Reader()
    reader.feed(hocr)
    reader.close()
    none = (None,) * 4
    rows = [(w["par"], w["line"], w["class"], text, *(w["box"] or none), w["wconf"], *(w["line_box"] or none)) for w in reader.words if (text := w["text"].strip())]
    return tuple(map(list, zip(*rows, strict=True))) if rows else ([],) * 13


def _parsed_plain(hocr: str) -> Columns | None:
    """The same by the pattern of plain words; None where the page has others, or a word's place isn't certain."""
    last = hocr.find("</span>", hocr.rfind("ocrx_word")) + len("</span>")
    found = _PLAIN.findall(hocr, 0, last) if "ocrx_word" in hocr else []
    if not found or len(found) != hocr.count("ocrx_word"):
        return None
    between, _, x1, y1, x2, y2, conf, texts = zip(*found, strict=True)
    reader, lines, begun = _Reader(), [], []
    for k, gap in enumerate((*between, hocr[last:])):
        if gap == " " or k and gap.isspace():
            continue
        if (line := _NEXT_LINE.fullmatch(gap)) and reader.stack[-1:] == [("span", "line")]:
            reader.line, reader.line_class, reader.line_box = reader.line + 1, "ocr_line", tuple(map(float, line.groups()[1:]))
        elif gap:
            reader.feed(gap)
            if k < len(texts) and (reader.rawdata or reader.cdata_elem) or reader.word or reader.words:
                return None
        begun.append(k)
        lines.append((reader.par, reader.line, reader.line_class, reader.line_box or (None,) * 4))
    reader.close()
    if not begun or begun[0]:  # a page that begins with a word
        begun, lines = [0, *begun], [(-1, -1, "", (None,) * 4), *lines]
    counts = [min(b, len(texts)) - min(a, len(texts)) for a, b in zip(begun, [*begun[1:], len(texts)], strict=True)]
    repeated = lambda value: list(chain.from_iterable([value(line)] * n for line, n in zip(lines, counts, strict=True)))
    words = [t.strip() for t in (map(unescape, texts) if any("&" in t for t in texts) else texts)]
    sides = [repeated(lambda line, k=k: line[3][k]) for k in range(4)]
    columns = [*(repeated(lambda line, k=k: line[k]) for k in range(3)), words, *(list(map(float, c)) for c in (x1, y1, x2, y2)), [int(c) if c else None for c in conf], *sides]
    if not all(words):
        kept = [k for k, w in enumerate(words) if w]
        columns = [[c[k] for k in kept] for c in columns]
    return tuple(columns)


def page_columns(hocr: str | None) -> Columns:
    """The words of one page in document order, trimmed, blank ones left out."""
    found = _parsed_plain(hocr or "")
    return _parsed_whole(hocr or "") if found is None else found


def page_words(hocr: str | None) -> list[dict]:
    """The words of one page, a dictionary each."""
    box = lambda sides: None if sides[0] is None else sides
    return [{"text": w[3], "box": box(w[4:8]), "wconf": w[8], "par": w[0], "line": w[1], "class": w[2], "line_box": box(w[9:])} for w in zip(*page_columns(hocr), strict=True)]


#: Words of a batch of parsed pages, about.
BATCH_WORDS = 16_384
#: Bytes of texts that are rendered at once, about; pages have some fifteen times as many.
BATCH_CHARS = 1 << 18
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _read(hocr: str | None) -> tuple[Columns, str | None]:
    """A page's words, and its error if it can't be read or has none."""
    try:
        found = page_columns(hocr)
    except Exception as failure:  # noqa: BLE001 - whatever is wrong with a page, the others go on
        return ([],) * 13, f"{type(failure).__name__}: {failure}"
    return found, None if found[0] else "no words"


def _each_page(pages: DataFrame, made: Callable[[int, str | None, Columns, str | None], tuple | None], columns: str) -> DataFrame:
    """The columns that ``made`` gives for each page (page_id, hocr), a list each of its rows, or None for none."""
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, columns.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in schema]
        for batch in batches:
            for row in range(len(batch)):
                page, hocr = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                for column, values in zip(held, made(page, hocr, *_read(hocr)) or (), strict=False):
                    column += values
                if len(held[0]) >= BATCH_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema)
                    held = [[] for _ in schema]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("hocr").cast("string").alias("hocr")).mapInArrow(rows, columns)


@lru_cache(1024)
def _head(hocr: bytes) -> int | None:
    """The number of the paragraph that is open after the beginning of a page; None if it isn't certain that only that is."""
    reader = _Reader()
    try:
        reader.feed(hocr.decode())
    except Exception:  # noqa: BLE001 - such a page is left to the parser as a whole
        return None
    return None if reader.rawdata or reader.cdata_elem or reader.word or reader.words or reader.line >= 0 else reader.par


@lru_cache(1024)
def _tail(hocr: bytes) -> bool:
    """Whether the end of a page has no word."""
    reader = _Reader()
    try:
        reader.feed(hocr.decode())
        reader.close()
    except Exception:  # noqa: BLE001
        return False
    return not (reader.word or reader.words)


#: Bytes of pages that are read at once, about.
READ_BYTES = 4 << 20


def read_words(pages: DataFrame, columns: str = f"{WORDS}, error string") -> DataFrame:
    """``WORDS`` of pages (page_id, hocr) and their ``error``: a page that can't be read or has no word is one row of it.

    Of the columns only those asked for are made; ``page_id`` must be the first.
    """
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, columns.split(", "))])
    order = [n.split()[0] for n in WORDS.split(", ")[2:]]

    def of_page(page: int, hocr: str | None) -> list[pa.Array]:
        words, error = _read(hocr)
        n = len(words[0])
        values = dict(zip(order, words, strict=True)) if n else {name: [None] for name in order}
        values |= {"page_id": [page] * (n or 1), "pos": range(n) if n else [None], "error": [error] * (n or 1)}
        return [pa.array(values[f.name], f.type) for f in schema]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in plainpages.slices(sizes, READ_BYTES):
                ids, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                plain, own, made = plainpages.read(texts, _head, _tail)
                if len(own):
                    made |= {"page_id": lambda own=own, ids=ids: ids.take(pa.array(own)), "error": lambda own=own: pa.nulls(len(own), pa.string())}
                    yield pa.RecordBatch.from_arrays([made[f.name]().cast(f.type) for f in schema], schema=schema)
                others = [of_page(ids[k].as_py(), texts[k].as_py()) for k in np.flatnonzero(~plain).tolist()]
                for first in range(0, len(others), 64):
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*others[first : first + 64], strict=True)], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("hocr").cast("string").alias("hocr")).mapInArrow(rows, columns)


def read_errors(pages: DataFrame) -> DataFrame:
    """``ERRORS`` of pages (page_id, hocr) that can't be read or have no word."""
    return _each_page(pages, lambda page, _, words, error: ([page], [error]) if error else None, ERRORS)


#: Between the words of a page's text; HTML has no such character, so a word that holds it has U+FFFD instead.
BETWEEN = "\0"


_PAGE = re.compile(r"class=['\"]ocr_page['\"][^>]*?title=(?:'[^']*'|\"[^\"]*\")")
_PAGE_BOX = re.compile(_BBOX.pattern, re.ASCII)


def _dimensions(hocr: str | None) -> tuple[float | None, float | None]:
    """Width and height as ``page_dimensions`` gives them."""
    title = _PAGE.search(hocr or "")
    if not title or not (box := _PAGE_BOX.search(title[0])):
        return None, None
    x1, y1, x2, y2 = map(float, box.groups())
    return x2 - x1, y2 - y1


def read_texts(pages: DataFrame, all_lines: bool = False) -> DataFrame:
    """page_id, text, width, height, error: the words to search of each page, joined by ``BETWEEN`` (null where there are
    none), and the page's own size.

    Only words of plain lines are searched unless all are.  It is a page's shortest form: about as long as its bare text.
    """

    def made(page: int, hocr: str | None, words: Columns, error: str | None) -> tuple:
        own = words[3] if all_lines else [w for w, kind in zip(words[3], words[2], strict=True) if kind == "ocr_line"]
        width, height = _dimensions(hocr)
        return [page], [BETWEEN.join(w.replace(BETWEEN, "\ufffd") for w in own) if own else None], [width], [height], [error]

    return _each_page(pages, made, "page_id long, text string, width double, height double, error string")


def marker_texts(pages: DataFrame) -> DataFrame:
    """page_id, marked: what ``marker_text_of`` gives for the words of pages (page_id, hocr), worked out page by page."""

    def made(page: int, hocr: str | None, words: Columns, error: str | None) -> tuple | None:
        pars: dict[int, list[str]] = {}
        for (par, _), line in groupby(zip(*words, strict=True), key=lambda w: (w[0], w[1])):
            if own := [w for w in line if w[2] == "ocr_line"]:
                box = " ".join(str(int(side)) for side in own[0][9:] if side is not None)
                pars.setdefault(par, []).append(" ".join([f"[[LINE {box}]]", *(w[3] for w in own)]))
        return ([page], [" ".join("[[PARAGRAPH]] " + " ".join(lines) for lines in pars.values())]) if pars else None

    return _each_page(pages, made, "page_id long, marked string")


def parsed_words(pages: DataFrame, columns: str = WORDS) -> DataFrame:
    """``WORDS``, or those of their columns that are asked for, of pages (page_id, hocr); pages that can't be read have none."""
    return read_words(pages, f"{columns}, error string").where("error is null").drop("error")


def usable_words(words: DataFrame) -> DataFrame:
    """Words with a proper box, and clean_text in lower case."""
    return words.where("x1 >= 0 and y1 >= 0 and x2 > x1 and y2 > y1").withColumn("clean_text", F.lower("word"))


def page_dimensions(hocr: Column) -> Column:
    """struct(width, height) of the page's own box, null if it has none."""
    title = F.regexp_extract(hocr, r"class=['\"]ocr_page['\"][^>]*?title=(?:'([^']*)'|\"([^\"]*)\")", 0)
    box = box_of_title(title)
    return F.when(box["x1"].isNotNull(), F.struct((box["x2"] - box["x1"]).alias("width"), (box["y2"] - box["y1"]).alias("height")))


def spanning_marker(first: dict[str, Column], last: dict[str, Column], ws: Column) -> Column:
    """Marker text of a list of words: one line from the first word's corner to the last one's."""
    corners = [side.cast("long").cast("string") for side in (first["x1"], first["y1"], last["x2"], last["y2"])]
    marker = F.concat(F.lit("[[PARAGRAPH]] [[LINE "), F.concat_ws(" ", *corners), F.lit("]] "))
    return F.concat(marker, F.array_join(ws, " "), F.lit(" "))


def spanning_marker_text(words: DataFrame) -> DataFrame:
    """page_id, marked: ``spanning_marker`` of words that have to be gathered by their pages."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "word", "x1", "y1", "x2", "y2")))
    held = words.groupBy("page_id").agg(listed.alias("w"))
    first, last = F.get("w", F.lit(0)), F.element_at("w", -1)
    return held.select("page_id", spanning_marker(first, last, F.transform("w", lambda w: w["word"])).alias("marked"))


def write_marker_text(marked: DataFrame, path: str) -> None:
    """Marker text (page_id, marked) as text files, one folder a page."""
    marked.select("page_id", "marked").write.partitionBy("page_id").text(path)


def marker_text_of(words: DataFrame) -> DataFrame:
    """page_id, marked: marker text from parsed words of lines; paragraphs and lines each open with their marker."""
    lines = words.where(F.col("line_class") == "ocr_line")
    whole = lambda c: F.col(c).cast("long").cast("string")
    marker = F.concat(F.lit("[[LINE "), F.concat_ws(" ", *[whole(c) for c in ("lx1", "ly1", "lx2", "ly2")]), F.lit("]]"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    by_line = lines.groupBy("page_id", "par_no", "line_no").agg(F.first(marker, ignorenulls=True).alias("m"), text.alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "m", "t"))), lambda s: F.concat_ws(" ", s["m"], s["t"])), " ")
    by_par = by_line.groupBy("page_id", "par_no").agg(joined.alias("p"))
    pars = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par_no", "p"))), lambda s: F.concat(F.lit("[[PARAGRAPH]] "), s["p"])), " ")
    return by_par.groupBy("page_id").agg(pars.alias("marked"))


def _openings(layout: dict[tuple[int, int], str], pos: int, word: str) -> str:
    """The opening tag of a laid-out word, remembered by its place and length."""
    at = pos, min(len(word), LONGEST)
    if at not in layout:
        if len(layout) >= 1 << 18:
            layout.clear()
        layout[at] = "<span class='ocrx_word' title='bbox {} {} {} {}; x_wconf 95'>".format(*placed(*at))
    return layout[at]


def _body(ws: list[str | None], layout: dict[tuple[int, int], str]) -> str:
    parts: list[str] = []
    for k, word in enumerate(ws):
        if word is None:
            continue
        if k % LINE_WORDS == 0:
            last = min(k + LINE_WORDS, len(ws)) - 1
            x1, y1, _, _ = placed(k, len(word))
            _, _, x2, y2 = placed(last, len(ws[last] or ""))
            parts.append(f"{'</span>' if k else ''}<span class='ocr_line' title='bbox {x1} {y1} {x2} {y2}'>")
        parts += _openings(layout, k, word), escape(word, quote=False) if "&" in word or "<" in word or ">" in word else word, "</span> "
    return "".join(parts)


def rendered(pages: DataFrame, width: Column | int = 2560, height: Column | int = 3300) -> DataFrame:
    """page_id, hocr: laid-out pages (page_id, ws) as hOCR; a page whose width or height is null has no box of its own."""
    size = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("int").cast("string")
    own = F.coalesce(F.concat(F.lit(" title='bbox 0 0 "), size(width), F.lit(" "), size(height), F.lit("'")), F.lit(""))

    before, after = "<p class='ocr_par'>", "</p></div></body></html>"

    def of_words(ws: list[str | None] | None, title: str, layout: dict) -> str | None:
        return None if ws is None else f"<html><body><div class='ocr_page'{title}>{before}{_body(ws, layout)}{'</span>' if ws else ''}{after}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout: dict[tuple[int, int], str] = {}
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in plainpages.slices(sizes, BATCH_CHARS):
                part = batch.slice(a, b - a)
                told = part.filter(part.column(1).is_valid())
                if len(told):
                    bodies = plainpages.rendered_bodies(told.column(1), BETWEEN)
                    texts = pc.binary_join_element_wise("<html><body><div class='ocr_page'", told.column(3), f">{before}", bodies, after, "")
                    yield pa.RecordBatch.from_arrays([told.column(0), texts], names=["page_id", "hocr"])
                others = part.filter(part.column(1).is_null())
                if len(others):
                    texts = [of_words(ws, title, layout) for ws, title in zip(others.column(2).to_pylist(), others.column(3).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([others.column(0), pa.array(texts, pa.string())], names=["page_id", "hocr"])

    # Words travel as one text, which is far quicker to take apart than a list; null for the few that it can't tell apart.
    joined = F.array_join("ws", BETWEEN, BETWEEN)
    alike = F.coalesce(F.length(joined) - F.length(F.replace(joined, F.lit(BETWEEN), F.lit(""))) == F.size("ws") - 1, F.lit(False))
    sent = pages.select("page_id", F.when(alike, joined).alias("text"), F.when(~alike, F.col("ws")).alias("odd"), own.alias("own"))
    return sent.mapInArrow(rows, pages.select("page_id").schema.add("hocr", "string"))
