"""The facade: search passages on pages and annotate what is found."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.operators import boxes, citations, fuzzy, geometry, highlight, match, richtext
from leafscan.plans.shared import checkpointed, settled
from leafscan.sources import hocr


@dataclass(frozen=True)
class Options:
    """How to search and what to return; ``max_results`` limits matches of a page (none: all).

    ``page_width`` and ``page_height`` are the recognised pages' size, before any that a page or table tells; the target
    size holds for pages that no table of targets has.
    """

    tolerance: float = match.TOLERANCE
    fuzzy: bool = False
    all_lines: bool = False
    max_results: int | None = None
    early_stop: bool = True
    page_width: float | None = None
    page_height: float | None = None
    target_width: float = geometry.TARGET_WIDTH
    target_height: float = geometry.TARGET_HEIGHT


def _searchable(words: DataFrame, options: Options) -> DataFrame:
    """Words to search, with their position among them."""
    own = words if options.all_lines else words.where("line_class is null or line_class = 'ocr_line'")
    places = F.array_sort(F.collect_list(F.struct("pos", "word", "x1", "y1", "x2", "y2")))
    return own.groupBy("page_id").agg(places.alias("w"))


def _placed(held: DataFrame) -> DataFrame:
    """Searchable words, a row each."""
    return held.select("page_id", F.posexplode("w").alias("pos", "p")).select("page_id", "pos", "p.word", "p.x1", "p.y1", "p.x2", "p.y2")


def _scaled(boxed: DataFrame, options: Options, sizes: DataFrame | None, targets: DataFrame | None) -> DataFrame:
    """Boxes with their place on the target page: x, y, width, height.

    A page's size is the option, its own, or its target's; without a table of sizes, and without an option, the fixed
    standard size.
    """
    standard = geometry.sizes_of(boxed, geometry.PAGE_WIDTH, geometry.PAGE_HEIGHT)
    known = geometry.sizes_of(boxed, options.target_width, options.target_height) if targets is None else targets
    sized = geometry.sized_pages(standard if sizes is None else sizes, known, options.page_width, options.page_height, options.target_width, options.target_height)
    both = boxed.join(sized.select("page_id", F.col("width").alias("from_width"), F.col("height").alias("from_height")), "page_id")
    both = both.join(known.select("page_id", F.struct("width", "height").alias("to")), "page_id", "left")
    whole = F.col("to.width").isNotNull() & F.col("to.height").isNotNull()
    to = [F.when(whole, F.col(f"to.{c}")).otherwise(F.lit(v)).cast("double") for c, v in (("width", options.target_width), ("height", options.target_height))]
    placed = geometry.pdf_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], width=F.col("from_width"), height=F.col("from_height"), to_width=to[0], to_height=to[1])
    return both.select(*boxed.columns, *[c.alias(n) for n, c in placed.items()])


def _matches(pages: DataFrame, queries: DataFrame, options: Options) -> DataFrame:
    """Matches of the queries' texts on pages (page_id, ws), as the options ask for them."""
    wanted = queries.select("query_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("qs"))
    if options.fuzzy:
        found = fuzzy.fuzzy_matches(pages, wanted, options.tolerance).drop("fuzzy")
    else:
        found = match.closest_matches(pages, wanted, options.tolerance, options.early_stop)
    if options.max_results is not None:
        found = match.top_matches(found, options.max_results).drop("rank")
    return settled(found)


def _drawn(found: DataFrame, pages: DataFrame, placed: DataFrame, queries: DataFrame, options: Options, sizes: DataFrame | None, targets: DataFrame | None) -> DataFrame:
    boxed = checkpointed(boxes.usable_boxes(boxes.match_boxes(match.with_text(found, pages), placed)))  # read several times below
    joined = _scaled(boxed, options, sizes, targets).join(queries.drop("text"), "query_id")
    return geometry.draw_ops(geometry.styled(joined))


def annotate(words: DataFrame, queries: DataFrame, options: Options = Options(), sizes: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Annotations of all pages: match, box on the page, box on the target page, style.

    ``words``: page_id, pos, line_class, word, box (``hocr.parsed_words``); ``queries``: query_id, text,
    annotation_type, color, background_color; ``sizes`` and ``targets``: page_id, width, height of recognised and of target
    pages.  Words have to be gathered by their pages here; where these are at hand, ``annotate_pages`` costs less.
    """
    held = _searchable(words, options)
    pages = held.select("page_id", F.transform("w", lambda w: w["word"]).alias("ws"))
    found = _matches(pages, queries, options)
    return _drawn(found, pages, _placed(match.on_matched_pages(held, found)), queries, options, sizes, targets)


def _read(pages: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words to search of recognised pages (page_id, ws), their sizes, and the pages that failed (page_id, error).

    All pages are parsed once, into a checkpoint of their bare texts; their boxes are read again where something is found.
    """
    read = checkpointed(hocr.read_texts(pages, options.all_lines))
    searched = read.where("text is not null").select("page_id", F.split("text", hocr.BETWEEN).alias("ws"))
    return searched, read.select("page_id", "width", "height"), read.where("error is not null").select("page_id", "error")


def _boxes_of(pages: DataFrame, options: Options) -> DataFrame:
    """Searchable words with their boxes, a row each, of recognised pages."""
    return _placed(_searchable(hocr.parsed_words(pages), options))


def annotate_pages(pages: DataFrame, queries: DataFrame, options: Options = Options(), targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Annotations of recognised pages (page_id, hocr), and the pages that failed: page_id, error.

    A page that can't be read or has no word is left out and named.  Boxes are scaled from the size that a page tells of
    itself.
    """
    searched, sizes, failed = _read(pages, options)
    found = _matches(searched, queries, options)
    placed = _boxes_of(match.on_matched_pages(pages, found), options)
    return _drawn(found, searched, placed, queries, options, match.on_matched_pages(sizes, found), targets), failed


def annotate_page(page_id: int, markup: str, queries: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Annotations of a single recognised page; a page that fails is an error here."""
    one = queries.sparkSession.createDataFrame([(page_id, markup)], "page_id long, hocr string")
    found, failed = annotate_pages(one, queries, options)
    if row := failed.first():
        raise ValueError(f"page {page_id}: {row['error']}")
    return found


def annotate_rich_text(pages: DataFrame, texts: DataFrame, options: Options = Options(), text: str = "text", key: str = "query_set") -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """``annotate_pages`` for the queries of rich texts (HTML, RTF or plain); equal queries count once, the first stays."""
    same = ["text", "annotation_type", "color", "background_color"]
    first = F.min(F.struct(key, "run_no", "query_id")).alias("first")
    asked = rich_text_queries(texts, text, key).groupBy(*same).agg(first).select("first.query_id", *same)
    return annotate_pages(pages, asked, options)


def annotate_with_citations(
    pages: DataFrame, queries: DataFrame, sources: DataFrame, fmt: str, as_of: Column, options: Options = Options()  # noqa: B008
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotations of recognised pages, their citations, and the bibliography of these.

    ``sources``: page_id, and any of title, author, organization, url of the page's document.  A match on a page that has no
    source is an error when its citation is read.
    """
    found, _ = annotate_pages(pages, queries, options)
    found = checkpointed(found)
    joined = citations.joined_pages(found.select("page_id", "query_id", "text"), sources.withColumn("order", F.lit(0)), ["page_id"], "order")
    known = {c: F.col(c) for c in ("title", "author", "organization", "url") if c in sources.columns}
    cited = citations.checked(joined, "page_id").select("page_id", "query_id", citations.citation(fmt, known, as_of).alias("citation"), F.col("text").alias("match_text"))
    return found, cited, citations.plain_bibliography(cited)


def rich_text_queries(texts: DataFrame, text: str = "text", key: str = "query_set") -> DataFrame:
    """Search queries from rich texts of any kind (HTML, RTF, plain): query_id, text, annotation_type, colours."""
    kind = richtext.detected_format(F.col(text))
    by_kind = [
        texts.where(kind == "html").select(key, richtext.parsed_html(F.col(text)).alias("segments")),
        texts.where(kind == "rtf").select(key, richtext.parsed_rtf(F.col(text)).alias("segments")),
        texts.where(kind == "plain").select(key, richtext.plain_segment(F.col(text)).alias("segments")),
    ]
    found = richtext.search_queries(by_kind[0].unionByName(by_kind[1]).unionByName(by_kind[2]), key)
    return found.withColumn("query_id", F.xxhash64(key, "run_no"))


def _closest(pages: DataFrame, queries: DataFrame, options: Options) -> DataFrame:
    return _matches(pages, queries, replace(options, fuzzy=False, max_results=None))


def _sections(matched: DataFrame, placed: DataFrame, queries: DataFrame) -> DataFrame:
    found = boxes.match_boxes(matched, placed)
    sections = queries.select("query_id", F.inline(highlight.parsed_sections(F.col("html"))))
    return highlight.highlighted(boxes.words_in_area(found, placed), sections)


def annotate_with_highlights(words: DataFrame, queries: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Sections of formatted queries (query_id, text, html) found around their matches."""
    held = _searchable(words, options)
    pages = held.select("page_id", F.transform("w", lambda w: w["word"]).alias("ws"))
    matched = _closest(pages, queries, options)
    return _sections(matched, _placed(match.on_matched_pages(held, matched)), queries)


def highlight_pages(pages: DataFrame, queries: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """``annotate_with_highlights`` for recognised pages (page_id, hocr)."""
    searched, _, _ = _read(pages, options)
    matched = _closest(searched, queries, options)
    return _sections(matched, _boxes_of(match.on_matched_pages(pages, matched), options), queries)
