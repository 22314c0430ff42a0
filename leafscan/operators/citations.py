"""Citations of matched passages: templates, metadata, bibliographies, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.plans.shared import globally_ranked

#: Format -> name, pattern, fields in the order they are filled.
FORMATS = {
    "apa": ("APA Style", "{author} ({year}). {title}. {organization}. Retrieved {accessDate}, from {url}", ("author", "year", "title", "organization", "url", "accessDate")),
    "mla": ("MLA Style", '{author}. "{title}." {organization}, {date}, {url}. Accessed {accessDate}.', ("author", "title", "organization", "date", "url", "accessDate")),
    "chicago": ("Chicago Style", '{author}. "{title}." {organization}. {date}. {url} (accessed {accessDate}).', ("author", "title", "organization", "date", "url", "accessDate")),
    "harvard": ("Harvard Style", "{author} ({year}) {title}, {organization}, viewed {accessDate}, <{url}>.", ("author", "year", "title", "organization", "url", "accessDate")),
    "ieee": ("IEEE Style", '{author}, "{title}," {organization}, {date}. [Online]. Available: {url}. [Accessed: {accessDate}].', ("author", "title", "organization", "date", "url", "accessDate")),
}
#: What is tidied in a filled template, in this order.
CLEAN_UPS = ((r"\s+", " "), (r"\s*,\s*,", ","), (r"\s*\.\s*\.", "."), (r"^\s*,\s*", ""), (r"\s*,\s*$", ""))
#: Fixed value: the header of a CSV export.
CSV_HEADER = "Citation,Format,Match Text,Page Number,Document UID,Timestamp"
#: Order of citations in a bibliography.
COLLATION = "UNICODE"
#: What the example of every format is made of.
EXAMPLE = {"author": "Smith, J.", "title": "Sample Document Analysis", "organization": "Research Institute", "year": "2023", "date": "January 15, 2023", "url": "https://example.com/document.pdf", "accessDate": "March 20, 2024"}


def long_date(day: Column) -> Column:
    """A date as in ``January 5, 2024``."""
    return F.date_format(day, "MMMM d, yyyy")


def citation(fmt: str, data: dict[str, Column], as_of: Column) -> Column:
    """A filled template; fields that are null go with the white space around them.

    ``data``: any of author, title, organization, url, year, date, accessDate; the last three default to ``as_of``.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported citation format: {fmt}")
    _, pattern, fields = FORMATS[fmt]
    defaults = {"year": F.year(as_of).cast("string"), "date": long_date(as_of), "accessDate": long_date(as_of)}
    out = F.lit(pattern)
    for field in fields:
        value = F.coalesce(*[c for c in (data.get(field), defaults.get(field), F.lit(None).cast("string")) if c is not None])
        gone = F.regexp_replace(out, r"\s*\{" + field + r"\}\s*", "")
        out = F.when(value.isNull(), gone).otherwise(F.replace(out, F.lit("{" + field + "}"), value))
    for what, by in CLEAN_UPS:
        out = F.regexp_replace(out, what, by)
    return F.trim(out)


def formats(spark: SparkSession) -> DataFrame:
    """format, name, pattern, example of every citation format."""
    texts = {k: (name, pattern, pattern.format(**EXAMPLE)) for k, (name, pattern, _) in FORMATS.items()}
    rows = [F.struct(F.lit(k).alias("format"), *[F.lit(v).alias(n) for n, v in zip(("name", "pattern", "example"), values, strict=True)]) for k, values in texts.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    """The host of a URL, null where it is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def organization_of(url: Column) -> Column:
    """The capitalised label before a host's last; a host of one label by what it contains; else unknown."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    main = F.get(labels, F.size(labels) - 2)
    single = F.when(F.contains(host, F.lit("gov")), "Government Document").when(F.contains(host, F.lit("edu")), "Academic Institution")
    single = single.when(F.contains(host, F.lit("org")), "Organization").when(F.contains(host, F.lit("com")), "Commercial Source").otherwise(host)
    named = F.concat(F.upper(F.substr(main, F.lit(1), F.lit(1))), F.substr(main, F.lit(2)))
    return F.when(host.isNull(), "Unknown Source").when(F.size(labels) >= 2, named).otherwise(single)


def joined_pages(matches: DataFrame, pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Matches with their page; of pages with one key the last by ``order`` counts; ``found`` tells whether there is one."""
    rest = [c for c in pages.columns if c not in keys]
    last = pages.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("page"))
    return matches.join(last, keys, "left").select(*matches.columns, F.col("page").isNotNull().alias("found"), *[F.col(f"page.{c}").alias(c) for c in rest])


def in_order(text: Column, collation: str | None) -> list[Column]:
    """What to sort texts by: a collation's order, texts that it holds for equal in binary order; none: binary order."""
    return [F.collate(text, collation), text] if collation else [text]


def bibliography(cited: DataFrame, collation: str | None = COLLATION) -> DataFrame:
    """The lines of a bibliography in order: line_no, section, line.

    ``cited``: section, page, citation.  Sections come in the order of their first page, a title and its underline
    before each; lines by page, then citation.  Rows stay lines: no section is gathered in one place.
    Citations without a section form one of their own, whose title and underline are null.
    """
    first = cited.groupBy("section").agg(F.min("page").alias("first"))
    named = first.select(F.col("section").alias("title"), "first")
    lines = cited.join(named, F.col("section").eqNullSafe(F.col("title"))).select("first", "section", F.lit(2).alias("kind"), "page", F.col("citation").alias("line"))
    titles = first.select("first", "section", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page"), F.col("section").alias("line"))
    rules = first.select("first", "section", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("page"), F.repeat(F.lit("="), F.length("section")).alias("line"))
    order = [*[F.col(c) for c in ("first", "section", "kind", "page")], *in_order(F.col("line"), collation)]
    return globally_ranked(lines.unionByName(titles).unionByName(rules), *order, name="line_no").select("line_no", "section", "line")


def plain_bibliography(cited: DataFrame, collation: str | None = COLLATION) -> DataFrame:
    """The citations in order, without sections: line_no, line; blank lines go between when they are written."""
    return globally_ranked(cited.select(F.col("citation").alias("line")), *in_order(F.col("line"), collation), name="line_no").select("line_no", "line")


def write_lines(lines: DataFrame, path: str, number: str = "number", line: str = "line", parts: int | None = None) -> None:
    """Lines as text files whose order by name is that of their numbers: joined, they are the whole export.

    Numbers are dealt out by ranges and sorted within; header and brackets of ``whole_export`` are lines like others, so the
    first and the last file have them.  Spark's own commit makes a rerun replace the files as a whole.
    """
    ranged = lines.repartitionByRange(parts, number) if parts else lines.repartitionByRange(number)
    ranged.sortWithinPartitions(number).select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def checked(joined: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``joined_pages``, of which each must have found its page; else reading them fails and names the page."""
    missing = F.concat(F.lit("no page "), F.concat_ws(":", *keys))
    return joined.where(F.when(F.col("found"), F.lit(True)).otherwise(F.raise_error(missing).cast("boolean")))


def exported(cited: DataFrame, fmt: str, *order: Column) -> DataFrame:
    """Rows of an export in order: number (from 1), line.

    ``cited``: citation, format, match_text, page_number, doc_uid, timestamp.  ``whole_export`` adds what a file of
    them has besides.
    """
    numbered = globally_ranked(cited, *order, name="number")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text, number = lambda c: F.col(c).cast("string"), F.col("number").cast("string")
    title = F.concat(F.substr("match_text", F.lit(1), F.lit(50)), F.when(F.length("match_text") > 50, "...").otherwise(""))
    lines = {
        "json": F.to_json(F.struct("citation", "format", "match_text", "page_number", "doc_uid", "timestamp")),
        "csv": F.concat_ws(",", quoted(F.col("citation")), "format", quoted(F.col("match_text")), text("page_number"), text("doc_uid"), text("timestamp")),
        "txt": F.concat(number, F.lit(". "), "citation", F.lit('\n   Match: "'), "match_text", F.lit('" (Page '), text("page_number"), F.lit(", "), text("doc_uid"), F.lit(")")),
        "bibtex": F.concat(F.lit("@misc{ref"), number, F.lit(",\n  title={"), title, F.lit("},\n  note={"), "citation", F.lit("},\n  year={"), F.year("timestamp").cast("string"), F.lit("}\n}")),
    }
    if fmt not in lines:
        raise ValueError(f"unsupported export format: {fmt}")
    return numbered.select("number", lines[fmt].alias("line"))


def whole_export(cited: DataFrame, fmt: str, *order: Column) -> DataFrame:
    """The lines of an export file in order: number, line.

    CSV begins with its header (number 0); JSON is one array, its brackets at both ends; of a text each entry also tells
    when it was generated; entries of text and BibTeX are to be written with a blank line between.
    """
    lines = exported(cited, fmt, *order)
    if fmt == "csv":
        header = cited.sparkSession.range(1).select(F.lit(0).cast("long").alias("number"), F.lit(CSV_HEADER).alias("line"))
        return header.unionByName(lines.select(F.col("number").cast("long").alias("number"), "line"))
    if fmt == "json":
        n = lines.agg(F.count("*").alias("n"))
        ends = n.select(F.inline(F.array(F.struct(F.lit(0).cast("long").alias("number"), F.lit("[").alias("line")), F.struct((F.col("n") + 1).alias("number"), F.lit("]").alias("line")))))
        comma = lines.select(F.col("number").cast("long").alias("number"), "line").join(F.broadcast(n), F.lit(True))  # one row of a count
        return ends.unionByName(comma.select("number", F.when(F.col("number") < F.col("n"), F.concat("line", F.lit(","))).otherwise(F.col("line")).alias("line")))
    if fmt == "txt":
        stamped = cited.withColumn("doc_uid", F.concat(F.col("doc_uid").cast("string"), F.lit(")\n   Generated: "), F.date_format("timestamp", "M/d/yyyy, h:mm:ss a")))
        lines = exported(stamped, fmt, *order)
        return lines.select("number", F.regexp_replace("line", r"\)$", "").alias("line"))
    return lines
