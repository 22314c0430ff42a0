"""Queries over records: citations, cache, jobs, rich text, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.functions.colors import NAMED, channels
from leafscan.functions.tokens import cache_hash, hocr_key, match_key, pdf_key
from leafscan.operators import cache, citations, geometry, jobs, richtext
from leafscan.plans.shared import globally_ranked
from leafscan.sources.tables import table

#: The day that citations are dated.
AS_OF = "2024-01-15"


def _cited(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    data = {
        "title": F.regexp_extract("html", "<title>([^<]*)</title>", 1),
        "author": F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("Author "), (F.col("page_id") % 10).cast("string"))),
        "organization": F.when(F.col("page_id") % 5 != 0, citations.organization_of(F.col("url"))),
        "url": F.col("url"),
    }
    made = citations.citation(fmt, data, F.lit(AS_OF).cast("date"))
    return pages.select("page_id", "url", made.alias("citation"), data["title"].alias("match_text"))


def _citation_query(fmt: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cited(spark, sf_dir, fmt).select("page_id", "citation")

    return query


def citation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_uid"), F.col("turn").alias("page_number"))
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 4).alias("doc_uid"), (F.col("page_id") % 2).alias("page_number"), "url", "page_id")
    return citations.joined_pages(turns, pages, ["doc_uid", "page_number"], "page_id")


def citation_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", citations.host_of(F.col("url")).alias("host"), citations.organization_of(F.col("url")).alias("organization"))


def bibliography_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _cited(spark, sf_dir, "mla").select(citations.host_of(F.col("url")).alias("section"), F.col("page_id").alias("page"), "citation")
    return citations.bibliography(cited, collation=None)


def bibliography_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.plain_bibliography(_cited(spark, sf_dir, "ieee"), collation=None)


def _whole_export(fmt: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cited = _cited(spark, sf_dir, "apa").select(
            "citation", F.lit("APA Style").alias("format"), "match_text", F.lit(1).alias("page_number"), F.col("page_id").alias("doc_uid"), F.lit(AS_OF).cast("date").alias("timestamp")
        )
        return citations.whole_export(cited, fmt, F.col("citation"), F.col("doc_uid").cast("string"))

    return query


def _export(fmt: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cited = _cited(spark, sf_dir, "apa").select(
            "citation", F.lit("APA Style").alias("format"), "match_text", F.lit(1).alias("page_number"), F.col("page_id").alias("doc_uid"), F.lit(AS_OF).cast("date").alias("timestamp")
        )
        return citations.exported(cited, fmt, F.col("citation"), F.col("doc_uid"))

    return query


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("store"), F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("props").alias("data"), F.length("props").cast("long").alias("size"))


def cache_lookup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lookups(_accesses(spark, sf_dir)).select("id", "store", "key", "hit")


def cache_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hit_rates(cache.lookups(_accesses(spark, sf_dir))).select("store", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = cache.entries(_accesses(spark, sf_dir))
    return current.select("store", "key", "data", "size", F.unix_micros(F.col("expires_at").cast("timestamp")).alias("expires_us"))


def cache_store_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.store_info(cache.entries(_accesses(spark, sf_dir)))


def cache_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gone = cache.cleaned(cache.entries(_accesses(spark, sf_dir)), F.lit("2024-01-28 00:00:00").cast("timestamp"))
    return gone


def cache_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = cache.entries(_accesses(spark, sf_dir))
    gone = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.lit("click").alias("store"), F.col("c_custkey").alias("key"))
    left = cache.without_stores(cache.without_keys(current, gone), "purchase")
    return left.select("store", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("set_us"))


def cache_gets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _accesses(spark, sf_dir)
    gets, sets = events.where("id % 3 = 0").select("store", "key", "ts", "id"), events.where("id % 3 <> 0")
    return cache.found_at(gets, sets, "6 hours").select("id", "hit", F.unix_micros(F.col("set_at").cast("timestamp")).alias("set_us"))


def match_and_pdf_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid, page = F.col("page_id") % 7, F.col("page_id") % 5
    return table(spark, sf_dir, "pages").select(
        "page_id", hocr_key(uid, page, F.col("url")).alias("hocr_key"), match_key(uid, page, F.col("url"), F.lit("0.8")).alias("match_key"), pdf_key(uid, F.col("url")).alias("pdf_key")
    )


def page_size_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    own = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.length("url") * 10.0).alias("width"), F.when(F.col("page_id") % 2 == 0, F.length("url") * 13.0).alias("height"))
    targets = pages.where("page_id % 5 < 3").select("page_id", (F.col("page_id") % 7 + 595.0).alias("width"), F.when(F.col("page_id") % 4 != 0, F.lit(842.0)).alias("height"))
    return geometry.sized_pages(own, targets)


def custom_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    border = F.when(key % 3 == 0, F.lit("no colour")).otherwise(F.concat(F.lit("#"), F.substr(F.md5("p_name"), F.lit(1), F.lit(6))))
    style = geometry.custom_style(border, F.when(key % 2 == 0, F.lit("yellow")), F.lit(0.4), F.col("p_size").cast("double"))
    made = table(spark, sf_dir, "part").select("p_partkey", style.alias("s"))
    return made.select("p_partkey", *[F.round(f"s.{part}.{c}", 6).alias(f"{part}_{c}") for part in ("border", "fill") for c in "rgb"], F.col("s.opacity").alias("opacity"), F.col("s.border_width").alias("border_width"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("hocr:"), cache_hash(F.col("url"))).alias("cache_key"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    level = F.substr("o_orderpriority", F.lit(1), F.lit(1))
    priority = F.when(level == "1", "urgent").when(level == "2", "high").when(level == "3", "medium").otherwise("low")
    return orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("owner"),
        priority.alias("priority"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 7 + 1).alias("pages"),
        (F.col("o_orderkey") % 90 + 1).alias("queries"),
        F.floor(F.col("o_totalprice")).alias("total_ms"),
        F.col("o_orderstatus").alias("status"),
    )


def job_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_order(_jobs(spark, sf_dir)).select("job_id", "priority", "place")


def job_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _jobs(spark, sf_dir).withColumn("page_ms", F.col("total_ms") / F.col("pages"))
    return jobs.estimates(timed, "owner").select("job_id", "owner", F.round("estimate_ms", 3).alias("estimate_ms"))


def job_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("page_no"), (F.col("l_orderkey") % 200 + 1).alias("queries"))
    return jobs.batches(lines.distinct(), batch_size=3).select("job_id", "page_no", "batch_no")


def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.stats(_jobs(spark, sf_dir), "priority")
    return found.select("priority", "jobs", "pages", F.round("mean_ms", 4).alias("mean_ms"), F.round("per_second", 8).alias("per_second"), "memory_mb")


def job_queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = _jobs(spark, sf_dir).withColumn("estimate", F.col("pages") * F.col("queries") * 500)
    return waiting.groupBy("status", "priority").agg(F.count("*").alias("jobs"), F.sum("estimate").alias("estimate_ms"))


def job_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = _jobs(spark, sf_dir).select(
        "owner", "job_id", "created_at", (F.col("job_id") % 10 / 10).alias("efficiency"), (F.col("pages") * jobs.PAGE_MB).cast("double").alias("memory_mb"), (F.col("pages") * 50000 / F.col("total_ms")).alias("per_second")
    )
    found = jobs.recommendations(measured, "owner", memory_limit_mb=50.0)
    return found.select("owner", F.array_join("recommendations", "; ").alias("recommendations"))


def worker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("worker_id"), F.col("l_quantity").alias("ms"), (F.col("l_returnflag") == "R").alias("failed"))
    return jobs.worker_stats(tasks).select("worker_id", "tasks", "failed", F.round("mean_ms", 6).alias("mean_ms"))


def _color() -> Column:
    digest = F.md5("url")
    names = F.array(*[F.lit(n) for n in NAMED])
    kinds = [F.concat(F.lit("#"), F.substr(digest, F.lit(1), F.lit(6))), F.concat(F.lit("#"), F.substr(digest, F.lit(1), F.lit(3))), F.element_at(names, (F.col("page_id") % len(NAMED) + 1).cast("int")), F.col("url")]
    return F.element_at(F.array(*kinds), (F.floor(F.col("page_id") / 3) % 4 + 1).cast("int"))


def parse_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", _color().alias("color")).withColumn("c", channels(F.col("color")))
    return found.select("page_id", "color", *[F.round(f"c.{k}", 6).alias(k) for k in "rgb"])


def annotation_type_from_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    strike, under, back = F.contains("html", F.lit("<s>")), F.contains("html", F.lit("<b>")), F.when(F.col("page_id") % 3 == 0, F.lit("yellow"))
    kind = richtext.annotation_type(strike, under & (F.col("page_id") % 2 == 0), back)
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("annotation_type"), richtext.detected_format(F.col("html")).alias("format"))


def merge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("long", F.length("text") > 200)
    merged = richtext.merged_runs(turns, "conv_id", "turn", ["long"])
    return merged.select("conv_id", F.col("run_no").cast("int").alias("run_no"), "long", "first", "n", F.md5("text").alias("text_md5"))


def dedup_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return richtext.first_of_equal(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang"), ["text_md5", "lang"], "doc_id")


def html_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    made = richtext.html_query(F.regexp_extract("url", "://([^/]*)", 1), page % 2 == 0, page % 3 == 0, F.when(page % 5 == 0, F.lit("red")), F.when(page % 7 == 0, F.lit("yellow")), F.when(page % 4 == 0, page % 9 + 8))
    return table(spark, sf_dir, "pages").select("page_id", made.alias("query"))


def rtf_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/]*)", 1)
    words = F.concat(F.lit("{\\rtf1\\ansi "), F.when(F.col("page_id") % 2 == 0, F.lit("\\b ")).otherwise(F.lit("")), F.when(F.col("page_id") % 3 == 0, F.lit("\\strike ")).otherwise(F.lit("")), F.lit("\\fs24 "), host, F.lit("\\par }"))
    parsed = table(spark, sf_dir, "pages").select("page_id", richtext.parsed_rtf(words).alias("segments")).select("page_id", F.inline("segments"))
    return parsed.select("page_id", "text", "bold", "strikethrough", "underline", "font_size")


def rtf_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatting of RTF texts of varying size, with flags in any mixture, some without a size."""
    host = F.regexp_extract("url", "://([^/]*)", 1)
    flag = lambda word, k: F.when(F.col("page_id") % k == 1, F.lit(f"\\{word} ")).otherwise(F.lit(""))
    size = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("\\fs"), (F.col("page_id") % 23 + 10).cast("string"), F.lit(" "))).otherwise(F.lit(""))
    text = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}} "), flag("b", 2), flag("i", 3), flag("ul", 5), flag("strike", 4), size, host, F.lit(" {at} "), F.col("page_id").cast("string"), F.lit("\\par }"))
    parsed = table(spark, sf_dir, "pages").select("page_id", F.inline(richtext.parsed_rtf(text)))
    return parsed.select("page_id", "text", "bold", "italic", "underline", "strikethrough", "font_size")


def html_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html_queries(spark, sf_dir).select("page_id", richtext.parsed_html(F.concat(F.lit("see "), "query", F.lit(" now"))).alias("segments"))
    return made.select("page_id", F.inline("segments")).select("page_id", "ord", "text", "bold", "italic", "color", "background_color", "font_size")


_RECORD_QUERIES = (
    citation_join, citation_metadata, bibliography_by_document, cache_lookup_ttl, cache_hit_rates, cache_entries, cache_store_info, cache_cleanup, cache_keys,
    job_queue_order, job_estimates, job_batches, job_stats, job_queue_status, job_recommendations, worker_stats, parse_colors,
    annotation_type_from_formatting, merge_segments, dedup_queries, html_queries, rtf_queries, rtf_segments, html_segments,
    bibliography_plain, cache_delete, cache_gets, match_and_pdf_keys, page_size_fallback, custom_styles,
)
QUERIES = {q.__name__: q for q in _RECORD_QUERIES}
QUERIES |= {f"citations_{fmt}": _citation_query(fmt) for fmt in citations.FORMATS}
QUERIES |= {f"export_{fmt}": _export(fmt) for fmt in ("csv", "txt", "json", "bibtex")}
QUERIES |= {f"whole_export_{fmt}": _whole_export(fmt) for fmt in ("csv", "txt", "json")}

_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
_ORG = f"""CASE WHEN {_HOST} IS NULL THEN 'Unknown Source' WHEN len(string_split({_HOST}, '.')) >= 2
    THEN upper(substr(string_split({_HOST}, '.')[-2], 1, 1)) || substr(string_split({_HOST}, '.')[-2], 2)
    WHEN contains({_HOST}, 'gov') THEN 'Government Document' WHEN contains({_HOST}, 'edu') THEN 'Academic Institution'
    WHEN contains({_HOST}, 'org') THEN 'Organization' WHEN contains({_HOST}, 'com') THEN 'Commercial Source' ELSE {_HOST} END"""


def _cited_sql(fmt: str) -> str:
    values = {
        "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
        "author": "CASE WHEN page_id % 4 <> 0 THEN 'Author ' || (page_id % 10) END",
        "organization": f"CASE WHEN page_id % 5 <> 0 THEN {_ORG} END",
        "url": "url",
        "year": "'2024'",
        "date": "'January 15, 2024'",
        "accessDate": "'January 15, 2024'",
    }
    _, pattern, fields = citations.FORMATS[fmt]
    out = "'" + pattern + "'"
    for f in fields:
        gone = "regexp_replace({}, '\\s*\\{{" + f + "\\}}\\s*', '', 'g')"
        out = f"(CASE WHEN v_{f} IS NULL THEN {gone.format(out)} ELSE replace({out}, '{{{f}}}', v_{f}) END)" if f in ("author", "organization") else f"replace({out}, '{{{f}}}', v_{f})"
    for what, by in citations.CLEAN_UPS:
        out = f"regexp_replace({out}, '{what}', '{by}', 'g')"
    columns = ", ".join(f"{sql} AS v_{name}" for name, sql in values.items())
    return f"cited AS (SELECT page_id, url, v_title AS match_text, trim({out}) AS citation FROM (SELECT page_id, url, {columns} FROM pages))"


_ACCESSES = "acc AS (SELECT event_type AS store, user_id AS key, ts, event_id AS id, props AS data, CAST(length(props) AS BIGINT) AS size FROM events)"
_LOOKED = f"WITH {_ACCESSES}, looked AS (SELECT *, coalesce(ts <= lag(ts) OVER (PARTITION BY store, key ORDER BY ts, id) + INTERVAL 24 HOURS, false) AS hit FROM acc)"
_CURRENT = f"WITH {_ACCESSES}, current AS (SELECT *, ts + INTERVAL 24 HOURS AS expires_at FROM acc QUALIFY row_number() OVER (PARTITION BY store, key ORDER BY ts DESC, data DESC, size DESC) = 1)"
_JOBS = """WITH jobs AS (SELECT o_orderkey AS job_id, o_custkey AS owner,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS prio,
    o_orderdate AS created_at, o_orderkey % 7 + 1 AS pages, o_orderkey % 90 + 1 AS queries, CAST(floor(o_totalprice) AS BIGINT) AS total_ms, o_orderstatus AS status FROM orders)"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMED) + "]"
_RGB = ", ".join(f"('{n}', {r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE)" for n, (r, g, b) in NAMED.items())


def _hash_sql(text: str) -> str:
    """The cache's hash of an ASCII text, in base 36."""
    units = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(unicode(substr({text}, CAST(k AS INTEGER), 1)) AS BIGINT))"
    number = f"abs(list_reduce({units}, lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT))"
    digits = f"list_transform([6, 5, 4, 3, 2, 1, 0], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(({number} // CAST(36 ** p AS BIGINT)) % 36 + 1 AS INTEGER), 1))"
    return f"coalesce(nullif(ltrim(array_to_string({digits}, ''), '0'), ''), '0')"


_EXPORTED = "WITH {cited}, numbered AS (SELECT *, row_number() OVER (ORDER BY citation, CAST(page_id AS VARCHAR)) AS number, count(*) OVER () AS n FROM cited)"


def _export_sql(line: str) -> str:
    return f"""WITH {_cited_sql("apa")}, numbered AS (SELECT *, row_number() OVER (ORDER BY citation, page_id) AS number FROM cited)
        SELECT number, {line} AS line FROM numbered"""


ORACLE_SQL = {f"citations_{fmt}": f"WITH {_cited_sql(fmt)} SELECT page_id, citation FROM cited" for fmt in citations.FORMATS}
ORACLE_SQL |= {
    "citation_join": """WITH pg AS (SELECT page_id // 4 AS doc_uid, page_id % 2 AS page_number, url, page_id FROM pages
            QUALIFY row_number() OVER (PARTITION BY page_id // 4, page_id % 2 ORDER BY page_id DESC) = 1)
        SELECT c.conv_id AS doc_uid, c.turn AS page_number, p.page_id IS NOT NULL AS found, p.url, p.page_id
        FROM conversations c LEFT JOIN pg p ON p.doc_uid = c.conv_id AND p.page_number = c.turn""",
    "citation_metadata": f"SELECT page_id, {_HOST} AS host, {_ORG} AS organization FROM pages",
    "bibliography_by_document": f"""WITH {_cited_sql("mla")}, c AS (SELECT {_HOST} AS section, page_id AS page, citation FROM cited),
        f AS (SELECT section, min(page) AS first FROM c GROUP BY section),
        l AS (SELECT first, c.section, 2 AS kind, page, citation AS line FROM c JOIN f ON f.section IS NOT DISTINCT FROM c.section
              UNION ALL SELECT first, section, 0, NULL, section FROM f UNION ALL SELECT first, section, 1, NULL, repeat('=', length(section)) FROM f)
        SELECT row_number() OVER (ORDER BY first, section, kind, page NULLS FIRST, line) AS line_no, section, line FROM l""",
    "export_csv": _export_sql("""'"' || replace(citation, '"', '""') || '",APA Style,"' || replace(match_text, '"', '""') || '",1,' || page_id || ',2024-01-15'"""),
    "export_txt": _export_sql("""number || '. ' || citation || chr(10) || '   Match: "' || match_text || '" (Page 1, ' || page_id || ')'"""),
    "export_json": _export_sql("CAST(json_object('citation', citation, 'format', 'APA Style', 'match_text', match_text, 'page_number', 1, 'doc_uid', page_id, 'timestamp', '2024-01-15') AS VARCHAR)"),
    "export_bibtex": _export_sql("""'@misc{ref' || number || ',' || chr(10) || '  title={' || substr(match_text, 1, 50) || CASE WHEN length(match_text) > 50 THEN '...' ELSE '' END || '},' || chr(10)
        || '  note={' || citation || '},' || chr(10) || '  year={2024}' || chr(10) || '}'"""),
    "whole_export_csv": f"""{_EXPORTED.format(cited=_cited_sql("apa"))} SELECT 0::BIGINT AS number, 'Citation,Format,Match Text,Page Number,Document UID,Timestamp' AS line
        UNION ALL SELECT number, '"' || replace(citation, '"', '""') || '",APA Style,"' || replace(match_text, '"', '""') || '",1,' || page_id || ',2024-01-15' FROM numbered""",
    "whole_export_txt": f"""{_EXPORTED.format(cited=_cited_sql("apa"))} SELECT number, number || '. ' || citation || chr(10) || '   Match: "' || match_text || '" (Page 1, ' || page_id || ')' || chr(10)
        || '   Generated: 1/15/2024, 12:00:00 AM' AS line FROM numbered""",
    "whole_export_json": f"""{_EXPORTED.format(cited=_cited_sql("apa"))} SELECT 0::BIGINT AS number, '[' AS line UNION ALL SELECT count(*) + 1, ']' FROM cited
        UNION ALL SELECT number, CAST(json_object('citation', citation, 'format', 'APA Style', 'match_text', match_text, 'page_number', 1, 'doc_uid', page_id, 'timestamp', '2024-01-15') AS VARCHAR)
            || CASE WHEN number < n THEN ',' ELSE '' END FROM numbered""",
    "bibliography_plain": f"WITH {_cited_sql('ieee')} SELECT row_number() OVER (ORDER BY citation) AS line_no, citation AS line FROM cited",
    "cache_delete": f"""{_CURRENT} SELECT store, key, epoch_us(ts) AS set_us FROM current
        WHERE store <> 'purchase' AND NOT (store = 'click' AND key IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0))""",
    "cache_gets": f"""WITH {_ACCESSES}, found AS (SELECT g.id, g.ts, max(s.ts) AS set_at FROM acc g LEFT JOIN acc s ON s.id % 3 <> 0 AND s.store = g.store AND s.key = g.key AND s.ts <= g.ts
            WHERE g.id % 3 = 0 GROUP BY g.id, g.ts)
        SELECT id, coalesce(ts <= set_at + INTERVAL 6 HOURS, false) AS hit, epoch_us(set_at) AS set_us FROM found""",
    "match_and_pdf_keys": f"""WITH h AS (SELECT page_id, {_hash_sql('url')} AS h FROM pages)
        SELECT page_id, 'hocr:' || page_id % 7 || ':' || page_id % 5 || ':' || h AS hocr_key, 'match:' || page_id % 7 || ':' || page_id % 5 || ':' || h || ':0.8' AS match_key, 'pdf:' || page_id % 7 || ':' || h AS pdf_key FROM h""",
    "page_size_fallback": """SELECT page_id,
        CASE WHEN page_id % 6 = 0 THEN CAST(length(url) * 10 AS DOUBLE) WHEN page_id % 5 < 3 AND page_id % 4 <> 0 THEN CAST(page_id % 7 + 595 AS DOUBLE) ELSE 612.0::DOUBLE END AS width,
        CASE WHEN page_id % 6 = 0 THEN CAST(length(url) * 13 AS DOUBLE) WHEN page_id % 5 < 3 AND page_id % 4 <> 0 THEN 842.0::DOUBLE ELSE 792.0::DOUBLE END AS height FROM pages""",
    "custom_styles": """WITH c AS (SELECT *, CASE WHEN p_partkey % 3 <> 0 THEN md5(p_name) END AS h FROM part),
        b AS (SELECT *, CAST(('0x' || substr(h, 1, 2)) AS INTEGER) / 255 AS r, CAST(('0x' || substr(h, 3, 2)) AS INTEGER) / 255 AS g, CAST(('0x' || substr(h, 5, 2)) AS INTEGER) / 255 AS b FROM c)
        SELECT p_partkey, round(r, 6) AS border_r, round(g, 6) AS border_g, round(b, 6) AS border_b,
               CASE WHEN h IS NULL THEN NULL WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE round(r, 6) END AS fill_r, CASE WHEN h IS NULL THEN NULL WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE round(g, 6) END AS fill_g,
               CASE WHEN h IS NULL THEN NULL WHEN p_partkey % 2 = 0 THEN 0.0::DOUBLE ELSE round(b, 6) END AS fill_b,
               CASE WHEN h IS NOT NULL THEN 0.4::DOUBLE END AS opacity, CASE WHEN h IS NOT NULL THEN CAST(p_size AS DOUBLE) END AS border_width FROM b""",
    "cache_lookup_ttl": f"{_LOOKED} SELECT id, store, key, hit FROM looked",
    "cache_hit_rates": f"""{_LOOKED} SELECT store, CAST(count(*) FILTER (hit) AS BIGINT) AS hits, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS misses,
        round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM looked GROUP BY store""",
    "cache_entries": f"{_CURRENT} SELECT store, key, data, size, epoch_us(expires_at) AS expires_us FROM current",
    "cache_store_info": f"{_CURRENT} SELECT store, count(*) AS entries, CAST(sum(size) AS BIGINT) AS size FROM current GROUP BY ROLLUP (store)",
    "cache_cleanup": f"{_CURRENT} SELECT store, count(*) AS expired, CAST(sum(size) AS BIGINT) AS freed FROM current WHERE TIMESTAMP '2024-01-28 00:00:00' > expires_at GROUP BY store",
    "cache_keys": """WITH h AS (SELECT page_id, abs(list_reduce(list_transform(range(1, length(url) + 1), lambda k: CAST(unicode(substr(url, CAST(k AS INTEGER), 1)) AS BIGINT)),
            lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT)) AS h FROM pages)
        SELECT page_id, 'hocr:' || coalesce(nullif(ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(36 ** p AS BIGINT)) % 36 + 1 AS INTEGER), 1)), ''), '0'), ''), '0') AS cache_key FROM h""",
    "job_queue_order": f"{_JOBS} SELECT job_id, priority, row_number() OVER (ORDER BY prio, created_at, job_id) AS place FROM jobs",
    "job_estimates": f"""{_JOBS} SELECT job_id, owner, round(pages * queries * coalesce(avg(total_ms / pages) OVER (PARTITION BY owner ORDER BY created_at, job_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 500.0::DOUBLE), 3) AS estimate_ms FROM jobs""",
    "job_batches": """WITH l AS (SELECT DISTINCT l_orderkey AS job_id, l_linenumber * 100000 + l_partkey AS page_no, l_orderkey % 200 + 1 AS queries FROM lineitem)
        SELECT job_id, page_no, CAST((row_number() OVER (PARTITION BY job_id ORDER BY page_no) - 1) // least(3, greatest(1, 256 // queries)) AS BIGINT) AS batch_no FROM l""",
    "job_stats": f"""{_JOBS} SELECT priority, count(*) AS jobs, CAST(sum(pages) AS BIGINT) AS pages, round(sum(total_ms) / sum(pages), 4) AS mean_ms,
        round(sum(pages) / (sum(total_ms) / 1000), 8) AS per_second, CAST(sum(pages) * 10 AS BIGINT) AS memory_mb FROM jobs GROUP BY priority""",
    "job_queue_status": f"{_JOBS} SELECT status, priority, count(*) AS jobs, CAST(sum(pages * queries * 500) AS BIGINT) AS estimate_ms FROM jobs GROUP BY status, priority",
    "job_recommendations": f"""{_JOBS}, r AS (SELECT owner, job_id % 10 / 10 AS e, CAST(pages * 10 AS DOUBLE) AS m, pages * 50000 / total_ms AS t FROM jobs
            QUALIFY row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, job_id DESC) <= 10)
        SELECT owner, concat_ws('; ', CASE WHEN avg(e) < 0.7 THEN 'smaller batches' END, CASE WHEN avg(m) > 40 THEN 'less memory' END, CASE WHEN avg(t) < 1 THEN 'more workers' END) AS recommendations
        FROM r GROUP BY owner""",
    "worker_stats": "SELECT l_suppkey AS worker_id, count(*) AS tasks, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS failed, round(avg(l_quantity), 6) AS mean_ms FROM lineitem GROUP BY l_suppkey",
    "parse_colors": f"""WITH c AS (SELECT page_id, CASE (page_id // 3) % 4 WHEN 0 THEN '#' || substr(md5(url), 1, 6) WHEN 1 THEN '#' || substr(md5(url), 1, 3) WHEN 2 THEN {_NAMES}[page_id % {len(NAMED)} + 1] ELSE url END AS color FROM pages),
        x AS (SELECT *, CASE WHEN color LIKE '#%' AND length(color) = 7 THEN substr(color, 2) WHEN color LIKE '#%' AND length(color) = 4 THEN regexp_replace(substr(color, 2), '(.)', '\\1\\1', 'g') END AS h FROM c),
        n(name, r, g, b) AS (VALUES {_RGB})
        SELECT page_id, color, round(coalesce(CAST('0x' || substr(h, 1, 2) AS INTEGER) / 255, n.r), 6) AS r, round(coalesce(CAST('0x' || substr(h, 3, 2) AS INTEGER) / 255, n.g), 6) AS g,
               round(coalesce(CAST('0x' || substr(h, 5, 2) AS INTEGER) / 255, n.b), 6) AS b FROM x LEFT JOIN n ON n.name = lower(color)""",
    "annotation_type_from_formatting": """SELECT page_id, CASE WHEN contains(html, '<s>') THEN 'strikethrough' WHEN contains(html, '<b>') AND page_id % 2 = 0 THEN 'underline'
        WHEN page_id % 3 = 0 THEN 'highlight' ELSE 'rectangle' END AS annotation_type, CASE WHEN contains(html, '<') AND contains(html, '>') THEN 'html' ELSE 'plain' END AS format FROM pages""",
    "merge_segments": """WITH t AS (SELECT *, length(text) > 200 AS long FROM conversations),
        b AS (SELECT *, CASE WHEN long IS DISTINCT FROM lag(long) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS begins FROM t),
        r AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS run_no FROM b)
        SELECT conv_id, run_no, long, min(turn) AS first, count(*) AS n, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5 FROM r GROUP BY conv_id, run_no, long""",
    "dedup_queries": "SELECT md5(text) AS text_md5, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL",
    "html_queries": """WITH s AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS t, concat_ws('; ', CASE WHEN page_id % 5 = 0 THEN 'color: red' END, CASE WHEN page_id % 7 = 0 THEN 'background-color: yellow' END,
            CASE WHEN page_id % 4 = 0 THEN 'font-size: ' || (page_id % 9 + 8) || 'px' END) AS style FROM pages),
        a AS (SELECT page_id, CASE WHEN style <> '' THEN '<span style="' || style || '">' || t || '</span>' ELSE t END AS q FROM s),
        b AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<em>' || q || '</em>' ELSE q END AS q FROM a)
        SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<strong>' || q || '</strong>' ELSE q END AS query FROM b""",
    "rtf_queries": """SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS text, page_id % 2 = 0 AS bold, page_id % 3 = 0 AS strikethrough, false AS underline, 12.0::DOUBLE AS font_size FROM pages""",
    "rtf_segments": """SELECT page_id, regexp_extract(url, '://([^/]*)', 1) || ' at ' || page_id AS text, page_id % 2 = 1 AS bold, page_id % 3 = 1 AS italic, page_id % 5 = 1 AS underline,
        page_id % 4 = 1 AS strikethrough, CASE WHEN page_id % 7 <> 0 THEN (page_id % 23 + 10) / 2 END AS font_size FROM pages""",
    "html_segments": """WITH s AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS t, page_id % 2 = 0 AS bold, page_id % 3 = 0 AS italic, CASE WHEN page_id % 5 = 0 THEN 'red' END AS color,
            CASE WHEN page_id % 7 = 0 THEN 'yellow' END AS background_color, CASE WHEN page_id % 4 = 0 THEN CAST(page_id % 9 + 8 AS DOUBLE) END AS font_size FROM pages),
        p AS (SELECT *, bold OR italic OR color IS NOT NULL OR background_color IS NOT NULL OR font_size IS NOT NULL AS marked FROM s)
        SELECT page_id, 0 AS ord, CASE WHEN marked THEN 'see ' ELSE 'see ' || t || ' now' END AS text, false AS bold, false AS italic, NULL AS color, NULL AS background_color, NULL::DOUBLE AS font_size FROM p
        UNION ALL SELECT page_id, 1, t, bold, italic, color, background_color, font_size FROM p WHERE marked
        UNION ALL SELECT page_id, 2, ' now', false, false, NULL, NULL, NULL FROM p WHERE marked""",
}
