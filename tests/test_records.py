import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from leafscan.operators import cache, citations, richtext
from leafscan.plans.annotate import rich_text_queries
from leafscan.plans.shared import globally_ranked


def test_citation_leaves_out_what_is_missing(spark):
    row = spark.createDataFrame([("A title", None, "http://x.org")], "t string, a string, u string")
    made = citations.citation("apa", {"title": F.col("t"), "author": F.col("a"), "url": F.col("u")}, F.lit("2024-03-05").cast("date"))
    assert row.select(made).first()[0] == "(2024). A title. Retrieved March 5, 2024, from http://x.org"
    with pytest.raises(ValueError, match="unsupported"):
        citations.citation("odd", {}, F.lit(None))


def test_metadata(spark):
    urls = ["https://www.example.com/a", "http://localhost:80/", "no url", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(citations.organization_of(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["Example", "localhost", "Unknown Source", "Unknown Source"]


def test_bibliography(spark):
    cited = spark.createDataFrame([("b", 1, "z"), ("a", 2, "y"), ("b", 1, "c")], "section string, page long, citation string")
    rows = citations.bibliography(cited).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["b", "=", "c", "z", "a", "=", "y"]


def test_bibliography_keeps_lines_without_a_section(spark):
    cited = spark.createDataFrame([(None, 4, "w"), ("b", 2, "c"), (None, 3, "v")], "section string, page long, citation string")
    rows = citations.bibliography(cited).orderBy("line_no").collect()
    assert [(r["section"], r["line"]) for r in rows] == [("b", "b"), ("b", "="), ("b", "c"), (None, None), (None, None), (None, "v"), (None, "w")]


def test_global_rank(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    assert globally_ranked(rows, F.col("v")).where("rank <> v + 1").count() == 0
    assert globally_ranked(rows.limit(0), F.col("v")).count() == 0


def test_collated_order(spark):
    words = ["zebra", "Éclair", "eclair", "Zoo", "apple", "éclair", "Apple", "Ångström", "b"]
    cited = spark.createDataFrame([("s", 1, w) for w in words], "section string, page long, citation string").repartition(3)
    shown = lambda rows: [r["line"] for r in rows.orderBy("line_no").collect()]
    assert shown(citations.plain_bibliography(cited)) == ["Ångström", "apple", "Apple", "b", "eclair", "éclair", "Éclair", "zebra", "Zoo"] or shown(citations.plain_bibliography(cited)) == [
        "apple", "Apple", "Ångström", "b", "eclair", "éclair", "Éclair", "zebra", "Zoo"
    ]
    assert shown(citations.plain_bibliography(cited, collation=None)) == sorted(words)
    assert shown(citations.bibliography(cited))[2:] == shown(citations.plain_bibliography(cited))


def test_joined_files_are_the_export(spark, tmp_path):
    rows = [(f"c{k:03d}", "mla", 'a "b"', k, "d", datetime.datetime(2024, 1, 1)) for k in range(200)]
    cited = spark.createDataFrame(rows, "citation string, format string, match_text string, page_number long, doc_uid string, timestamp timestamp").repartition(5)
    for fmt in ("json", "csv"):
        lines = citations.whole_export(cited, fmt, F.col("citation"))
        for _ in range(2):  # a rerun replaces
            citations.write_lines(lines, str(tmp_path / fmt), parts=4)
        files = sorted((tmp_path / fmt).glob("part-*"))
        whole = "".join(f.read_text() for f in files)
        assert len(files) == 4 and whole.splitlines() == [r["line"] for r in lines.orderBy("number").collect()]
    assert len(json.loads((lambda d: "".join(f.read_text() for f in sorted(d.glob("part-*"))))(tmp_path / "json"))) == 200


def test_gets_of_one_key_are_spread_and_find_their_sets(spark):
    rng = random.Random(2)
    at = datetime.datetime(2024, 1, 1)
    hour = lambda: at + datetime.timedelta(hours=rng.randrange(60))
    key = lambda: rng.choice([("s", 1)] * 6 + [("s", 2), ("t", 1), ("t", 9), ("u", None)])
    sets = [(*key(), hour(), f"d{k}") for k in range(60)]
    gets = [(*key(), hour(), k, f"x{k}") for k in range(300)] + [("s", 1, None, 900, "no time")]
    schema = "store string, key long, ts timestamp"
    found = cache.found_at(spark.createDataFrame(gets, f"{schema}, id long, data2 string").repartition(4), spark.createDataFrame(sets, f"{schema}, data string"), "6 hours")
    want = {}
    for s, k, t, i, _ in gets:
        before = [(x[2], x[3]) for x in sets if k is not None and t is not None and x[:2] == (s, k) and x[2] <= t]
        last = max(before, default=(None, None))
        want[i] = (*last, bool(last[0] and t <= last[0] + datetime.timedelta(hours=6)))
    assert {r["id"]: (r["set_at"], r["data"], r["hit"]) for r in found.collect()} == want
    none = spark.createDataFrame([], f"{schema}, data string")
    assert cache.found_at(spark.createDataFrame(gets, f"{schema}, id long, data2 string"), none).where("hit OR set_at IS NOT NULL").count() == 0
    assert cache.found_at(spark.createDataFrame([], f"{schema}, id long, data2 string"), none).count() == 0


def test_store_puts_deletes_and_reads_back(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, n)
    store = cache.Store(spark, str(tmp_path / "store"), "long", buckets=4)
    batch = lambda *rows: spark.createDataFrame(list(rows), "store string, key long, ts timestamp, data string, size long")
    keys = lambda *rows: spark.createDataFrame(list(rows), "store string, key long")
    held = lambda: {(r["store"], r["key"]): r["data"] for r in store.read().collect()}
    assert held() == {}
    first = batch(*[("a", k, day(1), f"v{k}", 1) for k in range(20)])
    store.put(first)
    store.put(batch(("a", 3, day(2), "new", 1), ("b", 3, day(2), "b3", 1)))
    assert held() == {**{("a", k): f"v{k}" for k in range(20)}, ("a", 3): "new", ("b", 3): "b3"}
    store.delete(keys(("a", 4), ("a", 5), ("z", 1)), F.lit(day(3)))
    want = {k: v for k, v in held().items()}
    assert ("a", 4) not in want and len(want) == 19
    store.put(first)  # a batch that runs again changes nothing
    assert held() == want
    store.put(batch(("a", 4, day(4), "again", 1)))
    assert held() == want | {("a", 4): "again"}
    store.clear(F.lit(day(5)), "a")
    assert held() == {("b", 3): "b3"}
    store.swept(F.lit(day(3)), "24 hours")
    assert held() == {("b", 3): "b3"} and store._all().where("gone AND ts < TIMESTAMP '2024-01-02'").count() == 0
    store.clear(F.lit(day(6)))
    assert held() == {}


def test_cache_holds_to_the_very_end(spark):
    at = datetime.datetime(2024, 1, 1)
    sets = spark.createDataFrame([("s", 1, at, 1, "a", 5), ("s", 1, at + datetime.timedelta(hours=24), 2, "b", 6), ("s", 2, at, 3, "c", 7)], "store string, key long, ts timestamp, id long, data string, size long")
    assert [r["hit"] for r in cache.lookups(sets).orderBy("id").collect()] == [False, True, False]
    live, gone = cache.cleaned(cache.entries(sets), F.lit(at + datetime.timedelta(hours=24, seconds=1)))
    assert [(r["key"], r["data"]) for r in live.collect()] == [(1, "b")]
    assert gone.first()["freed"] == 7


@pytest.mark.parametrize(("html", "flags"), [("<strong>Bold text</strong>", {"bold"}), ("<em>x</em>", {"italic"}), ("<u>x</u>", {"underline"}), ("<s>x</s>", {"strikethrough"}), ("<b><i>x</i></b>", {"bold", "italic"}), ("<span style='font-weight: 700'>x</span>", {"bold"})])
def test_html_flags(html, flags):
    (segment,) = richtext.html_segments(html)
    assert {f for f in ("bold", "italic", "underline", "strikethrough") if segment[f]} == flags


def test_html_styles_and_order():
    found = richtext.html_segments("Normal text <strong>bold text</strong> more <em style='color: blue; font-size: 16px; font-family: Arial'>x</em>")
    assert [s["text"] for s in found] == ["Normal text ", "bold text", " more ", "x"]
    assert (found[3]["color"], found[3]["font_size"], found[3]["font_family"]) == ("blue", 16.0, "Arial")


def test_rich_text_queries(spark):
    texts = spark.createDataFrame([(1, "<s>old</s> <u>new</u> <u>er</u>"), (2, "{\\rtf1\\ansi \\b Hello\\b0  world}"), (3, "plain words")], "query_set long, text string")
    rows = rich_text_queries(texts).orderBy("query_set", "run_no").collect()
    assert [(r["query_set"], r["text"], r["annotation_type"]) for r in rows] == [
        (1, "old", "strikethrough"), (1, "new er", "underline"), (2, "Hello world", "rectangle"), (3, "plain words", "rectangle"),
    ]


def test_micro_batches_equal_one_batch(spark, tmp_path):
    from leafscan.sources.tables import pages_of_texts
    from leafscan.streaming import each_batch

    texts = spark.createDataFrame([(k, "a b " * k) for k in range(6)], "doc_id long, text string").repartition(3)
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    plan = lambda t: pages_of_texts(t, "doc_id", "text").selectExpr("page_id", "size(ws) AS n")
    each_batch(stream, plan, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r["page_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["page_id"], r["n"]) for r in plan(texts).collect()}
