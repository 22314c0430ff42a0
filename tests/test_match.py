import math
import random

import pytest
from pyspark.sql import functions as F

from leafscan.operators import boxes, fuzzy, geometry, match
from leafscan.plans.shared import settled


def brute(ws, qs, early_stop=True):
    best = None
    for i in range(len(ws) - len(qs) + 1):
        s = sum(a == b for a, b in zip(ws[i:], qs)) / len(qs)
        if s > 0 and (best is None or s > best[1]):
            best = (i, s)
            if early_stop and s >= 0.95:
                break
    return best


def tables(spark, pages, queries):
    return (
        spark.createDataFrame(list(enumerate(pages)), "page_id long, ws array<string>"),
        spark.createDataFrame(list(enumerate(queries)), "query_id long, qs array<string>"),
    )


def test_windows_equal_a_scan(spark):
    rng = random.Random(3)
    pages = [[rng.choice("abc") for _ in range(rng.randrange(0, 30))] for _ in range(25)]
    queries = [[rng.choice("abc") for _ in range(rng.randrange(1, 25))] for _ in range(15)]
    # A window of 0.975 before an exact one: the first that reaches the limit wins.
    long = [str(k) for k in range(40)]
    pages.append([*long[:39], "x", *long])
    queries.append(long)
    p, q = tables(spark, pages, queries)
    for stop in (True, False):
        expected = {(a, b): w for a, ws in enumerate(pages) for b, qs in enumerate(queries) if (w := brute(ws, qs, stop))}
        rows = match.best_windows(p, q, early_stop=stop).collect()
        assert {(r["page_id"], r["query_id"]): (r["start_index"], r["similarity"]) for r in rows} == expected
    pruned = match.closest_matches(p, q, 0.6).collect()
    expected = {(a, b): w for a, ws in enumerate(pages) for b, qs in enumerate(queries) if (w := brute(ws, qs)) and w[1] >= 0.6}
    assert {(r["page_id"], r["query_id"]): (r["start_index"], r["similarity"]) for r in pruned} == expected


def test_fuzzy_finds_what_exact_misses(spark):
    p, q = tables(spark, ["voltag regulatr circit provides stable power".split()], ["voltage regulator circuit".split()])
    assert match.closest_matches(p, q).count() == 0
    row = fuzzy.fuzzy_matches(p, q).first()
    assert (row["start_index"], row["end_index"], round(row["similarity"], 3), row["fuzzy"]) == (0, 3, 0.848, True)


def word_alike(a, b):
    if a == b:
        return 1.0
    return 0.8 if a in b or b in a else sum(c in b for c in a) / max(len(a), len(b))


def fuzzy_by_hand(ws, qs, threshold):
    """All windows of all sizes, one by one."""
    if not 0 < len(qs) <= len(ws):
        return None
    equal = [sum(a == b for a, b in zip(ws[i:], qs)) / len(qs) for i in range(len(ws) - len(qs) + 1)]
    at = next((i for i, s in enumerate(equal) if s >= 0.95), equal.index(max(equal)))
    best, exact = None, equal[at]
    if exact < 0.8:
        for n in range(max(1, len(qs) - 2), min(len(ws), len(qs) + 3) + 1):
            for i in range(len(ws) - n + 1):
                w = ws[i : i + n]
                total = 0.0
                for a, b in zip(w, qs):
                    total += word_alike(a, b)
                x, y = "".join(w), "".join(qs)
                s = max(math.floor(total / max(n, len(qs)) * 1000) / 1000, math.floor(sum(map(str.__eq__, x, y)) / max(len(x), len(y)) * 1000) / 1000)
                if s > (best[2] if best else 0.6):
                    best = (i, i + n, s)
    if best and best[2] > exact:
        return (*best, True) if best[2] >= threshold else None
    return (at, at + len(qs), exact, False) if exact >= threshold else None


def test_bounds_lose_no_fuzzy_window(spark):
    rng = random.Random(12)
    letters = "abcdeé"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    misread = lambda w: w if rng.random() < 0.5 else w[: rng.randrange(len(w))] + rng.choice(letters) + w[rng.randrange(len(w)) :]
    pages = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))] for _ in range(25)]
    queries = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 5, 8, 30]))] for _ in range(22)]
    for page in pages[::2]:
        page[3:3] = map(misread, rng.choice(queries))
    p, q = tables(spark, pages, queries)
    for threshold, block in ((0.6, 500), (0.8, 4), (0.9, 500), (0.3, 7)):
        got = {(r["page_id"], r["query_id"]): (r["start_index"], r["end_index"], r["similarity"], r["fuzzy"]) for r in fuzzy.fuzzy_matches(p, q, threshold, block).collect()}
        assert got == {(a, b): w for a, ws in enumerate(pages) for b, qs in enumerate(queries) if (w := fuzzy_by_hand(ws, qs, threshold))}
    assert fuzzy.fuzzy_matches(p, q.where("query_id < 0")).count() == 0


def test_boxes_and_quads(spark):
    words = spark.createDataFrame(
        [(1, 0, "Document", 50.0, 100.0, 150.0, 130.0), (1, 1, "Title", 160.0, 100.0, 250.0, 130.0), (1, 2, "Header", 60.0, 150.0, 350.0, 180.0)],
        "page_id long, pos int, word string, x1 double, y1 double, x2 double, y2 double",
    )
    found = spark.createDataFrame([(1, 7, 0, 2, 1.0), (1, 8, 0, 3, 1.0)], "page_id long, query_id long, start_index int, end_index int, similarity double")
    got = {r["query_id"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in boxes.match_boxes(found, words).collect()}
    assert got == {7: (50, 100, 250, 130), 8: (50, 100, 350, 180)}
    quads = boxes.line_quads(boxes.matched_words(found, words)).orderBy("query_id", "line_index").collect()
    assert [(q["query_id"], q["line_index"], q["text"]) for q in quads] == [(7, 0, "Document Title"), (8, 0, "Document Title"), (8, 1, "Header")]
    area = boxes.words_in_area(boxes.match_boxes(found, words).where("query_id = 7"), words, padding=20.0).collect()
    assert {r["word"] for r in area} == {"Document", "Title", "Header"}
    assert boxes.words_in_area(boxes.match_boxes(found, words).where("query_id = 7"), words, padding=19.0).count() == 2


def test_offsets_and_limit(spark):
    p, q = tables(spark, ["a bb ccc bb".split()], [["bb", "ccc"], ["a"]])
    found = match.closest_matches(p, q)
    words = spark.createDataFrame([(0, k, w) for k, w in enumerate("a bb ccc bb".split())], "page_id long, pos int, word string")
    spans = {r["query_id"]: (r["char_start"], r["char_end"]) for r in match.with_char_offsets(found, words).collect()}
    assert spans == {0: (2, 8), 1: (0, 1)}
    assert match.top_matches(found, 1).count() == 1
    assert {r["text"] for r in match.with_text(found, p).collect()} == {"bb ccc", "a"}


def lines_by_hand(words, tolerance):
    """Each word to the first line whose mean centre is near enough, in the order given; lines by mean, words by left edge."""
    lines = []
    for word in words:
        cy = (word[3] + word[5]) / 2
        for line in lines:
            if abs(cy - sum((w[3] + w[5]) / 2 for w in line) / len(line)) <= tolerance:
                line.append(word)
                break
        else:
            lines.append([word])
    order = sorted(range(len(lines)), key=lambda k: (sum((w[3] + w[5]) / 2 for w in lines[k]) / len(lines[k]), k))
    shown = [sorted(lines[k], key=lambda w: (w[2], w[0])) for k in order]
    return [(n, min(w[2] for w in ln), min(w[3] for w in ln), max(w[4] for w in ln), max(w[5] for w in ln), len(ln), " ".join(w[1] for w in ln)) for n, ln in enumerate(shown)]


def test_lines_drift_with_their_means(spark):
    rng = random.Random(6)
    rows, want = [], {}
    cases = [[(k, f"w{k}", 10.0 * k, 8.0 * k, 10.0 * k + 5, 8.0 * k + 4) for k in range(5)]]  # five words 8 pixels apart: 3 lines
    cases += [[(k, f"w{k}", float(rng.randrange(50)), y := float(rng.randrange(60)), 60.0, y + rng.randrange(1, 12)) for k in range(rng.randrange(1, 25))] for _ in range(12)]
    for q, words in enumerate(cases):
        rows += [(1, q, *w) for w in words]
        want[q] = lines_by_hand(words, 10.0)
    table = spark.createDataFrame(rows, "page_id long, query_id long, pos int, word string, x1 double, y1 double, x2 double, y2 double").repartition(3)
    got = {}
    for r in boxes.line_quads(table).orderBy("query_id", "line_index").collect():
        got.setdefault(r["query_id"], []).append((r["line_index"], r["x1"], r["y1"], r["x2"], r["y2"], r["n_words"], r["text"]))
    assert got == want and len(got[0]) == 3


def test_marker_offsets(spark):
    text = "[[PARAGRAPH]] [[LINE 1 2 3 4]] a bb a[[LINE 1 6 3 8]]bb  a [[odd [[LINE 1 9 3 9]] bb a"
    # An opening without its end is a marker up to the next end, so the words are a bb a bb a bb a.
    marked = spark.createDataFrame([(0, text)], "page_id long, marked string")
    spans = [(0, q, s, e) for q, (s, e) in enumerate([(0, 1), (1, 3), (2, 5), (3, 4), (0, 7)])]
    found = match.with_marker_offsets(spark.createDataFrame(spans, "page_id long, query_id long, start_index int, end_index int"), marked)
    got = {r["query_id"]: text[r["marker_start"] : r["marker_end"]] for r in found.collect()}
    assert got == {0: "a", 1: "bb a", 2: "a[[LINE 1 6 3 8]]bb  a", 3: "bb", 4: "a bb a[[LINE 1 6 3 8]]bb  a [[odd [[LINE 1 9 3 9]] bb a"}


def test_joined_sides_are_broadcast_by_their_bytes(spark):
    few = spark.createDataFrame([(1, ["x" * 40_000] * 3, None), (2, None, "y")], "k long, ws array<string>, s string")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(settled(few)) and hinted(settled(few, 125_000)) and not hinted(settled(few, 115_000)) and hinted(settled(few.limit(0), 0))
    deep = few.select(F.array(F.struct("k", "ws")).alias("a"), F.lit(None).cast("array<int>").alias("i"))
    assert not hinted(settled(deep, 100_000)) and settled(deep).count() == 2


def test_closest_pages_equal_all_pairs(spark):
    rng = random.Random(8)
    pages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))] for _ in range(30)]
    queries = [[rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 5, 9, 20]))] for _ in range(20)]
    for k, page in enumerate(pages[:12]):  # queries with enough pages at the tolerance, and with too few
        page[k:k] = queries[k // 5 * 4]
    p, q = tables(spark, pages, queries)
    for votes, stop, most in ((1, True, 3), (4, True, 3), (3, False, 1)):
        expected = {}
        for b, qs in enumerate(queries):
            near = sorted((-w[1], a, w[0]) for a, ws in enumerate(pages) if (w := brute(ws, qs, stop)) and w[1] >= 0.4)
            expected |= {(b, k): (a, at, at + len(qs), -s) for k, (s, a, at) in enumerate(near[:most], 1)}
        rows = match.closest_pages(p, q, most, early_stop=stop, votes=votes).collect()
        assert {(r["query_id"], r["rank"]): (r["page_id"], r["start_index"], r["end_index"], r["similarity"]) for r in rows} == expected
        assert len(rows) == len(expected)
    assert match.closest_pages(p, q.where("query_id < 0")).count() == 0
    with pytest.raises(ValueError):
        match.closest_pages(p, q, least=0.9)


def test_markup_annotations(spark):
    nan, inf = float("nan"), float("inf")
    good = ([1.00000049, 2.0, 3.0, 4.0], [1.0] * 8, 255, 128, 0, "highlight", None, "a b")
    rows = [
        (0, *good),
        (1, *good[:5], "underline", 0.0, None),
        (2, *good[:5], "strikethrough", 0.25, "x"),
        (3, *good[:5], "note", 1.5, "x"),
        (4, [1.0, 2.0], [], 256, -1, 0, "highlight", 0.5, "x"),
        (5, [1.0, nan, 3.0, 4.0], [inf] * 8, None, 0, 0, None, 0.5, "x"),
        (6, None, None, 0, 0, 0, "highlight", 0.5, "x"),
    ]
    given = spark.createDataFrame(rows, "k int, rect array<double>, quad_points array<double>, r int, g int, b int, annotation_type string, opacity double, text string")
    got = {r["k"]: r for r in geometry.markup_annotations(given).collect()}
    assert (got[0]["rect"][0], got[0]["color"], got[0]["opacity"], got[0]["contents"], got[0]["flags"], got[0]["errors"]) == (1.0, [1.0, 0.501961, 0.0], 0.5, "Highlight: a b", 4, [])
    assert (got[1]["subtype"], got[1]["opacity"], got[1]["contents"]) == ("Underline", 0.8, "Underline: ")
    assert (got[2]["subtype"], got[2]["opacity"]) == ("StrikeOut", 0.25)
    assert (got[3]["subtype"], got[3]["contents"], got[3]["errors"]) == ("Highlight", "Annotation: x", ["opacity must be within 0 and 1"])
    assert got[4]["errors"] == ["rect needs 4 numbers", "quad points come in eights", "colours must be within 0 and 255"]
    assert got[5]["errors"] == ["quad points must be finite", "rect must be finite", "colours must be within 0 and 255"]
    assert got[6]["errors"] == ["rect needs 4 numbers", "quad points come in eights"]


def test_unscaled_boxes(spark):
    box = [F.lit(float(v)) for v in (10, 20, 30, 50)]
    row = spark.range(1).select(geometry.unscaled_rect(*box, F.lit(100.0)).alias("r"), geometry.unscaled_quad(*box, F.lit(100.0)).alias("q")).first()
    assert (row["r"], row["q"]) == ([10, 50, 30, 80], [10, 80, 30, 80, 10, 50, 30, 50])
