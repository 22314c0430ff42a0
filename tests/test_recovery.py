import math
import random
import re

import pytest
from pyspark.sql import functions as F

from leafscan.operators import chain, match, recovery

#: Words of a sample page with their boxes, a text, and the box that belongs to it.
CASES = [
    ([("Document", 50, 100, 150, 130), ("Title", 160, 100, 250, 130), ("Header", 260, 100, 350, 130)], "Document Title", (50, 100, 250, 130)),
    ([("important", 300, 400, 420, 450), ("information", 430, 400, 550, 450), ("located", 560, 400, 640, 450), ("here", 650, 400, 700, 450)], "important information", (300, 400, 550, 450)),
    ([("Contact", 600, 700, 700, 750), ("Information", 710, 700, 850, 750), ("Footer", 860, 700, 950, 750)], "Contact Information", (600, 700, 850, 750)),
    ([("This", 100, 200, 150, 230), ("is", 160, 200, 180, 230), ("a", 190, 200, 200, 230), ("multi-line", 100, 240, 200, 270), ("text", 210, 240, 300, 270), ("example", 310, 240, 400, 270)], "multi-line text", (100, 240, 300, 270)),
]
WORDS = "page_id long, pos int, word string, line_no int, x1 double, y1 double, x2 double, y2 double"


def tables(spark, cases=CASES):
    words = [(p, k, w[0], int(w[2]) // 40, *map(float, w[1:])) for p, (ws, _, _) in enumerate(cases) for k, w in enumerate(ws)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame([(p, 7, text) for p, (_, text, _) in enumerate(cases)], "page_id long, query_id long, text string")


def test_boxes_with_gaps(spark):
    words, pairs = tables(spark)
    pages = words.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]).alias("ws"))

    def boxes(asked):
        found = recovery.gap_boxes(chain.stretches(pages, asked), asked, words).collect()
        return {r["query_id"]: (r["page_id"], (r["x1"], r["y1"], r["x2"], r["y2"])) for r in found}

    asked = spark.createDataFrame([(p, text) for p, (_, text, _) in enumerate(CASES)], "query_id long, text string")
    assert boxes(asked) == {p: (p, tuple(map(float, CASES[p][2]))) for p in range(4)}
    assert boxes(spark.createDataFrame([(0, "zzz qqq xxx"), (1, "?!"), (2, None), (3, "important informatoin located here")], "query_id long, text string")) == {3: (1, (300.0, 400.0, 700.0, 450.0))}


def brute_chain(words, wanted, need, width):
    """Longest common subsequences of all stretches, the best by length, end and begin."""
    best = None
    for first in range(len(words)):
        row = [0] * (len(wanted) + 1)
        for last in range(first, min(len(words), first + width)):
            new = [0]
            for j, w in enumerate(wanted):
                new.append(row[j] + 1 if w == words[last] else max(new[j], row[j + 1]))
            row = new
            if row[-1] >= need and (best is None or (row[-1], -last, first) > best):
                best = (row[-1], -last, first)
    return best and (best[0], best[2], -best[1])


def test_chains_equal_all_stretches():
    rng = random.Random(4)
    for _ in range(300):
        words, wanted = ([rng.choice("abcdef") for _ in range(rng.randrange(0, 30))] for _ in range(2))
        need, width = rng.randrange(1, 6), rng.randrange(1, 20)
        assert chain.longest_chain(words, wanted, need, width) == brute_chain(words, wanted, need, width)


def planted(rng, text, vocabulary):
    """A text with words dropped, added and misread, a fifth of it at most."""
    out = list(text)
    for _ in range(rng.randrange(1, max(2, len(text) // 5))):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[k : k + (kind != 1)] = [[], [rng.choice(vocabulary)], ["misread"]][kind]
    return out


def test_stretches_equal_all_pages_and_texts(spark):
    """Every pair of a page and a text by brute force; and planted texts that no exact window holds are found."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)] + ["The", "the.", "--", "Ünï"]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 25, 40]))] for _ in range(14)]
    pages, plants = [], set()
    for p in range(40):
        page = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        if p % 2:
            q = rng.randrange(14)
            at = rng.randrange(len(page) + 1)
            page[at:at] = planted(rng, texts[q], vocabulary)
            if len(texts[q]) >= 12:
                plants.add((p, q))
        pages.append(page)
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, ws array<string>").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(99, None), (98, "")], "query_id long, text string")
    got = {(r["page_id"], r["query_id"]): (r["n_found"], r["start_index"], r["end_index"]) for r in chain.stretches(table, asked).collect()}
    cleaned = lambda w: re.sub(r"\W", "", w.lower())
    want = {}
    for p, page in enumerate(pages):
        held = [(k, cleaned(w)) for k, w in enumerate(page) if cleaned(w)]
        for q, text in enumerate(texts):
            qs = [w for w in map(cleaned, text) if w]
            need = math.ceil(len(qs) * 0.7 - 1e-9)
            if qs and (best := brute_chain([w for _, w in held], qs, need, len(qs) + len(qs) // 2)):
                want[p, q] = (best[0], held[best[1]][0], held[best[2]][0] + 1)
    assert got == want
    exact = {(r["page_id"], r["query_id"]) for r in match.closest_matches(table, asked.select("query_id", F.split("text", " ").alias("qs")), 0.7).collect()}
    assert len(plants & set(got)) >= 0.99 * len(plants) and len(plants - exact) > 3  # measured recall


@pytest.mark.parametrize(
    ("page", "text", "run"),
    [
        ("a b c d e f", "b c d", [1, 2, 3]),
        ("x voltage regulater circuit y", "voltage regulator circuit", [1, 2, 3]),  # a misread word
        ("one two noise three four", "one two three four", [0, 1, 3, 4]),  # a gap after half of the text
        ("one noise two three four", "one two three four", []),  # a gap too early
        ("one two nine ten", "one two three four", []),
        ("onetwo thre efour", "one two three four", [0, 1, 2]),  # words cut elsewhere
        ("a", "b c", []),
    ],
)
def test_runs(page, text, run):
    assert recovery.run_with_gaps(page.split(), text.split()) == run


def test_token_boxes(spark):
    marked = "[[PARAGRAPH]] [[LINE 1 2 30 4]] red green blue [[LINE 1 12 40 14]] cyan pink [[PARAGRAPH]] [[LINE 1 22 50 24]] red lime"
    texts = {1: "red green", 2: "blue cyan pink", 3: "red lime", 4: "green blue [[LINE 1 12 40 14]] cyan", 5: "", 6: "much longer " * 20, 7: "Q"}
    pairs = spark.createDataFrame([(0, k, t) for k, t in texts.items()], "page_id long, query_id long, text string")
    rows = {r["query_id"]: tuple(r)[2:] for r in recovery.token_boxes(pairs, spark.createDataFrame([(0, marked)], "page_id long, marked string")).collect()}
    assert rows[1] == (1.0, 2.0, 1.0, 0.0) and rows[3] == (1.0, 22.0, 1.0, 0.0)
    assert rows[4] == (1.0, 2.0, 40.0, 14.0)
    assert 5 not in rows and 6 not in rows and 7 not in rows


def test_text_spans_and_opening_boxes(spark):
    words, _ = tables(spark)
    pages = words.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]).alias("ws"))
    asked = [(3, 1, "is a multi-line"), (3, 2, "s a multi"), (3, 3, "This is b multi-line"), (3, 4, "That was b multi-line"), (3, 5, " ")]
    spans = recovery.text_spans(spark.createDataFrame(asked, "page_id long, query_id long, text string"), pages)
    found = {r["query_id"]: (r["start_index"], r["end_index"], r["exact"]) for r in spans.collect()}
    assert found == {1: (1, 4, True), 2: (1, 4, True), 3: (0, 4, False)}
    boxes = {r["query_id"]: tuple(r)[2:] for r in recovery.opening_boxes(spans, words).collect()}
    assert boxes[1] == (100.0, 200.0, 400.0, 270.0)
    one = spark.createDataFrame([(0, 1, 0, 2)], "page_id long, query_id long, start_index int, end_index int")
    assert tuple(recovery.opening_boxes(one, words).first())[2:] == (50.0, 100.0, 50.0, 100.0)
