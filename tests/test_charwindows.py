"""Boxes from line markers against a search that tries every window, one character after the other."""

import random
import re

import pytest

from leafscan.operators import charwindows

PAGE = "[[PARAGRAPH]] [[LINE 100 200 300 400]] hello world test of a rather long first line [[LINE 500 600 700 800]] another line of hello worlds"


def tried(page, text, enough=0.85):
    """Grow each window to the left, one end after the other."""
    best = None
    for end in range(len(page), len(text), -1):
        start = end - len(text)
        while start >= 0:
            window = re.sub(r"\[\[.*?\]\] ", "", page[start:end])
            if len(window) >= len(text):
                break
            start -= len(text) - len(window)
        if start < 0:
            continue
        share = sum(a == b for a, b in zip(window, text, strict=True)) / len(text)
        if share > (best[2] if best else 0):
            best = (start, end, share)
        if best and best[2] > enough:
            break
    return best


def test_windows_equal_those_tried_one_by_one():
    rng = random.Random(3)
    for case in range(400):
        words = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 30))]
        pieces = []
        for word in words:
            if rng.random() < 0.2:
                pieces.append(f"[[LINE {rng.randint(0, 9)} 20 3 4]]")
            if rng.random() < 0.05:
                pieces.append("[[PARAGRAPH]]")
            pieces.append(word)
        page = " ".join(pieces)
        text = "".join(rng.choice("abé [L]1") for _ in range(rng.choice([1, 2, 5, 12, 25, 40])))
        if case % 2 and len(page) > 20:
            at = rng.randint(0, len(page) - 10)
            text = re.sub(r"\[\[.*?\]\] ", "", page[at : at + rng.randint(5, 40)])
        assert charwindows.window_of(page, text) == (tried(page, text) if text else None), (page, text)


def test_blocks_of_windows_give_the_same(monkeypatch):
    whole = charwindows.window_of(PAGE, "hxllo wyrkd"), charwindows.window_of(PAGE, "hello world")
    monkeypatch.setattr(charwindows, "_AT_ONCE", 40)
    assert whole == (charwindows.window_of(PAGE, "hxllo wyrkd"), charwindows.window_of(PAGE, "hello world"))
    assert whole[1] == tried(PAGE, "hello world")


@pytest.mark.parametrize(
    ("text", "box"),
    [
        ("test of a rather long first line another", (100.0, 200.0, 700.0, 800.0)),  # over the line's end
        ("first line another", (100.0, 200.0, 0.0, 0.0)),  # too short: windows over the marker end inside it, which stays as text
        ("hello world", (500.0, 600.0, 0.0, 0.0)),  # inside a line, the last of equals
        ("hello world test", (100.0, 200.0, 0.0, 0.0)),
        ("another line", (500.0, 600.0, 0.0, 0.0)),
    ],
)
def test_boxes(spark, text, box):
    texts = spark.createDataFrame([(1, 7, text), (1, 8, None), (1, 9, ""), (2, 7, text), (3, 7, text)], "page_id long, query_id long, text string")
    marked = spark.createDataFrame([(1, PAGE, "x"), (2, None, "x"), (3, "", "x")], "page_id long, marked string, text string")
    (row,) = charwindows.character_boxes(charwindows.character_windows(texts, marked)).collect()
    assert (row["page_id"], row["query_id"], row["x1"], row["y1"], row["x2"], row["y2"]) == (1, 7, *box)
    assert (row["start"], row["end"], row["similarity"]) == tried(PAGE, text)
    assert charwindows.character_windows(texts.where("page_id > 5"), marked).count() == 0


def test_only_windows_that_can_win_are_compared(monkeypatch):
    """match_character_boxes: a text is laid over the page as a whole; windows with a piece of a marker are compared only where they could win."""
    rng, compared = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    lines = [[word() for _ in range(10)] for _ in range(40)]
    page = " ".join(["[[PARAGRAPH]]", *(f"[[LINE 100 {n} 200 300]] " + " ".join(line) for n, line in enumerate(lines))])
    plain = charwindows.np.clip
    monkeypatch.setattr(charwindows.np, "clip", lambda a, *rest: compared.append(a.size) or plain(a, *rest))
    for text in (" ".join(lines[7] + lines[8]), " ".join([*lines[3][4:], "zzzzz", *lines[4]]), " ".join(word() for _ in range(30))):
        compared.clear()
        assert charwindows.window_of(page, text) == tried(page, text)
        assert sum(compared) < len(page) * len(text) / 3
