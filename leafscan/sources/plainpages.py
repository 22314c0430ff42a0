"""Pages in their plain form, many at once: laid-out pages rendered, and recognised pages read, on the bytes of an Arrow batch.

A page is plain if its words are ``<span class='ocrx_word' title='bbox ...'>`` elements of one class of lines, ``ocr_line``, with
nothing marked up between its first line and the end of its last.  What stands before and after is read by the HTML
parser.  Any other page is left to ``hocr.page_columns``, which gives the same for the plain ones, word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leafscan.sources.tables import CHAR, COLUMN, HEIGHT, LEFT, LINE, LINE_WORDS, LONGEST, TOP

WORD_OPEN, LINE_OPEN, CONF, CLOSE = b"<span class='ocrx_word' title='bbox ", b"<span class='ocr_line' title='bbox ", b"; x_wconf ", b"</span>"
#: Zeros behind a batch, so that no tag is read over its end; longest text before and after the lines of a plain page.
_PAD, _MOST_AROUND = 128, 4096
_OTHER, _IN_LINE, _IN_WORD, _AFTER_WORD, _AFTER_LINE = range(5)
_FOLLOWS = np.zeros((5, 5), bool)
for _a, _b in ((_IN_LINE, _IN_WORD), (_IN_WORD, _AFTER_WORD), (_AFTER_WORD, _IN_WORD), (_AFTER_WORD, _AFTER_LINE), (_AFTER_LINE, _IN_LINE)):
    _FOLLOWS[_a, _b] = True


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of neighbouring rows that have about ``most`` together."""
    part = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def rendered_bodies(texts: pa.Array, between: str) -> pa.Array:
    """What stands between the tags of the paragraph of laid-out pages, whose words are joined by ``between``, none null."""
    listed = pc.split_pattern(texts, between)
    words, counts = listed.flatten(), listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    begins = np.repeat(ends - counts, counts)
    at = np.arange(len(words)) - begins
    column, line = at % LINE_WORDS, at // LINE_WORDS
    x2 = LEFT + COLUMN * column + CHAR * np.minimum(pc.utf8_length(words).to_numpy(zero_copy_only=False), LONGEST)
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        if pc.any(pc.match_substring(texts, plain)).as_py():
            words = pc.replace_substring(words, plain, safe)
    tops = TOP + LINE * np.arange(line.max(initial=0) + 1)
    numbers = pa.array(np.arange(x2.max(initial=0) + 1)).cast(pa.string())
    joined = lambda *parts: pc.binary_join_element_wise(*parts, "")
    top, bottom = pa.array(tops).cast(pa.string()), pa.array(tops + HEIGHT).cast(pa.string())
    opened = [joined(WORD_OPEN.decode(), str(LEFT + COLUMN * k), " ") for k in range(LINE_WORDS)]
    opened = pa.array([o.as_py() for o in opened])
    # A line's tag stands before its first word and tells the right side of its last.
    firsts = np.flatnonzero(column == 0)
    lasts = np.minimum(firsts + LINE_WORDS - 1, np.repeat(ends, counts)[firsts] - 1)
    ended = pa.array(["", CLOSE.decode()]).take(pa.array((line[firsts] > 0).astype(np.int8)))
    tags = joined(ended, LINE_OPEN.decode(), str(LEFT), " ", top.take(pa.array(line[firsts])), " ", numbers.take(pa.array(x2[lasts])), " ", bottom.take(pa.array(line[firsts])), "'>")
    place = np.zeros(len(words), np.int64)
    place[firsts] = np.arange(1, len(firsts) + 1)
    tags = pa.concat_arrays([pa.array([""]), tags]).take(pa.array(place))
    lines = joined(" ", bottom, CONF.decode(), "95'>")
    whole = joined(tags, opened.take(pa.array(column)), joined(top, " ").take(pa.array(line)), numbers.take(pa.array(x2)), lines.take(pa.array(line)), words, CLOSE.decode() + " ")
    bodies = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), whole), "")
    return joined(bodies, CLOSE.decode())


class _Bytes:
    """The bytes of a batch, compared eight at a time at many places."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(_PAD, np.uint8)])
        self.eights = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))

    def begins(self, at: np.ndarray, text: bytes) -> np.ndarray:
        same = np.ones(len(at), bool)
        for k in {*range(0, len(text) - 7, 8), len(text) - 8}:
            same &= self.eights[at + k] == int.from_bytes(text[k : k + 8], "little")
        return same

    def numbers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole numbers of at most nine digits, -1 for none, and the places behind them."""
        value, end = np.zeros(len(at), np.int64), at.copy()
        for _ in range(10):
            digit = self.data[end] - np.uint8(48)
            found = digit < 10
            if not found.any():
                break
            value = np.where(found, value * 10 + digit, value)
            end += found
        return np.where((end > at) & (end < at + 10), value, -1), end

    def opened(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sides, confidence (-1: not told) and end of tags whose box begins at places, and whether they are plain."""
        sides, plain = [], np.ones(len(at), bool)
        for k in range(4):
            value, at = self.numbers(at)
            sides.append(value)
            plain &= value >= 0
            if k < 3:
                plain &= self.data[at] == ord(" ")
                at = at + 1
        told = self.begins(at, CONF)
        conf, after = self.numbers(np.where(told, at + len(CONF), at))
        plain &= ~told | (conf >= 0)
        at = np.where(told, after, at)
        plain &= (self.data[at] == ord("'")) & (self.data[at + 1] == ord(">"))
        return np.array(sides), np.where(told, conf, -1), at + 2, plain


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of words: character references told, trimmed."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    words = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
    if not len(words):
        return words
    # White space is at most U+0020, or two or three bytes that begin and end as here; the few words that may have it are trimmed one by one.
    some = lambda *values: np.isin(np.arange(256), values)
    low = range(33)
    first, last, before = data[starts], data[np.maximum(ends - 1, 0)], data[np.maximum(ends - 2, 0)]
    odd = some(*low, 0xC2, 0xE1, 0xE2, 0xE3)[first] | some(*low)[last] | (last >= 0x80) & some(0xC2, 0x80, 0x81, 0x9A)[before]
    odd[np.searchsorted(offsets, np.flatnonzero(flat == ord("&")), side="right") - 1] = True
    odd &= sizes > 0
    if not odd.any():
        return words
    return pc.replace_with_mask(words, pa.array(odd), pa.array([unescape(w).strip() for w in words.filter(pa.array(odd)).to_pylist()], pa.string()))


def read(pages: pa.Array, head: Callable[[bytes], int | None], tail: Callable[[bytes], bool]) -> tuple[np.ndarray, np.ndarray, dict[str, Callable[[], pa.Array]]]:
    """Which pages are plain; and of each of their words the number of its page and its columns, each made when asked for.

    ``head`` gives the paragraph that stands open after what is before the first line, None if that isn't certain; ``tail``
    whether what is behind the last line has no word.
    """
    known, pages = pages.is_valid().to_numpy(zero_copy_only=False), pages.cast(pa.large_string())
    offsets = np.frombuffer(pages.buffers()[1], np.int64)[pages.offset : pages.offset + len(pages) + 1]
    whole = np.frombuffer(pages.buffers()[2] or b"", np.uint8)
    bounds = offsets - offsets[0]
    text = _Bytes(whole[offsets[0] : offsets[-1]])
    data = text.data
    at = np.flatnonzero(data == ord("<"))
    tags = np.searchsorted(at, bounds)
    page = np.repeat(np.arange(len(pages)), np.diff(tags))
    limit = bounds[1:][page]
    kind, end = np.full(len(at), _OTHER), at.copy()
    sides, conf = np.zeros((4, len(at)), np.int64), np.full(len(at), -1)
    kind[((text.eights[at] & 0xFFFFFFFFFFFFFF) == int.from_bytes(CLOSE, "little")) & (at + len(CLOSE) <= limit)] = _AFTER_WORD
    spans = np.flatnonzero(text.eights[at] == int.from_bytes(WORD_OPEN[:8], "little"))
    for opening, state in ((WORD_OPEN, _IN_WORD), (LINE_OPEN, _IN_LINE)):
        own = spans[text.begins(at[spans], opening)]
        own_sides, own_conf, own_end, plain = text.opened(at[own] + len(opening))
        plain &= own_end <= limit[own]
        if state == _IN_LINE:
            plain &= own_conf < 0
        own = own[plain]
        sides[:, own], conf[own], end[own], kind[own] = own_sides[:, plain], own_conf[plain], own_end[plain], state
    kind[(kind == _AFTER_WORD) & (np.concatenate([[_OTHER], kind[:-1]]) != _IN_WORD)] = _AFTER_LINE
    lines, words = np.flatnonzero(kind == _IN_LINE), np.flatnonzero(kind == _IN_WORD)
    # From the first line of a page to the end of the line of its last word each tag must follow the one before it.
    low, high = tags[:-1], tags[1:]
    beyond = len(at)
    first = np.append(lines, beyond)[np.searchsorted(lines, low)]
    last = np.append(words, -3)[np.searchsorted(words, high) - 1] + 2
    wrong = np.concatenate([[0], np.cumsum(~_FOLLOWS[np.concatenate([[_OTHER], kind[:-1]]), kind])]) if len(at) else np.zeros(1, int)
    plain = known & (first < high) & (last > first) & (last < high) & (last >= low)
    plain &= np.searchsorted(words, first) == np.searchsorted(words, low)
    plain[plain] = wrong[last[plain] + 1] == wrong[first[plain] + 1]
    pars = np.zeros(len(pages), np.int32)
    for k in np.flatnonzero(plain).tolist():
        a, b, c, d = bounds[k], at[first[k]], at[last[k]] + len(CLOSE), bounds[k + 1]
        par = head(data[a:b].tobytes()) if b - a + d - c <= _MOST_AROUND and tail(data[c:d].tobytes()) else None
        plain[k] = par is not None
        pars[k] = par or 0
    words = words[plain[page[words]]]
    texts = _texts(data, end[words], at[words + 1]) if len(words) else pa.array([], pa.string())
    kept = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    if not kept.all():
        words, texts = words[kept], texts.filter(pa.array(kept))
    own = page[words]
    line = np.cumsum(kind == _IN_LINE)
    of_line = lines[line[words] - 1]
    counts = np.bincount(own, minlength=len(pages))
    double = lambda values: pa.array(values.astype(np.float64))
    columns = {
        "pos": lambda: pa.array((np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)),
        "par_no": lambda: pa.array(pars[own]),
        "line_no": lambda: pa.array((line[words] - line[first[own]]).astype(np.int32)),
        "line_class": lambda: pa.repeat("ocr_line", len(own)),
        "word": lambda: texts,
        "wconf": lambda: pa.array(conf[words].astype(np.int32), mask=conf[words] < 0),
    }
    for k, name in enumerate(("x1", "y1", "x2", "y2")):
        columns[name] = lambda k=k: double(sides[k, words])
        columns[f"l{name}"] = lambda k=k: double(sides[k, of_line])
    return plain & (counts > 0), own, columns
