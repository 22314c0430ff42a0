"""Closest word windows where no word has to be equal: upper bounds from running sums, best bound first, exact stop.

The score of a window of n words against a query of m is the better of two, both cut to three decimals: the mean likeness of
words at equal places, and the share of equal characters at equal places of the joined words.  Nothing can be joined on, so the
queries, a stated set, go over all pages in blocks; what a page and a query cost is kept small by bounds:

- A word of the page counts at most its best likeness to any word of the query.  These are summed along the page once, and the
  difference of two sums bounds the word score of any window.
- Of the characters the first ``HEAD`` are compared; all others count as equal.

Before that, pairs of a page and a query without any window that could reach the threshold are left out, for many pages
at once (``Asked.near``):

- What the words of a page lack to be like a query's words in their order is summed for each beginning of a window.  For that
  the queries' words are held in some hundred classes of similar lengths and letters; a word of the page is compared with what
  the words of a class have together.  Beginnings that are left are looked at again word by word.
- If enough characters are equal at equal places, some of the query's pieces of four (three, two) characters are equal as a
  whole: each mismatch spoils one piece at most.  Equal pieces are looked up and counted for each beginning of a window.

Windows whose bound can't reach the threshold are left out; the others are worked out in the order of their bounds until
no bound is as high as the best score found.  Likenesses of all words of a page and a block of queries are one product
of character counts; only pairs of words that may contain each other are looked at one by one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.plans.shared import against_all

#: The fuzzy search looks at windows from two words shorter to three longer and accepts what is better than this.
FUZZY_LEAST, SHORTER, LONGER = 0.6, 2, 3
EARLY_STOP, TOLERANCE = 0.95, 0.8
#: Characters compared for the bound; queries of a block; cells of an array that is worked on at once; windows worked out at once.
HEAD, BLOCK_QUERIES, CELLS, STEP = 96, 500, 1 << 21, 256
#: Slots of hashed pieces of characters; pages remembered by a task, and words of these.
SLOTS, REMEMBERED, SHORT = 1 << 18, 20_000, 64
#: Classes of the queries' words; share of a query's words that are summed for all beginnings; beginnings summed at once.
CLASSES, SUMMED, PART = 512, 0.8, 8192
#: Words of a page, or of pages, whose likenesses to classes are held at once.
HELD_WORDS = 32 * PART
#: Letters that classes tell apart; others share groups.
APART, GROUPS = 28, 4


class Asked:
    """A block of queries, their words numbered and their characters counted."""

    def __init__(self, queries: list[tuple[int, list[str]]]):
        self.queries = queries
        self.words = sorted({w for _, qs in queries for w in qs})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.letters = {c: k for k, c in enumerate(sorted(set("".join(self.words))))}
        self.lengths = np.array([len(w) for w in self.words])
        self.present = np.zeros((len(self.letters), len(self.words)), np.float32)
        for k, word in enumerate(self.words):
            self.present[[self.letters[c] for c in word], k] = 1
        self.distinct = self.present.sum(axis=0)
        self.by_length = defaultdict(list)
        for at, (_, qs) in enumerate(queries):
            self.by_length[len(qs)].append(at)
        self.ids = [np.array([self.number[w] for w in qs]) for _, qs in queries]
        self.joined = ["".join(qs) for _, qs in queries]
        self.codes = [np.array([ord(c) for c in j[:HEAD]]) for j in self.joined]
        self.order: list[list[int]] = []

    def likeness(self, words: list[str]) -> np.ndarray:
        """Of each page word (rows) to each query word: 1 if equal, 0.8 if one contains the other, else by characters."""
        counts = np.zeros((len(words), len(self.letters)), np.float32)
        for k, word in enumerate(words):
            for c in word:
                if (at := self.letters.get(c)) is not None:
                    counts[k, at] += 1
        lengths = np.array([len(w) for w in words])
        common = counts @ self.present
        out = common.astype(np.float64) / np.maximum(lengths[:, None], self.lengths[None, :])
        inside = (common == lengths[:, None]) | (((counts > 0).astype(np.float32) @ self.present) == self.distinct[None, :])
        for a, b in zip(*np.nonzero(inside), strict=True):
            if words[a] == self.words[b]:
                out[a, b] = 1.0
            elif words[a] in self.words[b] or self.words[b] in words[a]:
                out[a, b] = 0.8
        return out

    def _counts(self, words: list[str]) -> np.ndarray:
        """How often each word has each letter of the queries."""
        codes, of = _codes("".join(words)), np.repeat(np.arange(len(words)), [len(w) for w in words])
        known = np.array([ord(c) for c in self.letters])
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], codes), len(known) - 1)
        same = known[order][at] == codes
        places = of[same] * len(known) + order[at[same]]
        return np.bincount(places, minlength=len(words) * len(known)).reshape(-1, len(known)).astype(np.float32)

    def _classes(self) -> None:
        """Classes of the queries' words: what letters they have in all, what letters each of them has, and the least length."""
        letters, lengths = self.present.T, self.lengths.astype(np.float32)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        middle, far = letters[order[:: -(-len(order) // CLASSES)]], lengths[order[:: -(-len(order) // CLASSES)]]
        for _ in range(6):
            apart = letters.sum(axis=1)[:, None] + (middle**2).sum(axis=1)[None, :] - 2 * letters @ middle.T + np.abs(lengths[:, None] - far[None, :])
            of = apart.argmin(axis=1)
            held = np.maximum(np.bincount(of, minlength=len(middle)), 1)[:, None]
            middle, far = np.zeros_like(middle), np.bincount(of, lengths, len(held)) / held[:, 0]
            np.add.at(middle, of, letters)
            middle /= held
        self.of = np.unique(of, return_inverse=True)[1]
        members = [np.flatnonzero(self.of == k) for k in range(self.of.max() + 1)]
        place = np.empty(len(self.letters), np.int64)
        place[np.argsort(-letters.sum(axis=0), kind="stable")] = np.arange(len(place))
        group = np.where(place < APART, place, APART + place % GROUPS)
        self.grouped = np.zeros((len(place), min(len(place), APART) + GROUPS * (len(place) > APART)), np.float32)
        self.grouped[np.arange(len(place)), group] = 1
        self.any_letters = np.minimum(np.array([letters[m].max(axis=0) for m in members]) @ self.grouped, 1).T.copy()
        self.all_letters = np.minimum(np.array([letters[m].min(axis=0) for m in members]) @ self.grouped, 1).T.copy()
        self.at_least = np.array([max(1, self.lengths[m].min()) for m in members], np.float32)
        self.longest = max(map(len, self.ids))

    def _lacking(self, words: list[str]) -> np.ndarray:
        """What each word lacks at least to be like any word of each class, in steps of 1/255, rounded down."""
        out = np.empty((len(words), len(self.at_least)), np.uint8)
        every, lengths = self._counts(words) @ self.grouped, np.array([len(w) for w in words])
        letters = ((every > 0) @ 2.0 ** np.arange(every.shape[1])).astype(np.uint64)
        # The masks' upper bits tell lengths: a word has all up to its own, a class that of its shortest word.
        missed = ~(letters | ((np.uint64(1) << (np.minimum(lengths, 30) + 1).astype(np.uint64)) - np.uint64(1)) << np.uint64(32))[:, None]
        asked = (2.0 ** np.arange(every.shape[1]) @ self.all_letters).astype(np.uint64) | np.uint64(1) << (32 + np.minimum(self.at_least, 30)).astype(np.uint64)
        sizes, of = np.unique(lengths, return_inverse=True)
        scaled = (-255 / np.maximum(sizes[:, None], self.at_least)).astype(np.float32)
        for k in range(0, len(words), STEP):
            alike = every[k : k + STEP] @ self.any_letters
            inside = alike == lengths[k : k + STEP, None].astype(np.float32)
            inside |= (asked & missed[k : k + STEP]) == 0
            alike *= scaled[of[k : k + STEP]]
            alike += 255.01
            np.minimum(alike.astype(np.uint8), 255 - 204 * inside.view(np.uint8), out=out[k : k + STEP])  # 51 where the likeness may be 0.8
        return out

    def _by_words(self, words: pa.DictionaryArray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Queries and beginnings (places in ``words``, one page after the other) whose word score could reach the threshold."""
        ids, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
        if not hasattr(self, "of"):
            self._classes()
        n, found = len(ids), []
        kind = np.uint16 if self.longest <= 257 else np.uint32
        sums, place = np.empty(PART, kind), np.arange(len(distinct))
        lacking = np.zeros((len(self.at_least), PART + self.longest), kind)
        rows, classes = list(lacking), [self.of[own].tolist() for own in self.ids]
        for k in range(0, n, PART):
            if k % HELD_WORDS == 0:
                some = ids[k : k + HELD_WORDS + self.longest] if n > HELD_WORDS else ids
                held = np.unique(some)
                place[held] = np.arange(len(held))
                every = self._lacking([distinct[w] for w in held])
            if not self.order:  # first the words that most others lack much to be like
                mean = every[place[ids[:PART]]].mean(axis=0)
                self.order = [np.argsort(-mean[self.of[own]], kind="stable").tolist() for own in self.ids]
            here = place[ids[k : k + PART + self.longest]]
            for at in range(0, len(here), SHORT):  # few at a time, for the processor's cache
                lacking[:, at : min(at + SHORT, len(here))] = every[here[at : at + SHORT]].T
            lacking[:, len(here) :] = 0
            for q, (own, order) in enumerate(zip(classes, self.order, strict=True)):
                number, spared = max(1, math.ceil(SUMMED * len(own))), 255 * ((1 - threshold) * len(own) + 1e-3) + 0.01 * len(own)
                np.copyto(sums, rows[own[order[0]]][order[0] : order[0] + PART])
                for at in range(1, number):
                    i = order[at]
                    np.add(sums, rows[own[i]][i : i + PART], out=sums)
                    if at % 4 == 0 and at * 2 > number and sums.min() > spared:
                        break
                else:
                    start = np.flatnonzero(sums[: n - k] <= spared)
                    if len(start):
                        rest = sums[start].astype(np.int64) + sum(rows[own[i]][start + i].astype(np.int64) for i in order[number:])
                        start = start[rest <= spared]
                        found.append((np.full(len(start), q), start + k))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        asked, start = map(np.concatenate, zip(*found, strict=True))
        return self._with_all_words(asked, start, ids, distinct, threshold)

    def _with_all_words(self, asked: np.ndarray, start: np.ndarray, ids: np.ndarray, words: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the queries and beginnings that could reach the threshold by all their words."""
        kept, order = np.zeros(len(asked), bool), np.argsort(asked, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(asked[order])) + 1):
            for k in range(0, len(part), STEP):
                some = part[k : k + STEP]
                own = self.ids[asked[some[0]]]
                there = start[some][:, None] + np.arange(len(own))
                page, place = np.unique(ids[np.minimum(there, len(ids) - 1)], return_inverse=True)
                there = there < len(ids)
                read = [words[w] for w in page]
                counts, lengths = self._counts(read), np.array([len(w) for w in read])
                present = self.present[:, own]
                common, around = counts @ present, (counts > 0).astype(np.float32) @ present == self.distinct[own]
                alike = common / np.maximum(lengths[:, None], self.lengths[own][None, :])
                alike = np.where((common == lengths[:, None]) | around, np.maximum(alike, 0.8), alike)
                kept[some] = (alike[place.reshape(there.shape), np.arange(len(own))] * there).sum(axis=1) >= threshold * len(own) - 1e-3
        return asked[kept], start[kept]

    def _pieces(self, threshold: float) -> list[tuple]:
        """For each size of pieces the queries' pieces by their hash, and how many each query needs; those without any need 0."""
        if not hasattr(self, "pieces"):
            self.pieces, self.needed = [], np.zeros(len(self.ids), np.int64)
            by_size = defaultdict(list)
            for q, joined in enumerate(self.joined):
                misses = math.floor((1 - threshold) * len(joined) + 1e-9)
                if size := next((g for g in (4, 3, 2) if len(joined) // g > misses), 0):
                    by_size[size].append(q)
                    self.needed[q] = len(joined) // size - misses
            for size, members in by_size.items():
                hashed = [_hashes(_codes(self.joined[q]), size)[::size] for q in members]
                at, asked = np.concatenate(hashed), np.repeat(members, [len(h) for h in hashed])
                places, order = np.concatenate([np.arange(len(h)) * size for h in hashed]), np.argsort(at, kind="stable")
                self.pieces.append((size, np.searchsorted(at[order], np.arange(SLOTS + 1)), asked[order], places[order]))
        return self.pieces

    def _by_chars(self, ends: np.ndarray, text: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Queries and beginnings whose character score could reach the threshold."""
        pieces, count = self._pieces(threshold), len(ends) - 1
        begins = np.full(ends[-1] + 1, -1)
        begins[ends[:-1]] = np.arange(count)
        codes, found = _codes(text), []
        for size, first, asked, places in pieces:
            hashed = _hashes(codes, size)
            known = np.flatnonzero(np.diff(first)[hashed])
            of, at = _spans(first[hashed[known]], np.diff(first)[hashed[known]])
            start = known[of] - places[at]
            place = np.where(start >= 0, begins[np.maximum(start, 0)], -1)
            votes, seen = np.unique(asked[at[place >= 0]] * count + place[place >= 0], return_counts=True)
            votes = votes[seen >= self.needed[votes // count]]
            found.append((votes // count, votes % count))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, np.int64),) * 2

    def near(self, pages: pa.ListArray, threshold: float) -> dict[int, list[int]]:
        """The queries that could have a window of at least the threshold on a page, by the pages that have any (one threshold for all pages)."""
        flat = pages.flatten()
        if not len(flat):
            return {}
        words, text = flat.dictionary_encode(), pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), "")[0].as_py()
        lengths, ids = pc.utf8_length(words.dictionary).to_numpy(), words.indices.to_numpy()
        ends = np.concatenate([[0], lengths[ids].cumsum()])
        found = [self._by_words(words, threshold), self._by_chars(ends, text, threshold)]
        asked, start = map(np.concatenate, zip(*found, strict=True))
        page = np.searchsorted(np.cumsum(pages.value_lengths().to_numpy()), start, side="right")
        short = np.flatnonzero(self.needed == 0)  # too short for pieces: on all pages
        asked, page = np.concatenate([asked, np.tile(short, len(pages))]), np.concatenate([page, np.repeat(np.arange(len(pages)), len(short))])
        out = defaultdict(list)
        for code in np.unique(page * len(self.ids) + asked).tolist():
            out[code // len(self.ids)].append(code % len(self.ids))
        return out

    def possible(self, ws: list[str], threshold: float) -> np.ndarray:
        """Whether each query could have a window of at least the threshold on a page."""
        out = np.zeros(len(self.ids), bool)
        out[self.near(pa.array([ws], pa.list_(pa.string())), threshold).get(0, [])] = True
        return out


def _spans(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of numbers from ``first`` on: of each number, which run it is in, and the number."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) + (first - np.cumsum(counts) + counts)[of]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A slot for each run of so many characters."""
    n = max(0, len(codes) - size + 1)
    hashed = np.zeros(n, np.int64)
    for k in range(size):
        hashed = (hashed * 8191 + codes[k : k + n]) % 2147483647
    return hashed % SLOTS


def _cut(value: float) -> float:
    return math.floor(value * 1000) / 1000


def best_windows(ws: list[str], asked: Asked, threshold: float) -> list[tuple[int, int, int, float, bool]]:
    """(place of the query in the block, start, end, similarity, fuzzy) of all queries that reach the threshold on a page."""
    own = sorted(set(ws))
    number = {w: k for k, w in enumerate(own)}
    ids, count = np.array([number[w] for w in ws]), len(ws)
    alike = asked.likeness(own)
    as_asked = np.array([asked.number.get(w, -1) for w in own])[ids]
    ends = np.concatenate([[0], np.cumsum([len(w) for w in ws])])
    text = "".join(ws)
    codes = np.concatenate([np.array([ord(c) for c in text]), np.full(HEAD, -1)])
    heads = np.lib.stride_tricks.sliding_window_view(codes, HEAD)[ends[:-1]]
    out = []
    for qn, members in asked.by_length.items():
        if not 0 < qn <= count:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(as_asked, qn)
        step = max(1, CELLS // (len(windows) * max(qn, HEAD)))
        for k in range(0, len(members), step):
            some = members[k : k + step]
            equal = (windows[None] == np.stack([asked.ids[q] for q in some])[:, None, :]).sum(axis=2) / qn
            for row, q in enumerate(some):
                stopped = np.flatnonzero(equal[row] >= EARLY_STOP)
                start = int(stopped[0]) if len(stopped) else int(equal[row].argmax())
                exact = float(equal[row, start])
                if exact < TOLERANCE and (found := _fuzzy(q, qn, ids, alike, ends, text, heads, asked, max(threshold, exact, FUZZY_LEAST), exact)):
                    out.append((q, found[0], found[0] + found[1], found[2], True))
                elif exact >= threshold:
                    out.append((q, start, start + qn, exact, False))
    return out


def page_windows(ws: list[str], asked: Asked, threshold: float) -> list[tuple[int, int, int, float, bool]]:
    """``best_windows``, of the queries only that could reach the threshold."""
    return _windows(ws, asked, np.flatnonzero(asked.possible(ws, threshold)).tolist(), threshold)


def _windows(ws: list[str], asked: Asked, near: list[int], threshold: float) -> list[tuple[int, int, int, float, bool]]:
    found = best_windows(ws, Asked([asked.queries[q] for q in near]), threshold) if near else []
    return [(near[q], *window) for q, *window in found]


def _fuzzy(q, qn, ids, alike, ends, text, heads, asked, least, exact):
    """(start, words, score) of the best window that beats what it has to, shorter and earlier ones first on ties."""
    count, own, joined = len(ids), asked.ids[q], asked.joined[q]
    code, length = asked.codes[q], len(joined)
    running = np.concatenate([[0], np.cumsum(alike[:, own].max(axis=1)[ids])])
    same = (heads[:, : len(code)] == code[None, :]).cumsum(axis=1)
    bounds, sizes, starts, reaching = [], [], [], []
    for n in range(max(1, qn - SHORTER), min(count, qn + LONGER) + 1):
        start = np.arange(count - n + 1)
        by_words = (running[start + min(n, qn)] - running[start]) / max(n, qn)
        long = ends[start + n] - ends[start]
        shorter = np.minimum(long, length)
        seen = np.minimum(shorter, len(code))
        by_chars = (np.where(seen > 0, same[start, np.maximum(seen, 1) - 1], 0) + shorter - seen) / np.maximum(long, length)
        bound = np.maximum(by_words, by_chars)
        kept = np.flatnonzero(bound >= least - 1e-9)
        bounds.append(bound[kept])
        starts.append(start[kept])
        sizes.append(np.full(len(kept), n))
        reaching.append(by_chars[kept])
    bound, size, start, by_chars = map(np.concatenate, (bounds, sizes, starts, reaching))
    order, best, along = np.argsort(-bound, kind="stable"), None, np.arange(qn)
    for k in range(0, len(order), STEP):
        if best and bound[order[k]] < best[0] - 1e-9:
            break
        at = order[k : k + STEP]
        n, s = size[at], start[at]
        # Sums in the words' order; those past a shorter window's end are not taken.
        sums = np.cumsum(alike[ids[np.minimum(s[:, None] + along, count - 1)], own], axis=1)[np.arange(len(at)), np.minimum(n, qn) - 1]
        words, wanted = sums / np.maximum(n, qn), max(least, best[0] if best else 0)
        for i in np.flatnonzero((words >= wanted - 1e-9) | (by_chars[at] >= wanted - 1e-9)):
            window = text[ends[s[i]] : ends[s[i] + n[i]]]
            chars = sum(map(str.__eq__, window, joined)) / max(len(window), length)
            found = (max(_cut(float(words[i])), _cut(chars)), -int(n[i]), -int(s[i]))
            if found[0] >= least and found[0] > FUZZY_LEAST and found[0] > exact and (best is None or found > best):
                best = found
    return best and (-best[2], -best[1], best[0])


def fuzzy_matches(pages: DataFrame, queries: DataFrame, threshold: float = TOLERANCE, block: int = BLOCK_QUERIES) -> DataFrame:
    """page_id, query_id, start_index, end_index, similarity, fuzzy (whether the window comes from the fuzzy search).

    Pairs with a window of equal words of at least ``TOLERANCE`` keep it; others have the best fuzzy window if it is better.
    Rows reach the threshold.  ``pages``: page_id, ws; ``queries``: query_id, qs.  A task holds some pages and one block; short
    pages that are equal are searched once in a task.
    """
    known = queries.where(F.size("qs") > 0).select("query_id", "qs")
    schema = pages.select("page_id").schema.add("query_id", known.schema["query_id"].dataType)
    for name, kind in (("start_index", "integer"), ("end_index", "integer"), ("similarity", "double"), ("fuzzy", "boolean")):
        schema = schema.add(name, kind)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, asked, seen = None, None, {}
        for batch in batches:
            for row in range(len(batch)):
                if batch.column(0)[row].as_py() != number:
                    number, asked, seen = batch.column(0)[row].as_py(), Asked(list(enumerate(batch.column(2)[row].as_py()))), {}
                query_ids, page_ids, held = (batch.column(k)[row].values for k in (1, 3, 4))
                made: list[tuple] = []
                for at, near in asked.near(held, threshold).items():
                    ws = held[at].as_py()
                    if (windows := seen.get(key := tuple(ws) if len(ws) <= SHORT else None)) is None:
                        windows = _windows(ws, asked, near, threshold)
                        if key and len(seen) < REMEMBERED:
                            seen[key] = windows
                    made += [(at, *w) for w in windows]
                if made:
                    values = [pa.array([m[k] for m in made], t) for k, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.float64()), (5, pa.bool_()))]
                    ids = [page_ids.take(pa.array([m[0] for m in made])), query_ids.take(pa.array([m[1] for m in made]))]
                    yield pa.RecordBatch.from_arrays([*ids, *values], names=schema.names)

    return against_all(pages, known, block).mapInArrow(found, schema)
