"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  How often each combination of votes occurs, a table of
bounded size however large the corpus, is all that expectation-maximisation needs to estimate the labellers' accuracies and
the posterior of every combination.  The posteriors label a bounded sample of documents (``TRAIN_DOCS``, about,
drawn by a hash of id and text; rows that repeat both count once in it), which trains a linear scorer over hashed features of word shapes; the scorer judges all
documents.

Defined cases: null and empty texts score 0 and are rejected; without documents to learn from every other document
is kept with score 0.5; repeated rows give repeated results; other columns are left out; texts are read whole.
"""

from __future__ import annotations

import operator
import re
import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import by_text, drawn, fresh_worker, slices

#: Documents that train the scorer, about: the bound of the sample.
TRAIN_DOCS = 12_000
DIMENSIONS_BITS = 14
THRESHOLD = 0.5
#: Word shapes that a task remembers, and the longest word that it does.
MEMO_SHAPES, MEMO_CHARS = 100_000, 40

#: Each labeller: the measure it looks at; bad beyond the first limit, good within the second, else no vote; the
#: least number of words it needs.
LABELLERS = (
    ("symbols", 0.02, 0.004, 1),
    ("marked", 0.25, 0.05, 5),
    ("shouted", 0.3, 0.1, 5),
    ("doubled", 0.2, 0.05, 8),
    ("barred", 0.1, 0.01, 8),
    ("exclaimed", 0.15, 0.03, 8),
    ("endless", 40.0, 25.0, 40),
    ("squeezed", 0.85, 0.75, 30),
    ("oddly_long", 4.5, 3.0, 8),
)
#: Votes (g, b, none) that each labeller is taken to have cast on bad and on good documents before any are seen: a good
#: document is seldom called bad, a bad one has some flaws and not others.
PRIOR_VOTES = ((6.0, 6.0, 0.0), (60.0, 1.0, 0.0))
_SYMBOLS = b"$%&#*@^~{}[]<>|\\=+_`"
_SHAPES = str.maketrans(string.ascii_letters + string.digits, "a" * 26 + "A" * 26 + "0" * 10)
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_MARKS = re.compile(r"[^\w.,;:?'\"()|!-]|!!$")


class Shapes(dict):
    """Word -> (shape: letters to a or A, digits to 0, runs to one; facts), remembered.

    Facts are bits: 1 upper-cased word of two letters or more, 2 symbols or marks at its end, 4 exclaimed, 8 ends a
    sentence, 16 a bar.
    """

    PLAIN = ("a", 0)

    def __missing__(self, word: str) -> tuple[str, int]:
        if word.isalpha() and word.islower():
            found = self.PLAIN
        else:
            shape = word.translate(_SHAPES)
            if not shape.isascii():
                shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
            facts = (len(word) > 1 and word.isupper()) | (_MARKS.search(word) is not None) << 1 | word.endswith("!") << 2
            facts |= (word[-1] in ".?!:" and not word.endswith("!!")) << 3 | (word == "|") << 4
            found = _RUN.sub(r"\1", shape), facts
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_SHAPES:
                self.clear()
            self[word] = found
        return found


def measured(text: str, shapes: Shapes) -> tuple[dict[str, float], int, Counter]:
    """A text's measures, number of words, and counts of its features; the text has a word."""
    words, data = text.split(), text.encode()
    n = len(words)
    found = Counter(map(shapes.__getitem__, words))
    share = lambda bit: sum(k for (_, facts), k in found.items() if facts & bit) / n
    ends = share(8)
    measures = {
        "symbols": 1 - len(data.translate(None, _SYMBOLS)) / len(data),
        "marked": share(2),
        "shouted": share(1),
        "doubled": sum(map(operator.eq, words, words[1:])) / max(1, n - 1),
        "barred": share(16),
        "exclaimed": share(4),
        "endless": 1 / ends if ends else float(n),
        "squeezed": 1 - len(zlib.compress(data, 1)) / len(data),
        "oddly_long": abs(sum(map(len, words)) / n - 6.0),
    }
    features: Counter = Counter()
    for (shape, facts), k in found.items():
        features[f"shape {shape}"] += k / n
        features[f"facts {facts}"] += k / n
    for name, bad, good, least in LABELLERS:
        if n >= least:
            features[f"{name} {min(8, int(4 * measures[name] / bad))}"] += 0.5
    return measures, n, features


def votes(measures: dict[str, float], n: int) -> str:
    """One letter for each labeller: g good, b bad, - no vote."""
    out = ""
    for name, bad, good, least in LABELLERS:
        value = measures[name]
        out += "-" if n < least else "b" if value > bad else "g" if value <= good else "-"
    return out


def accuracies(patterns: dict[str, int], rounds: int = 60) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over vote patterns and how often they occur.

    Returns the share of good documents; for each labeller the chances of g and b among its votes, on bad and on good
    documents (shape labellers x 2 x 2); and each pattern's posterior of being good.
    """
    names = sorted(patterns)
    if not names:
        return 0.5, np.full((len(LABELLERS), 2, 2), 0.5), {}
    weight = np.array([patterns[p] for p in names], float)
    cast = np.array([["gb-".index(v) for v in p] for p in names])
    good = np.array([0.9 if p.count("b") == 0 else 0.5 if p.count("b") * 4 < p.count("g") else 0.1 for p in names])
    for _ in range(rounds):
        prior = np.clip(weight @ good / weight.sum(), 0.02, 0.98)
        chances = np.empty((cast.shape[1], 2, 2))
        for j in range(cast.shape[1]):
            for side, mass in enumerate((weight * (1 - good), weight * good)):
                cast_g, cast_b, _ = np.bincount(cast[:, j], mass, 3) + PRIOR_VOTES[side]
                chances[j, side] = cast_g / (cast_g + cast_b), cast_b / (cast_g + cast_b)
        logs = np.concatenate([np.log(chances), np.zeros((len(chances), 2, 1))], axis=2)  # no vote says nothing
        ratio = np.log(prior / (1 - prior)) + sum(logs[j, 1, cast[:, j]] - logs[j, 0, cast[:, j]] for j in range(cast.shape[1]))
        good = 1 / (1 + np.exp(-np.clip(ratio, -50, 50)))
    return float(prior), chances, dict(zip(names, good.tolist(), strict=True))


def hashed(features: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Sorted dimensions and normalised values of features."""
    dims: Counter = Counter()
    for name, value in features.items():
        dims[zlib.crc32(name.encode()) >> (32 - DIMENSIONS_BITS)] += value
    at = np.fromiter(sorted(dims), np.int64, len(dims))
    values = np.sqrt(np.array([dims[k] for k in at.tolist()], float))
    norm = np.linalg.norm(values)
    return at, values / norm if norm else values


def trained(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, rounds: int = 300, step: float = 0.5) -> np.ndarray:
    """Weights of a logistic scorer (its constant last), by full gradients with momentum over sparse rows."""
    weights = np.zeros((1 << DIMENSIONS_BITS) + 1)
    if not rows:
        return weights
    at, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    balance = np.where(targets > 0.5, 0.5 / max(targets.mean(), 0.02), 0.5 / max(1 - targets.mean(), 0.02))
    speed = np.zeros_like(weights)
    for _ in range(rounds):
        scores = np.bincount(of, values * weights[at], len(rows)) + weights[-1]
        wrong = (1 / (1 + np.exp(-np.clip(scores, -30, 30))) - targets) * balance / len(rows)
        slope = np.append(np.bincount(at, values * wrong[of], len(weights) - 1), wrong.sum()) + 1e-5 * weights
        speed = 0.9 * speed - step * slope * 10
        weights += speed
    return weights


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, dict[str, float]]:
    """Weights of the scorer and the posterior of every vote pattern, from doc_id and text."""
    rows = docs.where("text is not null and trim(text) <> ''").select("doc_id", "text")

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        shapes, seen = Shapes(), Counter()
        for batch in batches:
            for texts in slices(batch.column(0), 1 << 20):
                for text in texts.to_pylist():
                    if text.split():
                        measures, n, _ = measured(text, shapes)
                        seen[votes(measures, n)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    # At most 3 ** len(LABELLERS) rows.
    found = rows.select("text").mapInArrow(voted, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    patterns = {r["votes"]: r["n"] for r in found}
    _, _, posterior = accuracies(patterns)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashed features of the sample, a few hundred numbers a document at most, and its posterior."""
        shapes = Shapes()
        for batch in batches:
            made, targets = [], []
            for text in batch.column(0).to_pylist():
                if text.split():
                    measures, n, features = measured(text, shapes)
                    made.append(hashed(features))
                    targets.append(posterior[votes(measures, n)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([at.tobytes() for at, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary()), pa.array(targets, pa.float64())],
                names=["dims", "weights", "target"],
            )

    def learned(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["dims", "weights", "target"])
        made = [(np.frombuffer(d, np.int64), np.frombuffer(v, float)) for d, v in zip(group["dims"], group["weights"], strict=True)]
        return pd.DataFrame({"weights": [trained(made, group["target"].to_numpy(float)).astype("<f8").tobytes()]})

    total = sum(patterns.values())
    share = min(1.0, train_docs / total) if total else 1.0
    sample = rows if share == 1 else rows.where(drawn(F.lit(share), F.col("doc_id"), F.col("text"), F.lit("train")))
    features = sample.distinct().select("text").mapInArrow(featured, "dims binary, weights binary, target double")
    weights = features.groupBy(F.lit(0).alias("all")).applyInPandas(learned, "weights binary").collect()
    if total and not weights:
        raise ValueError(f"no document of {total} is in the sample of {train_docs} to learn from")
    return np.frombuffer(weights[0]["weights"], "<f8") if weights else np.zeros((1 << DIMENSIONS_BITS) + 1), posterior


def _judged(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...], threshold: float) -> tuple[DataFrame, list[Column]]:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def judge() -> Callable[[pa.Array], list[pa.Array]]:
        own, shapes = shared.value, Shapes()

        def scored(texts: pa.Array) -> list[pa.Array]:
            cast, scores = [], []
            for text in texts.to_pylist():
                if not text or not text.split():
                    cast.append("-" * len(LABELLERS))
                    scores.append(0.0)
                    continue
                measures, n, features = measured(text, shapes)
                at, values = hashed(features)
                cast.append(votes(measures, n))
                scores.append(float(1 / (1 + np.exp(-np.clip(values @ own[at] + own[-1], -30, 30)))))
            return [pa.array(cast, pa.string()), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())]

        return scored

    return by_text(docs, keep, judge, "votes string, score double, accepted boolean")


def classified(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, votes, score (chance of being good), accepted for every document."""
    rows, kept = _judged(docs, weights, keep, threshold)
    return rows.select(*kept, "votes", "score", "accepted")


def without_rejected(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are accepted, with all their columns, whatever these are called."""
    rows, kept = _judged(docs, weights, tuple(docs.columns), threshold)
    return rows.where("accepted").select(kept)
