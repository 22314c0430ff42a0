"""Language identification by nearest centroid.

A text is the vector of its letter 1- to 3-grams (lower case, everything but letters read as one space), hashed
to a fixed number of dimensions, with logarithmic counts, weighted by inverse document frequency and normalised.  Each
language has several centroids, from spherical k-means over a bounded sample of its labelled texts; a text gets the
language of the nearest one by cosine.  A text far from all centroids (below a share of the cosines that the language's own
texts reach) is rejected.

Document frequencies come from all labelled texts; only the clustering takes a sample (``SAMPLE`` texts of each
language, about, drawn by a hash of id and text; rows that repeat both count once in it).

Defined cases: a null text and one without a letter are ``und``, rejected, with score 0; without labelled texts so
is every text; repeated rows give repeated results; other columns are left out; texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.llm.common import by_text, drawn, fresh_worker, slices

DIMENSIONS_BITS = 13
DIMENSIONS = 1 << DIMENSIONS_BITS
CLUSTERS = 4
#: Texts of each language that are clustered, about: the bound of the sample.
SAMPLE = 1200
#: A text is rejected below this share of the cosine that nearly all of the language's texts reach; of a text with
#: fewer n-grams than FULL_GRAMS, proportionately less is asked.
REJECT_SHARE, FULL_GRAMS = 0.5, 300
UNKNOWN = "und"
#: Characters of a text that are turned into n-grams at a time.
BLOCK = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _hashed(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIMENSIONS_BITS)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of a text's hashed n-grams, or None where it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes[letter | np.concatenate([[True], letter[:-1]])], [np.uint64(32)]]).astype(np.uint64)
    out = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(codes), BLOCK):
        one = codes[at : at + BLOCK + 2]
        two = one[:-1] << np.uint64(21) | one[1:]
        three = two[:-1] << np.uint64(21) | one[2:]
        for grams in (one[:BLOCK], two[:BLOCK] | np.uint64(1 << 63), three[:BLOCK]):
            out += np.bincount(_hashed(grams), minlength=DIMENSIONS)
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised rows for texts, and how many n-grams they have (0: not a letter)."""
    rows = np.zeros((len(texts), DIMENSIONS), np.float32)
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = counts(text)
        if found is not None:
            rows[k], sizes[k] = np.log1p(found, dtype=np.float32) * idf, found.sum()
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=rows, where=norms > 0), sizes


def spherical_means(rows: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of normalised rows, and each row's cosine with the nearest; starts from rows far apart."""
    centres = rows.mean(axis=0, keepdims=True)
    picked = [int((rows @ centres[0]).argmax())]
    while len(picked) < min(clusters, len(rows)):
        picked.append(int((rows @ rows[picked].T).max(axis=1).argmin()))
    centres = rows[picked]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        centres = np.array([rows[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres, (rows @ centres.T).max(axis=1)


class Model:
    """Centroids with their languages, and the document frequencies' weights; small whatever the corpus."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, langs, centroids, least


def fit(labelled: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """A model from doc_id, text, lang (rows without text or lang are left out)."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in (text for some in slices(batch.column(0), 1 << 20) for text in some.to_pylist()):
                found = counts(text)
                if found is not None:
                    total += found > 0
                    n += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], names=["dim", "n"])

    # A row for each dimension at most.
    known = rows.select("text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    of = {r["dim"]: r["n"] for r in known}
    n = of.pop(-1, 0)
    idf = np.full(DIMENSIONS, np.log(1 + n), np.float32)
    idf[list(of)] = np.log((1 + n) / (1 + np.array(list(of.values())))) + 0.1 if of else 0

    def clustered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        own, sizes = vectors(group["text"].tolist(), idf)
        has = sizes > 0
        if not has.any():
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        centres, cosines = spherical_means(own[has], clusters)
        least = float(np.quantile(cosines, 0.01))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.astype("<f4").tobytes() for c in centres], "least": least})

    sizes = F.broadcast(rows.groupBy("lang").agg((sample / F.count("*")).alias("share")))  # a row for each language
    some = rows.join(sizes, "lang").where(drawn(F.col("share"), F.col("doc_id"), F.col("text"), F.lit("sample"))).select("doc_id", "text", "lang").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text", F.lit("sample")), "doc_id", "text"))
    found = some.withColumn("r", first).where(F.col("r") <= 2 * sample).drop("r").groupBy("lang").applyInPandas(clustered, "lang string, centroid binary, least double").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["centroid"]))
    centroids = np.array([np.frombuffer(r["centroid"], "<f4") for r in found], np.float32).reshape(len(found), DIMENSIONS)
    return Model(idf, [r["lang"] for r in found], centroids, np.array([r["least"] for r in found]))


def _judged(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge() -> Callable[[pa.Array], list[pa.Array]]:
        own = shared.value

        def predict(texts: pa.Array) -> list[pa.Array]:
            langs, scores, rejected = [], [], []
            for at in range(0, len(texts), 256):
                rows, sizes = vectors(texts.slice(at, 256).to_pylist(), own.idf)
                known = (sizes > 0) & (len(own.langs) > 0)
                cosines = rows @ own.centroids.T if own.langs else np.zeros((len(rows), 1), np.float32)
                nearest = cosines.argmax(axis=1)
                score = np.clip(cosines.max(axis=1).astype(float), 0, 1) * known
                least = own.least[nearest] * REJECT_SHARE * np.minimum(1, sizes / FULL_GRAMS) if own.langs else np.ones(len(rows))
                langs += [own.langs[k] if ok else UNKNOWN for k, ok in zip(nearest, known, strict=True)]
                scores.append(score)
                rejected.append(~known | (score < least))
            return [pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))]

        return predict

    return by_text(docs, keep, judge, "lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, lang_pred, score (cosine, 0 to 1), rejected for every document."""
    rows, kept = _judged(docs, model, keep)
    return rows.select(*kept, "lang_pred", "score", "rejected")


def without_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever these are called."""
    rows, kept = _judged(docs, model, tuple(docs.columns))
    return rows.where(~F.col("rejected")).select(kept)


def fold(doc_id: Column) -> Column:
    """The fold of a document, 0 to 3; fold 2 is held out from learning.  A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4
