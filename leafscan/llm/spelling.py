"""Spelling variant grouping: words one edit apart, found by an index of variable-length grams.

**Dictionary.** Words get a begin and an end mark.  A gram of at least ``SHORTEST`` characters that occurs often is
*extended*, up to ``LONGEST`` characters; a rare one isn't.  Only grams above a least count are kept, and that
count grows with the number of gram places, so there are at most ``MOST_GRAMS`` of each length: the dictionary is the one
thing that is sent to every task.  It decides the cost, never the result.

**Decomposition.** A gram begins at every place of a word and goes on while the dictionary says so, once as far as
``LONGEST`` and once as far as ``CAPPED`` characters.  Where it ends depends on its own characters alone, so an edit
outside a gram leaves it as it is, at most one place further on.

**Bounds.** An edit affects only the grams that cover its place.  For a set of a word's grams the most that any one place covers is
its bound.  A word asks for its rarest grams, as few as keep the bound below their number: of these a word one edit away
still has ``number - bound`` at least (five characters and grams of at most four always suffice).  Each asked gram names a
list: the words of a fitting length that have it at a fitting place.  Lists are merged by counting, verified, and those that reach
``number - bound`` are kept.  Each pair is asked for by its shorter word, or by both of equally long ones.

Forms and roots follow.  A form is at least twice as frequent, so chains are no longer than the logarithm of the largest
count; they are followed by pointer doubling.

Defined cases: a null text has no words; a null id counts as an empty one in the digest; repeated rows count as often as
they occur; a run that loses its only character is no word; a table without rows gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import cut, fresh_worker, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many (document, run) loses a character.
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
SHORTEST, CAPPED, LONGEST = 2, 4, 7
#: A gram is extended if it has more places than this, and than this share of all places.
LEAST_FREQUENT, MOST_GRAMS = 32, 50_000
#: A form is so many times as frequent.
TIMES = 2
#: Different words that a task remembers before it hands their counts on.
REMEMBERED = 200_000
BEGIN, END = "^", "$"

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def damaged(doc_id: object, run: str, damage: int = DAMAGED) -> str:
    """The run as a document has it: one in ``damage`` lacks a code point, chosen by the digest."""
    digest = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if digest % damage:
        return run
    at = digest % len(run)
    return run[:at] + run[at + 1 :]


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGED) -> DataFrame:
    """word, n: all words of the documents that are long and frequent enough."""
    told = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        found: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            part = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return part

        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                for doc_id, text in zip(ids, texts.to_pylist(), strict=True):
                    for run, n in Counter(RUN.findall(text.translate(_LOWER))).items():
                        if len(run) >= least_length and len(word := damaged(doc_id, run, damage)) >= least_length:
                            found[word] += n
                if len(found) > REMEMBERED:
                    yield handed()
        if found:
            yield handed()

    return told.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame, least: int = LEAST_FREQUENT, most: int = MOST_GRAMS) -> dict[str, int]:
    """The frequent grams and the number of their places; at most ``most`` of each length."""
    marked = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("w"))
    places = marked.agg(F.coalesce(F.sum(F.length("w")), F.lit(0))).first()[0]
    ends = F.sequence(F.lit(SHORTEST), F.lit(LONGEST))
    at = marked.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - (SHORTEST - 1))).alias("at"))
    grams = at.select("w", "at", F.explode(ends).alias("size")).where(F.col("at") + F.col("size") - 1 <= F.length("w"))
    counts = grams.select(F.substr("w", F.col("at"), F.col("size")).alias("gram")).groupBy("gram").count()
    return {r["gram"]: r["count"] for r in counts.where(F.col("count") > max(least, places // most)).collect()}


def decomposed(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """Place and text of a word's grams, those of both longest lengths."""
    marked, found = BEGIN + word + END, []
    for at in range(len(marked) - SHORTEST + 1):
        size = SHORTEST
        while size < CAPPED and at + size < len(marked) and marked[at : at + size] in frequent:
            size += 1
        found.append((at, marked[at : at + size]))
        if size == CAPPED:
            while size < LONGEST and at + size < len(marked) and marked[at : at + size] in frequent:
                size += 1
            if size > CAPPED:
                found.append((at, marked[at : at + size]))
    return found


def affected(grams: list[tuple[int, str]], length: int) -> int:
    """The most grams that one edit of a word of this length can affect: those that cover its place."""
    cover = [0] * (length + 2)
    for at, gram in grams:
        for place in range(at, at + len(gram)):
            cover[place] += 1
    return max(cover[1 : length + 1])


def asked(grams: list[tuple[int, str]], frequent: dict[str, int], length: int) -> tuple[set[int], int]:
    """Which grams a word asks for, and how many of them a word one edit away has at least.

    The rarest until an edit can't affect all of them; then those are left out, most frequent first, that the rest can
    do without.
    """
    ranked = sorted(range(len(grams)), key=lambda k: (frequent.get(grams[k][1], 0), -len(grams[k][1]), k))
    chosen: list[int] = []
    bound = lambda ks: affected([grams[k] for k in ks], length)
    for k in ranked:
        chosen.append(k)
        if bound(chosen) < len(chosen):
            break
    for k in chosen[-2::-1]:
        if bound(fewer := [c for c in chosen if c != k]) < len(fewer):
            chosen = fewer
    return set(chosen), len(chosen) - bound(chosen)


def gram_index(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """word, n, length, gram, at, need (null: the word doesn't ask for this gram)."""
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        known = shared.value
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                rows: list[tuple] = []
                for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    grams = decomposed(word, known)
                    ask, need = asked(grams, known, len(word))
                    rows += [(word, n, len(word), gram, at, need if k in ask else None) for k, (at, gram) in enumerate(grams)]
                types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["word", "n", "length", "gram", "at", "need"])

    return words.select("word", "n").mapInArrow(index, "word string, n long, length int, gram string, at int, need int")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: all pairs of words exactly one edit apart, both ways."""
    index = cut(gram_index(words, gram_dictionary(words)))
    lists = index.select("gram", F.col("length"), "at", F.col("word").alias("other"), F.col("n").alias("other_n"))
    fits = lambda longer, further: F.struct((F.col("length") + longer).alias("length"), (F.col("at") + further).alias("at"))
    asking = index.where("need IS NOT NULL").select("word", "n", "gram", "need", F.inline(F.array(fits(0, 0), fits(1, 0), fits(1, 1))))
    met = asking.join(lists, ["gram", "length", "at"]).where("word <> other AND (length(word) < length(other) OR word < other)")
    verified = met.where(F.levenshtein("word", "other", 1) == 1)
    merged = verified.groupBy("word", "n", "other", "other_n").agg(F.count("*").alias("lists"), F.max("need").alias("need")).where("lists >= need")
    ways = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return merged.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: the last of each chain of forms."""
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGED) -> DataFrame:
    """word, n, form, form_n, root, n_near of every word of the documents."""
    words = cut(words_of(docs, least_length, least_count, damage))
    near = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    fits = -F.col("best.less") >= TIMES * F.col("n")
    told = cut(near.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    whole = words.join(told, "word", "left").join(roots(told.where("form IS NOT NULL")), "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
