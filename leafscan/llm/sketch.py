"""Document fingerprints: threshold-scaled sketches of word shingles, by Spark expressions alone.

A sketch keeps every distinct shingle hash below a fixed fraction of all hashes, whatever the document's length, and
the smallest hash of all.  Two sketches are samples by the same rule, so likeness and containment are estimated without bias
between very unequal documents, and sketches of parts merge into exactly the sketch of the whole (union and minimum).
Of a short document no hash may lie below the threshold.  Its sketch is then empty; where both are, the smallest hashes
decide (they agree with a chance of just the likeness, and always for equal texts).

The edited texts need each document's next one by id.  The ids alone are sorted over the cluster, every so many
documents give a bound, and a row finds its range among the bounds by bisection.  A range is one window partition, and the
highest document of each is also sent, as a guest, to the range above: one shuffle of the texts, none of them in one
task.  A bound takes 16 bytes; there are ``MOST_RANGES`` at most.

Defined cases: a null text counts as empty; a text without words has an empty sketch without a smallest hash; one of
fewer words than a shingle is one shingle; two texts without words are alike (1.0), one without and another are not
(0.0); documents of one id follow each other by their texts' hash, highest first; null ids come last; other columns are left
out.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: One in so many hashes is kept.
SCALE = 4
#: Documents of a range, more where there would be more ranges than that, and ids of a partition when they are sorted.
RANGE_DOCS, MOST_RANGES, SORTED_IDS = 5_000, 250_000, 1_000_000
_LOWEST = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles of a text's lower-cased words, repeats included."""
    found = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(
        found,
        lambda ws: F.when(F.size(ws) == 0, F.expr("array()").cast("array<bigint>"))
        .when(F.size(ws) <= words, F.array(F.xxhash64(ws)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(ws) - (words - 1)), lambda i: F.xxhash64(F.slice(ws, i, words)))),
    )


def sketch(text: Column, words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """A text's sketch: struct(hashes: sorted array of long, least: long)."""
    threshold = F.lit(min(_LOWEST + (1 << 64) // scale, (1 << 63) - 1))
    return let(
        shingle_hashes(text, words),
        lambda hs: F.struct(F.sort_array(F.array_distinct(F.filter(hs, lambda h: h < threshold))).alias("hashes"), F.array_min(hs).alias("least")),
    )


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together, from their sketches."""
    return F.struct(F.sort_array(F.array_union(a["hashes"], b["hashes"])).alias("hashes"), F.least(a["least"], b["least"]).alias("least"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles in all shingles of two sketched documents."""
    common = let(F.size(F.array_intersect(a["hashes"], b["hashes"])), lambda c: c / (F.size(a["hashes"]) + F.size(b["hashes"]) - c))
    return F.when(F.size(a["hashes"]) + F.size(b["hashes"]) == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(common)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second has too.

    A document without words is contained in every other (1.0).  One with an empty sketch is in a document of the same
    smallest hash (1.0); otherwise nothing is known (null).
    """
    common = F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.size(a["hashes"])
    return F.when(F.size(a["hashes"]) > 0, common).when(a["least"].isNull() | (a["least"] == b["least"]), F.lit(1.0))


def fingerprint(sketched: Column) -> Column:
    """A sketch as a string: its hashes, 16 hex digits each; of an empty one the smallest hash, if there is one."""
    shown = F.when(F.size(sketched["hashes"]) > 0, sketched["hashes"]).otherwise(F.array_compact(F.array(sketched["least"])))
    return F.lower(F.array_join(F.transform(shown, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _bounds(keys: DataFrame, range_docs: int, sorted_ids: int) -> list[tuple[int | None, int]]:
    """The highest (doc_id, tie) of every range, ascending; each is that of a row.

    A range has ``range_docs`` rows at most, or fewer where that would leave cores idle, and ends where a sorted partition ends.
    """
    highest = keys.agg(F.max(F.struct("doc_id", "tie")).alias("h"), F.count("*").alias("n")).first()
    if not highest["n"]:
        return []
    at_once = 2 * keys.sparkSession.sparkContext.defaultParallelism
    range_docs = max(min(range_docs, -(-highest["n"] // at_once)), highest["n"] // MOST_RANGES, 1)
    spread = keys.repartitionByRange(-(-highest["n"] // sorted_ids), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    number = F.monotonically_increasing_id()
    block = F.floor(number.bitwiseAND((1 << 33) - 1) / range_docs)
    blocks = spread.select("doc_id", "tie", F.shiftright(number, 33).alias("part"), block.alias("block")).groupBy("part", "block")
    some = blocks.agg(F.max(F.struct("doc_id", "tie")).alias("h")).select("h.*").collect()
    found = {(r["doc_id"], r["tie"]) for r in some}
    return sorted(found, key=lambda b: (b[0] is not None, b[0] or 0, b[1]))


def with_next(docs: DataFrame, carried: dict[str, Column], range_docs: int = RANGE_DOCS, sorted_ids: int = SORTED_IDS) -> DataFrame:
    """doc_id, text and the carried columns of every document, and next_<name> of each from the next one.

    Next by descending id; after the last comes the first.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    bounds = _bounds(own.select("doc_id", "tie"), range_docs, sorted_ids)
    listed = F.from_json(F.lit(json.dumps([{"doc_id": i, "tie": t} for i, t in bounds])), "array<struct<doc_id:bigint,tie:bigint>>")
    key = F.struct("doc_id", "tie")
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length(), -1, -1)])
    # How many bounds are lower, by bisection.
    number = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(listed, low + step - 1) < key, low + step).otherwise(low))
    placed = own.withColumn("range", number)
    above = F.pmod(F.col("range") + 1, F.lit(max(len(bounds), 1)))
    at = lambda where, guest: F.struct(where.alias("at"), F.lit(guest).alias("guest"))
    twice = F.when(F.get(listed, F.col("range")) == key, F.array(at(F.col("range"), False), at(above, True))).otherwise(F.array(at(F.col("range"), False)))
    placed = placed.select("doc_id", "text", "tie", twice.alias("places"), *[c.alias(n) for n, c in carried.items()])
    everyone = placed.select("doc_id", "text", "tie", *carried, F.inline("places")).repartitionById(max(len(bounds), 1), "at")
    then = Window.partitionBy("at").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("tie"), "text")
    names = ["text", *carried]
    ahead = everyone.select("*", *[F.lead(n).over(then).alias(f"next_{n}") for n in names])
    return ahead.where(~F.col("guest")).select("doc_id", *names, *[f"next_{n}" for n in names])


def edited(docs: DataFrame, range_docs: int = RANGE_DOCS, sorted_ids: int = SORTED_IDS) -> DataFrame:
    """Every document with its sketch, its edited text's, and the next document's sketch.

    The edited text has the last third of the code points replaced by the first as many (or all) of the next.
    """
    found = with_next(docs, {"sketch": sketch(F.col("text"))}, range_docs, sorted_ids)
    third = F.floor(F.length("text") / 3).cast("int")
    changed = F.concat(F.substr("text", F.lit(1), F.length("text") - third), F.substr("next_text", F.lit(1), third))
    found = found.select("doc_id", "text", "sketch", "next_sketch", changed.alias("edited"))
    return found.withColumn("edited_sketch", sketch(F.col("edited")))
