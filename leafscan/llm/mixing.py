"""Mixing sources to target weights: a low-discrepancy schedule of slots, each filled with a block of its source.

**Targets.** Sources take weights in turn; each gets its share of all words, but ``EPOCHS`` times its own at most, and
what is over goes to the others by weight until none is above.  All of it is done in whole numbers (the level is a
fraction), with one aggregate of the source table a round.

**Schedule.** The targets, one after another, make an axis of words, cut into cells of ``BLOCK_WORDS``.  Slot i of the mix
looks at the cell that the i-th van der Corput point names (the bits of i in reverse), so every stretch of slots holds
every source in proportion.  A cell belongs to each source whose part of the axis it touches; over all slots that is a
block more than a source needs at most, never one less.

**Blocks.** Each source's documents stand in a shuffled order (by a digest of epoch and id), once for each epoch it needs,
as one stream of words, cut into equal blocks; the stream ends at the target.  The k-th slot of a source takes its k-th
block.  So a source's taken words are its target, rounded down, and no document is taken more than ``EPOCHS`` times.

Places in a stream and ranks of slots are sums before a row.  They are made in two steps, within chunks and over
the chunks' sums, so that no source is gathered in one task, however large.  The points are counted numbers and the order
a digest, so reruns agree.

Defined cases: a null text has size 0; documents of size 0 are never in a block (taken 0); null is a source of its own, the
last; rows equal in id, source and text follow each other in the stream; a null id counts as an empty one in the digest;
without words all targets are 0; a table without rows gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.llm.common import cut, merged_like
from leafscan.plans.shared import globally_ranked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: A document is taken so many times at most.
EPOCHS = 3
BLOCK_WORDS = 1024
#: Shares into which a source's documents are dealt where they meet its targets.
SALTS = 64
#: Rows of a chunk of a running sum, about.
CHUNK_ROWS = 1 << 14


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest of the text and number of copies: equal rows are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    return merged_like(own, docs).groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("copies"))


def _above(num: int, den: int) -> Column:
    """Whether a source's share at the level num / den is over the most it may give."""
    exact = lambda c: c.cast("decimal(19,0)")
    return exact(F.col("most")) * exact(F.lit(den)) < exact(F.col("weight")) * exact(F.lit(num))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, weight, target (double), budget (target in whole words), first (budgets before it) from source, source_size."""
    order = (F.col("source").isNull(), F.col("source"))
    ranked = globally_ranked(sizes, *order, name="at")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = cut(ranked.withColumns({"weight": weight.cast("long"), "most": F.col("source_size") * epochs}), 0)
    words, parts = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    num, den = words, parts
    while den:
        full = placed.where(_above(num, den)).agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (num, den) == (words - full[0], parts - full[1]):
            break
        num, den = words - full[0], parts - full[1]
    share = lambda value: F.element_at(F.array(*[F.lit(value(w)) for w in sorted(set(weights))]), F.array_position(F.array(*[F.lit(w).cast("long") for w in sorted(set(weights))]), F.col("weight")).cast("int"))
    above = _above(num, den)
    whole = F.when(above, F.col("most")).otherwise(share(lambda w: w * num // max(den, 1)).cast("long"))
    exact = F.when(above, F.col("most").cast("double")).otherwise(share(lambda w: float(w * num / max(den, 1))))
    known = placed.select("source", "source_size", "weight", "at", exact.alias("target"), whole.alias("budget"))
    return before(known.withColumn("chunk", F.floor(F.col("at") / CHUNK_ROWS)), [], ["at"], F.col("budget"), "first").drop("at", "chunk")


def before(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the rows before each, by key, in the order of the column ``chunk`` and then ``order``.

    Chunks are summed first; a task orders the rows of one chunk, or the chunks of one key.
    """
    valued = rows.withColumn("_v", value)
    sums = valued.groupBy(*keys, "chunk").agg(F.sum("_v").alias("_s"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "chunk", F.coalesce(F.sum("_s").over(earlier(Window.partitionBy(*keys).orderBy("chunk"))), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("_v").over(earlier(Window.partitionBy(*keys, "chunk").orderBy(*order))), F.lit(0))
    return valued.withColumn("_within", within).join(bases, [*keys, "chunk"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_v", "_within", "_base")


def _key(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("+"), source), F.lit(""))


def spans(units: DataFrame, known: DataFrame, rows: int, block: int = BLOCK_WORDS) -> DataFrame:
    """Every document's stretches of its source's blocks; a document without any keeps a row with a null block.

    Columns key, block, doc_id, source, size, text_hash, copy, source_size, target, begins (word of the document), words, at
    (word of the block).
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    stats = known.select(_key(F.col("source")).alias("key"), "source_size", "target", "budget", salts)
    chunks = max(1, rows // CHUNK_ROWS)
    epochs = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1))))
    dealt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")
    told = units.withColumns({"key": _key(F.col("source")), "salt": dealt}).join(stats, ["key", "salt"]).drop("salt")
    told = told.select("*", F.explode(F.sequence(F.lit(0).cast("long"), epochs.cast("long") - 1)).alias("epoch"))
    told = told.withColumn("order", F.md5(F.concat(F.col("epoch").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    told = told.withColumn("chunk", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * chunks / (1 << 32)))
    placed = before(told, ["key", "epoch"], ["order", "doc_id", "size", "text_hash"], F.col("size") * F.col("copies"), "start")
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    place = F.col("epoch") * F.col("source_size") + F.col("start") + F.col("copy") * F.col("size")
    placed = placed.withColumn("place", place).withColumn("end", F.least(F.col("place") + F.col("size"), F.col("budget")))
    blocks = F.when(F.col("end") > F.col("place"), F.sequence(F.floor(F.col("place") / block), F.floor((F.col("end") - 1) / block)))
    cut_up = placed.select("*", F.explode_outer(blocks).alias("block"))
    low, high = F.greatest(F.col("place"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    return cut_up.select("key", "block", "doc_id", "source", "size", "text_hash", "copy", "source_size", "target", (low - F.col("place")).alias("begins"), (high - low).alias("words"), (low - F.col("block") * block).alias("at"))


def reversed_bits(number: Column, bits: int) -> Column:
    """The lowest bits of a whole number in reverse order: the van der Corput point, times 2 ** bits."""
    for step, low in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        mask = F.lit(low)
        number = F.shiftleft(number.bitwiseAND(mask), step).bitwiseOR(F.shiftrightunsigned(number, step).bitwiseAND(mask))
    return F.shiftrightunsigned(number, 64 - bits)


def slots(known: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, key, source, block: the slots of the mix in their order, each with its source's next block."""
    words = known.agg(F.coalesce(F.sum("budget"), F.lit(0))).first()[0]
    cells = -(-words // block)
    bits = max(2, cells.bit_length())
    coarse = max(0, bits - 10)
    first, last = F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("budget") - 1) / block)
    parts = known.where("budget > 0").select("source", first.alias("from_cell"), last.alias("to_cell"))
    parts = parts.select("*", F.explode(F.sequence(F.shiftright("from_cell", coarse), F.shiftright("to_cell", coarse))).alias("part"))
    points = known.sparkSession.range(1 << bits).select(F.col("id").alias("slot"), reversed_bits(F.col("id"), bits).alias("cell")).where(F.col("cell") < cells)
    named = points.withColumn("part", F.shiftright("cell", coarse)).join(parts, "part").where("cell BETWEEN from_cell AND to_cell")
    named = named.select("slot", _key(F.col("source")).alias("key"), "source", F.shiftright("slot", bits // 2).alias("chunk"))
    return before(named, ["key"], ["slot"], F.lit(1).cast("long"), "block").drop("chunk")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix: ``spans`` of all documents, each with the slot that takes it (null: no slot does)."""
    units = cut(sized(docs))
    counted = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
    known = cut(targets(counted, weights, epochs), 0)
    return spans(units, known, units.count(), block).join(slots(known, block).select("slot", "key", "block"), ["key", "block"], "left")


def taken(mix: DataFrame) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (words of it in the mix)."""
    whole = mix.groupBy("doc_id", "source", "size", "text_hash", "copy", "source_size", "target")
    words = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).cast("long")
    return whole.agg(words.alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def texts(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """slot, source, text: what each slot holds, words joined by spaces, in the order of the source's block."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"), text.alias("_text")).distinct()
    used = mix.where("slot IS NOT NULL")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("text_hash") == F.xxhash64("_text"))
    said = F.slice(F.regexp_extract_all("_text", F.lit(f"({WORD})"), 1), (F.col("begins") + 1).cast("int"), F.col("words").cast("int"))
    cut_out = used.join(own, same).select("slot", "source", "at", F.array_join(said, " ").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "part")))
    return cut_out.groupBy("slot", "source").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), " ").alias("text"))
