"""Preference formatting of conversations, by Spark expressions alone.

Each pair has a chosen and a rejected conversation.  The turns that both begin with are rendered once, as the prompt; the
turns after them are rendered as two completions, masked so that only replies are learned: of every rendered
turn, ``learn_from`` and ``learn_to`` are the characters that count (both 0: none).

Turns of both sides meet by grouping on (pair, turn, role, text) with how often each side has them, the first turn that
they have differently ends the prompt (a minimum for each pair), and nothing else needs a pair's rows together.
``assembled`` then joins the turns of a pair into its prompt and two completions, one row a pair, whatever its turns are
numbered.  Only where ``piece_chars`` is given, pairs with more characters than that come in several rows.

Defined cases: a null role is ``unknown``, a null text empty, a null turn comes before all others; rows that repeat a turn
of one side are rendered as often as they occur; several texts of one turn follow in the order of role and text; a row
without an id belongs to no other row's conversation, so each such turn, role and text is a pair of its own; marks
inside texts are broken up, so no text can forge a turn; a pair whose sides are equal is all prompt; other columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .mixing import before

#: Fixed values of the chat template.
BEGIN, END = "<|im_start|>", "<|im_end|>"
REPLY = "assistant"
#: Equal rows of a turn that are unfolded from one row at a time.
COPIES = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the defined values for nulls."""
    return conversations.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: pair_id, side, turn, role, text.

    Chosen is the conversation itself; rejected is the same with its last reply replaced by the last reply of the
    conversation whose id differs in the lowest bit (without such a partner or a reply the sides are equal).
    """
    turns = turns_of(conversations)
    last = turns.where((F.col("role") == REPLY) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    partner = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("reply"))
    known = last.join(partner, "conv_id", "left").select(F.col("conv_id").alias("of"), "last", "reply")
    both = turns.join(known, F.col("conv_id") == F.col("of"), "left")
    is_last = (F.col("role") == REPLY) & (F.struct("turn", "text") == F.col("last")) & F.col("reply").isNotNull()
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
        F.struct(F.lit("rejected").alias("side"), F.when(is_last, F.col("reply")).otherwise(F.col("text")).alias("text")),
    )
    return both.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.inline(sides))


def rendered(role: Column, text: Column) -> Column:
    """A turn in the chat template."""
    plain = lambda value: F.replace(value, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(BEGIN), plain(role), F.lit("\n"), plain(text), F.lit(END + "\n"))


def formatted(pairs: DataFrame) -> DataFrame:
    """pair, pair_id, part (prompt, chosen or rejected), turn, role, rendered, copy, learn_from, learn_to.

    One row for each turn of a part, equal rows included (``copy`` counts them from 0).  ``pair`` is what a pair's rows have in
    common: made of its id, or of the turn where it has none.  ``pairs``: pair_id, side (chosen or rejected), turn, role, text.
    """
    on = lambda side: F.count(F.when(F.col("side") == side, F.lit(1)))
    counted = pairs.groupBy("pair_id", "turn", "role", "text").agg(on("chosen").alias("chosen"), on("rejected").alias("rejected"))
    alone = F.sha2(F.to_json(F.struct("turn", "role", "text")), 256)
    turns = counted.withColumn("pair", F.coalesce(F.concat(F.lit("+"), F.col("pair_id").cast("string")), alone))
    differs = turns.where(F.col("chosen") != F.col("rejected")).groupBy("pair").agg(F.min("turn").alias("first"))
    known = turns.join(differs, "pair", "left")
    shared = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    part = lambda name, copies: F.struct(F.lit(name).alias("part"), F.col(copies).alias("copies"))
    parts = F.when(shared, F.array(part("prompt", "chosen"))).otherwise(F.array(part("chosen", "chosen"), part("rejected", "rejected")))
    rows = known.select("pair", "pair_id", F.inline(parts), "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered")).where("copies > 0")
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + COPIES, F.col("copies")) - 1)))
    learned = (F.col("role") == REPLY) & (F.col("part") != "prompt")
    return rows.select(
        "pair",
        "pair_id",
        "part",
        "turn",
        "role",
        "rendered",
        "copy",
        F.when(learned, F.instr("rendered", "\n")).otherwise(F.lit(0)).cast("int").alias("learn_from"),
        F.when(learned, F.length("rendered") - 1).otherwise(F.lit(0)).cast("int").alias("learn_to"),
    )


def in_pieces(segments: DataFrame, piece_chars: int) -> DataFrame:
    """Segments with the characters of their part before them (start) and their piece, ``start`` by ``piece_chars``.

    Running sums over ranges of rows: a pair's turns may lie in any number of tasks.
    """
    order = ("turn", "role", "rendered", "copy")
    ranged = cut(segments.repartitionByRange("pair", "part", *order).withColumn("chunk", F.spark_partition_id()))
    placed = before(ranged, ["pair", "part"], list(order), F.length("rendered").cast("long"), "start").drop("chunk")
    return placed.withColumn("piece", F.floor(F.col("start") / piece_chars).cast("long"))


def assembled(segments: DataFrame, piece_chars: int | None = None) -> DataFrame:
    """pair_id, piece, prompt, chosen, rejected, and the spans (from, to) of each completion that are learned.

    One row for each pair, which so has to fit a row.  With ``piece_chars``, a turn whose part has n characters before it goes to piece n / ``piece_chars``
    instead, and each piece is a row: put together in their order they are the parts of the whole
    pair, and spans count from the beginning of the whole part.
    """
    placed = segments.withColumns({"start": F.lit(0).cast("long"), "piece": F.lit(0).cast("long")}) if piece_chars is None else in_pieces(segments, piece_chars)
    own = F.struct("turn", "role", "rendered", "copy", "learn_from", "learn_to", "start")
    names = ("prompt", "chosen", "rejected")
    listed = [F.array_sort(F.collect_list(F.when(F.col("part") == p, own))).alias(p) for p in names]
    held = placed.groupBy("pair", "piece").agg(F.max("pair_id").alias("pair_id"), *listed)
    span = lambda at, s: F.struct((at + s["learn_from"]).alias("from"), (at + s["learn_to"]).alias("to"))
    step = lambda done, s: F.struct(
        (done["at"] + F.length(s["rendered"])).alias("at"),
        F.when(s["learn_to"] > 0, F.array_append(done["spans"], span(done["at"], s))).otherwise(done["spans"]).alias("spans"),
    )
    none = F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)")

    def spans(p: str) -> Column:
        first = F.struct(F.coalesce(F.get(p, F.lit(0))["start"], F.lit(0).cast("long")).alias("at"), none.alias("spans"))
        return F.aggregate(p, first, step, lambda done: done["spans"]).alias(f"{p}_spans")

    text = lambda p: F.array_join(F.transform(p, lambda s: s["rendered"]), "").alias(p)
    return held.select("pair_id", "piece", *[text(p) for p in names], spans("chosen"), spans("rejected"))
