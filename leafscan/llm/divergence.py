"""Source divergence audit: how far sources of a language differ in their use of terms, by one-hot level products.

``documents`` -> terms are counted by (lang, source) in one pass over the texts; a language keeps the terms of at least
``LEAST_DOCS`` of its documents.  A group's count of a term is its *level*; a group prices a level, p(level), in whole
billionths.  The distance of two groups is the sum of |p - q| over all kept terms.

**One-hot level products.** For a block of terms, a group has one indicator column for each level that occurs in the block,
level 0 included.  The transposed columns of one group times those of others are their joint tables: how many
terms are at level a here and at level b there.  A table's cells times |p(a) - p(b)|, summed, are the distance over the
block; blocks add up.  The products are of 0s and 1s over ``BLOCK_TERMS`` rows and so exact in floating point; prices and
sums are whole 64-bit numbers.  A task holds the columns of ``BLOCK_SOURCES`` sources twice, whatever the number of terms,
sources or levels; a language's terms and a source's rows are spread over as many tasks as there are blocks.

Terms of a pair of source blocks in which none of them has the term aren't sent: their number is known, and they add to
the cell of both zero levels.

Defined cases: null text, lang and source count as ''; groups without kept terms have rows (all levels 0); a language
without kept terms has distances 0 and no ``term`` rows; a language of one source has no ``pair`` rows; repeated rows count as
often as they occur; a table without rows gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.llm.common import cut, fresh_worker, slices

LEAST_DOCS = 30
#: Prices are whole parts of this, after so many occurrences are added to each term.
UNIT, ADDED = 1_000_000_000, 5
#: A group's terms are reported up to this rank.
TOP_TERMS = 50
#: Terms of a block, and sources of a block, about.
BLOCK_TERMS, BLOCK_SOURCES = 512, 16
#: Different (lang, source, term) that a task remembers before it hands their counts on.
REMEMBERED = 100_000

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, lower-cased, and of all that isn't ASCII."""
    return text.translate(_LETTERS).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); each group has a row of the term '' too."""
    told = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def handed(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in found.items():
            terms = [b"", *n]
            columns = [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *(in_docs[t] for t in n)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        found.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            at = 0
            for texts in slices(batch.column(0), 1 << 20):
                part = batch.slice(at, len(texts))
                at += len(texts)
                for text, lang, source in zip(texts.cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    terms, (n, in_docs) = terms_of(text), found[lang, source]
                    n.update(terms)
                    in_docs.update(set(terms))
                if sum(len(n) for n, _ in found.values()) > REMEMBERED:
                    yield from handed(found)
        yield from handed(found)

    parts = told.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column, words: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (words + ADDED * kept)), in whole numbers of any size."""
    whole = lambda c: c.cast("decimal(19,0)")
    share = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * whole(n + ADDED), whole(words + ADDED * kept))
    return F.when(kept > 0, share + 1).otherwise(F.lit(0)).cast("long")


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Two tables: the kept terms' counts, and the groups.

    Counts: lang, source, term, n, lang_n.  Groups: lang, source, words (of kept terms), lang_words, kept, sources.
    """
    every = cut(counted(docs))
    kept = every.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least_docs).drop("in_docs")
    counts = cut(every.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    words = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    langs = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_words"))
    groups = every.where("term = ''").select("lang", "source")
    many = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    whole = groups.join(words, ["lang", "source"], "left").join(langs, "lang", "left").join(many, "lang")
    return counts, cut(whole.na.fill(0, ["words", "lang_words", "kept"]), 0)


def term_rows(counts: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The terms that a group uses more than its language does, the largest differences first."""
    p, q = price(F.col("n"), F.col("words"), F.col("kept")), price(F.col("lang_n"), F.col("lang_words"), F.col("kept"))
    over = counts.where("n > 0").join(groups, ["lang", "source"]).withColumn("value", p - q).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return over.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _indicators(rows: np.ndarray, columns: np.ndarray, zeros: np.ndarray, begins: np.ndarray, n_rows: int, n_columns: int) -> np.ndarray:
    """One-hot columns of 0s and 1s; a source's zero level is where none of its others is."""
    hot = np.zeros((n_rows, n_columns), np.float32)
    hot[rows, columns] = 1
    hot[:, zeros] = 1 - np.add.reduceat(hot, begins, axis=1)
    return hot


def _block_distances(table: pa.Table) -> tuple[list[str], list[str], list[int]]:
    """Pairs of sources and their distances over one block of terms.

    Rows with a term are levels above 0; one row of each source, without a term, gives its price of level 0.
    """
    source, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    side_i, side_j = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("in_i", "in_j"))
    level, cost = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "price"))
    names, group = source.dictionary.to_pylist(), source.indices.to_numpy().astype(np.int64)
    here = term.indices.is_valid().to_numpy(zero_copy_only=False)
    row = term.indices.fill_null(0).to_numpy().astype(np.int64)
    seen = len(term.dictionary)
    unseen = int(table.column("terms")[0].as_py()) - seen
    # Columns: the levels of every source in turn, level 0 first.
    order = np.lexsort((level, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (level[order][1:] != level[order][:-1])
    column = np.empty(len(order), np.int64)
    column[order] = np.cumsum(new) - 1
    col_group, col_cost, col_zero = group[order][new], cost[order][new], level[order][new] == 0
    begins = np.flatnonzero(np.r_[True, col_group[1:] != col_group[:-1]])
    hot = _indicators(row[here], column[here], np.flatnonzero(col_zero), begins, max(seen, 1), len(col_group))
    hot[seen:] = 0
    of = {g: (a, b) for g, a, b in zip(col_group[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(col_group)], strict=True)}
    left, right = sorted(set(group[side_i].tolist())), sorted(set(group[side_j].tolist()))
    inside = left == right
    out: tuple[list[str], list[str], list[int]] = ([], [], [])
    for g in left:
        a, b = of[g]
        others = [h for h in right if not inside or h > g]
        if not others:
            continue
        cols = np.concatenate([np.arange(*of[h]) for h in others])
        joint = (hot[:, a:b].T @ hot[:, cols]).astype(np.int64)
        joint[np.ix_(col_zero[a:b], col_zero[cols])] += unseen
        priced = (joint * np.abs(col_cost[a:b, None] - col_cost[None, cols])).sum(axis=0)
        sizes = [of[h][1] - of[h][0] for h in others]
        sums = np.add.reduceat(priced, np.r_[0, np.cumsum(sizes)[:-1]])
        out[0].extend([names[g]] * len(others))
        out[1].extend(names[h] for h in others)
        out[2].extend(sums.tolist())
    return out


def pair_rows(counts: DataFrame, groups: DataFrame, block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """Distances of all pairs of sources of a language, from the joint tables of their levels."""
    term_blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / block_terms)).cast("int")
    source_blocks = F.ceil(F.col("sources") / block_sources).cast("int")
    blocked = groups.select("*", term_blocks.alias("term_blocks"), source_blocks.alias("source_blocks"), F.pmod(F.xxhash64("source"), source_blocks).cast("int").alias("own"))
    sized = lambda n: price(n, F.col("words"), F.col("kept")).alias("price")
    block = lambda term: F.pmod(F.xxhash64(term), F.col("term_blocks")).cast("int")
    levels = counts.where("n > 0").join(blocked, ["lang", "source"])
    levels = levels.select("lang", block(F.col("term")).alias("block"), "source", "own", "source_blocks", "term", "n", sized(F.col("n")), F.lit(None).cast("long").alias("terms"))
    terms = counts.select("lang", "term").distinct().join(blocked.select("lang", "term_blocks").distinct(), "lang").groupBy("lang", block(F.col("term")).alias("block")).agg(F.count("*").alias("terms"))
    zeros = blocked.select("*", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("block")).join(terms, ["lang", "block"], "left")
    zeros = zeros.select("lang", "block", "source", "own", "source_blocks", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), sized(F.lit(0)), F.coalesce("terms", F.lit(0)).alias("terms"))
    both = zeros.unionByName(levels).select("*", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)).alias("other"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    sent = both.select("lang", "block", i.alias("i"), j.alias("j"), (F.col("own") == i).alias("in_i"), (F.col("own") == j).alias("in_j"), "source", "term", "n", "price", "terms")

    def distances(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b, value = _block_distances(table.sort_by([("terms", "descending")]))  # known ones first
        return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])

    found = sent.groupBy("lang", "block", "i", "j").applyInArrow(distances, "lang string, a string, b string, value long")
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    listed = summed.select("lang", "value", F.inline(ways))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return listed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts, groups = kept_counts(docs, least_docs)
    return pair_rows(counts, groups).unionByName(term_rows(counts, groups, top))
