"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2h bits have a common variant within h bits of both.  So every distinct
fingerprint emits all its variants within half the radius, equal variants meet in a shuffle, and those that meet
are linked (a common variant within h bits of both proves at most 2h bits; each linked pair is verified besides).

Variants of a fingerprint differ little, so the shuffle does not write them one by one.  It deals them out by
their first bits: a fingerprint is sent once to each prefix that its variants can have (a few dozen), and the
task of a prefix makes the variants that begin with it, deduplicates them and links what meets, members in a
row rather than in all pairs.  The number of prefixes grows with the fingerprints; a prefix that many share is
split further by a hash of the variants.  What meets inside a prefix leaves as stars of its local components, and
components over all prefixes come from alternating large-star and small-star rounds, each with its own
checkpoint.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text of fewer words than
a shingle is one shingle; repeated rows stay and share a component; a component is named by its smallest non-null
doc_id; other columns are left out; a table without rows gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafscan.llm.common import cut, fresh_worker, merged_like, shuffles_freed, slices

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Characters of texts whose shingles are made at once, about.
SLICE_BYTES = 1 << 20
#: Fingerprints for which a prefix is made, about, and variants that a group may hold before it is split.
PREFIX_FINGERPRINTS = 1500
GROUP_VARIANTS = 6_000_000


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text's words (A-Z lower-cased), repeats included."""
    joined = b" ".join(text.encode().lower().split()) if text else b""
    if not joined:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    size, digest = min(words, len(starts)), xxhash.xxh64_intdigest
    ends = ends[size - 1 :]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is one if more than half of the hashes have it; no hashes: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED, distinct: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every whole text; ``distinct`` counts repeated shingles once."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (shingle_hashes(text.as_py(), words, seed) for text in batch.column(1))
            fps = np.fromiter((fingerprint(np.unique(h) if distinct else h) for h in found), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(hashed, "doc_id long, fp long")


def masks(bits: int, most: int) -> list[int]:
    """All masks over the lowest ``bits`` bits with at most ``most`` ones."""
    return [sum(1 << b for b in some) for n in range(most + 1) for some in itertools.combinations(range(bits), n)]


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (jumped := root[root]).tolist() != root.tolist():
            root = jumped
        if (root == before).all():
            return root


def _slot(values: np.ndarray, bits: int) -> np.ndarray:
    """A well-mixed hash of variants."""
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def meetings(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of owners of equal values: neighbours in a row, each pair once."""
    ordered = np.sort(values)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(repeated):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[_slot(repeated, 20)] = True
    some = np.flatnonzero(seen[_slot(values, 20)])
    some = some[np.argsort(values[some], kind="stable")]
    same = values[some[1:]] == values[some[:-1]]
    a, b = owners[some[:-1][same]], owners[some[1:][same]]
    codes = np.unique(np.minimum(a, b).astype(np.int64) << 32 | np.maximum(a, b))
    codes = codes[codes >> 32 != (codes & 0xFFFFFFFF)]
    return codes >> 32, codes & 0xFFFFFFFF


def _grouped(radius: int, prefix: int, bits: int):
    """The function of one group: fingerprints sent to a prefix -> (space, fp, root) of those that meet another."""
    half = radius // 2
    low = [np.array(masks(bits - prefix, half - d), np.uint64) for d in range(half + 1)]

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        space, bucket, salt, salts = key
        rows = rows.sort_values("fp", kind="stable")
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        away = np.bitwise_count((fps >> np.uint64(bits - prefix)) ^ np.uint64(bucket))
        moved_to = np.uint64(bucket << (bits - prefix)) | fps & np.uint64((1 << (bits - prefix)) - 1)
        values, owners = [], []
        for d in range(half + 1):
            own = np.flatnonzero(away == d)
            for at in range(0, len(own), 1024):
                some = own[at : at + 1024]
                made = (moved_to[some][:, None] ^ low[d][None, :]).ravel()
                of = np.repeat(some.astype(np.int32), len(low[d]))
                if salts > 1:
                    mine = _slot(made, 40) % np.uint64(salts) == salt
                    made, of = made[mine], of[mine]
                values.append(made)
                owners.append(of)
        a, b = meetings(np.concatenate(values), np.concatenate(owners))
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        root = _local_roots(len(fps), a[near], b[near])
        moved = np.flatnonzero(root != np.arange(len(fps)))
        signed = fps.view(np.int64)
        u, v = signed[moved], signed[root[moved]]
        return pd.DataFrame({"space": np.full(len(u), space, np.int32), "u": u, "v": v})

    return group


def links(fps: DataFrame, n: int, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """Links (space, u, v) that connect all distinct fingerprints of a space at ``radius`` or fewer bits.

    ``fps``: space (int; fingerprints of different spaces never meet), fp; about ``n`` rows in each space.
    """
    half = radius // 2
    prefix = min(24, max(6, math.ceil(math.log2(max(n, 1) / PREFIX_FINGERPRINTS))))
    shifts = [m << (bits - prefix) for m in masks(prefix, half)]
    shifts = F.array(*[F.lit(s - (1 << 64) if s >> 63 else s).cast("long") for s in shifts])
    begins = lambda value: F.shiftrightunsigned(value, bits - prefix).cast("int")
    sent = fps.select("space", "fp", F.explode(shifts).alias("shift"))
    sent = sent.select("space", begins(F.col("fp").bitwiseXOR(F.col("shift"))).alias("bucket"), "fp")
    cost = [sum(math.comb(bits - prefix, k) for k in range(half - d + 1)) for d in range(half + 1)]
    away = F.bit_count(F.col("bucket").bitwiseXOR(begins(F.col("fp"))))
    load = F.sum(F.element_at(F.array(*[F.lit(c) for c in cost]), away + 1))
    full = cut(sent.groupBy("space", "bucket").agg(F.ceil(load / GROUP_VARIANTS).cast("int").alias("salts")).where("salts > 1"), 0)
    if full.isEmpty():  # the usual case needs no join, so the rows are dealt out once
        salted = sent.select("*", F.lit(0).alias("salt"), F.lit(1).alias("salts"))
    else:
        known = sent.join(full, ["space", "bucket"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    grouped = salted.groupBy("space", "bucket", "salt", "salts")
    return grouped.applyInPandas(_grouped(radius, prefix, bits), "space int, u long, v long")


def stars(edges: DataFrame, rows: int) -> DataFrame:
    """Connected components of (u, v): every node but the smallest of its component as (u, root).

    ``edges`` has ``rows`` rows at most; no round makes more of them.  Rounds end when every node points to one root
    and no root points anywhere.
    """
    state = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 32 * rows)
    while not state.isEmpty():
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), 32 * rows)
        twice = state.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        inner = state.select(F.col("v").alias("u")).distinct().join(state.select("u"), "u", "left_semi")
        if twice.unionByName(inner).isEmpty():
            break
    return state.withColumnRenamed("v", "root")


def components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fps`` (doc_id, fp) with component_id, the smallest doc_id that links of ``radius`` or fewer bits reach."""
    fps = cut(fps.select("doc_id", "fp"))
    n = fps.count()
    each = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), 32 * n)
    met = cut(links(each.select(F.lit(0).alias("space"), "fp"), n, radius).select("u", "v"), 32 * n)
    roots = stars(met, met.count()).withColumnRenamed("u", "fp")
    # Only fingerprints that have a neighbour are brought together: with their root, which comes to itself.
    members = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    lowest = cut(members.join(each, "fp").groupBy("root").agg(F.min("first").alias("lowest")), 32 * n)
    named = members.join(_sized(lowest, lowest.count()), "root").select("fp", "lowest")
    of_fp = each.join(named, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every document."""
    found = components(merged_like(fingerprints(docs, words), docs), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-copies: sets of shingles of so many words, alike from this Jaccard similarity on.
DECIDING_WORDS, SIMILARITY = 5, 0.8
#: Documents and shingles, at most, from which the order of the shingles is learnt.
ORDER_DOCS, ORDER_SHINGLES = 20_000, 200_000
#: Documents that share a shingle and are paired at once, and of a block where there are more.
FEW, BLOCK = 64, 4096
#: Early shingles that a pair must have in common, where so many follow from the similarity and the sizes.
COMMON = 4
#: Documents whose shingles one task sorts, about.
SORTED_NODES = 5_000
#: A side of a join is broadcast up to so many rows of an id and a digest; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Ends of pairs of a block where many are paired, and shingles of the texts that are compared at once, about.
TOGETHER, BUCKET_SHINGLES = 64, 500_000
#: Bits of a block of a sieve (a power of two, up to 65,536) and its keys, about.
SIEVE_BITS, SIEVE_KEYS = 1 << 16, 2000


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of some texts: which one, and a hash of each of its distinct shingles; sorted.

    Words and their lower case are those of ``shingle_hashes``; a shingle's hash mixes the 64-bit hashes of its words.
    """
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    there = pc.not_equal(found.flatten(), "")
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    of = of[there.to_numpy(zero_copy_only=False)]
    if not len(of):
        return of, np.empty(0, np.uint64)
    coded = found.flatten().filter(there).dictionary_encode()
    value = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy()]
    held = np.bincount(of, minlength=len(texts))
    ends = held.cumsum()
    left = ends[of] - np.arange(len(of))  # words of the text from here on
    begins = (left >= words) | (left == held[of])  # a text of fewer words is one shingle
    mixed, at = np.zeros(int(begins.sum()), np.uint64), np.flatnonzero(begins)
    left = left[at]
    for k in range(words):
        inside = np.minimum(at + k, len(value) - 1)
        mixed = np.where(left > k, (mixed ^ value[inside]) * np.uint64(0x9E3779B97F4A7C15), mixed)
        mixed ^= mixed >> np.uint64(29)
    of = of[at]
    order = np.lexsort((mixed, of))
    of, mixed = of[order], mixed[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (mixed[1:] != mixed[:-1])])
    return of[new], mixed[new]


def set_fingerprints(of: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """``fingerprint`` of each text's distinct shingles."""
    out = np.zeros(texts, np.uint64)
    if len(of):
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        sizes = np.diff(np.append(begins, len(of)))
        out[of[begins]] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _common_shingles(docs: DataFrame, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of frequent shingles in a sample of about ``ORDER_DOCS`` of ``n`` documents.

    They only set the order of shingles, so the sample decides what the search costs, not what it finds.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for texts in slices(batch.column(0), SLICE_BYTES):
                found, counts = np.unique(shingle_sets(texts, words)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["hash", "n"])

    some = docs.select("text") if n <= ORDER_DOCS else docs.select("text").sample(ORDER_DOCS / n, SEED)
    each = some.mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 2")
    rows = each.orderBy(F.desc("n"), "hash").limit(ORDER_SHINGLES).toArrow()
    hashes, counts = rows.column("hash").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _beginnings(of: np.ndarray, hashes: np.ndarray, texts: int, known: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingles of each text's set, one of which every set similar enough has too, one text after the other.

    Also how many each text has, and per mille of frequent shingles in its set.
    """
    held = np.bincount(of, minlength=texts)
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    often = np.where(known[at] == hashes, counts[at], 0) if len(known) else np.zeros(len(of), np.int64)
    order = np.lexsort((hashes, often, of))
    place = np.arange(len(of)) - (held.cumsum() - held)[of]
    most = np.where(held > 0, held - np.ceil(similarity * held - 1e-9).astype(np.int64) + 1, 0)
    share = 1000 * np.bincount(of, often > 0, texts) / np.maximum(held, 1)
    return hashes[order[place < most[of]]], most, share.astype(np.int32)


def _needed(small: Column, large: Column, similarity: float, most: int) -> Column:
    """How many of their first shingles two similar sets of so many share at least, counted up to ``most``.

    Whichever of the two beginnings ends first in the order, all that is common up to there is in both.
    """
    overlap, behind = similarity / (1 + similarity) * (small + large), F.ceil(similarity * large - 1e-9) - 1
    return F.least(F.lit(most), F.ceil(overlap - behind - 1e-6).cast("int"))


def _meeting(shared: DataFrame, similarity: float, block: int = BLOCK, most: int = 1) -> DataFrame:
    """Distinct pairs (u, v) of nodes of different ``component`` that share a shingle and may be similar enough.

    ``shared``: shingle, held (rows of the shingle), node, at (place of the shingle in the node's order), n (its
    shingles), component, crowded (its first shingles that are in no row here).  Where many nodes share a shingle,
    pairs of blocks of them are dealt out.  A pair has to share up to ``most`` shingles early enough, of which
    ``common`` are in rows here.
    """
    blocks = F.ceil(F.col("held") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    side = lambda name, mine, other: shared.select(
        "shingle", own.alias(mine), every.alias(other), *[F.col(c).alias(f"{c}_{name}") for c in ("node", "at", "n", "component", "crowded")]
    )
    both = side("u", "i", "j").join(side("v", "j", "i"), ["shingle", "i", "j"])
    # u has no more shingles than v; the first shingle that both have leaves this many that they can share.
    ordered = (F.col("n_u") < F.col("n_v")) | ((F.col("n_u") == F.col("n_v")) & (F.col("node_u") < F.col("node_v")))
    left = F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v"))
    overlap = similarity / (1 + similarity) * (F.col("n_u") + F.col("n_v"))
    # The shingle after k others that both have may leave k less.
    early = left >= overlap - (most - 1) - 1e-6
    found = both.where(ordered & early & (F.col("n_u") >= similarity * F.col("n_v") - 1e-6) & (F.col("component_u") != F.col("component_v")))
    needed = _needed(F.col("n_u"), F.col("n_v"), similarity, most) - F.least("crowded_u", "crowded_v")
    found = found.select(F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v"), (left >= overlap - 1e-6).alias("first"), needed.alias("needed"))
    each = found.groupBy("u", "v").agg(F.count("*").cast("int").alias("common"), F.max("first").alias("first"), F.max("needed").alias("needed"))
    return each.where(F.col("first") & (F.col("common") >= F.col("needed"))).select("u", "v", "common")


def _by_fingerprint(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """Pairs (u, v) of ``n`` nodes of one fingerprint, and of neighbours at ``radius`` or fewer bits by ball hashing."""
    each = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")), 32 * n)
    same = nodes.join(each, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    met = links(each.select(F.lit(0).alias("space"), "fp"), n, radius).select("u", "v").distinct()
    named = lambda c: each.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    near = met.join(named("u"), "u").join(named("v"), "v").select(F.greatest("first_u", "first_v").alias("u"), F.least("first_u", "first_v").alias("v"))
    return same.unionByName(near)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _digest() -> Column:
    return F.unhex(F.substr(F.sha2(_text(), 256), F.lit(1), F.lit(32)))


def _sieve(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """block, bits, and the number of blocks: of about ``n`` ``key``s, four bytes each, by which ``_sifted`` tells rows that have none of them."""
    blocks = max(1, -(-n // SIEVE_KEYS))

    def filled(rows: pa.Table) -> pa.Table:
        keys, held = rows.column("key").to_numpy().view(np.uint64), np.zeros(SIEVE_BITS, np.uint8)
        for shift in (0, 16):
            held[(keys >> np.uint64(shift)) % np.uint64(SIEVE_BITS)] = 1
        bits = np.packbits(held, bitorder="little").view("<i8")
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "bits": pa.array([bits.tolist()], pa.list_(pa.int64()))})

    placed = keys.select(_block(F.col("key"), blocks).alias("block"), "key")
    return cut(placed.groupBy("block").applyInArrow(filled, "block int, bits array<long>"), SIEVE_BITS // 8 * blocks), blocks


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 32), F.lit(blocks)).cast("int")


def _sifted(rows: DataFrame, sieve: tuple[DataFrame, int], digest: str, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with ``maybe``: false only where none of the keys has that id and digest (of others a few in a thousand are true)."""
    key = F.xxhash64(doc_id, digest)
    place = lambda shift: F.shiftrightunsigned(key, shift).bitwiseAND(SIEVE_BITS - 1).cast("int")
    there = [F.getbit(F.get("bits", F.shiftright(place(shift), 6)), place(shift).bitwiseAND(63)) for shift in (0, 16)]
    marked = rows.join(F.broadcast(sieve[0]), _block(key, sieve[1]) == F.col("block"), "left")
    return marked.withColumn("maybe", F.coalesce(there[0] + there[1] == 2, F.lit(False))).drop("block", "bits")


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with label, i, j: pairs of one label, i and j are worked out together.

    A label brings together what is paired with one another, so that few texts travel twice; where it has many pairs, blocks of their ends are.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), "v"), F.struct(F.col("v").alias("node"), "v"))).alias("end"))
    least = ends.groupBy("end.node").agg(F.min("end.v").alias("least"))
    named = lambda c: least.select(F.col("node").alias(c), F.col("least").alias(f"least_{c}"))
    labelled = cut(pairs.join(named("u"), "u").join(named("v"), "v").select("u", "v", F.least("least_u", "least_v").alias("label")), 0)
    many = labelled.groupBy("label").count().where(F.col("count") > TOGETHER).select("label")
    blocks = lambda c: F.ceil(F.approx_count_distinct(c) / TOGETHER)
    sides = labelled.join(many, "label", "left_semi").groupBy("label").agg(blocks("u").alias("is"), blocks("v").alias("js"))
    placed = labelled.join(sides, "label", "left")
    block = lambda c, of: F.pmod(F.xxhash64(c), F.greatest(F.coalesce(of, F.lit(1)), F.lit(1))).cast("int")
    return cut(placed.select("label", block("u", "is").alias("i"), block("v", "js").alias("j"), "u", "v"), 0)


def _similar(texts: pa.Table, pairs: pa.Table, words: int, similarity: float) -> pa.Table:
    """Those of a bucket's pairs (u, v) that are similar enough, by the texts of their nodes."""
    sets = {}
    ids, at = texts.column("node").to_numpy(), 0
    for some in slices(texts.column("text").combine_chunks(), SLICE_BYTES):
        of, hashes = shingle_sets(some, words)
        ends = np.bincount(of, minlength=len(some)).cumsum()
        sets |= {int(ids[at + k]): own for k, own in enumerate(np.split(hashes, ends[:-1]))}
        at += len(some)
    found = []
    for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True):
        a, b = sets[u], sets[v]
        both = np.concatenate([a, b])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        if common >= similarity * (len(a) + len(b) - common) - 1e-9:
            found.append((u, v))
    return pa.table({name: pa.array([pair[k] for pair in found], pa.int64()) for k, name in enumerate(("u", "v"))})


def _kept(docs: DataFrame, similarity: float, words: int, radius: int) -> tuple[tuple[DataFrame, int] | None, DataFrame, int, bool]:
    """What ``without_near_copies`` goes by: kept_id, kept_digest and their number, and whether rows repeat an id and a text.

    With a sieve, of removed keys, the table holds only those of the kept ones that it takes for removed.
    """
    own = docs.select("doc_id", _text().alias("text"), _digest().alias("digest"))
    repeated = not own.groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    known, counts = _common_shingles(own, n := own.count(), words)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), SLICE_BYTES):
                of, hashes = shingle_sets(texts, words)
                first, most, often = _beginnings(of, hashes, len(texts), known, counts, similarity)
                begins = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], most.cumsum()]).astype(np.int32)), pa.array(first.view(np.int64)))
                columns = [pa.array(set_fingerprints(of, hashes, len(texts)).view(np.int64)), pa.array(np.bincount(of, minlength=len(texts)).astype(np.int32)), pa.array(often), begins]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), *columns], names=["doc_id", "digest", "fp", "n", "often", "begins"])
                at += len(texts)

    # One node for each distinct text.
    schema = own.select("doc_id", "digest").schema
    for name, kind in (("fp", T.LongType()), ("n", T.IntegerType()), ("often", T.IntegerType()), ("begins", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)
    firsts = [F.first(name).alias(name) for name in ("fp", "n", "often", "begins")]
    prints = own.mapInArrow(begun, schema).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *firsts)
    nodes = cut(prints.withColumn("node", F.monotonically_increasing_id()), 2048 * n)

    def close(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are similar enough; texts go to the buckets of their pairs, sets of shingles go nowhere."""
        dealt = _dealt(pairs)
        asked = nodes.join(dealt.select("label", "i", "j", F.explode(F.array("u", "v")).alias("node")).distinct(), "node")
        size = asked.agg(F.sum("n")).first()[0] or 0
        buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_SHINGLES))
        bucket = F.pmod(F.xxhash64("label", "i", "j"), F.lit(buckets)).alias("bucket")
        wanted = asked.groupBy("node", F.col("doc_id").alias("id"), F.col("digest").alias("of")).agg(F.collect_set(bucket).alias("buckets"))
        wanted = cut(wanted, 64 * n)
        near = own if (rows := wanted.count()) <= BROADCAST_ROWS else _sifted(own, _sieve(wanted.select(F.xxhash64("id", "of").alias("key")), rows), "digest").where("maybe")
        side = _sized(wanted, rows) if rows <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
        texts = near.join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")))
        texts = texts.select(F.explode("buckets").alias("bucket"), "node", "text")
        met = texts.groupBy("bucket").cogroup(dealt.select(bucket, "u", "v").groupBy("bucket"))
        return cut(met.applyInArrow(lambda left, right: _similar(left, right, words, similarity), "u long, v long"), 32 * n)

    # A dozen bytes a shingle in the shuffle, a hundred shingles a document, about; small parts, as each is sorted whole.
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-n // SORTED_NODES))
    begins = nodes.select("node", "n", "often", F.posexplode("begins").alias("at", "shingle"))
    packed = F.shiftleft(F.col("often").cast("long"), 52).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 26)).bitwiseOR(F.col("at").cast("long"))  # 26 bits each
    held = F.count("*").over(Window.partitionBy("shingle"))
    shared = begins.select("shingle", "node", packed.alias("packed")).repartition(parts, "shingle").withColumn("held", held).where("held > 1")
    part = lambda shift, bits: F.shiftrightunsigned("packed", shift).bitwiseAND((1 << bits) - 1).cast("int")
    shared = cut(shared.select("shingle", "node", "held", part(0, 26).alias("at"), part(26, 26).alias("n"), part(52, 11).alias("often")), 512 * n)
    few, many = shared.where(F.col("held") <= FEW), shared.where(F.col("held") > FEW)
    crowded = cut(many.groupBy("node").agg(F.count("*").cast("int").alias("crowded")), 16 * n)
    few = few.join(_sized(crowded, crowded.count()), "node", "left").withColumns({"crowded": F.coalesce("crowded", F.lit(0)), "component": F.col("node")})
    # Where many meet, first each with the one most made of frequent shingles: an original rather than its edited copies.
    top = many.groupBy("shingle").agg(F.max(F.struct("often", "node", "n")).alias("top"))
    small, large = F.least("n", "top.n"), F.greatest("n", "top.n")
    to_top = many.join(top, "shingle").where((F.col("node") != F.col("top.node")) & (small >= similarity * large - 1e-6))
    needed = _needed(small, large, similarity, COMMON)
    to_top = to_top.select(F.greatest("node", "top.node").alias("u"), F.least("node", "top.node").alias("v"), needed.alias("needed"))
    to_top = to_top.groupBy("u", "v").agg(F.count("*").alias("common"), F.max("needed").alias("needed")).where("common >= needed")
    pairs = _meeting(few, similarity, most=COMMON).unionByName(to_top.drop("needed")).drop("common").unionByName(_by_fingerprint(nodes, n, radius))
    pairs = cut(pairs.distinct(), 32 * n)
    linked = close(pairs)
    copies = stars(linked, linked.count())
    # Then all of them that no chain connects so far.
    placed = many.join(copies.withColumnRenamed("u", "node"), "node", "left").withColumn("component", F.coalesce("root", "node"))
    apart = placed.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("shingle")
    rest = _meeting(placed.join(apart, "shingle", "left_semi").withColumn("crowded", F.lit(0)), similarity)
    rest = cut(rest.select("u", "v").join(pairs, ["u", "v"], "left_anti"), 32 * n)
    if not rest.isEmpty():
        linked = linked.unionByName(close(rest))
        copies = stars(linked, linked.count())

    grouped = nodes.select("node", "doc_id", "digest").join(copies.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")
    kept = cut(grouped.groupBy("root").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_digest")), 64 * n)
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    sieve, fewer = None, kept
    if (n_kept := kept.count()) > BROADCAST_ROWS:  # only keys are shuffled: texts that no removed key resembles stay where they are
        keys = own.select(F.col("doc_id").alias("id"), "digest")
        removed = cut(keys.join(kept, same, "left_anti").select(F.xxhash64("id", "digest").alias("key")), 16 * n)
        sieve = _sieve(removed, removed.count())
        fewer = cut(_sifted(kept, sieve, "kept_digest", "kept_id").where("maybe").select("kept_id", "kept_digest"), 64 * n)
        n_kept = fewer.count()
    return sieve, fewer, n_kept, repeated


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY, words: int = DECIDING_WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents without exact and near copies: of each group the one with the smallest doc_id stays.

    Two texts are near copies if the Jaccard similarity of their sets of shingles of ``words`` words is at least
    ``similarity``; groups are what chains of them connect.  Ball hashing of the sets' fingerprints gives the first
    candidates.  It can't give all (sets of that similarity often differ in more bits), so an exact search adds the
    others: sets so similar share one of their first shingles in any order common to all, and every pair that does is
    worked out, unless a chain connects it already.  The order puts rare shingles first, so that frequent ones bring
    few together.  Texts count, not ids: rows without a doc_id come after all others, texts that share a doc_id by
    their digests, and of rows that repeat both one stays.  Columns of any name are carried.
    """
    with shuffles_freed(docs.sparkSession):
        sieve, kept, n_kept, repeated = _kept(docs, similarity, words, radius)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), _digest().alias("digest"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    if sieve is None:
        staying = rows.join(_sized(kept, n_kept), same, "left_semi")
    else:
        marked = _sifted(rows, sieve, "digest", "id").join(_sized(kept, n_kept), same, "left")
        staying = marked.where(~F.col("maybe") | F.col("kept_digest").isNotNull()).select("row", "id", "digest")
    if repeated:
        staying = staying.dropDuplicates(["id", "digest"])
    return merged_like(staying.select("row.*"), docs)
