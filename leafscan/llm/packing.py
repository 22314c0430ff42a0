"""Best-fit packing of tokenised documents into sequences of a fixed length.

Two steps.  ``tokenised_pieces`` is a map over documents: ids of the whole text, then the end id, cut only where
a document is longer than a sequence.  ``best_fit`` places pieces: it shuffles the piece lengths alone (a few
bytes a piece, never the ids), dealt out by a hash, and every task packs its share as a stream with a fixed
number of open bins.  A bin that is full is closed; if no open bin has room and no bin may be opened, the
fullest open bin is closed.  What the tasks leave open is packed once more by the same method, whole bins as
pieces, in a sixteenth as many tasks.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated rows are packed each on
its own; a table without rows gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import cut, fresh_worker, merged_like, slices, vocabulary
from leafscan.llm.wordbpe import SLICE_BYTES, encoder

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Open bins of a task.
OPEN_BINS = 2048
#: Tokens of pieces that one packing task gets, about; its memory doesn't depend on it.
TASK_TOKENS = 1 << 25

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenised_pieces(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, limit: int = SEQUENCE_TOKENS
) -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), start, length, ids (little-endian unsigned 32-bit)."""
    path = path or vocabulary("word_bpe_49k.json")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), SLICE_BYTES):
                ids, sizes = own.encode(texts, end_id)
                count = -(-sizes // limit)
                of = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(of)) - np.repeat(count.cumsum() - count, count)
                length = np.minimum(limit, sizes[of] - piece * limit)
                ends = np.concatenate([[0], 4 * length.cumsum()]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)).take(pa.array(of)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(piece * limit),
                        pa.array(length),
                        pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends), pa.py_buffer(ids)]),
                    ],
                    schema=PIECES,
                )
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids binary"
    )


class OpenBins:
    """Bounded-space best-fit: open bins under their free space, and a bitset of the spaces that occur."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.count = 0
        self.opened = 0

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def _keep(self, bin_no: int, free: int) -> None:
        if free:
            self.by_free[free].append(bin_no)
            self.bits |= 1 << free
            self.count += 1

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset for a piece; the tightest open bin that has room, else a new one."""
        roomy = self.bits >> length
        if roomy:
            free = length + (roomy & -roomy).bit_length() - 1
            bin_no = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_no, free = self.opened, self.capacity
            self.opened += 1
        self._keep(bin_no, free - length)
        return bin_no, self.capacity - free


def _packed(pieces: DataFrame, tasks: int, capacity: int, open_bins: int) -> DataFrame:
    """Columns key, length -> key, length, bin, offset; ``bin`` is unique among tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("length"), pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=["key", "length", "bin", "offset"],
            )

    dealt = pieces.select("key", "length").repartition(tasks, F.xxhash64("key"))
    return dealt.sortWithinPartitions(F.xxhash64("key"), "key", "length").mapInArrow(
        pack, pieces.select("key").schema.add("length", "long").add("bin", "long").add("offset", "long")
    )


def best_fit(
    pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS
) -> DataFrame:
    """``pieces`` (key, length; lengths from 1 to ``capacity``) with sequence_id and offset.

    Sequence ids are any distinct numbers; the offsets in a sequence are gapless from 0.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens))
    first = cut(_packed(pieces, tasks, capacity, open_bins))  # as many files as tasks
    bins = first.groupBy("bin").agg(F.sum("length").alias("length")).where(F.col("length") < capacity)
    again = _packed(bins.withColumnRenamed("bin", "key"), max(1, tasks // 16), capacity, open_bins)
    moved = again.select(F.col("key").alias("bin"), (-1 - F.col("bin")).alias("into"), F.col("offset").alias("base"))
    return first.join(moved, "bin", "left").select(
        "key",
        "length",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Where every piece of every document goes, with the checksum of its ids.

    The digests are kept in the shared folder, so the texts are tokenised once.
    """
    pieces = tokenised_pieces(docs, path, limit=capacity)
    digests = cut(merged_like(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), docs))
    keyed = digests.select(F.struct("doc_id", "piece", "start", "ids_crc32").alias("key"), "length")
    return best_fit(keyed, capacity).select(
        "key.doc_id", "key.piece", "key.start", "length", "key.ids_crc32", "sequence_id", "offset"
    )


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most a sequence's tokens), from the pieces' ids."""
    whole = pieces.join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return whole.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda joined, part: F.concat(joined, part["ids"])).alias("ids")
    )

