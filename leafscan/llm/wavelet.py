"""Token ids on disk: one wavelet matrix per shard, in a compressed file that answers queries.

A shard holds the ids of consecutive documents.  Its file keeps, from the highest bit of the ids to the lowest,
one plane of bits; each plane orders the ids stably by the bits above it.  With the zeros of a plane and its
directory of running counts, which the file holds too, ``access`` (the id at a position), ``rank`` (how often an id occurs
before a position) and ``select`` (where its k-th occurrence is) take one step a plane and unpack one chunk of each.

``write`` orders documents by id over the cluster (range partitions, ties by the text's hash), encodes each in
its task and lets Spark's writer store one file for each shard; ``read_documents`` decodes shards from those
files.  Defined cases: a null or empty text has the end id alone; repeated rows stay, side by side; a null
doc_id comes first; no rows give no shards; other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm.common import shared_path, slices, vocabulary
from leafscan.llm.wordbpe import SLICE_BYTES, encoder

END_ID = 2
#: A shard closes with the document that brings it to this many ids.
SHARD_TOKENS = 1 << 21
#: Bytes of a plane between two entries of its directory, and of a chunk that is compressed on its own.
BLOCK_BYTES, CHUNK_BYTES = 128, 1 << 15
_HEAD = struct.Struct("<4sQB")
_MAGIC = b"WVM2"


class WaveletMatrix:
    """Succinct bit-planes of a sequence of unsigned integers.

    A plane is kept in chunks, compressed one by one; a question unpacks only the chunks that it looks into.
    """

    def __init__(self, n: int, zeros: list[int], directory: np.ndarray, packed: list[list[bytes]]):
        self.n, self.zeros, self.width = n, zeros, len(zeros)
        #: Ones of each plane before each of its blocks, and at last all of them.
        self.directory = directory
        self.packed = packed
        self.unpacked: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype("<u2" if width <= 16 else "<u4")
        zeros, counts, packed = [], [], []
        compress = zstandard.ZstdCompressor(level=1).compress
        for bit in range(width - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << bit)) != 0
            plane = np.packbits(ones, bitorder="little")
            blocks = np.pad(plane, (0, -len(plane) % BLOCK_BYTES)).view("<u8").reshape(-1, BLOCK_BYTES // 8)
            counts.append(np.concatenate([[0], np.bitwise_count(blocks).sum(axis=1, dtype=np.uint32).cumsum()]))
            packed.append([compress(plane[at : at + CHUNK_BYTES]) for at in range(0, len(plane), CHUNK_BYTES)])
            low = ids.take(np.flatnonzero(~ones))
            zeros.append(len(low))
            ids = np.concatenate([low, ids.take(np.flatnonzero(ones))])
        return cls(len(ids), zeros, np.array(counts, "<u4"), packed)

    def _chunk(self, level: int, number: int) -> np.ndarray:
        key = level, number
        if key not in self.unpacked:
            self.unpacked[key] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed[level][number]), np.uint8)
        return self.unpacked[key]

    def _bytes(self, level: int, at: np.ndarray) -> np.ndarray:
        """Bytes of a plane at some places; zero beyond its end."""
        out, chunk = np.zeros(at.shape, np.uint8), at // CHUNK_BYTES
        for number in np.unique(chunk):
            if number < len(self.packed[level]):
                data, here = self._chunk(level, int(number)), chunk == number
                within = at[here] - number * CHUNK_BYTES
                out[here] = np.where(within < len(data), data[np.minimum(within, len(data) - 1)], 0)
        return out

    def ids(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        out, unpack = np.zeros(self.n, kind), zstandard.ZstdDecompressor().decompress
        for level in range(self.width - 1, -1, -1):
            plane = np.frombuffer(b"".join(map(unpack, self.packed[level])), np.uint8)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above, zeros = np.empty(self.n, kind), self.zeros[level]
            above[np.flatnonzero(~ones)] = out[:zeros]
            above[np.flatnonzero(ones)] = out[zeros:] | kind(1 << (self.width - 1 - level))
            out = above
        return out

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at // (8 * BLOCK_BYTES)
        byte = block[..., None] * BLOCK_BYTES + np.arange(BLOCK_BYTES)
        held = np.clip(at[..., None] - 8 * byte, 0, 8)
        part = np.zeros(byte.shape, np.uint8)
        part[held > 0] = self._bytes(level, byte[held > 0])
        return self.directory[level][block].astype(np.int64) + np.bitwise_count(part & ((1 << held) - 1).astype(np.uint8)).sum(axis=-1, dtype=np.int64)

    def access(self, positions) -> np.ndarray:
        at = np.asarray(positions, np.int64)
        out = np.zeros(at.shape, np.int64)
        for level in range(self.width):
            bit, ones = self._bytes(level, at >> 3) >> (at & 7).astype(np.uint8) & 1, self._ones_before(level, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def _range_of(self, value: int, end: int) -> tuple[int, int]:
        """Where, below the last plane, the occurrences of ``value`` before ``end`` lie."""
        ends = np.array([0, end], np.int64)
        for level in range(self.width):
            ones = self._ones_before(level, ends)
            ends = self.zeros[level] + ones if value >> (self.width - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def rank(self, value: int, end: int | None = None) -> int:
        """Occurrences of ``value`` before position ``end`` (default: in all)."""
        if value < 0 or value >> self.width:
            return 0
        first, last = self._range_of(value, self.n if end is None else min(max(end, 0), self.n))
        return last - first

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this kind in a plane."""
        ones = self.directory[level].astype(np.int64)
        counts = ones if bit else np.arange(len(ones)) * 8 * BLOCK_BYTES - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self._bytes(level, block * BLOCK_BYTES + np.arange(BLOCK_BYTES)), bitorder="little")
        return block * 8 * BLOCK_BYTES + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of ``value``; -1 where there are fewer."""
        if k < 0 or value < 0 or value >> self.width:
            return -1
        first, last = self._range_of(value, self.n)
        if k >= last - first:
            return -1
        at = first + k
        for level in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def locate(self, value: int) -> list[int]:
        """All positions of ``value``, ascending."""
        return [self.select(value, k) for k in range(self.rank(value))]

    def to_bytes(self) -> bytes:
        chunks = [c for plane in self.packed for c in plane]
        sizes = np.array([len(c) for c in chunks], "<u4").tobytes()
        return b"".join([_HEAD.pack(_MAGIC, self.n, self.width), np.array(self.zeros, "<u8").tobytes(), self.directory.tobytes(), sizes, *chunks])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, int]:
        """The matrix, and where in ``data`` it ends; no chunk is unpacked."""
        magic, n, width = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        plane = -(-n // 8)
        blocks, chunks = -(-plane // BLOCK_BYTES) + 1, -(-plane // CHUNK_BYTES)
        at = _HEAD.size
        zeros = np.frombuffer(data, "<u8", width, at).astype(int).tolist()
        at += 8 * width
        directory = np.frombuffer(data, "<u4", width * blocks, at).reshape(width, blocks)
        at += 4 * width * blocks
        sizes = np.frombuffer(data, "<u4", width * chunks, at).astype(np.int64)
        ends = at + 4 * width * chunks + np.concatenate([[0], sizes.cumsum()])
        packed = [[data[ends[k] : ends[k + 1]] for k in range(level * chunks, (level + 1) * chunks)] for level in range(width)]
        return cls(n, zeros, directory, packed), int(ends[-1])


class Shard:
    """A shard file: the wavelet matrix of its ids, and where its documents begin."""

    def __init__(self, matrix: WaveletMatrix, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray):
        self.matrix, self.doc_ids, self.known, self.lengths = matrix, doc_ids, known, lengths

    @classmethod
    def of(cls, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> Shard:
        known = doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        return cls(WaveletMatrix.of(ids), doc_ids.fill_null(0).to_numpy().astype("<i8"), known, lengths.astype("<u8"))

    def to_bytes(self) -> bytes:
        table = self.doc_ids.tobytes() + self.known.tobytes() + self.lengths.tobytes()
        return self.matrix.to_bytes() + struct.pack("<Q", len(self.doc_ids)) + zlib.compress(table, 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        matrix, at = WaveletMatrix.from_bytes(data)
        (n,) = struct.unpack_from("<Q", data, at)
        table = zlib.decompress(data[at + 8 :])
        return cls(matrix, np.frombuffer(table, "<i8", n), np.frombuffer(table, np.uint8, n, 8 * n), np.frombuffer(table, "<u8", n, 9 * n))


def write(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode all documents and write their shards, one file each, below ``folder``.

    Columns of the files: part (its order is that of the documents), start (ids before the shard in its part),
    n_ids, payload (a ``Shard``).
    """
    path = path or vocabulary("word_bpe_49k.json")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        start = 0

        def closed() -> pa.RecordBatch:
            ids, lengths = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            data = Shard.of(pa.concat_arrays([h[0] for h in held]), ids, lengths).to_bytes()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(([part], [start], [len(ids)], [data]), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["part", "start", "n_ids", "payload"],
            )

        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), SLICE_BYTES):
                docs_of, (ids, sizes) = batch.column(0).slice(at, len(texts)), own.encode(texts, end_id)
                at, first, ends = at + len(texts), 0, sizes.cumsum()
                while first < len(sizes):
                    before = ends[first] - sizes[first]
                    room = shard_tokens - sum(len(h[1]) for h in held)
                    last = min(len(sizes), int(np.searchsorted(ends, before + room)) + 1)
                    held.append((docs_of.slice(first, last - first), ids[before : ends[last - 1]].copy(), sizes[first:last].copy()))
                    if ends[last - 1] - before >= room:
                        done = closed()
                        yield done
                        start += done.column(2)[0].as_py()
                        held.clear()
                    first = last
        if held:
            yield closed()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    made = ordered.mapInArrow(shards, "part int, start long, n_ids long, payload binary")
    made.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), ids (end id too)."""
    files = spark.read.parquet(folder)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                shard = Shard.from_bytes(data.as_py())
                ids = shard.matrix.ids().astype("<u4")
                ends = shard.lengths.astype(np.int64).cumsum()
                begins = ends - shard.lengths.astype(np.int64)
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), part.as_py(), np.int32)),
                        pa.array(shard.doc_ids, mask=shard.known == 0),
                        pa.array(begins + start.as_py()),
                        pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]),
                    ],
                    names=["part", "doc_id", "within", "ids"],
                )

    read = files.select("part", "start", "payload").mapInArrow(documents, "part int, doc_id long, within long, ids binary")
    # One row for each range partition of the writer: as many as a shuffle has partitions, whatever the data.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, bases = 0, []
    for row in sorted(parts, key=lambda r: r["part"]):
        bases.append((row["part"], base))
        base += row["n"]
    known = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return read.join(known, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "ids")


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents through shard files of their own in the shared folder, read back."""
    folder = shared_path(docs.sparkSession, "shards")
    write(docs, folder, path)
    return read_documents(docs.sparkSession, folder)
