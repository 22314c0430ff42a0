"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

A sequence of tokens is what the merges make of its bytes exactly if every two neighbours are what the merges
make of theirs.  So the last token of every prefix's encoding follows from the last tokens of shorter prefixes,
and a finite transducer can read a text byte by byte.  Its states are made when they are first met (then one
dictionary step a byte suffices): the longest suffix read that begins some token, and, for every place in it,
the tokens not yet emitted of the encoding up to that place.  Whatever begins later than that suffix can't
change what all those encodings share, so their common beginning is emitted: the lookahead is bounded by the
longest token.

Texts are split by the vocabulary's pattern; a worker remembers the ids of what it met between white space, in two
generations of bounded size.  Decoding concatenates token bytes in slices, and a small state machine holds back
the bytes of a character that the slice cuts.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated results;
other columns are left out; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import vocabulary

#: Pieces between white space whose ids one generation of a worker's memo holds, and the longest kept.
MEMO_PIECES, MEMO_CHARS = 250_000, 64
#: Steps of the transducer, and as many pairs of tokens, that a worker keeps before it starts anew.
KEPT_STEPS = 500_000
#: Ids that streaming decoding takes at a time.
SLICE_IDS = 16_384
#: The white space of Unicode, which the pattern's \\s stands for.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern whose pieces never cross the chunks below, and which leaves runs of letters whole.
CHUNKED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int], keep: int = 1) -> list[bytes]:
    """Tokens of a short piece by repeated merging of the lowest rank, leftmost first: the definition itself.

    Stops where ``keep`` tokens are left.
    """
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > keep:
        rank, at = min((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Deterministic transducer from bytes to token ids, made as far as texts need it."""

    def __init__(self, ranks: dict[bytes, int], kept_steps: int = KEPT_STEPS):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.begins = {token[:k] for token in ranks for k in range(len(token) + 1)}
        self.kept_steps = kept_steps
        self.fits: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self._restart()

    def _restart(self) -> None:
        #: A state: its suffix, and for every place from which some token may still grow (longest first) how many
        #: bytes ago it was and the tokens not yet emitted up to it.
        self.states: list[tuple[bytes, tuple]] = [(b"", ((0, ()),))]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merges join last into this one; (-1, -1) for a byte, None if they never make it."""
        if rank not in self.split:
            token = self.token[rank]
            parts = merged(token, self.ranks, keep=2)
            if len(parts) == 2 and parts[0] + parts[1] in self.ranks:
                self.split[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
            else:
                self.split[rank] = (-1, -1) if len(token) == 1 else None
        return self.split[rank]

    def follows(self, first: int, second: int) -> bool:
        """Whether the merges keep these two tokens as neighbours; -1 stands for a piece's beginning.

        Undoes the merges of both from the last (highest rank; of equal ones the right) to the first. At no time
        may the two parts that touch have been next to merge: their joint rank must not be below that of the merge
        undone, nor equal to it where that merge is the one to the right.
        """
        if self.halves(second) is None:
            return False
        if first < 0:
            return True
        key = first << 32 | second
        known = self.fits.get(key)
        if known is None:
            limit = 1 << 60
            left, right = first, second
            while True:
                known = self.ranks.get(self.token[left] + self.token[right], 1 << 60) >= limit
                if not known:
                    break
                of_left, of_right = self.halves(left)[1], self.halves(right)[0]
                if of_left >= 0 and (left > right or of_right < 0):
                    limit, left = left, of_left
                elif of_right >= 0:
                    limit, right = right + 1, of_right
                else:
                    break
            if len(self.fits) > self.kept_steps:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        suffix, places = self.states[state]
        read = suffix + bytes((byte,))
        end, own, kept = len(read), None, []
        rank_of, begins, fits = self.ranks.get, self.begins, self.fits.get
        for size, chain in places:
            grown = read[end - size - 1 :]
            if own is None:
                rank = rank_of(grown)
                if rank is not None:
                    fit = fits(chain[-1] << 32 | rank) if chain else None
                    if self.follows(chain[-1] if chain else -1, rank) if fit is None else fit:
                        own = (*chain, rank)
            if grown in begins:
                kept.append((size + 1, chain))
        if own is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        kept.append((0, own))
        shared = 0
        if len(kept) > 1:
            shortest = min([len(chain) for _, chain in kept]) - 1
            while shared < shortest and all([chain[shared] == own[shared] for _, chain in kept]):
                shared += 1
        else:
            shared = len(own) - 1
        if shared:
            kept = [(size, chain[shared:]) for size, chain in kept]
        new = (read[end - kept[0][0] :], tuple(kept))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        step = self.steps[state << 8 | byte] = number, own[:shared]
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.steps) > self.kept_steps:
            self._restart()
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            state, emitted = steps.get(state << 8 | byte) or self._step(state, byte)
            if emitted:
                out += emitted
        out += self.states[state][1][-1][1]
        return out


class Utf8Stream:
    """Incremental UTF-8: feeds give the text of the whole characters so far, the rest waits for the next feed."""

    #: How many bytes follow a lead byte, by its upper five bits.
    FOLLOW = [0] * 24 + [1] * 4 + [2] * 2 + [3, 0]

    def __init__(self, errors: str = "replace") -> None:
        self.held, self.errors = b"", errors

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        whole = len(data)
        if not last:
            for back in range(1, min(3, whole) + 1):
                byte = data[-back]
                if byte & 0xC0 != 0x80:
                    whole -= back if self.FOLLOW[byte >> 3] >= back else 0
                    break
        self.held = data[whole:]
        return data[:whole].decode("utf-8", errors=self.errors)


class ByteBPE:
    """Whole texts to ids and back, with a vocabulary file and the pattern that goes with it."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(load_ranks(path))
        self.finditer = regex.compile(pattern).finditer
        self.chunked = pattern == CHUNKED_PATTERN
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes_of = [self.transducer.token.get(k, b"") for k in range(max(self.transducer.token, default=-1) + 1)]

    def _pieces(self, text: str) -> list[int]:
        return [i for piece in self.finditer(text) for i in self.transducer.encode(piece[0].encode())]

    def _chunk(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():  # the pattern leaves runs of letters whole
                found = self.transducer.encode(chunk.encode())
            else:
                found = self._pieces(chunk)
            ids = array("i", found).tobytes()
        if len(chunk) <= MEMO_CHARS:
            self.young[chunk] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not self.chunked:
            return np.array(self._pieces(text or ""), "<i4")
        chunks = _CHUNK.findall(text) if text else []
        young = self.young
        try:
            parts = [young[c] for c in chunks]
        except KeyError:
            parts = [young.get(c) or self._chunk(c) for c in chunks]
            if len(young) > MEMO_PIECES:
                self.young, self.old = {}, young
        return np.frombuffer(b"".join(parts), "<i4")

    def decode_bytes(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of ids, in slices."""
        for at in range(0, len(ids), SLICE_IDS):
            yield b"".join([self.bytes_of[i] for i in ids[at : at + SLICE_IDS].tolist()])

    def decode(self, ids: np.ndarray, errors: str = "replace") -> Iterator[str]:
        """The text of ids, in slices that never cut a character; with ``errors="strict"`` its bytes are the ids' bytes."""
        stream = Utf8Stream(errors)
        for data in self.decode_bytes(ids):
            yield stream.feed(data)
        yield stream.feed(b"", last=True)


_codecs: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """The worker's codec for a vocabulary; later tasks of the same worker find it filled."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(path, pattern)
    return _codecs[path, pattern]


def release() -> None:
    """Give back the worker's memory; for tasks that need it for something else."""
    _codecs.clear()


def _files(path: str | None, pattern: str | None) -> tuple[str, str]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return path or vocabulary("byte_bpe_multi_50k.tiktoken"), pattern


def _lists(arrays: Iterable[np.ndarray]) -> pa.ListArray:
    arrays = list(arrays)
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]), pa.int32()))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; with ``decoded`` also text, decoded from those ids.

    The ids of a text must decode to valid UTF-8; if they ever don't, the task fails and no digest hides it.
    """
    files = _files(path, pattern)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*files)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [own.encode(text.as_py()) for text in part.column(1)]
                columns = {"doc_id": part.column(0), "ids": _lists(ids)}
                if decoded:
                    columns["text"] = pa.array(["".join(own.decode(i, "strict")) for i in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(coded, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text of every row's ids (null ids: an empty text)."""
    files = _files(path, pattern)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*files)
        for batch in batches:
            found = ["".join(own.decode(np.asarray(ids.as_py() or [], np.int32))) for ids in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(found, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")
