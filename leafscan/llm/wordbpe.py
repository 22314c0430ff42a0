"""Ids of whole texts by a vocabulary of the ``tokenizers`` library, inside Spark tasks.

The vocabulary's pre-tokenizer drops white space, so the ids of a text are those of its words one after the
other.  Arrow splits a batch of texts and finds its distinct words; a worker looks these up in a memo of fixed size and
asks the library's model for the others.  The memo is a table of arrays: a word's 128-bit hash names the two slots it may
take, later words take one over in turn, and memory stays the same however many words there are (``SLOTS``).

Words of printable ASCII and Latin letters are lower-cased and split here by the pre-tokenizer's own pattern and go
straight to the library's model; all others, and texts with an added token, go through its whole pipeline.  A vocabulary
file with another pipeline is used on whole texts, without any of this.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from leafscan.llm.common import single_threaded, slices

#: Words that a worker's memo can hold and ids of a word that fit into it: 33 bytes a slot.
SLOTS, SLOT_IDS = 1 << 20, 8
#: Parts of words whose ids a worker keeps before it starts anew.
MEMO_PARTS = 60_000
#: Characters of text that are split at once, about.
SLICE_BYTES = 1 << 22
#: Fixed value: the pre-tokenizer pattern of the vocabularies that the shortcuts hold for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters that no normalisation changes, and what the pattern above makes of them and of printable ASCII.
_LATIN = "ªµºÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(f"[^!-~{_LATIN}]|İ")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next free one."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _drops_space(file: dict) -> bool:
    """Whether the pipeline is: NFC, runs of space to one, lower case; parts by the pattern alone, then bytes."""
    normal = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": PATTERN}
        and (steps[0]["behavior"], steps[0]["invert"], steps[1]["add_prefix_space"]) == ("Removed", True, False)
        and not steps[1].get("use_regex", True)
        and file.get("post_processor") is None
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
    )


class WordEncoder:
    """``encode(texts, end_id)`` gives the ids of a batch of texts."""

    def __init__(self, path: str, slots: int = SLOTS):
        single_threaded()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.by_word = _drops_space(described)
        self.added = [t["content"] for t in described["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.letters = _byte_letters()
        self.parts: dict[str, list[int]] = {}
        self.shift = np.uint64(65 - slots.bit_length())
        self.first, self.second = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.held = np.zeros((slots, SLOT_IDS), np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.sizes = np.zeros(slots, np.uint8)
        self.turn = 0

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= MEMO_PARTS:
                self.parts.clear()
            mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[part] = [token.id for token in self.tokenize(mapped)]
        return ids

    def _word(self, word: str) -> list[int]:
        if _OTHER.search(word):
            return self._whole(word)
        parts = _PARTS.findall(word.lower())
        return self._part(parts[0]) if len(parts) == 1 else [i for part in parts for i in self._part(part)]

    def _ids_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has."""
        first, second = (pd.util.hash_array(words, hash_key=key, categorize=False) for key in ("first half of it", "and second of it"))
        slot = (first >> self.shift).astype(np.int64)
        here, beside = ((self.first[at] == first) & (self.second[at] == second) for at in (slot, slot ^ 1))
        known, slot = here | beside, np.where(here, slot, np.where(beside, slot ^ 1, slot ^ self.turn))
        self.turn ^= 1
        sizes, rows = self.sizes[slot].astype(np.int64), self.held[slot]
        long: dict[int, list[int]] = {}
        for k in np.flatnonzero(~known).tolist():
            ids = self._word(words[k]) if words[k] else []
            sizes[k] = len(ids)
            if len(ids) > SLOT_IDS:
                long[k] = ids
            else:
                rows[k, : len(ids)] = ids
        new = np.flatnonzero(~known & (sizes <= SLOT_IDS))
        new = new[np.unique(slot[new], return_index=True)[1]]
        self.first[slot[new]], self.second[slot[new]] = first[new], second[new]
        self.held[slot[new]], self.sizes[slot[new]] = rows[new], sizes[new]
        inside = np.arange(SLOT_IDS) < np.where(sizes > SLOT_IDS, 0, sizes)[:, None]
        if not long:
            return rows[inside].astype(np.uint32), sizes
        out, starts = np.empty(sizes.sum(), np.uint32), sizes.cumsum() - sizes
        out[(starts[:, None] + np.arange(SLOT_IDS))[inside]] = rows[inside]
        for k, ids in long.items():
            out[starts[k] : starts[k] + len(ids)] = ids
        return out, sizes

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, and how many each has."""
        lowered = pc.ascii_lower(pc.fill_null(texts, ""))
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(lowered, token.lower()).to_numpy(zero_copy_only=False)
        if special.any():
            lowered = pc.if_else(pa.array(special), "", lowered)
        words = pc.ascii_split_whitespace(lowered)
        ends = words.offsets.to_numpy()[1:]
        coded = words.values.dictionary_encode()
        of, sizes = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False))
        word = coded.indices.to_numpy()
        per_word = sizes[word]
        until = np.concatenate([[0], per_word.cumsum()])
        place = np.repeat((sizes.cumsum() - sizes)[word] - until[:-1], per_word)
        ids, upto = of[place + np.arange(until[-1])], until[ends]
        if special.any():
            each = np.split(ids, upto[:-1])
            for k in np.flatnonzero(special).tolist():
                each[k] = np.array(self._whole(texts[k].as_py()), np.uint32)
            ids, upto = np.concatenate(each), np.cumsum([len(e) for e in each])
        return ids, np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts one after the other, ``end_id`` after each, and how many each has.

        A null text has the end id alone.
        """
        if not self.by_word:
            each = [np.array(self._whole(t.as_py() or ""), np.uint32) for t in texts]
            found = [(np.concatenate([np.empty(0, np.uint32), *each]), np.array([len(e) for e in each], np.int64))]
        else:
            found = [self._slice(some) for some in slices(texts, SLICE_BYTES)]
        ids = np.concatenate([np.empty(0, np.uint32), *[i for i, _ in found]])
        sizes = np.concatenate([np.empty(0, np.int64), *[n for _, n in found]])
        return np.insert(ids, sizes.cumsum(), np.uint32(end_id)), sizes + 1


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary; later tasks of the same worker find it filled."""
    if path not in _encoders:
        _encoders.clear()  # a worker holds one at a time
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def release() -> None:
    """Give back the worker's memory; for tasks that need it for something else."""
    _encoders.clear()
