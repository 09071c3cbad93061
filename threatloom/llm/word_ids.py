"""Token ids of texts whose tokens never cross white space, with a table of words in numpy arrays.

A batch's bytes are cut into words at once. A word of up to SHORT bytes is its own key (its bytes and length in two 64-bit
numbers), looked up by open addressing for all words of the batch together; longer ones are kept in a dictionary. Words
that are not yet known are merged together: plain words, whose normal form is their lower case, by arrays, any others by the
tokenizer. A full table is emptied.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threatloom.llm.bpe import byte_alphabet
from threatloom.llm.merges import PLAIN, MergeTable, plain_pattern

#: Words in the table.
CAPACITY = 1 << 20
#: Bytes of a word that is its own key, and characters of a word that is merged together with others.
SHORT, LONG_WORD = 15, 256
#: Fixed: the tokenizer's split pattern, and the white space that its normaliser drops and no token crosses.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
GAPS = b" \t\r\n"
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordIds:
    """Encoder of one tokenizers JSON file of the kind that lower-cases, drops white space and marks word ends."""

    def __init__(self, path: str, capacity: int = CAPACITY):
        """Entries beyond the capacity, which one large batch may need, make the arrays larger for good."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = MergeTable(vocab, merges)
        alphabet = byte_alphabet()
        self.byte_ids = np.array([vocab[c] for c in alphabet], dtype=np.int32)
        self.end_ids = np.array([vocab[c + model["end_of_word_suffix"]] for c in alphabet], dtype=np.int32)
        self.parts = re.compile(plain_pattern(WORD_PATTERN) + "|\n")
        self.is_gap = np.zeros(256, dtype=bool)
        self.is_gap[list(GAPS)] = True
        self.capacity = capacity
        self.low, self.high = np.zeros(capacity, dtype=np.uint64), np.zeros(capacity, dtype=np.uint64)
        self.first, self.size = np.zeros(capacity, dtype=np.int64), np.zeros(capacity, dtype=np.int32)
        self.bits = max(4, int(2 * capacity - 1).bit_length())
        self.empty()

    def empty(self) -> None:
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.high[:] = 0
        self.n, self.n_ids = 0, 0
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.long: dict[bytes, int] = {}

    def merged(self, words: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n words, given with a line break between them, one after another, and how many each has."""
        if n and PLAIN.fullmatch(words) and "<|" not in words and (len(words) <= LONG_WORD or max(map(len, words.split("\n"))) <= LONG_WORD):
            return self.merged_plain(words)
        each = words.split("\n") if n else []
        plain = [i for i, w in enumerate(each) if len(w) <= LONG_WORD and PLAIN.fullmatch(w) and "<|" not in w]
        other = sorted(set(range(n)).difference(plain))
        ids: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * n
        for i, e in zip(other, self.tokenizer.encode_batch([each[i] for i in other], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, dtype="<u4")
        if plain:
            symbols, sizes = self.merged_plain("\n".join(each[i] for i in plain))
            for i, part in zip(plain, np.split(symbols, np.cumsum(sizes)[:-1]), strict=True):
                ids[i] = part
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=n)
        return (np.concatenate(ids) if n else np.zeros(0, dtype="<u4")), sizes

    def merged_plain(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words: all their parts, none of which holds a line break, are merged at once."""
        parts = self.parts.findall(words.lower())
        chars = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        buf = np.frombuffer("".join(parts).encode(), dtype=np.uint8)
        begins = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))  # of characters
        edges = begins[np.append(0, np.cumsum(chars))]
        starts = edges[:-1]
        breaks = buf[starts] == ord("\n")
        of_words = np.concatenate([[0], np.cumsum(~breaks)[breaks], [int((~breaks).sum())]])
        buf, ends = np.delete(buf, starts[breaks]), np.cumsum(np.diff(edges)[~breaks])
        symbols = self.byte_ids[buf]
        symbols[ends - 1] = self.end_ids[buf[ends - 1]]
        symbols, counts = self.table.merge(symbols, np.append(0, ends[:-1]) if len(ends) else ends)
        return symbols.astype("<u4"), np.diff(np.append(0, np.cumsum(counts))[of_words])

    def store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entries for these ids."""
        total = len(ids)
        if self.n_ids + total > len(self.ids):
            more = np.zeros(max(2 * len(self.ids), self.n_ids + total), dtype="<u4")
            more[: self.n_ids] = self.ids[: self.n_ids]
            self.ids = more
        self.ids[self.n_ids : self.n_ids + total] = ids
        if (more := self.n + len(sizes) - len(self.low)) > 0:
            self.low, self.high, self.first, self.size = (np.concatenate([a, np.zeros(more + len(a), a.dtype)]) for a in (self.low, self.high, self.first, self.size))
            self.grow()
        entries = np.arange(self.n, self.n + len(sizes))
        self.first[entries], self.size[entries] = self.n_ids + np.cumsum(sizes) - sizes, sizes
        self.n, self.n_ids = self.n + len(sizes), self.n_ids + total
        return entries

    def grow(self) -> None:
        """Twice as many slots until a third of them at most can be taken."""
        while len(self.slots) < 2 * len(self.low):
            self.bits += 1
            self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        keyed = np.flatnonzero(self.high[: self.n] > 0)  # a short word's length stands in its key
        self.insert(self.low[keyed], self.high[keyed], keyed)

    def home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _MIX ^ high * _MIX2
        h ^= h >> np.uint64(29)
        return (h * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key; -1 if there is none."""
        at = self.home(low, high)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            e = self.slots[at[wrong]]
            out[wrong] = e
            wrong = wrong[(e >= 0) & ((self.low[e] != low[wrong]) | (self.high[e] != high[wrong]))]
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> None:
        """Adds distinct keys that are not in the table."""
        self.low[entries], self.high[entries] = low, high
        at, todo = self.home(low, high), entries.astype(np.int32)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot the last stays
            left = self.slots[at] != todo
            at, todo = (at[left] + 1) & (len(self.slots) - 1), todo[left]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (little-endian unsigned 32-bit), and how many each text (null: none) has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, dtype=np.uint8)[offsets[0] : offsets[-1]] if whole is not None and len(texts) else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, dtype=np.int64)
        gap = self.is_gap[data]
        opens, closes = np.ones(len(data) + 1, dtype=bool), np.ones(len(data) + 1, dtype=bool)
        opens[1:-1], closes[:-2] = gap[:-1], gap[1:]
        opens[offsets], closes[offsets[1:][offsets[1:] > 0] - 1] = True, True
        starts, ends = np.flatnonzero(~gap & opens[:-1]), np.flatnonzero(~gap & closes[:-1]) + 1
        entries = self.entries(data, starts, ends - starts)
        counts = self.size[entries].astype(np.int64)
        total = np.append(0, np.cumsum(counts))
        shift = np.repeat(self.first[entries] - total[:-1], counts)
        shift += np.arange(len(shift))
        return self.ids[shift], np.diff(total[np.searchsorted(starts, offsets)])

    def entries(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each word; unknown ones are learnt."""
        out = np.empty(len(starts), dtype=np.int64)
        short, rest = np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT)
        low, high = np.zeros(len(short), dtype=np.uint64), sizes[short].astype(np.uint64) << np.uint64(56)
        begin, size = starts[short], sizes[short]
        left = np.arange(len(short))
        for k in range(SHORT):
            left = left[size[left] > k]
            if not len(left):
                break
            (low if k < 8 else high)[left] |= data[begin[left] + k].astype(np.uint64) << np.uint64(8 * (k % 8))
        found = self.find(low, high)
        names = [data[a : a + n].tobytes() for a, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)]
        new = np.flatnonzero(found < 0)
        order = new[np.lexsort((low[new], high[new]))]
        distinct = order[np.flatnonzero(np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])))] if len(order) else order
        unknown = list(set(names).difference(self.long))
        if self.n + len(distinct) + len(unknown) > self.capacity and self.n:
            self.empty()
            return self.entries(data, starts, sizes)
        if len(distinct):
            added = self.store(*self.merged(between_breaks(data, begin[distinct], size[distinct]), len(distinct)))
            self.insert(low[distinct], high[distinct], added)
            found[new] = self.find(low[new], high[new])
        if unknown:
            added = self.store(*self.merged(b"\n".join(unknown).decode("utf-8", "surrogatepass"), len(unknown)))
            self.long.update(zip(unknown, added.tolist(), strict=True))
        out[short] = found
        out[rest] = np.fromiter(map(self.long.__getitem__, names), dtype=np.int64, count=len(names))
        return out


def between_breaks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> str:
    """Pieces of UTF-8 data with a line break between them."""
    ends = np.cumsum(sizes + 1)
    at = np.repeat(starts - (ends - sizes - 1), sizes + 1) + np.arange(int(ends[-1]))
    out = data[np.minimum(at, len(data) - 1)]
    out[ends - 1] = ord("\n")
    return out[:-1].tobytes().decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def loaded(path: str) -> WordIds:
    """One encoder for each Python worker, with the words that it has learnt."""
    return WordIds(path)
