"""Byte-level BPE by forced-boundary splitting.

A merge only ever joins bytes that stand side by side inside some vocabulary token. So a byte pair
that occurs inside no token marks a certain cut: no merge can cross it. Every word of the
pre-tokeniser's pattern is cut at those places, the fragments are encoded on their own, and their
ids are concatenated. Fragments and words repeat a lot, so a worker merges each once and remembers it.

Defined cases: a null text is empty; an empty text has no ids and decodes to an empty text; repeated
rows stay repeated; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import map_batches
from threatloom.llm.merges import PLAIN, MergeTable, plain_pattern

#: Fixed: the word pattern of byte-level BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a worker; when full, those not used since the last time are forgotten.
CACHE_WORDS = 250_000
#: Bytes of a fragment that is merged on its own.
LONG_FRAGMENT = 256


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of one tokenizers JSON file of the byte-level BPE kind."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.to_char = dict(enumerate(byte_alphabet()))
        to_byte = {c: b for b, c in self.to_char.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        #: Pairs that stand inside some token; every other pair is a certain cut.
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in bytes_of.values():
            self.joined[list(token[:-1]), list(token[1:])] = True
        bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.lengths = np.array([len(bytes_of.get(i, b"")) for i in range(max(bytes_of) + 1)], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(len(self.lengths))), dtype=np.uint8)
        self.byte_ids = np.array([vocab[self.to_char[b]] for b in range(256)], dtype=np.int32)
        self.merger = Tokenizer(models.BPE(vocab, merges))
        self.table = MergeTable(vocab, merges)
        self.words, self.plain_words = regex.compile(WORD_PATTERN), re.compile(plain_pattern(WORD_PATTERN))
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fragments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes, and where fragments start: at each word and inside every pair that no token holds."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
        cut = np.ones(len(buf), dtype=bool)
        cut[1:] = ~self.joined[buf[:-1], buf[1:]]
        cut[np.cumsum([0, *map(len, raw[:-1])])] = True
        return buf, np.flatnonzero(cut)

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not yet known, all fragments at once."""
        buf, starts = self.fragments(words)
        sizes = np.diff(np.append(starts, len(buf)))
        if (sizes > LONG_FRAGMENT).any():  # by a heap, as each round would pass over all of it
            shown = buf.tobytes().decode("latin-1").translate(self.to_char)
            ids = [e.ids for e in self.merger.encode_batch([shown[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])]
            symbols, counts = np.fromiter(chain.from_iterable(ids), dtype=np.int32), np.array(list(map(len, ids)))
        else:
            symbols, counts = self.table.merge(self.byte_ids[buf], starts)
        ends = np.append(0, np.cumsum(counts))
        word_ends = np.cumsum([0, *(len(w.encode("utf-8", "surrogatepass")) for w in words)])
        at = (ends[np.searchsorted(starts, word_ends)] * 4).tolist()
        data = symbols.astype("<i4").tobytes()
        self.known.update((w, data[a:b]) for w, (a, b) in zip(words, pairwise(at), strict=True))

    def split_words(self, text: str) -> list[str]:
        """The words of the pattern, and each special token on its own."""
        if self.split and (parts := self.split.split(text))[1:]:
            return [w for p in parts for w in ([p] if p in self.special else self.split_words(p))]
        return (self.plain_words if PLAIN.fullmatch(text) else self.words).findall(text)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.split_words(t) for t in texts]
        if missing := set(chain.from_iterable(words)).difference(self.known):
            if len(self.known) + len(missing) > CACHE_WORDS:
                self.known, self.older = {}, self.known
                missing = set(chain.from_iterable(words))
            self.known.update((s, np.array([i], dtype="<i4").tobytes()) for s, i in self.special.items())
            self.known.update((w, self.older[w]) for w in missing & self.older.keys())
            if new := list(missing - self.known.keys()):
                self.learn(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, w)), dtype="<i4") for w in words]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Joins the bytes of the ids; bytes that form no character become U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        lengths = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.blob[np.arange(len(shift)) + shift].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> ForcedBoundaryBPE:
    """One encoder for each Python worker, with what it has learnt."""
    return ForcedBoundaryBPE(path)


def lists(arrays: list[np.ndarray], kind: type = np.int32) -> pa.Array:
    """A list column of one array for each row."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind, copy=False)))


def encode(docs: DataFrame, path: str, *, decoded: bool = False) -> DataFrame:
    """doc_id, ids and, if asked for, the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = bpe.encode_all([t or "" for t in batch.column(1).to_pylist()])
            cols = [batch.column(0), lists(ids)]
            if decoded:
                cols.append(pa.array([bpe.decode(x) for x in ids], type=pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)])

    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of ids; a null list is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "decoded"])

    return map_batches(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), run, "doc_id long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The digest row of each document, from the ids and the text that encode() gives."""
    return encode(docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
