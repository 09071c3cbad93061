"""Token ids as grammar-compressed binary shards (Re-Pair).

Documents are ordered by id with a range shuffle and tokenised; each task cuts its documents into
shards of about SHARD_IDS ids. In a shard, pairs of neighbouring ids that occur often are replaced by
new symbols, round after round: all frequent pairs of a round at once, where two of them overlap the
more frequent one, until no round shortens the shard by LEAST_GAIN. Pairs don't cross documents. A
shard holds its rules, how many ids each rule and document expands to, and the shortened sequence; so
any range of ids is decoded from the symbols that cover it.

A written table is a folder with two Parquet tables: shards (one binary payload a row) and parts (how
many ids stand before each part, a row for each task of the writer). The payload, all little-endian:
MAGIC, eight unsigned 64-bit numbers (documents, ids, first new symbol, rules, symbols, bytes of a
symbol, CRC-32 of what follows, 0), then arrays: doc_id (int64), whether it is null (uint8), ids of each
document (uint64), left and right side of each rule (uint32), ids of each rule (uint64), the sequence
(uint16 or uint32), symbols of each document (uint64).

Defined cases: a null or empty text is its end id alone; a null doc_id stands before all others; rows
with one doc_id are ordered by a hash of their text, and equal rows stay beside each other as documents
of their own; a document lies in one shard whatever its length; further columns are ignored; an
empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.common import map_batches, shared_folder
from threatloom.llm.word_ids import loaded

END_ID = 1
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
#: A pair is frequent from so many occurrences in a shard, and a round is the last if it shortens the shard by a smaller share than this.
FREQUENT, LEAST_GAIN = 64, 1 / 64
MAGIC = b"REPAIR01"
HEAD = struct.Struct("<8Q")
_BITS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
SHARDS = "part int, shard int, start long, n_docs long, n_ids long, payload binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def frequent_pairs(pairs: np.ndarray) -> np.ndarray:
    """The pairs that occur FREQUENT times or more, the commonest first."""
    s = np.sort(pairs)
    some = np.unique(s[: len(s) - FREQUENT + 1][s[: len(s) - FREQUENT + 1] == s[FREQUENT - 1 :]]) if len(s) >= FREQUENT else s[:0]
    count = np.searchsorted(s, some, "right") - np.searchsorted(s, some, "left")
    return some[np.argsort(-count, kind="stable")]


def slots(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)


def chosen(pairs: np.ndarray, joined: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair is replaced, and the rank of that pair in common."""
    none = np.int32(len(common))
    rank_of, pair_of = np.full(1 << _BITS, none, dtype=np.int32), np.zeros(1 << _BITS, dtype=np.uint64)
    at = slots(common)[::-1]  # of pairs in one slot the commonest stays for this round
    rank_of[at], pair_of[at] = np.arange(len(common), dtype=np.int32)[::-1], common[::-1]
    at = slots(pairs)
    rank = np.where(joined & (pair_of[at] == pairs), rank_of[at], none)
    where = np.flatnonzero(rank < none)
    rank = rank[where]
    if not len(where):
        return where, rank
    # A stretch of one repeated pair (aaaa): every other one counts.
    beside = where[1:] == where[:-1] + 1
    same = np.append(False, beside & (rank[1:] == rank[:-1]))
    if same.any():
        order = np.arange(len(rank))
        even = (order - np.maximum.accumulate(np.where(same, 0, order))) % 2 == 0
        where, rank = where[even], rank[even]
        beside = where[1:] == where[:-1] + 1
    wins = np.ones(len(where), dtype=bool)
    wins[1:] &= ~(beside & (rank[:-1] < rank[1:]))
    wins[:-1] &= ~(beside & (rank[1:] < rank[:-1]))
    return where[wins], rank[wins]


def grammar(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The shortened sequence, its documents' ends in it, the rules (rows of two symbols) and the first new symbol."""
    first = int(ids.max(initial=0)) + 1
    symbols, rules, n_rules = ids.astype(np.uint32), [], 0
    last = np.zeros(len(symbols), dtype=bool)  # the last symbol of a document
    last[ends - 1] = True
    while len(symbols) >= FREQUENT:
        pairs = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
        joined = ~last[:-1]
        common = frequent_pairs(pairs[joined])
        if not len(common):
            break
        where, rank = chosen(pairs, joined, common)
        used = np.bincount(rank, minlength=len(common)) >= FREQUENT // 2
        keep = used[rank]
        where, rank = where[keep], rank[keep]
        if not len(where):
            break
        number = np.cumsum(used) - 1 + n_rules
        pair = common[used]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        symbols[where] = (first + number[rank]).astype(np.uint32)
        last[where] = last[where + 1]
        stay = np.ones(len(symbols), dtype=bool)
        stay[where + 1] = False
        gain = len(where) / len(symbols)
        symbols, last = symbols[stay], last[stay]
        n_rules += int(used.sum())
        if gain < LEAST_GAIN:
            break
    return symbols, np.flatnonzero(last) + 1, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32), first


def sizes_of(symbols: np.ndarray, rule_sizes: np.ndarray, first: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    out = np.ones(len(symbols), dtype=np.int64)
    new = symbols >= first
    out[new] = rule_sizes[symbols[new].astype(np.int64) - first]
    return out


def encoded(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The payload of a shard: the ids of all documents one after another, and how many each has, never none."""
    counts = counts.astype("<u8")
    symbols, ends, rules, first = grammar(ids, np.cumsum(counts).astype(np.int64))
    rule_sizes = np.ones(len(rules), dtype=np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        rule_sizes[r] = (rule_sizes[a - first] if a >= first else 1) + (rule_sizes[b - first] if b >= first else 1)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    body = b"".join(
        [
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
            counts.tobytes(),
            rules[:, 0].astype("<u4").tobytes(),
            rules[:, 1].astype("<u4").tobytes(),
            rule_sizes.astype("<u8").tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
            np.diff(ends, prepend=0).astype("<u8").tobytes(),
        ]
    )
    return MAGIC + HEAD.pack(len(doc_ids), len(ids), first, len(rules), len(symbols), width, zlib.crc32(body), 0) + body


class Shard:
    """A payload, open for reading."""

    def __init__(self, payload: bytes):
        if payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.n_docs, self.n_ids, self.first, n_rules, n_symbols, width, crc, _ = HEAD.unpack_from(payload, len(MAGIC))
        at = len(MAGIC) + HEAD.size
        if zlib.crc32(memoryview(payload)[at:]) != crc:
            raise ValueError("a shard of token ids is damaged")

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        ids, null = array("<i8", self.n_docs), array("u1", self.n_docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.counts = array("<u8", self.n_docs).astype(np.int64)
        self.left, self.right = array("<u4", n_rules), array("<u4", n_rules)
        self.rule_sizes = array("<u8", n_rules).astype(np.int64)
        self.symbols = array(f"<u{width}", n_symbols)
        self.symbol_counts = array("<u8", self.n_docs).astype(np.int64)
        self.starts = np.cumsum(self.rule_sizes) - self.rule_sizes
        self.expansions = self.expanded()
        #: The number of ids before each symbol.
        self.before = np.append(0, np.cumsum(sizes_of(self.symbols, self.rule_sizes, self.first)))

    def expanded(self) -> np.ndarray:
        """The ids of all rules, one after another; a rule's sides are ids or earlier rules."""
        out = np.zeros(int(self.rule_sizes.sum()), dtype="<u4")
        starts, ends, first = self.starts.tolist(), (self.starts + self.rule_sizes).tolist(), self.first
        for r, sides in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            at = starts[r]
            for s in sides:
                if s < first:
                    out[at] = s
                    at += 1
                else:
                    part = out[starts[s - first] : ends[s - first]]
                    out[at : at + len(part)] = part
                    at += len(part)
        return out

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids [begin, end) of the shard, from the symbols that cover them."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if begin >= end:
            return np.zeros(0, dtype="<u4")
        a, b = np.searchsorted(self.before, begin, "right") - 1, np.searchsorted(self.before, end, "left")
        symbols = self.symbols[a:b].astype(np.int64)
        sizes = np.diff(self.before[a : b + 1])
        out = np.repeat(symbols, sizes)
        new = np.flatnonzero(out >= self.first)
        offset = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[new] = self.expansions[self.starts[out[new] - self.first] + offset[new]]
        return out[begin - self.before[a] : len(out) - (self.before[b] - end)].astype("<u4")

    def document(self, number: int) -> np.ndarray:
        begin = int(self.counts[:number].sum())
        return self.ids(begin, begin + int(self.counts[number]))


def write(docs: DataFrame, path: str, folder: str, *, end_id: int = END_ID) -> str:
    """Writes the ids of all documents, in ascending order of doc_id, to the folder."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = loaded(path), TaskContext.get().partitionId()
        shard = start = held = 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        counts: list[int] = []

        def closed() -> pa.RecordBatch:
            payload = encoded(doc_ids, np.concatenate(parts), np.array(counts))
            cols = [[part], [shard], [start], [len(doc_ids)], [held], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split(" ")[0] for c in SHARDS.split(", ")])

        for batch in batches:
            plain, sizes = encoder.encode(batch.column(1))
            ends = np.cumsum(sizes + 1)
            ids = np.full(len(plain) + len(sizes), end_id, dtype="<u4")
            ids[np.delete(np.arange(len(ids)), ends - 1)] = plain
            at, names = 0, batch.column(0).to_pylist()
            while at < len(names):
                begin = int(ends[at] - sizes[at] - 1)
                # As many documents as a shard still takes, one at least.
                till = max(at + 1, int(np.searchsorted(ends, begin + SHARD_IDS - held, "left")) + 1)
                till = min(till, len(names))
                doc_ids += names[at:till]
                counts += (sizes[at:till] + 1).tolist()
                parts.append(ids[begin : ends[till - 1]])
                held += len(parts[-1])
                at = till
                if held >= SHARD_IDS:
                    yield closed()
                    shard, start, held, doc_ids, parts, counts = shard + 1, start + held, 0, [], [], []
        if doc_ids:
            yield closed()

    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").select("doc_id", "text")
    map_batches(ordered, run, SHARDS).write.parquet(f"{folder}/shards")
    # A row for each task of the writer, so the driver can add them up.
    totals = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/shards").groupBy("part").agg(F.sum("n_ids")).collect())
    before = np.cumsum([0] + [n for _, n in totals]).tolist()
    parts = [(part, first) for (part, _), first in zip(totals, before[:-1], strict=True)]
    spark.createDataFrame(parts, "part int, before long").coalesce(1).write.parquet(f"{folder}/parts")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(payload)
                ids, ends = shard.ids(), np.cumsum(shard.counts)
                offsets = pa.py_buffer(np.append(0, ends * 4).astype(np.int32).tobytes())
                data = pa.Array.from_buffers(pa.binary(), shard.n_docs, [None, offsets, pa.py_buffer(ids.tobytes())])
                cols = [pa.array(shard.doc_ids, pa.int64()), pa.array(first + ends - shard.counts), pa.array(shard.counts), data]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])

    parts = F.broadcast(spark.read.parquet(f"{folder}/parts"))  # a row for each task of the writer
    shards = spark.read.parquet(f"{folder}/shards").join(parts, "part").select((F.col("before") + F.col("start")).alias("first"), "payload")
    return map_batches(shards, run, DOCUMENTS)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Writes the documents' ids to a folder of their own and gives what its files say about each document."""
    spark = docs.sparkSession
    folder = write(docs, path, f"{shared_folder(spark)}/token-ids-{uuid4().hex}")
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
