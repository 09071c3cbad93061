"""Packing of tokenised documents into windows by the sum-of-squares rule.

An online bin packer: N[h] windows are filled to level h, and a piece goes to the level whose choice gives the smallest sum of
N[h] squared afterwards. A new window counts as level 0, a full one as none; ties go to the fullest window. Documents longer
than a window first give whole windows; only their remainders are placed.

Each task packs the rows of its own partition, so texts aren't shuffled. The windows that it still holds open at its end, or
when it holds MOST_OPEN, are handed to a next step, which packs their pieces anew by the same rule, the largest first, in tasks of
about STEP_WINDOWS windows; and so on until one task is left, whose open windows are poured: those filled to within a SLACK-th stay as they
are, of the others the emptiest are cut to fill the gaps of the fullest. A step that doesn't halve its windows (equal sizes of
which no two fit together) is poured in its tasks. What a step closes is written to the shared folder.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed each
on its own; further columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import map_batches, written
from threatloom.llm.word_ids import loaded

WINDOW = 2048
END_ID = 1
#: Open windows that a task hands over, windows that a task of a later step packs, and the part of a window that may stay empty at the end.
MOST_OPEN, STEP_WINDOWS, SLACK = 4096, 4096, 64
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
STEP_SCHEMA = SCHEMA + ", open boolean"


class SumOfSquaresPacker:
    """Places pieces (doc_id, start, ids, tokens of the document); done holds the rows of windows that have left it."""

    def __init__(self, first_id: int, window: int = WINDOW):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array; level 0 is a new window
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level, the pieces of each open window
        self.n_open = self.poured = 0
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, whole = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for start in range(0, whole, self.window):
            self.leave([(doc_id, start, ids[4 * start : 4 * (start + self.window)], n)])
        if n > whole:
            self.place((doc_id, whole, ids[4 * whole :], n))

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        level = self.choose(size)
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        self.keep(pieces, level + size)
        if self.n_open >= MOST_OPEN:
            self.hand_over()

    def choose(self, size: int) -> int:
        """The level, of those at which a piece of this size fits, where it adds least to the sum of squares."""
        top = self.window - size
        after = 2 * self.count[size:] + 1  # one window more at the level that the piece leaves
        after[top] = 0  # a full window is no level
        change = after - 2 * self.count[: top + 1] + 1
        change[self.count[: top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = after[0]
        return top - int(np.argmin(change[::-1]))

    def keep(self, pieces: list, level: int) -> None:
        if level == self.window:
            self.leave(pieces)
        else:
            self.open[level].append(pieces)
            self.count[level] += 1
            self.n_open += 1

    def leave(self, pieces: list, still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.done.append((doc_id, start, len(ids) // 4, ids, n, self.next_id, offset, still_open))
            offset += len(ids) // 4
        self.next_id += 1

    def taken(self) -> list[list]:
        """The open windows, the fullest first; none is left."""
        every = [pieces for level in range(self.window - 1, 0, -1) for pieces in self.open[level]]
        self.count[:], self.n_open = 0, 0
        self.open = [[] for _ in range(self.window)]
        return every

    def hand_over(self) -> None:
        for pieces in self.taken():
            self.leave(pieces, still_open=True)

    def pour(self) -> None:
        """Closes all windows; of those that lack much, the emptiest are cut to fill the fullest."""
        fill = lambda pieces: sum(len(p[2]) // 4 for p in pieces)
        every = self.taken()
        while every and fill(every[0]) >= self.window - self.window // SLACK:
            self.leave(every.pop(0))
        self.poured += len(every)
        first, last, rest = 0, len(every) - 1, []
        while first <= last:
            pieces = every[first]
            level = fill(pieces)
            first += 1
            while level < self.window:
                if not rest:
                    if first > last:
                        break
                    rest = every[last]
                    last -= 1
                doc_id, start, ids, n = rest.pop()
                room = 4 * (self.window - level)
                pieces.append((doc_id, start, ids[:room], n))
                level += len(ids[:room]) // 4
                if ids[room:]:
                    rest.append((doc_id, start + room // 4, ids[room:], n))
            self.leave(pieces)
        if rest:
            self.leave(rest)

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def rows(done: list[tuple], most: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows in batches of a few MB."""
    names = [x.split(" ")[0] for x in STEP_SCHEMA.split(", ")]
    kinds = [{"ids": pa.binary(), "open": pa.bool_()}.get(n, pa.int64()) for n in names]
    for at in range(0, len(done), most):
        cols = zip(*((d, a, n, ids, all_, s, o, zlib.crc32(ids), open_) for d, a, n, ids, all_, s, o, open_ in done[at : at + most]), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)


def first_id(step: int) -> int:
    """Windows are numbered apart by step and task."""
    return step << 57 | TaskContext.get().partitionId() << 33


def next_step(step: int, window: int, pours: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the pieces of a task anew, the largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [p for b in batches for p in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)]
        pieces.sort(key=lambda p: (-len(p[2]), p[0] is not None, p[0] or 0, p[1], p[2]))
        packer = SumOfSquaresPacker(first_id(step), window)
        for piece in pieces:
            packer.place(piece)
        packer.pour() if pours else packer.hand_over()
        yield from rows(packer.take())

    return run


def pack(docs: DataFrame, path: str, *, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, with its ids (little-endian unsigned 32-bit), their CRC-32, and its place in a window."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        packer = SumOfSquaresPacker(first_id(0), window)
        for batch in batches:
            ids, counts = encoder.encode(batch.column(1))
            data, at = ids.tobytes(), 0
            for doc_id, n in zip(batch.column(0).to_pylist(), (4 * counts).tolist(), strict=True):
                packer.add(doc_id, data[at : at + n] + end)
                at += n
            yield from rows(packer.take())
        packer.hand_over()
        yield from rows(packer.take())

    step = written(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, STEP_SCHEMA), "packed-0")
    closed, number, before = [step.where("NOT open")], 0, math.inf
    while (windows := step.where("open AND offset = 0").count()) > 0:
        number += 1
        tasks = math.ceil(windows / STEP_WINDOWS)
        # The pieces are dealt out evenly, as their windows dissolve; the last, of STEP_WINDOWS windows at most, go to one task.
        left = step.where("open").select("doc_id", "start", "ids", "doc_tokens").repartition(tasks)
        step = written(map_batches(left, next_step(number, window, tasks == 1 or 2 * windows > before), STEP_SCHEMA), f"packed-{number}")
        closed.append(step.where("NOT open"))
        before = windows
    return reduce(DataFrame.unionByName, closed).drop("open")


def digests(packed: DataFrame) -> DataFrame:
    """The pieces without their ids, of which each row holds the checksum."""
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
