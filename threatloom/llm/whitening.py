"""Embedding whitening by a tiled covariance.

Vectors become integers, their sums per dimension give the mean, and each task cuts its centred rows
into blocks of ROW_BLOCK rows and TILE columns. A column block goes, under the number of its row
block, to every tile key (pair of column blocks) that it belongs to; there the two are multiplied.
Products are added up inside tasks before they are shuffled, and cell by cell after it. The assembled
matrix, as large as the vectors are wide squared, is decomposed on the driver; rows are then projected.
A second covariance, of the whitened values themselves, gives the error against the identity.

Defined cases: vectors that are null, empty, or hold a null or non-finite entry take no part. Rows with a
null vec_id count like others and come back under a null vec_id; repeated rows each count. Vectors of different
lengths are whitened apart, each length with its own fit. Entries saturate at LARGEST. A component is
left out if its eigenvalue is not above RANK times the largest (no variance to scale), so fewer than
32 may come back; a deviation beyond a 64-bit integer is null. Empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import map_batches
from threatloom.llm.ranked_search import flat

#: Rows and columns of a block.
ROW_BLOCK, TILE = 4096, 128
#: Fixed: how an entry becomes an integer.
SCALE, SHIFT = 64, 1_000_000
#: The largest value of an entry times SCALE.
LARGEST = float(1 << 52)
#: Least eigenvalue of a component, as a share of the largest.
RANK = 1e-13
PIECES = "width int, row_block long, block int, n_rows int, data binary"
PRODUCTS = "width int, ti int, tj int, data binary"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Fit:
    """What is known of the vectors of one width; components are columns, already divided by the root of their eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: as 64-bit integers where these hold it, else as Python's."""
        largest = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest < 1 << 62 else object
        return self.n * x.astype(kind) - np.array(self.sums, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components


def usable(vectors: DataFrame) -> DataFrame:
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~odd)


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, row numbers and integer vectors of a batch."""
    values, sizes = flat(batch.column(1))
    values, ends = values.to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
    x = np.floor(np.clip(values * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        at = (ends[rows] - width)[:, None] + np.arange(width)
        yield width, rows, x[at]


def moments(rows: DataFrame) -> dict[int, Fit]:
    """n and S of each width; as many rows come to the driver as the widths have dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = defaultdict(int)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, which, x in by_width(batch):
                n[width] += len(which)
                sums[width] = sums.get(width, 0) + x.sum(axis=0).astype(object)
        names = ["width", "dim", "n", "high", "low"]
        for width, s in sums.items():
            cols = [[width] * width, list(range(width)), [n[width]] * width, [int(v) >> 40 for v in s], [int(v) & (1 << 40) - 1 for v in s]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=names)

    parts = map_batches(rows, run, "width long, dim long, n long, high long, low long").groupBy("width", "dim").agg(F.sum("n"), F.sum("high"), F.sum("low"))
    found: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    for width, dim, n, high, low in parts.collect():
        found[width][dim] = (n, (high << 40) + low)
    return {width: Fit(dims[0][0], [dims[i][1] for i in range(width)]) for width, dims in found.items()}


def covariance(rows: DataFrame, fits: dict[int, Fit], values: Callable[[Fit, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each width, the covariance of values(fit, x), which are centred, over all rows."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[int, list[np.ndarray]] = defaultdict(list)

        def cut(width: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            z = np.concatenate(held.pop(width))
            for begin in range(0, len(z), ROW_BLOCK):
                part = z[begin : begin + ROW_BLOCK]
                for block in range(-(-z.shape[1] // TILE)):
                    data = np.ascontiguousarray(part[:, block * TILE : (block + 1) * TILE]).tobytes()
                    cols = [pa.array([width], pa.int32()), pa.array([number], pa.int64()), pa.array([block], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["width", "row_block", "block", "n_rows", "data"])
                number += 1

        for batch in batches:
            for width, _, x in by_width(batch):
                held[width].append(values(fits[width], x))
                if sum(map(len, held[width])) >= ROW_BLOCK:
                    yield from cut(width)
        for width in list(held):
            yield from cut(width)

    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        width, _, ti, tj = (k.as_py() for k in key)
        sides = {b: np.frombuffer(d, dtype=np.float64).reshape(n, -1) for b, n, d in zip(*(table[c].to_pylist() for c in ("block", "n_rows", "data")), strict=True)}
        tile = np.ascontiguousarray(sides[ti].T @ sides[tj]).tobytes()
        return pa.table({"width": pa.array([width], pa.int32()), "ti": pa.array([ti], pa.int32()), "tj": pa.array([tj], pa.int32()), "data": pa.array([tile], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[tuple(key)] = sums.get(tuple(key), 0) + np.frombuffer(data, dtype=np.float64)
        for (width, ti, tj), tile in sums.items():
            n = len(tile)
            cols = [pa.array(np.full(n, v), pa.int32()) for v in (width, ti, tj)] + [pa.array(np.arange(n), pa.int32()), pa.array(tile)]
            yield pa.RecordBatch.from_arrays(cols, names=["width", "ti", "tj", "cell", "v"])

    cut = map_batches(rows, pieces, PIECES)
    wide = {w: values(f, np.zeros((1, w), dtype=np.int64)).shape[1] for w, f in fits.items()}
    blocks = F.create_map(*[F.lit(x) for w, size in wide.items() for x in (w, -(-size // TILE))])[F.col("width")]
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    keyed = cut.withColumn("other", other).withColumn("ti", F.least("block", "other")).withColumn("tj", F.greatest("block", "other")).drop("other")
    products = keyed.groupBy("width", "row_block", "ti", "tj").applyInArrow(lambda key, part: multiply(key, part), PRODUCTS)
    cells = map_batches(products, added, "width int, ti int, tj int, cell int, v double").groupBy("width", "ti", "tj", "cell").agg(F.sum("v").alias("v"))
    out = {w: np.zeros((size, size)) for w, size in wide.items()}
    for width, ti, tj, cell, v in cells.collect():
        columns = min(TILE, wide[width] - tj * TILE)
        i, j = ti * TILE + cell // columns, tj * TILE + cell % columns
        out[width][i, j] = out[width][j, i] = v / fits[width].n
    return out


def decomposed(fit: Fit, v: np.ndarray, most: int) -> Fit:
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = np.flatnonzero((values > 0) & (values > RANK * values[0]))[:most]
    return replace(fit, components=vectors[:, some] / np.sqrt(values[some]), explained=values[some] / max(np.trace(v), 5e-324))


def whiten(vectors: DataFrame, *, most: int = 32) -> DataFrame:
    """A row for each usable vector and component."""
    rows = usable(vectors)
    fits = moments(rows)
    if not fits:
        return vectors.sparkSession.createDataFrame([], RESULT)
    found = covariance(rows, fits, Fit.centred)
    fits = {w: decomposed(f, found[w], most) for w, f in fits.items()}
    fits = {w: f for w, f in fits.items() if f.components.shape[1]}
    if not fits:
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows = rows.where(F.size("embedding").isin(list(fits)))
    again = covariance(rows, fits, Fit.whitened)
    fits = {w: replace(f, identity_error=float(np.abs(again[w] - np.eye(len(again[w]))).max())) for w, f in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in RESULT.split(", ")]
        for batch in batches:
            ids = batch.column(0)
            for width, which, x in by_width(batch):
                fit = fits[width]
                k, d = fit.components.shape[1], fit.deviations(x)
                if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * width >= float(1 << 62):
                    d = d.astype(object)
                deviation = [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]
                owner = pa.array(np.repeat(np.arange(len(which)), k))
                n = len(which) * k
                cols = [
                    ids.take(pa.array(which)).take(owner),
                    pa.array(np.tile(np.arange(1, k + 1), len(which)), pa.int32()),
                    pa.array(np.full(n, fit.n)),
                    pa.array(deviation, pa.int64()).take(owner),
                    pa.array(fit.whitened(x).ravel()),
                    pa.array(np.tile(fit.explained, len(which))),
                    pa.array(np.full(n, fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_batches(rows, run, RESULT)
