"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Every string of WINDOW bytes that starts at two places anywhere is found, and all bytes that such strings
cover are removed from every text.

1. A window of WINDOW bytes is keyed by the smallest hash of the ANCHOR bytes strings inside it. Consecutive windows of
   one key make a piece; so each window of a text lies in one piece, and equal windows lie in pieces of one key. Keys
   whose string stands once only can't hold a repeated one: their pieces are never cut out.
2. One text of each group of equal ones is cut into the other pieces, which are dealt by key to shards of a bounded
   number of bytes. In a shard equal pieces become one, counted twice; those that share too few bytes around the key's
   string with any other place are left out; the suffix array of the rest is built by induced sorting, and
   permuted common prefixes give the runs of suffixes that share WINDOW bytes. A run of two places marks its windows.
3. The pieces of a key that stands at more than HOT_PIECES places (at a passage in very many texts) would not fit in a
   shard. Equal ones are merged by a pre-aggregated grouping first; the others are cut into parts of STEP windows,
   keyed by all bytes that these windows share (the bytes beside the anchor), and dealt to suffix-array shards by this
   longer key. A part whose longer key is still too common (where such a passage ends) is cut into its single
   windows, where no suffix is left to sort: equal windows are grouped by 128-bit hash.
4. Spans are joined to texts, merged and cut out.

Defined cases: a null text is empty; texts shorter than WINDOW bytes lose nothing; equal texts of at least WINDOW bytes lose
all bytes; repeated rows are equal texts; rows with a null doc_id count like others; a text of any length and any period is
read in slices of SLICE windows and gives a piece for WINDOW - ANCHOR + 1 windows at least; an empty table gives
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import heavy_join, map_batches, reliable, written
from threatloom.llm.suffix_array import permuted_common_prefixes, suffix_array

WINDOW = 200
ANCHOR = 48
#: Bytes of the pieces of a shard, on average; places of one key that may meet in one.
SHARD_BYTES, HOT_PIECES = 1_000_000, 4_000
#: The marks of so many texts that hold hot pieces are sent to where the texts lie; more are joined by a shuffle.
SENT_TEXTS = 200_000
#: Windows in a part of a hot piece.
STEP = 13
#: Windows of a text that are hashed at once, and bytes of pieces in one Arrow batch.
SLICE, OUT_BYTES = 1 << 18, 8 << 20
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)
_M1 = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's first n powers and those of its inverse."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, np.uint64(m), dtype=np.uint64))) for m in (int(_M1), pow(int(_M1), -1, 1 << 64)))


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of size bytes; polynomial, so any size takes one pass over prefix sums."""
    n = len(buf)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(1 << n.bit_length())
    sums = np.append(np.uint64(0), np.cumsum(_BYTES[buf] * up[:n]))
    h = (sums[size:] - sums[: n - size + 1]) * down[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def smallest_of_windows(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive hashes."""
    blocks = np.append(h, np.full(-len(h) % w, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(h) - w + 1], left[w - 1 : len(h)])


def stands_again(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are the hash of several strings of h. A table of 16-bit remainders leaves few hashes to compare."""
    table = np.zeros(1 << 16, dtype=bool)
    table[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    near = np.sort(h[table[(h & np.uint64(0xFFFF)).astype(np.int64)]])
    return np.isin(keys, near[1:][near[1:] == near[:-1]])


def cut(buf: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's pieces: runs of windows of one key, of as many as can hold one anchor at most.

    Keys, starts, sizes, and whether the key's string stands again nearby, so that windows of one piece may be equal.
    """
    out: list[list[np.ndarray]] = [[], [], [], []]
    longest = window - ANCHOR + 1
    for at in range(0, max(0, len(buf) - window + 1), SLICE):
        h = gram_hashes(buf[at : at + SLICE + window - 1], ANCHOR)
        low = smallest_of_windows(h, longest)
        begin = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        again = stands_again(h, low[begin])
        length = np.diff(np.append(begin, len(low)))
        parts = -(-length // longest)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(begin, parts) + inner * longest
        last = np.minimum(first + longest, np.repeat(begin + length, parts))
        for c, v in zip(out, (low[first].view(np.int64), first + at, last - first + window - 1, np.repeat(again, parts)), strict=True):
            c.append(v)
    return tuple(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out)


def content_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("other"), text).alias("k2")]


def keyed(docs: DataFrame) -> DataFrame:
    """id, k1, k2, text of every row; a null text is empty, a null doc_id is NO_ID."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    return rows.select("id", *content_key(F.col("text")), "text")


def key_rows(texts: DataFrame, window: int) -> DataFrame:
    """The keys of all windows: id, k1 of the text; fp, start and size of the piece; again if the key's string stands again nearby."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut(np.frombuffer(t.encode(), dtype=np.uint8), window) for t in batch.column(2).to_pylist()]
            counts = [len(f[0]) for f in found]
            keys = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), counts).astype(np.int64), pa.int64()) for i in (0, 1)]
            rest = [pa.array(np.concatenate([f[i] for f in found]) if found else [], pa.int64()) for i in range(3)]
            again = pa.array(np.concatenate([f[3] for f in found]).astype(bool) if found else [], pa.bool_())
            yield pa.RecordBatch.from_arrays([*keys, *rest, again], names=["id", "k1", "fp", "start", "size", "again"])

    return map_batches(texts.select("id", "k1", "text"), run, "id long, k1 long, fp long, start long, size long, again boolean")


def piece_rows(texts: DataFrame) -> DataFrame:
    """The bytes of pieces. texts: id, k1, text, marks array<struct<fp, start, size, again>>."""
    names = ["id", "k1", "fp", "start", "again", "piece"]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(3)
            edges = marks.offsets.to_numpy()
            fps, starts, sizes, again = (marks.values.field(n).to_numpy(zero_copy_only=False).tolist() for n in ("fp", "start", "size", "again"))
            rows, held = [], 0
            for i, (ident, k1, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                raw = text.encode()
                for j in range(edges[i], edges[i + 1]):
                    rows.append((ident, k1, fps[j], starts[j], again[j], raw[starts[j] : starts[j] + sizes[j]]))
                    held += sizes[j]
                    if held > OUT_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
            yield batch_of(rows)

    return map_batches(texts.select("id", "k1", "text", "marks"), run, "id long, k1 long, fp long, start long, again boolean, piece binary")


def shares_core(pieces: list[bytes], keys: np.ndarray, window: int) -> np.ndarray:
    """Which pieces may hold a window that stands at two places; all others hold none.

    Equal windows hold their key's string equally far from their start, so they share all bytes that any windows with it
    STEP places further or less hold. A piece none of whose strings of these bytes stands again need not be sorted.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    buf, first = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(sizes) - sizes
    h = gram_hashes(buf, ANCHOR).view(np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(h)]
    spot = np.flatnonzero((h == keys[owner]) & (np.arange(len(h)) + ANCHOR <= (first + sizes)[owner]))
    owner = owner[spot]
    up, down = _powers(1 << len(buf).bit_length())
    sums = np.append(np.uint64(0), np.cumsum(_BYTES[buf] * up[: len(buf)]))
    out = np.zeros(len(pieces), dtype=bool)
    for least in range(0, window - ANCHOR + 1, STEP):
        most = min(least + STEP - 1, window - ANCHOR)
        fits = (spot - least >= first[owner]) & (spot - most + window <= (first + sizes)[owner])
        begin, end = spot[fits] - least, spot[fits] - most + window
        _, core, places = np.unique((sums[end] - sums[begin]) * down[begin], return_inverse=True, return_counts=True)
        out[owner[fits][places[core] > 1]] = True
    return out


def repeats_of_shard(pieces: list[bytes], many: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of different pieces that stand at two places, merged to ranges: piece, start and end in it.

    many: pieces that stand at several places themselves. All others stand at one, and no window stands in two pieces.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    # Bytes are 2 to 257, 1 ends each piece, 0 ends the whole.
    s = np.frombuffer(b"\0".join([*pieces, b""]), dtype=np.uint8).astype(np.int64) + 2
    s[first + sizes] = 1
    s = np.append(s, 0)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    inner = np.arange(len(owner)) - first[owner]
    sa = suffix_array(s, 258)
    plcp = permuted_common_prefixes(s, sa, 1, 2 * window)
    sa = sa[1:]
    run = np.cumsum(plcp[sa] < window)  # a new run where fewer bytes are shared with the suffix before
    fits = sizes[owner[sa]] - inner[sa] >= window
    sa, run = sa[fits], run[fits]
    places = np.bincount(run, 1 + many[owner[sa]])
    hit = np.sort(sa[places[run] > 1])
    fresh = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))[: len(hit)]
    begin, end = hit[fresh], hit[np.append(fresh[1:], True)[: len(hit)]]
    return owner[begin], inner[begin], inner[end] + window


def spans_of_shard(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """id, k1, a, z: the repeated ranges of the texts whose pieces (id, k1, fp, start, again, piece) lie in the shard."""
    rows = rows.drop_duplicates(["id", "k1", "start"])
    kind, pieces = pd.factorize(rows["piece"])
    of_kind = np.bincount(kind, minlength=len(pieces))
    # Where all pieces of a key are equal there is nothing to sort: they share all their windows.
    key_of_kind = np.zeros(len(pieces), dtype=np.int64)
    key_of_kind[kind] = rows["fp"].to_numpy()
    again = np.zeros(len(pieces), dtype=bool)
    again[kind] = rows["again"].to_numpy().astype(bool)
    _, key, kinds = np.unique(key_of_kind, return_inverse=True, return_counts=True)
    sort = np.flatnonzero((kinds[key] > 1) | again)
    sort = sort[(of_kind[sort] > 1) | shares_core([pieces[i] for i in sort], key_of_kind[sort], window)]
    equal = np.flatnonzero((kinds[key] == 1) & ~again & (of_kind > 1))
    who, a, z = repeats_of_shard([pieces[i] for i in sort], of_kind[sort] > 1, window) if len(sort) else (np.zeros(0, dtype=np.int64),) * 3
    who, a, z = np.append(sort[who], equal), np.append(a, np.zeros(len(equal), dtype=np.int64)), np.append(z, [len(pieces[i]) for i in equal]).astype(np.int64)
    # Each range of a kind of piece goes to all pieces of this kind.
    order = np.argsort(kind, kind="stable")
    n = of_kind[who]
    first = np.repeat((np.cumsum(of_kind) - of_kind)[who] - (np.cumsum(n) - n), n)
    at = order[first + np.arange(n.sum())]
    start = rows["start"].to_numpy()[at]
    return pd.DataFrame({"id": rows["id"].to_numpy()[at], "k1": rows["k1"].to_numpy()[at], "a": start + np.repeat(a, n), "z": start + np.repeat(z, n)})


def in_shards(rows: DataFrame, key: str, size: float, fn, schema: str) -> DataFrame:
    """Deals rows of size bytes by key to shards of SHARD_BYTES on average and applies fn to each."""
    shards = max(1, math.ceil(size / SHARD_BYTES))
    return rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards))).groupBy("shard").applyInPandas(fn, schema)


def part_rows(kinds: DataFrame, window: int, step: int) -> DataFrame:
    """Parts of hot pieces (ph, piece, many): consecutive windows whose anchor lies equally far, up to step windows.

    g: the hash of all bytes that any windows so far from the anchor share, so equal windows get one g. The anchor
    of a window is the last smallest hash in it, which depends on its bytes alone.
    """
    names = ["g", "part", "sh", "ph", "a0", "many"]

    def parts(piece: bytes) -> Iterator[tuple[bytes, bytes, int]]:
        buf = np.frombuffer(piece, dtype=np.uint8)
        w = window - ANCHOR + 1
        h = np.lib.stride_tricks.sliding_window_view(gram_hashes(buf, ANCHOR), w)
        far = w - 1 - h[:, ::-1].argmin(1)  # from the window's start to its anchor
        spot = np.arange(len(far)) + far
        fresh = np.flatnonzero(np.append(True, (spot[1:] != spot[:-1]) | (far[1:] // step != far[:-1] // step)))
        for i, z in zip(fresh.tolist(), [*fresh[1:].tolist(), len(far)], strict=True):
            least = int(far[i]) // step * step
            core = piece[int(spot[i]) - least : int(spot[i]) - least - step + 1 + window]
            yield hashlib.md5(b"%d:" % (least // step) + core).digest(), piece[i : z - 1 + window], i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ph, piece, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(g, part, hashlib.md5(part).digest(), ph, at, many) for g, part, at in parts(piece)]
                types = [pa.binary()] * 4 + [pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_batches(kinds.select("ph", "piece", "many"), run, "g binary, part binary, sh binary, ph binary, a0 long, many boolean")


def hot_spans(pieces: DataFrame, window: int) -> DataFrame:
    """The same as spans_of_shard for pieces of hot keys: id, k1, a, z."""
    pieces = written(pieces.withColumn("ph", F.unhex(F.md5("piece"))), "hot-pieces")
    place, count = F.xxhash64("id", "k1", "start"), F.count(F.lit(1)).alias("n")
    kinds = reliable(pieces.groupBy("ph").agg(F.first("piece").alias("piece"), (F.min(place) != F.max(place)).alias("many"), count))
    parts = written(part_rows(kinds, window, STEP), "hot-parts")
    different = parts.groupBy("g", "sh").agg(F.first("part").alias("part"), (F.max("many") | (F.count(F.lit(1)) > 1)).alias("many"), count)
    different = written(different, "hot-kinds")
    common = different.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.max("many").alias("any"), count).where("kinds > 1 OR any")
    meeting = heavy_join(different.drop("n"), reliable(common.select("g", "kinds", "n")), ["g"], different.count())

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        who, a, z = repeats_of_shard(list(rows["part"]), rows["many"].to_numpy().astype(bool), window)
        return pd.DataFrame({"sh": rows["sh"].to_numpy()[who], "a": a, "z": z})

    few, size = meeting.where(F.col("kinds") <= HOT_PIECES), F.sum(F.length("part"))
    found = in_shards(few.select("g", "sh", "part", "many"), "g", few.agg(size).first()[0] or 0, shard, "sh binary, a long, z long")
    windows = meeting.where(F.col("kinds") > HOT_PIECES).select("sh", "part", "many", F.explode(F.sequence(F.lit(0), F.length("part") - window)).alias("a"))
    windows = windows.select("sh", "many", F.col("a").cast("long").alias("a"), F.md5(F.expr(f"substring(part, a + 1, {window})")).alias("wh"))
    twice = reliable(windows.groupBy("wh").agg((F.max("many") | (F.count(F.lit(1)) > 1)).alias("twice"), count).where("twice").select("wh", "n"))
    alone = heavy_join(windows, twice, ["wh"], windows.count()).select("sh", "a", (F.col("a") + window).alias("z"))

    # Ranges of a part go to the kinds of pieces that hold it, theirs to the pieces; each key has few ranges, if many rows.
    of_part = found.unionByName(alone).groupBy("sh").agg(F.collect_list(F.struct("a", "z")).alias("ranges"))
    of_part = reliable(of_part.join(different.groupBy("sh").agg(F.max("n").alias("n")), "sh"))
    inner = heavy_join(parts.select("sh", "ph", "a0"), of_part, ["sh"], parts.count()).select("ph", "a0", F.inline("ranges"))
    of_piece = inner.groupBy("ph").agg(F.collect_list(F.struct((F.col("a0") + F.col("a")).alias("a"), (F.col("a0") + F.col("z")).alias("z"))).alias("ranges"))
    of_piece = reliable(of_piece.join(kinds.select("ph", "n"), "ph"))
    spans = heavy_join(pieces.select("id", "k1", "start", "ph"), of_piece, ["ph"], pieces.count()).select("id", "k1", "start", F.inline("ranges"))
    return spans.select("id", "k1", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("z")).alias("z"))


def repeated_spans(large: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """id, k1 and spans array<struct<a, z>> of each of texts (id, k1, k2: one row for each different text of large)."""
    found = written(key_rows(large, window), "keys")
    place = F.xxhash64("k1", "start")
    twice = found.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("again").alias("again"), F.count(F.lit(1)).alias("n"))
    twice = reliable(twice.where("lo <> hi OR again").select("fp", "n", (F.col("n") > HOT_PIECES).alias("hot")))
    marks = heavy_join(found, twice, ["fp"], found.count())
    marks = written(marks.join(texts.select("id", "k1"), ["id", "k1"], "left_semi"), "marks")
    size = {r["hot"]: r["size"] for r in marks.groupBy("hot").agg(F.sum("size").alias("size")).collect()}

    def pieces(hot: bool) -> DataFrame:
        of_text = marks.where(F.col("hot") == hot).groupBy("id", "k1").agg(F.collect_list(F.struct("fp", "start", "size", "again")).alias("marks"))
        wanted = texts.join(of_text, ["id", "k1"])
        if hot:  # a query of its own, which else shuffles all texts once more
            wanted = reliable(wanted)
            wanted = F.broadcast(wanted) if wanted.count() <= SENT_TEXTS else wanted
        return piece_rows(large.join(wanted, ["id", "k1", "k2"]))

    spans = in_shards(pieces(False), "fp", size.get(False, 0), lambda pdf: spans_of_shard(pdf, window), "id long, k1 long, a long, z long")
    if True in size:
        spans = spans.unionByName(hot_spans(pieces(True), window))
    return spans.groupBy("id", "k1").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def without_spans(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of rows doc_id, text, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, kept, end, removed, n = text.encode(), [], 0, 0, 0
                merged: list[list[int]] = []
                for a, z in sorted((s["a"], s["z"]) for s in found or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(z, merged[-1][1])
                    else:
                        merged.append([a, z])
                for a, z in merged:
                    kept.append(raw[end:a])
                    removed, n, end = removed + z - a, n + 1, z
                out.append((len(raw), removed, n, b"".join([*kept, raw[end:]])))
            cols = list(zip(*out, strict=True)) or [[] for _ in range(4)]
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(rows.select("doc_id", "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay), one row for each row of docs."""
    rows = keyed(docs)
    large, n = rows.where(F.octet_length("text") >= window), F.octet_length("text").cast("long")
    ledger = written(large.select("id", "k1", "k2", n.alias("n")), "texts")
    groups = reliable(ledger.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    spans = repeated_spans(large, groups.drop("copies"), window)

    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    none = F.lit(0).cast("long")
    short = rows.where(F.octet_length("text") < window).select(doc_id, n.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    # A text that stands twice is wholly covered. Copies need no text, so a large group of them moves as narrow rows.
    copies = heavy_join(ledger, groups.where("copies > 1").select("k1", "k2", "copies"), ["k1", "k2"], ledger.count(), "copies")
    copies = copies.select(doc_id, F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    single = groups.where("copies = 1").select("id", "k1", "k2").join(spans, ["id", "k1"], "left")
    single = without_spans(large.join(single, ["id", "k1", "k2"]).select(doc_id, "text", "spans"))
    return short.unionByName(copies).unionByName(single)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
