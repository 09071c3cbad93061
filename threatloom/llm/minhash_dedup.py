"""Near-duplicates by bottom-k sketches of one hash function.

1. A text's set holds a 64-bit hash of each distinct shingle of words. Its sketch is the k smallest
   hashes. Texts with equal sets (128-bit digest and size) are one class with one representative.
2. Inverted lists: a class is listed under some of its retained values. Two sets with similarity t or
   more share, up to chance, at least a t part of the k smallest hashes of their union. So with all values
   ordered by frequency, rarest first, they meet in a list of the first p values of each, where p leaves
   out fewer values than they must share (for whole sets p is exact; for k = 64 and 0.85 the chance
   that more than 31 of 64 are not shared is below 1e-10 a pair). Values that stand in one class only
   take up places but make no list, so ordinary texts, even with a common passage, are in no list at all.
3. In each list, every member is paired with a leader, in a long list with several (stars, linear in the list). Leaders
   are the members with the fewest values of one class only, that is, those least edited, so they link with most others.
   The union-sketch estimate drops pairs that can't reach t; the rest are verified on full sets. Components of these links follow.
4. Members of a list outside its largest component are compared with all members of other components: by a join where the
   list is short; where it is long, in blocks of bounded size, once for all long lists with the same largest component.
   There a pair is dropped if even the values that each shares with any member of a long list are too few for t (exact), or by the
   estimate, or if the block has already connected its components; the rest are verified on full sets on the spot. Pairs within a component are already connected, so no connection between texts is lost.
5. Components of the further links, over those found before, are found by minimum labels; a text has the component of its class.

Words are what stands between the six ASCII white-space characters after A-Z is lower-cased. A text
with fewer words than a shingle has its whole sequence as its only shingle; without words or text
the set is empty and links with nothing. Equal texts link with each other. Rows with a null doc_id
are kept and link with nothing; rows that share a doc_id are one node. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.bpe import lists
from threatloom.llm.common import lower_ascii_py, map_batches, reliable
from threatloom.llm.components import components

SKETCH = 64
#: Standard deviations by which a list prefix exceeds the expected number of values not shared.
MARGIN = 7.5
#: The estimate drops a pair only if it lies so many standard deviations below the threshold.
SLACK = 6.0
#: Members of a list that is joined with itself in step 4; longer lists are compared in blocks.
SHORT_LIST = 32
#: Members of a long list that all its members are paired with in step 3.
LEADERS = 3
#: Members, and values of their full sets, in a block.
BLOCK, BLOCK_VALUES = 4_000, 1_000_000
#: So many ids of listed texts are sent to where the texts lie; more are joined by a shuffle.
BROADCAST_IDS = 500_000
SPACE = re.compile(r"[\x20\x09-\x0D]+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class ShingleHasher:
    """64-bit hashes of the distinct word shingles of a text, ascending, with a bounded memory of words."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = [w for w in SPACE.split(lower_ascii_py(text)) if w]
        if not words:
            return np.zeros(0, dtype=np.int64)
        known = self.known
        h = np.fromiter((known[w] if w in known else self.of_word(w) for w in words), dtype=np.uint64, count=len(words))
        n = min(self.words, len(h))
        mixed = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            mixed = (mixed ^ h[i : len(h) - n + 1 + i]) * _MULTIPLIERS[i % 5]
            mixed ^= mixed >> np.uint64(29)
        return np.unique((mixed * _MULTIPLIERS[1]).view(np.int64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(words)
        for batch in batches:
            sets = [hasher(t) for t in batch.column(1).to_pylist()]
            digest = [hashlib.md5(s.tobytes()).digest() for s in sets]
            cols = [batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), lists([s[:SKETCH] for s in sets], np.int64)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "digest", "sketch"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(words)
        for batch in batches:
            sets = [hasher(t) for t in batch.column(1).to_pylist()]
            digest = [hashlib.md5(s.tobytes()).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "digest", "full"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "rep long, digest binary, full binary")


def shared_values(sets: DataFrame) -> DataFrame:
    """rep and lone: how many values of each full set stand in no other of these sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1)]
            reps = np.repeat(batch.column(0).to_numpy(), list(map(len, full)))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(np.concatenate(full) if full else [], pa.int64())], names=["rep", "v"])

    values = map_batches(sets.select("rep", "full"), run, "rep long, v long").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep"))
    return values.where("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("lone"))


def prefix_length(size: int, percent: int) -> int:
    """Values of a sketch of this size under which a class is listed."""
    miss = 1 - percent / 100
    if size <= SKETCH * percent // 100:  # both sets lie whole in their sketches
        return size - math.ceil(size * percent / 100) + 1
    return min(size, math.ceil(size * miss + MARGIN * math.sqrt(size * miss * (1 - miss))) + 1)


def may_link(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """The union-sketch estimate: False only where similarity can't, up to chance, reach the threshold."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    union = np.union1d(a, b)
    whole = n_a <= SKETCH and n_b <= SKETCH
    union = union if whole else union[:SKETCH]
    shared = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True))
    t, m = percent / 100, len(union)
    return shared >= (t * m if whole else t * m - SLACK * math.sqrt(m * t * (1 - t)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b): those that pass the estimate and, on full sets, the threshold. A full set begins with its sketch."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (c.to_pylist() for c in batch.columns[2:4])
            sa, sb = ([np.frombuffer(z.as_buffer(), dtype=np.int64) for z in c] for c in batch.columns[4:])
            keep = [may_link(x, y, i, j, percent) for x, y, i, j in zip(sa, sb, na, nb, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.int64) for z in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left, right = (sets.select(F.col("rep").alias(x), (F.length("full") / 8).cast("long").alias("n" + x), F.substring("full", 1, 8 * SKETCH).alias("s" + x)) for x in "ab")
    likely = map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb"), estimate, "a long, b long")
    full_a, full_b = (sets.select(F.col("rep").alias(x), F.col("full").alias("f" + x)) for x in "ab")
    return map_batches(likely.join(full_a, "a").join(full_b, "b").select("a", "b", "fa", "fb"), exact, "a long, b long")


def long_list_links(rest: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between components under one core, verified on full sets: rows of rest against all members, block by block.

    Both sides: core, rep, comp, shared, full. A block gives no link between components that its links already connect.
    """

    def dealt(rows: DataFrame, own: str) -> DataFrame:
        n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("full") / 8) / BLOCK_VALUES)).cast("int")
        return rows.groupBy("core").agg(n.alias(own + "s"))

    counts = dealt(rest, "rb").join(dealt(members, "mb"), "core")
    of = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.join(counts, "core").withColumn("rb", of("rbs")).withColumn("mb", every("mbs")).drop("rbs", "mbs")
    right = members.join(counts, "core").withColumn("mb", of("mbs")).withColumn("rb", every("rbs")).drop("rbs", "mbs")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, apart from the left side's

    def compare(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        top: dict[int, int] = {}

        def find(c: int) -> int:
            while top.get(c, c) != c:
                c = top[c] = top.get(top[c], top[c])
            return c

        if len(some) and len(others):
            full = [np.frombuffer(x, dtype=np.int64) for x in others["full"]]
            posts = np.concatenate([f[:SKETCH] for f in full])
            owner = np.repeat(np.arange(len(full)), [len(f[:SKETCH]) for f in full])
            order = np.argsort(posts, kind="stable")
            posts, owner = posts[order], owner[order]
            sizes, comps, most, reps = np.array(list(map(len, full))), others["comp"].to_numpy(), others["shared"].to_numpy(), others["rep"].to_numpy()
            for rep, comp, shared, raw in zip(*(some[c] for c in ("rep", "comp", "shared", "full")), strict=True):
                own = np.frombuffer(raw, dtype=np.int64)
                n, sketch = len(own), own[:SKETCH]
                common = np.minimum(most, shared)  # the largest intersection that there can be
                possible = (comps != comp) & (100 * common >= percent * (n + sizes - common))
                if not possible.any():
                    continue
                lo, hi = np.searchsorted(posts, sketch), np.searchsorted(posts, sketch, side="right")
                hits = np.concatenate([owner[i:j] for i, j in zip(lo, hi, strict=True)])
                overlap = np.bincount(hits, minlength=len(full))
                near = np.flatnonzero((overlap * 4 >= len(sketch)) & possible)  # far below what similar sets share
                for o in near[np.argsort(-overlap[near], kind="stable")].tolist():
                    x, y = find(comp), find(int(comps[o]))
                    if x == y or not may_link(sketch, full[o][:SKETCH], n, int(sizes[o]), percent):
                        continue
                    both = len(np.intersect1d(own, full[o], assume_unique=True))
                    if 100 * both >= percent * (n + int(sizes[o]) - both):
                        top[max(x, y)] = min(x, y)
                        out.append((min(rep, int(reps[o])), max(rep, int(reps[o]))))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keys = ["core", "rb", "mb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long")


def near_groups(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    rows = reliable(signatures(docs, words))
    filled = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = filled.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = reliable(classes)

    values = classes.select("rep", "n_shingles", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    found = values.join(shared, "v").groupBy("rep", "n_shingles", "m").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    prefix = F.element_at(F.array(*(F.lit(prefix_length(m, percent)) for m in range(1, SKETCH + 1))), F.col("m"))
    take = prefix - (F.col("m") - F.size("vs"))  # values of one class only come first and make no list
    alone = (F.col("m") - F.size("vs")) / F.col("m")
    listed = found.where(take > 0).select("rep", "n_shingles", alone.alias("alone"), F.explode(F.slice("vs", F.lit(1), take)).alias("e")).select("rep", "n_shingles", "alone", F.col("e.v").alias("v"))
    lead = [F.min_by("rep", F.struct("alone", F.xxhash64("rep", F.lit(k)))).alias(f"lead{k}") for k in range(LEADERS)]
    sizes = listed.groupBy("v").agg(F.count(F.lit(1)).alias("len"), *lead).where(F.col("len") > 1)
    leads = F.when(F.col("len") > SHORT_LIST, F.array(*(f"lead{k}" for k in range(LEADERS)))).otherwise(F.array("lead0"))
    listed = reliable(listed.join(sizes, "v").select("v", "rep", "n_shingles", "len", leads.alias("leads")))

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = listed.select("rep", F.explode("leads").alias("lead")).where(F.col("rep") != F.col("lead")).select(*ordered("rep", "lead")).distinct()
    wanted = listed.select("rep").distinct().join(classes.select("rep", "digest"), "rep")
    wanted = reliable(wanted)
    ids = wanted.select(F.col("rep").alias("doc_id"))
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = reliable(full_sets(texts, words).join(wanted, ["rep", "digest"]).dropDuplicates(["rep", "digest"]))
    linked = reliable(verified(stars, sets, percent))

    near = components(linked)
    placed = listed.join(near.select(F.col("node").alias("rep"), "component"), "rep", "left").select("v", "rep", "n_shingles", "len", F.coalesce("component", "rep").alias("comp"))
    placed = reliable(placed)
    kinds = placed.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("v")
    kinds = kinds.agg(F.max_by("comp", F.struct("n", "comp")).alias("core"), F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    apart = reliable(placed.join(kinds.select("v", "core"), "v"))
    rest = apart.where(F.col("comp") != F.col("core"))
    other = apart.where(F.col("len") <= SHORT_LIST).select("v", F.col("rep").alias("other"), F.col("comp").alias("comp2"))
    short = rest.where(F.col("len") <= SHORT_LIST).join(other, "v").where(F.col("comp") != F.col("comp2"))
    pairs = reliable(short.select(*ordered("rep", "other")).distinct())
    hot = rest.where(F.col("len") > SHORT_LIST)
    paired = reliable(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
    paired = F.broadcast(paired) if paired.count() <= BROADCAST_IDS else paired
    further = verified(pairs, sets.join(paired, "rep", "left_semi"), percent)
    if not hot.isEmpty():
        long = apart.where(F.col("len") > SHORT_LIST).select("core", "rep", "comp").distinct()
        held = sets.join(long.select("rep").distinct(), "rep", "left_semi").select("rep", "full")
        shared = F.length("full") / 8 - F.coalesce("lone", F.lit(0))
        held = held.join(shared_values(held), "rep", "left").select("rep", "full", shared.cast("long").alias("shared"))
        members = reliable(long.join(held.where(100 * F.col("shared") >= percent * F.length("full") / 8), "rep"))
        further = further.unionByName(long_list_links(members.where(F.col("comp") != F.col("core")), members, percent))
    of = lambda side: near.select(F.col("node").alias(side), F.col("component").alias("c" + side))
    further = further.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(further)

    labels = classes.select("digest", "n_shingles", "rep").join(near.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.select("digest", "n_shingles", F.coalesce("component", "rep").alias("node"))
    labels = labels.join(joined, "node", "left").select("digest", "n_shingles", F.coalesce("component", "node").alias("_label"))
    out = filled.join(labels, ["digest", "n_shingles"]).select("doc_id", "n_shingles", F.col("_label").alias("component_id"))
    unlinked = rows.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(unlinked).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
