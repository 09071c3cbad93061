"""Ranked lexical search over inverted treaps, one for each term of a shard.

A treap holds a term's postings: searched by document, heap-ordered by impact, so the root of any
subtree is the largest impact of its range of documents. The treaps of a query's terms are traversed
together over ranges of documents: the weighted roots add up to a bound, a range whose bound can't
enter the query's k best is pruned with all its subtrees, any other is split at the document of its
heaviest root, which is scored. Ranges with few postings are scored at once instead of split further.

Documents are read once: their length and the counts of the terms that some item has are written to
the shared folder. From that come the statistics of the whole corpus, and shards of about
SHARD_POSTINGS postings, dealt by row and not by id or term. Each shard meets each block of items as
one cogroup; a window over the k rows of each shard merges them.

Defined cases: null and empty texts have no terms and take part in nothing; rows with a null doc_id
count in the statistics but can't be answers, as items with a null item_id can't ask; repeated rows
are documents of their own; an item is answered once for each distinct (id, text); items without a
term of the corpus have no rows; equal scores go to the smaller doc_id; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import lower_ascii_py, map_batches, reliable, written

#: Terms in the UTF-8 bytes of a text whose A-Z are lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Postings of a shard, and terms of a block of items.
SHARD_POSTINGS, ITEM_TERMS = 1_000_000, 1 << 16
#: Up to so many distinct terms of items are sent to the tasks, which then keep only these; beyond, all terms are kept.
SENT_TERMS = 200_000
#: A range with no more postings than this is scored outright.
LEAF = 4096
#: Cells (ranges times terms) that are expanded at once, and cells of the items that are searched together.
STEP_CELLS, SLICE_CELLS = 1 << 17, 1 << 12
FORWARD = "row long, doc_id long, n long, terms array<binary>, counts array<long>"
FOUND = "item long, item_id long, doc_id long, score long"


def terms_of(text: bytes | str | None) -> list[bytes]:
    raw = lower_ascii_py(text).encode("utf-8", "surrogatepass") if isinstance(text, str) else (text or b"").lower()
    return TERM.findall(raw)


def term_counts(docs: DataFrame, wanted: list[bytes] | None) -> DataFrame:
    """A row for each document: its id, its number of terms, and its distinct (wanted) terms with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(None if wanted is None else frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, at = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            terms, counts, n, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                found = Counter(words)
                some = list(found) if keep is None else list(found.keys() & keep)
                terms += some
                counts += map(found.__getitem__, some)
                n.append(len(words))
                ends.append(len(terms))
            offsets = pa.array(ends, type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(at, at + len(n))),
                    batch.column(0),
                    pa.array(n, type=pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, type=pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, type=pa.int64())),
                ],
                names=["row", "doc_id", "n", "terms", "counts"],
            )
            at += len(n)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text")), run, FORWARD)


class InvertedTreaps:
    """The treaps of all terms of a shard, in arrays over postings that stand in order of term and document."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, starts: np.ndarray, n_docs: int):
        #: Postings: document, impact, children; starts has one entry more than there are terms.
        self.docs, self.impacts, self.starts, self.n_docs = docs, impacts, starts, n_docs
        self.keys = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts)) * n_docs + docs
        self.left, self.right, self.roots = self.built()

    def built(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Equal impacts are ordered by a number drawn for the posting, so that ties don't become chains.
        weight = self.impacts << 20 | np.random.default_rng(0).integers(0, 1 << 20, len(self.impacts))
        left, right = np.full(len(weight), -1, dtype=np.int32), np.full(len(weight), -1, dtype=np.int32)
        roots, bounds = [], self.starts.tolist()
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            below, after = [-1] * (end - begin), [-1] * (end - begin)
            spine: list[int] = []  # from the root along right children
            of = weight[begin:end].tolist()
            for i, w in enumerate(of):
                top = -1
                while spine and of[spine[-1]] < w:
                    top = spine.pop()
                below[i] = top
                if spine:
                    after[spine[-1]] = i
                spine.append(i)
            if spine:
                for out, of_term in ((left, below), (right, after)):
                    child = np.array(of_term, dtype=np.int32)
                    out[begin:end] = np.where(child >= 0, child + begin, -1)
            roots.append(begin + spine[0] if spine else -1)
        return left, right, np.array(roots, dtype=np.int32)

    def descend(self, node: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The highest node below each node whose posting lies in [begin, end); -1 where that is empty."""
        node = np.where(begin < end, node, -1)
        todo = np.flatnonzero((node >= 0) & ((node < begin) | (node >= end)))
        while len(todo):
            at = node[todo]
            at = np.where(at >= end[todo], self.left[at], self.right[at])
            node[todo] = at
            todo = todo[(at < begin[todo]) | (at >= end[todo])]
        return node

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the k best of each query, a row of terms (-1: none) with their weights."""
        n, width = terms.shape
        best = Best(n, k)
        has = terms >= 0
        term = np.where(has, terms, 0)
        begin, end = np.where(has, self.starts[term], 0), np.where(has, self.starts[term + 1], 0)
        node = np.where(begin < end, self.roots[term], -1)
        pool = Ranges(np.arange(n), np.zeros(n, dtype=np.int64), begin, end, node)
        while len(pool.query):
            bound = (weights[pool.query] * self.peaks(pool.node)).sum(axis=1)
            open_ = best.admits(pool.query, bound, pool.low)
            pool, bound = pool.take(open_), bound[open_]
            first = max(1, STEP_CELLS // width)
            order = np.argsort(-bound, kind="stable")
            now, pool = pool.take(order[:first]), pool.take(order[first:])
            small = (now.end - now.begin).sum(axis=1) <= LEAF
            best.offer(*self.scored(now.take(small), weights))
            now = now.take(~small)
            if len(now.query):
                pool = Ranges.joined(pool, *self.split(now, term, weights, best))
        return best.rows()

    def peaks(self, node: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, self.impacts[node], 0)

    def scored(self, ranges: Ranges, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The score of every document of the ranges."""
        row, column = np.nonzero(ranges.end > ranges.begin)
        begin, count = ranges.begin[row, column], (ranges.end - ranges.begin)[row, column]
        at = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
        gain = np.repeat(weights[ranges.query[row], column], count) * self.impacts[at]
        key = np.repeat(ranges.query[row], count) * self.n_docs + self.docs[at]
        order = np.argsort(key)
        key, gain = key[order], gain[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        key, score = key[first], np.add.reduceat(gain, first) if len(first) else gain
        return key // self.n_docs, key % self.n_docs, score

    def split(self, ranges: Ranges, term: np.ndarray, weights: np.ndarray, best: Best) -> tuple[Ranges, Ranges]:
        """Scores the document of the heaviest root of each range, and gives what lies before and behind it."""
        weight = weights[ranges.query]
        heaviest = np.argmax(weight * self.peaks(ranges.node), axis=1)
        pivot = self.docs[ranges.node[np.arange(len(heaviest)), heaviest]].astype(np.int64)
        held = ranges.node >= 0
        cut = ranges.begin.copy()
        wanted = (term[ranges.query] * self.n_docs + pivot[:, None])[held]
        cut[held] = np.searchsorted(self.keys, wanted)
        found = np.zeros(held.shape, dtype=bool)
        inside = cut < ranges.end
        found[inside] = self.keys[cut[inside]] == (term[ranges.query] * self.n_docs + pivot[:, None])[inside]
        score = (weight * np.where(found, self.impacts[np.where(found, cut, 0)], 0)).sum(axis=1)
        best.offer(ranges.query, pivot, score)
        shape = held.shape
        halves = []
        for low, begin, end in ((ranges.low, ranges.begin, cut), (pivot + 1, cut + found, ranges.end)):
            node = self.descend(ranges.node.ravel().copy(), begin.ravel(), end.ravel()).reshape(shape)
            halves.append(Ranges(ranges.query, low, begin, end, node))
        return halves[0], halves[1]


class Ranges:
    """Ranges of documents with, for each term of their query, the postings [begin, end) and their treap's root."""

    def __init__(self, query: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray, node: np.ndarray):
        self.query, self.low, self.begin, self.end, self.node = query, low, begin, end, node

    def take(self, which: np.ndarray) -> Ranges:
        return Ranges(self.query[which], self.low[which], self.begin[which], self.end[which], self.node[which])

    @staticmethod
    def joined(*parts: Ranges) -> Ranges:
        return Ranges(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("query", "low", "begin", "end", "node")))


class Best:
    """The k best documents of each query so far; the smaller document first among equal scores."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query = self.doc = self.score = np.zeros(0, dtype=np.int64)
        #: Score and document of each query's last place, if all its places are taken.
        self.least, self.last = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)

    def admits(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document not before doc, with no more than this score, can still enter."""
        return (score > self.least[query]) | ((score == self.least[query]) & (doc < self.last[query]))

    def offer(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        enters = self.admits(query, score, doc)
        if not enters.any():
            return
        query, doc, score = (np.concatenate(x) for x in ((self.query, query[enters]), (self.doc, doc[enters]), (self.score, score[enters])))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept, full = place < self.k, place == self.k - 1
        self.least[query[full]], self.last[query[full]] = score[full], doc[full]
        self.query, self.doc, self.score = query[kept], doc[kept], score[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.query, self.doc, self.score


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and the length of each list."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
    return one.flatten(), pc.list_value_length(one).to_numpy(zero_copy_only=False).astype(np.int64)


def search_shard(docs: pa.Table, items: pa.Table, k: int, n_docs: int, n_terms: int) -> pa.Table:
    """The k best documents of the shard for each item of the block."""
    empty = pa.table({n: pa.array([], type=pa.int64()) for n in ("item", "item_id", "doc_id", "score")})
    if not len(docs) or not len(items):
        return empty
    ids = docs["doc_id"].to_numpy()
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    terms, sizes = flat(docs["terms"])
    count = flat(docs["counts"])[0].to_numpy()
    asked, asked_sizes = flat(items["terms"])
    known = pc.unique(asked)
    code = pc.index_in(terms, value_set=known).to_numpy(zero_copy_only=False)
    doc = np.repeat(rank, sizes)
    here = ~np.isnan(code) if code.dtype.kind == "f" else np.ones(len(code), dtype=bool)
    doc, count, code = doc[here], count[here], code[here].astype(np.int64)
    order = np.argsort(code * len(ids) + doc)
    doc, count, code = doc[order], count[order], code[order]
    m = np.empty(len(ids), dtype=np.int64)
    m[rank] = 100 - 90 + 90 * docs["n"].to_numpy() * n_docs // n_terms
    impact = 1_000_000_000 * count // (1000 * count + 8 * m[doc])
    starts = np.append(0, np.cumsum(np.bincount(code, minlength=len(known))))
    treaps = InvertedTreaps(doc.astype(np.int32), impact, starts, len(ids))
    ordered, out = np.sort(ids), []
    asked_codes = pc.index_in(asked, value_set=known).to_numpy().astype(np.int64)
    weight = flat(items["weights"])[0].to_numpy()
    ends = np.append(0, np.cumsum(asked_sizes))
    by_size = np.argsort(asked_sizes, kind="stable")
    at = 0
    while at < len(by_size):
        till = at + 1  # as many items as fit, padded to the longest
        while till < len(by_size) and (till + 1 - at) * asked_sizes[by_size[till]] <= SLICE_CELLS:
            till += 1
        part = by_size[at:till]
        width = max(1, int(asked_sizes[part].max()))
        some, weights = np.full((len(part), width), -1, dtype=np.int64), np.zeros((len(part), width), dtype=np.int64)
        for i, item in enumerate(part):
            some[i, : asked_sizes[item]] = asked_codes[ends[item] : ends[item + 1]]
            weights[i, : asked_sizes[item]] = weight[ends[item] : ends[item + 1]]
        query, found, score = treaps.search(some, weights, k)
        out.append((part[query], ordered[found], score))
        at = till
    which, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"item": items["item"].to_numpy()[which], "item_id": items["item_id"].to_numpy()[which], "doc_id": found, "score": score})


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of its own for each distinct id and text), item_id and its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, type=pa.list_(pa.binary()))], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long"), F.encode("text", "UTF-8").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    rows = map_batches(rows, run, "item_id long, terms array<binary>").where(F.size("terms") > 0)
    return reliable(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "terms"))


def rank(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item."""
    asked = item_terms(items)
    pairs = asked.select("item", F.explode("terms").alias("term"))
    distinct = pairs.select("term").distinct()
    some = distinct.limit(SENT_TERMS + 1).collect()
    forward = written(term_counts(docs, [bytes(r.term) for r in some] if len(some) <= SENT_TERMS else None), "term-counts")
    n_docs, n_terms, postings = forward.where("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    n_shards = max(1, math.ceil((postings or 0) / SHARD_POSTINGS))
    held = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(distinct, "term", "left_semi")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    entry = F.struct("term", weight.alias("weight"))
    weighed = pairs.join(held, "term").groupBy("item").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    queries = reliable(asked.drop("terms").join(weighed, "item").select("item", "item_id", F.col("entries.term").alias("terms"), F.col("entries.weight").alias("weights")))
    n_blocks = max(1, math.ceil((queries.agg(F.sum(F.size("terms"))).first()[0] or 0) / ITEM_TERMS))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = forward.where((F.size("terms") > 0) & F.col("doc_id").isNotNull()).withColumn("shard", dealt("row", n_shards)).withColumn("block", each(n_blocks)).drop("row")
    right = queries.withColumn("block", dealt("item", n_blocks)).withColumn("shard", each(n_shards))
    search = partial(search_shard, k=k, n_docs=n_docs, n_terms=n_terms)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(lambda a, b: search(a, b), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
