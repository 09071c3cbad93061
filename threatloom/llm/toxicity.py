"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes a bounded sample of labelled rows (TRAIN_ROWS, those of smallest hash of their id among
the rows that may be learnt from, as far as SAMPLE_BYTES of text go). Features are words and word beginnings: all
that the sample holds. A term's weight is (1 + log of its count) times its inverse document frequency, counted over all documents,
times its relevance (1 + chi) / (RELEVANCE + chi), where chi is the chi-square of term and label: no term is left out,
but terms that say something about the label weigh more.

The sample's vectors lie in blocks of BLOCK. Rare terms have plain postings; a frequent term has its weights by
block, and the largest of each block. A batch of queries adds up their rare terms, bounds each block by what their frequent
terms can add there, and visits blocks in the order of their bounds, each query only those that reach its k-th best similarity. So
the neighbours are exact. Votes are weighted by squared similarity with a weak prior, and a logistic curve fitted on the
votes that each half of the sample gives the other calibrates them. Scoring runs where a document lies; only the index (bounded by TRAIN_ROWS
and SAMPLE_BYTES) is sent to the tasks.

Defined cases: a null or empty text, or one without a term of the sample, has no neighbours and gets the calibrated
prior; labels that are null are not learnt from; of repeated labels of a doc_id the largest counts, of several texts under one
doc_id the least is learnt from; a null doc_id is scored and not held out; without any labels every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import map_batches

TRAIN_ROWS = 2_400
SAMPLE_BYTES = 64 << 20
#: Chi-square at which a term gets half of its weight.
RELEVANCE = 30.0
PREFIXES = (4, 6)
NEIGHBOURS = 15
BLOCK = 32
#: A term is frequent if one in so many examples holds it.
FREQUENT = 16
#: After so many blocks the k-th best similarities are taken (anew).
REVIEWS = (0, 40)
PRIOR_WEIGHT = 0.05
THRESHOLD = 0.3
#: Examples whose neighbours the driver looks for at once.
FIT_ROWS = 50
#: Characters of a word that is looked up with others of its batch.
SHORT = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, marked with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class Terms:
    """The terms of some texts, by text and term: which text, which term, how often (then its weight in the text)."""

    def __init__(self, texts: int, text: np.ndarray, term: np.ndarray, n: np.ndarray):
        self.texts, self.text, self.term, self.n = texts, text, term, n

    def weighted(self, weight: np.ndarray) -> Terms:
        """Unit TF-IDF vectors."""
        w = (1 + np.log(self.n)) * weight[self.term]
        norm = np.sqrt(np.bincount(self.text, w**2, self.texts))
        return Terms(self.texts, self.text, self.term, w / np.where(norm > 0, norm, 1)[self.text])


class WordTable:
    """Numbers of words by open addressing; a word of up to SHORT characters of the basic plane is its own key, in SHORT // 4 numbers of 64 bits."""

    def __init__(self, words: list[str], numbers: list[int]):
        short = [len(w) <= SHORT and max(map(ord, w), default=0) < 1 << 16 for w in words]
        self.other = {w: n for w, n, s in zip(words, numbers, short, strict=True) if not s}
        words, numbers = [w for w, s in zip(words, short, strict=True) if s], np.array([n for n, s in zip(numbers, short, strict=True) if s], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.keys, self.numbers = packed(codes, np.cumsum(sizes) - sizes, sizes), numbers
        self.slots = np.full(1 << max(4, int(3 * len(words)).bit_length()), -1, dtype=np.int32)
        todo, at = np.arange(len(words), dtype=np.int32), self.home(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot the last stays
            left = self.slots[at] != todo
            at, todo = (at[left] + 1) & (len(self.slots) - 1), todo[left]

    def home(self, keys: np.ndarray) -> np.ndarray:
        h = np.zeros(keys.shape[1], dtype=np.uint64)
        for part in keys:
            h = (h ^ part) * _MIX
            h ^= h >> np.uint64(31)
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if there is none."""
        at = self.home(keys)
        entry = self.slots[at]
        if not len(self.numbers):
            return np.full(len(entry), -1, dtype=np.int64)
        differs = lambda e, k: (self.keys[:, e] != k).any(0)
        wrong = np.flatnonzero((entry >= 0) & differs(entry, keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            entry[wrong] = self.slots[at[wrong]]
            wrong = wrong[(entry[wrong] >= 0) & differs(entry[wrong], keys[:, wrong])]
        return np.where(entry >= 0, self.numbers[entry], -1)


def packed(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first SHORT characters of words as numbers, 16 bits a character."""
    out = np.zeros((SHORT // 4, len(starts)), dtype=np.uint64)
    left = np.arange(len(starts))
    for k in range(SHORT):
        left = left[sizes[left] > k]
        if not len(left):
            break
        out[k // 4, left] |= codes[starts[left] + k].astype(np.uint64) << np.uint64(16 * (k % 4))
    return out


class TermCounter:
    """Counts texts' terms of the vocabulary, all words of a batch at once."""

    def __init__(self, terms: list[str]):
        self.size = len(terms)
        whole = [(t, i) for i, t in enumerate(terms) if not t.endswith("*")]
        self.whole = WordTable([t for t, _ in whole], [i for _, i in whole])
        begins = {n: [(t[:n], i) for i, t in enumerate(terms) if len(t) == n + 1 and t.endswith("*")] for n in PREFIXES}
        self.begins = {n: WordTable([t for t, _ in found], [i for _, i in found]) for n, found in begins.items()}

    def found(self, texts: list[str | None]) -> np.ndarray:
        """text * size + term of every term of every word."""
        lowered = [(t or "").lower() for t in texts]
        whole = "\n".join(["", *lowered, ""])
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        edges = np.flatnonzero(np.diff(is_letter()[codes].astype(np.int8)))
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        sizes = ends - starts
        text = np.searchsorted(np.cumsum([1, *(len(t) + 1 for t in lowered)]), starts, "right") - 1
        far = np.append(0, np.cumsum(codes >= 1 << 16))
        plain = far[ends] == far[starts]
        keys = packed(codes, starts, np.where(plain, sizes, 0))
        out = []

        def add(rows: np.ndarray, terms: np.ndarray) -> None:
            hit = terms >= 0
            out.append(text[rows[hit]] * self.size + terms[hit])

        short = np.flatnonzero(plain & (sizes <= SHORT))
        add(short, self.whole.find(keys[:, short]))
        odd = np.flatnonzero(~plain | (sizes > SHORT))
        words = [whole[a:z] for a, z in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
        add(odd, np.array([self.whole.other.get(w, -1) for w in words], dtype=np.int64))
        for n, table in self.begins.items():
            longer = np.flatnonzero(plain & (sizes > n))
            mask = np.array([(1 << 16 * min(4, max(0, n - 4 * k))) - 1 for k in range(SHORT // 4)], dtype=np.uint64)
            add(longer, table.find(keys[:, longer] & mask[:, None]))
            far_words = np.flatnonzero(~plain & (sizes > n))
            begins = [whole[a : a + n] for a in starts[far_words].tolist()]
            # A beginning may be plain though its word isn't.
            some = [table.other.get(b, -1) if max(map(ord, b)) >= 1 << 16 else int(table.find(packed(np.array(list(map(ord, b))), np.zeros(1, dtype=np.int64), np.array([n])))[0]) for b in begins]
            add(far_words, np.array(some, dtype=np.int64))
        return np.sort(np.concatenate(out))

    def counts(self, texts: list[str | None]) -> Terms:
        key = self.found(texts)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        n = np.diff(np.append(first, len(key)))
        return Terms(len(texts), key[first] // max(1, self.size), key[first] % max(1, self.size), n)

    def frequencies(self, texts: list[str | None]) -> np.ndarray:
        """How many of the texts hold each term."""
        key = self.found(texts)
        return np.bincount(key[np.append(True, key[1:] != key[:-1])[: len(key)]] % max(1, self.size), minlength=self.size)


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    """Of each code point whether WORD matches it."""
    return np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))])


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges that begin at first."""
    return np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


class BlockMaxIndex:
    """An inverted index over labelled unit vectors, searched exactly with block upper bounds, a batch of queries at a time."""

    def __init__(self, ids: list[int], labels: list[int], vectors: Terms, n_terms: int):
        # Vectors with the same strongest term lie together, which makes the bounds of other blocks low.
        strongest = np.lexsort((-vectors.n, vectors.text))
        strongest = vectors.term[strongest[np.searchsorted(vectors.text[strongest], np.arange(len(ids)))]]
        order = np.lexsort((np.array(ids), strongest, np.array(labels)))
        self.ids, self.labels = np.array(ids, dtype=np.int64)[order], np.array(labels, dtype=np.int64)[order]
        self.n_blocks = -(-len(order) // BLOCK)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        docs = place[vectors.text]
        by_term = np.lexsort((docs, vectors.term))
        terms, self.docs, self.weights = vectors.term[by_term], docs[by_term].astype(np.int32), vectors.n[by_term]
        self.starts = np.searchsorted(terms, np.arange(n_terms + 1))
        often = np.flatnonzero(np.diff(self.starts) * FREQUENT > len(order))
        self.frequent = np.full(n_terms, -1, dtype=np.int64)  # a frequent term's row in the blocks
        self.frequent[often] = np.arange(len(often))
        mine = self.frequent[terms] >= 0
        self.blocks = np.zeros((self.n_blocks, len(often), BLOCK))
        self.blocks[self.docs[mine] // BLOCK, self.frequent[terms[mine]], self.docs[mine] % BLOCK] = self.weights[mine]
        self.best = self.blocks.max(2).T

    def nearest(self, queries: Terms, k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the positions and similarities of the k nearest that share a term, by similarity, then position."""
        width, row = self.n_blocks * BLOCK, self.frequent[queries.term]
        rare, often = np.flatnonzero(row < 0), np.flatnonzero(row >= 0)
        first = self.starts[queries.term[rare]]
        sizes = self.starts[queries.term[rare] + 1] - first
        at = spread(first, sizes)
        scores = np.bincount(np.repeat(queries.text[rare] * width, sizes) + self.docs[at], np.repeat(queries.n[rare], sizes) * self.weights[at], queries.texts * width)
        scores = scores.astype(float).reshape(queries.texts, width)
        if skip is not None:
            scores[np.arange(queries.texts), skip] = -np.inf
        common = np.zeros((queries.texts, self.best.shape[0]))
        common[queries.text[often], row[often]] = queries.n[often]
        bounds = scores.reshape(queries.texts, -1, BLOCK).max(2) + common @ self.best
        seen = min(k, width)
        for i, block in enumerate(np.argsort(-bounds.max(0, initial=0), kind="stable")):
            if i in REVIEWS:  # a block whose bound is lower holds none of the k best
                edge = np.partition(scores, width - seen, axis=1)[:, width - seen]
            wanted = np.flatnonzero((bounds[:, block] > 0) & (bounds[:, block] >= edge - 1e-9))
            scores[wanted, block * BLOCK : (block + 1) * BLOCK] += common[wanted] @ self.blocks[block]
        edge = np.maximum(np.partition(scores, width - seen, axis=1)[:, width - seen] - 2e-9, 5e-10)
        query, doc = np.nonzero(scores >= edge[:, None])
        sims = np.round(scores[query, doc], 9)
        order = np.lexsort((doc, -sims, query))
        begin = np.searchsorted(query[order], np.arange(queries.texts + 1))
        picks = [order[a : min(a + k, z)] for a, z in zip(begin[:-1], begin[1:], strict=True)]
        return [(doc[p], sims[p]) for p in picks]


class Scorer:
    """What tasks need to score texts: the terms with their weights, the index and its calibration."""

    def __init__(self, terms: list[str], idf: np.ndarray, ids: list[int], labels: list[int], examples: Terms):
        self.terms = terms
        self.prior = (sum(labels) + 0.5) / (len(labels) + 1) if labels else 0.0
        self.curve, self.index = (1.0, 0.0), None
        truth, every = np.array(labels, dtype=float), np.arange(len(ids))
        # The curve is fitted on votes by one half of the examples for the other: those neither chose the weights nor stand in the index.
        votes, judged = [], []
        for half in (0, 1) if len(ids) > 1 else ():
            self.learn(idf, ids, truth, examples, every[every % 2 != half])
            if self.index is None:
                continue
            asked = self.part(examples, every[every % 2 == half]).weighted(self.weight)
            for at in range(0, asked.texts, FIT_ROWS):
                some = slice(*np.searchsorted(asked.text, [at, at + FIT_ROWS]))
                rows = Terms(min(FIT_ROWS, asked.texts - at), asked.text[some] - at, asked.term[some], asked.n[some])
                votes += [self.vote(*x) if len(x[0]) else self.prior for x in self.index.nearest(rows, NEIGHBOURS)]
            judged += truth[every % 2 == half].tolist()
        self.learn(idf, ids, truth, examples, every)
        if votes:
            self.curve = logistic(logit(np.array(votes)), np.array(judged))

    @staticmethod
    def part(examples: Terms, rows: np.ndarray) -> Terms:
        """The examples of some rows, numbered anew."""
        number = np.full(examples.texts, -1, dtype=np.int64)
        number[rows] = np.arange(len(rows))
        text = number[examples.text]
        return Terms(len(rows), text[text >= 0], examples.term[text >= 0], examples.n[text >= 0])

    def learn(self, idf: np.ndarray, ids: list[int], truth: np.ndarray, examples: Terms, rows: np.ndarray) -> None:
        """Weights and index of these rows of the examples."""
        vectors, y = self.part(examples, rows), truth[rows]
        n1 = np.bincount(vectors.term, y[vectors.text], len(self.terms))
        both = np.bincount(vectors.term, minlength=len(self.terms)).astype(float)
        toxic = y.sum() / max(1, len(rows))
        chi = sum((n - both * share) ** 2 / np.maximum(both * share, 1e-9) for n, share in ((n1, toxic), (both - n1, 1 - toxic)))
        self.weight, self.index = idf * (1 + chi) / (RELEVANCE + chi), None
        vectors = vectors.weighted(self.weight)
        if len(full := np.unique(vectors.text)):
            vectors.texts, vectors.text = len(full), np.searchsorted(full, vectors.text)
            self.index = BlockMaxIndex([ids[rows[i]] for i in full], [int(y[i]) for i in full], vectors, len(self.terms))

    def vote(self, at: np.ndarray, sims: np.ndarray) -> float:
        strength = sims**2
        return float((strength * self.index.labels[at]).sum() + PRIOR_WEIGHT * self.prior) / float(strength.sum() + PRIOR_WEIGHT)

    def score(self, texts: Terms) -> list[tuple[float, list[int]]]:
        """The calibrated score of each text, and its neighbours' doc_ids."""
        if self.prior == 0.0:
            return [(0.0, [])] * texts.texts
        near = self.index.nearest(texts.weighted(self.weight), NEIGHBOURS) if self.index is not None else [(np.zeros(0, dtype=np.int64), np.zeros(0))] * texts.texts
        shares = np.array([self.vote(*x) if len(x[0]) else self.prior for x in near])
        scores = 1 / (1 + np.exp(-(self.curve[0] * logit(shares) + self.curve[1])))
        return [(float(s), self.index.ids[at].tolist() if len(at) else []) for s, (at, _) in zip(scores, near, strict=True)]


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve, by Newton steps on slightly softened labels."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p) - 1e-3 * (w - [1.0, 0.0]))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """doc_id, text and y of at most train_rows labelled documents, one row each, as far as SAMPLE_BYTES go."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over train_rows rows
    return rows.withColumn("_bytes", so_far).where(F.col("_bytes") <= SAMPLE_BYTES).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Learns from at most train_rows labelled rows; document frequencies come from all documents."""
    rows = sample_of(docs, labels, train_rows).persist()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = {w for text in batch.column(0).to_pylist() for w in WORD.findall(text.lower())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(chain.from_iterable(map(terms_of, words)))), pa.string())], names=["term"])

    terms = map_batches(rows.select("text"), split, "term string").distinct().orderBy("term").toArrow().column("term").to_pylist()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(terms)
        for batch in batches:
            found = counter.counts(batch.column(2).to_pylist())
            edges = pa.array(np.searchsorted(found.text, np.arange(found.texts + 1)), pa.int32())
            cols = [batch.column(0), batch.column(1), *(pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (found.term, found.n))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "terms", "counts"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, df, n = TermCounter(terms), np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            df += counter.frequencies(batch.column(0).to_pylist())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["term", "n"])

    drawn = map_batches(rows.select("doc_id", "y", "text"), vectors, "doc_id long, y int, terms array<int>, counts array<int>").toArrow()
    every = map_batches(docs.select("text"), frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    rows.unpersist()
    at, n = (every.column(c).to_numpy() for c in ("term", "n"))
    df = np.zeros(len(terms))
    df[at[at >= 0]] = n[at >= 0]
    idf = np.log((1 + n[at < 0].sum()) / (1 + df)) + 1
    drawn = drawn.sort_by("doc_id").combine_chunks()
    ids, labels = drawn.column("doc_id").to_pylist(), drawn.column("y").to_pylist()
    sizes = pc.list_value_length(drawn.column("terms")).to_numpy()
    examples = Terms(len(ids), np.repeat(np.arange(len(ids)), sizes), *(pc.list_flatten(drawn.column(c)).to_numpy().astype(np.int64) for c in ("terms", "counts")))
    return Scorer(terms, idf, ids, labels, examples)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the nearest examples' doc_ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by TRAIN_ROWS and SAMPLE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counter = TermCounter(model.terms)
        for batch in batches:
            found = model.score(counter.counts(batch.column(2).to_pylist()))
            cols = [batch.column(0), batch.column(1), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= THRESHOLD) for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "evidence"])

    key = F.col("doc_id").cast("long")
    return map_batches(docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def keep_clean(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counter = TermCounter(model.terms)
        for batch in batches:
            clean = [s < THRESHOLD for s, _ in model.score(counter.counts(batch.column(at).to_pylist()))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_batches(docs, run, docs.schema)
