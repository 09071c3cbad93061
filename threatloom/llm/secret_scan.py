"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

The base patterns (assignments, access keys, long hexadecimal runs) always count. Every further candidate, a maximal run of LEAST_RUN
or more key characters that base spans don't cover whole, is judged with its surrounding context by a small network in numpy: character
embedding, one convolution, maximum over places in, before and behind the run, one hidden layer. No candidate is left out before it. Beside the filters it sees a run's
length, and how much likelier its pairs of neighbouring characters are in a secret than in harmless text. It learns from labelled
findings: secrets that a seeded generator writes (keys, tokens and passwords in code and prose), and as harmless ones generated
identifiers, paths, versions, numbers and words, and real runs from at most SAMPLE_ROWS texts of the table, those of smallest hash. The
network is calibrated by a logistic curve on held-back findings, and its threshold is the highest one that keeps RECALL of the held-back
secrets of every kind. Candidates longer than a tile are judged tile by tile.

Offsets are code points, end exclusive. Defined cases: a null or empty text has no spans; matches
of a pattern are leftmost and don't overlap, and a match that is too short is dropped together with
what it consumed; repeated rows are scanned each on its own; further columns are ignored; an empty
table gives an empty result, and a table without runs leaves the generated findings to learn from.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import map_batches

ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Maximal runs, so the least length can stand in the pattern itself.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY_CHARACTERS = string.ascii_letters + string.digits + "+/_.=-"
LEAST_RUN = 8
#: Texts that harmless runs are taken from, runs of one text, and runs in all that are learnt from.
SAMPLE_ROWS, SAMPLE_RUNS, LEARNT_RUNS = 1000, 40, 4000
KINDS = ("assign", "access", "hex", "cnn")

RECALL = 0.98
CONTEXT, TILE = 24, 48
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + string.punctuation + " \n"
EMBED, WIDTH, FILTERS, HIDDEN = 12, 5, 32, 16
DECAY = 0.02
SEED = 20_240_117


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of LEAST_RUN or more key characters begin and end in UTF-8 bytes; they are ASCII, so bytes are characters."""
    key = IS_KEY[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], key, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= LEAST_RUN
    return starts[long], ends[long]


def uncovered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether base spans (by start) leave a part of a run free."""
    for a, _, z in spans:
        if a > start:
            break
        start = max(start, z)
    return start < end


class Odds:
    """How much likelier each pair of neighbouring characters, and what a run begins and ends with, is in a secret than in harmless runs."""

    def __init__(self, secrets: list[str], harmless: list[str]):
        self.size = len(KEY_CHARACTERS) + 1  # and the edge of a run
        odds = [np.full((self.size, self.size), 0.3) for _ in range(2)]
        for counts, words in zip(odds, (harmless, secrets), strict=True):
            for w in words:
                codes = KEY_CODE[np.frombuffer(b" " + w.encode() + b" ", dtype=np.uint8)]
                np.add.at(counts, (codes[:-1], codes[1:]), 1 / max(1, len(w)))  # a long run says no more than a short one
        self.odds = np.log(odds[1] / odds[1].sum()) - np.log(odds[0] / odds[0].sum())
        self.odds[-1, -1] = 0

    def by_code(self) -> np.ndarray:
        """The odds of pairs of the network's codes."""
        key = np.array([len(KEY_CHARACTERS)] * 2 + [KEY_CODE[ord(c)] for c in ALPHABET])
        return self.odds[key[:, None], key[None]]


def tiles(text: str, start: int, end: int) -> list[tuple[str, str, str]]:
    """What stands before, in and after each tile of a candidate."""
    return [(text[max(0, a - CONTEXT) : a], text[a : min(a + TILE, end)], text[min(a + TILE, end) : min(a + TILE, end) + CONTEXT]) for a in range(start, end, TILE)]


KEY_CODE = np.full(256, len(KEY_CHARACTERS), dtype=np.int64)
KEY_CODE[list(KEY_CHARACTERS.encode())] = np.arange(len(KEY_CHARACTERS))
IS_KEY = KEY_CODE < len(KEY_CHARACTERS)
CODE = {c: i + 2 for i, c in enumerate(ALPHABET)}  # 0: nothing, 1: any other character
CODES = np.array([CODE.get(chr(i), 1) for i in range(129)], dtype=np.uint8)
#: What texts of a batch are parted by, and tiles that are judged at once.
GAP, JUDGED = "\n" * CONTEXT, 8_192


def encode(parts: list[tuple[str, str, str]]) -> np.ndarray:
    """Character codes with the candidate in fixed places."""
    out = np.zeros((len(parts), 2 * CONTEXT + TILE), dtype=np.int64)
    for row, (before, inner, after) in zip(out, parts, strict=True):
        for at, piece in ((CONTEXT - len(before), before), (CONTEXT, inner), (CONTEXT + TILE, after)):
            row[at : at + len(piece)] = [CODE.get(c, 1) for c in piece]
    return out


class CharCNN:
    """Embedding, convolution, ReLU, maximum and mean over places inside, maximum before and behind, length and odds of pairs, hidden layer, logit."""

    def __init__(self, rng: np.random.Generator, odds: np.ndarray):
        self.odds = odds
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {
            "e": rng.normal(0, 0.5, (len(ALPHABET) + 2, EMBED)),
            "w": normal(WIDTH * EMBED, FILTERS),
            "c": np.zeros(FILTERS),
            "h": normal(4 * FILTERS + 2, HIDDEN),
            "d": np.zeros(HIDDEN),
            "o": normal(HIDDEN, 1),
            "b": np.zeros(1),
        }
        self.curve, self.threshold = (1.0, 0.0), 0.5

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        x = p["e"][codes] * (codes > 0)[..., None]
        places = codes.shape[1] - WIDTH + 1
        windows = np.concatenate([x[:, i : i + places] for i in range(WIDTH)], axis=2)
        z = np.maximum(windows @ p["w"] + p["c"], 0)
        a, b = CONTEXT - WIDTH + 1, CONTEXT + TILE
        inner = z[:, CONTEXT : b - WIDTH + 1]
        filled = (codes[:, CONTEXT : b - WIDTH + 1] > 0)[..., None]
        size = np.maximum(filled.sum(1), 1)
        mean = (inner * filled).sum(1) / size
        pooled = np.concatenate([inner.max(1), mean, z[:, :a].max(1), z[:, b:].max(1), self.measures(codes).astype(z.dtype)], axis=1)
        hidden = np.maximum(pooled @ p["h"] + p["d"], 0)
        return (hidden @ p["o"] + p["b"])[:, 0], {"windows": windows, "z": z, "pooled": pooled, "hidden": hidden, "filled": filled}

    def measures(self, codes: np.ndarray) -> np.ndarray:
        """The length of each tile, and the odds of its pairs in all."""
        inner = codes[:, CONTEXT - 1 : CONTEXT + TILE].astype(np.intp)
        total = self.odds.ravel()[inner[:, :-1] * len(self.odds) + inner[:, 1:]].sum(1)
        return np.stack([(inner[:, 1:] > 0).sum(1) / 8, total / 8], axis=1)

    def gradients(self, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logits, m = self.forward(codes)
        d_logit = ((1 / (1 + np.exp(-logits)) - y) / len(y))[:, None]
        g = {"o": m["hidden"].T @ d_logit, "b": d_logit.sum(0)}
        d_hidden = d_logit @ p["o"].T * (m["hidden"] > 0)
        g |= {"h": m["pooled"].T @ d_hidden, "d": d_hidden.sum(0)}
        d_pooled = d_hidden @ p["h"].T
        d_z = np.zeros_like(m["z"])
        a, lo, hi = CONTEXT - WIDTH + 1, CONTEXT, CONTEXT + TILE - WIDTH + 1
        rows, cols = np.arange(len(y))[:, None], np.arange(FILTERS)[None]
        d_z[rows, lo + m["z"][:, lo:hi].argmax(1), cols] += d_pooled[:, :FILTERS]
        d_z[:, lo:hi] += m["filled"] * (d_pooled[:, FILTERS : 2 * FILTERS] / np.maximum(m["filled"].sum(1), 1))[:, None]
        d_z[rows, m["z"][:, :a].argmax(1), cols] += d_pooled[:, 2 * FILTERS : 3 * FILTERS]
        d_z[rows, CONTEXT + TILE + m["z"][:, CONTEXT + TILE :].argmax(1), cols] += d_pooled[:, 3 * FILTERS : 4 * FILTERS]
        d_z *= m["z"] > 0
        flat = d_z.reshape(-1, FILTERS)
        g |= {"w": m["windows"].reshape(-1, WIDTH * EMBED).T @ flat, "c": flat.sum(0)}
        d_windows = (flat @ p["w"].T).reshape(*d_z.shape[:2], WIDTH, EMBED)
        d_x = np.zeros((*codes.shape, EMBED), dtype=flat.dtype)
        for i in range(WIDTH):
            d_x[:, i : i + d_z.shape[1]] += d_windows[:, :, i]
        g["e"] = np.stack([np.bincount(codes.ravel(), d_x[..., i].ravel(), len(p["e"])) for i in range(EMBED)], axis=1).astype(flat.dtype)
        g["e"][0] = 0
        return g

    def train(self, codes: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 8, batch: int = 64, rate: float = 3e-3) -> None:
        """Adam over shuffled batches, with a falling rate and weights that decay, in single precision."""
        self.p, y = {k: v.astype(np.float32) for k, v in self.p.items()}, y.astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                step += 1
                part = order[at : at + batch]
                for k, g in self.gradients(codes[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (1 - (step - 1) / steps) * (DECAY * self.p[k] + m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        self.p = {k: v.astype(np.float64) for k, v in self.p.items()}

    def calibrate(self, codes: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> None:
        """A logistic curve over the logits, and the highest threshold that keeps RECALL of the secrets of each kind."""
        logits = self.logits(codes)
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(200):
            q = 1 / (1 + np.exp(-(a * logits + b)))
            a, b = a + 0.05 * float(((target - q) * logits).mean()), b + 0.05 * float((target - q).mean())
        self.curve = (a, b)
        scores = 1 / (1 + np.exp(-(a * logits + b)))
        self.threshold = min(float(np.sort(scores[(y > 0) & (kinds == k)])[int((1 - RECALL) * ((y > 0) & (kinds == k)).sum())]) for k in np.unique(kinds[y > 0]))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * self.logits(codes) + b)))

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """forward() in single precision: what two neighbouring characters add to a filter is looked up, windows over nothing, between the end of a run and what stands behind it, are not written out."""
        p, v = self.p, len(ALPHABET) + 2
        e = p["e"].copy()
        e[0] = 0
        tap = [(e @ p["w"][i * EMBED : (i + 1) * EMBED]).astype(np.float32) for i in range(WIDTH)]
        lead = (tap[0][:, None] + tap[1][None] + p["c"].astype(np.float32)).reshape(v * v, FILTERS)
        mid, tail = (tap[2][:, None] + tap[3][None]).reshape(v * v, FILTERS), tap[4]
        codes = codes.astype(np.intp)
        pairs = codes[:, :-1] * v + codes[:, 1:]
        size = (codes[:, CONTEXT : CONTEXT + TILE - WIDTH + 1] > 0).sum(1)
        nothing = np.maximum(p["c"], 0).astype(np.float32)

        def windows(rows: np.ndarray, a: int, z: int) -> np.ndarray:
            out = lead[pairs[rows, a:z]]
            out += mid[pairs[rows, a + 2 : z + 2]]
            out += tail[codes[rows, a + 4 : z + 4]]
            return np.maximum(out, 0, out=out)

        pooled = np.zeros((len(codes), 4 * FILTERS + 2), dtype=np.float32)
        pooled[:, 4 * FILTERS :] = self.measures(codes)
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), 256):
            rows = order[i : i + 256]
            n = size[rows]
            most = int(n.max(initial=1))
            inner = windows(rows, CONTEXT, CONTEXT + most)
            pooled[rows, 2 * FILTERS : 3 * FILTERS] = windows(rows, 0, CONTEXT - WIDTH + 1).max(1)
            pooled[rows, 3 * FILTERS : 4 * FILTERS] = windows(rows, CONTEXT + TILE, 2 * CONTEXT + TILE - WIDTH + 1).max(1)
            pooled[rows, :FILTERS] = inner.max(1)
            inner *= (np.arange(most) < n[:, None])[..., None]
            pooled[rows, FILTERS : 2 * FILTERS] = inner.sum(1) / np.maximum(n, 1)[:, None]
        short = size < TILE - WIDTH + 1
        pooled[short, :FILTERS] = np.maximum(pooled[short, :FILTERS], nothing)
        hidden = np.maximum(pooled @ p["h"] + p["d"], 0)
        return (hidden @ p["o"] + p["b"])[:, 0]


def generated(n: int, seed: int, around: list[tuple[str, str]] = []) -> tuple[list[tuple[str, str, str]], np.ndarray, np.ndarray]:  # noqa: B006
    """Findings with labels and kinds: secrets in the places where they leak, and look-alikes; half of both stand in real surroundings, if some are given."""
    r = random.Random(seed)
    pick = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    alnum, b64, low_hex = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    syllables = "an er th in on re ti es st en at ou ing tion ar le de la que ment schen ver lich keit".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    secrets = (
        lambda: pick(alnum, 24, 48),
        lambda: pick(alnum, 16, 23),
        lambda: pick(b64, 32, 64) + "=" * r.randint(0, 2),
        lambda: pick(low_hex, 24, 31),
        lambda: pick(low_hex.upper(), 32, 48),
        lambda: "-".join(pick(low_hex, k, k) for k in (8, 4, 4, 4, 12)),
        lambda: pick(string.ascii_letters, 24, 48),
        lambda: pick(string.ascii_lowercase, 28, 48),
        lambda: pick(string.digits, 20, 40),
        lambda: r.choice(("ghp_", "sk-", "xoxb-", "glpat-", "pk_live_")) + pick(alnum, 20, 40),
        lambda: "eyJ" + pick(b64.replace("+/", "-_"), 20, 40) + "." + pick(b64, 20, 40),
    )
    harmless = (
        lambda: "-".join(word() for _ in range(r.randint(4, 7))) + f"-{r.randint(1, 2030)}",
        lambda: "/".join(word() for _ in range(r.randint(4, 8))) + f"/v{r.randint(1, 9)}.html",
        lambda: f"{word()}{r.randint(1, 9999)}.{word()}.example.com/{word()}/{word()}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.00Z",
        lambda: "".join(word() for _ in range(6)) + str(r.randint(1, 99)),
        lambda: "".join(word() for _ in range(r.randint(3, 9))).capitalize() + r.choice(("", ".", "-")),
        lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 99)}_{word()}",
        lambda: "=" * r.randint(18, 40) + str(r.randint(1, 9)) + word(),
        lambda: ".".join(str(r.randint(0, 999)) for _ in range(7)) + "-rc1",
        lambda: pick(string.digits, 8, 19) + r.choice(("", ".", "-")),
        lambda: "".join(word() for _ in range(r.randint(2, 5))).upper(),
        lambda: word()[:4] * r.randint(6, 9) + "1",
    )
    before_secret = ("key: ", "Authorization: Bearer ", "auth=", "credential ", "export KEY=", "private ", "login with ", "curl -H ")
    before_any = (" see ", " the ", " at https://", " file ", "\n", " in ", " (", " version ", " id ")
    parts, labels, kinds = [], [], []
    for i in range(n):
        secret = i % 2
        kind = r.randrange(len(secrets if secret else harmless))
        whole = (secrets if secret else harmless)[kind]()
        lead = r.choice(before_secret if secret and r.random() < 0.5 else before_any)
        before = (" ".join(word() for _ in range(4)) + lead)[-CONTEXT:]
        after = (r.choice(('"', "'", " ", ".\n", "\n", ", ")) + " ".join(word() for _ in range(4)))[:CONTEXT]
        if around and r.random() < 0.5:
            before, after = r.choice(around)
        parts.append((before, whole[:TILE], (whole[TILE:] + after)[:CONTEXT]))
        labels.append(secret)
        kinds.append(kind)
    return parts, np.array(labels, dtype=float), np.array(kinds)


class SecretModel:
    """The network, learnt from generated findings and real harmless runs (before, run, after). Deterministic."""

    def __init__(self, real: list[tuple[str, str, str]], n: int = 12_000):
        rng = np.random.default_rng(SEED)
        real = real + [(b, r.upper(), a) for b, r, a in real[::4]]  # any word may stand in capitals
        around = [(b, a) for b, _, a in real]
        parts, y, _ = generated(n, SEED, around)
        later, later_y, kinds = generated(n, SEED + 1, around)
        inner = lambda rows, want: [p[1] for p, label in zip(rows, want, strict=True) if label]
        # Half of the harmless weight lies on real runs, however many there are.
        real = real * min(-(-n // 2 // len(real)) if real else 0, 8)
        odds = Odds(inner(parts, y), inner(parts, 1 - y) + [p[1] for p in real])
        self.network = CharCNN(rng, odds.by_code())
        rows = list(zip(parts, y, strict=True)) + [(p, 0.0) for p in real]
        self.network.train(encode([p for p, _ in rows]), np.array([label for _, label in rows]), rng)
        self.network.calibrate(encode(later), later_y, kinds)


@lru_cache(maxsize=4)
def trained(real: tuple[tuple[str, str, str], ...] = ()) -> SecretModel:
    return SecretModel(list(real))


def fit(docs: DataFrame) -> SecretModel:
    """A model whose harmless runs come from at most SAMPLE_ROWS texts of docs, SAMPLE_RUNS of each; runs that a base span touches aren't taken."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                spans, at = base_spans(text), 0
                for m in re.finditer(f"[{re.escape(KEY_CHARACTERS)}]{{{LEAST_RUN},}}", text):
                    if not any(a < m.end() and m.start() < z for a, _, z in spans):
                        rows.append(tiles(text, m.start(), m.end())[0])
                        at += 1
                    if at == SAMPLE_RUNS:
                        break
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["b", "r", "a"])

    texts = docs.select("text", F.xxhash64("text").alias("h")).where("text IS NOT NULL")
    drawn = texts.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS)  # hashes alone, so that texts don't meet in one task
    some = texts.join(F.broadcast(drawn), "h").groupBy("h").agg(F.min("text").alias("text"))
    found = map_batches(some.select("text"), sample, "b string, r string, a string").distinct().orderBy(F.xxhash64("b", "r", "a"), "b", "r", "a").limit(LEARNT_RUNS)
    return trained(tuple(tuple(x) for x in found.collect()))


def find_all(texts: list[str | None], model: SecretModel) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, by start, then kind; the network judges every tile of every candidate, those of all texts at once."""
    found = [base_spans(t or "") for t in texts]
    points = np.frombuffer((GAP + GAP.join(t or "" for t in texts) + GAP).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.cumsum([CONTEXT, *(len(t or "") + CONTEXT for t in texts)])[:-1]
    narrow = np.minimum(points, 128).astype(np.uint8)
    starts, ends = runs(narrow)
    owner = np.searchsorted(first, starts, "right") - 1
    covered = np.array([len(s) > 0 for s in found], dtype=bool)[owner]
    for i in np.flatnonzero(covered):
        at = int(first[owner[i]])
        covered[i] = not uncovered(int(starts[i]) - at, int(ends[i]) - at, found[owner[i]])
    starts, ends, owner = starts[~covered], ends[~covered], owner[~covered]
    if not len(starts):
        return found
    codes = CODES[narrow]
    codes[(first[:, None] - np.arange(1, CONTEXT + 1)).ravel()] = codes[-CONTEXT:] = 0  # nothing stands before a text, or behind it
    n_tiles = -(-(ends - starts) // TILE)
    head = np.cumsum(n_tiles) - n_tiles
    begin = np.repeat(starts, n_tiles) + TILE * (np.arange(n_tiles.sum()) - np.repeat(head, n_tiles))
    last = np.repeat(ends, n_tiles)
    scores = np.zeros(len(begin))
    for i in range(0, len(begin), JUDGED):
        where = begin[i : i + JUDGED, None] + np.arange(-CONTEXT, TILE)
        inside = where < last[i : i + JUDGED, None]
        behind = np.minimum(begin[i : i + JUDGED] + TILE, last[i : i + JUDGED])[:, None] + np.arange(CONTEXT)
        scores[i : i + JUDGED] = model.network.probability(np.concatenate([codes[np.where(inside, where, 0)] * inside, codes[behind]], axis=1))
    secret = np.maximum.reduceat(scores, head) >= model.network.threshold
    for i, a, z in zip(owner[secret].tolist(), (starts - first[owner])[secret].tolist(), (ends - first[owner])[secret].tolist(), strict=True):
        found[i].append((a, 3, z))
    return [sorted(s) for s in found]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document, with its base spans and all spans, listed as kind:start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))  # some thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            every = find_all(batch.column(1).to_pylist(), model)
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in every], pa.int64()) for k in range(3)]
            base = pa.array([listed([s for s in spans if s[1] < 3]) for spans in every], pa.string())
            cols = [batch.column(0), *counts, base, pa.array([listed(s) for s in every], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split(" ")[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def digests(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, *, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span in text replaced by the mask; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for text, spans in zip(texts, find_all(texts, model), strict=True):
                parts, end = [], 0
                for a, _, z in spans:
                    if z > end:  # overlapping spans share one mask
                        parts += [text[end:a], mask] if a >= end else []
                        end = z
                out.append(text if not spans else "".join([*parts, text[end:]]))
            cols = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_batches(docs, run, docs.schema)
