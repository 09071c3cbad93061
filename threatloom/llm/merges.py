"""Byte-pair merges over many short segments at once, with numpy.

All segments lie in one array of symbols. A round merges, in every segment that still has a pair of
the vocabulary, the leftmost pair of lowest rank; segments without one leave the array. That is the
usual merge order, and a round costs a few array passes however many segments there are.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

NONE = np.int64(1) << 30  # a rank above all others
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 19


#: Characters up to here, but for one that grows when lower-cased, need no normalisation but lower-casing.
_PLAIN = [chr(i) for i in range(0x180) if i != 0x130]
PLAIN = re.compile("[" + re.escape("".join(_PLAIN)) + "]*")


def plain_pattern(pattern: str) -> str:
    """The same pattern for plain texts, with classes that Python's own, faster re knows."""

    def of(kind: str) -> str:
        return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)

    white = "\\t-\\r \x85\xa0"
    out = pattern.replace(r"[\p{L}]", f"[{of('L')}]").replace(r"[\p{N}]", f"[{of('N')}]")
    out = out.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{of('L')}{of('N')}]")
    out = out.replace(r"\p{L}", f"[{of('L')}]").replace(r"\p{N}", f"[{of('N')}]")
    return out.replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")


class MergeTable:
    """Ranks and results of symbol pairs, by open hashing in two arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.result = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        keys = left << 32 | right
        self.keys = np.full(1 << _BITS, -1, dtype=np.int64)
        self.ranks = np.full(1 << _BITS, NONE, dtype=np.int64)
        todo, at = np.arange(len(keys)), self.home(keys)
        while len(todo):
            free = self.keys[at] == -1
            winners, first = np.unique(at[free], return_index=True)
            which = todo[free][first]
            self.keys[winners], self.ranks[winners] = keys[which], which
            stay = ~np.isin(todo, which)
            todo, at = todo[stay], (at[stay] + 1) & ((1 << _BITS) - 1)

    @staticmethod
    def home(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the vocabulary doesn't merge it."""
        keys = a.astype(np.int64) << 32 | b
        at = self.home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << _BITS) - 1)
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all segments in order, and how many each has. starts: of non-empty segments."""
        n_seg = len(starts)
        counts = np.diff(np.append(starts, len(symbols)))
        if not n_seg:
            return symbols.astype(np.int32), counts
        sym, seg = symbols.astype(np.int32), np.repeat(np.arange(n_seg), counts)
        rank = np.full(len(sym), NONE, dtype=np.int64)
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        done_sym, done_seg = [], []
        while len(sym):
            begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), begin)
            live = best >> 32 < NONE
            if not live.all():
                finished = np.repeat(~live, np.diff(np.append(begin, len(sym))))
                done_sym.append(sym[finished])
                done_seg.append(seg[finished])
                best = best[live]
                moved = np.cumsum(finished)
                keep = ~finished
                sym, seg, rank = sym[keep], seg[keep], rank[keep]
                at = (best & 0xFFFFFFFF) - moved[best & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            if not len(sym):
                break
            sym[at] = self.result[best >> 32]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # each merge before it took one symbol away
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < len(sym))]
                same = seg[left] == seg[left + 1]
                rank[left[~same]] = NONE
                rank[left[same]] = self.rank(sym[left[same]], sym[left[same] + 1])
            if len(sym) and at[-1] + 1 >= len(sym):
                rank[-1] = NONE
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], np.bincount(seg, minlength=n_seg)
