"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Suffixes are classified as larger (L) or smaller (S) than their successor. Leftmost-smaller (LMS)
substrings are sorted by inducing, named, and, while names repeat, sorted recursively; the sorted LMS
suffixes then induce all L suffixes bucket by bucket upwards, and those all S suffixes downwards. A
bucket, or a range of buckets that doesn't induce into itself, is handled as one array. Suffixes are put into
their buckets by counting (16-bit digits, for which numpy's stable order is a radix sort), so every step is linear.
"""

from __future__ import annotations

import numpy as np


def counted_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of keys (not negative) by counting, one pass for each 16-bit digit; few keys are compared."""
    if len(keys) < 64:
        return keys.argsort(kind="stable")
    order = keys.astype(np.uint16).argsort(kind="stable")
    rest = keys >> 16
    while rest.any():
        order, rest = order[rest[order].astype(np.uint16).argsort(kind="stable")], rest >> 16
    return order


def _ranks_in_order(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by character, with the characters present, where each begins in it and how many each has."""
    order = counted_order(chars)
    ranked = chars[order]
    fresh = np.ones(len(ranked), dtype=bool)
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    first = fresh.nonzero()[0]
    counts = np.empty_like(first)
    counts[:-1] = first[1:] - first[:-1]
    counts[-1] = len(ranked) - first[-1]
    return order, ranked[first], first, counts


def _induce(s: np.ndarray, k: int, seeds: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sorted suffixes of the wanted type, induced from sorted seeds; within a bucket they stand before the seeds.

    s: characters in the direction of the pass, so a wanted predecessor never has a smaller one.
    """
    offsets = np.append(0, np.cumsum(np.bincount(s[wanted], minlength=k)))
    out, head = np.zeros(offsets[-1], dtype=np.int64), offsets[:-1].copy()
    seed_at, places = np.searchsorted(s[seeds], np.arange(k + 1)), np.arange(len(s))

    def place(before: np.ndarray) -> None:
        if len(before):
            order, present, first, counts = _ranks_in_order(s[before])
            at = head[present]
            out[(at - first).repeat(counts) + places[: len(before)]] = before[order]
            head[present] = at + counts

    def predecessors(entries: np.ndarray) -> np.ndarray:
        before = entries[entries > 0] - 1
        return before[wanted[before]]

    c, step = 0, 1
    while c < k:
        end = min(k, c + step)
        mine, more = out[offsets[c] : head[end - 1]] if step == 1 else None, seeds[seed_at[c] : seed_at[end]]
        if step > 1:
            filled = np.concatenate([out[offsets[b] : head[b]] for b in range(c, end)]) if end - c <= 4 else out[offsets[c] : offsets[end]][_filled(offsets, head, c, end)]
            both = np.concatenate([filled, more])
            keys = s[both] * 2
            keys[len(filled) :] += 1
            both = both[counted_order(keys)]
            keep = both > 0
            before, at = both[keep] - 1, s[both[keep]]
            good = wanted[before]
            before, at = before[good], at[good]
            if len(before):
                low = np.minimum.accumulate(s[before])
                bad = np.flatnonzero(at >= low)
                stop = min(end, int(low[-1]) if not len(bad) else min(int(at[bad[0]]), int(low[bad[0] - 1]) if bad[0] else end))
                if stop <= c:
                    step = 1
                    continue
                if stop < end:
                    before = before[at < stop]
                    step = max(1, (stop - c) * 2)
                    end = stop
                else:
                    step *= 2
            else:
                step *= 2
            place(before)
            c = end
            continue
        done = offsets[c]
        while done < head[c]:  # runs of one character induce into their own bucket
            mine = out[done : head[c]]
            done = head[c]
            place(predecessors(mine.copy()))
        place(predecessors(more))
        c, step = end, 2 if k > 512 else 1
    return out


def _filled(offsets: np.ndarray, head: np.ndarray, c: int, end: int) -> np.ndarray:
    size = offsets[end] - offsets[c]
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, offsets[c:end] - offsets[c], 1)
    np.add.at(edge, head[c:end] - offsets[c], -1)
    return np.cumsum(edge)[:size] > 0


def _sorted_from(s: np.ndarray, k: int, small: np.ndarray, lms_sorted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    larger = _induce(s, k, lms_sorted, ~small)
    mirrored = k - 1 - s
    wanted = small.copy()
    wanted[-1] = False  # the sentinel is induced by nothing
    smaller = _induce(mirrored, k, larger[::-1], wanted)[::-1]
    return larger, np.append(len(s) - 1, smaller)


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of s (values below k) whose last value is its only smallest one."""
    s = s.astype(np.int64)
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    rises = np.sign(s[1:] - s[:-1])
    at = np.where(rises != 0, np.arange(n - 1), n)  # the next place where the character changes decides
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.append(rises[at] > 0, True)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        ordered = lms
    else:
        by_char = lms[counted_order(s[lms])]
        _, smaller = _sorted_from(s, k, small, by_char)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        ranked = smaller[is_lms[smaller]]
        place = np.zeros(n, dtype=np.int64)
        place[lms] = np.arange(len(lms))
        length = np.append(np.diff(lms) + 1, 1)[place[ranked]]  # LMS substrings share their end
        same = length[1:] == length[:-1]
        pairs = np.flatnonzero(same)
        if len(pairs):
            sizes = length[pairs]
            first = np.cumsum(sizes) - sizes
            inner = np.arange(sizes.sum()) - np.repeat(first, sizes)
            equal = s[np.repeat(ranked[pairs], sizes) + inner] == s[np.repeat(ranked[pairs + 1], sizes) + inner]
            same[pairs] = np.logical_and.reduceat(equal, first)
        names = np.append(0, np.cumsum(~same))
        if names[-1] + 1 == len(lms):
            ordered = ranked
        else:
            reduced = np.zeros(len(lms), dtype=np.int64)
            reduced[place[ranked]] = names
            ordered = lms[suffix_array(reduced, int(names[-1]) + 1)]
    larger, smaller = _sorted_from(s, k, small, ordered)
    both = np.concatenate([larger, smaller])
    keys = s[both] * 2
    keys[len(larger) :] += 1
    return both[counted_order(keys)]


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, separator: int, most: int) -> np.ndarray:
    """For each suffix, the characters shared with the one before it in sa, up to a separator or most.

    Only irreducible suffixes, whose preceding characters differ, are compared; the values of the others follow.
    """
    n = len(s)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    here = np.arange(n)
    reducible = np.zeros(n, dtype=bool)
    inner = here[1:][phi[1:] > 0]
    reducible[inner] = (s[inner - 1] == s[phi[inner] - 1]) & (s[inner - 1] != separator)
    todo = np.flatnonzero(~reducible & (phi >= 0))
    plcp = np.zeros(n, dtype=np.int64)
    padded = np.append(s, np.full(16, separator, dtype=s.dtype))
    reach = 0
    while len(todo) and reach < most:
        a, b = np.minimum(todo + reach, n), np.minimum(phi[todo] + reach, n)
        x, y = padded[a[:, None] + np.arange(16)], padded[b[:, None] + np.arange(16)]
        differs = (x != y) | (x == separator)
        stops = differs.any(1)
        plcp[todo] += np.where(stops, differs.argmax(1), 16)
        todo = todo[~stops]
        reach += 16
    source = np.maximum.accumulate(np.where(reducible, 0, here))
    return np.maximum(plcp[source] - (here - source), 0)
