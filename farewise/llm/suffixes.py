"""Suffix order of a shard by induced sorting, in whole buckets.

Suffixes are of type S or L by the first symbol in which they differ from the next suffix. Leftmost S suffixes
are sorted first: their substrings by one round of induction, then, named by rank, as suffixes of the shorter string
of names. From their order a pass upward through the buckets induces the L suffixes and a pass downward the S
suffixes: each suffix taken from a queue puts its predecessor into the queue of that one's first symbol. A queue
receives tuples in suffix order, so it holds its part of the result ready; all tuples of a bucket move at once.

Order is needed to ``depth`` symbols only: names stop being refined there.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last symbol is."""
    n = len(t)
    nxt = np.append(t[1:], -1)
    differs = np.flatnonzero(np.append(t[:-1] != t[1:], True))
    at = differs[np.searchsorted(differs, np.arange(n))]
    s = t[at] < nxt[at]
    s[at == n - 1] = True
    return s


class Queues:
    """One queue per first symbol; tuples arrive in suffix order."""

    def __init__(self, symbols: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def push(self, first: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(first, kind="stable")
        first, suffixes = first[order], suffixes[order]
        at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(first)]):
            self.parts[first[a]].append(suffixes[a:b])

    def pop(self, symbol: int) -> list[np.ndarray]:
        got, self.parts[symbol] = self.parts[symbol], []
        return got


def _induce(t: np.ndarray, is_s: np.ndarray, symbols: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that ``lms`` (leftmost S suffixes, bucket by bucket) induces."""
    seeds, up = Queues(symbols), Queues(symbols)
    seeds.push(t[lms], lms)
    rows_l: list[np.ndarray] = [np.zeros(0, np.int64)] * symbols

    def before(p: np.ndarray, s_type: bool) -> tuple[np.ndarray, np.ndarray]:
        q = p[p > 0] - 1
        q = q[is_s[q] == s_type]
        return t[q], q

    last = np.array([len(t) - 1])
    for c in range(symbols):
        # the last suffix is its own symbol alone and precedes all others
        done, waiting = [], up.pop(c)
        while waiting:
            p = np.concatenate(waiting)
            done.append(p)
            up.push(*before(p, False))
            waiting = up.pop(c)
        rows_l[c] = np.concatenate(done) if done else rows_l[c]
        for p in seeds.pop(c):
            up.push(*before(p, False))
    down = Queues(symbols)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * symbols
    for c in range(symbols - 1, -1, -1):
        done, waiting = [], down.pop(c)
        while waiting:
            p = np.concatenate(waiting)
            done.append(p)
            down.push(*before(p, True))
            waiting = down.pop(c)
        down.push(*before(rows_l[c][::-1], True))
        s_part = np.concatenate(done)[::-1] if done else np.zeros(0, np.int64)
        out[c] = np.concatenate([last[t[last] == c], rows_l[c], s_part[s_part != last[0]]])
    return np.concatenate(out)


def _name(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each leftmost S substring (position order), equal ones alike; ``order`` has them sorted."""
    stop = np.append(lms[1:], len(t) - 1)
    length = np.empty(len(t), np.int64)
    length[lms] = stop - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[length[a[live]] > k]
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
    rank = np.empty(len(t), np.int64)
    rank[order] = np.append(0, np.cumsum(~same))
    return rank[lms]


def _sort_names(names: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the string of names, to ``depth`` symbols of the text, by doubling."""
    n, rank, step = len(names), names.copy(), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.append(False, sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        step *= 2
        covered = starts[np.minimum(np.arange(n) + step, n - 1)] - starts
        if rank[order[-1]] == n - 1 or step >= n or covered[:max(n - step, 0)].min(initial=depth) >= depth:
            return order


def suffix_order(t: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (integers below ``symbols``) in order of their first ``depth`` symbols at least."""
    t = t.astype(np.int64)
    if len(t) < 2:
        return np.arange(len(t))
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        rough = _induce(t, is_s, symbols, lms[np.argsort(t[lms], kind="stable")])
        mark = np.zeros(len(t), bool)
        mark[lms] = True
        names = _name(t, lms, rough[mark[rough]])
        lms = lms[_sort_names(names, lms, depth)]
    # the upward pass begins at the last suffix too
    return _induce(t, is_s, symbols, lms)
