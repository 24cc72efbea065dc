"""Suffix sorting by linear grouping.

Suffixes start in groups by first symbol.  Groups are taken in descending order; every suffix i of the
group gets its previous-smaller pointer: the last j < i whose group is lower, found by following
pointers already known.  The suffixes pointed at extend their prefix by the group's, so they leave
their group for new ones right above it, the higher the more pointers they got.  When all groups
were taken, a group holds the suffixes that share their longest Lyndon prefix.  The order is then
emitted from left to right: the suffix before an emitted one, and those along its pointers, are
next in their groups.  Nothing is renamed and nothing recurses.

``sort_many`` runs this on many strings at once, one group of every string per step, so that each step is
a few array operations; ``sort_one`` runs it on one long string.  Both sort a suffix that is a prefix of
another before it.
"""

from __future__ import annotations

import numpy as np

LONG = 3000  # strings above this length are sorted one by one


def sort_one(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of one string, in order."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    first = np.argsort(symbols, kind="stable")
    fresh = np.flatnonzero(np.append(True, symbols[first][1:] != symbols[first][:-1]))
    starts = np.repeat(fresh, np.diff(np.append(fresh, n)))
    group_of = np.empty(n, np.int64)
    group_of[first] = starts
    at = np.empty(n, np.int64)
    at[first] = np.arange(n)
    sa, gid, isa = first.tolist(), group_of.tolist(), at.tolist()
    gid.append(-1)  # gid[-1]: the place before the string
    end_of = {int(a): int(b) for a, b in zip(fresh, np.append(fresh[1:], n))}
    prev, end = [-1] * n, n
    while end > 0:
        start = gid[sa[end - 1]]
        counts: dict[int, int] = {}
        for i in sorted(sa[start:end]):
            j = i - 1
            while gid[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        moved: dict[int, list[tuple[int, int]]] = {}
        for j, k in counts.items():
            moved.setdefault(gid[j], []).append((k, j))
        for h, js in moved.items():
            js.sort()
            top = end_of[h]
            low = top - len(js)
            # those that stay take the places of those that leave
            leaving = {j for _, j in js}
            stay = [s for s in sa[low:top] if s not in leaving]
            holes = [isa[j] for _, j in js if isa[j] < low]
            for s, p in zip(stay, holes):
                sa[p], isa[s] = s, p
            end_of[h] = low
            for p, (k, j) in enumerate(js, low):
                sa[p], isa[j] = j, p
                if p == low or k != js[p - low - 1][0]:
                    begin = p
                gid[j] = begin
                end_of[begin] = p + 1
        end = start
    free = list(range(n))  # next place of the group that starts there
    out, placed = [-1] * n, [False] * n
    i, j = -1, n - 1
    while True:
        while j >= 0 and not placed[j]:
            g = gid[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
        i += 1
        if i == n:
            break
        j = out[i] - 1
    return np.array(out)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def sort_many(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix orders of strings laid end to end; positions count over the whole array.

    String s covers ``sum(lengths[:s])`` and on; so does its order in the result.
    """
    total, count = int(lengths.sum()), len(lengths)
    if not total:
        return np.zeros(0, np.int64)
    # one place before every string, whose group is below all others
    base = np.cumsum(lengths + 1) - (lengths + 1)
    size = total + count
    inside = np.ones(size, bool)
    inside[base] = False
    owner = np.repeat(np.arange(count), lengths)
    key = owner.astype(np.int64) << 32 | symbols.astype(np.int64)
    place = np.flatnonzero(inside)
    order = np.argsort(key, kind="stable")
    sa = np.full(size, -1, np.int64)
    sa[place] = place[order]
    fresh = np.append(True, key[order][1:] != key[order][:-1])
    starts = place[np.maximum.accumulate(np.where(fresh, np.arange(total), 0))]
    gid = np.full(size, -1, np.int64)
    gid[sa[place]] = starts
    isa = np.zeros(size, np.int64)
    isa[sa[place]] = place
    edge = np.flatnonzero(fresh)
    end_of = np.zeros(size + 1, np.int64)
    end_of[place[edge]] = place[np.append(edge[1:], total) - 1] + 1
    prev = np.zeros(size, np.int64)
    leaving = np.zeros(size, bool)
    live = np.flatnonzero(lengths > 0)
    end = (base + lengths + 1)[live]
    low = base[live] + 1
    while len(end):
        start = gid[sa[end - 1]]
        members = sa[_ranges(start, end - start)]
        bound = np.repeat(start, end - start)
        j = members - 1
        prev[members] = j  # until it is known: one place back
        open_ = np.flatnonzero(gid[j] >= bound)
        while len(open_):
            j[open_] = prev[j[open_]]
            open_ = open_[gid[j[open_]] >= bound[open_]]
        prev[members] = j
        hit = j[gid[j] >= 0]
        if len(hit):
            node, k = np.unique(hit, return_counts=True)
            h = gid[node]
            o = np.lexsort((k, h))
            node, k, h = node[o], k[o], h[o]
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n_h = np.diff(np.append(cut, len(h)))
            tail = end_of[h[cut]] - n_h
            dest = _ranges(tail, n_h)
            leaving[node] = True
            here = sa[dest]
            stay = here[~leaving[here]]
            hole = isa[node]
            hole = hole[hole < np.repeat(tail, n_h)]
            sa[hole] = stay
            isa[stay] = hole
            sa[dest] = node
            isa[node] = dest
            leaving[node] = False
            end_of[h[cut]] = tail
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])))
            n_new = np.diff(np.append(new, len(h)))
            gid[node] = np.repeat(dest[new], n_new)
            end_of[dest[new]] = dest[new] + n_new
        more = start > low
        end, low = start[more], low[more]
    # emission: every string places one suffix or moves on by one, per step
    free = np.arange(size)
    out = np.full(size, -1, np.int64)
    placed = np.zeros(size, bool)
    placed[base] = True
    i, last = base[live].copy(), (base + lengths)[live]
    j = last.copy()
    while len(i):
        do = ~placed[j]
        on = np.flatnonzero(do)
        if len(on):
            node = j[on]
            g = gid[node]
            out[free[g]] = node
            free[g] += 1
            placed[node] = True
            j[on] = prev[node]
        off = np.flatnonzero(~do)
        if len(off):
            i[off] += 1
            done = i[off] > last[off]
            go = off[~done]
            j[go] = out[i[go]] - 1
            if done.any():
                keep = np.ones(len(i), bool)
                keep[off[done]] = False
                i, last, j = i[keep], last[keep], j[keep]
    shift = np.repeat(np.arange(count) + 1, lengths)
    return out[place] - shift


def sort_strings(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """As ``sort_many``; long strings are sorted one by one."""
    long = np.flatnonzero(lengths > LONG)
    if not len(long):
        return sort_many(symbols, lengths)
    at = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), np.int64)
    short = np.repeat(lengths <= LONG, lengths)
    if short.any():
        keep = np.flatnonzero(short)
        out[keep] = keep[sort_many(symbols[keep], lengths[lengths <= LONG])]
    for s in long:
        a, b = int(at[s]), int(at[s] + lengths[s])
        out[a:b] = a + sort_one(symbols[a:b])
    return out
