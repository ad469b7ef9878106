"""The Burrows-Wheeler transform and common prefixes of a collection, column by column.

Every string of the collection grows from its end, one symbol for each string a
round. A round scans the transform so far from the start: the symbol at a
string's row tells where its next longer suffix belongs, the rows of earlier
equal symbols and the smallest common prefix passed since the last of them give
the new common prefixes. Then old and new rows are merged in one more scan. The
transform and the prefixes are files of bytes that are only read and written
from front to back, in chunks; memory holds a few numbers for each string and
one chunk.

Bytes of 255 must not occur: they mark the start of a string. Valid UTF-8 has none.
"""

from __future__ import annotations

import os

import numpy as np

END = 255
CHUNK = 1 << 20


class RangeMin:
    """Minima over ranges of an array of bytes, by doubling."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= longest:
            step, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of start..end, both included; start <= end."""
        level = LOG2[np.minimum(end - start + 1, len(LOG2) - 1)]
        out = np.empty(len(start), np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.levels[k]
            out[at] = np.minimum(row[start[at]], row[end[at] - (1 << int(k)) + 1])
        return out


LOG2 = np.zeros(CHUNK + 2, np.uint8)
LOG2[1:] = np.floor(np.log2(np.arange(1, CHUNK + 2))).astype(np.uint8)


class Collection:
    """The transform of ``strings`` (rows of bytes, the first ``lengths`` of which count) with prefixes up to ``cap``."""

    def __init__(self, strings: np.ndarray, lengths: np.ndarray, folder: str, cap: int, chunk: int = CHUNK):
        self.m, self.cap, self.chunk, self.lengths = len(lengths), cap, min(chunk, CHUNK), lengths.astype(np.int64)
        self.strings = strings
        self.folder = folder
        self.paths = [os.path.join(folder, name) for name in ("bwt-0", "lcp-0")]
        self.n = self.m
        last = self._symbol(np.arange(self.m), 0)
        last.tofile(self.paths[0])
        np.zeros(self.m, np.uint8).tofile(self.paths[1])
        self.total = np.bincount(last, minlength=256)
        who, row = np.arange(self.m), np.arange(self.m)
        keep = last != END
        who, row = who[keep], row[keep]
        size = 1
        while len(who):
            who, row = self._round(who, row, size)
            size += 1

    def _symbol(self, who: np.ndarray, size: int) -> np.ndarray:
        """The symbol before the suffix of ``size`` symbols of each string."""
        at = self.lengths[who] - size - 1
        return np.where(at >= 0, self.strings[who, np.maximum(at, 0)], END).astype(np.uint8)

    def _round(self, who: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Insert the suffix of ``size`` symbols of every string in ``who``, whose last suffix is in ``row`` (ascending)."""
        below = np.cumsum(self.total) - self.total
        seen = np.zeros(256, np.int64)
        since = np.full(256, 255, np.uint8)  # the least common prefix since a symbol's last row
        fresh = np.zeros(256, np.bool_)  # whether that row is of this round
        targets, prefixes, owners, changed, changed_to = [], [], [], [], []
        with open(self.paths[0], "rb") as bf, open(self.paths[1], "rb") as lf:
            for start in range(0, self.n, self.chunk):
                b, lcp = np.fromfile(bf, np.uint8, self.chunk), np.fromfile(lf, np.uint8, self.chunk)
                i, j = np.searchsorted(row, (start, start + len(b)))
                order = np.argsort(b, kind="stable")  # by symbol, then row
                counts = np.bincount(b, minlength=256) if self.n > self.chunk else self.total
                end = np.cumsum(counts)
                first = end - counts
                here = np.zeros(len(b), np.bool_)
                here[row[i:j] - start] = True
                new = here[order]
                at_new = np.flatnonzero(new)
                # a row that follows a new one of its symbol has another neighbour now
                own_end = end[np.searchsorted(end, at_new, "right")]
                follows = at_new[at_new + 1 < own_end] + 1
                follows = follows[~new[follows]]
                if start:
                    carried = first[np.flatnonzero((counts > 0) & fresh)]
                    follows = np.append(follows, carried[~new[carried]])
                wanted = np.append(at_new, follows)
                own = np.arange(len(wanted)) < len(at_new)
                s = np.searchsorted(end, wanted, "right")
                head = wanted == first[s]
                rank = wanted - first[s] + seen[s]
                to = order[wanted]
                least = np.zeros(len(wanted), np.uint8)
                inner = ~head
                if inner.any():
                    a, z = order[wanted[inner] - 1] + 1, to[inner]
                    least[inner] = RangeMin(lcp, int((z - a).max()) + 1)(a, z)
                if start:
                    upto = np.minimum.accumulate(lcp)
                    least[head] = np.minimum(since[s[head]], upto[to[head]])
                value = np.where(rank == 0, 0, np.minimum(least.astype(np.int64) + 1, self.cap)).astype(np.uint8)
                target = self.m + below[s] + rank
                targets.append(target[own])
                prefixes.append(value[own])
                # ``who`` and ``row`` are in order of rows, ``wanted`` in order of symbols
                owners.append(who[i:j][np.searchsorted(row[i:j], to[own] + start)])
                changed.append(target[~own])
                changed_to.append(value[~own])
                if start + len(b) < self.n:  # what the next chunk needs of this one
                    tail = np.minimum.accumulate(lcp[::-1])[::-1]
                    since = np.minimum(since, tail[0])
                    present = np.flatnonzero(counts)
                    last = order[end[present] - 1]
                    since[present], fresh[present] = np.append(tail, np.uint8(255))[last + 1], here[last]
                    seen = seen + counts
        target, prefix, owner = np.concatenate(targets), np.concatenate(prefixes), np.concatenate(owners)
        order = np.argsort(target)
        target, prefix, owner = target[order], prefix[order], owner[order]
        at, to = np.concatenate(changed), np.concatenate(changed_to)
        order = np.argsort(at)
        at, to = at[order], to[order]
        symbols = self._symbol(owner, size)
        self._merge(target, symbols, prefix, at, to)
        self.total += np.bincount(symbols, minlength=256)
        self.n += len(target)
        keep = symbols != END
        return owner[keep], target[keep]

    def _merge(self, target: np.ndarray, symbols: np.ndarray, prefix: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        n = self.n + len(target)
        names = [os.path.join(self.folder, f"{name}-{n}") for name in ("bwt", "lcp")]
        with open(self.paths[0], "rb") as bf, open(self.paths[1], "rb") as lf, open(names[0], "wb") as bo, open(names[1], "wb") as lo:
            for start in range(0, n, self.chunk):
                size = min(self.chunk, n - start)
                i, j = np.searchsorted(target, (start, start + size))
                u, v = np.searchsorted(at, (start, start + size))
                old = np.ones(size, np.bool_)
                old[target[i:j] - start] = False
                for f, o, values in ((bf, bo, symbols), (lf, lo, prefix)):
                    out = np.empty(size, np.uint8)
                    out[old] = np.fromfile(f, np.uint8, size - (j - i))
                    out[~old] = values[i:j]
                    if o is lo:
                        out[at[u:v] - start] = to[u:v]
                    out.tofile(o)
        for path in self.paths:
            os.unlink(path)
        self.paths = names

    def common_prefixes(self) -> np.ndarray:
        """Of each row with the row before it, ``cap`` at most."""
        return np.fromfile(self.paths[1], np.uint8)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """String and size of the suffix in each row, by walking every string back from its end."""
        b = np.fromfile(self.paths[0], np.uint8)
        order = np.argsort(b, kind="stable")[: self.n - int((b == END).sum())]
        step = np.full(self.n, -1, np.int64)
        step[order] = self.m + np.arange(len(order))
        string, size = np.empty(self.n, np.int32), np.empty(self.n, np.int32)
        row, who, k = np.arange(self.m), np.arange(self.m), 0
        while len(row):
            string[row], size[row] = who, k
            row = step[row]
            row, who, k = row[row >= 0], who[row >= 0], k + 1
        return string, size


def least_by_window(strings: np.ndarray, lengths: np.ndarray, values: np.ndarray, window: int, folder: str) -> np.ndarray:
    """For each string and each start of a window in it, the least of ``values`` over the strings that have an equal window.

    Windows are equal where their rows are neighbours with common prefixes of at least ``window``.
    """
    c = Collection(strings, lengths, folder, window)
    string, size = c.suffixes()
    head = c.common_prefixes() < window
    head[0] = True
    least = np.minimum.reduceat(values[string], np.flatnonzero(head))[np.cumsum(head) - 1]
    out = np.full((len(lengths), max(strings.shape[1] - window + 1, 1)), np.iinfo(np.int64).max)
    full = size >= window
    out[string[full], lengths[string[full]] - size[full]] = least[full]
    return out
