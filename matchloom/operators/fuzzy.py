"""Nearest texts of a catalogue by token set similarity, through an index that bounds every score before any is computed.

For a text and a row of the catalogue, the longest common subsequence of their sorted words has at most as many
characters as both have in common, and at most a third of (their lengths, their common bigrams and one): an
insertion breaks one bigram, a deletion two. Common words count exactly. Rows are verified in the order of
these bounds until none left can enter the best ``k``; rows without a common word are verified many at a time.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np

from matchloom.functions import similarity

#: Rows verified in one step, and characters of a text up to which one 64-bit word holds a column of the subsequence's matrix.
STEP, WORD = 256, 64


def _joined(text: str | None) -> str:
    return " ".join(sorted(set((text or "").split())))


class _Counts:
    """Postings of features that occur in texts: for the k-th occurrence of a feature, the rows that have it so often."""

    def __init__(self, features: list[list[str]]):
        rows = defaultdict(list)
        for row, own in enumerate(features):
            for f, n in Counter(own).items():
                for k in range(n):
                    rows[f, k].append(row)
        self.rows = {f: np.array(r, np.int32) for f, r in rows.items()}
        self.n = len(features)

    def common(self, own: list[str]) -> np.ndarray:
        """How many features each row has in common with ``own``."""
        total = np.zeros(self.n, np.int32)
        for f, n in Counter(own).items():
            for k in range(n):
                if (f, k) in self.rows:
                    total[self.rows[f, k]] += 1
        return total


class Index:
    """A block of a catalogue: rows of (ord, code, text)."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        self.rows = sorted(rows, key=lambda r: r[0])
        self.texts = [_joined(t) for _, _, t in self.rows]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ords = np.array([r[0] for r in self.rows], np.int64)
        self.chars = _Counts([list(t) for t in self.texts])
        self.pairs = _Counts([[t[i : i + 2] for i in range(len(t) - 1)] for t in self.texts])
        self.words, self.codes = defaultdict(list), defaultdict(list)
        for row, text in enumerate(self.texts):
            for w in text.split():
                self.words[w].append(row)
            self.codes[self.rows[row][1]].append(row)
        self.numbers = [np.array([ord(c) for c in t], np.int32) for t in self.texts]
        #: Rows that were compared, of all that were asked for.
        self.verified = self.asked = 0

    def _subsequences(self, text: str, rows: np.ndarray) -> np.ndarray:
        """The longest common subsequence of ``text`` with each row, bit-parallel over the text and numpy over the rows."""
        sizes = self.sizes[rows]
        table = np.zeros((int(sizes.max()), len(rows)), np.int32)
        for k, row in enumerate(rows.tolist()):
            table[: sizes[k], k] = self.numbers[row]
        letters = {c: i + 1 for i, c in enumerate(dict.fromkeys(text))}
        masks = np.zeros(len(letters) + 1, np.uint64)
        for i, c in enumerate(text):
            masks[letters[c]] |= np.uint64(1 << i)
        known, place = np.unique(table, return_inverse=True)
        of_known = np.array([masks[letters.get(chr(c), 0)] if c else np.uint64(0) for c in known.tolist()], np.uint64)
        hits = of_known[place.reshape(table.shape)]
        rest = np.full(len(rows), np.uint64((1 << len(text)) - 1))
        for hit in hits:
            both = rest & hit
            rest = (rest + both) | (rest - both)
        held = rest & np.uint64((1 << len(text)) - 1)
        return len(text) - np.bitwise_count(held).astype(np.int64)

    def search(self, text: str | None, k: int, boost: float) -> list[tuple[float, int, str]]:
        """(score, ord, code) of the ``k`` best rows; ties go to the smaller ``ord``."""
        own = set((text or "").split())
        said = _joined(text)
        n = len(self.rows)
        self.asked += n
        more = np.zeros(n)
        for w in own:
            more[self.codes.get(w, [])] = boost
        if not said:
            order = np.lexsort((self.ords, -more))[:k]
            return [(float(min(1.0, more[r])), int(self.ords[r]), self.rows[r][1]) for r in order]
        total = self.sizes + len(said)
        most = np.minimum(self.chars.common(list(said)), (self.pairs.common([said[i : i + 2] for i in range(len(said) - 1)]) + total + 1) // 3)
        bound = np.where(self.sizes > 0, 2.0 * most / total, 0.0)
        sharing = np.zeros(n, np.int64)  # characters of common words, with a space after each
        for w in own:
            sharing[self.words.get(w, [])] += len(w) + 1
        some = sharing > 0
        base = np.where(some, sharing - 1, 0)
        part = np.where(some, np.maximum(2.0 * base / np.maximum(base + self.sizes, 1), 2.0 * base / (base + len(said))), 0.0)
        part = np.where(some & ((base == self.sizes) | (base == len(said))), 1.0, part)
        bound = np.minimum(1.0, np.maximum(bound, part) + more) + 1e-9
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int, int]] = []  # (score, -ord, row), the worst first
        at = 0
        while at < n and (len(best) < k or bound[order[at]] >= best[0][0]):
            rows = order[at : at + (STEP if at else max(k, 16))]
            at += len(rows)
            if len(best) == k:
                rows = rows[bound[rows] >= best[0][0]]
            self.verified += len(rows)
            scores = np.zeros(len(rows))
            plain = ~some[rows] & (self.sizes[rows] > 0)
            if len(said) <= WORD and plain.any():
                scores[plain] = 200.0 * self._subsequences(said, rows[plain]) / total[rows[plain]] / 100
            else:
                plain[:] = False
            for i in np.flatnonzero(~plain).tolist():
                scores[i] = similarity.token_sets(text or "", self.rows[rows[i]][2] or "") / 100
            scores = np.minimum(1.0, scores + more[rows])
            for row, score in zip(rows.tolist(), scores.tolist(), strict=True):
                entry = (score, -int(self.ords[row]), row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -o, self.rows[row][1]) for s, o, row in sorted(best, reverse=True)]
