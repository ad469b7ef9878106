"""Texts as sets of word n-grams: their hashes, and fingerprints of whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from matchloom.llm import common

U64 = np.uint64

SEPARATOR = np.zeros(256, np.bool_)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def feature_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct feature hashes) of every row; a row of fewer than ``n`` words has its word sequence as one feature."""
    data, offsets = common.utf8(texts)
    for i, j in common.blocks(offsets):
        part = common.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = common.words_of(part, offsets[i : j + 1] - offsets[i], ~SEPARATOR)
        word = common.span_hashes(part, starts, ends)
        m = max(len(word) - n + 1, 0)
        run = np.zeros(m, np.uint64)
        for k in range(n):
            run = common.mix64(run * U64(31) + word[k : k + m])
        for row in range(i, j):
            a, b = int(first[row - i]), int(first[row - i + 1])
            if b - a >= n:
                yield row, np.unique(run[a : b - n + 1])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    whole = common.mix64(whole * U64(131) + word[k])
                yield row, whole
            else:
                yield row, np.empty(0, np.uint64)


def fingerprint(features: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers of a set, as signed."""
    a = common.mix64(features).sum(dtype=np.uint64)
    b = common.mix64(features ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))
