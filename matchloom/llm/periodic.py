"""Periodic runs of words in each text: every maximal stretch that repeats a period of words often enough.

A task works on blocks of texts:

1. Words get numbers (exactly, by a dictionary of the block). Doubling of ranks
   sorts all suffixes of the block's texts, which never compare as equal across
   texts; neighbours get their longest common prefix. Both steps are numpy.
2. A run of ``length`` words with ``period`` has a suffix that occurs again
   ``period`` words before, so a text whose common prefixes all stay under
   ``min_length * (1 - 1 / min_exponent)`` has no run. The others go on alone.
3. The longest previous factor of each position follows from the suffix array by
   one scan with a stack, and cuts the text into blocks, each a copy of what came before.
4. Runs that touch or cross a boundary of blocks come from Main's extensions: for
   every period, how far the text agrees with itself to the right and to the
   left. If a run crosses the boundary between blocks of ``a`` and ``b`` words
   and ends in the second, then ``(min_exponent - 1) * period <= a + b``,
   so all extensions together take linear time.
5. Runs inside a block are those of its source: buckets by first word are copied from left to right.

Time is about linear in the words, memory that of the largest text or block.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm import common
from matchloom.llm.wordsets import SEPARATOR

#: Common prefixes up to this length are compared column by column, longer ones from suffix to suffix.
STEPS = 16

RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words, and only those, get equal numbers from 0."""
    if not len(starts):
        return np.empty(0, np.int64)
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of ``symbols``, the last of which is unique, by doubling of ranks; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    in_order = symbols[order]
    head = np.ones(n, np.bool_)
    head[1:] = in_order[1:] != in_order[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # where the group of each slot starts
    rank = np.empty(n, np.int64)
    rank[order] = first
    step = 1
    tied = np.flatnonzero(~head | ~np.append(head[1:], True))
    while len(tied):
        at = order[tied]
        group, after = rank[at], rank[at + step]  # a tie never reaches past a unique symbol, so at + step exists
        by = np.lexsort((after, group))
        at, group, after = at[by], group[by], after[by]
        order[tied] = at
        new = np.ones(len(at), np.bool_)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = tied[~new | ~np.append(new[1:], True)]
        step *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix in ``order`` with the one before it."""
    n = len(symbols)
    lcp = np.zeros(n, np.int64)
    slots = np.arange(1, n)
    for step in range(STEPS):
        a, b = order[slots] + step, order[slots - 1] + step
        slots = slots[symbols[a] == symbols[b]]
        lcp[slots] = step + 1
        if not len(slots):
            return lcp
    # the rest in order of text: the prefix of the next position is shorter by one at most
    words, before = symbols.tolist(), np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    places = np.sort(order[slots])
    long, last, size = [], -2, STEPS
    for i, j in zip(places.tolist(), before[places].tolist(), strict=True):
        size = max(size - 1, STEPS) if i == last + 1 else STEPS
        while words[i + size] == words[j + size]:
            size += 1
        long.append(size)
        last = i
    lcp[slot[places]] = long
    return lcp


def previous_factors(order: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """For each position the length of its longest factor that also starts earlier, and such an earlier start."""
    n = len(order)
    longest, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []
    for k in range(n + 1):
        here, size = (order[k], lcp[k]) if k < n else (-1, 0)
        while stack and here < stack[-1][0]:
            top, below = stack.pop()
            if below >= size:
                longest[top], source[top] = below, stack[-1][0] if stack else -1
            else:
                longest[top], source[top] = size, here
            size = min(size, below)
        stack.append((here, size))
    return longest, source


def agreements(x: list[int]) -> list[int]:
    """For each position of ``x``, how many symbols from there agree with the start of ``x``."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_boundary(words: list[int], before: int, at: int, end: int, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of runs that touch or cross ``at`` and end in ``at .. end``; the block before starts at ``before``.

    ``words`` has a symbol of its own at the end of the text.
    """
    longest = (end - before) // (exponent - 1)
    low = max(0, before - longest - 1)
    right, left = words[at : end + 1], words[low:at][::-1]
    found = []
    inner = min(longest, end - at)
    gap = [-1]
    # the period to the right of the boundary is within the run
    if inner:
        ahead = agreements(right)
        back = agreements(left + gap + right[:inner][::-1] + left)[len(left) + 1 :]
        for period in range(1, inner + 1):
            start, stop = at - back[inner - period], at + period + ahead[period]
            if stop <= end and stop - start >= least and stop - start >= exponent * period and (start > low or not low):
                found.append((start, stop, period))
    # the period to its left is
    inner = min(longest, len(left))
    if inner:
        back = agreements(left)
        ahead = agreements(right + gap + left[:inner][::-1] + right)[len(right) + 1 :]
        for period in range(1, inner + 1):
            start, stop = at - period - (back[period] if period < len(left) else 0), at + ahead[inner - period]
            if stop <= end and stop - start >= least and stop - start >= exponent * period and (start > low or not low):
                found.append((start, stop, period))
    return found


def runs_of(words: list[int], order: list[int], lcp: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period; ``words`` ends with a symbol of its own."""
    n = len(words) - 1
    longest, source = previous_factors(order, lcp)
    cuts, at = [], 0
    while at < n:
        cuts.append(at)
        at += max(1, longest[at])
    cuts.append(n)
    reach = least * (exponent - 1)  # of exponent times the words in two blocks beside a boundary
    periods: dict[tuple[int, int], int] = {}
    for k in range(1, len(cuts)):
        end = cuts[min(k + 1, len(cuts) - 1)]
        if exponent * (end - cuts[k - 1]) >= reach:
            for start, stop, period in _at_boundary(words, cuts[k - 1], cuts[k], end, least, exponent):
                periods[start, stop] = min(period, periods.get((start, stop), period))
    buckets = defaultdict(list)
    for (start, stop), period in periods.items():
        buckets[start].append((stop, period))
    for k in range(len(cuts) - 1):
        at, size = cuts[k], cuts[k + 1] - cuts[k]
        if size < least + 2:
            continue
        shift = at - source[at]
        for start in range(source[at] + 1, source[at] + size - least):
            if start in buckets:
                for stop, period in buckets[start]:
                    if stop < source[at] + size:
                        buckets[start + shift].append((stop + shift, period))
    return sorted((start, stop - start, period) for start, there in buckets.items() for stop, period in set(there))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words are in the first period of every run that has them."""
    dropped = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return np.cumsum(dropped)[:n] == 0


def _runs_of_block(numbers: np.ndarray, first: np.ndarray, least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text; ``numbers`` are the words of all, ``first`` the bounds of the texts."""
    n_texts, n = len(first) - 1, len(numbers)
    row = np.repeat(np.arange(n_texts), np.diff(first))
    _, own = np.unique(row * (int(numbers.max()) + 1 if n else 1) + numbers, return_inverse=True)
    symbols = np.empty(n + n_texts, np.int64)
    symbols[np.arange(n) + row] = own
    bounds = first + np.arange(n_texts + 1)  # each text takes one symbol more, that marks its end
    symbols[bounds[1:] - 1] = n + np.arange(n_texts)
    order = suffix_order(symbols)
    lcp = common_prefixes(symbols, order)
    where = np.searchsorted(bounds, order, "right") - 1
    most = np.zeros(n_texts, np.int64)
    np.maximum.at(most, where, lcp)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_texts)]
    some = np.flatnonzero(exponent * most >= least * (exponent - 1))
    if not len(some):
        return out
    by_text = np.argsort(where, kind="stable")
    for t in some.tolist():
        a, z = int(bounds[t]), int(bounds[t + 1])
        slots = by_text[a:z]  # as many suffixes as the text has symbols
        sub = lcp[slots]
        sub[0] = 0
        # suffixes of other texts lie between only where the common prefix is empty
        out[t] = runs_of(symbols[a:z].tolist(), (order[slots] - a).tolist(), sub.tolist(), least, exponent)
    return out


def runs(docs: DataFrame, text: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without repetitions.

    A run is a stretch of words with smallest period ``period`` that no
    neighbouring word extends, of at least ``min_length`` words and ``min_exponent``
    periods. Words are parted by ASCII white space; ``collapsed`` has the words that
    lie in no run or only in the first period of every run that has them, joined by one space.

    Defined results: a null, an empty or a blank text has no words, no runs and
    an empty ``collapsed``; equal texts have equal results; ids are not looked
    at, so rows may repeat and ids be null; an empty table gives an empty one.
    A text of any length is worked on whole. Own columns of these three names are replaced.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run has two periods and one word at least")

    def of_batch(column: pa.Array) -> list[pa.Array]:
        data, offsets = common.utf8(column)
        counts, found, texts = [], [], []
        for i, j in common.blocks(offsets):
            part = data[offsets[i] : offsets[j]]
            starts, ends, first = common.words_of(part, offsets[i : j + 1] - offsets[i], ~SEPARATOR)
            counts.append(np.diff(first))
            of_texts = _runs_of_block(word_numbers(part, starts, ends), first, min_length, min_exponent)
            for k, of_text in enumerate(of_texts):
                words = part[int(offsets[i + k] - offsets[i]) : int(offsets[i + k + 1] - offsets[i])].tobytes().split()
                if of_text:
                    words = [words[w] for w in np.flatnonzero(_kept(len(words), of_text)).tolist()]
                texts.append(b" ".join(words))
            found += of_texts
        flat = np.array([r for of_text in found for r in of_text], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=[pa.field(f.name, pa.int64(), False) for f in RUN.fields])
        bounds = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        return [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.ListArray.from_arrays(bounds, structs), pa.array(texts, pa.binary()).cast(pa.string())]

    # columns go through the map under plain names: a name with a dot would not
    adds = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN, False)), ("collapsed", T.StringType())]
    keep = [c for c in docs.columns if c.lower() not in {name for name, _ in adds}]
    said = f"c{keep.index(text)}" if text in keep else "said"
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), *([] if text in keep else [F.col(f"`{text}`").alias(said)]))
    found = common.with_columns_by_batch(plain, [said], adds, of_batch)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *(name for name, _ in adds))


def best(found: str = "runs") -> F.Column:
    """The run of the greatest length / period, compared exactly; ties go to the smallest start, then period. Null without runs."""
    more = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    return F.aggregate(found, F.get(found, F.lit(0)), more)
