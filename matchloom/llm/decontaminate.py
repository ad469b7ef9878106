"""Benchmark decontamination: training texts against a broadcast hash set of normalised test n-grams.

Words are runs of digits, lower-cased ASCII letters and characters beyond ASCII.
Every window of ``N`` consecutive words of a benchmark item (the whole item if
it has fewer) is a test n-gram. The tasks hash all windows of a training text,
look the hashes up and compare the words of each hit.

The set is broadcast in slices of at most ``MAX_WINDOWS`` windows; a benchmark
that needs several slices costs a pass over the texts for each, whose hits add
up. So the size of a broadcast is bounded, whatever the benchmark's.

Defined results: null and empty texts have no words and no hits; items without
a word or an id are skipped; items that repeat an id count once; repeated
documents get one row each. Texts of any length are read whole. Added columns
replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm import common
from matchloom.session import staged

N = 10
#: Windows in one broadcast set; at about 150 bytes each, some 150 MB.
MAX_WINDOWS = 1_000_000
FILTER_BITS = 22
U64 = np.uint64

WORD = np.zeros(256, np.bool_)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

HITS = T.ArrayType(T.StructType([T.StructField("word", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("item", T.StringType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def rolling(word: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` words."""
    m = max(len(word) - length + 1, 0)
    h = np.full(m, length, np.uint64)
    for k in range(length):
        h = h * U64(common.BASE) + word[k : k + m]
    return common.mix64(h)


def split_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = common.LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = common.words_of(data, np.array([0, len(data)]), WORD)
    return data, starts, ends


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """(item, length, window, slot) of each different window of an item; slot spreads windows evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, starts, ends = split_words((body or "").encode())
                words = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
                k = min(n, len(words))
                rows += {(name, k, b" ".join(words[i : i + k])) for i in range(len(words) - k + 1) if k}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["item", "length", "window"])

    named = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    found = named.mapInArrow(run, "item string, length int, window binary").distinct()
    return found.withColumn("slot", F.pmod(F.xxhash64("window"), F.lit(1 << 30)))


class WindowSet:
    """One slice of the test n-grams."""

    def __init__(self, rows: pd.DataFrame):
        self.by_length = {}
        for length, part in rows.groupby("length"):
            bodies, where = np.unique(np.array(part["window"].tolist(), dtype=object), return_inverse=True)
            items: list[list[str]] = [[] for _ in bodies]
            for w, name in zip(where, part["item"], strict=True):
                items[w].append(name)
            hashes = []
            for body in bodies:
                data, starts, ends = split_words(body)
                hashes.append(rolling(common.span_hashes(data, starts, ends), int(length))[0])
            order = np.argsort(np.array(hashes, np.uint64), kind="stable")
            keys = np.array(hashes, np.uint64)[order]
            seen = np.zeros(1 << FILTER_BITS, np.bool_)
            seen[keys & U64((1 << FILTER_BITS) - 1)] = True
            self.by_length[int(length)] = (keys, [bytes(bodies[i]) for i in order], [sorted(set(items[i])) for i in order], seen)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, list[str]]]:
        """(row, word within the row, length, items) of each occurrence."""
        word = common.span_hashes(data, starts, ends)
        for length, (keys, bodies, items, seen) in self.by_length.items():
            h = rolling(word, length)
            maybe = np.flatnonzero(seen[h & U64((1 << FILTER_BITS) - 1)])
            at = np.searchsorted(keys, h[maybe])
            at[at == len(keys)] = 0
            same = keys[at] == h[maybe]
            maybe, at = maybe[same], at[same]
            row = np.searchsorted(first, maybe, "right") - 1
            inside = maybe + length <= first[row + 1]
            for i, k, r in zip(maybe[inside].tolist(), at[inside].tolist(), row[inside].tolist(), strict=True):
                body = b" ".join(data[starts[w] : ends[w]].tobytes() for w in range(i, i + length))
                while k < len(keys) and keys[k] == h[i]:
                    if bodies[k] == body:
                        yield r, i - int(first[r]), length, items[k]
                    k += 1


def texts_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, word starts, word ends, first word of each row) of each block of rows."""
    data, offsets = common.utf8(texts)
    for i, j in common.blocks(offsets):
        part = common.LOWER[data[offsets[i] : offsets[j]]]
        yield (i, part, *common.words_of(part, offsets[i : j + 1] - offsets[i], WORD))


def _add_hits(docs: DataFrame, text: str, found: pd.DataFrame, earlier: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(WindowSet(found))

    def run(texts: pa.Array, *before: pa.Array) -> list[pa.Array]:
        hits: list[list] = before[0].to_pylist() if before else [[] for _ in range(len(texts))]
        for i, part, starts, ends, first in texts_of(texts):
            for row, word, length, items in held.value.find(part, starts, ends, first):
                hits[i + row] += [{"word": word, "length": length, "item": name} for name in items]
        return [pa.array(hits, pa.list_(pa.struct([("word", pa.int32()), ("length", pa.int32()), ("item", pa.string())])))]

    return common.with_columns_by_batch(docs, [text, *["__hits"] * earlier], [("__hits", HITS)], run)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit (words within an occurrence), items (ids, sorted) and spans (runs of hit words, in characters)."""
    tests = windows(benchmark, item, item_text, n)
    total = tests.count()
    n_slices = max(1, -(-total // max_windows))
    if n_slices > 1:
        tests = staged(tests, "test-windows")
    hit = docs
    for k in range(n_slices):
        part = tests.where(F.col("slot") % n_slices == k).select("item", "length", "window").toPandas()
        hit = _add_hits(hit, text, part, k > 0)
        if k + 1 < n_slices:
            hit = staged(hit, "test-hits")

    def cover(texts: pa.Array, hits: pa.Array) -> list[pa.Array]:
        found = hits.to_pylist()
        n_words, n_hit, items, spans = [], [], [], []
        for i, part, starts, ends, first in texts_of(texts):
            n_words.append(np.diff(first))
            change = np.zeros(len(starts) + 1, np.int64)
            rows = range(i, i + len(first) - 1)
            for row in rows:
                for h in found[row]:
                    w = int(first[row - i]) + h["word"]
                    change[w] += 1
                    change[w + h["length"]] -= 1
            covered = np.cumsum(change[:-1]) > 0
            n_hit.append(common.grouped_sum(covered, first))
            chars = None
            for row in rows:
                items.append(sorted({h["item"] for h in found[row]}))
                out = []
                if found[row]:
                    if chars is None:  # characters before each byte of the block
                        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts.slice(i, len(rows)).fill_null("").to_pylist()])])
                    a, b = int(first[row - i]), int(first[row - i + 1])
                    edge = np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]]))
                    base = chars[offsets[row - i]]
                    out = [{"start": int(chars[starts[a + s]] - base), "end": int(chars[ends[a + e - 1]] - base)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                spans.append(out)
        join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
        return [join(n_words), join(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    added = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", SPANS)]
    return common.with_columns_by_batch(hit, [text, "__hits"], added, cover).drop("__hits")


def drop_documents(docs: DataFrame, benchmark: DataFrame, **how: str) -> DataFrame:
    """``docs`` without those that hold an occurrence of a window; its columns only."""
    return _restored(docs, scan(_hidden(docs), benchmark, **how).where("n_hit = 0"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how: str) -> DataFrame:
    """``docs`` with the runs of hit words cut from their texts; its columns only."""
    found = scan(_hidden(docs), benchmark, text=text, **how)
    cut = F.aggregate(
        F.col("spans"),
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["kept"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])).alias("kept"), s["end"].alias("at")),
        lambda acc: F.concat(acc["kept"], F.substring(F.col(text), acc["at"] + 1, F.length(text) - acc["at"])),
    )
    return _restored(docs, found.withColumn(text, F.when(F.size("spans") > 0, cut).otherwise(F.col(text))))


_OUT = ("n_words", "n_hit", "items", "spans")


def _hidden(docs: DataFrame) -> DataFrame:
    """Columns that :func:`scan` would replace, under other names."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c.lower() in _OUT})


def _restored(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"`__own_{c}`").alias(c) if c.lower() in _OUT else F.col(f"`{c}`") for c in docs.columns))
