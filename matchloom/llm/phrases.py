"""Phrases of two to four words that stand together more often than apart, by language.

1. Texts are packed into blocks of even size, which are staged: a block never
   changes, whatever is run again. Equal texts of a pack are kept once, with a
   count; a long text is cut between words, each part with the last words before it.
2. Each block tells the parts of a count-min sketch how often it has each of its
   words and n-grams. Sketches are merged part by part; their width grows with the
   corpus, and no task holds a whole one. A part answers each block with those of its cells that
   are frequent. Merged cells can only count too much, so no frequent n-gram is lost.
3. A block sends the n-grams all of whose cells are frequent, and all of whose
   parts are, as text with exact counts; these are added up and compared with the threshold.
4. The parts of a frequent phrase are frequent, so scores come from joins of the counts with themselves.
   Parts that a share of all words are, like articles, are dealt to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.llm import common
from matchloom.llm.periodic import word_numbers
from matchloom.session import staged

U64 = np.uint64

#: Bytes of text in a row of the staged table and in a block, about; a longer word is a row of its own.
PACK_BYTES, PACKS = 256 << 10, 16

#: Cells of a part of a sketch, and bytes of text for each cell of a row of a sketch.
PART, BYTES_A_CELL = 1 << 20, 16

#: Rows of a sketch: one seed each.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: A phrase that is at least this share of all words is joined in this many parts.
HOT_SHARE, SALTS = 1000, 64

LINE_ENDS = range(0x0A, 0x0E)
BREAK = np.zeros(256, np.bool_)
BREAK[[*b".,;:!?", *LINE_ENDS]] = True
SPACE = BREAK.copy()
SPACE[[0x20, 0x09]] = True

PACK_SCHEMA = "block long, body binary, sizes array<long>, skips array<long>, times array<long>, langs array<string>"


def _slices(text: bytes, longest: int, pack_bytes: int) -> Iterator[tuple[int, bytes]]:
    """``text`` in parts of about ``pack_bytes``, each with the number of words before its own that it has for context."""
    if len(text) <= pack_bytes:
        yield 0, text
        return
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = common.words_of(data, np.array([0, len(data)]), ~SPACE)
    breaks = np.concatenate([[0], np.cumsum(BREAK[data])])[starts]  # equal within a piece
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + pack_bytes, "right")))
        skip = 0
        while skip < min(longest - 1, at) and breaks[at - skip - 1] == breaks[at]:
            skip += 1
        yield skip, text[starts[at - skip] : ends[end - 1]]
        at = end


def _packed(places: np.ndarray) -> bytes:
    """Ascending numbers below 2**24, as differences in three planes of bytes; the upper ones are almost empty and compress away."""
    step = np.diff(places, prepend=0).astype("<u4")
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int64)
    return np.cumsum(planes[0] + (planes[1] << 8) + (planes[2] << 16))


def numbered(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``np.unique`` of numbers below ``top`` with first places and numbers of each, by one sort of value and place together where 63 bits hold both."""
    n = len(values)
    bits = n.bit_length()
    if not n or top.bit_length() + bits > 63:
        return np.unique(values, return_index=True, return_inverse=True)
    both = np.sort((values << bits) | np.arange(n))
    value, at = both >> bits, both & ((1 << bits) - 1)
    head = np.ones(n, np.bool_)
    head[1:] = value[1:] != value[:-1]
    which = np.empty(n, np.int64)
    which[at] = np.cumsum(head) - 1
    return value[head], at[head], which


def added_up(cell: np.ndarray, n: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different cells, ascending, and the sums of their counts; a sum of at least ``least`` counts as ``least``."""
    bits = least.bit_length()
    if width.bit_length() + bits > 63:
        cell, which = np.unique(cell, return_inverse=True)
        return cell, np.minimum(np.bincount(which, n, len(cell)), least).astype("<u4")
    both = np.sort((cell << bits) | np.minimum(n, least))
    cell, n = both >> bits, both & ((1 << bits) - 1)
    head = np.flatnonzero(np.diff(cell, prepend=-1))
    return cell[head], np.minimum(np.add.reduceat(n, head) if len(head) else n, least).astype("<u4")


class Block:
    """The words of a block, numbered by language and word, and what n-grams they form."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("body")
        data = np.frombuffer(b"".join(table["body"].to_pylist()), np.uint8)
        sizes, skips, times = (np.array([v for row in table[name].to_pylist() for v in row], np.int64) for name in ("sizes", "skips", "times"))
        self.langs, lang = np.unique(np.array([v for row in table["langs"].to_pylist() for v in row], np.str_), return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        starts, ends, first = common.words_of(data, offsets, ~SPACE)
        n = len(starts)
        self.row = np.repeat(np.arange(len(sizes)), np.diff(first))
        self.own = np.arange(n) - first[self.row] >= skips[self.row]  # not context
        self.times = times[self.row]
        self.lang = lang[self.row]
        breaks = np.concatenate([[0], np.cumsum(BREAK[data])])[starts]
        #: Whether a word and the next are in one piece.
        self.joined = (self.row[1:] == self.row[:-1]) & (breaks[1:] == breaks[:-1])
        word = word_numbers(data, starts, ends)
        seeds = np.array([int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little") for s in self.langs], np.uint64)
        words = int(word.max()) + 1 if n else 1
        _, at, self.symbol = numbered(self.lang * words + word, len(self.langs) * words)
        self.hash = common.span_hashes(data, starts[at], ends[at]) if n else np.empty(0, np.uint64)
        self.lang_hash = seeds[self.lang[at]] if n else self.hash
        self.text = [data[a:z].tobytes() for a, z in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]

    def grams(self, longest: int, wanted: Wanted | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each size: hashes and counts of the different n-grams, and where each occurs first; of those only that are in ``wanted``, and so are their parts."""
        n = len(self.symbol)
        at = np.arange(n)
        number, top = self.symbol, len(self.hash)  # of the n-gram at each place of ``at``
        hashes = common.mix64(self.hash ^ self.lang_hash)
        for size in range(1, longest + 1):
            if size > 1:
                # an n-gram goes on where both its parts are there: that at ``at`` and that at ``at + 1``
                there = np.zeros(n + 1, np.bool_)
                there[at] = True
                go = self.joined[at[at + 1 < n]] if size == 2 else np.ones(int((at + 1 < n).sum()), np.bool_)
                keep = np.flatnonzero(at + 1 < n)[go & there[at[at + 1 < n] + 1]]
                last = self.symbol[at[keep] + size - 1]
                pairs, first, number = numbered(number[keep] * (len(self.hash) + 1) + last, max(top, 1) * (len(self.hash) + 1))
                at = at[keep]
                hashes = common.mix64(hashes[pairs // (len(self.hash) + 1)] * U64(31) + self.hash[pairs % (len(self.hash) + 1)])
                top = len(pairs)
            else:
                first = np.zeros(top, np.int64)
                first[number[::-1]] = at[::-1]
            counts = np.bincount(number, np.where(self.own[at + size - 1], self.times[at], 0), top).astype(np.int64)
            where = at[first]
            if wanted is not None:
                good = wanted.has(hashes)
                on = good[number]
                at, number = at[on], number[on]
                yield hashes[good], counts[good], where[good]
            else:
                yield hashes, counts, where

    def phrase(self, at: int, size: int) -> str:
        return b" ".join([self.text[k] for k in self.symbol[at : at + size].tolist()]).decode()


def cells(hashes: np.ndarray, seed: int, width: int) -> np.ndarray:
    return (common.mix64(hashes ^ U64(seed)) % U64(width)).astype(np.int64)


class Wanted:
    """The frequent cells that a block was told."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.rows, self.width = [np.sort(r) for r in rows], width

    def has(self, hashes: np.ndarray) -> np.ndarray:
        good = np.ones(len(hashes), np.bool_)
        for seed, row in zip(SEEDS, self.rows, strict=True):
            at = np.flatnonzero(good)
            if not len(row):
                return np.zeros(len(hashes), np.bool_)
            c = cells(hashes[at], seed, self.width)
            good[at] = row[np.minimum(np.searchsorted(row, c), len(row) - 1)] == c
        return good


def packs(docs: DataFrame, text: str, lang: str, longest: int, pack_bytes: int) -> DataFrame:
    """The texts in rows of about ``pack_bytes``, with the number of the block that each belongs to."""
    common.small_batches(docs.sparkSession)
    names = ["block", "body", "sizes", "skips", "times", "langs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        pack: dict[tuple[str, int, bytes], int] = {}
        held = 0

        def full() -> pa.RecordBatch:
            keys = list(pack)
            columns = [[base + made // PACKS], [b"".join(k[2] for k in keys)], [[len(k[2]) for k in keys]], [[k[1] for k in keys]], [list(pack.values())], [[k[0] for k in keys]]]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            for own, whole in zip(b.column(0), b.column(1), strict=True):
                for skip, part in _slices((whole.as_py() or "").encode().translate(common.LOWER.tobytes()), longest, pack_bytes):
                    key = own.as_py(), skip, part
                    if part and key not in pack:
                        held += len(part)
                    if part:
                        pack[key] = pack.get(key, 0) + 1
                    if held >= pack_bytes:
                        yield full()
                        pack, held, made = {}, 0, made + 1
        if pack:
            yield full()
        common.trim()

    return docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")), F.col(f"`{text}`")).mapInArrow(run, PACK_SCHEMA)


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, pack_bytes: int = PACK_BYTES, part_cells: int = PART) -> DataFrame:
    """(lang, phrase, size, f): every phrase of one to ``longest`` words that occurs ``least`` times in its language; size 0 has the number of all words."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0]
    if part_cells > 1 << 24:
        raise ValueError("places in a part are numbers of three bytes")
    n_parts = -(-max(total // BYTES_A_CELL, 1) // part_cells)
    width = n_parts * part_cells
    blocks = staged(packs(docs, text, lang, longest, pack_bytes), "phrase-blocks")

    def ask(table: pa.Table) -> pa.Table:
        block = Block(table)
        found = list(block.grams(longest))
        hashes, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))  # a count may be 0: context that an n-gram goes on from
        parts, blobs, sums = [], [], []
        for k, seed in enumerate(SEEDS):
            cell, count = added_up(cells(hashes, seed, width), n, least, width)
            part = cell // part_cells
            head = np.flatnonzero(np.diff(part, prepend=-1))
            for a, z in zip(head.tolist(), [*head[1:].tolist(), len(cell)], strict=True):
                parts.append(k * n_parts + int(part[a]))
                blobs.append(_packed(cell[a:z] % part_cells))
                sums.append(np.ascontiguousarray(count[a:z].view(np.uint8).reshape(-1, 4).T).tobytes())
        common.trim()
        own = table["block"][0].as_py()
        return pa.table({"part": pa.array(parts, pa.int64()), "block": pa.array([own] * len(parts), pa.int64()), "cells": pa.array(blobs, pa.binary()), "counts": pa.array(sums, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        merged = np.zeros(part_cells, np.int64)
        asked = table["cells"].to_pylist()
        for cell, count in zip(asked, table["counts"].to_pylist(), strict=True):
            merged[_unpacked(cell)] += np.ascontiguousarray(np.frombuffer(count, np.uint8).reshape(4, -1).T).view("<u4").ravel()  # the cells of a row differ
        often = merged >= least
        blobs = []
        for cell in asked:
            at = _unpacked(cell)
            blobs.append(_packed(at[often[at]]))
        keep = [k for k, blob in enumerate(blobs) if blob]
        common.trim()
        return pa.table({"block": table["block"].take(pa.array(keep, pa.int64())), "part": table["part"].take(pa.array(keep, pa.int64())), "cells": pa.array([blobs[k] for k in keep], pa.binary())})

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(table):
            block = Block(table)
            rows: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in SEEDS]
            for part, cell in zip(answers["part"].to_pylist(), answers["cells"].to_pylist(), strict=True):
                rows[part // n_parts].append(_unpacked(cell) + part % n_parts * part_cells)
            for size, (_, n, at) in enumerate(block.grams(longest, Wanted([np.concatenate(r) for r in rows], width)), 1):
                some = np.flatnonzero(n)
                out[0] += block.langs[block.lang[at[some]]].tolist()
                out[1] += [block.phrase(a, size) for a in at[some].tolist()]
                out[2] += [size] * len(some)
                out[3] += n[some].tolist()
            all_words = np.bincount(block.lang, np.where(block.own, block.times, 0), len(block.langs)).astype(np.int64)
            out[0] += block.langs.tolist()
            out[1] += [""] * len(block.langs)
            out[2] += [0] * len(block.langs)
            out[3] += all_words.tolist()
        common.trim()
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "size", "n"])

    asks = blocks.groupBy("block").applyInArrow(ask, "part long, block long, cells binary, counts binary")
    answers = asks.groupBy("part").applyInArrow(answer, "block long, part long, cells binary")
    kept = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, "lang string, phrase string, size int, n long")
    summed = kept.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f"))
    return staged(summed.where((F.col("size") == 0) | (F.col("f") >= least)), "phrase-counts")


def _words(phrase: str | Column) -> Column:
    return F.split(phrase, " ")


def _with_count(cuts: DataFrame, known: DataFrame, part: str, name: str, hot: list[int]) -> DataFrame:
    """``cuts`` with the count of their column ``part`` as ``name``; parts in ``hot`` are dealt by phrase."""
    salts = lambda c, many, one: F.when(F.xxhash64("lang", c).isin(hot), many).otherwise(one) if hot else one
    copies = known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    copies = copies.withColumn("salt", F.explode(salts(part, F.sequence(F.lit(0), F.lit(SALTS - 1)), F.array(F.lit(0)))))
    dealt = cuts.withColumn("salt", salts(part, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"), F.lit(0)))
    return dealt.join(copies, ["lang", part, "salt"]).drop("salt")


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase has two to ``longest`` words of one piece of text and occurs ``a >= least`` times.
    Cut after its first k words, its parts occur ``l`` and ``r`` times; the cut of the lowest
    score ``floor(2000000 * a / (l + r))`` counts, then the smallest k. A phrase is left out if a longer
    one has it and occurs ``percent`` of ``a`` times at least. ``n`` is the number of the language's words.

    Defined results: a null language is ``und``, a null text is empty; empty texts count nothing and an
    empty table gives no rows; equal texts count as often as they occur; ties end with the phrase in byte order.
    Other columns are not read. Words and texts may have any length.
    """
    found = counts(docs, text, lang, least, longest, **sizes)
    known = found.where("size > 0")
    total = F.sum(F.when(F.col("size") == 0, F.col("f")))
    n_words = found.agg(F.coalesce(total, F.lit(0))).first()[0]
    # at most HOT_SHARE phrases of each size
    hot = [r[0] for r in known.where((F.col("size") < longest) & (F.col("f") * HOT_SHARE >= n_words)).select(F.xxhash64("lang", "phrase")).collect()]
    phrases = known.where("size > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = _with_count(_with_count(cuts, known, "first", "l", hot), known, "rest", "r", hot)
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what each longer phrase says of those inside it
    inner = phrases.where("size > 2").withColumn("w", _words("phrase")).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(inner, ["lang", "phrase"], "left")
    left = left.where(F.coalesce(F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * percent, F.lit(True)))
    # the best of each share of a language first, so that no task meets more than SALTS * top of them
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top).drop("share", "rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = found.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
