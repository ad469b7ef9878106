"""Sets that have enough features in common with the rest of the corpus to be similar to some other set.

Similar sets share at least ``percent`` of the features of either, so a set of
which fewer occur in any other set is similar to none, and needs no signatures.
Most documents of a corpus go this way.

The larger the corpus, the more features occur in some other set by chance. But
a similar set is one set: it is of similar size, and in one block. So blocks
hold sets of one band of sizes, the blocks of a band fall in groups of bounded
size, and a set stays only if it shares enough features with one group of its
own band or of a neighbouring one. What stays by chance grows with the size of a
group, not with the corpus, as long as a band has no more than ``GROUPS`` groups.

1. A map task deals the texts, one for each different set it meets, into blocks
   by the set's fingerprint. Equal sets meet in one block.
2. A block tells each bucket of the feature domain which features it has: sorted
   32-bit places, as differences, in four planes of bytes. Empty buckets cost
   nothing.
3. A bucket answers each block with a bit for every feature of it that another
   block of such sizes has as well, and with the groups of those blocks.
4. The block counts the features that each of its sets shares with each group.

The texts cross the network once (both steps on blocks read one exchange), the
features once in about three bytes each. Two features of one place count as one,
which can only keep a set for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm import common
from matchloom.llm.wordsets import feature_sets, fingerprint

#: Features of a block of sets, and of a bucket of the feature domain, about.
BLOCK_FEATURES, BUCKET_FEATURES = 250_000, 500_000
#: Groups of a band at most (those of three bands have a bit each in 64), and blocks of a group, about, while there are fewer.
GROUPS, GROUP_BLOCKS = 21, 8
#: A band's largest size is at least this percentage of the next one's, and no set is larger than the last.
WIDEST, LARGEST_SET = 90, 1 << 40
U64 = np.uint64
LOW = U64(0xFFFFFFFF)
PLANES = ("p0", "p1", "p2", "p3")


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose rows are the bytes between ``bounds``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)])


def bands(percent: int) -> np.ndarray:
    """The first sizes of bands such that similar sets are in one band or in two neighbouring ones."""
    starts = [1]
    while starts[-1] < LARGEST_SET:
        starts.append(starts[-1] * 100 // min(percent, WIDEST) + 1)
    return np.array(starts, np.int64)


class Layout:
    """The blocks of each band and their groups; without ``by_band``, the features of each band, all sizes are one band and one group."""

    def __init__(self, percent: int, total: int, by_band: dict[int, int] | None, block_features: int):
        self.starts = np.ones(1, np.int64) if by_band is None else bands(percent)
        held = [total] if by_band is None else [by_band.get(b, 0) for b in range(len(self.starts))]
        self.blocks = np.maximum(np.array(held, np.int64) // block_features, 16 if by_band is None else 1)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        self.groups = 1 if by_band is None else int(np.clip(self.blocks.max() // GROUP_BLOCKS, 1, GROUPS))

    def block(self, size: int, fp: int) -> int:
        band = int(np.searchsorted(self.starts, size, "right")) - 1
        return int(self.first[band]) + fp % int(self.blocks[band])

    def place(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bands of blocks and their groups."""
        band = np.searchsorted(self.first, block, "right") - 1
        return band, (block - self.first[band]) % self.groups


class Block:
    """The different sets of a block, in an order that each step finds again, and the places of their features."""

    def __init__(self, table: pa.Table, n: int, n_buckets: int):
        table = table.sort_by([("fp", "ascending"), ("fp2", "ascending")])
        fp, fp2 = table["fp"].to_numpy(), table["fp2"].to_numpy()
        new = np.ones(len(fp), np.bool_)
        new[1:] = (fp[1:] != fp[:-1]) | (fp2[1:] != fp2[:-1])
        self.table = table.take(np.flatnonzero(new))
        sets = [f for _, f in feature_sets(self.table["text"].combine_chunks(), n)]
        self.sizes = np.array([len(f) for f in sets], np.int64)
        flat = np.concatenate(sets)
        place = (flat >> U64(32)) % U64(n_buckets) << U64(32) | flat & LOW
        self.places, self.which, self.count = np.unique(place, return_inverse=True, return_counts=True)


def _runs(values: np.ndarray) -> np.ndarray:
    """The first places of the runs of equal ones in sorted ``values``."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


def groups_of(place: np.ndarray, band: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """For each (place, block), given by the block's band and group, the groups of other blocks that have the place: of the band below, its own and the one above."""
    key = (place << U64(15)) | (band.astype(np.uint64) << U64(6)) | group.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    bit = U64(1) << (key & U64(63))
    own = _runs(key)
    single = np.repeat(np.diff(np.append(own, len(key))) == 1, np.diff(np.append(own, len(key))))
    of_band = key >> U64(6)
    at = _runs(of_band)
    held, number = np.bitwise_or.reduceat(bit, at), of_band[at]
    below, above = np.zeros_like(held), np.zeros_like(held)
    next_to = number[1:] == number[:-1] + U64(1)  # no place has a last band, so none is next to the first band of the place behind it
    below[1:][next_to], above[:-1][next_to] = held[:-1][next_to], held[1:][next_to]
    run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
    found = np.empty(len(key), np.uint64)
    found[order] = below[run] | (held[run] & ~np.where(single, bit, U64(0))) << U64(groups) | above[run] << U64(2 * groups)
    return found


def _enough(found: np.ndarray, sizes: np.ndarray, n_bits: int, percent: int) -> np.ndarray:
    """The sets that share at least ``percent`` of their features with one group; ``found`` has a bit for each group and feature, a set behind the other."""
    held = common.grouped_sum(found > 0, np.concatenate([[0], np.cumsum(sizes)]))
    some = 100 * held >= percent * sizes
    found, ids, sizes = found[np.repeat(some, sizes)], np.flatnonzero(some), sizes[some]
    bounds, enough = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(ids), np.bool_)
    for k in range(n_bits):
        enough |= 100 * common.grouped_sum(found >> U64(k) & U64(1) > 0, bounds) >= percent * sizes
    return ids[enough]


def candidates(rows: DataFrame, total: int, percent: int, n: int, block_features: int = BLOCK_FEATURES, bucket_features: int = BUCKET_FEATURES, by_band: dict[int, int] | None = None) -> DataFrame:
    """(fp, fp2, size, text) of each different set of the texts of ``rows`` that may be similar to another; ``total`` is about the number of features, ``by_band`` that of each of ``bands``."""
    layout, n_buckets = Layout(percent, total, by_band, block_features), max(16, total // bucket_features)
    width = -(-3 * layout.groups // 8)
    ask_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((p, pa.binary()) for p in PLANES)])
    kept_schema = pa.schema([("fp", pa.int64()), ("fp2", pa.int64()), ("size", pa.int64()), ("text", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            keep, prints = [], []
            for row, features in feature_sets(b.column(0), n):
                own = fingerprint(features)
                if len(features) and own not in seen:
                    seen.add(own)
                    keep.append(row)
                    prints.append((layout.block(len(features), own[0]), *own, len(features)))
            numbers = np.array(prints, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in numbers.T), b.column(0).take(pa.array(keep, pa.int64()))], names=["block", "fp", "fp2", "size", "text"])
        common.trim()

    def ask(table: pa.Table) -> pa.Table:
        block = Block(table, n, n_buckets)
        bucket = (block.places >> U64(32)).astype(np.int32)
        head = np.ones(len(bucket), np.bool_)
        head[1:] = bucket[1:] != bucket[:-1]
        step = (block.places & LOW).astype("<u4")
        step[1:] = np.where(head[1:], step[1:], step[1:] - step[:-1])
        at = np.flatnonzero(head)
        planes, bounds = step.view(np.uint8).reshape(-1, 4), np.append(at, len(step))
        common.trim()
        return pa.table([pa.array(bucket[at]), pa.array(np.full(len(at), table["block"][0].as_py())), *(_binary(planes[:, k], bounds) for k in range(4))], schema=ask_schema)

    def answer(table: pa.Table) -> pa.Table:
        planes = [_joined(table[p]) for p in PLANES]
        bounds = planes[0][1]
        place = np.cumsum(np.stack([p for p, _ in planes], 1).view("<u4").ravel(), dtype=np.uint64)
        before = np.append(U64(0), place)[bounds[:-1]]
        place = place - np.repeat(before, np.diff(bounds))
        found = groups_of(place, *(np.repeat(c, np.diff(bounds)) for c in layout.place(table["block"].to_numpy())), layout.groups)
        hit = np.flatnonzero(common.grouped_sum(found > 0, bounds))
        parts = [found[bounds[k] : bounds[k + 1]] for k in hit]
        bits = [np.packbits(f > 0).tobytes() for f in parts]
        groups = [np.ascontiguousarray(f[f > 0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for f in parts]
        common.trim()
        return pa.table({"block": table["block"].take(pa.array(hit)), "bucket": table["bucket"].take(pa.array(hit)), "bits": pa.array(bits, pa.binary()), "groups": pa.array(groups, pa.binary())})

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return kept_schema.empty_table()
        block = Block(table, n, n_buckets)
        own = int(layout.place(table["block"].to_numpy()[:1])[1][0]) + layout.groups
        found = np.where(block.count > 1, U64(1 << own), U64(0))
        for bucket, bits, groups in zip(*(answers[c].to_pylist() for c in ("bucket", "bits", "groups")), strict=True):
            a, z = np.searchsorted(block.places, [U64(bucket << 32), U64(bucket + 1 << 32)])
            of = np.frombuffer(groups, np.uint8).reshape(width, -1)
            wide = np.zeros((of.shape[1], 8), np.uint8)
            wide[:, :width] = of.T
            found[a + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a))] |= wide.view("<u8").ravel()
        enough = _enough(found[block.which], block.sizes, 3 * layout.groups, percent)
        common.trim()
        return block.table.take(pa.array(enough)).select(kept_schema.names).cast(kept_schema)

    dealt = rows.select("text").mapInArrow(deal, "block long, fp long, fp2 long, size long, text string")
    asked = dealt.groupBy("block").applyInArrow(ask, "bucket int, block long, p0 binary, p1 binary, p2 binary, p3 binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, bits binary, groups binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, "fp long, fp2 long, size long, text string")
