"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

A document longer than a sequence is cut into pieces, the first of which may be
shorter. All that the packing depends on is how many pieces of each length
there are: at most ``capacity`` counts, whatever the number of documents. Bins
are filled one kind at a time: the longest piece left, and the combination of
the other lengths left that fills the rest best, found by subset-sum dynamic
programming over a bitset. As long as the lengths last, the same combination
stays the fullest, so it is repeated until one of them runs out. The result is a
small table of places for each length; Spark numbers the pieces of each length
and looks their places up. Pieces of a length are numbered in salted groups, so
that a length that a third of all pieces have is no single task.

Defined results: null and empty texts have the end id alone; repeated rows are
packed each; pieces without an id or of a null key are packed like others. Texts
of any length are encoded whole. Only the key and the text are read; other
columns, whatever their names, do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm import common, tokens
from matchloom.session import staged

CAPACITY = 2048
END_ID = 0
#: Groups in which the pieces of one length are numbered: so many, and more if all pieces would make groups of more than this.
SALTS, GROUP_PIECES = 64, 500_000


def tokenise(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every piece of every document, with its ids if they are asked for.

    ``vocabulary`` is the path of a byte-level BPE file for the tokenizers library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(vocabulary)
        for b in batches:
            keys = b.column(0).to_pylist()
            for i, ids, bounds in tokens.encoded(b.column(1), encoder):
                rows = []
                for r in range(len(bounds) - 1):
                    own = np.append(ids[bounds[r] : bounds[r + 1]], end_id).astype("<u4")
                    cut = len(own) % capacity or capacity
                    edges = [0, *range(cut, len(own) + 1, capacity)]
                    for piece, (a, e) in enumerate(zip(edges, edges[1:], strict=False)):
                        rows.append((keys[i + r], piece, a, e - a, zlib.crc32(own[a:e].tobytes()), own[a:e].tolist() if keep_ids else None))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        del encoder
        common.trim()

    found = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>")
    return found if keep_ids else found.drop("ids")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the lengths in ``counts`` whose sum comes closest to ``room`` from below."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, copies = left - take, copies * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places: (length, first, end, sequence, copies, offset).

    Pieces of the length numbered from first to end (exclusive) go into the
    sequences from ``sequence`` on, ``copies`` to each, side by side from ``offset``.
    """
    left, given, places, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if c > (n == longest) and n <= capacity - longest}
        chosen = fullest(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // c for n, c in chosen.items())
        offset = 0
        for n in sorted(chosen, reverse=True):
            c = chosen[n]
            places.append((n, given[n], given[n] + c * times, sequence, c, offset))
            given[n] += c * times
            left[n] -= c * times
            if not left[n]:
                del left[n]
            offset += n * c
        sequence += times
    return places


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a length of at most ``capacity``) with sequence_id and offset.

    ``pieces`` is read several times, so it should be a table and not a computation.
    """
    spark: SparkSession = pieces.sparkSession
    salts = max(SALTS, pieces.count() // GROUP_PIECES)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before"), "n")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = spark.createDataFrame(plan(counts, capacity), "length long, first long, end long, sequence long, copies long, place long")
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("__in_group", F.row_number().over(order) - 1).join(groups.drop("n"), ["length", "__salt"])
    numbered = numbered.withColumn("__number", F.col("__before") + F.col("__in_group"))
    # the places follow from capacity counts, so their table is bounded; a length has a few ranges
    placed = numbered.join(F.broadcast(places.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & (F.col("__number") >= F.col("first")) & (F.col("__number") < F.col("end")))
    within = F.col("__number") - F.col("first")
    return placed.select(
        *pieces.columns,
        (F.col("sequence") + F.floor(within / F.col("copies")).cast("long")).alias("sequence_id"),
        (F.col("place") + (within % F.col("copies")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack: a row for each piece with its place."""
    return pack(staged(tokenise(docs, vocabulary, key, text, capacity, end_id, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that kept their ids; a sequence holds ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
