"""Suffix-array dedup: bytes of a text that are covered by a long string which also starts in an earlier document.

1. Every window of ``WINDOW`` bytes has a key: the least hash of the short
   strings in it. Equal windows have equal keys, and a run of windows with one
   key is one stretch of text, a segment. Documents are dealt into blocks; a
   block sends its different keys, and learns which of them other documents
   have as well.
2. Blocks send the segments of those keys to buckets of keys. Equal segments of
   a block are sent once, for the document with the smallest key; the others
   are covered whole. If more than ``HOT`` documents have a key, its segments
   are cut into their single windows, dealt by their own hash.
3. Segments none of whose windows has a hash that recurs in the bucket cannot
   match and leave. Of the others the bucket builds the Burrows-Wheeler transform
   and the common prefixes column by column (:mod:`matchloom.llm.bwt`).
   Neighbouring rows with a common prefix of ``WINDOW`` bytes are equal windows; a
   window is covered if the smallest document of its rows precedes its own.
4. The covered stretches return to the blocks, which cut them from the texts.

The text crosses the network once: the three steps on blocks read one exchange.
Buckets and blocks grow in number with the input, not in size.

Defined results: a null text is empty; a text shorter than a window loses
nothing; rows of one key do not cover each other; a row with a null key neither
covers nor is covered. Matches never cross documents. Rows that repeat a key and
a text get one row each. Texts of any length are read whole, and a block has at
least one text, however long. What is kept is bytes: a cut may split a
character. Only the key and the text are read; other columns, whatever their
names, do not matter.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import bwt, common

WINDOW = 50
#: Length of the short strings whose least hash is a window's key; shorter than a window.
GRAM = 20
#: Bytes of text in a block of documents, and in a bucket of the key exchange.
BLOCK, BUCKET = 4 << 20, 8 << 20
#: Bytes of segments in one collection; its columns fit the processor's cache.
COLLECTION = 640 << 10
#: Documents that share a key before its segments are cut into windows.
HOT = 20_000
#: Segments whose windows are hashed at once.
HASH_ROWS = 4096
SPAN = WINDOW - GRAM + 1  # short strings in a window, and windows in a segment at most
WIDTH = SPAN + WINDOW - 1  # bytes of a segment at most
U64 = np.uint64


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The hash of each string of ``length`` bytes, by doubling."""
    power, size, done, done_size = data.astype(np.uint64) + U64(1), 1, None, 0
    while True:
        if length & size:
            if done is None:
                done, done_size = power, size
            else:
                n = len(data) - done_size - size + 1
                done = done[:n] * U64(pow(common.BASE, size, 1 << 64)) + power[done_size : done_size + n]
                done_size += size
        if done_size == length:
            return common.mix64(done)
        n = len(power) - size
        power = power[:n] * U64(pow(common.BASE, size, 1 << 64)) + power[size : size + n]
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, first window, number of windows) of every segment; windows are numbered by their first byte in ``data``."""
    if len(data) < WINDOW:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    least = sliding_min(gram_hashes(data, GRAM), SPAN)
    ends = np.maximum(offsets[1:] - WINDOW + 1, offsets[:-1])  # windows of a row start before
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, np.minimum(offsets[:-1], len(least)), 1)
    np.add.at(valid, np.minimum(ends, len(least)), -1)
    valid = np.cumsum(valid[:-1]) > 0
    head = np.ones(len(least), np.bool_)
    head[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    starts_of_rows = offsets[:-1][np.diff(offsets) >= WINDOW]
    head[starts_of_rows] = True
    head &= valid
    begin = np.flatnonzero(head)
    # a run ends where the next begins or its row's windows end
    row = np.searchsorted(offsets, begin, "right") - 1
    size = np.minimum(np.append(begin[1:], len(least)), ends[row]) - begin
    pieces = -(-size // SPAN)
    if (pieces > 1).any():
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, row, size = np.repeat(begin, pieces) + nth * SPAN, np.repeat(row, pieces), np.repeat(size, pieces) - nth * SPAN
    return common.mix64(least[begin] ^ U64(0x5851F42D4C957F2D)), row, begin, np.minimum(size, SPAN)


def _sorted_docs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in a fixed order: document ids, which of them are null, bytes and offsets."""
    table = table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")]))
    data, offsets = common.utf8(table["text"])
    null = table["id"].is_null().to_numpy()
    return table["id"].fill_null(0).to_numpy(), null, data, offsets


def _known_segments(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, ...]:
    found = segments(data, offsets)
    keep = ~null[found[1]]
    return tuple(x[keep] for x in found)


def distinct(strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each different string, and the number of each row's string; rows are zero-padded."""
    full = np.concatenate([strings, lengths[:, None].astype(np.uint8)], axis=1)
    _, first, which = np.unique(np.ascontiguousarray(full).view(np.dtype((np.void, full.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, which


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Strings of the given starts and lengths (at most WIDTH) as zero-padded rows."""
    at = start[:, None] + np.arange(WIDTH)
    inside = np.arange(WIDTH) < length[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def recurring(strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a string has a window whose hash occurs again among the strings; equal windows have equal hashes."""
    window = np.arange(SPAN) < (lengths - WINDOW + 1)[:, None]
    found = []
    for a in range(0, len(lengths), HASH_ROWS):
        rows = np.ascontiguousarray(strings[a : a + HASH_ROWS])
        hashes = np.append(gram_hashes(rows.ravel(), WINDOW), np.zeros(WINDOW - 1, np.uint64)).reshape(rows.shape)[:, :SPAN]
        found.append(hashes[window[a : a + HASH_ROWS]])
    hashes = np.concatenate(found)
    in_order = np.sort(hashes)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    out = np.zeros(len(lengths), np.bool_)
    if len(twice):
        again = twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
        out[np.nonzero(window)[0][again]] = True
    return out


def _least(strings: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """:func:`bwt.least_by_window` by collections of about ``COLLECTION`` bytes; strings that share a window are in one.

    A string none of whose windows recurs keeps its own value, and needs no transform.
    """
    m = len(lengths)
    out = np.where(np.arange(SPAN) < (lengths - WINDOW + 1)[:, None], values[:, None], np.iinfo(np.int64).max)
    some = np.flatnonzero(recurring(strings, lengths)) if m else np.empty(0, np.int64)
    if not len(some):
        return out
    grams = np.append(gram_hashes(np.ascontiguousarray(strings[some, :WINDOW]).ravel(), GRAM), np.zeros(GRAM - 1, np.uint64))
    key = common.mix64(grams.reshape(len(some), WINDOW)[:, :SPAN].min(1))  # all windows of a segment have this key
    group = (key % U64(-(-int(lengths[some].sum()) // COLLECTION))).astype(np.int64)
    order = np.argsort(group, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        own = some[at]
        with tempfile.TemporaryDirectory() as folder:
            out[own] = bwt.least_by_window(strings[own], lengths[own], values[own], WINDOW, folder)
    return out


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK, bucket_bytes: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, spans, kept): the maximal covered runs of each text as (start, end) in bytes, and the other bytes."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_buckets = max(64, total // block_bytes), max(64, total // bucket_bytes)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("id", F.hash("text"))), F.lit(n_blocks)).cast("int"))

    def deal(bucket: np.ndarray, *columns: np.ndarray) -> list[tuple[int, list[bytes]]]:
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        return [(k, [np.ascontiguousarray(c[order[cuts[k] : cuts[k + 1]]]).tobytes() for c in columns]) for k in np.flatnonzero(np.diff(cuts)).tolist()]

    def keys_of(table: pa.Table) -> pa.Table:
        ids, null, data, offsets = _sorted_docs(table)
        found, row, _, _ = _known_segments(data, offsets, null)
        order = np.lexsort((row, found))
        found, row = found[order], ids[row[order]]
        new_key = np.ones(len(found), np.bool_)
        new_key[1:] = found[1:] != found[:-1]
        new_doc = new_key.copy()
        new_doc[1:] |= row[1:] != row[:-1]
        head = np.flatnonzero(new_key)
        n_docs = np.add.reduceat(new_doc.astype(np.int32), head) if len(head) else np.empty(0, np.int32)
        block = table["block"][0].as_py()
        parts = deal((found[head] % U64(n_buckets)).astype(np.int64), found[head], n_docs.astype(np.int32))
        return pa.table({"bucket": pa.array([k for k, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int32()), "keys": pa.array([c[0] for _, c in parts], pa.binary()), "n": pa.array([c[1] for _, c in parts], pa.binary())})

    def shared_keys(table: pa.Table) -> pa.Table:
        blobs = table["keys"].to_pylist()
        found, n = np.frombuffer(b"".join(blobs), np.uint64), np.frombuffer(b"".join(table["n"].to_pylist()), np.int32)
        _, which = np.unique(found, return_inverse=True)
        docs_of = np.bincount(which, n)[which]
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in blobs])])
        out: dict[str, list] = {"block": [], "keys": [], "hot": []}
        for block, a, z in zip(table["block"].to_pylist(), bounds[:-1], bounds[1:], strict=True):
            due = docs_of[a:z] > 1
            if due.any():
                out["block"].append(block)
                out["keys"].append(found[a:z][due].tobytes())
                out["hot"].append((docs_of[a:z][due] > hot).tobytes())
        return pa.table({"block": pa.array(out["block"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})

    segment_schema = "bucket int, block int, bytes binary, lengths binary, docs binary, rows binary, starts binary, done binary"

    def segments_of(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("bytes", "lengths", "docs", "rows", "starts", "done")]])
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, null, data, offsets = _sorted_docs(left)
        found, row, start, size = _known_segments(data, offsets, null)
        wanted = np.frombuffer(b"".join(right["keys"].to_pylist()), np.uint64)
        is_hot = np.frombuffer(b"".join(right["hot"].to_pylist()), np.bool_)
        order = np.argsort(wanted)
        wanted, is_hot = wanted[order], is_hot[order]
        at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
        due = wanted[at] == found
        found, row, start, size, cut = found[due], row[due], start[due], size[due], is_hot[at[due]]
        if cut.any():  # windows of hot keys, each dealt by its own hash
            nth = np.arange(int(size[cut].sum())) - np.repeat(np.cumsum(size[cut]) - size[cut], size[cut])
            own = np.repeat(start[cut], size[cut]) + nth
            more_row = np.repeat(row[cut], size[cut])
            more_key = common.mix64(gram_hashes(data, WINDOW)[own])
            found, row = np.concatenate([found[~cut], more_key]), np.concatenate([row[~cut], more_row])
            start, size = np.concatenate([start[~cut], own]), np.concatenate([size[~cut], np.ones(len(own), np.int64)])
        if not len(found):
            return schema.empty_table()
        length = size + WINDOW - 1
        strings = gathered(data, start, length)
        # rows are in order of ids, so the first of equal segments has the smallest
        order = np.lexsort((start, row))
        found, row, start, length, strings = found[order], row[order], start[order], length[order], strings[order]
        first, which = distinct(strings, length)
        again = ids[row] > ids[row[first[which]]]
        # those of a larger id than the first are covered whole; of the others, all of the smallest id are sent
        send = np.flatnonzero(~again)
        bucket = (found[send] % U64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        send, bucket = send[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
        done = np.stack([row[again], start[again], start[again] + length[again]], 1).astype(np.uint32)  # a block's bytes are one Arrow string column, so 32 bits do
        done_cuts = np.linspace(0, len(done), n_buckets + 1).astype(np.int64)  # they ride along, anywhere
        out: list[tuple] = []
        block = left["block"][0].as_py()
        for k in range(n_buckets):
            own, ride = send[cuts[k] : cuts[k + 1]], done[done_cuts[k] : done_cuts[k + 1]]
            if len(own) or len(ride):
                body = strings[own][np.arange(WIDTH) < length[own][:, None]]
                out.append((k, block, body.tobytes(), length[own].astype(np.uint8).tobytes(), ids[row[own]].astype(np.int64).tobytes(), row[own].astype(np.int32).tobytes(), start[own].astype(np.uint32).tobytes(), ride.tobytes()))
        return pa.table([pa.array([x[c] for x in out], f.type) for c, f in enumerate(schema)], schema=schema)

    def match(table: pa.Table) -> pa.Table:
        length = np.frombuffer(b"".join(table["lengths"].to_pylist()), np.uint8).astype(np.int64)
        doc = np.frombuffer(b"".join(table["docs"].to_pylist()), np.int64)
        start = np.frombuffer(b"".join(table["starts"].to_pylist()), np.uint32).astype(np.int64)
        n_own = np.array([len(x) for x in table["lengths"].to_pylist()])
        bounds = np.concatenate([[0], np.cumsum(n_own)])
        begin, end = np.empty(0, np.int64), np.empty(0, np.int64)
        owner = np.empty(0, np.int64)
        if len(length):
            body = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
            strings = gathered(body, np.cumsum(length) - length, length)
            first, which = distinct(strings, length)
            smallest = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(smallest, which, doc)
            least = _least(strings[first], length[first], smallest)
            hit = np.zeros((len(length), SPAN + 2), np.int8)
            hit[:, 1 : least.shape[1] + 1] = least[which] < doc[:, None]
            edge = np.diff(hit, axis=1)
            owner, a = np.nonzero(edge == 1)
            _, z = np.nonzero(edge == -1)
            begin, end = start[owner] + a, start[owner] + z - 1 + WINDOW
        row = np.frombuffer(b"".join(table["rows"].to_pylist()), np.int32)
        cuts = np.searchsorted(owner, bounds)
        blocks, spans = [], []
        for n, (block, ride) in enumerate(zip(table["block"].to_pylist(), table["done"].to_pylist(), strict=True)):
            own = slice(cuts[n], cuts[n + 1])
            body = np.stack([row[owner[own]].astype(np.int64), begin[own], end[own]], 1).astype(np.uint32).tobytes() + ride
            if body:
                blocks.append(block)
                spans.append(body)
        return pa.table({"block": pa.array(blocks, pa.int32()), "spans": pa.array(spans, pa.binary())})

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", kind), ("kept", pa.binary())])
        if not len(left):
            return schema.empty_table()
        ids, null, data, offsets = _sorted_docs(left)
        spans = np.frombuffer(b"".join(right["spans"].to_pylist()), np.uint32).reshape(-1, 3).astype(np.int64)
        change = np.bincount(spans[:, 1], minlength=len(data) + 1) - np.bincount(spans[:, 2], minlength=len(data) + 1)
        gone = np.zeros(len(data) + 2, np.bool_)
        gone[1:-1] = np.cumsum(change[:-1]) > 0
        here, row_start = gone[1:-1], np.zeros(len(data) + 1, np.bool_)
        row_start[offsets] = True
        begin = np.flatnonzero(here & (~gone[:-2] | row_start[:-1]))
        end = np.flatnonzero(here & (~gone[2:] | row_start[1:])) + 1
        of = np.searchsorted(begin, offsets)
        base = offsets[np.searchsorted(offsets, begin, "right") - 1]
        pairs = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], names=["start", "end"])
        kept, left_over = data[~here], common.grouped_sum(~here, offsets)
        bounds = np.concatenate([[0], np.cumsum(left_over)])
        body = kept.tobytes()
        return pa.table([
            pa.array(ids, mask=null), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pairs),
            pa.array([body[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
        ], schema=schema)

    keys = dealt.groupBy("block").applyInArrow(keys_of, "bucket int, block int, keys binary, n binary")
    known = keys.groupBy("bucket").applyInArrow(shared_keys, "block int, keys binary, hot binary")
    sent = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(segments_of, segment_schema)
    spans = sent.groupBy("bucket").applyInArrow(match, "block int, spans binary")
    out = dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut_out, "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.withColumnRenamed("id", key)
