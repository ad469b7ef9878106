"""Token ids in binary files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

Every id is replaced by its rank in the frequencies of the whole corpus, so that
frequent ids are small numbers. Four numbers share a control byte with two bits
of length for each; their data bytes, one to four each, follow in a stream of
their own. A decoder looks a control byte up in a table of byte masks and
spreads the data bytes with it, for a whole block at once.

A store is a folder in the shared file system: the table of ranks (Parquet), and
files of consecutive ranges of documents. A file is ``MAGIC``, then blocks: the
numbers of documents, ids and data bytes (unsigned, 64 bits), document keys
(64 bits; a bit set marks null keys), ids of each document (32 bits), control
bytes and data bytes, all little-endian. A document's control bytes are its own:
the last one's spare numbers are zeros, which a decoder drops. Ids wait for
their ranks in two bytes each where the vocabulary allows, sorted by documents. A task writes its file under a name of its own and reports it; only files in the
manifest, which the job writes once all tasks are done, belong to the store, so
an attempt that is lost or repeated leaves nothing behind that counts.

Defined results: null and empty texts have the end id alone; documents of a null
key come first; repeated rows are stored each, one after another, and a key that
many rows have is spread over as many files as its ids fill. Texts of any length
are encoded whole; a document is never split between blocks. Only the key and
the text are read; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm import common, tokens
from matchloom.session import fresh_path, staged

MAGIC = b"RANKVB1\n"
END_ID = 1
#: Ids in a file, about, and in a block at most unless one document has more.
FILE_IDS, BLOCK_IDS = 8_000_000, 500_000

#: Of a control byte: which of its four numbers' four bytes are in the data.
MASKS = np.arange(4)[None, None, :] <= ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)[:, :, None]


def encode(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    padded = np.zeros(-(-len(numbers) // 4) * 4, "<u4")
    padded[: len(numbers)] = numbers
    extra = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    quads = extra.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), padded.view(np.uint8).reshape(-1, 4)[MASKS[control].reshape(-1, 4)].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` numbers."""
    mask = MASKS[np.frombuffer(control, np.uint8)].reshape(-1, 4)
    out = np.zeros((len(mask), 4), np.uint8)
    out[mask] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()[:n]


def encode_documents(numbers: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of documents one after another, each with control bytes of its own; ``counts`` has its share of ``numbers``."""
    spare = -counts % 4
    padded = np.zeros(len(numbers) + int(spare.sum()), "<u4")
    padded[np.arange(len(numbers)) + np.repeat(np.cumsum(spare) - spare, counts)] = numbers
    return encode(padded)


def pack_block(keys: list[int | None], counts: np.ndarray, control: bytes, data: bytes) -> bytes:
    null = np.packbits(np.array([k is None for k in keys], np.bool_)).tobytes()
    numbers = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    return b"".join([struct.pack("<QQQ", len(keys), int(counts.sum()), len(data)), numbers, null, counts.astype("<u4").tobytes(), control, data])


def read_blocks(read: Callable[[int], bytes]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(keys, counts, ranks) of each block of a file that ``read`` gives the next bytes of."""
    if read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of this format")
    while head := read(24):
        n_docs, n_ids, n_data = struct.unpack("<QQQ", head)
        keys = np.frombuffer(read(8 * n_docs), "<i8").tolist()
        null = np.unpackbits(np.frombuffer(read(-(-n_docs // 8)), np.uint8), count=n_docs)
        counts = np.frombuffer(read(4 * n_docs), "<u4").astype(np.int64)
        quads = -(-counts // 4)
        control, data = read(int(quads.sum())), read(n_data)
        spare = 4 * quads - counts
        at = np.arange(n_ids) + np.repeat(np.cumsum(spare) - spare, counts)
        yield [None if x else k for k, x in zip(keys, null, strict=True)], counts, decode(control, data, 4 * int(quads.sum()))[at]


def id_type(vocabulary: str) -> str:
    """The numpy type that holds every id of the vocabulary."""
    return "<u2" if tokens.loaded(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids): each document's ids and the end id, as little-endian bytes of :func:`id_type`."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(vocabulary)
        for b in batches:
            for i, ids, bounds in tokens.encoded(b.column(1), encoder):
                rows = [np.append(ids[s:e], end_id).astype(kind).tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(rows)), pa.array(np.diff(bounds) + 1), pa.array(rows, pa.binary())], names=["doc_id", "n", "ids"])
        del encoder
        common.trim()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def frequencies(tokenised: DataFrame, kind: str) -> DataFrame:
    """(id, n) of every id, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            found = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[: len(found)] += found
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], names=["id", "n"])

    return tokenised.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Write the store of ``docs`` to the folder ``path``."""
    spark: SparkSession = docs.sparkSession
    kind = id_type(vocabulary)
    tokenised = staged(tokenise(docs, vocabulary, key, text, end_id), "token-ids")
    counted = frequencies(tokenised, kind).orderBy(F.desc("n"), "id").toPandas()  # a vocabulary's ids at most
    by_rank = counted["id"].to_numpy(np.int64)
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank long, id long").write.parquet(f"{path}/ranks")
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    held = spark.sparkContext.broadcast(rank)
    n_files = max(1, -(-int(counted["n"].sum()) // file_ids))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name = f"{uuid.uuid4().hex}.rvb"
        out, rows, first, n_docs, n_ids, waiting = None, [], None, 0, 0, 0

        def flush() -> None:
            nonlocal rows, waiting
            keys, counts, ids = zip(*rows, strict=True)
            counts = np.array(counts, np.int64)
            out.write(pack_block(list(keys), counts, *encode_documents(held.value[np.frombuffer(b"".join(ids), kind)], counts)))
            rows, waiting = [], 0

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc, n = row[:2]
                if out is None:
                    where, at = fs.FileSystem.from_uri(path)
                    where.create_dir(at, recursive=True)
                    out, first = where.open_output_stream(f"{at}/{name}"), doc
                    out.write(MAGIC)
                if waiting and waiting + n > BLOCK_IDS:
                    flush()
                rows.append(row)
                waiting += n
                n_docs, n_ids, last = n_docs + 1, n_ids + n, doc
        if out is not None:
            flush()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_doc": first, "last_doc": last, "n_docs": n_docs, "n_ids": n_ids}], schema=pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    order = (F.asc_nulls_first("doc_id"), "n", "tie")
    ordered = tokenised.withColumn("tie", F.xxhash64("ids")).repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "n", "ids").mapInArrow(store, "file string, first_doc long, last_doc long, n_docs long, n_ids long").write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document of a store: its ids as 32-bit little-endian bytes, and the ids of all documents before it."""
    by_rank = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.int64).astype("<u4")
    held = spark.sparkContext.broadcast(by_rank)
    manifest = spark.read.parquet(f"{path}/manifest")  # a row for each file
    before = F.sum("n_ids").over(Window.orderBy(F.asc_nulls_first("first_doc"), F.asc_nulls_first("last_doc")).rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("start", F.coalesce(before, F.lit(0))).select("file", "start")
    n_files = max(1, manifest.count())

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, at = fs.FileSystem.from_uri(path)
                with where.open_input_stream(f"{at}/{name}") as f:
                    for keys, counts, ranks in read_blocks(f.read):
                        ids = held.value[ranks]
                        bounds = np.concatenate([[0], np.cumsum(counts)])
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + bounds[:-1]), pa.array([ids[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc_id", "start", "ids"])
                        start += int(bounds[-1])

    return files.repartition(n_files).mapInArrow(load, "doc_id long, start long, ids binary")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what :func:`read` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 4 for x in blobs], pa.int64()), pa.array([zlib.crc32(x) for x in blobs], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write a store of ``docs`` in the shared folder and read it back."""
    path = fresh_path(docs.sparkSession, "token-store")
    write(docs, path, vocabulary, key, text, end_id)
    return digests(read(docs.sparkSession, path))
