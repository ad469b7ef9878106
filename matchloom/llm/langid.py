"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of each language in Spark and brings one
matrix of ``n_buckets`` rows by languages to the driver; its size does not
depend on the number of documents. Scoring broadcasts the matrix of log
probabilities and works on whole Arrow batches in numpy.

Defined results: a null text, an empty text or one without any letter is
``und`` with score 0; so is every text if no labelled row exists. Ties go to the
language that sorts first. Repeated rows are counted and scored each. Texts of
any length are read whole. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm import common

#: Lengths of the n-grams, in characters.
ORDERS = (1, 2, 3)
N_BUCKETS = 1 << 16
#: Labelled rows of each language that training reads at most, about; chosen by a hash of the row's key.
MAX_TRAIN_ROWS = 8_000
#: The finest share of rows that a sample can be.
SHARES = 1 << 52
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # float32, languages x buckets
    prior: np.ndarray  # float32, languages
    orders: tuple[int, ...] = ORDERS


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """A flag for each code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, other characters than letters as one blank, and row offsets."""
    low = [(t or "").lower() for t in texts]
    offsets = np.zeros(len(low) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, low), np.int64, len(low)), out=offsets[1:])
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[codes], codes, np.uint32(32)), offsets


def grams(codes: np.ndarray, offsets: np.ndarray, order: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram that lies within a row, and the bounds of each row's n-grams."""
    n = max(len(codes) - order + 1, 0)
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h *= np.uint32(0x01000193)
        h ^= codes[k : k + n]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    bucket = (h >> np.uint32(8)) % np.uint32(n_buckets)
    lengths = np.maximum(np.diff(offsets) - order + 1, 0)
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(lengths, out=bounds[1:])
    if order > 1:
        inside = np.ones(n + order, np.bool_)
        for k in range(1, order):
            inside[np.maximum(offsets[1:] - k, 0)] = False  # starts whose n-gram would cross a row's end
        short = np.diff(offsets) < order
        if short.any():
            for a, b in zip(offsets[:-1][short], offsets[1:][short], strict=True):
                inside[a:b] = False
        bucket = bucket[inside[:n]]
    return bucket, bounds


def pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """The rows of a text column, some at a time."""
    _, offsets = common.utf8(texts)
    for i, j in common.blocks(offsets, common.BLOCK_BYTES):
        yield texts.slice(i, j - i).to_pylist()


def share_of(total: int, max_rows: int) -> int:
    """Of ``SHARES``, how many give about ``max_rows`` of ``total`` rows; never none."""
    return max(1, min(SHARES, SHARES * max_rows // max(total, 1)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS, n_buckets: int = N_BUCKETS, orders: tuple[int, ...] = ORDERS) -> Model:
    """Learn from rows that have a language and a text: of each language about ``max_rows``, or all if there are fewer.

    ``key`` tells rows apart, so that copies of one text are chosen one by one. The frequencies of the languages are those of all rows.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language, as in the model
    part = F.lit(SHARES)
    for name, total in totals.items():
        if total > max_rows:
            part = F.when(F.col("lang") == name, share_of(total, max_rows)).otherwise(part)
    if max(totals.values(), default=0) > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(SHARES)) < part)
    rows = rows.select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            at = 0
            for part in pieces(b.column(0)):
                of = langs[at : at + len(part)]
                at += len(part)
                for name in sorted(set(of)):
                    codes, offsets = encoded([t for t, x in zip(part, of, strict=True) if x == name])
                    for order in orders:
                        found = np.bincount(grams(codes, offsets, order, n_buckets)[0], minlength=n_buckets)
                        sums[name] = sums[name] + found if name in sums else found
        for name, c in sums.items():
            hit = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(c[hit].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(totals)
    matrix = np.zeros((len(languages), n_buckets))
    docs = np.zeros(len(languages))
    for i, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        matrix[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
        docs[i] = totals[name]
    matrix += 0.5
    return Model(languages, np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32), np.log((docs + 1) / (docs.sum() + len(docs))).astype(np.float32), orders)


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is the posterior of the mean n-gram, over the root of their number."""
    codes, offsets = encoded(texts)
    known = common.grouped_sum(codes != 32, offsets) > 0
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = np.zeros((len(model.languages), len(texts)))
    n = np.zeros(len(texts))
    for order in model.orders:
        bucket, bounds = grams(codes, offsets, order, model.log_prob.shape[1])
        n += np.diff(bounds)
        for i, row in enumerate(model.log_prob):
            total[i] += common.grouped_sum(row[bucket].astype(np.float64), bounds)
    total += model.prior[:, None]
    best = total.argmax(0)
    soft = np.exp((total - total.max(0)) / np.sqrt(np.maximum(n, 1)))
    points = np.where(known, 1 / soft.sum(0), 0.0)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], points


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language of each text and a score from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        names: list[str] = []
        points = []
        for part in pieces(texts):
            a, b = score(part, held.value)
            names += a
            points.append(b)
        return [pa.array(names, pa.string()), pa.array(np.concatenate(points) if points else np.empty(0))]

    return common.with_columns_by_batch(docs, [text], [(lang_pred, T.StringType()), (score_col, T.DoubleType())], run)


def training_rows(docs: DataFrame, key: str = "doc_id", folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows that may be learned from: their key is not in the fold that is held out."""
    return docs.where(common.crc_fold(key, folds) != held_out)
