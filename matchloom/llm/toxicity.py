"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs to the letters they look like, digits and
signs between letters to the letters they stand for, and everything else to one
blank. The lexicon holds whole words and beginnings of words whose document
frequency among toxic labelled texts exceeds that among others, weighted by the
log ratio. At each place the heaviest entry counts, unless an exception phrase
covers it: pairs of words around an entry that clean labelled texts have and
toxic ones hardly do, and those that the caller gives. The sum of the weights is
normalised by the text's length, and a logistic curve makes it a score.

Learning reads at most about ``MAX_TRAIN_ROWS`` labelled keys, chosen by a hash
of the key. All terms of their texts that pass the test of association enter the
lexicon, which the sample thus bounds.

Defined results: null and empty texts are folded to nothing and get the score
of a text without an entry; so does every text if no labelled row exists. A key
with several labels counts as toxic if one of them is 1. Repeated rows are
scored each. Texts of any length are read whole. Added columns replace those of
the same name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm import common
from matchloom.llm.langid import SHARES, letters, share_of
from matchloom.session import staged

MAX_TRAIN_ROWS = 40_000
#: Lengths of the beginnings of words that may be entries.
PREFIXES = (4, 5, 6)
#: An entry needs so many toxic texts, a log ratio of document frequencies of at least so much, and this G-test statistic.
MIN_TEXTS, MIN_WEIGHT, MIN_G = 4, 2.0, 30.0
#: Normalisation: the sum of weights over (1 + words) to this power.
LENGTH_POWER = 0.25

#: Letters of other scripts and signs that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅰ": "i", "ⅼ": "l",
}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
BLANK = 32


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]  # " word " or " beginning"
    exceptions: frozenset[str] = field(default_factory=frozenset)  # " two words "
    slope: float = 1.0
    intercept: float = -3.0


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """From a code point to its folded letter or a blank, and to the letter it stands for inside a word or 0."""
    code = np.arange(0x110000, dtype=np.uint32)
    plain = np.where(letters(), code, np.uint32(BLANK))
    for full in range(0xFF41, 0xFF5B):  # full-width letters
        plain[full] = full - 0xFF41 + ord("a")
    for k, v in HOMOGLYPHS.items():
        plain[ord(k)] = ord(v)
    stands = np.zeros(0x110000, np.uint32)
    for k, v in SUBSTITUTES.items():
        stands[ord(k)] = ord(v)
    return plain, stands


def folded(texts: list[str | None]) -> list[str]:
    """Each text folded: words with one blank before, between and after them."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer((" " + "\0 ".join(low) + "\0 ").encode("utf-32-le", "surrogatepass"), np.uint32)
    plain, stands = tables()
    end = codes == 0
    ends = np.flatnonzero(end)
    if len(ends) != len(low):  # a text has zero bytes
        return [x for t in low for x in folded([t.replace("\0", " ")])]
    out, sub = plain[codes], stands[codes]
    word = out != BLANK
    like = word | (sub > 0)
    before, after = np.roll(word, 1), np.roll(word, -1)
    open_before = ~np.roll(like, 1)
    use = (sub > 0) & after & (before | open_before)
    out = np.where(use, sub, out)
    blank = out == BLANK
    keep = ~(blank & np.roll(blank, 1))
    keep[0] = True
    out = out.copy()
    out[end] = BLANK
    keep[end] = True  # each row ends with a blank of its own
    keep[1:][end[:-1]] = True  # and begins with one
    body = out[keep].tobytes().decode("utf-32-le", "surrogatepass")
    cuts = np.concatenate([[0], np.cumsum(keep)[ends]])
    return [f"{body[a:b].rstrip()} " if body[a:b].strip() else "" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    _, offsets = common.utf8(texts)
    for i, j in common.blocks(offsets, common.BLOCK_BYTES):
        yield folded(texts.slice(i, j - i).to_pylist())


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def entries(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the heaviest entry at each place that no exception covers."""
        if self.empty:
            return []
        best: dict[int, tuple[int, float]] = {}
        excused: dict[int, int] = {}
        for last, (n, weight) in self.automaton.iter(text):
            start = last - n + 1
            if weight is None:
                excused[start] = max(excused.get(start, 0), last + 1)
            elif start not in best or weight > best[start][1]:
                best[start] = (last + 1, weight)
        found, covered = [], 0  # where the longest exception ends that begins here or before
        for a in sorted(best.keys() | excused.keys()):
            covered = max(covered, excused.get(a, 0))
            if a in best and best[a][0] > covered:
                found.append((a, *best[a]))
        return found

    def weigh(self, text: str) -> float:
        """The weights of the entries, over the text's length; one that repeats n times counts 1 + log(n) times."""
        found = Counter((text[a:b], w) for a, b, w in self.entries(text))
        return sum(w * (1 + math.log(n)) for (_, w), n in sorted(found.items())) / (1 + text.count(" ")) ** LENGTH_POWER


def _terms(text: str, prefixes: tuple[int, ...]) -> set[str]:
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in prefixes if len(w) > n}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, exceptions: frozenset[str] = frozenset()) -> Lexicon:
    """Learn from the rows of ``labels`` (key, label 0 or 1); at most about ``max_rows`` keys."""
    rows = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where("key is not null and label is not null").groupBy("key").agg(F.max("label").alias("label"))
    total = rows.count()
    if not total:
        return Lexicon({}, exceptions)
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(SHARES)) < share_of(total, max_rows))
    # about max_rows rows of two numbers
    chosen = staged(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(rows), "key").select("label", "text"), "toxic-training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            toxic = iter(b.column(0).to_pylist())
            for block in _blocks(b.column(1)):
                for body in block:
                    mark = int(next(toxic) > 0)
                    found[mark].update(_terms(body, PREFIXES))
                    found[mark][""] += 1  # texts
            terms = sorted(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([found[k][t] for t in terms], pa.int64()) for k in (1, 0))], names=["term", "toxic", "clean"])

    terms = staged(chosen.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-terms")
    texts = terms.where("term = ''").first()
    if texts is None or not texts["toxic"] or not texts["clean"]:
        return Lexicon({}, exceptions)
    weight = F.log((F.col("toxic") + 0.5) / (texts["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (texts["clean"] + 1.0))
    share = texts["toxic"] / (texts["toxic"] + texts["clean"])
    both = F.col("toxic") + F.col("clean")
    g = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0))
    entries = terms.where(f"term <> '' and toxic >= {MIN_TEXTS}").withColumn("weight", weight).where((F.col("weight") >= MIN_WEIGHT) & (g >= MIN_G))
    best = entries.select("term", "weight").collect()  # terms of max_rows texts that pass a test, as the broadcast lexicon holds them
    lexicon = Lexicon({r["term"]: float(r["weight"]) for r in best}, exceptions)

    # words next to an entry: pairs that clean texts have and toxic ones hardly do
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            toxic = iter(b.column(0).to_pylist())
            for block in _blocks(b.column(1)):
                for body in block:
                    mark = int(next(toxic) > 0)
                    near = set()
                    for a, _, _ in matcher.entries(body):
                        word = body.find(" ", a + 1)
                        left, right = body.rfind(" ", 0, a), body.find(" ", word + 1)
                        near |= {body[left : word + 1]} if left >= 0 else set()
                        near |= {body[a : right + 1]} if right >= 0 else set()
                    found[mark].update(near)
            names = sorted(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[k][t] for t in names], pa.int64()) for k in (1, 0))], names=["term", "toxic", "clean"])

    around = chosen.mapInArrow(pairs, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    harmless = around.where(f"clean >= 3 and clean * {texts['toxic'] + 1} > 4 * (toxic + 1) * {texts['clean'] + 1}").select("term").collect()  # pairs around entries in the same texts
    lexicon = Lexicon(lexicon.weights, exceptions | {r["term"] for r in harmless})

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            z = [round(matcher.weigh(body), 2) for block in _blocks(b.column(1)) for body in block]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), pa.array([int(x > 0) for x in b.column(0).to_pylist()], pa.int64())], names=["z", "label"])

    points = chosen.mapInArrow(weighed, "z double, label long").groupBy("z", "label").agg(F.count("*").alias("n")).toPandas()  # max_rows rows at most
    slope, intercept = logistic(points["z"].to_numpy(), points["label"].to_numpy(), points["n"].to_numpy())
    return Lexicon(lexicon.weights, lexicon.exceptions, slope, intercept)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through weighted points, by Newton's method with a little ridge on the slope."""
    a, b = 0.0, float(np.log((n[y == 1].sum() + 0.5) / (n[y == 0].sum() + 0.5)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n * (y - p) * x).sum() - ridge * a, (n * (y - p)).sum()])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text, from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    made: list[Matcher] = []

    def run(texts: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(Matcher(held.value))
        z = np.array([made[0].weigh(body) for block in _blocks(texts) for body in block])
        return [pa.array(1 / (1 + np.exp(-np.clip(held.value.slope * z + held.value.intercept, -30, 30))), pa.float64())]

    return common.with_columns_by_batch(docs, [text], [(score_col, T.DoubleType())], run)
