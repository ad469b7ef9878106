"""Phrase mining against counts in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("matchloom.llm")

from matchloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            f[lang or "und", 0, ""] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und", size, " ".join(words[i : i + size])] += 1
    return f


def plain(rows, least, longest, percent, top):
    f = plain_counts(rows, longest)
    by_lang = defaultdict(list)
    candidates = {k: n for k, n in f.items() if k[1] > 1 and n >= least}
    longer = defaultdict(int)
    for (lang, size, phrase), n in candidates.items():
        words = phrase.split(" ")
        for m in range(2, size):
            for i in range(size - m + 1):
                key = lang, " ".join(words[i : i + m])
                longer[key] = max(longer[key], n)
    for (lang, size, phrase), a in candidates.items():
        words = phrase.split(" ")
        cuts = []
        for k in range(1, size):
            left, right = f[lang, k, " ".join(words[:k])], f[lang, size - k, " ".join(words[k:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        if 100 * longer[lang, phrase] < percent * a:
            by_lang[lang].append((-score, -a, phrase.encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, f[lang, 0, ""], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = ["the", "of", "New", "york", "É", "à", "sea", "x1", "\x00", "ﬁ"]
    stock = ["New York City hall", "à la carte", "of the sea", "x1"]
    out = []
    for _ in range(300):
        parts = [rnd.choice([*words, *stock]) + rnd.choice([" ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rnd.randint(0, 40))]
        out.append((rnd.choice(["en", "en", "en", "fr", None, "und"]), "".join(parts)))
    out += [("en", "same text again and again")] * 50 + [("en", None), ("fr", ""), (None, " . "), ("zz", "lonely words here")]
    out.append(("fr", " ".join(rnd.choices(words[:4], k=3000))))  # one long piece
    out.append(("en", "long" * 500 + " word"))
    return out


@pytest.mark.parametrize("sizes", [{}, {"pack_bytes": 300, "part_cells": 97}])
def test_phrases(spark, rows, sizes):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = sorted(tuple(r) for r in phrases.mined(docs, least=8, top=60, **sizes).collect())
    assert found == plain(rows, 8, 4, 80, 60)
    assert len({r[0] for r in found}) == 3 and max(r[1] for r in found) > 20


def test_counts_lose_nothing(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = {(r["lang"], r["size"], r["phrase"]): r["f"] for r in phrases.counts(docs, least=5, longest=3, pack_bytes=500, part_cells=64).collect()}
    wanted = {k: n for k, n in plain_counts(rows, 3).items() if k[1] == 0 or n >= 5}
    assert {k: n for k, n in found.items() if n} == {k: n for k, n in wanted.items() if n}


def test_slices_keep_context():
    text = b"aa bb cc dd. ee ff gg hh ii"
    parts = list(phrases._slices(text, 4, 8))
    assert len(parts) > 2 and [w for s, p in parts for w in p.split()[s:]] == text.split()
    for skip, part in parts:
        assert skip <= 3 and part in text


def test_hot_parts_are_dealt(spark):
    cuts = spark.createDataFrame([("en", "the", f"the w{i}") for i in range(500)] + [("en", "a", "a b")], "lang string, first string, phrase string")
    known = spark.createDataFrame([("en", "the", 9), ("en", "a", 4), ("fr", "the", 1)], "lang string, phrase string, f long")
    from pyspark.sql import functions as F

    hot = [known.where("f = 9").select(F.xxhash64("lang", "phrase")).first()[0]]
    found = phrases._with_count(cuts, known, "first", "l", hot)
    assert found.count() == 501 and {(r["first"], r["l"]) for r in found.collect()} == {("the", 9), ("a", 4)}


def test_tables(spark):
    empty = phrases.mined(spark.createDataFrame([], "lang string, text string"))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and not empty.collect()
    odd = spark.createDataFrame([(None, "p q", 1, "x")] * 30, "lang string, text string, block int, `phrase.a` string")
    assert [tuple(r) for r in phrases.mined(odd).collect()] == [("und", 1, "p q", 30, 30, 30, 60, 1000000)]


def test_one_sort_numbers_as_unique_does():
    import numpy as np

    from matchloom.llm import phrases

    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (5000, 900), (5000, 1 << 50), (5000, 1 << 62)):
        values = rng.integers(0, top, n)
        values = np.append(values, values[: n // 3])
        for found, wanted in zip(phrases.numbered(values, top), np.unique(values, return_index=True, return_inverse=True), strict=True):
            assert (found == wanted).all()
        counts = rng.integers(0, 60, len(values))
        cell, which = np.unique(values, return_inverse=True)
        found = phrases.added_up(values, counts, 30, top)
        assert (found[0] == cell).all()
        assert (found[1] == np.minimum(np.bincount(which, counts, len(cell)), 30)).all()
