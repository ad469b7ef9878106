"""Periodic runs against a version that tries every period at every word."""

import random

import pytest

pytest.importorskip("matchloom.llm")

from matchloom.llm import periodic


def plain(words, least, exponent):
    found = {}
    for period in range(1, len(words) // exponent + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end > at and end + period - at >= max(least, exponent * period):
                found.setdefault((at, end + period - at), period)
            at = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    out = []
    for _ in range(400):
        alphabet = "abcdé"[: rnd.randint(1, 5)]
        words = rnd.choices(alphabet, k=rnd.choice([0, 1, 5, 30, 90]))
        for _ in range(rnd.randint(0, 4)):
            at, period = rnd.randint(0, len(words)), rnd.choices(alphabet, k=rnd.randint(1, 12))
            words[at:at] = (period * 8)[: rnd.randint(0, 60)]
            if rnd.random() < 0.5:
                words += words[: rnd.randint(0, len(words))]
        out.append(rnd.choice([" ", "\n", " \t "]).join(words))
    line = "the same line again and again . "
    return out + ["", None, " \n ", "a", "a " * 3000, line * 4, line * 4 + "other " + line * 5, "x y " * 30, "a\x00b " * 40, out[7], out[7]]


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (6, 3), (1, 2), (10, 4)])
def test_every_run(spark, texts, least, exponent):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in periodic.runs(docs, min_length=least, min_exponent=exponent).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        words = [w.decode() for w in words]
        wanted = plain(words, least, exponent)
        assert found[i]["n_words"] == len(words)
        assert [tuple(r) for r in found[i]["runs"]] == wanted
        assert found[i]["collapsed"] == collapsed(words, wanted)


def test_best_run(spark):
    rows = [(1, [(0, 60, 14), (5, 30, 7), (40, 30, 7)]), (2, []), (3, [(0, 30, 10), (3, 31, 10)])]
    docs = spark.createDataFrame(rows, "i long, runs array<struct<start:long,length:long,period:long>>")
    found = {r["i"]: r["b"] and tuple(r["b"]) for r in docs.select("i", periodic.best().alias("b")).collect()}
    assert found == {1: (0, 60, 14), 2: None, 3: (3, 31, 10)}


def test_planted_repeats(spark):
    """The documents of the contract, built once more word by word."""
    from zlib import crc32

    from matchloom.llm.queries import with_repeats

    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["x", "yy", "z", "é"], k=i % 70))) for i in range(400)] + [(None, "a b c d e f"), (10**12, None)]
    for row in with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[row["doc_id"]]
        h = crc32(str("" if row["doc_id"] is None else row["doc_id"]).encode())
        words = (text or "").split()
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
        assert row["text"] == text


def test_tables(spark):
    empty = periodic.runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and not empty.collect()
    odd = spark.createDataFrame([(None, "b " * 30, 1, "x")], "doc_id long, text string, RUNS int, `a.b` string")
    row = periodic.runs(odd).collect()[0]
    assert row["a.b"] == "x" and [tuple(r) for r in row["runs"]] == [(0, 30, 1)] and row["collapsed"] == "b"
    with pytest.raises(ValueError, match="two periods"):
        periodic.runs(odd, min_exponent=1)
