"""Mixing to target weights against plain versions of targets and rates."""

import math
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("matchloom.llm")

from pyspark.sql import functions as F

from matchloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_weight = sum(weight[s] for s in order if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / open_weight if open_weight else 0
        more = {s for s in order if s not in full and weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def plain_rate(sizes, target, most=3):
    """Rates of the documents of one source, by bisection."""
    mean = sum(sizes) / len(sizes)
    rates = lambda t: [min(most, math.exp(min(t * s / mean, 50))) for s in sizes]
    lo, hi = -1e5, 1e5
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(s * r for s, r in zip(sizes, rates(mid), strict=True)) > target else (mid, hi)
    return rates(hi)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for i in range(600):
        source = rnd.choice(["a", "a", "a", "a", "B", "é", "ﬁ", "𝒳", "", None, "tiny"])
        n = 0 if source == "" else 2 if source == "tiny" else rnd.choice([0, 1, 3, rnd.randint(1, 60), rnd.randint(1, 300)])
        out.append((i, " \n".join(["w"] * n) if n else rnd.choice([None, "", "  "]), source))
    out += [(700 + k, "one text of many copies", "a") for k in range(300)] + [(999, "same row", "B")] * 40 + [(None, "no key", "é")]
    return out


@pytest.mark.parametrize("slots", [None, (50, 5)])
def test_mix(spark, rows, slots, monkeypatch):
    if slots:
        monkeypatch.setattr(mixing, "SLOTS", slots[0])
        monkeypatch.setattr(mixing, "SLOT_ROWS", slots[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mixed(docs).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").split())
    targets = plain_targets(size)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in found) == Counter((i, len((t or "").split()), s) for i, t, s in rows)
    taken, members = Counter(), defaultdict(list)
    for r in found:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-9)
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        members[r["source"]].append(r)
    assert sum(targets.values()) == pytest.approx(sum(size.values()))
    for source, its in members.items():
        assert abs(taken[source] - targets[source]) <= max(1, 0.002 * targets[source])
        real = [r for r in its if r["size"]]
        if real:
            wanted = plain_rate([r["size"] for r in real], targets[source])
            assert all(r["rate"] == pytest.approx(w, abs=1e-6) for r, w in zip(real, wanted, strict=True))
    # copies follow the rates but for rounding and what makes up the rest
    assert sum(abs(r["copies"] - r["rate"]) > 1 for r in found) <= 0.05 * len(found)
    again = mixing.mixed(docs.repartition(2)).collect()
    assert Counter(again) == Counter(found)


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{k}": int(rnd.paretovariate(0.5)) if rnd.random() < 0.9 else 0 for k in range(40)}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.with_targets(frame).collect()}
    wanted = plain_targets(sizes)
    assert found.keys() == wanted.keys() and all(found[s] == pytest.approx(wanted[s], rel=1e-9) for s in wanted)


def test_numbered_over_ranges(spark):
    values = [(f"k{i:05d}",) for i in range(3000)] + [(None,)]
    random.Random(1).shuffle(values)
    found = mixing.numbered(spark.createDataFrame(values, "k string").repartition(7), F.asc_nulls_last("k")).collect()
    assert [r["k"] for r in sorted(found, key=lambda r: r["place"])] == [f"k{i:05d}" for i in range(3000)] + [None]
    assert sorted(r["place"] for r in found) == list(range(3001))


def test_mixture(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7), (2, "c", "y", 8)], "doc_id long, text string, source string, `COPIES` int")
    plan = spark.createDataFrame([(1, 3), (2, 0)], "doc_id long, copies long")
    found = mixing.mixture(docs, plan).collect()
    assert [(r["doc_id"], r["text"], r["COPIES"], r["copy"]) for r in sorted(found, key=lambda r: r["copy"])] == [(1, "a b", 7, k) for k in (1, 2, 3)]


def test_tables(spark):
    empty = mixing.mixed(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert empty.columns == ["doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken"] and not empty.collect()
    blank = mixing.mixed(spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in blank} == {(0, 0.0, 0)}
    odd = spark.createDataFrame([("k", "a b c d", 2, "m")], "`my.key` string, body string, size int, `from` string")
    row = mixing.mixed(odd, key="my.key", text="body", source="from").first()
    assert row["my.key"] == "k" and row["taken"] == 4 and row["target"] == 4.0
