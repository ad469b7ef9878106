"""Queries and operators against plain versions on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import log

import pytest

pytest.importorskip("matchloom.llm")

from pyspark.sql import functions as F

from matchloom.llm import jaccard, langid, packing, substrings, tokenstore
from matchloom.llm.queries import vocabulary


@pytest.fixture(scope="module")
def texts():
    """Passages shared across texts, near copies, exact copies, short and empty texts."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 8)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(6)]
    out = []
    for _ in range(150):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60)))]
        parts += rnd.sample(shared, rnd.choice([0, 0, 1, 2]))
        rnd.shuffle(parts)
        out.append(" ".join(parts))
    for k in range(40):
        words = out[k % 7].split(" ")
        words[rnd.randrange(len(words))] = word()
        out.append(" ".join(words))
    out += [out[3]] * 20 + ["", None, "a", "a b", "a" * 49, "a" * 300, "ab" * 120, "a" * 120]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(5).cache()


@pytest.mark.parametrize("options", [{}, {"block_bytes": 4000, "bucket_bytes": 3000, "hot": 3}])
def test_suffix_dedup(docs, texts, options, monkeypatch):
    least = {}
    for i, t in texts:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            least.setdefault(b[a : a + 50], i)
    wanted = {}
    for i, t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for a in range(len(b) - 49):
            if least[b[a : a + 50]] < i:
                gone[a : a + 50] = [True] * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        wanted[i] = (len(b), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    found = {r["doc_id"]: (r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in substrings.covered(docs, **options).collect()}
    assert found == wanted


def test_collections_of_any_size(texts):
    import numpy as np

    from matchloom.llm import bwt, common

    data = " ".join(t or "" for _, t in texts).encode()
    body, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    _, _, start, size = substrings.segments(body, offsets)
    length = size + substrings.WINDOW - 1
    strings = substrings.gathered(body, start, length)
    first, _ = substrings.distinct(strings, length)
    whole = substrings._least(strings[first], length[first], start[first])
    old, substrings.COLLECTION = substrings.COLLECTION, 2000
    try:
        assert (substrings._least(strings[first], length[first], start[first]) == whole).all()
    finally:
        substrings.COLLECTION = old
    assert bwt and common


def test_only_strings_that_share_a_window_are_transformed(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 60 * 80).astype(np.uint8)
    strings, length = data.reshape(60, 80).copy(), np.full(60, 80)
    length[::3] = 61
    strings[::3, 61:] = 0
    strings[7, 5:56] = strings[31, 20:71]  # 51 bytes, so two windows
    values = np.arange(100, 160)[::-1].copy()
    wanted = np.full((60, substrings.SPAN), np.iinfo(np.int64).max)
    for r in range(60):
        wanted[r, : length[r] - 49] = values[r]
    wanted[7, 5:7] = wanted[31, 20:22] = values[31]
    seen = []
    plain = substrings.bwt.least_by_window
    monkeypatch.setattr(substrings.bwt, "least_by_window", lambda rows, *rest: seen.append(len(rows)) or plain(rows, *rest))
    monkeypatch.setattr(substrings, "gram_hashes", lambda d, n, f=substrings.gram_hashes: f(d, n) if n == substrings.WINDOW else np.zeros(len(d) - n + 1, np.uint64))
    assert (substrings._least(strings, length, values) == wanted).all()
    assert seen == [2]


@pytest.mark.parametrize(("percent", "n", "limits"), [(90, 3, {}), (80, 5, {"ROUNDS": 1, "GROUP_FEATURES": 2000}), (80, 3, {"ROUNDS": 0, "GROUP_FEATURES": 300, "BLOCK_SIGNATURES": 500})])
def test_jaccard(spark, texts, percent, n, limits, monkeypatch):
    """Also with groups that sign again, and with groups that are cut into blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(3)
    chain = [f"w{k}" for k in range(80)]
    more = []
    for k in range(60):  # near copies and chains of them, whose ends have little in common
        chain[rnd.randrange(80)] = f"c{k}"
        more.append((2000 + k, " ".join(chain)))
    rows = texts + more

    def features(t):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split() if w]
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())

    sets = {i: features(t) for i, t in rows}
    component = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        moved = False
        for a, b in links:
            low = min(component[a], component[b])
            moved |= component[a] != component[b]
            component[a] = component[b] = low
        if not moved:
            break
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["n_features"], r["component"]) for r in jaccard.components(docs, percent=percent, n=n).collect()}
    assert found == {i: (len(sets[i]), component[i]) for i in sets}


def test_shared_features(spark, texts):
    """Sets are left out only if too few of their features occur elsewhere, with blocks and buckets of any size."""
    import pyarrow as pa

    from matchloom.llm import sharing
    from matchloom.llm.wordsets import feature_sets

    sets = {t: frozenset(f.tolist()) for t, (_, f) in zip([t for _, t in texts], feature_sets(pa.array([t for _, t in texts]), 3), strict=True) if len(f)}
    counts = Counter(x for s in set(sets.values()) for x in s)
    wanted = {s for s in sets.values() if 100 * sum(counts[x] > 1 for x in s) >= 90 * len(s)}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for sizes in ((500_000, 1_000_000), (300, 200)):
        found = [sets[r["text"]] for r in sharing.candidates(docs, sum(map(len, sets.values())), 90, 3, *sizes).collect()]
        assert set(found) == wanted and len(found) == len(wanted)


def test_features_shared_by_chance(spark):
    """A set whose features occur in larger sets only, or here one and there one, is similar to none and leaves; similar sets stay, in bands of any number of groups."""
    from matchloom.llm import sharing

    rnd = random.Random(7)
    words = lambda k: [f"w{rnd.randrange(10**9)}" for _ in range(k)]
    large = [words(300) for _ in range(20)]
    inside = [t[40 * k : 40 * k + 40] for t in large for k in range(7)]
    own = [words(100) for _ in range(40)]
    near = [[*t[:-1], "end"] for t in own]  # 95 of 97 features of each
    rows = [(i, " ".join(t)) for i, t in enumerate(large + inside + own + near)]
    sizes = [len(t.split()) - 4 for _, t in rows]
    starts, by_band = sharing.bands(80).tolist(), {}
    for size in sizes:
        band = max(b for b, s in enumerate(starts) if s <= size)
        by_band[band] = by_band.get(band, 0) + size
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {" ".join(t) for t in own + near}
    for limits in ((), (200, 300), (10_000, 50)):
        found = [r["text"] for r in sharing.candidates(docs, sum(sizes), 80, 5, *limits, by_band=by_band).collect()]
        assert set(found) == kept and len(found) == len(kept)
    # of one size: every feature is in about ten sets, a tenth of them in any one group of blocks
    mixed = [rnd.sample(range(2000), 96) for _ in range(200)]
    counts = Counter(w for t in mixed for w in t)
    assert all(100 * sum(counts[w] > 1 for w in t) >= 80 * len(t) for t in mixed)
    docs = spark.createDataFrame([(i, " ".join(f"v{w}" for w in t)) for i, t in enumerate(mixed)], "doc_id long, text string").repartition(3)
    band = max(b for b, s in enumerate(starts) if s <= 96)
    assert sharing.candidates(docs, 96 * 200, 80, 1, 100, 200, by_band={band: 96 * 200}).count() == 0


def test_few_keys_that_go_are_sent_to_the_texts(spark):
    """The texts cross the network once, for the join, and not once more to lose a few of them."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")], "doc_id long, text string")
    kept = jaccard.keep_one(docs)
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    found = defaultdict(list)
    places = defaultdict(list)
    for r in packing.pack_documents(docs, path).collect():
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for n, (piece, start, length, crc) in enumerate(sorted(found[i])):
            assert (piece, start) == (n, at)
            assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + length]))
            at += length
        assert at == len(ids) and (len(ids) > 2048 or len(found[i]) == 1)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048


def test_fullest_combination():
    """The subset-sum programme against every combination, and the number of sequences against a lower bound: long pieces alone, middle ones apart, short ones in what is left."""

    def least(counts, room):
        best = 0
        for t in range(room // 2 + 1):
            middle = {n: c for n, c in counts.items() if room // 2 < n <= room - t}
            short = sum(n * c for n, c in counts.items() if t <= n <= room // 2)
            left = sum((room - n) * c for n, c in middle.items())
            best = max(best, sum(c for n, c in counts.items() if n > room - t) + sum(middle.values()) + max(0, -(-(short - left) // room)))
        return max(best, -(-sum(n * c for n, c in counts.items()) // room))

    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(0, 4))}
        room = rnd.randint(0, 40)
        sums = {0}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(1, c + 1) if s + n * k <= room}
        chosen = packing.fullest(counts, room)
        assert sum(n * c for n, c in chosen.items()) == max(sums) and all(c <= counts[n] for n, c in chosen.items())
    for _ in range(20):
        counts = Counter(rnd.randint(1, 100) for _ in range(400))
        places = packing.plan(dict(counts), 100)
        used = Counter()
        for n, first, end, sequence, copies, _ in places:
            for k in range(first, end):
                used[sequence + (k - first) // copies] += n
        total = sum(n * c for n, c in counts.items())
        assert sum(used.values()) == total and max(used.values()) <= 100 and len(used) <= 1.015 * least(counts, 100)
        assert {n: sum(e - f for m, f, e, *_ in places if m == n) for n in counts} == counts


def test_toxicity_matcher():
    """The automaton against a search for every entry at every place."""
    from matchloom.llm import toxicity

    rnd = random.Random(8)
    words = ["ab", "abc", "b", "cab", "ba"]
    for _ in range(100):
        weights = {f" {rnd.choice(words)} ": float(rnd.randint(1, 5)) for _ in range(3)} | {f" {rnd.choice(words)}": float(rnd.randint(1, 5)) for _ in range(2)}
        exceptions = frozenset(f" {rnd.choice(words)} {rnd.choice(words)} " for _ in range(3))
        text = " " + " ".join(rnd.choices(words, k=12)) + " "
        excused = [(k, k + len(e)) for e in exceptions for k in range(len(text)) if text.startswith(e, k)]
        wanted = []
        for k in range(len(text)):
            fits = [(w, e) for e, w in weights.items() if text.startswith(e, k)]
            if fits:
                top = max(w for w, _ in fits)
                ends = {k + len(e) for w, e in fits if w == top}
                wanted.append((k, {e for e in ends if not any(s <= k and e <= z for s, z in excused)}, top))
        found = {a: (b, w) for a, b, w in toxicity.Matcher(toxicity.Lexicon(weights, exceptions)).entries(text)}
        for k, ends, top in wanted:
            assert k in found and found[k][0] in ends and found[k][1] == top if len(ends) == 1 and k in found else k not in found or found[k][1] == top
        assert found.keys() <= {k for k, _, _ in wanted} and {k for k, ends, _ in wanted if not ends}.isdisjoint(found)


def test_toxicity_lexicon(spark):
    """Entries and their weights against document frequencies that are counted here."""
    from matchloom.llm import toxicity

    rnd = random.Random(9)
    bad, good = ["grolm", "vexit", "plusk"], ["tree", "river", "stone", "cloud", "grass", "light"]
    rows = []
    for k in range(300):
        words = rnd.choices(good, k=12)
        if k % 3 == 0:
            words[rnd.randrange(12)] = rnd.choice(bad)
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    n = Counter(y for _, _, y in rows)
    for w in bad:
        inside = sum(w in t.split() for _, t, _ in rows)
        assert abs(lexicon.weights[f" {w} "] - (log((inside + 0.5) / (n[1] + 1)) - log(0.5 / (n[0] + 1)))) < 1e-9
    assert not any(f" {w} " in lexicon.weights for w in good)
    scored = toxicity.score(docs, lexicon).collect()
    assert all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in scored)


def test_token_store(docs, texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    at, wanted = 0, {}
    for i, t in sorted(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        wanted[i] = (at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.round_trip(docs, path).collect()} == wanted


#: Texts that spell added tokens: alone, inside words, at either end, twice, next to odd white space, in other case.
SPELT = ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b c", "x y <|endoftext|>", "<|endoftext|> z", "<|startoftext|> p <|endoftext|><|endoftext|> q", "u  <|endoftext|>\tv", "W <|ENDOFTEXT|> w", "plain words <| only"]


@pytest.mark.parametrize(("name", "end"), [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)])
def test_added_tokens(spark, name, end):
    from tokenizers import Tokenizer

    path = vocabulary(name)
    tok = Tokenizer.from_file(path)
    ids = [[*tok.encode(t, add_special_tokens=False).ids, end] for t in SPELT]
    crcs = [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)) for own in ids]
    docs = spark.createDataFrame(list(enumerate(SPELT)), "doc_id long, text string").repartition(2)
    if end == packing.END_ID:
        found = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_documents(docs, path).collect()}
        assert found == {i: (len(own), c) for i, (own, c) in enumerate(zip(ids, crcs, strict=True))}
    else:
        found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.round_trip(docs, path).collect()}
        assert found == {i: (sum(map(len, ids[:i])), len(own), c) for i, (own, c) in enumerate(zip(ids, crcs, strict=True))}


@pytest.mark.parametrize(("name", "blank"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_on_odd_texts(name, blank):
    """The ids of the library for texts of odd white space, signs, contractions, marks, several scripts and added tokens."""
    import pyarrow as pa

    from matchloom.llm import tokens

    rnd = random.Random(name)
    signs = list("abAB é'’.,!?-_\n\t019ßÀñ漢́½²ªº<|>~`^{}[]@#$%&*()+=/\\") + ["'s", "'re", "'ll", " ", "  ", "don't", "<|endoftext|>", "\n\n", "\r\n", "İ", "ﬁ", "Σ"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 40))) for _ in range(1500)] + ["a" * 3000 + "漢", None, ""]
    encoder = tokens.Encoder(vocabulary(name), cached_words=2000)
    found = [ids[a:z].tolist() for _, ids, bounds in tokens.encoded(pa.array(texts), encoder) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_language_model(spark, docs):
    """Against naive Bayes on counted n-grams; in so many buckets that hardly any two n-grams share one."""
    rnd = random.Random(1)
    make = lambda letters: " ".join("".join(rnd.choices(letters, k=5)) for _ in range(20))
    rows = [(make("aeioumn"), "xx") for _ in range(30)] + [(make("aetklou"), "yy") for _ in range(20)]
    labelled = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(labelled, n_buckets=1 << 22)
    grams = lambda t: [t[k : k + n] for n in langid.ORDERS for k in range(len(t) - n + 1)]
    counts = {name: Counter(g for t, x in rows if x == name for g in grams(t)) for name in ("xx", "yy")}
    tests = [make("aeioumn") for _ in range(20)] + [make("aetklou") for _ in range(20)] + [make("aeoul") for _ in range(20)]

    def best(t):
        points = {n: log(sum(x == n for _, x in rows) + 1) + sum(log((c[g] + 0.5) / (sum(c.values()) + 0.5 * (1 << 22))) for g in grams(t)) for n, c in counts.items()}
        return max(points, key=points.get)

    found = {r["text"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame([(t,) for t in tests], "text string"), model).collect()}
    assert sum(found[t] == best(t) for t in tests) >= len(tests) - 1
    assert hashlib and F
    # a language of few rows stays in the model, copies of a hot text are sampled one by one, and no total leaves a sample empty
    hot = labelled.union(labelled.sparkSession.range(100, 400).selectExpr("id", "'aaaa eeee'", "'xx'"))
    small = langid.fit(hot, max_rows=10)
    assert small.languages == ["xx", "yy"] and small.prior[0] > small.prior[1]
    kept = hot.where(F.pmod(F.xxhash64("doc_id"), F.lit(langid.SHARES)) < langid.share_of(330, 10)).where("lang = 'xx'").count()
    assert 1 <= kept <= 30 and langid.share_of(10**13, 20_000) > 10**6 and langid.share_of(5, 10) == langid.SHARES


def test_every_similar_pair_shares_a_star(spark):
    """A set whose signatures a smaller set of its own block has as well still meets a smaller one of another block."""
    rnd = random.Random(5)
    texts, near = {}, {}
    for k in range(150):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        texts[300 + 2 * k + 1] = " ".join(words)
        texts[300 + 2 * k] = " ".join([*words[:-1], "end"])  # comes first in the block of the one above
        texts[k] = " ".join([*words[:30], "mid", *words[31:]])
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in texts.items()}
    frame = spark.createDataFrame(sorted(texts.items()), "id long, text string").withColumn("component", F.lit(0).cast("long"))
    for a, b in jaccard.candidate_edges(frame, len(texts), sum(map(len, sets.values())), 90, 3).collect():
        near.setdefault(b, {b}).add(a)
    shared = {pair for star in near.values() for pair in combinations(sorted(star), 2)}
    links = [(k, 300 + 2 * k + 1) for k in range(150)]
    assert all(100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for a, b in links)
    assert not [pair for pair in links if pair not in shared]


def test_members_of_a_star_by_chance_leave_before_their_texts_travel(spark):
    common_words = [f"c{k}" for k in range(30)]
    rows = [(i, 40, " ".join(common_words + [f"o{i}x{k}" for k in range(10)])) for i in range(60)]  # similarity 0.6
    rows.append((100, 40, rows[20][2].replace("o20x0", "changed")))
    kept = spark.createDataFrame(rows, "id long, size long, text string")
    found = {tuple(r) for r in jaccard.candidate_groups(kept, 80, 1).collect()}
    assert found == {(20, 20), (20, 100)}


def test_sketches_part_no_similar_sets(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 60, rng.integers(1, 3000)).astype(np.uint64)
        for _ in range(4):
            own = base[rng.random(len(base)) > 0.08 * rng.random()]
            sets.append(np.unique(np.append(own, rng.integers(0, 1 << 60, rng.integers(0, 1 + len(base) // 12)).astype(np.uint64))))
    sizes = np.array([len(s) for s in sets])
    sketches = np.frombuffer(b"".join(map(jaccard.sketch, sets)), np.uint64).reshape(len(sets), -1)
    first = jaccard.close_groups(sizes, sketches, 80)
    linked = 0
    for x in range(len(sets)):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 80 * (sizes[x] + sizes[y] - both):
                linked += 1
                assert first[x] == first[y]
    assert linked > 40 and len(set(first.tolist())) > 20
