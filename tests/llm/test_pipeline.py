"""Each stage of the pipeline against a plain version, on texts with nulls, repeats, ties, long texts and columns with clashing names."""

import random
import re
from itertools import combinations

import pytest

pytest.importorskip("matchloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F

WORDS = {"en": "the of and a house green river stone under walk light paper window friend never".split(), "de": "der und das ein haus gruen fluss stein unter licht papier fenster freund niemals gehen".split()}
ITEM = "one two three four five six seven eight nine ten eleven twelve"
SECRET = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    out = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        out.append((i, " ".join(rnd.choices(WORDS[lang], k=rnd.randint(30, 90))), lang, "web", None))
    for i in range(60, 75):  # near copies, some of which are of 0.8 and more
        words = out[i % 6][1].split()
        for _ in range(i % 3 + 1):
            words[rnd.randrange(len(words))] = f"new{i}"
        out.append((i, " ".join(words), "en", "web", None))
    out += [(80, out[1][1], "en", "web", None), (81, None, "en", "web", None), (82, "", "en", None, None), (83, "123 !!!", None, "web", None), (84, "the house " + ITEM + " green river", "en", "web", None)]
    out += [(85, "the green house has token=abcdef123456 and the river", "en", "web", None), (86, " ".join(f"word{k}" for k in range(5000)), "en", "web", None)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("i", ITEM), ("j", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def kept(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_language_stage(spark, rows, folder):
    got = kept(corpus_pipeline.known_language(spark, docs(spark, rows), folder))
    assert set(got) == {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)} - (set() if 86 in got else {86})


def test_near_copy_stage(spark, rows, folder):
    sets = {}
    for i, t, *_ in rows:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    least = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = kept(corpus_pipeline.one_of_each_group(spark, docs(spark, rows), folder))
    assert set(got) == {i for i in sets if least[i] == i} and len(got) < len(rows)


def test_benchmark_stage(spark, rows, folder):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    item = words(ITEM)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    wanted = {i for i, t, *_ in rows if not any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t))))}
    assert set(kept(corpus_pipeline.without_benchmark(spark, docs(spark, rows), folder))) == wanted == {i for i, *_ in rows} - {84}


def test_secret_stage(spark, rows, folder):
    found = corpus_pipeline.without_secrets(spark, docs(spark, rows), folder)
    assert kept(found) == {i: None if t is None else SECRET.sub("<secret>", t) for i, t, *_ in rows}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found.collect())


def test_packing_stage(spark, rows, folder):
    from tokenizers import Tokenizer

    from matchloom.llm.queries import vocabulary

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    found = corpus_pipeline.packed(spark, docs(spark, rows), folder).toPandas()
    sizes = found.groupby("doc_id").length.sum().to_dict()
    assert sizes == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in rows}
    assert found.groupby("sequence_id").length.sum().max() <= 2048 and found.sequence_id.nunique() <= -(-sum(sizes.values()) // 2048) + 2


def test_stages_keep_columns_and_empty_tables(spark, rows, folder):
    clashing = docs(spark, rows).select("*", *(F.lit(7).alias(c) for c in ("score", "spans", "n_hit", "items", "component", "lang_pred", "id")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing.limit(20), folder).columns == clashing.columns
        assert stage(spark, docs(spark, rows).limit(0), folder).count() == 0
    assert corpus_pipeline.packed(spark, docs(spark, rows).limit(0), folder).count() == 0


def test_whole_run(spark, rows, folder):
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert found <= {i for i, *_ in rows} and {81, 82, 83, 84, 80}.isdisjoint(found) and {1, 2, 85} <= found
