"""The fuzzy index against the nested loop."""

import heapq
import random

import pytest

from matchloom.functions import similarity
from matchloom.operators import candidates
from matchloom.operators.fuzzy import Index

WORDS = [a + b for a in ("DISJ", "CHAV", "TRAF", "BARR", "REL", "SEC", "POT", "TENS") for b in ("UNTOR", "E", "ONADOR", "AMENTO", "AO", "IONAL", "ENCIA", "O", "ÃO 1", "2 A")]


def nested_loop(rows, text, k, boost=0.25):
    own = set((text or "").split())
    scored = [(-min(1.0, similarity.token_sets(text or "", body or "") / 100 + boost * (code in own)), o, code) for o, code, body in rows]
    return [(-s, o, c) for s, o, c in heapq.nsmallest(k, scored)]


@pytest.mark.parametrize("seed", range(4))
def test_index(seed):
    rnd = random.Random(seed)
    text = lambda: rnd.choice([None, "", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 4))), "".join(rnd.choices("AB C", k=rnd.randint(1, 90)))])
    rows = [(i * 2, rnd.choice(["X", "CHAVE", "REL2", "A"]), text()) for i in range(rnd.choice([0, 1, 40, 700]))]
    index = Index(rows)
    for _ in range(60):
        said, k = text(), rnd.choice([1, 5, 50])
        wanted = nested_loop(rows, said, k)
        found = index.search(said, k, 0.25)
        assert [(o, c) for _, o, c in found] == [(o, c) for _, o, c in wanted]
        assert [s for s, _, _ in found] == pytest.approx([s for s, _, _ in wanted], abs=1e-12)


def test_large_catalogue_is_hardly_compared():
    rnd = random.Random(1)
    rows = [(i, f"C{i}", " ".join(rnd.choices(WORDS, k=rnd.randint(2, 5)))) for i in range(50_000)]
    index = Index(rows)
    for _ in range(6):
        words = rows[rnd.randrange(len(rows))][2].split()
        words[rnd.randrange(len(words))] += rnd.choice("XYZ")
        said = " ".join(words)
        assert [(o, c) for _, o, c in index.search(said, 5, 0.25)] == [(o, c) for _, o, c in nested_loop(rows, said, 5)]
    assert index.verified < 0.05 * index.asked, index.verified / index.asked


def test_blocks_of_a_catalogue(spark):
    rnd = random.Random(3)
    rows = [(i, f"C{i}", " ".join(rnd.choices(WORDS, k=3))) for i in range(60)] + [(60, "E", None)]
    said = [(1, "CHAVE RELE"), (2, None), (3, "C7 TENSO"), (4, "CHAVE RELE")]
    frame, catalogue = spark.createDataFrame(said, "id long, text string"), spark.createDataFrame(rows, "ord long, code string, text string")
    for limit in (1000, 13):
        found = candidates.fuzzy(frame, catalogue, 4, limit=limit).collect()
        for i, text in said:
            own = sorted((r["rank"], r["ord"]) for r in found if r["id"] == i)
            assert own == [(k, o) for k, (_, o, _) in enumerate(nested_loop(rows, text, 4), 1)]


def test_canonical_form_with_repairs(spark):
    """A misspelt description has the form, and so the candidates, of the right one."""
    right = ["Disjuntor 52-1 aberto", "Seccionadora com defeito", "Transformador de corrente", "Relé 67 N 1 atuado", "DISJUNTR", "", None]
    wrong = ["Disjuntro 52-1 aberto", "Secionadora com defeito", "Transfromador de corrente", "Relé 67 N 1 atuado", "XYZWQ", "", None]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(right, wrong, strict=True))], "id long, good string, bad string")
    terms = candidates.vocabulary(spark.createDataFrame([("DISJUNTOR ABERTO SECCIONADORA DEFEITO",), ("TRANSFORMADOR CORRENTE RELE ATUADO",)], "text string"))
    found = {r["id"]: r for r in candidates.canonical(candidates.canonical(rows, terms, text="good").withColumnRenamed("canonical", "g"), terms, text="bad").collect()}
    assert len(found) == 7
    for i in (0, 1, 2, 3):
        assert found[i]["g"] == found[i]["canonical"] and found[i]["g"]
    assert found[4]["g"] == "DISJUNTOR" and found[4]["canonical"] == "XYZWQ"
    assert found[5]["canonical"] == "" and found[6]["canonical"] == ""
    assert "TRANSFORMADOR" in found[2]["canonical"] and "bad" in found[2].asDict()
