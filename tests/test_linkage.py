"""Linkage operators on small fixtures: literals, plain versions, round trips, conservation."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity
from matchloom.functions import text as x
from matchloom.operators import analytics, candidates, expand, funnel, resolve, rules
from matchloom.plans import bank
from matchloom.sources import tables, workbooks
from matchloom.streaming import scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("Disjuntor (52-1) - Aberto", "52 1 ABERTO"), ("RELE 67 N 1 ATUADO", "RELE 67N1 ATUADO"), ("Sobrecorrente Estágio 2", "SOBRECORRENTE E2"), ("FASE A DO DISJ", "FASE A DISJUNTOR")],
)
def test_canonical(spark, text, wanted):
    found = value(spark, x.canonical(F.lit(text)))
    assert found.split()[-1] == wanted.split()[-1] and "Á" not in found and "(" not in found


def test_states_and_phases(spark):
    assert value(spark, x.text_state(F.lit("Disjuntor desligado"))) == "POSICAO"
    assert value(spark, x.text_polarity(F.lit("Disjuntor desligado"))) == "B"
    assert value(spark, x.text_state(F.lit("Falha com chave fechada"))) is None
    assert value(spark, x.phase_in(F.split(F.lit("TENSAO FASE AC"), " "))) == "CA"
    assert value(spark, x.fold_exact(F.lit("ação"))) == "ACAO"


def test_similarity():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abcd ", k=rnd.randint(0, 30))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == lcs(a, b)
    assert similarity.token_sets("a b c", "b a") == 100 and similarity.sorted_tokens("b a", "a b") == 100


def test_fuzzy_and_typos(spark):
    signals = spark.createDataFrame([(1, "RELE SOBRECORRENTE"), (2, ""), (3, "DJ ABERTO")], "id long, text string")
    catalogue = spark.createDataFrame([(0, "DJ", "DISJUNTOR ABERTO"), (1, "67N", "RELE SOBRECORRENTE NEUTRO")], "ord long, code string, text string")
    found = {(r["id"], r["code"]): r["score"] for r in candidates.fuzzy(signals, catalogue).collect()}
    assert found[(1, "67N")] == 1.0 and found[(2, "DJ")] == 0.0
    assert found[(3, "DJ")] == pytest.approx(min(1, similarity.token_sets("DJ ABERTO", "DISJUNTOR ABERTO") / 100 + 0.25))
    words = spark.createDataFrame([("DISJUNTR",), ("XYZW",), ("RELE",)], "token string")
    terms = spark.createDataFrame([("DISJUNTOR",), ("RELE",), ("CHAVE",)], "term string")
    assert [tuple(r) for r in candidates.repaired(words, terms).collect()] == [("DISJUNTR", "DISJUNTOR")]


def test_typos_of_long_words(spark):
    words = spark.createDataFrame([("TARNSFORMADOERS",), ("DISJNUTRO",)], "token string")
    terms = spark.createDataFrame([("TRANSFORMADORES",), ("DISJUNTOR",)], "term string")
    assert similarity.indel("TARNSFORMADOERS", "TRANSFORMADORES") > 85 > similarity.indel("DISJNUTRO", "DISJUNTOR")
    assert [tuple(r) for r in candidates.repaired(words, terms).collect()] == [("TARNSFORMADOERS", "TRANSFORMADORES")]


def test_greedy_parity(spark):
    rnd = random.Random(5)
    rows = [(g, a, rnd.choice("xy"), n) for g in range(60) for n, a in enumerate(sorted(rnd.choices(range(12), k=8)))]
    found = {(r["g"], r["ord"]): r["role"] for r in resolve.fuse_positions(spark.createDataFrame(rows, "g int, address int, polarity string, ord int"), ["g"]).collect()}
    for g in range(60):
        own, i = [r for r in rows if r[0] == g], 0
        while i < len(own):
            if i + 1 < len(own) and own[i + 1][1] == own[i][1] + 1 and own[i + 1][2] != own[i][2]:
                assert (found[(g, own[i][3])], found[(g, own[i + 1][3])]) == ("head", "tail")
                i += 2
            else:
                assert found[(g, own[i][3])] == "single"
                i += 1


def test_pair_greedy(spark):
    rows = [(1, "m", "Input", "DISJUNTOR ABERTO", 0), (2, "m", "Input", "CHAVE LOCAL", 1), (3, "m", "Output", "ABERTO DISJUNTOR", 2), (4, "m", "Output", "ZZZ", 3)]
    found = {r["id"]: r["partner"] for r in resolve.pair_greedy(spark.createDataFrame(rows, "id long, module string, direction string, text string, ord int"), ["module"]).collect()}
    assert found == {1: 3, 3: 1, 2: None, 4: None}


def sequential(rows, minimum):
    """The pairs of (id, key, side, text, ord) by the sequential rule."""
    ins, outs = ([r for r in rows if r[2] == side] for side in ("Input", "Output"))
    near = [(similarity.sorted_tokens(o[3] or "", i[3] or ""), (o[4], o[0]), (i[4], i[0])) for o in outs for i in ins if o[1] == i[1]]
    used, wanted = set(), {}
    for s, o, i in sorted(near, reverse=True):
        if s >= minimum and o[1] not in used and i[1] not in used:
            used |= {o[1], i[1]}
            wanted |= {o[1]: (i[1], s), i[1]: (o[1], s)}
    return {r[0]: wanted.get(r[0], (None, None)) for r in rows}


def test_greedy_matching_with_ties(spark):
    """Many small keys, one of many rows and few texts, and one of many texts."""
    rnd = random.Random(11)
    words = ["AB", "AC", "BC", "ABC", "D", "DA"]
    rows = []
    for key in [*range(60), None]:
        for _ in range(rnd.randint(2, 20)):
            rows.append((len(rows), key, rnd.choice(["Input", "Output", "Output", "InputOutput"]), rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randint(1, 3)))]), rnd.randint(0, 9)))
    for _ in range(400):
        rows.append((len(rows), 777, rnd.choice(["Input", "Output"]), " ".join(rnd.choices(words[:3], k=2)), rnd.randint(0, 300)))
    for _ in range(150):
        rows.append((len(rows), 778, rnd.choice(["Input", "Output"]), "".join(rnd.choices("ABCD", k=rnd.randint(4, 9))), 0))
    frame = spark.createDataFrame(rows, "id long, module long, direction string, text string, ord int").repartition(3)
    found = resolve.pair_greedy(frame, ["module"]).collect()
    assert len(found) == len(rows) and {r["id"]: (r["partner"], r["score"]) for r in found} == sequential(rows, 60.0)


def test_greedy_matching_of_no_rows(spark):
    assert not resolve.pair_greedy(spark.createDataFrame([], "id long, module long, direction string, text string, ord int"), ["module"]).collect()


def test_pair_greedy_of_a_large_group(spark):
    """400 million pairs of rows, of 20 x 20 texts."""
    one = F.concat_ws(" ", F.lit("DISJUNTOR"), (F.col("id") % 20).cast("string"))
    rows = spark.range(40_000).select("id", F.lit("m").alias("module"), F.when(F.col("id") < 20_000, "Input").otherwise("Output").alias("direction"), one.alias("text"), F.col("id").alias("ord"))
    found = resolve.pair_greedy(rows, ["module"]).collect()
    assert len(found) == 40_000 and all(r["score"] == 100 and abs(r["id"] - r["partner"]) == 20_000 for r in found)


def test_rules(spark):
    rows = [(1, "50A", 0, 0.5), (1, "27", 1, 0.5), (2, "DJF1", 0, 0.5)]
    frame = spark.createDataFrame(rows, "id long, code string, ord int, score double").withColumn("text", F.when(F.col("id") == 1, "RELE 50 SOBRECORRENTE").otherwise("DISJUNTOR FECHADO"))
    frame = frame.withColumn("tokens", F.split("text", " ")).withColumns({c: F.lit(None).cast("string") for c in ("phase", "family", "direction", "side", "mm", "code_direction", "category", "phases")})
    assert {(r["id"], r["code"]) for r in rules.filtered(frame).collect()} == {(1, "50A"), (2, "DJF1")}
    moved = {(r["id"], r["code"]): round(r["delta"], 2) for r in rules.adjusted(frame).collect()}
    assert moved[(1, "50A")] > 0 > moved[(1, "27")]


def test_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "x & <y>", None), ("b", 2, "ä", "2"), ("c", 1, "", "3")], "book string, ord int, one string, two string")
    for r in workbooks.workbooks(rows, "book", "ord", ["one", "two"], head=[["title"]]).collect():
        (tmp_path / f"{r['key']}.xlsx").write_bytes(r["content"])
    found = {(r["file"].rsplit("/", 1)[1], r["row_no"]): r["cells"] for r in workbooks.read(spark, str(tmp_path)).collect()}
    assert found[("b.xlsx", 1)] == ["title"] and found[("b.xlsx", 3)] == ["x & <y>"] and found[("b.xlsx", 4)] == ["ä", "2"] and found[("c.xlsx", 2)] == ["one", "two"]
    assert workbooks.read(spark, str(tmp_path), 2).where("row_no > 2").count() == 0
    assert [workbooks.column_number(workbooks.column_name(n)) for n in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_tables(spark):
    sheets = spark.createDataFrame([("S", 1, ["Code", "Text"]), ("S", 2, ["a", "one"]), ("S", 3, ["#N/A", "no"]), ("S", 4, ["A ", "two"])], "sheet string, row_no int, cells array<string>")
    rows = tables.by_header(sheets, "S", {"code": "CODE", "text": "TEXT", "more": "MORE"})
    assert [(r["code"], r["text"], r["more"]) for r in rows.orderBy("ord").collect()] == [("a", "one", None), ("A", "two", None)]
    assert [tuple(r) for r in tables.last_of(rows, "code", "text").collect()] == [("A", "TWO")]
    with pytest.raises(ValueError, match="MISSING"):
        tables.by_header(sheets, "S", {"code": "MISSING"})
    assert tables.settings("weight_a = 0.9\nk = 3\nother = 1", {"weight_a": 0.7, "weight_b": 0.3, "k": 5}) == {"weight_a": 0.7, "weight_b": 0.3, "k": 3}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["relay", "open"]), (2, ["nothing"])], "id long, terms array<string>")
    catalogue = spark.createDataFrame([(0, "A", ["relay", "open"]), (1, "B", ["switch", "relay"])], "ord long, code string, terms array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scoring.score_stream(stream, catalogue, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    found = {r["id"]: (r["code"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: ("A", "decided"), 2: (None, "review")}


def test_names():
    assert set(bank.ORACLE_SQL) <= set(bank.QUERIES) and len(bank.QUERIES) > 60


def test_signals_that_differ_only_in_id_are_decided_once(spark):
    """Members of a kind, whose values may be null, all get what was found for it; a null id stays."""
    said = [("A", ["A"], None), ("A", ["A"], "ABC"), (None, None, None)]
    rows = spark.createDataFrame([(None if i == 7 else i, *said[i % 3]) for i in range(30)], "id long, text string, tokens array<string>, phase string")
    asked = []

    def found(each):
        asked.append(each.count())
        return each.select("id", F.coalesce("phase", F.lit("none")).alias("code"))

    got = funnel.by_kind(rows, found).collect()
    assert asked == [3]
    assert sorted((-1 if r["id"] is None else r["id"], r["code"]) for r in got) == sorted((-1 if i == 7 else i, "ABC" if i % 3 == 1 else "none") for i in range(30))


def test_accuracy_of_rows_that_stand_for_several(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, code string, rank int")
    each = [(1, "a", True)] * 3 + [(1, "b", True)] * 2 + [(2, "x", False)]
    wanted = spark.createDataFrame([(1, "a", True, 3), (1, "b", True, 2), (2, "x", False, 1)], "id long, code string, decided boolean, n long")
    found = analytics.accuracy(ranked, wanted).first()
    assert (found["acc_1"], found["recall_3"], found["decided"], found["precision"]) == (3 / len(each), 5 / len(each), 5 / len(each), 3 / 5)


def test_families_offer_codes_without_a_join_on_them(spark):
    rows = [(1, "A1", 0.5), (1, "A2", 0.7), (1, "X", 0.9), (2, "B1", 0.4), (2, "AB", 0.6), (2, "AB", 0.2), (None, "A1", 0.3), (3, "X", 1.0), (3, None, 0.1)]
    held = spark.createDataFrame(rows, "id long, code string, score double")
    families = [("A1", "A"), ("A2", "A"), ("A3", "A"), ("B1", "B"), ("AB", "A"), ("AB", "B"), ("X", None), (None, "A")]
    cat = spark.createDataFrame(families, "code string, family string")
    found = expand.by_family(held, cat)
    best = {}
    for i, c, s in rows:
        for f in {f for code, f in families if code == c and c is not None and f is not None}:
            best[i, f] = max(s, best.get((i, f), 0.0))
    wanted = [(*r, "direct") for r in rows]
    wanted += [(i, c, b * 0.9, "family") for (i, f), b in best.items() for c, of in families if of == f and (i is None or c is None or (i, c) not in {r[:2] for r in rows})]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()  # all codes of all families would cross the network


def test_simplex_counts_hits_where_codes_meet(spark):
    rnd = random.Random(5)
    value_of = lambda: rnd.choice([None, 0.0, 0.1, 0.123456789, 0.3, round(rnd.random(), 9), rnd.random(), -0.25])
    rows = [(i, c, value_of(), value_of(), value_of()) for i in range(60) for c in rnd.sample(["A", "B", "C", "D"], rnd.randint(1, 4))]
    rows += [(100, "A", 0.1, 0.1, 0.1), (100, "B", 0.1, 0.1, 0.1), (101, "B", 0.1 + 4e-10, 0.0, 0.0), (101, "A", 0.1, 0.0, 0.0)]
    wanted = [(i, rnd.choice("ABCD")) for i in range(60)] + [(100, "B"), (101, "A"), (102, "A"), (103, None)]
    triples = analytics.weight_simplex(4)
    got = analytics.simplex_search(spark.createDataFrame(rows, "id long, code string, s1 double, s2 double, s3 double"), spark.createDataFrame(wanted, "id long, code string"), triples)
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for each triple of an id
    offered = {}
    for i, *r in rows:
        offered.setdefault(i, []).append(r)
    scored = lambda t, s: None if None in s else Decimal(repr(t[0] * s[0] + t[1] * s[1] + t[2] * s[2])).quantize(Decimal("1e-9"), ROUND_HALF_UP)
    for a, b, c, accuracy in map(tuple, got.collect()):
        hits = []
        for i, w in wanted:
            if i in offered:
                first = min(((scored((a, b, c), s) is None, -(scored((a, b, c), s) or 0), code) for code, *s in offered[i]))
                hits.append(first[2] == w)
        assert accuracy == sum(hits) / len(hits)
    assert got.count() == len(triples)


def test_simplex_rounds_as_sql(spark):
    rnd = random.Random(6)
    values = [0.5e-9, 1.5e-9, -0.5e-9, 2.5e-9, 0.1234567885, 0.0000000015, 1e5 + 0.1234567895, float("nan")] + [round(rnd.uniform(-3, 3), 10) for _ in range(2000)]
    sql = [r["v"] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(F.round("v", 9).alias("v")).collect()]
    found = analytics._rounded(np.array(values)[:, None])[:, 0]
    assert [v / 1e9 for v in found[:7]] == sql[:7] and found[7] == -np.inf and [v / 1e9 for v in found[8:]] == sql[8:]
