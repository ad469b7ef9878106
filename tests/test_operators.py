"""Operators without SQL, sources and sinks, errors, and catalogues of several blocks."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity
from matchloom.functions import text as x
from matchloom.operators import analytics, calibrate, candidates, project, resolve, review, structure
from matchloom.sources import tables, workbooks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Relé (67N) atuado", "RELE 67N ATUADO"), ("RELE 67 N 1 ATUADO", "67N1 ATUADO"), ("Sobrecorrente Estágio 2", "SOBRECORRENTE E2"), ("FASE A DO DISJ", "FASE A DISJUNTOR"), ("", ""),
        ("Tensão em KV da barra", "TENSAO KV BARRA"), ("LT proteção", "LINHA TRANSMISSAO PROTECAO"), ("52A1 falha", "FALHA"),
    ],
)
def test_canonical_whole(spark, text, wanted):
    got = value(spark, x.canonical(F.lit(text)))
    assert got == wanted


def test_structure_of(spark):
    got = value(spark, x.structure_of(F.lit("Disj. 52-10 barra P fase AC")))
    assert (got["family"], got["device"], got["bus"], got["phase"]) == ("Disjuntor", "52-10", "Principal", "CA")


def test_blocks_of_a_catalogue(spark):
    signals = spark.createDataFrame([(i, f"word{i % 5} rele aberto") for i in range(20)], "id long, text string")
    cat = spark.createDataFrame([(i, f"C{i}", f"word{i % 7} rele fechado {i % 3}") for i in range(40)], "ord long, code string, text string")
    key = lambda df: sorted((r["id"], r["rank"], r["code"], round(r["score"], 9)) for r in df.collect())
    assert key(candidates.fuzzy(signals, cat, 4, limit=7)) == key(candidates.fuzzy(signals, cat, 4))
    vectors = lambda df: candidates.encoded(df)
    assert key(candidates.cosine(vectors(signals), vectors(cat), 4, block_bytes=8 * 256 * 7)) == key(candidates.cosine(vectors(signals), vectors(cat), 4))


def test_encoders_and_rerank(spark):
    rows = spark.createDataFrame([(1, "a b a")], "id long, text string")
    assert sum(candidates.encoded(rows).first()["vector"]) == 3
    assert candidates.encoded(rows, lambda c: F.array(F.length(c).cast("double"))).first()["vector"] == [len("query: a b a")]
    pairs = spark.createDataFrame([(1, "x", "A", "xx", 0), (1, "x", "B", "x", 1)], "id long, text string, code string, code_text string, ord long")
    got = {r["code"]: (r["rank"], round(r["score"], 6)) for r in candidates.reranked(pairs, lambda a, b: -F.abs(F.length(a) - F.length(b))).collect()}
    assert got == {"B": (1, 0.5), "A": (2, 0.268941)}
    cat = spark.createDataFrame([("IA", "corrente fase A", "CORRENTE", "A", "Read")], "code string, text string, measure string, unit string, code_direction string")
    rich = candidates.corpora(cat, x.canonical).first()
    assert rich["rich"] == f"IA {rich['text']} CORRENTE A Read" and {r["term"] for r in candidates.vocabulary(cat).collect()} == {"corrente", "fase", "A"}


def test_calibrations(spark):
    rows = spark.createDataFrame([(1, "m", "A", 0.0), (1, "m", "B", 1.0)], "id long, method string, code string, score double")
    got = {r["code"]: r["score"] for r in calibrate.calibrated(rows, {"m": "platt"}, {"m": (1.0, 0.0)}).collect()}
    assert got["A"] == 0.5
    got = {r["code"]: r["score"] for r in calibrate.calibrated(rows, {"m": "isotonic"}, {"m": ([(0, 0.2), (1, 0.8)],)}).collect()}
    assert got == {"A": pytest.approx(0.2), "B": pytest.approx(0.8)}
    with pytest.raises(ValueError, match="unknown"):
        calibrate.calibrated(rows, {"m": "no"})
    labelled = spark.createDataFrame([(k / 20, int(k > 10 or k == 4)) for k in range(20)], "score double, label int")
    slope, _ = calibrate.fit_platt(labelled)
    knots = calibrate.fit_isotonic(labelled)
    assert slope > 0 and all(a[1] <= b[1] for a, b in zip(knots, knots[1:], strict=False))


def test_nearest_codes(spark):
    names = ["RELE ABERTO", "ABERTO RELE", "RELE FECHADO", "CHAVE", "CHAVES", "X"]
    unknown = spark.createDataFrame([(i, n, "t") for i, n in enumerate(["RELE ABERT", "CHAVE S", "ZZ", "RELE ABERT"])], "ord long, code string, text string")
    got = {r["code"]: (r["n"], r["nearest"]) for r in analytics.nearest_codes(unknown, spark.createDataFrame([(n,) for n in names], "code string"), 75.0).collect()}
    for code, (_, nearest) in got.items():
        rated = sorted((-similarity.sorted_tokens(code, n), n) for n in names)
        assert nearest == (rated[0][1] if -rated[0][0] >= 75 else None)
    assert got["RELE ABERT"][0] == 2


def test_catalogue_probe(spark):
    texts = ["RELE 67N ATUADO", "DISJUNTOR ABERTO AGORA", "ABERTO DISJUNTOR", ""]
    cat = [("67N", "SOBRECORRENTE"), ("DJ", "DISJUNTOR ABERTO"), ("Q", "")]
    found = analytics.catalogue_probe(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(cat, "code string, text string"))
    wanted = set()
    for i, t in enumerate(texts):
        for code, text in cat:
            if code in t.split():
                wanted.add((i, code, "exact"))
            elif text and t and similarity.sorted_tokens(t, text) > 90:
                wanted.add((i, code, "text"))
    assert {(r["id"], r["code"], r["how"]) for r in found.collect()} == wanted == {(0, "67N", "exact"), (2, "DJ", "text")}


def test_structuring(spark):
    rows = spark.createDataFrame([("M1:1", "M1", "high", True), ("M2:M2:1", "M2", "low", True), ("Z", None, "none", True)], "id string, module string, confidence string, trusted boolean")
    aliases = spark.createDataFrame([("M2", "LT2"), ("M1", "M1")], "module string, alias string")
    got = {r["id"]: r["module"] for r in structure.renamed_modules(rows, aliases).collect()}
    assert got == {"M1:1": "M1", "LT2:M2:1": "LT2", "Z": None}
    assert {r["module"]: (r["trusted"], r["flagged"]) for r in structure.by_confidence(rows).collect()}["M2"] == (False, True)
    decided = rows.withColumn("status", F.lit("decided"))
    with pytest.raises(ValueError, match="station"):
        structure.assembled(decided, None)
    assert structure.assembled(decided, "S").count() == 3 and structure.assembled(decided.limit(0), None).count() == 0
    assert [value(spark, structure.double_command(F.lit("Output"), F.lit(k))) for k in ("comando s", "COMANDO D", None)] == [False, True, True]
    cells = spark.createDataFrame([("M", 1, ["x", None]), ("M", 2, ["Módulo ", "n"]), ("M", 3, ["LT1", "1"]), ("M", 4, ["", "2"])], "sheet string, row_no long, cells array<string>")
    from matchloom.operators import discover

    assert {r["row_no"]: r["section"] for r in discover.section_column(cells).collect()} == {3: "LT1", 4: None}


def test_templates():
    class Frame:
        columns = ["id", "A"]

    with pytest.raises(ValueError, match="43"):
        project.fits_template(Frame, ["A"], "Discrete")
    with pytest.raises(ValueError, match="lacks"):
        project.fits_template(Frame, ["B"] * 43, "Discrete")
    assert project.fits_template(Frame, ["A"] + [None] * 42, "Discrete")[0] == "A"
    assert [len(c) for c in (project.DISCRETE_COLUMNS, project.ANALOG_COLUMNS, project.DISCRETE_ANALOG_COLUMNS)] == [21, 17, 16]
    assert project.file_name("OUT", None, "20260101") == "OUT_20260101.xlsx" and project.file_name("OUT", "S", "20260101", 2) == "OUT_S_20260101_v2.xlsx"


def test_review(spark):
    with pytest.raises(ValueError, match="0.900"):
        review.checked_weights({"a": 0.9})
    rows = spark.createDataFrame([(1, "Input"), (2, "Output"), (3, "InputOutput")], "id long, direction string")
    act = lambda *ids: review.pair_action(rows.where(F.col("id").isin(*ids))).first()["action"]
    assert (act(1, 2), act(3), act(1), act(1, 3)) == ("pair", "split", "refuse", "refuse")
    assert review.added(rows, spark.createDataFrame([(3,), (4,)], "id long")).count() == 4
    assert [value(spark, review.valid_address(F.lit(v))) for v in ("0", "65535", "65536")] == [True, True, False]


def test_pairing(spark):
    rows = [("a", "M", "52", "DJF1", "Input", "DISJUNTOR ABERTO"), ("b", "M", "52", "DJF1", "Output", "LOCAL"), ("c", "M", "53", "DJF1", "Input", "ABERTO"), ("d", "M", "53", "DJF1", "Output", "FECHADO"), ("e", "M", None, "CDC", "Output", "x"), ("f", "M", None, "79", "Output", "x"), ("g", "N", None, "79", "Input", "x")]
    df = spark.createDataFrame(rows, "id string, module string, device string, code string, direction string, text string")
    got = {r["id"]: r["status"] for r in resolve.pair_one_to_one(df, ["module", "device", "code"], "text", ("CDC",)).collect()}
    assert got == {"a": "ambiguous", "b": "ambiguous", "c": "paired", "d": "paired", "e": "legitimate_write", "f": "command_without_status", "g": "passes"}
    again = df.withColumns({"address": F.when(F.col("id") == "a", 5).when(F.col("id") == "c", 6), "polarity": F.col("id"), "output_address": F.lit(None).cast("int")})
    again = again.withColumn("device", F.lit("52"))
    got = {r["id"]: (r["status"], r["fused_with"]) for r in resolve.paired_again(again, ["module", "device"], ("DJF1",)).collect()}
    assert got["a"] == ("ambiguous", 6) and "c" not in got


def test_sources_and_sinks(spark, tmp_path):
    sheets = {
        "DiscreteSignals": [["SINAL", "DESCRIÇÃO NOVA", "VALOR"], ["A1", "um", "1;2"], ["#N/A", "x", "1"], ["B", "dois", "#N/A"], ["A1", "três", "1;x"]],
        "AnalogSignals": [["SINAL", "DESCRIÇÃO NOVA", "FASES"], ["IA", "corrente", "L1"]], "DE->PARA": [["DE", "PARA"], ["old", "a1"], ["OLD ", "b"]], "Message Mapping": [["Name"], ["m"], ["m"], [None]],
    }
    (tmp_path / "cat.xlsx").write_bytes(workbooks.built(sheets))
    read = workbooks.read(spark, str(tmp_path)).cache()
    cat = tables.catalogue(read).collect()
    assert [(r["category"], r["code"], r["text"], r["scada"]) for r in sorted(cat, key=lambda r: (r["category"], r["ord"]))] == [("Analog", "IA", "corrente", None), ("Discrete", "A1", "um", [1, 2]), ("Discrete", "B", "dois", []), ("Discrete", "A1", "três", [])]
    assert {r["old"]: r["new"] for r in tables.renames(read).collect()} == {"OLD": "B"} and tables.mappings(read).count() == 1
    assert tables.descriptions(lambda: read)["A1"] == "TRÊS" and tables.descriptions(lambda: workbooks.read(spark, str(tmp_path / "none"))) == {}
    frame = spark.createDataFrame([(1, "x", "decided"), (2, "y", "review")], "id long, code string, status string")
    tables.write_csv(frame, str(tmp_path / "a" / "b"))
    assert [r["id"] for r in tables.audit_files(spark, str(tmp_path / "a"), "id long, code string, status string").collect()] == [1]
    tables.write_json(frame, str(tmp_path / "j"))
    assert tables.read_json(spark, str(tmp_path / "j")).count() == 2
    built = []
    make = lambda: built.append(1) or frame
    for _ in range(2):
        assert tables.load_or_build(spark, str(tmp_path / "store"), "k", make).count() == 2
    assert len(built) == 1
    events = spark.createDataFrame([("t", "m", "INFO", "said")], "at string, module string, level string, message string")
    assert tables.event_lines(events).first()["value"] == "t [INFO] m: said"
    text = tables.settings_text({"a": 1, "b": True, "c": "x"}, {"a": 1, "b": False, "c": "y"})
    assert text == 'b = true\nc = "x"\n' and tables.settings(text, {"a": 1, "b": False, "c": "y"}) == {"a": 1, "b": True, "c": "x"}
    assert tables.relative("/a/b/c", "/a") == "b/c" and tables.relative("/x", "/a") == "/x"
    (tmp_path / "log.txt").write_text("file one\nwarn 7\nfile two\nwarn 8\n")
    lines = spark.createDataFrame([("f", 1, "file one"), ("f", 2, "warn 7"), ("f", 3, "file two"), ("f", 4, "warn 8")], "file string, line_no long, value string")
    assert [(r["context"], r["event"]) for r in tables.log_events(lines, r"^file (\w+)", r"^warn (\d)").orderBy("line_no").collect()] == [("one", "7"), ("two", "8")]
    assert tables.lines_of(spark, str(tmp_path / "log.txt")).count() == 4
    export = spark.createDataFrame([("S", 4, ["Code", "Addr"]), ("S", 5, ["A", "1;2"]), ("S", 6, ["B", "2"])], "sheet string, row_no long, cells array<string>")
    assert {r["address"]: r["code"] for r in tables.export_values(export, "code", "addr").collect()} == {1: "A", 2: "B"}


@pytest.mark.parametrize("method", [candidates.bm25, candidates.tfidf])
def test_lookup_of_signals(spark, method, monkeypatch):
    """A small catalogue is looked up where the signals are, without an exchange of them, and finds what the join finds."""
    rows = [(i, [f"w{(i * k) % 11}" for k in range(1, 2 + i % 7)]) for i in range(60)] + [(100, []), (101, None), (102, ["unknown"]), (103, ["w1", "w1", "w2"])]
    signals = spark.createDataFrame(rows, "id long, terms array<string>")
    catalogue = spark.createDataFrame([(o, f"C{o // 2}", [f"w{(o + k) % 11}" for k in range(1 + o % 4)]) for o in range(20)], "ord long, code string, terms array<string>")
    found = method(signals, catalogue, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    monkeypatch.setattr(candidates, "BROADCAST_ROWS", 1)
    wanted = method(signals, catalogue, 3)
    assert [f.dataType for f in found.schema] == [f.dataType for f in wanted.schema]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_variants_are_made_in_several_tasks(spark):
    from matchloom.operators import corrupt

    pairs = spark.createDataFrame([(f"C{i}", "50 FALHA DISJUNTOR LIGADO") for i in range(40)], "code string, text string").coalesce(1)
    assert corrupt.dataset(pairs).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_facts_of_rules_are_computed_once(spark):
    """Each class of states is worked out in one place of the plan of all adjustments; before, in a dozen."""
    from matchloom.functions import tables as t
    from matchloom.operators import rules

    columns = "id long, ord long, code string, score double, text string, tokens array<string>, phase string, family string, direction string, side string, mm string, code_direction string, category string, phases string"
    rows = spark.createDataFrame([(1, 1, "DJF1", 0.5, "DISJUNTOR ABERTO", ["DISJUNTOR", "ABERTO"], None, None, "Input", None, "DIG___ABERTO@FECHADO__1", "Read", "Discrete", None)], columns)
    found = rules.adjusted(rows, each=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("StartsWith(lambda") <= 2 * len(t.STATES)
    assert "d_state" in found.columns and "__state" not in found.columns


def test_greedy_matching_broadcasts_nothing(spark):
    """However small the files of staged rows are, no join of the result holds one side on the driver."""
    rows = spark.createDataFrame([(f"i{k}", 1, k, d, f"text {k % 3}") for k, d in enumerate(["Input", "Output"] * 4)], "id string, g int, ord long, direction string, text string")
    found = resolve.pair_greedy(rows, ["g"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert found.where("partner is not null").count() == 8
