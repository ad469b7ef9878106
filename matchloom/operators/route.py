"""Decision operators: from ranked candidates to decided or to review, with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as x
from matchloom.operators.candidates import small

PCT, GAP, FLOOR, NEAR_TIE = 0.45, 0.08, 0.20, 0.005
MARGIN = 0.03


def leaders(candidates: DataFrame) -> DataFrame:
    """(id, top, second): the two best candidates of each id as structs; ties by ord, then code."""
    order = F.struct((-F.col("score")).alias("o"), "ord", "code")
    row = F.struct("code", "score", *(["delta"] if "delta" in candidates.columns else [F.lit(0.0).alias("delta")]))
    ranked = candidates.withColumn("__row", row).withColumn("__order", order)
    w = Window.partitionBy("id").orderBy("__order")
    ranked = ranked.withColumn("__n", F.row_number().over(w)).where("__n <= 2")
    return ranked.groupBy("id").agg(F.max(F.when(F.col("__n") == 1, F.col("__row"))).alias("top"), F.max(F.when(F.col("__n") == 2, F.col("__row"))).alias("second"))


def gap() -> Column:
    return F.col("top.score") - F.coalesce(F.col("second.score"), F.lit(0.0))


def quadrant(signals: DataFrame, candidates: DataFrame, pct: float = PCT, min_gap: float = GAP, floor: float = FLOOR) -> DataFrame:
    """(id, code, score, gap, status, reason) of every signal; one without candidates goes to review."""
    led = signals.select("id").join(leaders(candidates), "id", "left")
    high, wide = F.col("top.score") >= pct, gap() >= min_gap
    reason = (
        F.when(F.col("top").isNull(), "no_candidate")
        .when(F.col("top.score") - F.col("top.delta") < floor, "low_score")
        .when(high & wide, "decided").when(high, "several_codes").otherwise("low_score")
    )
    return led.select("id", "top.code", "top.score", F.when(F.col("top").isNotNull(), gap()).alias("gap"), F.when(reason == "decided", "decided").otherwise("review").alias("status"), reason.alias("reason"))


def same_description(led: DataFrame, catalogue: DataFrame, pct: float = PCT, near: float = NEAR_TIE) -> DataFrame:
    """(id, code): near ties of two codes with one description go to the smaller code."""
    texts = catalogue.groupBy("code").agg(F.min_by("text", "ord").alias("text"))
    pair = led.where((F.col("top.score") >= pct) & (gap() <= near)).select("id", F.col("top.code").alias("a"), F.col("second.code").alias("b"))
    first, second = (small(texts.select(F.col("code").alias(c), F.col("text").alias(f"text_{c}"))) for c in "ab")
    return pair.join(first, "a").join(second, "b").where("text_a = text_b").select("id", F.least("a", "b").alias("code"))


def by_rules(led: DataFrame, pct: float = PCT, min_gap: float = GAP) -> DataFrame:
    """(id, code): a narrow lead decides if the rules favour the first and not the second."""
    return led.where((F.col("top.score") >= pct) & (gap() < min_gap) & (F.col("top.delta") > 0) & (F.coalesce("second.delta", F.lit(0.0)) <= 0)).select("id", "top.code")


def votes(candidates: DataFrame, fuzzy: float = 0.95, vector: float = 0.95, consensus: bool = True) -> DataFrame:
    """(id, code, how): a sure fuzzy match, else a sure vector match, else the code that two methods or more put first."""
    w = Window.partitionBy("id", "method").orderBy(F.desc("score"), "ord", "code")
    firsts = candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    by = firsts.groupBy("id").agg(
        F.max(F.when((F.col("method") == "fuzzy") & (F.col("score") >= fuzzy), F.col("code"))).alias("fuzzy"),
        F.max(F.when((F.col("method") == "vector") & (F.col("score") >= vector), F.col("code"))).alias("vector"),
    )
    agreed = firsts.groupBy("id", "code").agg(F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("n", "code")).alias("agreed"))
    both = by.join(agreed, "id")
    last = F.when(F.lit(consensus) & (F.col("agreed.n") >= 2), F.col("agreed.code"))
    how = F.when(F.col("fuzzy").isNotNull(), "fuzzy").when(F.col("vector").isNotNull(), "vector").when(last.isNotNull(), "consensus").otherwise("none")
    return both.select("id", F.coalesce("fuzzy", "vector", last).alias("code"), how.alias("how"))


def distinctive_tokens(catalogue: DataFrame) -> DataFrame:
    """(family, code, token): tokens that one code of a family has and neither its siblings nor its bare root."""
    exploded = catalogue.where("family is not null").select("family", "code", F.explode(F.array_distinct("tokens")).alias("token"))
    root = exploded.where("code = family").select("family", "token")
    rest = exploded.where("code <> family").join(root, ["family", "token"], "left_anti")
    only = rest.groupBy("family", "token").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).where("n = 1")
    return only.select("family", "code", "token")


def sibling(decided: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``decided`` (id, code, tokens) with ``code`` replaced by the one sibling whose own token the text has; several: ``ambiguous``."""
    own = distinctive_tokens(catalogue).withColumnRenamed("code", "sibling")
    words = decided.select("id", F.col("code").alias("family"), F.explode("tokens").alias("token"))
    found = words.join(small(own), ["family", "token"]).groupBy("id").agg(F.count_distinct("sibling").alias("n"), F.min("sibling").alias("sibling"))
    out = decided.join(found, "id", "left")
    return out.select("id", F.when(F.col("n") == 1, F.col("sibling")).otherwise(F.col("code")).alias("code"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


def variant(signals: DataFrame, found: DataFrame, candidates: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(id, code, how, narrowed) of signals (id, tokens, text) with an exact anchor (found: id, code, exact) of one family.

    Of the codes of the anchor's family in the catalogue (code, family,
    code_state) the one whose state is the text's, of several the one of the
    text's stage (``state``). Several but not all stay in review with these as
    ``narrowed``. Else the anchor, if the first three of ``candidates`` (id,
    code, rank) are all of its family and it is among them (``anchor``).
    """
    families = small(catalogue.select("code", "family", "code_state"))
    exact = found.where("exact").join(families, "code").select("id", F.col("code").alias("anchor"), F.coalesce("family", "code").alias("anchor_family"))
    state = x.text_state(F.col("text"))
    stage = F.right(F.get(F.array_sort(F.filter("tokens", lambda w: w.isin(*x.t.STAGES))), F.lit(0)), F.lit(1))
    asked = exact.select("id", "anchor_family").distinct().join(signals.select("id", state.alias("state"), stage.alias("stage")), "id")
    kin = asked.join(families.select(F.col("family").alias("anchor_family"), "code", "code_state"), "anchor_family")
    fits = (F.col("code_state") == F.col("state")) & (F.col("state") != "INDEFINIDO")
    staged_fit = fits & (x.code_stage(F.col("code")) == F.col("stage"))
    by = kin.groupBy("id").agg(F.count("*").alias("n_kin"), F.collect_set(F.when(fits, F.col("code"))).alias("fit"), F.collect_set(F.when(staged_fit, F.col("code"))).alias("fit_stage"))
    chosen = F.when((F.size("fit") > 1) & (F.size("fit_stage") > 0), F.col("fit_stage")).otherwise(F.col("fit"))
    by = by.select("id", "n_kin", F.array_sort(chosen).alias("fit"))
    near = candidates.where("rank <= 3").join(families.select("code", F.coalesce("family", "code").alias("own")), "code").join(exact.groupBy("id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("anchor_family").alias("wanted")), "id")
    near = near.groupBy("id").agg(F.bool_and(F.array_contains("wanted", F.col("own"))).alias("all_in"), F.min_by(F.when(F.array_contains("anchors", F.col("code")), F.col("code")), F.when(F.array_contains("anchors", F.col("code")), F.col("rank"))).alias("anchor"))
    both = exact.select("id").distinct().join(by, "id", "left").join(near, "id", "left")
    n = F.coalesce(F.size("fit"), F.lit(0))
    narrowed = (n > 1) & (n < F.col("n_kin"))
    how = F.when(n == 1, "state").when(F.coalesce(narrowed, F.lit(False)), "review").when(F.coalesce("all_in", F.lit(False)) & F.col("anchor").isNotNull(), "anchor").otherwise("review")
    return both.select("id", F.when(how == "state", F.get("fit", F.lit(0))).when(how == "anchor", F.col("anchor")).alias("code"), how.alias("how"), F.when(narrowed, F.col("fit")).alias("narrowed"))


def dual(outcomes: DataFrame, affinity: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One row of each id from the two passes (id, bundle a or b, code, gap, status, allowed).

    One allowed decision stands alone; of two, the clearly larger gap, else the
    larger affinity (id, a, b). A forbidden decision beside an allowed one is
    ``category_ambiguous``, alone it is ``category_conflict``.
    """
    pick = lambda b, c: F.max(F.when(F.col("bundle") == b, F.col(c)))
    ok = (F.col("status") == "decided") & F.col("allowed")
    wide = outcomes.withColumn("__ok", ok).withColumn("__no", (F.col("status") == "decided") & ~F.col("allowed")).groupBy("id").agg(
        *(pick(b, c).alias(f"{b}_{c}") for b in "ab" for c in ("code", "gap", "__ok")), F.bool_or("__no").alias("forbidden")
    ).join(affinity, "id", "left")
    a, b = F.coalesce("a___ok", F.lit(False)), F.coalesce("b___ok", F.lit(False))
    apart = F.col("a_gap") - F.col("b_gap")
    tie = F.when(F.abs(apart) > margin, F.when(apart > 0, "a").otherwise("b")).when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b")
    winner = F.when(a & b, tie).when(a & ~F.col("forbidden"), "a").when(b & ~F.col("forbidden"), "b")
    reason = F.when(winner.isNotNull(), "decided").when((a & b) | ((a | b) & F.col("forbidden")), "category_ambiguous").when(F.col("forbidden"), "category_conflict").otherwise("low_score")
    return wide.select("id", F.when(winner == "a", F.col("a_code")).when(winner == "b", F.col("b_code")).alias("code"), winner.alias("bundle"), reason.alias("reason"))


def policy(decided: DataFrame, reviewed_codes: tuple[str, ...] = ()) -> DataFrame:
    """(id, status, reason) after the decision: codes under review, undefined modules and missing addresses are never decided."""
    reason = (
        F.when(F.col("code").isin(*reviewed_codes), "project_decision").when(F.col("module").isNull(), "module_undefined")
        .when(F.size("indices") <= 0, "no_address").otherwise(F.col("reason"))
    )
    return decided.select("id", F.when((F.col("status") == "decided") & (reason == F.col("reason")), "decided").otherwise("review").alias("status"), reason.alias("reason"))
