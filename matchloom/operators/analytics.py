"""Evaluation, calibration quality, histograms and mining of catalogues."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import tables as t
from matchloom.functions import text as x
from matchloom.functions.similarity import indel_ratio
from matchloom.operators.candidates import small
from matchloom.session import staged

#: Ranges of x into which points are dealt before their frontier is sought.
RANGES = 200


def decision_summary(routed: DataFrame) -> DataFrame:
    n, d = F.count("*"), F.count_if(F.col("status") == "decided")
    return routed.agg(n.alias("total"), d.alias("decided"), (n - d).alias("review"), F.round(100.0 * F.try_divide(d, n), 1).alias("rate"))


def reasons(routed: DataFrame) -> DataFrame:
    return routed.where("status <> 'decided'").groupBy("reason").agg(F.count("*").alias("n"))


def first_of_each(key: str, *frames: DataFrame) -> DataFrame:
    """The union of frames, the first frame's row of each key."""
    union = frames[0].withColumn("__f", F.lit(0))
    for n, f in enumerate(frames[1:], 1):
        union = union.unionByName(f.withColumn("__f", F.lit(n)))
    return union.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__f"))).where("__n = 1").drop("__n", "__f")


def band(score: Column) -> Column:
    return F.when(score >= 0.70, "high").when(score >= 0.45, "middle").otherwise("low")


def accuracy(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Accuracy at 1, recall at 3, decided share and precision of the decided; ranked (id, code, rank), expected (id, code, decided).

    A row of ``expected`` with ``n`` stands for so many rows of its id and code.
    """
    wanted = expected.withColumnRenamed("code", "wanted")
    keys = ["id", "wanted", "decided", "n"] if "n" in expected.columns else ["id", "decided"]
    hits = wanted.join(ranked, "id", "left").groupBy(*keys).agg(
        F.bool_or((F.col("rank") == 1) & (F.col("code") == F.col("wanted"))).alias("first"), F.bool_or((F.col("rank") <= 3) & (F.col("code") == F.col("wanted"))).alias("three")
    )
    n = F.col("n") if "n" in expected.columns else F.lit(1)
    share = lambda c, of=n: F.sum(F.coalesce(c, F.lit(False)).cast("double") * of) / F.sum(of)
    return hits.agg(share(F.col("first")).alias("acc_1"), share(F.col("three")).alias("recall_3"), share(F.col("decided")).alias("decided"), share(F.col("first"), F.when(F.col("decided"), n)).alias("precision"))


def threshold_sweep(scored: DataFrame, pcts: list[float], gaps: list[float]) -> DataFrame:
    """(t_pct, t_gap, category or null for all, n, decided, precision) over a grid; scored (category, top, gap, correct).

    Rows are counted once, by how many thresholds of either kind they reach; the grid is summed from these counts, so its size does not matter to the pass over the rows.
    """
    spark = scored.sparkSession
    pcts, gaps = sorted(set(pcts)), sorted(set(gaps))
    reached = lambda column, limits: sum((F.coalesce(F.col(column) >= v, F.lit(False)).cast("int") for v in limits), F.lit(0))
    counted = scored.groupBy("category", reached("top", pcts).alias("i"), reached("gap", gaps).alias("j")).agg(F.count("*").alias("n"), F.count_if("correct").alias("good"))
    counted = staged(counted, "sweep-counts")
    sets = lambda rows, *keys: rows.groupingSets([[*keys, F.col("category")], [*keys]], *keys, "category")
    steps = counted.withColumn("p", F.explode(F.sequence(F.lit(1), F.greatest("i", F.lit(1))))).withColumn("q", F.explode(F.sequence(F.lit(1), F.greatest("j", F.lit(1))))).where("p <= i and q <= j")
    held = sets(steps, F.col("p"), F.col("q")).agg(F.sum("n").alias("decided"), F.sum("good").alias("good"), F.grouping("category").alias("every"))
    total = sets(counted).agg(F.sum("n").alias("n"), F.grouping("category").alias("every"))
    grid = spark.createDataFrame([(i, j, p, g) for i, p in enumerate(pcts, 1) for j, g in enumerate(gaps, 1)], "p int, q int, t_pct double, t_gap double")
    asked = total.crossJoin(F.broadcast(grid))  # one row for each category and place of the given grid
    both = asked.join(held, (asked["p"] == held["p"]) & (asked["q"] == held["q"]) & asked["category"].eqNullSafe(held["category"]) & (asked["every"] == held["every"]), "left")
    decided = F.coalesce(held["decided"], F.lit(0))
    return both.select("t_pct", "t_gap", asked["category"], asked["n"], decided.alias("decided"), F.try_divide(held["good"], held["decided"]).alias("precision"))


def weight_simplex(step: int = 20) -> list[tuple[float, float, float]]:
    """All weight triples in steps of 1/step that add to 1."""
    return [(a / step, b / step, (step - a - b) / step) for a in range(step + 1) for b in range(step + 1 - a)]


#: Cells of scores that one step of the simplex search holds.
CELLS = 250_000


def _rounded(score: np.ndarray) -> np.ndarray:
    """``score`` in billionths, rounded as SQL rounds 9 digits, half away from zero; from a million on as it is."""
    with np.errstate(invalid="ignore", over="ignore"):
        y = score * 1e9
        size = np.abs(y)
        out = np.where(size < 1e15, np.copysign(np.floor(size + 0.5), y), y)
        for at in np.argwhere((size < 1e15) & (np.abs(size - np.floor(size) - 0.5) < 1e-6 + 4e-16 * size)):  # near a half the digits decide
            out[tuple(at)] = float(Decimal(repr(float(score[tuple(at)]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(out), -np.inf, out)


def _wins(side: np.ndarray, s: np.ndarray, of: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each triple the number of ids (``of``, ascending) whose wanted code (``side`` 0) is ahead of the codes before (-1) and after it (1); each id has both kinds."""
    score = _rounded(s[:, :1] * weights[:, 0] + s[:, 1:2] * weights[:, 1] + s[:, 2:] * weights[:, 2])
    starts = lambda ids: np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    own, rival = side == 0, side != 0
    best = np.maximum.reduceat(score[own], starts(of[own]), axis=0)
    _, at = np.unique(of[rival], return_inverse=True)
    held, against = best[at], score[rival]
    ahead = np.where((side[rival] < 0)[:, None], held > against, held >= against)
    return np.logical_and.reduceat(ahead, starts(of[rival]), axis=0).sum(axis=0)


def _hits(triples: list[tuple[float, float, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(triples, dtype=float)
        step = max(1, CELLS // max(1, len(triples)))
        hits, n, any_rows = np.zeros(len(triples), dtype=np.int64), 0, False
        for batch in batches:
            any_rows |= batch.num_rows > 0
            offered = batch.column(0).drop_null()
            n += len(offered)
            flat = offered.flatten()
            if not len(flat):
                continue
            of = np.repeat(np.arange(len(offered)), offered.value_lengths().to_numpy(zero_copy_only=False))
            side, *s = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
            s = np.stack([c.astype(float) for c in s], axis=1)
            has, rivals = (np.bincount(of, weights=w, minlength=len(offered)) > 0 for w in (side == 0, side != 0))
            hits += int((has & ~rivals).sum())
            due = (has & rivals)[of]
            side, s, of = side[due], s[due], of[due]
            begin = 0
            while begin < len(of):
                end = int(np.searchsorted(of, of[min(begin + step, len(of)) - 1], side="right"))  # an id stays whole
                hits += _wins(side[begin:end], s[begin:end], of[begin:end], weights)
                begin = end
        if any_rows:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(triples)), pa.int32()), "hits": pa.array(hits), "n": pa.array([n] * len(triples), pa.int64())})

    return count


def simplex_search(candidates: DataFrame, expected: DataFrame, triples: list[tuple[float, float, float]]) -> DataFrame:
    """(a, b, c, accuracy): the share of ids whose best weighted code is the expected one; candidates (id, code, s1, s2, s3), a few for each id.

    All triples are tried where the codes of an id meet, and only where the expected code has rivals; what leaves a task is one count for each triple.

    Defined results: a code without a score comes last, a null code behind its equals; ids whose expected code is null are not counted.
    """
    grid = candidates.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(triples)], "at int, a double, b double, c double")
    offered = candidates.groupBy("id").agg(F.collect_list(F.struct("code", *(F.col(c).cast("double").alias(c) for c in ("s1", "s2", "s3")))).alias("offered"))
    asked = offered.join(expected.select("id", F.col("code").alias("wanted")), "id")
    side = lambda code: F.when(code < F.col("wanted"), -1).when(code == F.col("wanted"), 0).otherwise(1)
    placed = F.transform("offered", lambda o: F.struct(side(o["code"]).alias("side"), o["s1"].alias("s1"), o["s2"].alias("s2"), o["s3"].alias("s3")))
    counted = asked.select(F.when(F.col("wanted").isNotNull(), placed).alias("offered")).mapInArrow(_hits(triples), "at int, hits long, n long")
    return counted.groupBy("at").agg(F.try_divide(F.sum("hits"), F.sum("n")).alias("accuracy")).join(F.broadcast(grid), "at").select("a", "b", "c", "accuracy")


def pareto(points: DataFrame, x: str, y: str, ranges: int = RANGES) -> DataFrame:
    """Points that no other point beats in both; equal points all stay.

    Points are dealt into ranges of ``x``. A point stands if its ``y`` exceeds
    that of all points of a larger ``x`` in its range, and the most of all
    ranges beyond; only these maxima, one for each range, come together.
    """
    by_x = points.groupBy(x).agg(F.max(y).alias("__y"))
    cuts = by_x.agg(F.percentile_approx(x, [k / ranges for k in range(1, ranges)], 10_000).alias("c")).first()["c"] or []  # as many numbers as ranges
    place = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(x))) if cuts else F.lit(0)
    dealt = by_x.withColumn("__range", place)
    most = {r["__range"]: r["m"] for r in dealt.groupBy("__range").agg(F.max("__y").alias("m")).collect()}
    beyond, above = {}, None
    for k in sorted(most, reverse=True):
        beyond[k] = above
        above = most[k] if above is None else max(above, most[k])
    chain = F.when(F.lit(False), F.col("__y"))
    for k, m in beyond.items():
        chain = chain.when(F.col("__range") == k, F.lit(m))
    before = F.greatest(F.max("__y").over(Window.partitionBy("__range").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)), chain)
    keep = dealt.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__y") > F.col("__before"))).select(F.col(x).alias("__x"), "__y")
    return points.join(keep, (points[x] == F.col("__x")) & (points[y] == F.col("__y"))).select(points["*"])


def compare(ours: DataFrame, gold: DataFrame, keys: list[str], value: str = "code") -> DataFrame:
    """One row: common keys, equal values, percentage."""
    both = ours.select(*keys, F.col(value).alias("__a")).join(gold.select(*keys, F.col(value).alias("__b")), keys)
    equal = F.count_if(F.col("__a") == F.col("__b"))
    return both.agg(F.count("*").alias("common"), equal.alias("equal"), F.round(100.0 * F.try_divide(equal, F.count("*")), 1).alias("pct"))


def locked(cases: DataFrame, ours: DataFrame, keys: list[str]) -> DataFrame:
    """``cases`` (keys, expected) with ``code`` and ``passed``."""
    return cases.join(ours.select(*keys, "code"), keys, "left").withColumn("passed", F.coalesce(F.col("code") == F.col("expected"), F.lit(False)))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy); scored (score, correct)."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def divergences(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str = "code") -> DataFrame:
    """(*keys, ours, theirs): the keys that both have with different values; a missing value differs from any other."""
    both = ours.select(*keys, F.col(value).alias("ours")).join(theirs.select(*keys, F.col(value).alias("theirs")), keys)
    return both.where(~F.col("ours").eqNullSafe(F.col("theirs")))


def tie_taxonomy(rows: DataFrame, close: float, digits: int = 3) -> DataFrame:
    """(kind, n, mean_gap): why the two best candidates of rows (gap, first, second, first_text, second_text) are close.

    ``clear`` is a gap of ``close`` or more; else two codes of one description, of one family (the same leading number) or of others; ``alone`` has no second.
    """
    family = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{2})", 1)
    kind = (
        F.when(F.col("second").isNull(), "alone")
        .when(F.col("gap") >= close, "clear")
        .when(F.col("first_text").eqNullSafe(F.col("second_text")), "same_description")
        .when((family(F.col("first")) != "") & (family(F.col("first")) == family(F.col("second"))), "same_family")
        .otherwise("other_family")
    )
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("gap"), digits).alias("mean_gap"))


def gap_histogram(rows: DataFrame, digits: int = 3) -> DataFrame:
    """(gap, n, same): rounded gaps, and how many have the same description twice; rows (gap, same)."""
    return rows.groupBy(F.round("gap", digits).alias("gap")).agg(F.count("*").alias("n"), F.count_if("same").alias("same"))


def confusion(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(real, ours, n); keys that ours lacks count as null."""
    return left.select(*keys, F.col(value).alias("real")).join(right.select(*keys, F.col(value).alias("ours")), keys, "left").groupBy("real", "ours").agg(F.count("*").alias("n"))


def clean_base(pairs: DataFrame, shape: str, codes: DataFrame) -> DataFrame:
    """(alias, code): well-shaped aliases of known codes, each once, without aliases of several codes."""
    good = pairs.where(F.col("alias").isNotNull() & (F.trim("alias") != "") & F.col("alias").rlike(shape)).select("alias", "code").distinct()
    one = good.groupBy("alias").agg(F.count_distinct("code").alias("n")).where("n = 1").select("alias")
    return good.join(one, "alias", "left_semi").join(codes.select("code"), "code", "left_semi")


def ground_truth(first: DataFrame, second: DataFrame, canonical: DataFrame) -> DataFrame:
    """(text, code) of two sources without the catalogue's own texts and without ambiguous texts."""
    both = first.select("text", "code").union(second.select("text", "code")).distinct().join(canonical.select("text").distinct(), "text", "left_anti")
    return both.groupBy("text").agg(F.min("code").alias("code"), F.count_distinct("code").alias("n")).where("n = 1").drop("n")


def share_rules(rows: DataFrame, group: str, flag: Column, share: float = 0.9, least: int = 20) -> DataFrame:
    """(group, n, share): groups in which the flag holds nearly always."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("share")).where((F.col("n") >= least) & (F.col("share") >= share))


def variants(texts: DataFrame, catalogue: DataFrame, least: int = 2, least_share: float = 0.05) -> DataFrame:
    """(code, token, n, share): new tokens of a code's texts that no other code's description has, unless both rare in number and share."""
    words = texts.select("id", "code", F.explode(F.array_distinct("tokens")).alias("token"))
    size = texts.groupBy("code").agg(F.count_distinct("id").alias("n_texts"))
    own = catalogue.select("code", F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    holders = own.groupBy("token").agg(F.collect_set("code").alias("codes"))
    found = words.groupBy("code", "token").agg(F.count_distinct("id").alias("n")).join(size, "code").withColumn("share", F.col("n") / F.col("n_texts"))
    kept = found.join(own, ["code", "token"], "left_anti").join(holders, "token", "left")
    return kept.where(F.col("codes").isNull() & ((F.col("n") >= least) | (F.col("share") >= least_share))).select("code", "token", "n", "share")


def nearest_codes(unknown: DataFrame, codes: DataFrame, minimum: float = 85.0) -> DataFrame:
    """(code, n, example, nearest): unknown codes with their count, first example and the most similar known code.

    A ratio of ``minimum`` bounds both the lengths and the Levenshtein distance
    of sorted tokens, so only codes of fitting lengths meet.
    """
    counted = unknown.groupBy("code").agg(F.count("*").alias("n"), F.min_by("text", "ord").alias("example"))
    form = lambda c: F.array_join(F.array_sort(x.tokens(F.col(c))), " ")
    share = minimum / (200.0 - minimum)
    asked = counted.select("code", form("code").alias("a")).withColumn("size", F.explode(F.sequence(F.ceil(F.length("a") * share).cast("int"), F.floor(F.length("a") / share).cast("int"))))
    known = codes.select(F.col("code").alias("known")).distinct().withColumn("b", form("known")).withColumn("size", F.length("b"))
    bound = (100 - minimum) * (F.length("a") + F.length("b")) + 1e-6
    near = asked.join(known, "size").where(100 * F.levenshtein("a", "b") <= bound).withColumn("s", indel_ratio("a", "b"))
    best = near.where(F.col("s") >= minimum).groupBy("code").agg(F.min_by("known", F.struct(-F.col("s"), F.col("known"))).alias("nearest"))
    return counted.join(best, "code", "left")


def wide_top(signals: DataFrame, ranked: DataFrame, k: int = 3) -> DataFrame:
    """One row of each id: code_1, score_1 to code_k, score_k of its best candidates."""
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    columns = [c for n in range(1, k + 1) for c in (at(n, "code").alias(f"code_{n}"), F.round(at(n, "score"), 3).alias(f"score_{n}"))]
    return signals.join(ranked.groupBy("id").agg(*columns), "id", "left")


# --- diagnosis --------------------------------------------------------------------------------------------


def command_buckets(decided: DataFrame, write_codes: tuple[str, ...]) -> DataFrame:
    """(bucket, n) of decided rows that are commands: paired, a legitimate write, or escaped."""
    bucket = F.when(F.col("direction") == "InputOutput", "paired").when(F.upper("code").isin(*write_codes), "legitimate_write").otherwise("escaped")
    return decided.where(F.col("direction").isin("Output", "InputOutput")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def child_for_parent(divergences: DataFrame, codes: DataFrame) -> DataFrame:
    """(parent, n, children): where ours is a code of the catalogue and the real one (ours, real) begins with it."""
    known = small(codes.select(F.upper("code").alias("parent")).distinct())
    pairs = divergences.select(F.upper("ours").alias("parent"), F.upper("real").alias("child")).join(known, "parent", "left_semi")
    kin = pairs.where(F.startswith("child", "parent") & (F.col("child") != F.col("parent")))
    return kin.groupBy("parent").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("child")).alias("children"))


def anchor_diagnosis(reviewed: DataFrame, found: DataFrame, candidates: DataFrame, families: DataFrame) -> DataFrame:
    """(id, tags) of reviewed signals (id, low) that name a code: below the floor, the anchor or its whole family is not among the best three, siblings are."""
    kin = small(families.select("code", F.coalesce("family", "code").alias("family")))
    named = found.join(kin, "code").groupBy("id").agg(F.collect_set("code").alias("anchors"), F.collect_set("family").alias("families"))
    top = candidates.where("rank <= 3").select("id", "code").join(kin, "code").join(named, "id")
    by = top.groupBy("id").agg(F.bool_or(F.array_contains("anchors", F.col("code"))).alias("has"), F.count_distinct(F.when(F.array_contains("families", F.col("family")), F.col("code"))).alias("kin"))
    rows = reviewed.join(named.select("id"), "id").join(by, "id", "left").withColumns({"has": F.coalesce("has", F.lit(False)), "kin": F.coalesce("kin", F.lit(0))})
    gone = ~F.col("has")
    tags = F.array_compact(F.array(
        F.when(F.col("low"), "below_floor"), F.when(gone, "anchor_absent"), F.when(gone & (F.col("kin") == 0), "family_absent"), F.when(gone & (F.col("kin") == 1), "family_partial"), F.when(F.col("kin") >= 2, "siblings")
    ))
    return rows.select("id", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("other"))).alias("tags"))


def family_partition(catalogue: DataFrame) -> DataFrame:
    """(family, state, codes) of families with two variants or more besides the bare root; a state that isolates one code decides alone."""
    kin = catalogue.where(F.col("family").isNotNull() & (F.col("code") != F.col("family")))
    several = kin.groupBy("family").agg(F.count_distinct("code").alias("n")).where("n >= 2").select("family")
    return kin.join(small(several), "family").groupBy("family", F.coalesce("code_state", F.lit("none")).alias("state")).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def lexicon_hits(texts: DataFrame) -> DataFrame:
    """(entry, token, n): which tokens of a corpus each entry of the state lexicon takes, the first that fits."""
    counted = texts.select(F.explode(x.tokens(F.upper("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    chain = F.when(F.lit(False), "")
    for word in t.STATE_TOKENS:
        chain = chain.when(F.col("token") == word, f"[exact] {word}")
    for prefix, _, _ in t.STATES:
        chain = chain.when(F.startswith("token", F.lit(prefix)), prefix)
    return counted.withColumn("entry", chain).where("entry is not null").select("entry", "token", "n")


def qualifier_taxonomy(ties: DataFrame, tags: dict[str, str]) -> DataFrame:
    """(id, category) of ties (id, text, first, second, first_text, second_text): the tags of the text that tell the two codes apart."""
    found = lambda c: F.array_compact(F.array(*(F.when(F.col(c).rlike(p), F.lit(n)) for n, p in tags.items())))
    a, b = found("first_text"), found("second_text")
    apart = F.array_sort(F.array_intersect(found("text"), F.array_union(F.array_except(a, b), F.array_except(b, a))))
    same = F.coalesce(x.leading_number(F.upper("first")) == x.leading_number(F.upper("second")), F.lit(False))
    return ties.select("id", F.when(~same, "other_family").when(F.size(apart) > 0, F.array_join(apart, ",")).otherwise("same_family_without_qualifier").alias("category"))


def catalogue_probe(signals: DataFrame, extra: DataFrame, minimum: float = 90.0) -> DataFrame:
    """(id, code, how): codes of another catalogue (code, text) that a token spells, or whose description is more than ``minimum`` like the text."""
    cat = extra.select(F.upper("code").alias("code"), F.upper("text").alias("known"))
    exact = signals.select("id", F.explode(x.tokens(F.upper("text"))).alias("code")).join(small(cat.select("code").distinct()), "code").select("id", "code").distinct()
    form = lambda c: F.array_join(F.array_sort(x.tokens(c)), " ")
    share = minimum / (200.0 - minimum)
    texts = signals.select(F.upper("text").alias("said")).distinct().withColumn("a", form(F.col("said"))).where(F.length("a") > 0)
    sized = texts.withColumn("size", F.explode(F.sequence(F.ceil(F.length("a") * share).cast("int"), F.floor(F.length("a") / share).cast("int"))))
    known = cat.where(F.length("known") > 0).withColumn("b", form(F.col("known"))).withColumn("size", F.length("b"))
    near = sized.join(small(known), "size").where(100 * F.levenshtein("a", "b") <= (100 - minimum) * (F.length("a") + F.length("b")) + 1e-6)
    like = near.where(indel_ratio("a", "b") > minimum).select("said", "code").distinct()
    fuzzy = signals.select("id", F.upper("text").alias("said")).join(like, "said").select("id", "code").join(exact, ["id", "code"], "left_anti")
    return exact.withColumn("how", F.lit("exact")).unionByName(fuzzy.withColumn("how", F.lit("text")))


def domain_differences(ours: DataFrame, theirs: DataFrame, mapped: list[str], value: str = "value") -> DataFrame:
    """(value, where): values that only we use, that only the domain has, and that our map gives though the domain lacks them."""
    a, b = ours.select(value).distinct(), theirs.select(value).distinct()
    given = ours.sparkSession.createDataFrame([(m,) for m in sorted(set(mapped))], f"{value} string")
    parts = [a.subtract(b).withColumn("where", F.lit("only_ours")), b.subtract(a).withColumn("where", F.lit("only_domain")), given.subtract(b).withColumn("where", F.lit("mapped_outside"))]
    return reduce(lambda p, q: p.unionByName(q), parts)


def population(rows: DataFrame, groups: dict[str, Column], by: str) -> DataFrame:
    """(by, population, n): each row in the first of ``groups`` whose condition holds, else in ``other``."""
    chain = F.when(F.lit(False), "")
    for name, condition in groups.items():
        chain = chain.when(condition, name)
    return rows.groupBy(by, chain.otherwise("other").alias("population")).agg(F.count("*").alias("n"))


def family_report(catalogue: DataFrame) -> DataFrame:
    """(family, n, share): codes by their protection number, else by their first two letters, else together."""
    up = F.upper("code")
    letters = F.substring(F.regexp_extract(up, r"^(\p{L}+)", 1), 1, 2)
    family = F.coalesce(x.leading_number(up), F.when(letters != "", F.concat(F.lit("ALPHA_"), letters)), F.lit("OTHER"))
    counted = catalogue.groupBy(family.alias("family")).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(catalogue.agg(F.count("*").alias("of")))).select("family", "n", (F.col("n") / F.col("of")).alias("share"))  # one row


def enriched(catalogue: DataFrame, numbers: dict[str, str], quantities: dict[str, str], terms: dict[str, str]) -> DataFrame:
    """``catalogue`` (code, text, category) with ``text`` extended, never rewritten: several protection numbers, one, an adjustment, a quantity, a term of the code, in this order."""
    text = F.trim("text")
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d{2})[A-Z]*\b"), F.lit(1)), lambda n: n.isin(*numbers)))
    first = F.upper(F.get(x.tokens(text), F.lit(0)))
    several = F.array_join(F.transform(found, lambda n: x.lookup(n, numbers)), " + ")
    adjust = F.nullif(F.regexp_extract(text, r"^AJUSTE\s+(\S+)", 1), F.lit(""))
    more = (
        F.when(F.size(found) >= 2, several).when(F.size(found) == 1, x.lookup(F.get(found, F.lit(0)), numbers))
        .when(adjust.isNotNull(), F.concat(F.lit("GRUPO DE AJUSTE "), adjust)).when(F.col("category") == "Analog", x.lookup(first, quantities))
    )
    more = F.coalesce(more, x.lookup(F.upper(F.trim("code")), terms))
    return catalogue.withColumn("text", F.when(more.isNotNull(), F.concat("text", F.lit(" - "), more)).otherwise(F.col("text")))


def rewritten(catalogue: DataFrame, names: dict[str, str], suffixes: dict[str, str]) -> DataFrame:
    """``catalogue`` (ord, code) with ``description`` from the code's number and suffix, and ``first`` on the first row of each number."""
    base, suffix = F.regexp_extract("code", r"^(\d{2})", 1), F.regexp_extract("code", r"^\d{2}\d*(.*)$", 1)
    name = x.lookup(base, names)
    told = F.concat(base, F.lit(" - "), name, F.when(suffix != "", F.concat(F.lit(" ("), x.lookup(suffix, suffixes, suffix), F.lit(")"))).otherwise(""))
    first = catalogue.groupBy(base.alias("__base")).agg(F.min("ord").alias("__first"))  # one row for each two digits
    held = catalogue.withColumn("__base", base).join(F.broadcast(first), "__base")
    return held.withColumn("description", F.when(name.isNotNull(), told)).withColumn("first", name.isNotNull() & (F.col("ord") == F.col("__first"))).drop("__base", "__first")


def patched(catalogue: DataFrame, changes: DataFrame, added: DataFrame, field: str) -> DataFrame:
    """``catalogue`` with ``field`` replaced for the codes of ``changes`` (code, value) and the rows of ``added`` whose code is new."""
    joined = catalogue.join(small(changes.select("code", F.col("value").alias("__v"))), "code", "left")
    new = added.join(catalogue.select("code"), "code", "left_anti").select(*catalogue.columns)
    return joined.select(*(F.coalesce("__v", field).alias(field) if c == field else F.col(c) for c in catalogue.columns)).unionByName(new)


def flow_report(output: DataFrame, review: DataFrame, events: DataFrame) -> DataFrame:
    """(kind, name, n): rows in the output, in review by reason, and identity events by level."""
    parts = [output.select(F.lit("output").alias("kind"), F.lit("").alias("name")), review.select(F.lit("review"), "reason"), events.select(F.lit("identity"), "level")]
    return reduce(lambda a, b: a.union(b), parts).groupBy("kind", "name").agg(F.count("*").alias("n"))


def trace_commands(commands: DataFrame, decided: DataFrame, final: DataFrame, review: DataFrame, key: list[str]) -> DataFrame:
    """(id, destination) of every command: in a pair of the output, alone in it, in review, in a reviewed pair, lost after or before its decision.

    commands (id, address); decided (id, *key, address); final and review have
    (id, *key, direction, output_address), review also a reason.
    """
    known = commands.select("id").join(decided.select("id", *key, F.col("address").alias("at"), F.lit(True).alias("was_decided")), "id", "left")
    same = lambda other: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(other[f"__{k}"]) for k in key)) & (F.col("at") == other["__at"])
    keyed = lambda f, *more: f.select(*(F.col(k).alias(f"__{k}") for k in key), F.col("output_address").alias("__at"), *more)
    pairs = keyed(final.where("direction = 'InputOutput'")).distinct().withColumn("in_pair", F.lit(True))
    alone = final.where("direction = 'Output'").select("id", F.lit(True).alias("alone")).distinct()
    own = review.groupBy("id").agg(F.min("reason").alias("own_reason"))
    fused = keyed(review.where("output_address is not null"), "reason").groupBy(*(f"__{k}" for k in key), "__at").agg(F.min("reason").alias("pair_reason"))
    drop = [*(f"__{k}" for k in key), "__at"]
    rows = known.join(pairs, same(pairs), "left").drop(*drop).join(alone, "id", "left").join(own, "id", "left")
    rows = rows.join(fused, same(fused), "left").drop(*drop)
    where = (
        F.when(F.col("in_pair"), "output_pair").when(F.col("alone"), "output_alone").when(F.col("own_reason").isNotNull(), F.concat(F.lit("review:"), "own_reason"))
        .when(F.col("pair_reason").isNotNull(), F.concat(F.lit("review_pair:"), "pair_reason")).when(F.col("was_decided"), "lost_after_decision").otherwise("lost_before_decision")
    )
    return rows.select("id", where.alias("destination"))


def keyword_trace(signals: DataFrame, decisions: DataFrame, candidates: DataFrame, words: tuple[str, ...], k: int = 4) -> DataFrame:
    """(id, text, code, reason, top) of signals whose text holds one of ``words``; ``top`` are their ``k`` best candidates."""
    hit = reduce(lambda a, b: a | b, (F.contains(F.upper("text"), F.lit(w.upper())) for w in words))
    best = candidates.where(F.col("rank") <= k).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda c: c["code"]), ",").alias("top"))
    return signals.where(hit).select("id", "text").join(decisions.select("id", "code", "reason"), "id").join(best, "id", "left")


def two_ranks(first: DataFrame, second: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, code, first_rank, second_rank): the place of the expected code in two rankings (id, code, rank)."""
    a, b = (r.select("id", "code", F.col("rank").alias(n)) for r, n in ((first, "first_rank"), (second, "second_rank")))
    return expected.select("id", "code").join(a, ["id", "code"], "left").join(b, ["id", "code"], "left")


def function_divergence(catalogue: DataFrame) -> DataFrame:
    """Rows of the catalogue (code, states, mm) whose function and message mapping name different state classes."""
    a, b = x.function_state(F.col("states")), x.mapping_state(F.col("mm"))
    return catalogue.select("code", a.alias("function_state"), b.alias("mapping_state")).where("function_state <> mapping_state")
