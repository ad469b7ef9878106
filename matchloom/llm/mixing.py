"""Mixing documents to target weights of their sources, by entropy balancing. DataFrame functions only.

1. Documents shrink to groups of equal key, source and size, and these to cells of equal source and size with a number of documents.
2. Targets: sources share all words by weight; those that would take more than ``MOST`` times their words give the rest back.
3. Of all rates that meet a source's target, those of the least divergence from one copy each are
   ``exp(tilt * size / mean size)``, at most ``MOST``. The dual is convex in the tilt: Newton steps on the logarithm
   of the words taken, within a bracket, one aggregation over the cells a round for all sources together.
4. Rates become whole copies: cumulative rounding over the sizes of a source, then the words that are left over or lacking are
   made up by copies of the size that leaves the least, until none leaves less.
5. A cell's copies go to its documents in the order of a hash of their key. Cells with a large share of all documents are dealt to slots.

All sums that decide are of whole numbers or decimals, so that reruns agree whatever the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.session import staged

#: Copies of a document at most.
MOST = 3

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)

WORD = r"[^\x20\x09-\x0D]+"

#: Newton steps end where the words taken differ from the target by less than this share; the bracket halves at worst, so that rounds are bounded.
TOLERANCE, ROUNDS = 1e-9, 200

#: A cell with more than this share of all documents, and ``SLOT_ROWS``, is dealt to slots of about that size.
SLOTS, SLOT_ROWS = 4096, 100_000


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, size, m): the documents of equal key, source and number of words, with how many they are."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"))
    return staged(slim.groupBy("key", "source", "size").agg(F.count("*").alias("m")), "mix-documents")


def numbered(rows: DataFrame, by: Column) -> DataFrame:
    """``rows`` with ``place`` from 0 in the order ``by``: ranges are sorted on their own, and each starts after the rows of those before it."""
    ranges = staged(rows.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "mix-ranges")
    n, starts = 0, {}
    for r in sorted(ranges.groupBy("part").count().collect()):  # one row for each range
        starts[r["part"]] = n
        n += r["count"]
    before = F.get(F.lit([starts.get(k, 0) for k in range(max(starts, default=0) + 1)]).cast("array<long>"), F.col("part"))
    return ranges.withColumn("place", before + F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1).drop("part")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, ..) with ``target``: a level times the weight of the source, or ``most`` times its size if that is less."""
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int")).cast("double")
    known = staged(numbered(sources, F.asc_nulls_last("source")).withColumn("weight", weight).drop("place"), "mix-sources")
    total, level, before = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1.0
    capped = lambda at: F.col("weight") * at >= most * F.col("source_size")
    while level > before:  # it only rises, and stays once no other source is full
        full = capped(level) if before >= 0 else F.lit(False)
        taken, open_weight = known.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, max(level, (total - (taken or 0)) / open_weight) if open_weight else level
        if before == 0.0 and level == 0.0:
            break
    return known.withColumn("target", F.when(capped(level), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level))


def _same_source(a: DataFrame, b: DataFrame, more: list[str] = []) -> Column:  # noqa: B006
    on = a["source"].eqNullSafe(b["source"])
    for name in more:
        on &= a[name] == b[name]
    return on


def _joined(left: DataFrame, right: DataFrame, more: list[str] = [], how: str = "inner") -> DataFrame:  # noqa: B006
    """Joined by source, null included, and the columns ``more``."""
    both = left.join(right, _same_source(left, right, more), how)
    for name in ["source", *more]:
        both = both.drop(right[name])
    return both


def tilts(cells: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, mean, tilt): rates ``least(most, exp(tilt * size / mean))`` take each source's target. Newton steps within brackets that hold the root."""
    spread = cells.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("low"))
    state = _joined(sources.where("source_size > 0").select("source", "source_size", "target"), spread)
    least = F.col("low") / F.col("mean")
    more = F.col("target") >= F.col("source_size")
    state = state.withColumn("lo", F.when(more, 0.0).otherwise(F.log(F.col("target") / F.col("source_size")) / least))
    state = state.withColumn("hi", F.when(more, F.log(F.lit(float(most))) / least).otherwise(0.0))
    full = F.col("target") >= most * F.col("source_size")
    state = state.withColumn("tilt", F.when(full, F.col("hi")).otherwise(0.0)).withColumn("open", ~full).select("source", "mean", "target", "lo", "hi", "tilt", "open")
    state = staged(state, "mix-tilts")
    for _ in range(ROUNDS):
        if state.where("open").isEmpty():
            break
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.col("tilt") * z)
        words = F.col("n") * F.col("size")
        met = _joined(cells.where("size > 0"), state.where("open").select("source", "mean", "tilt"))
        met = met.groupBy("source").agg(
            F.sum((words * F.least(F.lit(float(most)), rate)).cast("decimal(38,9)")).cast("double").alias("got"),
            F.sum(F.when(rate < most, words * z * rate).otherwise(0.0).cast("decimal(38,9)")).cast("double").alias("slope"),
        )
        both = _joined(state, met, how="left")
        over = F.col("got") > F.col("target")
        both = both.withColumn("hi", F.when(over, F.col("tilt")).otherwise(F.col("hi"))).withColumn("lo", F.when(over, F.col("lo")).otherwise(F.when(F.col("got").isNull(), F.col("lo")).otherwise(F.col("tilt"))))
        newton = F.col("tilt") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        near = (F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-15 * F.greatest(F.abs("lo"), F.abs("hi")))
        step = F.when(~F.col("open") | near, F.col("tilt")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = staged(both.withColumn("next", step).withColumn("open", F.col("open") & ~near).drop("tilt", "got", "slope").withColumnRenamed("next", "tilt").select(state.columns), "mix-tilts")
    return state.select("source", "mean", "tilt")


def _whole(cells: DataFrame, most: int) -> DataFrame:
    """``cells`` with ``copies``, whole numbers near ``n * rate`` that meet the targets as nearly as their sizes allow."""
    order = Window.partitionBy("source").orderBy(F.desc("size"))  # the different sizes of a source
    upto = F.sum((F.col("n") * F.col("rate")).cast("decimal(38,9)")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumn("upto", F.floor(upto + F.lit(0.5).cast("decimal(2,1)")).cast("long"))
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0))
    cells = staged(cells.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), most * F.col("n"))).drop("upto"), "mix-cells")
    while True:
        lack = cells.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("lack")).where(F.abs("lack") >= 1)
        room = F.when(F.col("lack") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        add = F.least(room, F.greatest(F.lit(1), F.floor(F.abs("lack") / F.col("size")).cast("long")))
        rest = F.abs(F.abs("lack") - add * F.col("size"))
        fits = _joined(cells.where("size > 0"), lack).where(room > 0).withColumn("rest", rest).where(F.col("rest") < 0.9 * F.abs("lack"))
        turn = fits.groupBy("source").agg(F.min(F.struct("rest", "size", (F.signum("lack") * add).cast("long").alias("add"))).alias("turn"))
        turn = staged(turn.select("source", "turn.size", "turn.add"), "mix-turns")
        if turn.isEmpty():  # each turn leaves nine tenths of the lack at most
            return cells
        cells = staged(_joined(cells, turn, ["size"], "left").withColumn("copies", F.col("copies") + F.coalesce("add", F.lit(0))).drop("add"), "mix-cells")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies, taken): how many copies of each row of ``docs`` the mix takes.

    Sources in code point order, null last, have the weights in turn and share as many words as there are; none takes more than ``most`` times
    its own. Words are parted by ASCII white space. ``taken`` is ``copies * size``.

    Defined results: null and empty texts have size 0 and are taken once, which adds no words; rows that are equal in key, source and size are
    told apart by nothing, so any of them may have the copy that is over; an empty table gives an empty one; a null key is a key.
    Columns beside the three named are not read, whatever their names.
    """
    groups = sized(docs, key, text, source)
    cells = staged(groups.groupBy("source", "size").agg(F.sum("m").alias("n")), "mix-sizes")
    sources = staged(with_targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "mix-targets")
    tilt = tilts(cells, sources, most)
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.round(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))), 9))
    known = _joined(_joined(cells, sources.select("source", "source_size", "target")), tilt, how="left").withColumn("rate", F.coalesce(rate, F.lit(1.0))).drop("mean", "tilt")
    whole = _whole(known, most)

    # slots: only the largest cells have more than one; there are at most SLOTS of them
    limit = max(cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // SLOTS, SLOT_ROWS)
    large = F.broadcast(cells.where(F.col("n") > limit).select(F.xxhash64("source", "size").alias("cell"), F.ceil(F.col("n") / limit).alias("slots")).groupBy("cell").agg(F.max("slots").alias("slots")))
    dealt = groups.withColumn("cell", F.xxhash64("source", "size")).join(large, "cell", "left")
    dealt = dealt.withColumn("slot", F.coalesce(F.pmod(F.xxhash64("key"), F.col("slots")), F.lit(0))).drop("cell", "slots")
    slots = dealt.groupBy("source", "size", "slot").agg(F.sum("m").alias("own"))
    before = F.sum("own").over(Window.partitionBy("source", "size").orderBy("slot")) - F.col("own")
    slots = _joined(slots.withColumn("before", before), whole, ["size"])
    slots = slots.withColumn("base", F.floor(F.col("copies") / F.col("n"))).withColumn("over", F.col("copies") - F.col("base") * F.col("n") - F.col("before"))
    slots = slots.select("source", "size", "slot", "source_size", "target", "rate", "base", "over")
    chosen = _joined(dealt, slots, ["size", "slot"])
    upto = F.sum("m").over(Window.partitionBy("source", "size", "slot").orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = chosen.withColumn("more", F.greatest(F.lit(0), F.least(F.col("m"), F.col("over") - (upto - F.col("m")))))
    # equal rows again, by the thousand at most in one array
    step = 1000
    chosen = chosen.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(step).cast("long"))))
    chosen = chosen.withColumn("i", F.explode(F.sequence(F.col("chunk"), F.least(F.col("m"), F.col("chunk") + step) - 1)))
    copies = F.col("base") + (F.col("i") < F.col("more")).cast("long")
    return chosen.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of the mix: each of ``docs`` as often as ``plan`` says. Keys must be unique and not null."""
    name = "__copies_of_plan"
    of_plan = plan.select(F.col(f"`{key}`"), F.col("copies").alias(name)).where(F.col(name) > 0)
    return docs.join(of_plan, key).select(*(docs[f"`{c}`"] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(name))).alias("copy"))
