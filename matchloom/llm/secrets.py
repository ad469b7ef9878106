"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is taken apart when the plan is made: its
mandatory literals give a Boolean trigram query, an OR of ANDs. The index holds
a posting (trigram, document) for each trigram that some query names. A query is
answered by intersecting postings, and its candidates are verified with the
expression itself. A rule without mandatory trigrams scans every document.

Defined results: null and empty texts have no spans; a row with a null key is
scanned like any other; rows that repeat a key get one row each. Texts of any
length are scanned whole. Offsets count code points, ends are exclusive. Added
columns replace those of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

parser = re._parser

#: A query of more alternatives than this is not worth an index.
MAX_ALTERNATIVES = 64
#: A character class of at most so many characters is spelled out in a query.
MAX_CLASS = 5


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``regex`` that do not overlap, if ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The three base rules of the contract. The lengths are in the expression where that finds the same matches.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds: private key blocks, tokens of code hosts and chat services, signed web tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _alternatives(parsed) -> list[list[str | None]]:
    """Ways to match, each as a list of literal characters and gaps (None)."""
    ways: list[list[str | None]] = [[]]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            here = [[chr(arg).lower()]]
        elif name == "SUBPATTERN":
            here = _alternatives(arg[3])
        elif name == "BRANCH":
            here = [w for branch in arg[1] for w in _alternatives(branch)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= MAX_CLASS:
            here = [[c] for c in sorted({chr(a).lower() for _, a in arg})]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            literal = all(str(o) == "LITERAL" for o, _ in inner)
            if low == 0:
                here = [[], *_alternatives(inner)] if high == 1 and literal else [[None]]
            else:
                once = _alternatives(inner)
                here = [w * min(low, 3) if literal and low == high else [*w, None] for w in once]
        elif name == "AT":
            continue
        else:
            here = [[None]]
        ways = [a + b for a in ways for b in here]
        if len(ways) > MAX_ALTERNATIVES:
            return [[None]]
    return ways


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams that every match needs; None: no trigram is mandatory."""
    found = set()
    for way in _alternatives(parser.parse(regex)):
        runs = "".join(c if c is not None else "\0" for c in way).split("\0")
        found.add(frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)))
    if frozenset() in found:
        return None
    return sorted((q for q in found if not any(p < q for p in found)), key=sorted)


def postings(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """(trigram, key) for each of ``trigrams`` that a text has, whatever the case of its letters."""
    low = docs.select(F.col(key).alias("key"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(key, kinds): the rules whose trigram query a document satisfies; None if no rule has a query."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not None}
    terms = [(kind, n, t, len(ands)) for kind, q in queries.items() for n, ands in enumerate(q) for t in sorted(ands)]
    if not terms:
        return None
    wanted = docs.sparkSession.createDataFrame(terms, "kind string, alternative int, trigram string, needed int")
    found = postings(docs, key, text, sorted({t for _, _, t, _ in terms}))
    met = found.join(F.broadcast(wanted), "trigram").groupBy("key", "kind", "alternative").agg(F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed"))  # as many terms as the rules have
    return met.where("n = needed").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans as an array of (start, order, end, kind), from the gaps between matches and their lengths."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.regex, -1)
    parts = F.arrays_zip(F.slice(F.transform(gaps, F.length), 1, F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(tested, F.length).alias("tested"))
    empty = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind_order"), (start + p["size"]).alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct((start + p["size"]).alias("at"), F.when(p["tested"] >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``docs`` with ``spans``: all matches as an array of (start, kind_order, end, kind), in order of start, then of the rules.

    An own column named ``spans`` is replaced.
    """
    empty = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")
    docs = docs.drop("spans")
    # rows are told apart by key and text: rows of a hot or a null key then go to many tasks
    docs = docs.withColumn("__row", F.xxhash64(key, text))
    found = candidates(docs, "__row", text, rules)
    if found is None:
        joined = docs.withColumn("__kinds", F.array().cast("array<string>"))
    else:
        joined = docs.join(found.select(F.col("key").alias("__row"), F.col("kinds").alias("__kinds")), "__row", "left")
    body = F.coalesce(F.col(text), F.lit(""))
    each = []
    for order, r in enumerate(rules):
        due = F.array_contains("__kinds", r.kind) if trigram_query(r.regex) is not None else body.rlike(r.regex)
        each.append(F.when(F.coalesce(due, F.lit(False)), matches(body, r, order)).otherwise(empty))
    return joined.withColumn("spans", F.array_sort(reduce(lambda a, b: F.concat(a, b), each))).drop("__kinds", "__row")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; spans that overlap become one. Other columns stay as they are."""
    own = "spans" in [c.lower() for c in docs.columns]
    source = docs.withColumnRenamed("spans", "__own_spans") if own else docs
    found = scan(source, key, text, rules)

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["kept"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(s["start"] >= acc["at"], gap).otherwise(acc["kept"]).alias("kept"), F.greatest(acc["at"], s["end"]).alias("at"))

    cut = F.aggregate(
        F.col("spans"), F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")), step,
        lambda acc: F.concat(acc["kept"], F.substring(F.col(text), acc["at"] + 1, F.length(text) - acc["at"])),
    )
    found = found.withColumn(text, F.when(F.size("spans") > 0, cut).otherwise(F.col(text))).drop("spans")
    found = found.withColumnRenamed("__own_spans", "spans") if own else found
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))
