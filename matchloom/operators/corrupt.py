"""Noisy variants of labelled descriptions in five cumulative levels, for training and robustness tests.

Every choice is a hash of the code, the level, the variant, a seed and the step,
so a variant is the same wherever and however often it is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as x

#: Words and their usual abbreviations, and words that stand for each other.
SHORT = {"DISJUNTOR": "DJ", "SECCIONADORA": "SECC", "TRANSFORMADOR": "TRAFO", "TEMPERATURA": "TEMP", "CORRENTE": "CORR", "TENSAO": "TENS", "PROTECAO": "PROT", "BLOQUEIO": "BLOQ", "SINALIZACAO": "SINAL"}
SYNONYMS = {"FALHA": "DEFEITO", "DEFEITO": "FALHA", "LIGADO": "FECHADO", "DESLIGADO": "ABERTO", "ATUADO": "OPERADO", "RELIGAMENTO": "RELIGA"}
DEVICES = ("52-1", "52-10", "89-3", "24-1", "TR1")
SUFFIXES = ("ATUADO", "NORMAL", "LIGADO", "DESLIGADO")
LEVELS = 5
#: Variants that a task makes, about.
TASK_ROWS = 10_000


def number(*parts: Column | str | int) -> Column:
    """A whole number from 0 to 2**32 - 1 that the parts fix."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def chance(share: float, *parts: Column | str | int) -> Column:
    return number(*parts) < int(share * (1 << 32))


def _words(text: Column, key: Column, step: str, change) -> Column:  # noqa: ANN001
    """Each word as ``change`` (word, its own key) has it."""
    return F.array_join(F.transform(x.tokens(text), lambda w, i: change(w, F.concat_ws("|", key, F.lit(step), i.cast("string")))), " ")


def abbreviated(text: Column, key: Column, step: str) -> Column:
    return _words(text, key, step, lambda w, k: F.when(chance(0.7, k), x.lookup(F.upper(w), SHORT, w)).otherwise(w))


def with_synonyms(text: Column, key: Column, step: str) -> Column:
    return _words(text, key, step, lambda w, k: F.when(chance(0.6, k), x.lookup(F.upper(w), SYNONYMS, w)).otherwise(w))


def reordered(text: Column, key: Column, step: str) -> Column:
    marked = F.transform(x.tokens(text), lambda w, i: F.struct(number(key, step, i).alias("o"), i.alias("i"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(marked), lambda s: s["w"]), " ")


def with_device(text: Column, key: Column, step: str) -> Column:
    return F.concat_ws(" ", text, F.element_at(F.array(*map(F.lit, DEVICES)), (number(key, step) % len(DEVICES) + 1).cast("int")))


def with_state(text: Column, key: Column, step: str) -> Column:
    return F.concat_ws(" - ", text, F.element_at(F.array(*map(F.lit, SUFFIXES)), (number(key, step) % len(SUFFIXES) + 1).cast("int")))


def shortened(text: Column, key: Column, step: str) -> Column:
    """About a third of the words goes, never the first of two or fewer."""
    words = x.tokens(text)
    kept = F.filter(words, lambda w, i: (i == 0) | ~chance(1 / 3, key, step, i))
    return F.when(F.size(words) > 2, F.array_join(kept, " ")).otherwise(text)


def number_in_parentheses(text: Column, key: Column, step: str) -> Column:
    """A leading protection number moves to the end, in parentheses."""
    words = x.tokens(text)
    first = F.get(words, F.lit(0))
    rest = F.filter(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: w != "-")
    return F.when(first.rlike(r"^\d{2}$"), F.concat_ws(" ", F.array_join(rest, " "), F.concat(F.lit("("), first, F.lit(")")))).otherwise(text)


def misspelt(text: Column, key: Column, step: str) -> Column:
    """One character dropped, doubled, or swapped with the next."""
    n = F.length(text)
    at = (number(key, step, "at") % F.greatest(n, F.lit(1)) + 1).cast("int")
    how = number(key, step, "how") % 3
    left, here = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.lit(1))
    after, rest = F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 2, n)
    drop, double, swap = F.concat(left, after, rest), F.concat(left, here, here, after, rest), F.concat(left, after, here, rest)
    return F.when(n < 2, text).when(how == 0, drop).when(how == 1, double).otherwise(swap)


#: What each level adds to those before it.
CLASSES = {
    2: (abbreviated, with_synonyms), 3: (reordered, with_device, with_state), 4: (shortened, number_in_parentheses, misspelt), 5: (shortened, with_device, misspelt, reordered),
}


def dataset(pairs: DataFrame, variants: int = 3, seed: int = 0) -> DataFrame:
    """(code, level, variant, text): noisy variants of pairs (code, text) at every level. Each step is a column of its own, so that none is computed twice."""
    rows = pairs.select("code", F.array_join(x.tokens(F.col("text")), " ").alias("text"), F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))))
    rows = rows.withColumn("__key", F.concat_ws("|", "code", F.col("level").cast("string"), F.col("variant").cast("string"), F.lit(str(seed))))
    # a catalogue is a small file and its variants cost time, not space: without this one task makes them all
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_ROWS)
    rows = rows.repartition(tasks, "__key")
    for n, changes in CLASSES.items():
        for k, change in enumerate(changes):
            rows = rows.withColumn("text", F.when(F.col("level") >= n, change(F.col("text"), F.col("__key"), f"{n}.{k}")).otherwise(F.col("text")))
    return rows.select("code", "level", "variant", F.array_join(x.tokens(F.col("text")), " ").alias("text"))
