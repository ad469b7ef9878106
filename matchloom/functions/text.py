"""Normalisation of descriptions as Column expressions; no step leaves the JVM but exact accent folding and typo repair."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from matchloom.functions import tables as t

LATIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"


def lookup(value: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """The mapped value, or ``default`` (null) for a value that is not a key."""
    pairs = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    found = F.try_element_at(pairs, value)
    return found if default is None else F.coalesce(found, default)


def any_of(array: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(array, F.array(*(F.lit(w) for w in words)))


def tokens(text: Column) -> Column:
    """Non-empty words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def fold(text: Column) -> Column:
    """Upper case without Latin accents."""
    return F.translate(F.upper(text), LATIN, "".join(unicodedata.normalize("NFKD", c)[0] for c in LATIN))


@F.pandas_udf(StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """Upper case without any combining mark."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).upper())


def open_parentheses(text: Column) -> Column:
    return F.regexp_replace(text, r"\(([^)]+)\)", " $1 ")


def separators_to_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[/\-.(),;:]", " ")


def without_stopwords(words: Column, stopwords: tuple[str, ...] = t.STOPWORDS) -> Column:
    """Words that are no stopwords; a phase letter right after FASE stays."""
    phase = F.array(*map(F.lit, "ABCN"))
    listed = F.array(*map(F.lit, stopwords))
    guarded = lambda x, i: F.array_contains(phase, x) & (F.coalesce(F.get(words, i - 1), F.lit("")) == "FASE")
    return F.filter(words, lambda x, i: ~F.array_contains(listed, x) | guarded(x, i))


def expand_abbreviations(words: Column, own: dict[str, str] = t.ABBREVIATIONS) -> Column:
    merged = t.ABBREVIATIONS_EXTRA | own
    return F.flatten(F.transform(words, lambda x: F.split(lookup(x, merged, x), " ")))


ID_PATTERN = r"\b\d+[A-Z](?:\d+|O)\b"


def without_ids(text: Column) -> tuple[Column, Column]:
    """The text without letter-and-number ids of equipment, and those ids."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, ID_PATTERN, " "), r"\s+", " ")), F.regexp_extract_all(text, F.lit(ID_PATTERN), F.lit(0))


def without_boilerplate(words: Column) -> Column:
    """Without a leading equipment term, if more than three words are there."""
    return F.when((F.size(words) > 3) & F.get(words, F.lit(0)).isin(*t.EQUIPMENT_TERMS), F.slice(words, 2, F.size(words))).otherwise(words)


def canonical_units(words: Column) -> Column:
    return F.transform(words, lambda x: lookup(x, t.UNITS, x))


def compact_stages(text: Column) -> Column:
    return F.regexp_replace(text, r"\bESTAGIO\s*([1-5])\b", "E$1")


def stem(word: Column) -> Column:
    """Cut a common ending; the first rule that fits decides."""
    ends = lambda *x: reduce(lambda a, b: a | b, (word.endswith(e) for e in x))
    drop = lambda n, more="": F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(more))
    plural = (F.length(word) > 5) & word.rlike("[AEIOU]S$")
    return (
        F.when(ends("COES", "CAO"), drop(3, "C")).when(ends("MENTOS", "MENTO"), drop(5)).when(ends("DORES"), drop(4)).when(ends("DOR"), drop(3))
        .when(ends("NCIAS", "NCIA"), drop(4, "NT")).when(ends("DADES", "DADE"), drop(4)).when(plural, drop(1)).otherwise(word)
    )


def join_codes(text: Column) -> Column:
    """Numbers and letters of a code that blanks part are one token: ``67 N 1`` is ``67N1``."""
    once = F.regexp_replace(text, r"\b(\d{2,3}) ([A-Z]{1,2}) (\d)\b", "$1$2$3")
    return F.regexp_replace(once, r"\b(\d{2,3}) ([A-Z])\b", "$1$2")


def canonical_words(text: Column) -> Column:
    """The words of a description before typos are repaired."""
    return expand_abbreviations(without_stopwords(tokens(separators_to_blanks(open_parentheses(fold(text))))))


def canonical_of(words: Column) -> Column:
    """The canonical token string of such words, repaired or not."""
    kept = canonical_units(without_boilerplate(tokens(without_ids(F.array_join(words, " "))[0])))
    return join_codes(compact_stages(F.array_join(kept, " ")))


def canonical(text: Column) -> Column:
    """The canonical token string of a description; `candidates.canonical` repairs typos as well."""
    return canonical_of(canonical_words(text))


# --- context that is read from the raw text -------------------------------------------------------------


DEVICE, TRANSFORMER = r"\b(?:52|24|29|89)-\d+\b", r"\bTR\d+\b"


def _may_name_device(up: Column) -> Column:
    """Whether a text holds the beginning of a device's id, which costs less than to look for the id."""
    return reduce(lambda a, b: a | b, (F.contains(up, F.lit(f"{n}-")) for n in t.EQUIPMENT_NUMBERS))


def equipment_ids(text: Column) -> Column:
    """All (family, id) in a text: numbered devices first, then transformers."""
    found = lambda up, pattern, due: F.when(due, F.regexp_extract_all(up, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def named(up: Column) -> Column:
        devices = F.transform(found(up, DEVICE, _may_name_device(up)), lambda x: F.struct(lookup(F.substring(x, 1, 2), t.EQUIPMENT_NUMBERS).alias("family"), x.alias("id")))
        transformers = F.transform(found(up, TRANSFORMER, F.contains(up, F.lit("TR"))), lambda x: F.struct(F.lit("Transformador").alias("family"), x.alias("id")))
        return F.concat(devices, transformers)

    return once(F.coalesce(fold(text), F.lit("")), named)


def family_of_id(name: Column) -> Column:
    return F.when(name.rlike(r"^TR\d+$"), "Transformador").otherwise(lookup(F.split_part(name, F.lit("-"), F.lit(1)), t.EQUIPMENT_NUMBERS))


def clean_words(text: Column) -> Column:
    return F.transform(tokens(fold(text)), lambda x: F.when(F.translate(x, ".,;:()", "") == x, x).otherwise(F.regexp_replace(x, r"^[.,;:()]+|[.,;:()]+$", "")))


def phase_in(words: Column) -> Column:
    """Phase by a word, else by the token after FASE, else by several letters after a number of two or three digits."""
    word = F.get(F.filter(F.transform(words, lambda x: lookup(x, t.PHASE_WORDS)), lambda x: x.isNotNull()), F.lit(0))
    at = F.array_position(words, F.lit("FASE")).cast("int")
    after = F.when(at > 0, F.get(words, at))
    after = lookup(after, t.PHASE_PAIRS, after)
    named = F.when(after.isin(*t.PHASES), after)
    follow = F.transform(words, lambda x, i: F.when((F.length(x) <= 5) & x.rlike(r"^\d{2,3}$"), lookup(F.get(words, i + 1), t.PHASE_PAIRS, F.get(words, i + 1))))
    numbered = F.get(F.filter(follow, lambda x: x.isin("ABC", "AB", "BC", "CA")), F.lit(0))
    return F.coalesce(word, named, numbered)


def structure_of(text: Column, with_rest: bool = True) -> Column:
    """Struct of rest (unless told not), family, device, bus and phase from a raw description."""

    def read(up: Column) -> Column:
        device = F.when(_may_name_device(up), F.nullif(F.regexp_extract(up, DEVICE, 0), F.lit("")))
        transformer = F.when(F.contains(up, F.lit("TR")), F.nullif(F.regexp_extract(up, TRANSFORMER, 0), F.lit("")))
        bus = F.when(F.contains(up, F.lit("BARRA")), F.regexp_extract(up, r"\bBARRA\s+([A-Z])\b", 1)).otherwise("")
        return once(F.struct(up.alias("up"), device.alias("device"), transformer.alias("transformer"), clean_words(up).alias("words"), bus.alias("bus")), told)

    def told(s: Column) -> Column:
        up, device, transformer, words, bus = s["up"], s["device"], s["transformer"], s["words"], s["bus"]
        word = F.get(F.filter(F.transform(words, lambda x: lookup(x, t.EQUIPMENT_WORDS)), lambda x: x.isNotNull()), F.lit(0))
        family = F.when(device.isNotNull(), family_of_id(device)).when(transformer.isNotNull(), F.lit("Transformador")).otherwise(word)
        found = [family.alias("family"), F.coalesce(device, transformer).alias("device"), lookup(bus, t.BUS).alias("bus"), phase_in(words).alias("phase")]
        if not with_rest:
            return F.struct(*found)
        rest = F.when(F.coalesce(device, transformer).isNotNull(), F.regexp_replace(up, F.concat(F.lit(r"\b\Q"), F.coalesce(device, transformer), F.lit(r"\E\b")), F.lit(" "))).otherwise(up)
        rest = F.when(bus.isin(*t.BUS), F.regexp_replace(rest, F.lit(r"\bBARRA\s+[A-Z]\b"), F.lit("BARRA"))).otherwise(rest)
        return F.struct(F.array_join(tokens(rest), " ").alias("rest"), *found)

    return once(F.coalesce(fold(text), F.lit("")), read)


def integers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("int"))


def name_parts(name: Column) -> Column:
    """(station, module, equipment) of a name whose parts are joined by underscores."""
    parts = F.split(name, "_")
    n = F.size(parts)
    return F.struct(F.when(n >= 3, F.get(parts, F.lit(0))).alias("station"), F.when(n >= 3, F.get(parts, F.lit(1))).alias("module"), F.when(n >= 4, F.get(parts, F.lit(2))).alias("equipment"))


def code_in_name(code: Column, name: Column) -> Column:
    return (name == code) | name.endswith(F.concat(F.lit("_"), code))


def module_divergence(from_name: Column, from_sheet: Column) -> Column:
    """What two sources of a module's name disagree on; null if they agree or one is missing."""
    return F.when(F.upper(from_name) != F.upper(from_sheet), F.concat(F.lit("name="), from_name, F.lit(" != sheet="), from_sheet))


def display_text(text: Column, code: Column) -> Column:
    """The code instead of a text that is itself code-like."""
    return F.when(code.isNotNull() & F.upper(F.trim(text)).rlike(r"^[A-Z0-9_/-]+$"), code).otherwise(text)


def numbered(name: Column, number: Column) -> Column:
    bare = F.replace(name, F.lit(" "), F.lit(""))
    return F.when(bare.endswith(number), bare).otherwise(F.concat(bare, number))


def homogeneous_identity(labels: Column, sheet: Column, module: Column, equipment: Column, sides: tuple[str, ...] = t.SIDES) -> Column:
    """Struct of module, equipment and origin, from a sheet's header block (label to number) and a row's two cells.

    A side takes the letters of the sheet's name and the block's module number;
    else the module's own label; else the label of its busbar; else the module
    number, unless the name has one; else the name stands.
    """
    number, own = F.try_element_at(labels, F.lit("MODULO")), F.try_element_at(labels, module)
    letters = F.regexp_extract(fold(sheet), r"^([A-Z]+)", 1)
    is_side = module.isin(*sides)
    bus = F.try_element_at(labels, F.when(F.length(module) == 2, "BP AT").otherwise(F.concat(F.lit("BP BT"), F.substring(module, F.lit(3), F.length(module)))))
    name = (
        F.when(is_side & number.isNotNull(), F.concat(numbered(F.when(letters != "", letters).otherwise(module), number), module)).when(own.isNotNull(), numbered(module, own))
        .when(F.startswith(module, F.lit("BP")) & bus.isNotNull(), numbered(module, bus)).when(number.isNotNull() & ~module.rlike(r"^[A-Z]+\s?\d+$"), numbered(module, number)).otherwise(module)
    )
    origin = F.when((is_side & number.isNotNull()) | own.isNotNull() | (F.startswith(module, F.lit("BP")) & bus.isNotNull()) | (number.isNotNull() & ~module.rlike(r"^[A-Z]+\s?\d+$")), "column+header").otherwise("column")
    relay = F.when(equipment.endswith("_P"), "P").when(equipment.endswith("_A"), "A")
    base = F.when(relay.isNotNull(), F.substring(equipment, F.lit(1), F.length(equipment) - 2)).otherwise(equipment)
    value = F.coalesce(F.when(is_side, F.try_element_at(labels, F.concat_ws(" ", base, module))), F.when(base != "MODULO", F.try_element_at(labels, base)))
    device = F.when(F.contains(value, F.lit("-")), value).when(value.isNotNull(), numbered(base, value))
    device = F.when(relay.isNotNull(), F.concat_ws("_", F.coalesce(device, F.replace(name, F.lit(" "), F.lit(""))), relay)).otherwise(device)
    return F.struct(name.alias("module"), device.alias("equipment"), origin.alias("origin"))


def type_of(cell: Column) -> Column:
    """(category, direction) that a type cell names: an exact code, else a word in it, analog before command before discrete."""
    pair = lambda c, d: F.struct(F.lit(c).alias("category"), F.lit(d).alias("direction"))

    def named(up: Column) -> Column:
        holds = lambda words: reduce(lambda a, b: a | b, (F.contains(up, F.lit(w)) for w in words))
        chain = F.when(F.lit(False), pair("", ""))
        for code, (category, direction) in t.TYPE_CODES.items():
            chain = chain.when(up == code, pair(category, direction))
        return chain.when(holds(t.TYPE_ANALOG), pair("Analog", "Input")).when(holds(t.TYPE_COMMAND), pair("Discrete", "Output")).when(holds(t.TYPE_DISCRETE), pair("Discrete", "Input"))

    return once(F.trim(fold(F.coalesce(cell, F.lit("")))), named)


def is_quantity(words: Column) -> Column:
    return any_of(words, ("TENSAO", "CORRENTE", "POTENCIA", "FREQUENCIA")) & ~F.coalesce(F.get(words, F.lit(0)).isin("FALTA", "PERDA"), F.lit(False))


def module_name(text: Column, aliases: dict[str, str], prefixes: dict[str, str]) -> Column:
    """Canonical module name: an alias of the joined parts, else one known prefix and one number after it, else null."""
    parts = F.regexp_extract_all(fold(text), F.lit(r"[A-Z]+|\d+"), F.lit(0))
    joined = F.array_join(parts, "")
    pairs = F.filter(F.transform(parts, lambda x, i: F.when(F.get(parts, i + 1).rlike(r"^\d+$"), F.concat(lookup(x, prefixes), F.get(parts, i + 1)))), lambda x: x.isNotNull())
    distinct = F.array_distinct(pairs)
    return F.coalesce(lookup(joined, aliases), F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))))


def side_of_section(text: Column) -> Column:
    up = F.upper(F.coalesce(text, F.lit("")))
    holds = lambda *words: reduce(lambda a, b: a | b, (F.contains(up, F.lit(w)) for w in words))
    return F.when(holds("AT", "PRIM", "ALTA"), "AT").when(holds("BT", "MT", "SEC", "BAIXA"), "BT")


def clean_value(value: Column) -> Column:
    """Null for the usual spellings of nothing."""
    return F.when(F.upper(F.trim(value)).isin("", "#N/A", "NONE", "NULL"), None).otherwise(F.trim(value))


# --- codes ---------------------------------------------------------------------------------------------


def leading_number(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"^(\d{2})\d*", 1), F.lit(""))


def code_phase(code: Column) -> Column:
    base = F.when((F.length(code) > 1) & code.rlike("[1-4]$"), F.substring(code, F.lit(1), F.length(code) - 1)).otherwise(code)
    chain = F.when(base.endswith("N"), "N")
    for p in ("ABC", "AB", "BC", "CA"):
        chain = chain.when(base.endswith(p), p)
    return chain.when(base.endswith("F"), "F").when(base.rlike("[ABC]$"), F.right(base, F.lit(1)))


def code_stage(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"(\d)$", 1), F.lit(""))


def code_equipment(code: Column) -> Column:
    return F.when(code.startswith("DJ"), "Disjuntor").when(code.startswith("SEC"), "Seccionadora")


# --- states --------------------------------------------------------------------------------------------


def state_class(token: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for word, name in t.STATE_TOKENS.items():
        chain = chain.when(token == word, name)
    for prefix, name, _ in t.STATES:
        chain = chain.when(token.startswith(prefix), name)
    return chain


def state_polarity(token: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for word in t.STATE_TOKENS:
        chain = chain.when(token == word, None)
    for prefix, _, polarity in t.STATES:
        chain = chain.when(token.startswith(prefix), polarity)
    return chain


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _the_one(values: Column) -> Column:
    distinct = F.array_distinct(F.filter(values, lambda x: x.isNotNull()))
    return once(distinct, lambda d: F.when(F.size(d) == 1, F.get(d, F.lit(0))))


def text_state(text: Column) -> Column:
    """Class of the state that a description names: INDEFINIDO wins, several classes are none."""
    classes = F.array_distinct(F.filter(F.transform(tokens(F.upper(text)), state_class), lambda x: x.isNotNull()))
    return once(classes, lambda c: F.when(F.array_contains(c, "INDEFINIDO"), "INDEFINIDO").when(F.size(c) == 1, F.get(c, F.lit(0))))


def text_polarity(text: Column) -> Column:
    """Polarity of a description whose state is a position, if it is one."""
    return F.when(text_state(text) == "POSICAO", _the_one(F.transform(tokens(F.upper(text)), state_polarity)))


def mapping_state(mm: Column) -> Column:
    """Class of the states in a message mapping: the part after the first triple underscore, up to a double one."""
    part = F.get(F.split(mm, "___"), F.lit(1))
    states = F.split(F.get(F.split(part, "__"), F.lit(0)), "@")
    return _the_one(F.transform(states, lambda x: state_class(F.upper(F.trim(x)))))


def function_state(states: Column) -> Column:
    return _the_one(F.transform(F.split(states, ";"), lambda x: state_class(F.upper(F.trim(x)))))


def candidate_state(states: Column, mm: Column) -> Column:
    """The class of a candidate: that of its function, else that of its message mapping."""
    return F.coalesce(function_state(states), mapping_state(mm))


def compatible(a: Column, b: Column) -> Column:
    """Missing and undefined states fit any."""
    return F.coalesce((a == b) | (a == "INDEFINIDO") | (b == "INDEFINIDO"), F.lit(True))


def has_prefix(words: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(words, lambda x: reduce(lambda a, b: a | b, (x.startswith(p) for p in prefixes)))


def is_position(text: Column) -> Column:
    words = tokens(F.upper(text))
    return F.array_contains(words, "NA") | has_prefix(words, t.ON_PREFIXES) | has_prefix(words, t.OFF_PREFIXES)


def pure_polarity(text: Column, direction: Column) -> Column:
    words = tokens(F.upper(text))
    on, off = any_of(words, t.ON_WORDS), any_of(words, t.OFF_WORDS)
    return F.when(direction == "Output", None).when(on & ~off, "on").when(off & ~on, "off")


def is_toggle(text: Column) -> Column:
    words = tokens(F.upper(text))
    return has_prefix(words, t.OPENING) & has_prefix(words, t.CLOSING)


def disconnector_code(text: Column) -> Column:
    words = tokens(F.upper(text))
    chain = F.when(F.lit(False), "")
    for prefix, code in t.DISCONNECTORS:
        chain = chain.when(has_prefix(words, (prefix,)), code)
    return chain
