"""Text rules: token sets, classifiers, log lines, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Needles of section kinds in order of priority, first rule set (lower case, accents folded).
SECTION_RULES = (
    ("tani", ("tani",)),
    ("alaap", ("alap", "alapana")),
    ("composed", ("pallavi", "anupallavi", "caranam", "khyal", "kriti", "kirtana", "tarana", "bandish", "thumri", "bhajan", "dadra")),
)
#: Needles of the second rule set (lower case only, accents count).
INSPECTION_RULES = (
    ("alaap", ("ālāp", "alap", "alāp", "ālāpana", "alapana")),
    ("composed", ("pallavi", "anupallavi", "caraṇam", "caranam", "khyāl", "khyal", "kriti", "kirtana", "tarānā", "bandish", "thumri", "tarana")),
)


def token_set(text: Column, separator: str = ";") -> Column:
    """Trimmed, distinct, non-empty tokens; null and "nan" have none."""
    trimmed = F.transform(F.split(text, separator), lambda t: F.trim(t))
    tokens = F.array_distinct(F.filter(trimmed, lambda t: t != ""))
    return F.when(text.isNull() | (F.lower(text) == "nan"), F.array().cast("array<string>")).otherwise(tokens)


def raw_overlap(a: Column, b: Column, separator: str = ";") -> Column:
    """Whether the untrimmed tokens overlap."""
    return F.coalesce(F.arrays_overlap(F.split(a, separator), F.split(b, separator)), F.lit(False))


def canonical_key(text: Column) -> Column:
    """Sorted, lower-cased token set joined by ";"; ``__UNKNOWN__`` if there are none."""
    key = F.array_join(F.array_sort(F.array_distinct(F.transform(token_set(text), lambda t: F.lower(t)))), ";")
    return F.when(key == "", "__UNKNOWN__").otherwise(key)


def holds(text: Column, needle: str) -> Column:
    """Contains, without regard to case and accents."""
    return F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(F.lit(needle), "UNICODE_CI_AI"))


def classify(text: Column, rules) -> Column:
    """The first class one of whose needles the text holds, else null."""
    out = None
    for name, needles in rules:
        found = holds(text, needles[0])
        for needle in needles[1:]:
            found = found | holds(text, needle)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out


def marks(text: Column, rules) -> dict[str, Column]:
    """For each class whether the lower-cased text holds one of its needles; a null text holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {name: F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(low, n)) for name, needles in rules}


def seed_of(text: Column) -> Column:
    """The first four bytes of SHA-256, big-endian."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def uniform(text: Column) -> Column:
    """A repeatable number in [0, 1) for a key."""
    return seed_of(text) / F.lit(float(1 << 32))


def human_bytes(size: Column) -> Column:
    out = None
    for unit, power in (("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1)):
        scaled = F.concat(F.round(size / F.lit(1024.0**power), 1).cast("string"), F.lit(" " + unit))
        out = F.when(size >= 1024**power, scaled) if out is None else out.when(size >= 1024**power, scaled)
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def match_line(line: Column) -> dict[str, Column]:
    """A matcher's line: thirteen fields or more, separated by ``;``; all null where it is malformed.

    The first two fields are whole numbers of digits, the match id and the count
    are integers, the places and the three factors numbers (the factors with or
    without a per cent sign).  One field that is not makes the line malformed.
    """
    parts = F.transform(F.split(line, ";"), lambda p: F.trim(p))
    field = lambda i: F.get(parts, F.lit(i))
    factor = lambda i: F.regexp_replace(field(i), "[ %]+$", "").try_cast("double")
    numbers = {
        "task": field(0).try_cast("int"), "task_total": field(1).try_cast("int"), "query_start": field(3).try_cast("double"), "query_stop": field(4).try_cast("double"),
        "match_id": field(6).try_cast("bigint"), "ref_start": field(7).try_cast("double"), "ref_stop": field(8).try_cast("double"), "match_count": field(9).try_cast("int"),
        "time_factor_pct": factor(10), "freq_factor_pct": factor(11), "seconds_with_match_pct": factor(12),
    }
    good = (F.size(parts) >= 13) & field(0).rlike("^[0-9]+$") & field(1).rlike("^[0-9]+$")
    for value in numbers.values():
        good = good & value.isNotNull()
    return {name: F.when(good, value) for name, value in {**numbers, "query_path": field(2), "ref_path": field(5)}.items()}
