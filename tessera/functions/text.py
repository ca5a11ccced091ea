"""Column functions over names and texts."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for one company.
ALIASES = {
    "apple": "Apple Inc.",
    "apple inc": "Apple Inc.",
    "google": "Google LLC",
    "alphabet": "Alphabet Inc.",
    "microsoft": "Microsoft Corp.",
    "amazon": "Amazon.com Inc.",
    "meta": "Meta Platforms Inc.",
    "nvidia": "NVIDIA Corp.",
}

# Replacements that make a name canonical, in order, and what keeps its final dot.
NAME_RULES = (
    (r"^\s+|\s+$", ""),
    (r"""^[,;:()"'!?]+|[,;:()"'!?]+$""", ""),
    (r"\s+", " "),
    (r"\bInc\.?$", "Inc."),
    (r"\bCorp\.?$", "Corp."),
    (r"\bLtd\.?$", "Ltd."),
    (r"\bLLC\.?$", "LLC"),
)
KEEPS_DOT = r"(Inc|Corp|Ltd|Co)\.$"
#: Names that no rule changes: words with single spaces between them, and no legal form that takes a dot.
SETTLED = r"^(?:[A-Za-z0-9$%]++ )*+[A-Za-z0-9$%]++(?<!\bInc|\bCorp|\bLtd)\z"
_SETTLED = re.compile(SETTLED.replace(r"(?<!\bInc|\bCorp|\bLtd)\z", r"(?<!\bInc)(?<!\bCorp)(?<!\bLtd)\Z"), re.ASCII)


# such words with a legal form after them, which only its dot may need
_FORMED = re.compile(r"((?:[A-Za-z0-9$%]++ )*+)(Inc|Corp|Ltd|LLC)\.?\Z", re.ASCII)


def canonical(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Canonical form of a name: trimmed, legal form normalised, final dots off, aliases resolved."""

    def ruled(x: Column) -> Column:
        for pattern, by in NAME_RULES:
            x = F.regexp_replace(x, pattern, by)
        return x

    def settled(x: Column) -> Column:
        return F.get(F.transform(F.transform(F.array(x), ruled), lambda y: F.when(y.rlike(KEEPS_DOT), y).otherwise(F.regexp_replace(y, r"\.+$", ""))), F.lit(0))

    # one-element arrays: each step is evaluated once, however often the next one uses it
    steps = F.transform(F.array(name), lambda x: F.when(x.rlike(SETTLED), x).otherwise(settled(x)))
    if aliases:
        known = F.create_map(*map(F.lit, chain.from_iterable(aliases.items())))
        steps = F.transform(steps, lambda x: F.coalesce(F.try_element_at(known, F.lower(x)), x))
    return F.get(steps, F.lit(0))


def canonical_name(name: str) -> str:
    """``canonical`` of one name, for names that tasks cut out of texts."""
    if _SETTLED.match(name):
        return ALIASES.get(name.lower(), name)
    if formed := _FORMED.match(name):
        name = formed[1] + (formed[2] if formed[2] == "LLC" else f"{formed[2]}.")
        return ALIASES.get(name.lower(), name)
    for pattern, by in NAME_RULES:
        name = re.sub(pattern, by, name, flags=re.ASCII)
    if not re.search(KEEPS_DOT, name):
        name = re.sub(r"\.+$", "", name)
    return ALIASES.get(name.lower(), name)


def or_else(value: Column, default: Column) -> Column:
    """``value``, or ``default`` where it is null or empty."""
    return F.when(value.isNotNull() & (value != ""), value).otherwise(default)


def seeds_by_capitals(question: Column, most: int = 4) -> Column:
    """The first words of a question that start with an upper-case letter, without , . and ?"""
    named = F.filter(F.split(F.trim(question), r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))
    return F.transform(F.slice(named, 1, most), lambda w: F.btrim(w, F.lit(",.?")))


def cache_key(question: Column) -> Column:
    return F.sha2(F.lower(F.trim(question)), 256)
