"""Licence scans: identifier tags and notice phrases by automata, expressions by operator precedence.

One Aho-Corasick automaton runs over the words of a text and finds notice phrases, another over the
text as it stands and finds the tags that licence expressions follow. An expression is put in
postfix order by a shunting yard (WITH binds closest, then AND, then OR) and evaluated twice: for
the labels it names, and for how free the best reading of it leaves the user.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import handing_back

# The phrases of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases of notices, as words; overlapping ones are all found.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "boost software license": "bsl",
    "all rights reserved": "all-rights-reserved",
}
#: Tags, in lower case, that an expression follows up to the line's end.
TAGS = ("spdx-license-identifier:", "license-expression:", "@license ")
#: How free a family of licences leaves the user; identifiers of other families count as UNKNOWN.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "apache": 1.0, "bsl": 1.0, "zlib": 1.0, "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6,
    "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN, EXCEPTION = 0.1, 0.5  # an exception gives back this share of what its licence takes
_RANK = {"or": 1, "and": 2, "with": 3}
#: All bytes but letters, digits and those of other characters than ASCII part words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+:_-]+")
_LINE = re.compile(r"[^\r\n]*")


def family(identifier: str) -> str:
    """The label of an identifier: its longest beginning that is a known family, else itself."""
    known = [f for f in FREEDOM if re.match(re.escape(f) + r"(?![a-z])", identifier)]
    return max(known, key=len) if known else identifier.rstrip("+.")


def postfix(expression: str) -> list[str]:
    """Operands and operators of a lower-case expression in postfix order, by a shunting yard.

    What can't be part of an expression ends it: two operands in a row, an operator without a left
    operand, a bracket that closes nothing. Brackets that stay open close at the end, and an
    operator without a right operand goes.
    """
    out: list[str] = []
    held: list[str] = []
    operand = False  # does the last token end an operand?
    for m in _TOKEN.finditer(expression):
        token = m.group()
        if token == "(":
            if operand:
                break
            held.append(token)
        elif token == ")":
            if not operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in _RANK:
            if not operand:
                break
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = False
        else:
            if operand:
                break
            out.append(token)
            operand = True
    rest = [t for t in reversed(held) if t != "("]
    return out + rest[0 if operand else 1 :]


def evaluated(expression: str) -> tuple[set[str], float] | None:
    """Labels that an expression names, and its freedom: the best choice of OR, the worst part of
    AND, and for WITH the licence's with a share of the rest; None if it holds no identifier."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix(expression):
        if token not in _RANK:
            label = family(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
        elif len(stack) > 1:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, x + EXCEPTION * (1 - x)) if token == "with" else (a | b, max(x, y) if token == "or" else min(x, y)))
    return stack[-1] if stack else None


def automaton(phrases):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


def scan_text(raw: bytes, phrases, tags) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score`` of a text in UTF-8.

    ``score`` is 0 without any label, else the least freedom of what was found: the terms of all
    tags and notices hold at once.
    """
    words = raw.translate(_WORDS).split()
    # one byte a character: phrases are ASCII, and all others are parts of words
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts, base, labels = [], set(), set()
    upto = place = 0
    for end, phrase in phrases.iter(line):
        begin = end - len(phrase) + 1
        # a longer phrase may have begun before the last one
        place += line.count(" ", upto, begin) - line.count(" ", begin, upto)
        upto = begin
        words_of = phrase[1:-1]
        if words_of in BASE:
            starts.append(place)
            base.add(BASE[words_of])
        labels.add(BASE.get(words_of) or NOTICES[words_of])
    free = [FREEDOM[x] for x in labels]
    lower = raw.translate(_LOWER).decode("latin-1")
    for end, _ in tags.iter(lower):
        found = evaluated(_LINE.match(lower, end + 1).group())
        if found:
            labels |= found[0]
            free.append(found[1])
    shown = lambda x: ",".join(sorted(x))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), shown(base), shown(labels), float(min(free, default=0.0))


_FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches):
    phrases, tags = automaton(f" {p} " for p in {**BASE, **NOTICES}), automaton(TAGS)
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            found = zip(*(scan_text(r.as_py() or b"", phrases, tags) for r in part.column("raw")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(found, kinds))], [c.split()[0] for c in _FOUND.split(", ")])


def licensed(docs: DataFrame) -> DataFrame:
    """What ``scan_text`` finds in each row of ``docs(doc_id, text)``, null texts as empty ones.

    A row in, a row out, without a shuffle; rows that repeat are scanned each for itself, other
    columns don't matter, and an empty table gives an empty one.
    """
    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw"))
    return raw.mapInArrow(handing_back(_scan), _FOUND)
