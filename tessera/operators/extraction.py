"""Entities and relations of chunks by patterns, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import canonical_name, seeds_by_capitals

# Patterns, lexicon and confidences; (?i) where letter case doesn't count.
ORGANIZATION = r"\b([A-Z][a-zA-Z0-9_\-]+(?:\s+[A-Z][a-zA-Z0-9_\-]+)*\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?|Group|Technologies|Holdings|Bank|Labs|Systems|AI))\b"
METRIC = r"(?i)(\$[0-9]+(?:\.[0-9]+)?\s*(?:billion|million|trillion|B|M|k)?|[0-9]+(?:\.[0-9]+)?\s*%)"
TECHNOLOGY = r"(?i)\b(Neo4j|Pinecone|LlamaIndex|PyMuPDF|Transformers|PyTorch|CUDA|Kubernetes|Docker|PostgreSQL|Redis|FastAPI|LangChain|GraphRAG|Milvus|Qdrant|BERT|RoBERTa|GPT-4|Gemini|Claude)\b"
TRIGGERS = (
    ("ACQUIRED", 1.0, r"(?i)([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)\s+(?:formally|subsequently|officially|recently|successfully)?\s*(?:acquired|purchased|bought)\s+([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)"),
    ("SUBSIDIARY_OF", 0.95, r"(?i)([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)\s+(?:is a subsidiary of|owned by)\s+([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)"),
    ("PARTNERS_WITH", 0.9, r"(?i)([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)\s+(?:partnered with|collaborated with|signed agreement with)\s+([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)"),
    ("DEVELOPS_AND_OWNS", 0.95, r"(?i)([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)\s+(?:developed|built|launched|created|released|owns|controls|powers)\s+(?:and owns\s+)?(?:the\s+)?([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Engine|Database|Model|System|Platform|Framework))?)"),
    ("DEPENDS_ON", 0.9, r"(?i)([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)\s+(?:depends on|relies on|integrates with)\s+([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)"),
    ("INCREASED_BY", 0.9, r"(?i)([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)\s+(?:increased by|grew by|surged)\s+(\$[0-9]+[\w\s]*|[0-9]+%)"),
    ("REPORTED_METRIC", 0.9, r"(?i)([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)\s+(?:reported revenue of|generated)\s+(\$[0-9]+[\w\s]*)"),
    ("LOCATED_IN", 0.9, r"(?i)([A-Z][A-Za-z0-9\s]+?(?:\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?))?)\s+(?:is located in|headquartered in|based in)\s+([A-Z][A-Za-z0-9\s]+)"),
)
# A pattern's verbs, all alternatives of which hold one of the words; a cheap test before it runs.
TRIGGER_WORDS = {kind: re.search(r"\\s\+\(\?:(?!Inc|formally)([^()]*)\)|\\s\*\(\?:([^()]*)\)", pattern) for kind, _, pattern in TRIGGERS}
TRIGGER_WORDS = {kind: m[1] or m[2] for kind, m in TRIGGER_WORDS.items()}
#: What a trigger's match can consist of: word characters, white space, $ and %, and dots that end
#: a legal form. Patterns run on the pieces of a text that consist of these and hold a verb.
CLAUSE = r"(?i)(?:[\w\s$%]++|(?<=Inc|Corp|Ltd)\.)++"
CONFIDENCE = {"ORGANIZATION": 0.92, "TECHNOLOGY": 0.95, "METRIC": 0.88}
INFERRED = 0.80
ROWS = 500  # texts whose entities and relations a task holds before it hands them on


# The patterns as a task runs them: on texts with A-Z lower-cased, where letter case doesn't count, which is
# faster than to ignore it; white space, words and letter case are ASCII's, word boundaries are Unicode's.
_SPACE = " \t\n\x0b\f\r"


def _plain(text: str) -> str:
    """``text`` with one letter for all letters and digits that no pattern matches, marks on them included, and one sign for the rest.

    Word boundaries are those of letters and decimal digits, which Python's are not for all characters.
    """
    if text.isascii():
        return text
    out, word = [], False
    for c in text:
        if not (word and unicodedata.category(c) == "Mn"):
            word = c.isalpha() or c.isdecimal()
        out.append(c if c.isascii() else "é" if word else "·")
    return "".join(out)


def _compiled(pattern: str) -> re.Pattern:
    if pattern.startswith("(?i)"):
        pattern = pattern[4:].lower()
    return re.compile(pattern.replace(r"\b", r"(?u:\b)").replace("(?<=inc|corp|ltd)", "(?:(?<=inc)|(?<=corp)|(?<=ltd))"), re.ASCII)


# the same two patterns with their first character in front, for which a search skips quickly
_ORGANIZATION = ORGANIZATION.replace(r"\b([A-Z]", r"([A-Z](?<=\b[A-Z])", 1)
_METRIC = METRIC.replace(r"(\$[0-9]+", r"([$0-9](?:(?<=\$)[0-9]+", 1).replace(r"|[0-9]+(", r"|(?<=[0-9])[0-9]*(", 1) + ")"
_ORG, _AMOUNT = _compiled(_ORGANIZATION), _compiled(_METRIC)
_RULES = [(n, kind, confidence, TRIGGER_WORDS[kind].split("|"), _compiled(pattern)) for n, (kind, confidence, pattern) in enumerate(TRIGGERS)]
_canonical = lru_cache(1 << 14)(canonical_name)


@lru_cache(1)
def _finder():
    """All verbs and technologies, lower-cased, as one automaton: ``(number of the rule, length)``, number -1 for technologies."""
    import ahocorasick

    a, known = ahocorasick.Automaton(), {}
    for w in re.search(r"\(([^()]*)\)", TECHNOLOGY.removeprefix("(?i)"))[1].lower().split("|"):
        known.setdefault(w, []).append(-1)
    for nth, _, _, words, _ in _RULES:
        for w in words:
            known.setdefault(w, []).append(nth)
    for w, numbers in known.items():
        a.add_word(w, (numbers, len(w)))
    a.make_automaton()
    return a


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _found(lower: str) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """Places of all technologies in order, and the begins of each rule's verbs, of a text in one pass.

    No technology begins another one or overlaps it, with the word boundaries around them.
    """
    tools, verbs, size = [], {}, len(lower)
    for last, (numbers, length) in _finder().iter(lower):
        begin, end = last + 1 - length, last + 1
        for nth in numbers:
            if nth >= 0:
                verbs.setdefault(nth, []).append(begin)
            elif not (begin and _word(lower[begin - 1])) and not (end < size and _word(lower[end])):
                tools.append((begin, end))
    return tools, verbs


# a text's bytes with one sign for all that ends a clause of ``CLAUSE``, but for dots, which don't after a legal form
_PARTS = bytes(c if re.match(r"[\w\s$%.]", chr(c), re.ASCII) else 0x2C for c in range(256))


def _break_before(parts: bytes, at: int) -> int:
    """Where the clause of a verb at ``at`` begins."""
    dot = at
    while (dot := parts.rfind(b".", 0, dot)) >= 0 and parts.endswith((b"inc", b"corp", b"ltd"), 0, dot):
        pass
    return max(dot, parts.rfind(b",", 0, at)) + 1


def _break_after(parts: bytes, at: int) -> int:
    """Where the clause of a verb at ``at`` ends."""
    dot = at - 1
    while (dot := parts.find(b".", dot + 1)) >= 0 and parts.endswith((b"inc", b"corp", b"ltd"), 0, dot):
        pass
    sign = parts.find(b",", at)
    return min(len(parts) if dot < 0 else dot, len(parts) if sign < 0 else sign)


def _clauses(parts: bytes, begins: list[int]) -> list[list[int]]:
    """``begin, end, last verb`` of the clauses that hold verbs at ``begins``."""
    out: list[list[int]] = []
    for at in sorted(begins):
        if out and at < out[-1][1]:
            out[-1][2] = at
        else:
            out.append([_break_before(parts, at), _break_after(parts, at), at])
    return out


def _entities(text: str, lower: str, tools: list[tuple[int, int]]) -> list[tuple]:
    """``(canonical_name, name, entity_type, confidence)`` of all matches, in order of kind and place."""
    out = []
    for m in _ORG.finditer(text):
        name = m[1].strip(_SPACE)
        out.append((_canonical(name), name, "ORGANIZATION", CONFIDENCE["ORGANIZATION"]))
    for begin, end in tools:
        name = text[begin:end]
        out.append((_canonical(name), name, "TECHNOLOGY", CONFIDENCE["TECHNOLOGY"]))
    for m in _AMOUNT.finditer(lower):
        name = text[m.start(1) : m.end(1)].strip(_SPACE)
        out.append((name, name, "METRIC", CONFIDENCE["METRIC"]))
    return out


def _triples(text: str, lower: str, verbs: dict[int, list[int]], known: list[str]) -> list[tuple]:
    """``(position, relation_type, source_raw, target_raw, confidence, source, target)`` of all triggers.

    A pattern runs on the clauses that hold one of its verbs, up to the last of them.
    """
    out = []
    if not verbs:
        return out
    parts = lower.encode("latin-1").translate(_PARTS)
    for nth in sorted(verbs):
        _, kind, confidence, _, pattern = _RULES[nth]
        i = 1000 * nth
        for begin, end, last in _clauses(parts, verbs[nth]):
            clause, at, last = lower[begin:end], 0, last - begin
            while at < last and (m := pattern.search(clause, at)):
                at = m.end()
                raw = [text[begin + b : begin + e].strip(_SPACE) for b, e in (m.span(1), m.span(2))]
                source, target = [next((k for k in known if k in r), None) or _canonical(r) for r in raw]
                out.append((i, kind, *raw, confidence, source, target))
                i += 1
    return out


def _entries(found: list[tuple], triples: list[tuple]) -> list[tuple]:
    """``(ord, name, entity_type, confidence, canonical_name)``: the first of each name, ends of relations last."""
    out = [(i, *e[1:], e[0]) for i, e in enumerate(found)]
    for position, _, source_raw, target_raw, _, source, target in triples:
        at = 1_000_000 + 2 * position
        if len(source) > 2:
            out.append((at, source_raw, "CONCEPT", INFERRED, source))
        if len(target) > 1:
            out.append((at + 1, target_raw, "METRIC" if target.startswith("$") else "CONCEPT", INFERRED, target))
    first: dict[str, tuple] = {}
    for e in sorted(out):
        first.setdefault(e[4], e)
    return list(first.values())


_INT, _DOUBLE, _STRING = T.IntegerType(), T.DoubleType(), T.StringType()
_ENTRY = T.StructType([T.StructField(*f) for f in (("ord", _INT), ("name", _STRING), ("entity_type", _STRING), ("confidence", _DOUBLE), ("canonical_name", _STRING))])
_TRIPLE = T.StructType(
    [T.StructField(*f) for f in (("position", _INT), ("relation_type", _STRING), ("source_raw", _STRING), ("target_raw", _STRING), ("confidence", _DOUBLE), ("source", _STRING), ("target", _STRING))]
)


def _lists(rows: list[list[tuple]], kind: T.StructType) -> pa.Array:
    """A list of structs for each row."""
    columns = list(zip(*(x for row in rows for x in row))) or [()] * len(kind)
    fields = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind)]
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.StructArray.from_arrays(fields, kind.names))


def annotated(chunks: DataFrame, triples_too: bool = True) -> DataFrame:
    """``chunks`` with ``entries`` and ``triples``: all that the patterns find in each text.

    ``entries`` are the entities of a row, each name once; ``triples`` its relations. Chunks that
    have these columns already, from a stored table, are returned as they are. An end of a triple
    that holds the name of an entity found in the chunk is the first such entity.
    """
    if {"entries", "triples"} <= set(chunks.columns):
        return chunks
    at = chunks.columns.index("text")

    def run(batches):
        # few rows at once: what Python holds of thousands is walked again and again by its collector
        for batch in (b.slice(n, ROWS) for b in batches for n in range(0, b.num_rows, ROWS)):
            every, said = [], []
            for text in batch.column(at).to_pylist():
                text = _plain(text or "")
                lower = text.lower()
                tools, verbs = _found(lower)
                found = _entities(text, lower, tools)
                said.append(_triples(text, lower, verbs, list(dict.fromkeys(e[0] for e in found))) if triples_too else [])
                every.append(_entries(found, said[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(every, _ENTRY), _lists(said, _TRIPLE)], [*batch.schema.names, "entries", "triples"])

    return chunks.mapInArrow(run, T.StructType([*chunks.schema, T.StructField("entries", T.ArrayType(_ENTRY)), T.StructField("triples", T.ArrayType(_TRIPLE))]))


def relations(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``chunk_id, doc_id, source, target, relation_type, position, description, weight, confidence`` and raw ends.

    Columns of ``chunks`` to ``keep`` come last.
    """
    noted = chunks if "triples" in chunks.columns else annotated(chunks.select("chunk_id", "doc_id", "text", *keep))
    rows = noted.select("chunk_id", "doc_id", *keep, F.explode("triples").alias("r")).select("chunk_id", "doc_id", *keep, "r.*")
    return rows.select(
        "chunk_id", "doc_id", "source", "target", "relation_type", "position", F.concat_ws(" ", "source", "relation_type", "target").alias("description"),
        F.lit(1.0).alias("weight"), "confidence", "source_raw", "target_raw", *keep,
    )


def mentions(chunks: DataFrame, ends_too: bool = True, unique: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entities of each chunk, ``chunk_id, doc_id, canonical_name, name, entity_type, confidence, ord``.

    Of equal names in one chunk the first counts: organisations, technologies, metrics, then the
    ends of relations that are long enough. Ends come last and are concepts or metrics, so that
    organisations and technologies are the same without them (``ends_too``), and no relation is
    looked for. Where no two rows of ``chunks`` have the same chunk and document (``unique``), a
    row holds all mentions of its chunk, nothing is shuffled, and columns to ``keep`` come last.
    """
    if keep and not unique:
        raise ValueError("columns are kept of unique rows only")

    noted = annotated(chunks.select("chunk_id", "doc_id", "text", *keep), ends_too) if "entries" not in chunks.columns else chunks
    rows = noted.select("chunk_id", "doc_id", *keep, F.explode("entries").alias("e"))
    if unique:
        return rows.select("chunk_id", "doc_id", "e.canonical_name", "e.name", "e.entity_type", "e.confidence", "e.ord", *keep)
    first = rows.groupBy("chunk_id", "doc_id", F.col("e.canonical_name").alias("canonical_name")).agg(F.min(F.struct("e.ord", "e.name", "e.entity_type", "e.confidence")).alias("e"))
    return first.select("chunk_id", "doc_id", "canonical_name", "e.name", "e.entity_type", "e.confidence", "e.ord")


def merge_entities(mentions: DataFrame, unique: bool = False) -> DataFrame:
    """One row per name: attributes of its first mention, numbers of its chunks and documents.

    A chunk belongs to one document where rows are ``unique``: then chunks are counted without
    their ids, and a name's first mention is looked for among those of each of its spellings.
    """
    if unique:
        spelling = ("ord", "name", "entity_type", "confidence")
        # numbers only are kept for each group, so that tasks add up in place what they read of it
        each = mentions.groupBy("canonical_name", F.col("chunk_id").isNull().alias("no_chunk"), *spelling).agg(F.min("chunk_id").alias("chunk_id"), F.count("chunk_id").alias("n"))
        e = each.groupBy("canonical_name").agg(F.min(F.struct("chunk_id", *spelling)).alias("e"), F.sum("n").alias("n_chunks"))
        docs = mentions.select("canonical_name", "doc_id").distinct().groupBy("canonical_name").agg(F.count("doc_id").alias("n_docs"))
        merged = e.join(docs, "canonical_name")
        return merged.select("canonical_name", "e.name", "e.entity_type", "e.confidence", "n_chunks", "n_docs", F.col("e.chunk_id").alias("first_chunk"))
    first = F.min(F.struct("chunk_id", "ord", "name", "entity_type", "confidence")).alias("e")
    merged = mentions.groupBy("canonical_name").agg(first, F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))
    return merged.select("canonical_name", "e.name", "e.entity_type", "e.confidence", "n_chunks", "n_docs", F.col("e.chunk_id").alias("first_chunk"))


def entity_parts(mentions: DataFrame, key: list[str]) -> DataFrame:
    """What the documents of one bucket say of each name: ``canonical_name, doc_bucket, e, n_chunks, n_docs``.

    A chunk has one row for a name. Groups hold numbers only, which tasks add up in place: the first
    mention is looked for among those of each spelling, documents are counted beside it.
    """
    spelling = ("ord", "name", "entity_type", "confidence")
    each = mentions.groupBy(*key, "doc_bucket", *spelling).agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("n"))
    first = each.groupBy(*key, "doc_bucket").agg(F.min(F.struct("chunk_id", *spelling)).alias("e"), F.sum("n").alias("n_chunks"))
    docs = mentions.select(*key, "doc_bucket", "doc_id").distinct().groupBy(*key, "doc_bucket").agg(F.count("*").alias("n_docs"))
    return first.join(docs, [*key, "doc_bucket"]).select(*key, "doc_bucket", "e", "n_chunks", "n_docs")


def entities_of_parts(parts: DataFrame, key: list[str]) -> DataFrame:
    """``merge_entities`` from the parts of all buckets; a document is in one of them only."""
    merged = parts.groupBy(*key).agg(F.min("e").alias("e"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_docs").alias("n_docs"))
    return merged.select(*key, "e.name", "e.entity_type", "e.confidence", "n_chunks", "n_docs", F.col("e.chunk_id").alias("first_chunk"))


def relation_parts(relations: DataFrame, key: list[str]) -> DataFrame:
    """The last relation of each source, target and type in the documents of one bucket, as ``r``.

    Of equal rows but for the chunk a task keeps the number of the last chunk, in place.
    """
    rest = ("position", "description", "weight", "confidence")
    each = relations.groupBy(*key, "doc_bucket", *rest).agg(F.max("chunk_id").alias("chunk_id"))
    return each.groupBy(*key, "doc_bucket").agg(F.max(F.struct("chunk_id", *rest)).alias("r"))


def relations_of_parts(parts: DataFrame, key: list[str]) -> DataFrame:
    """``merge_relations`` from the parts of all buckets."""
    return parts.groupBy(*key).agg(F.max("r").alias("r")).select(*key, "r.description", "r.weight", "r.confidence")


def entity_sources(mentions: DataFrame) -> DataFrame:
    """``canonical_name, source, id``: the chunks and the documents of each entity, each once.

    The lists of a merged entity as rows: those of a common name are as long as the corpus.
    """
    of = lambda source: mentions.select("canonical_name", F.lit(source).alias("source"), F.col(f"{source}_id").alias("id")).distinct()
    return of("chunk").unionByName(of("doc"))


def question_seeds(queries: DataFrame) -> DataFrame:
    """``query_id, ord, seed`` of ``queries(query_id, question)``.

    All entities that the patterns find in a question, ends of relations included, in the order
    of mentions; where there is none, its first capitalised words.
    """
    asked = queries.select(F.col("query_id").alias("chunk_id"), F.col("query_id").alias("doc_id"), F.col("question").alias("text"))
    found = mentions(asked).select(F.col("chunk_id").alias("query_id"), F.struct("ord", "canonical_name").alias("m"))
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    some = F.transform("m", lambda x: x["canonical_name"])
    seeds = queries.join(lists, "query_id", "left").select("query_id", F.when(F.col("m").isNotNull(), some).otherwise(seeds_by_capitals(F.col("question"))).alias("s"))
    return seeds.select("query_id", F.posexplode("s").alias("ord", "seed")).filter("seed <> ''")


def merge_relations(relations: DataFrame) -> DataFrame:
    """One edge per source, target and type; the last chunk's description, weight and confidence.

    Of equal rows but for the chunk a task keeps the number of the last chunk, in place.
    """
    key, rest = ("source", "target", "relation_type"), ("position", "description", "weight", "confidence")
    each = relations.groupBy(*key, *rest).agg(F.max("chunk_id").alias("chunk_id"))
    last = F.max(F.struct("chunk_id", *rest)).alias("r")
    return each.groupBy(*key).agg(last).select(*key, "r.description", "r.weight", "r.confidence")
