"""A full-text index of chunks: postings in compressed blocks, and BM25 search that skips blocks.

Chunks are dealt over shards by a hash of their id, and a term's postings of a shard are sorted by
number and cut into blocks. A block has the numbers as steps, frequencies and lengths in as few
bytes as its largest value needs, and the largest share of a score that any of its postings can
give. A search cuts a shard's numbers where blocks begin or end: the blocks of a span bound the
scores of its chunks, spans are taken from the highest bound on, and once the k-th best score is
above the next bound no further block is decoded.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import stored

K1, B = 1.2, 0.75
BLOCK = 128  # postings of a block
SHARD = 1 << 13  # chunks of a shard, about
POSTINGS = 1 << 22  # that a task inverts at once
QUERIES = 256  # that are searched together, about
DIGITS = 6

#: Terms are runs of letters and digits with A-Z lower-cased; of other characters than ASCII all count.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


# --- blocks -----------------------------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them all, which the first byte names."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or x.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def share(tf: np.ndarray, length: np.ndarray, mean_length: float) -> np.ndarray:
    """What a posting gives to a score, but for the term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


_HELD = "shard int, no long, chunk_id {}, term string, first long, last long, n long, steps binary, tfs binary, lengths binary, most double"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _counted(batches):
    """Rows ``chunk_id, text`` as ``chunk_id, length, terms, tfs``: a text's distinct terms, with spaces between, and their counts."""
    for batch in batches:
        lengths, words, tfs = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            count = Counter((text or b"").translate(_LOWER).split())
            lengths.append(count.total())
            words.append(b" ".join(count))
            tfs.append(packed(np.fromiter(count.values(), np.int64, len(count))))
        yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(lengths, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(tfs, pa.binary())], ["chunk_id", "length", "terms", "tfs"])


def _all_packed(x: np.ndarray, begin: np.ndarray) -> pa.Array:
    """``packed`` of each run of ``x`` from one of ``begin`` to the next; runs may be empty."""
    size = np.diff(np.append(begin, len(x)))
    most = np.zeros(len(begin), np.int64)
    most[size > 0] = np.maximum.reduceat(x, begin[size > 0]) if len(x) else 0
    width = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    offsets = np.append(0, np.cumsum(1 + size * width))
    out = np.empty(offsets[-1], np.uint8)
    out[offsets[:-1]] = width
    wide = np.repeat(width, size)
    at = np.repeat(offsets[:-1] + 1 - begin * width, size) + np.arange(len(x)) * wide
    for w in np.unique(width).tolist():
        of = np.flatnonzero(wide == w)
        raw = x[of].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
        for byte in range(w):
            out[at[of] + byte] = raw[:, byte]
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _inverted(shard: int, no: np.ndarray, tf: np.ndarray, length: np.ndarray, texts: pa.Array, block: int, mean_length: float, schema: pa.Schema):
    """Blocks of the postings of ``texts``, whose terms have rows in ``no``, ``tf`` and ``length``, as batches of ``schema``."""
    coded = pc.split_pattern(texts, " ").flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")  # numbers ascend within a term
    code, no, tf, length = code[order], no[order], tf[order], length[order]
    run = np.flatnonzero(np.diff(code, prepend=-1))
    nth = np.arange(len(code)) - np.repeat(run, np.diff(np.append(run, len(code))))
    begin = np.flatnonzero(nth % block == 0)
    n = np.diff(np.append(begin, len(code)))
    inner = np.ones(len(code), bool)
    inner[begin] = False
    rows = {
        "shard": pa.array(np.full(len(begin), shard, np.int32)),
        "term": coded.dictionary.take(pa.array(code[begin])),
        "first": pa.array(no[begin]),
        "last": pa.array(no[begin + n - 1]),
        "n": pa.array(n),
        "steps": _all_packed(np.diff(no, prepend=0)[inner], begin - np.arange(len(begin))),
        "tfs": _all_packed(tf, begin),
        "lengths": _all_packed(length, begin),
        "most": pa.array(np.maximum.reduceat(share(tf, length, mean_length), begin)),
    }
    yield from _batches(rows, len(begin), schema)


def _batches(rows: dict, n: int, schema: pa.Schema):
    whole = pa.RecordBatch.from_arrays([rows[c].cast(schema.field(c).type) if c in rows else pa.nulls(n, schema.field(c).type) for c in schema.names], schema=schema)
    for at in range(0, n, 10_000):
        yield whole.slice(at, 10_000)


def _pack(block: int, mean_length: float, most: int = POSTINGS):
    """Rows ``chunk_id, terms, tfs`` of one shard, by id: a row for the number of each chunk, and the shard's blocks.

    Blocks are made of at most ``most`` postings at once, or of those of one chunk.
    """

    def run(batches):
        shard, seen, held = TaskContext.get().partitionId(), 0, []
        schema = None

        def flushed():
            no, tfs, texts = (np.concatenate([h[0] for h in held]), [t for h in held for t in h[1]], pa.concat_arrays([h[2] for h in held]))
            sizes = np.array([len(t) for t in tfs])
            lengths = np.array([t.sum() for t in tfs])
            held.clear()
            yield from _inverted(shard, np.repeat(no, sizes), np.concatenate(tfs), np.repeat(lengths, sizes), texts, block, mean_length, schema)

        waiting = 0
        for batch in batches:
            kind = batch.schema.field("chunk_id").type
            schema = schema or pa.schema([(c, t) for c, t in zip([x.split()[0] for x in _HELD.split(", ")], (pa.int32(), pa.int64(), kind, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()))])
            no = np.arange(seen, seen + batch.num_rows) + 1
            seen += batch.num_rows
            yield from _batches({"shard": pa.array(np.full(len(no), shard, np.int32)), "no": pa.array(no), "chunk_id": batch.column("chunk_id")}, len(no), schema)
            tfs = [unpacked(raw) for raw in batch.column("tfs").to_pylist()]
            ends, at = np.cumsum([len(t) for t in tfs]), 0
            while at < len(tfs):
                before = ends[at - 1] if at else 0
                upto = int(np.searchsorted(ends, before + most - waiting, "right"))
                if upto <= at:
                    if held:
                        yield from flushed()
                        waiting = 0
                        continue
                    upto = at + 1  # a chunk of more postings than that
                some = [i for i in range(at, upto) if len(tfs[i])]
                if some:
                    held.append((no[some], [tfs[i] for i in some], batch.column("terms").take(pa.array(some))))
                    waiting += int(ends[upto - 1] - before)
                at = upto
        if held:
            yield from flushed()

    return run


@dataclass(frozen=True)
class Index:
    """``postings(shard, term, first, last, n, steps, tfs, lengths, most)``, ``weights(term, weight)`` and
    ``numbers(shard, no, chunk_id)``, stored tables."""

    postings: DataFrame
    weights: DataFrame
    numbers: DataFrame
    mean_length: float


def build(chunks: DataFrame, block: int = BLOCK, shard: int = SHARD) -> Index:
    """The index of ``chunks(chunk_id, text)``; ids are unique, null and empty texts have no terms.

    A task counts the terms of each text; counts are dealt over shards by id and sorted there, and
    one task inverts a shard, ``POSTINGS`` at a time.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    sized = stored(chunks.select("chunk_id", F.col("text").cast("string")).mapInArrow(_counted, f"chunk_id {kind}, length long, terms string, tfs binary"))
    n, mean = sized.agg(F.count("*"), F.avg("length")).first()
    mean = float(mean or 1.0)
    dealt = sized.select("chunk_id", "terms", "tfs").repartition(max(1, -(-n // shard)), "chunk_id").sortWithinPartitions("chunk_id")
    held = stored(dealt.mapInArrow(_pack(block, mean), _HELD.format(kind)))
    numbers = held.filter("term IS NULL").select("shard", "no", "chunk_id")
    postings = held.filter("term IS NOT NULL").drop("no", "chunk_id")
    df = postings.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Index(postings, stored(df.select("term", weight.alias("weight"))), numbers, mean)


# --- search -----------------------------------------------------------------------------------


def best_of_shard(first: np.ndarray, last: np.ndarray, bound: np.ndarray, postings, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers and scores of the ``k`` best chunks among blocks, and how many blocks were read; ties go to the smaller number.

    Blocks go from number ``first`` to ``last`` and give a chunk at most ``bound``; ``postings(i)`` has a
    block's numbers and what each adds to its score. Spans are read in rounds, twice as many in each.
    """
    edges = np.unique(np.concatenate([first, last + 1]))
    # bounds of the spans between edges: blocks come in at their first number and go after their last
    begin, end = np.searchsorted(edges, first), np.searchsorted(edges, last + 1)
    change = np.bincount(begin, bound, len(edges)) - np.bincount(end, bound, len(edges))
    limit = np.cumsum(change)[:-1] + 1e-9
    order = np.argsort(-limit, kind="stable")
    ranked = -limit[order]
    read = np.zeros(len(first), bool)
    found_no, found_score = np.empty(0, np.int64), np.empty(0)
    least, at, round_ = -np.inf, 0, max(1, len(order) // 32)
    while at < len(order):
        # no span whose bound is below the k-th best score
        upto = min(at + round_, int(np.searchsorted(ranked, -(least - 10.0**-DIGITS), "right")))
        if upto <= at:
            break
        now = np.zeros(len(order), bool)
        now[order[at:upto]] = True
        before = np.append(0, np.cumsum(now))
        some = np.flatnonzero(before[end] > before[begin])
        read[some] = True
        parts = [postings(i) for i in some.tolist()]
        no, gain = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        inside = now[np.searchsorted(edges, no, "right") - 1] if upto - at < len(order) else slice(None)
        no, gain = no[inside], gain[inside]
        if len(no):  # else between blocks
            low = int(no.min())
            score = np.bincount(no - low, gain)
            each = np.flatnonzero(np.bincount(no - low))
            found_no, found_score = np.append(found_no, each + low), np.append(found_score, np.round(score[each], DIGITS))
        if len(found_no) >= k:
            least = np.partition(found_score, len(found_score) - k)[len(found_score) - k]
            found_no, found_score = found_no[keep := found_score >= least], found_score[keep]
        at, round_ = upto, 2 * round_
    best = np.lexsort((found_no, -found_score))[:k]
    return found_no[best], found_score[best], int(read.sum())


def _search(k: int, mean_length: float):
    """The best chunks of a shard for a group of queries; blocks are decoded once for all of them."""

    def run(key, blocks, asked):
        first, last, most = (blocks[c].to_numpy() for c in ("first", "last", "most"))
        steps, tfs, lengths = (blocks[c].to_numpy() for c in ("steps", "tfs", "lengths"))
        of_term = blocks.groupby("term").indices
        asked = asked[asked["term"].isin(of_term.keys())]
        weight = np.zeros(len(blocks))
        for term, w in zip(asked["term"], asked["weight"]):
            weight[of_term[term]] = w
        decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def postings(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in decoded:
                no = first[i] + np.append(0, np.cumsum(unpacked(steps[i])))
                decoded[i] = no, weight[i] * share(unpacked(tfs[i]), unpacked(lengths[i]), mean_length)
            return decoded[i]

        out = [pd.DataFrame({"query_id": [], "shard": [], "no": [], "score": [], "blocks": [], "decoded": []})]
        for query, of in asked.groupby("query_id"):
            held = np.concatenate([of_term[t] for t in of["term"]])
            no, score, n = best_of_shard(first[held], last[held], most[held] * weight[held], lambda i, held=held: postings(held[i]), k)
            out.append(pd.DataFrame({"query_id": query, "shard": key[1], "no": no, "score": score, "blocks": len(held), "decoded": n}))
        return pd.concat(out[1:] or out)

    return run


def _searched(index: Index, queries: DataFrame, k: int) -> DataFrame:
    groups = max(1, -(-queries.count() // QUERIES))
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term")).distinct().join(index.weights, "term").select(group, "query_id", "term", "weight")
    asked = stored(asked)
    blocks = index.postings.join(asked.select("group", "term").distinct(), "term").select("group", *index.postings.columns)
    # other names than those of the blocks' columns, which come from the same tables
    everywhere = asked.crossJoin(F.broadcast(index.numbers.select(F.col("shard").alias("at")).distinct())).select(F.col("group").alias("of"), "at", "query_id", "term", "weight")
    kind = queries.schema["query_id"].dataType.simpleString()
    met = blocks.groupBy("group", "shard").cogroup(everywhere.groupBy("of", "at"))
    return met.applyInPandas(_search(k, index.mean_length), f"query_id {kind}, shard int, no long, score double, blocks long, decoded long")


def top_k(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, chunk_id, score``: the ``k`` chunks of highest BM25 for each of ``queries(query_id, question)``.

    Scores are rounded before they are ranked, ties go to the smaller id; a term that a question
    repeats counts once. Chunks without any of the terms are no hits. A shard's blocks of the terms
    of a group of questions meet in one task, once however many of them share a term, which hands on
    the best of each; no task has more than a shard.
    """
    found = _searched(index, queries, k).join(index.numbers, ["shard", "no"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def skipped(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, blocks, skipped``: blocks of a question's terms, and those that were not decoded."""
    each = _searched(index, queries, k).groupBy("query_id", "shard").agg(F.max("blocks").alias("blocks"), F.max("decoded").alias("decoded"))
    return each.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.col("blocks") - F.col("decoded")).alias("skipped"))
