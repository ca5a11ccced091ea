"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased, with each run of white space as one space. An item of m characters is in
a document if some region of it is within ``k = m * RATE`` edits (rounded down) of the item. Such
a region shares at least ``m + 1 - q * (k + 1)`` q-grams with the item, on diagonals (position in
the document less position in the item) at most k apart. So shared q-grams are counted in diagonal
bands of 2 (k + 1) that overlap by half; bands that reach the bound are verified by a banded
alignment of the item against their region. An item's q is ``Q``, or less where the bound would
be below 1: ``min(Q, m // (k + 1))``. The filter loses no region within the budget. Items of less
than ``Q`` characters, for which k is 0, are looked for as whole words.

The index of the benchmark is broadcast in blocks of at most ``BLOCK_CHARS`` characters, so that
its size is bounded however long the benchmark is; documents are mapped without a shuffle. With
several blocks each one's result is written before the next is built.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, handing_back, scratch, stored

Q = 8
RATE = 0.1
BLOCK_CHARS = 4_000_000
CHUNK_CHARS = 500_000
_B = 0x9E3779B97F4A7C15 | 1


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(c: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of each window of q code points."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    x = c[: len(c) - q + 1].astype(np.uint64)
    if q == 8:  # three doublings
        x = c.astype(np.uint64)
        for n in (1, 2, 4):
            x = x[:-n] * np.uint64(pow(_B, n, 2**64)) + x[n:]
    else:
        for n in range(1, q):
            x = x * np.uint64(_B) + c[n : len(c) - q + 1 + n]
    return x * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """Q-grams of a block of items, by their q and by classes of similar length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, len(t), int(len(t) * RATE)) for i, t in items if t]
        self.budget = np.array([k for *_, k in self.items], np.int64)
        self.length = np.array([m for _, _, m, _ in self.items], np.int64)
        by_q: dict[int, list[int]] = {}
        for n, (_, _, m, k) in enumerate(self.items):
            by_q.setdefault(min(Q, m // (k + 1)), []).append(n)
        self.parts = [Part(self, q, members) for q, members in sorted(by_q.items())]

    def candidates(self, c: np.ndarray):
        """``(item number, lowest diagonal)`` of the bands that reach their bound; c: code points."""
        for part in self.parts:
            yield from part.candidates(c, self)


class Part:
    """The items of one q."""

    def __init__(self, index: Index, q: int, numbers: list[int]):
        self.q = q
        classes: dict[int, list[int]] = {}
        for n in numbers:
            classes.setdefault(int(np.log(index.items[n][2]) / np.log(1.25)), []).append(n)
        self.classes, every = [], [np.empty(0, np.uint64)]
        for members in classes.values():
            g = [_grams(_codes(index.items[n][1]), q) for n in members]
            grams = np.concatenate(g)
            item = np.repeat(np.array(members, np.int64), [len(x) for x in g])
            pos = np.concatenate([np.arange(len(x), dtype=np.int64) for x in g])
            order = np.argsort(grams, kind="stable")
            m, k = max(index.items[n][2] for n in members), max(index.items[n][3] for n in members)
            least = min(index.items[n][2] + 1 - q * (index.items[n][3] + 1) for n in members)
            self.classes.append((grams[order], item[order], pos[order], m + k - q + 1, least))
            every.append(grams)
        self.grams = np.unique(np.concatenate(every))
        bits = max(16, int(np.ceil(np.log2(64 * max(1, len(self.grams))))))
        self.shift = np.uint64(64 - min(bits, 26))
        self.seen = np.zeros(1 << min(bits, 26), bool)
        self.seen[self.grams >> self.shift] = True

    def candidates(self, c: np.ndarray, index: Index):
        g = _grams(c, self.q)
        at = np.flatnonzero(self.seen[g >> self.shift])
        h = g[at]
        if len(self.grams):
            known = self.grams[np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)] == h
            at, h = at[known], h[known]
        for grams, item, pos, span, least in self.classes:
            if len(at) < least:
                continue
            # hits in windows with as many hits as the bound asks for
            first = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < span)
            if not len(first):
                continue
            edge = np.zeros(len(at) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + least, -1)
            live = np.cumsum(edge[:-1]) > 0
            a, x = at[live], h[live]
            lo, hi = np.searchsorted(grams, x, "left"), np.searchsorted(grams, x, "right")
            n = hi - lo
            a, lo, n = a[n > 0], lo[n > 0], n[n > 0]
            if not len(a):
                continue
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            it = item[entry]
            width = index.budget[it] + 1
            cell = (np.repeat(a, n) - pos[entry] + len(c)) // width
            key, where = it << np.int64(40) | cell, pos[entry]
            order = np.lexsort((where, key))
            key, where = key[order], where[order]
            new = np.append(True, (key[1:] != key[:-1]) | (where[1:] != where[:-1]))
            # distinct positions of the item in each cell, then in each band of two cells
            key, count = np.unique(key[new], return_counts=True)
            follows = key[1:] == key[:-1] + 1
            pair = count + np.append(np.where(follows, count[1:], 0), 0)
            alone = np.append(True, ~follows)
            key, count = np.append(key, key[alone] - 1), np.append(pair, count[alone])
            i = key >> np.int64(40)
            enough = count >= index.length[i] + 1 - self.q * (index.budget[i] + 1)
            for i, band in zip(i[enough].tolist(), (key[enough] & ((1 << 40) - 1)).tolist()):
                yield i, band * int(index.budget[i] + 1) - len(c)


def banded(item: np.ndarray, region: np.ndarray, k: int, low: int, width: int) -> tuple[int, int, int]:
    """Fewest edits between the item and a part of the region, with the part's start and end.

    Only diagonals ``low .. low + width - 1`` (region position less item position) are filled.
    Returns (k + 1, 0, 0) if more than k edits are needed.
    """
    big = k + 1
    d = np.arange(low, low + width)
    cost = np.where((d >= 0) & (d <= len(region)), 0, big)
    start = np.clip(d, 0, len(region))
    steps = np.arange(width)
    for i in range(len(item)):
        j = d + i  # region position that a match would consume
        ok = (j >= 0) & (j < len(region))
        same = np.zeros(width, bool)
        same[ok] = region[j[ok]] == item[i]
        new = cost + ~same
        new[~ok] = big
        begin = start.copy()
        up = np.append(cost[1:] + 1, big)  # the item's character has no partner
        less = up < new
        new[less], begin[less] = up[less], np.append(start[1:], 0)[less]
        new[(j + 1 < 0) | (j + 1 > len(region))] = big
        run = new - steps  # characters of the region without partner
        best = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == best, steps, 0))
        cost, start = np.minimum(best + steps, big), begin[source]
        if cost.min() >= big:
            return big, 0, 0
    j = d + len(item)
    cost = np.where((j >= 0) & (j <= len(region)), cost, big)
    b = int(cost.argmin())
    return (int(cost[b]), int(start[b]), int(j[b])) if cost[b] <= k else (big, 0, 0)


def _whole_words(row: str, text: str, lo: int, hi: int) -> int:
    """Where ``text`` stands in the row, neither within a run of letters and digits; -1 if nowhere."""
    at = row.find(text, lo, hi)
    while at >= 0:
        end = at + len(text)
        inside = at > 0 and row[at - 1].isalnum() and text[0].isalnum() or end < len(row) and row[end].isalnum() and text[-1].isalnum()
        if not inside:
            return at
        at = row.find(text, at + 1, hi)
    return -1


def find(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """``(row, item_id, edits, start, end)``, the best region of each item in each text.

    Starts and ends are positions in the normalised text.
    """
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    rows = [normal(t) for t in texts]
    at = 0
    while at < len(rows):
        upto, size = at, 0
        while upto < len(rows) and (size < CHUNK_CHARS or upto == at):
            size += len(rows[upto]) + 1
            upto += 1
        c = _codes("\0".join(rows[at:upto]) + "\0")
        starts = np.cumsum([0] + [len(r) + 1 for r in rows[at:upto]])
        for i, low in index.candidates(c):
            item_id, text, m, k = index.items[i]
            item = _codes(text)
            # the documents that the band's region touches
            first = max(0, int(np.searchsorted(starts, max(low - k, 0), "right")) - 1)
            last = int(np.searchsorted(starts, min(low + 2 * (k + 1) + m + k, len(c) - 1), "right")) - 1
            for r in range(first, min(last, upto - at - 1) + 1):
                s, e = int(starts[r]), int(starts[r + 1]) - 1
                lo, hi = max(s, low - k), min(e, low + 2 * (k + 1) + m + k)
                if hi - lo < m - k or found.get((at + r, item_id), (m,))[0] == 0:
                    continue
                exact = _whole_words(rows[at + r], text, lo - s, hi - s) if m < Q else rows[at + r].find(text, lo - s, hi - s)
                if exact >= 0:
                    hit = (0, exact, exact + m)
                elif not k:
                    continue
                else:
                    edits, b, f = banded(item, c[lo:hi], k, low - k - lo, 2 * (k + 1) + 2 * k)
                    hit = (edits, b + lo - s, f + lo - s)
                if hit[0] <= k:
                    found[at + r, item_id] = min(hit, found.get((at + r, item_id), hit))
        at = upto
    return [(r, i, *hit) for (r, i), hit in sorted(found.items())]


def origins(text: str) -> np.ndarray:
    """For each character of the normalised text, where it comes from in the text itself."""
    where, space = [], False
    for p, ch in enumerate(text):
        if ch.isspace():
            space = bool(where)
            continue
        if space:
            where.append(p - 1)
            space = False
        where.extend([p] * len(ch.lower()))
    return np.array(where, np.int64)


def original_span(where: np.ndarray | str, start: int, end: int) -> tuple[int, int]:
    """Where a region of the normalised text lies in the text itself; ``where`` are its ``origins``."""
    if isinstance(where, str):
        where = origins(where)
    return int(where[start]), int(where[end - 1]) + 1


def _spans(texts: list[str | None], hits: list[tuple]) -> list[tuple[int, int]]:
    """Spans of hits, which come ordered by text: each text is walked once, however many it holds."""
    out, last, where = [], None, None
    for r, _, _, start, end in hits:
        if r != last:
            last, where = r, origins(texts[r])
        out.append(original_span(where, start, end))
    return out


def _blocks(benchmark: DataFrame):
    """Numbers of blocks, and of each block the broadcast index, built when its turn comes."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 2 * (-(-chars // BLOCK_CHARS) or 1) - 1  # about half full each
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        rows = items.filter(block == b).collect()
        yield n, benchmark.sparkSession.sparkContext.broadcast(Index([(r[0], normal(r[1])) for r in rows]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, start, end``: each item found in each document row, and where.

    ``start`` and ``end`` are positions in the document's own text. Null and empty texts hold no
    item; null and blank items are not looked for. Rows that repeat a document, and items that
    repeat a text, are reported each; of several regions the one with fewest edits, then the
    first, is given. Columns besides ids and texts are ignored. Empty tables give an empty result.
    """

    def search(block):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                    hits = find(texts, block.value)
                    spans = _spans(texts, hits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[h[0]] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())],
                        ["doc_id", "item_id", "edits", "start", "end"],
                    )

        return run

    out = None
    for n, block in _blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(handing_back(search(block)), "doc_id long, item_id long, edits long, start long, end long")
        if n > 1:
            part = stored(part)
            block.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _digest(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of the benchmark is found.

    Null and empty texts stay, repeated rows stay or go alike, and columns may have any names
    besides ``text``. An empty benchmark rejects nothing; an empty table stays empty.

    With several blocks each one stores only digests of the texts it rejects, and the rows are
    filtered once at the end, so that what is written doesn't grow with the number of blocks.
    """

    def marked(block, whole: bool):
        """Rows without a hit, or in place of rows the digests of texts with one."""

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    hit = {h[0] for h in find(part.column("text").to_pylist(), block.value)}
                    chosen = part.filter(pa.array([(r in hit) != whole for r in range(part.num_rows)], pa.bool_()))
                    yield chosen if whole else chosen.select(["digest"])

        return run

    found = []
    with scratch(docs.sparkSession) as s:
        for n, block in _blocks(benchmark):
            if n == 1:
                return docs.mapInArrow(handing_back(marked(block, True)), docs.schema)
            hits = docs.select("text", _digest("text").alias("digest")).mapInArrow(handing_back(marked(block, False)), "digest string")
            found.append(stored(hits))
            block.destroy()
        gone = stored(reduce(DataFrame.unionByName, found).distinct())
        s.keep(gone)
    digest = fresh(docs, "digest")
    return docs.withColumn(digest, _digest("text")).join(gone.withColumnRenamed("digest", digest), digest, "left_anti").drop(digest)
