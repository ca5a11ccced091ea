"""Names that are known already, found in texts wherever they stand.

Texts are read once, whatever the number of names: hashes of all places, of 1, 2, 4, ... characters,
tell by a table of bits where a name may begin, and those of the lengths that names have, where one may
stand. What is left, little more than is found, is compared with the names themselves.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch, stored

BLOCK = 200_000  # names of a block, but for twice as many where hashes are uneven
HELD = 16 << 20  # characters of texts that a task holds while one block of names after another is compared with them
PART = 1 << 17  # characters that are hashed at once, but for those of one text
ROWS = 1 << 15  # occurrences that a task hands on at once
BITS = 16  # bits of a table for each name

_BASE = 0x9E3779B97F4A7C15
_UNIT = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, ``base``, ... modulo 2 ** 64, at least ``n`` of them."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        of = np.full(max(n, PART + 1), base, np.uint64)
        of[0] = 1
        _POWERS[base] = np.multiply.accumulate(of)
    return _POWERS[base]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class _Hashes:
    """Hashes of all stretches of some characters, which depend on nothing but the stretch."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], out=self.sums[1:])
        self.units = _powers(_UNIT, n + 1)[: n + 1]

    def _mixed(self, x: np.ndarray, size) -> np.ndarray:
        x += np.asarray(size, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for factor, shift in ((0xBF58476D1CE4E5B9, 32), (0x94D049BB133111EB, 29)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(32)
        return x

    def of(self, at: np.ndarray, size) -> np.ndarray:
        """Those of ``size`` characters from ``at`` on."""
        return self._mixed((self.sums[at + size] - self.sums[at]) * self.units[at], size)

    def every(self, size: int) -> np.ndarray:
        """Those of ``size`` characters from each place on that has so many."""
        return self._mixed((self.sums[size:] - self.sums[:-size]) * self.units[:-size], size)


class _Bits:
    """A table of bits: whether a hash may be one of those that were added."""

    def __init__(self, n: int):
        self.shift = np.uint64(64 - min(30, max(10, (BITS * n - 1).bit_length())))
        self.table = np.zeros(1 << (61 - int(self.shift)), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = hashes >> self.shift
        np.bitwise_or.at(self.table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


class _Known:
    """What may be a name: tables of all hashes, and of the first 1, 2, 4, ... characters, with the lengths that begin so."""

    def __init__(self, sizes: dict[int, int]):
        """``sizes`` has the number of names of each length."""
        self.lengths: dict[int, list[int]] = {}
        for size in sorted(sizes):
            self.lengths.setdefault(1 << (size.bit_length() - 1), []).append(size)
        self.begins = {level: _Bits(sum(sizes[s] for s in of)) for level, of in self.lengths.items()}
        self.whole = _Bits(sum(sizes.values()))

    def add(self, hashes: _Hashes, at: np.ndarray, sizes: np.ndarray) -> None:
        self.whole.add(hashes.of(at, sizes))
        for level, bits in self.begins.items():
            bits.add(hashes.of(at[(sizes >= level) & (sizes < 2 * level)], level))

    def places(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and hashes that may be names; ``ends`` has the end of the text of each character."""
        hashes, found = _Hashes(points), []
        for level, bits in self.begins.items():
            if len(points) < level:
                continue
            begin = np.flatnonzero(bits.holds(hashes.every(level)))
            for size in self.lengths[level]:
                at = begin[begin + size <= ends[begin]]
                h = hashes.of(at, size)
                may = self.whole.holds(h)
                found.append((at[may], np.full(np.count_nonzero(may), size), h[may]))
        return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))


def _hashed(batches):
    """``canonical_name`` with its hash and its length; the hash as a number of 32 bits and the rest."""
    for batch in batches:
        names = batch.column("canonical_name").to_pylist()
        size = np.array([len(n) for n in names], np.int64)
        h = _Hashes(_points("".join(names))).of(np.cumsum(size) - size, size)
        yield pa.RecordBatch.from_arrays([batch.column("canonical_name"), pa.array((h >> np.uint64(32)).astype(np.int64)), pa.array(h.view(np.int64)), pa.array(size)], ["canonical_name", "high", "hash", "size"])


def _block_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The block, of ``n``, of each hash, by its upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(names: list[str], hashes: np.ndarray) -> bytes:
    """The names of a block in order of their hashes, with these."""
    order = np.argsort(hashes, kind="stable")
    names = [names[i] for i in order.tolist()]
    return zlib.compress(pickle.dumps((hashes[order], np.array([len(n) for n in names], np.int64), "".join(names).encode())), 1)


def _dictionary(names: DataFrame, block: int) -> tuple[list, object]:
    """Blocks of the distinct names and what may be one of them, as broadcasts."""
    known = names.select("canonical_name").filter("canonical_name <> ''").distinct()
    context, made = names.sparkSession.sparkContext, []
    with scratch(names.sparkSession):
        known = stored(known.mapInArrow(_hashed, "canonical_name string, high long, hash long, size long"))
        sizes = {r["size"]: r["count"] for r in known.groupBy("size").count().collect()}
        may, n = _Known(sizes), max(1, -(-sum(sizes.values()) // block))
        dealt = known.withColumn("block", F.shiftright(F.col("high") * n, 32))
        for i in range(n):
            part = dealt.filter(F.col("block") == i).select("canonical_name", "hash").toArrow()
            h = part.column("hash").to_numpy().view(np.uint64)
            found = part.column("canonical_name").to_pylist()
            size = np.array([len(x) for x in found], np.int64)
            may.add(_Hashes(_points("".join(found))), np.cumsum(size) - size, size)
            made.append(context.broadcast(_packed(found, h)))
    return made, context.broadcast(zlib.compress(pickle.dumps(may), 1))


def name_blocks(names: DataFrame, block: int = BLOCK) -> list:
    """The distinct names of ``names(canonical_name)`` as broadcasts of bounded size, one read at a time.

    They are broadcast packed, since a worker keeps the value of every block that it has read. Blocks are made by hash; each passes the driver by itself, so that its memory holds one block.
    Null and empty names are left out.
    """
    return _dictionary(names, block)[0]


def _equal(points: np.ndarray, at: np.ndarray, names: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the characters ``at`` some places are those that names ``begin`` with."""
    if not len(at):
        return np.empty(0, bool)
    starts = np.cumsum(sizes) - sizes
    nth = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    same = points[np.repeat(at, sizes) + nth] == names[np.repeat(begin, sizes) + nth]
    return np.logical_and.reduceat(same, starts)


class _Texts:
    """Texts that a task holds, and the places in them that may be names."""

    def __init__(self, may: _Known):
        self.may, self.texts, self.ids, self.size, self.part = may, [], [], 0, 0
        self.points: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.found: list[tuple] = []

    def add(self, chunk, text: str) -> None:
        self.ids.append(chunk)
        self.texts.append(text)
        self.lengths.append(len(text))
        self.part += len(text)
        if self.part >= PART:
            self.search()

    def search(self) -> None:
        """Looks for names in the texts since the last search."""
        if not self.texts:
            return
        points = _points("".join(self.texts))
        lengths = np.array([len(t) for t in self.texts])
        at, sizes, hashes = self.may.places(points, np.repeat(np.cumsum(lengths), lengths))
        self.found.append((at + self.size, sizes, hashes))
        self.points.append(points)
        self.size, self.part, self.texts = self.size + len(points), 0, []

    def named(self, blocks: list):
        """``names, text, name, first, n`` of each block: its names, and which texts hold which."""
        self.search()
        if not self.found:
            return
        points = np.concatenate(self.points)
        at, sizes, hashes = map(np.concatenate, zip(*self.found))
        ends = np.cumsum(self.lengths)
        order = np.argsort(hashes, kind="stable")  # by block, and within it in the order of its names
        limits = np.searchsorted(_block_of(hashes[order], len(blocks)), np.arange(len(blocks) + 1))
        for i, value in enumerate(blocks):
            mine = order[limits[i] : limits[i + 1]]
            if not len(mine):
                continue
            known, length, joined = pickle.loads(zlib.decompress(value.value))
            joined = joined.decode()
            names, begin = _points(joined), np.cumsum(length) - length
            nth, hits = np.searchsorted(known, hashes[mine]), []
            while len(mine):  # names of one hash follow each other
                some = nth < len(known)
                some[some] = known[nth[some]] == hashes[mine[some]]
                mine, nth = mine[some], nth[some]
                same = length[nth] == sizes[mine]
                same[same] = _equal(points, at[mine[same]], names, begin[nth[same]], sizes[mine[same]])
                hits.append((at[mine[same]], nth[same]))
                mine, nth = mine[~same], nth[~same] + 1
            place, name = map(np.concatenate, zip(*hits))
            if not len(place):
                continue
            text = np.searchsorted(ends, place, side="right")
            by = np.lexsort((place, name, text))
            place, name, text = place[by], name[by], text[by]
            new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (name[1:] != name[:-1])))
            first = place[new] - (ends[text[new]] - np.array(self.lengths)[text[new]]) + 1
            used, which = np.unique(name[new], return_inverse=True)
            spelt = pa.array([joined[b : b + n] for b, n in zip(begin[used].tolist(), length[used].tolist())], pa.string())
            yield text[new], spelt.take(pa.array(which)), first, np.diff(np.append(new, len(name)))


def occurrences(chunks: DataFrame, names: DataFrame, block: int = BLOCK) -> DataFrame:
    """``chunk_id, canonical_name, first_at, n_places``: the known names that each text holds, in any place.

    ``chunks(chunk_id, text)``; a name counts wherever its characters stand, within words too and
    overlapping others, as where ends of relations are matched with known entities. ``first_at`` is
    its first place in code points from 1. Each text is read once, whatever the number of names: a
    task holds some texts and the places in them that may be names, by tables of hashes that take
    ``BITS`` bits a name each, and compares these with one block of names after another. Nothing is
    shuffled. Null texts hold no name, rows that repeat are searched each for itself. The blocks are
    made when this is called, the search runs when it is read.
    """
    blocks, may = _dictionary(names, block)

    def run(batches):
        known, kind = None, None

        def found(texts: _Texts):
            ids = pa.array(texts.ids, kind)
            for text, name, first, n in texts.named(blocks):
                rows = pa.RecordBatch.from_arrays([ids.take(pa.array(text)), name, pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["chunk_id", "canonical_name", "first_at", "n_places"])
                yield from (rows.slice(i, ROWS) for i in range(0, rows.num_rows, ROWS))

        for batch in batches:
            if known is None:
                known, kind = pickle.loads(zlib.decompress(may.value)), batch.schema.field("chunk_id").type
                texts = _Texts(known)
            for chunk, text in zip(batch.column("chunk_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                texts.add(chunk, text)
                if texts.size >= HELD:
                    yield from found(texts)
                    texts = _Texts(known)
        if known is not None:
            yield from found(texts)

    kind_of = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text").mapInArrow(run, f"chunk_id {kind_of}, canonical_name string, first_at long, n_places long")
