"""Near duplicates by b-bit MinHash (Li and Koenig 2010).

One pass over the texts computes ``PERMUTATIONS`` minima per document. Rows of ``ROWS`` full
minima are hashed to band keys; of the minima themselves only two bits of a mix stay, packed in
six longs. Documents that share a band key are candidates. Bit counts of the packed signatures
give their collision-corrected similarity, and what lies far below the threshold goes; all other
candidates are confirmed on their full shingle sets, computed again from the texts.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^38 = 3e-7, and its bit
counts fall short by more than ``SLACK`` with probability 2.3e-6.

No bucket is expanded into all its pairs. Documents with equal shingle sets are one class. First
every class is held against one class of each of its buckets only: that with most company in its
own buckets, which in a family of copies lies close to the original. A bucket whose classes are
in one component then has no more to tell. For the classes of the other buckets, pairs between
different components are looked up by prefix: at similarity t two sets share one of the
``n - ceil(t n) + 1`` rarest shingles of each, so that members of one family, whose rare shingles
are their own edits, don't meet again. Neither step loses a link that joins two components.

A class that very many others are held against (a hub) has its text on several tasks, over which
the others are dealt.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, fresh, handing_back, hot_keys, mix64, salted_join, scratch, shingle_set, stored
from tessera.llm.components import connected_components

BANDS, ROWS, PERMUTATIONS = 38, 5, 192
LANES = 32  # two-bit lanes of a long
LONGS = PERMUTATIONS // LANES
#: Five standard deviations of the estimate at similarity 0.8.
SLACK = 0.17
#: Counters of the sketch of shingle frequencies.
CELLS = 1 << 18


def _family() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20240613)
    a = r.randint(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a[:, None], r.randint(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (mix64(s) >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        h = a * x[i : i + 1024]
        h += b
        np.minimum(low, h.min(axis=1), out=low)
    return low


def _bands(low: np.ndarray) -> np.ndarray:
    m = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    k = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
    return k.view(np.int64)


def _packed(low: np.ndarray) -> np.ndarray:
    # mixed: the low bits of a * x + b, a odd, agree in all lanes alike
    two = (mix64(low.astype(np.uint64)) & np.uint64(3)).reshape(LONGS, LANES)
    return (two << (np.arange(LANES, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _signatures(shingle: int):
    def run(batches):
        import xxhash

        hashes, (a, b) = WordHashes(), _family()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, key, sig, bands = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, shingle, hashes)
                    n.append(len(s))
                    if not len(s):
                        key.append(None), sig.append(None), bands.append(None)
                        continue
                    low = _minima(s, a, b)
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(_packed(low))
                    bands.append(_bands(low))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("tkey"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                    ["row", "doc_id", "tkey", "n_shingles", "key", "sig", "bands"],
                )

    return run


def _estimate(s: Column, t: Column) -> Column:
    """Similarity by bit counts: lanes that agree, less the quarter that agrees by chance."""
    differ = None
    for i in range(LONGS):
        x = s[i].bitwiseXOR(t[i])
        d = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = d if differ is None else differ + d
    agree = (PERMUTATIONS - differ) / F.lit(float(PERMUTATIONS))
    return (agree - 0.25) / 0.75


def _plausible(x: str, y: str, num: int, den: int) -> Column:
    nx, ny = F.col(f"{x}_n"), F.col(f"{y}_n")
    return (den * F.least(nx, ny) >= num * F.greatest(nx, ny)) & (_estimate(F.col(f"{x}_sig"), F.col(f"{y}_sig")) >= num / den - SLACK)


def _confirm(shingle: int, num: int, den: int):
    def run(batches):
        hashes, kept = WordHashes(), OrderedDict()

        def full(node, text):
            if node in kept:
                kept.move_to_end(node)
                return kept[node]
            s = kept[node] = shingle_set(text, shingle, hashes)
            while len(kept) > 64:
                kept.popitem(last=False)
            return s

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                u, v, tu, tv = (batch.column(c).slice(at, 256).to_pylist() for c in ("hub", "other", "hub_text", "other_text"))
                out = []
                for i in range(len(u)):
                    s, t = full(u[i], tu[i]), full(v[i], tv[i])
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if den * both >= num * (len(s) + len(t) - both):
                        out.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in out], pa.int64()), pa.array([v[i] for i in out], pa.int64())], ["u", "v"])

    return run


def _cell_counts(shingle: int):
    """``(cell, n)``: how many of a task's sets hold a shingle of each cell of the sketch."""

    def run(batches):
        hashes, count = WordHashes(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(count, (shingle_set(text.as_py(), shingle, hashes) % np.uint64(CELLS)).astype(np.int64), 1)
        cell = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count[cell])], ["cell", "n"])

    return run


def _packed_cells(batches):
    for batch in batches:
        both = np.stack([batch.column(c).to_numpy() for c in ("cell", "n")])
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], ["cells"])


def _prefixes(shingle: int, num: int, den: int, sketch):
    def run(batches):
        hashes, count = WordHashes(), sketch.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingle_set(t, shingle, hashes) for t in part.column("text").to_pylist()]
                out = []
                for s in sets:
                    s = s[np.lexsort((s, count[(s % np.uint64(CELLS)).astype(np.int64)]))]
                    out.append(s[: len(s) + (-num * len(s)) // den + 1])
                size = [len(x) for x in out]
                of = lambda values: pa.array(np.repeat(np.array(values, np.int64), size))
                place = np.concatenate([np.arange(k, dtype=np.int64) for k in size])
                yield pa.RecordBatch.from_arrays(
                    [of(part.column("node").to_pylist()), of(part.column("comp").to_pylist()), of([len(s) for s in sets]), pa.array(place), pa.array(np.concatenate(out).view(np.int64))],
                    ["node", "comp", "n", "pos", "sh"],
                )

    return run


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(float(np.log(1.05)))).cast("int")


def _between(rest: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Pairs ``(u, v)`` of ``rest(node, comp)`` from different components that share a rare shingle.

    Shingles are ordered by a sketch of their numbers of sets (``CELLS`` counters, broadcast), then
    by hash; any order that is the same for all sets loses nothing, and in a large family of copies
    the shingles of the original stand out of the sketch. A pair's first common shingle, at places
    p and q of the two sets, leaves at most ``min(n_u - p, n_v - q)`` common ones; it must reach
    the overlap that the similarity asks for. Of the sets with a prefix shingle those outside its
    largest component are held against all others, by classes of the partner's size, for which the
    bound is known before the join.
    """
    held = texts.join(rest, "node")
    cells = held.select("text").mapInArrow(handing_back(_cell_counts(shingle)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    count = np.zeros(CELLS, np.int64)
    for r in cells.mapInArrow(handing_back(_packed_cells), "cells binary").collect():
        cell, n = np.frombuffer(r[0], np.int64).reshape(2, -1)
        count[cell] = n
    sketch = rest.sparkSession.sparkContext.broadcast(count)
    pre = stored(held.select("node", "comp", "text").mapInArrow(handing_back(_prefixes(shingle, num, den, sketch)), "node long, comp long, n long, pos long, sh long"))
    sketch.unpersist()
    per = pre.groupBy("sh", "comp").agg(F.count("*").alias("n")).groupBy("sh").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"))
    pre = pre.join(per.filter("comps > 1").select("sh", F.col("top.comp").alias("major")), "sh")

    n, least = F.col("u_n"), F.ceil(F.pow(F.lit(1.05), F.col("size"))) - 1
    least = F.greatest(least, F.ceil(num * n / F.lit(den)))
    sizes = F.sequence(_size_class(F.ceil(num * n / F.lit(den))), _size_class(F.floor(den * n / F.lit(num))))
    probe = pre.filter("comp != major").select("sh", F.col("node").alias("u"), F.col("comp").alias("u_comp"), F.col("n").alias("u_n"), F.col("pos").alias("u_pos"))
    probe = probe.withColumn("size", F.explode(sizes)).filter((num + den) * (F.col("u_n") - F.col("u_pos")) >= num * (F.col("u_n") + least))
    index = pre.select("sh", _size_class(F.col("n")).alias("size"), F.col("node").alias("v"), F.col("comp").alias("v_comp"), F.col("n").alias("v_n"), F.col("pos").alias("v_pos"))
    left = F.least(F.col("u_n") - F.col("u_pos"), F.col("v_n") - F.col("v_pos"))
    pairs = probe.join(index, ["sh", "size"]).filter((F.col("u_comp") != F.col("v_comp")) & ((num + den) * left >= num * (F.col("u_n") + F.col("v_n"))))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, tkey, n_shingles, component_id, kept, group``.

    Documents are linked if ``den * |A and B| >= num * |A or B|`` for their sets of distinct
    ``shingle``-word shingles; ``component_id`` is the smallest doc_id of a document's connected
    component. ``tkey`` is xxhash64 of the text and tells rows of one doc_id apart; ``group`` is a
    number of the component, equal for its rows only.

    Null or wordless texts have no shingles and are alone in their component. Rows without
    doc_id take part in links; a component of such rows only has a null ``component_id`` and
    keeps them all. Repeated rows come back as often as they went in. Columns besides ``doc_id``
    and ``text`` are ignored. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as s:
        sigs, by_key = _components(docs, shingle, num, den)
        s.keep(sigs, by_key)
    rows = sigs.select("row", "doc_id", "tkey", "n_shingles", "key")
    placed = salted_join(rows.filter("n_shingles > 0"), by_key, "key", hot_keys(rows, "key")).select("doc_id", "tkey", "n_shingles", "component_id", "group")
    alone = rows.filter("n_shingles = 0").select("doc_id", "tkey", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("group"))
    return placed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components(docs: DataFrame, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``row, doc_id, tkey, n_shingles, key, ...`` and components ``key, component_id, group``, both stored."""
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    sigs = stored(
        base.withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "tkey", "text")
        .mapInArrow(handing_back(_signatures(shingle)), "row long, doc_id long, tkey long, n_shingles long, key binary, sig array<long>, bands array<long>")
    )
    classes = stored(sigs.filter("n_shingles > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_doc")))
    reps = sigs.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    band = reps.select(F.col("row").alias("node"), F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    # these sides grow with the corpus: no plan that fits small inputs only
    member = stored(band.join(shared.hint("merge"), "band"))
    company = member.groupBy("node").agg(F.sum("n").alias("company"))
    light = stored(
        reps.join(company.withColumnRenamed("node", "row"), "row").select(
            F.col("row").alias("node"), "doc_id", "tkey", F.col("n_shingles").alias("n"), "sig", "company"
        )
    )
    want = light.select("node", F.col("doc_id").alias("w_id"), F.col("tkey").alias("w_key"))
    texts = base.join(want.hint("merge"), (F.col("tkey") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]))

    def sided(x: str) -> DataFrame:
        return light.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sig").alias(f"{x}_sig"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(hub, other)`` that reach the similarity, as ``(u, v)``."""
        pairs = stored(pairs)
        hot = hot_keys(pairs, "hub").persist()
        near = salted_join(pairs.join(sided("other").hint("merge"), "other"), sided("hub"), "hub", hot, by="other").filter(_plausible("hub", "other", num, den)).select("hub", "other")
        side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"))
        both = salted_join(near.join(side("other").hint("merge"), "other"), side("hub"), "hub", hot, by="other")
        out = stored(both.mapInArrow(handing_back(_confirm(shingle, num, den)), "u long, v long"))
        hot.unpersist()
        return out

    # every class against the one with most company of each of its buckets
    leader = member.join(light.select("node", "company"), "node").groupBy("band").agg(F.max(F.struct("company", -F.col("node"))).alias("top"))
    stars = member.join(leader.select("band", (-F.col("top.col2")).alias("leader")), "band").filter("node != leader")
    # two classes may lead each other in different buckets
    low, high = F.least("node", "leader"), F.greatest("node", "leader")
    stars = stars.groupBy(low.alias("u"), high.alias("v")).agg(F.min("leader").alias("hub"))
    links = confirmed(stars.select("hub", F.when(F.col("hub") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("other")))
    comps = stored(connected_components(links))

    # classes of buckets that still hold several components: pairs between them
    placed = member.join(comps, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band")
    rest = stored(placed.join(mixed, "band", "left_semi").select("node", "comp").distinct())
    across = _between(rest, texts, shingle, num, den)
    more = confirmed(across.select(F.col("u").alias("hub"), F.col("v").alias("other")))
    if not more.isEmpty():
        comps = stored(connected_components(comps.filter("node != comp").select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(more)))

    named_class = stored(classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    first = named_class.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
    by_key = stored(salted_join(named_class, first, "comp", hot_keys(named_class, "comp")).select("key", "component_id", F.col("comp").alias("group")))
    return sigs, by_key


def deduplicated(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the smallest id.

    Rows without id come last; among rows of one id the smallest ``tkey`` decides, and of rows
    that repeat id and text one stays. Of texts without words all stay but such repetitions.
    Columns may have any names besides ``doc_id`` and ``text``; an empty table stays empty.
    """
    found = near_duplicates(docs, shingle, num, den)
    place = lambda key: F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), key.alias("text"))
    name = fresh(docs, "place")
    first = found.groupBy("group").agg(F.min(place(F.col("tkey"))).alias(name)).select(name)
    named = docs.withColumn(name, place(F.xxhash64("text")))
    return named.join(first, name, "left_semi").dropDuplicates([name]).drop(name)
