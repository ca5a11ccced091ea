"""Gazetteer and full-text index against brute force."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from tessera.operators import fulltext, gazetteer


def test_gazetteer_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    names = sorted({word() for _ in range(60)})
    texts = [(n, " ".join(word() for _ in range(rng.randint(0, 40)))) for n in range(120)] + [(120, None), (121, ""), (5, "ab ab")]
    chunks = spark.createDataFrame([(i, t, "x") for i, t in texts], "chunk_id long, text string, canonical_name string").repartition(3)
    known = spark.createDataFrame([(n,) for n in [*names, "", None, names[0]]], "canonical_name string")
    want = []
    for i, t in texts:
        for n in names:
            places = [k for k in range(len(t or "")) if t.startswith(n, k)]
            if places:
                want.append((i, n, places[0] + 1, len(places)))
    for block in (gazetteer.BLOCK, 7):
        got = [tuple(r) for r in gazetteer.occurrences(chunks, known, block).collect()]
        assert sorted(got) == sorted(want)
    assert len(gazetteer.name_blocks(known, 7)) > 3
    # packed, since workers keep them
    assert all(isinstance(b.value, bytes) for b in gazetteer.name_blocks(known, 7))
    assert gazetteer.occurrences(chunks, known.limit(0)).count() == 0 and gazetteer.occurrences(chunks.limit(0), known).count() == 0


@pytest.mark.parametrize("few_hashes", (False, True))
def test_gazetteer_hashes_texts_once_for_all_blocks(monkeypatch, few_hashes):
    """Places that may be names are found once, whatever the number of blocks, and names of one hash are told apart."""
    rng = random.Random(9)
    if few_hashes:
        monkeypatch.setattr(gazetteer._Hashes, "_mixed", lambda self, x, size: (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(61)) << np.uint64(61))
    monkeypatch.setattr(gazetteer, "PART", 300)
    word = lambda most: "".join(rng.choice("abcé😀 ") for _ in range(rng.randint(1, most)))
    names = sorted({word(20) for _ in range(300)} | {"ab" * 50, "a"})
    texts = [word(60) + rng.choice(names) + word(9) + rng.choice(("", "ab" * 51)) for _ in range(80)]
    size = np.array([len(n) for n in names])
    may, at = gazetteer._Known({s: int((size == s).sum()) for s in set(size.tolist())}), np.cumsum(size) - size
    hashes = gazetteer._Hashes(gazetteer._points("".join(names)))
    may.add(hashes, at, size)
    h = hashes.of(at, size)
    want = sorted((i, n, t.index(n) + 1, sum(t.startswith(n, k) for k in range(len(t)))) for i, t in enumerate(texts) for n in names if n in t)
    searched, places = [], gazetteer._Known.places
    monkeypatch.setattr(gazetteer._Known, "places", lambda self, points, ends: searched.append(len(points)) or places(self, points, ends))
    for n in (1, 2, 40):
        searched.clear()
        of = gazetteer._block_of(h, n)
        blocks = [SimpleNamespace(value=gazetteer._packed([x for x, b in zip(names, of) if b == i], h[of == i])) for i in range(n)]
        held = gazetteer._Texts(may)
        for i, t in enumerate(texts):
            held.add(i, t)
        got = [(int(i), x, int(first), int(k)) for text, name, at_, times in held.named(blocks) for i, x, first, k in zip(text, name.to_pylist(), at_, times)]
        assert sorted(got) == want
        assert sum(searched) == sum(map(len, texts)) and (few_hashes or sum(len(f[0]) for f in held.found) < 3 * sum(w[3] for w in want))


def plain_bm25(texts, question):
    of = lambda t: re.findall(fulltext.TERM, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    docs = {i: of(t) for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, d in docs.items():
        tf, score = Counter(d), 0.0
        for term in set(of(question)):
            df = sum(term in set(x) for x in docs.values())
            if tf[term]:
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(d) / mean))
        if any(tf[t] for t in set(of(question))):
            out[i] = round(score, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_equals_plain_scores(spark):
    rng = random.Random(7)
    lexicon = [f"w{n}" for n in range(60)]
    texts = {n: " ".join(rng.choices(lexicon, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 60))) for n in range(700)}
    texts |= {1000: None, 1001: "W1, w1; w2 " * 3, 1002: "w3 " * 500}
    chunks = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "chunk_id long, text string, length int")
    index = fulltext.build(chunks, block=8, shard=300)
    assert index.postings.select("shard").distinct().count() == 3
    asked = {1: "w1 w59", 2: "w0", 3: "w7 w8 w9 W7", 4: "nothing here", 5: "", 6: "w58 w57 w0 w1 w2"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, question string")
    for k in (1, 5, 1000):
        got = {}
        for r in fulltext.top_k(index, queries, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        assert got == {q: w[:k] for q, t in asked.items() if (w := plain_bm25(texts, t))}
    few = {r.query_id: r for r in fulltext.skipped(index, queries, 1).collect()}
    assert 0 < few[6].skipped < few[6].blocks
    assert sum(r.skipped for r in fulltext.skipped(index, queries, 1000).collect()) == 0
    empty = fulltext.build(chunks.limit(0))
    assert fulltext.top_k(empty, queries).count() == 0


def test_blocks_are_packed_without_loss():
    for x in ([0], [255], [256, 1], [70_000, 3], [1 << 40], []):
        raw = fulltext.packed(np.array(x, np.int64))
        assert fulltext.unpacked(raw).tolist() == x and len(raw) <= 1 + 8 * len(x)


def test_a_shard_hands_on_k_of_equal_scores(spark):
    rows = [(i, "same words here" if i % 4 else "other words") for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(5)
    index = fulltext.build(chunks, block=16, shard=200)
    shards = index.numbers.select("shard").distinct().count()
    queries = spark.createDataFrame([(1, "same"), (2, "words other"), (3, "here SAME")], "query_id long, question string")
    found = fulltext._searched(index, queries, 5).collect()
    assert len(found) <= 3 * shards * 5
    got = {}
    for r in fulltext.top_k(index, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: [1, 2, 3, 5, 6], 2: [0, 4, 8, 12, 16], 3: [1, 2, 3, 5, 6]}


def test_shards_are_inverted_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    texts = {n: " ".join(rng.choices([f"é{i}" for i in range(40)], k=rng.randint(0, 300))) for n in range(120)} | {500: None}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3)
    asked = {1: "é1 é2 É3 x", 2: "é39", 3: "é5-é6"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, question string")
    whole = fulltext._pack
    monkeypatch.setattr(fulltext, "_pack", lambda block, mean: whole(block, mean, 100))
    index = fulltext.build(chunks, block=8, shard=50)
    assert index.postings.groupBy("shard", "term").count().filter("count > 3").count() > 0
    got = {}
    for r in fulltext.top_k(index, queries, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert got == {q: w[:7] for q, t in asked.items() if (w := plain_bm25(texts, t))}
    assert sorted(r.chunk_id for r in index.numbers.collect()) == sorted(texts)


def test_runs_are_packed_as_each_alone():
    x, begin = np.array([3, 300, 1, 70_000, 1 << 40, 0]), np.array([0, 0, 2, 3, 4, 6])
    got = fulltext._all_packed(x, begin).to_pylist()
    assert got == [fulltext.packed(x[a:z]) for a, z in zip(begin, [*begin[1:], 6])]
