import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.near_dup import deduplicated, near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, k1 string, place string, salt long, hub long"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, "clash", "mine", "own", 5, 6) for d, t in rows], SCHEMA)


def shingles(text, size):
    ws = (text or "").encode().lower().split()
    return {tuple(ws)} if 0 < len(ws) < size else {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if ws else set()


def brute(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    first = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in comp}
    return {(d, len(s), first[c], d == first[c]) for (d, _), s, c in zip(rows, sets, comp)}


@pytest.mark.parametrize("size", [2, 5])
def test_families_equal_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=55)
    rows = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 150]))
        for _ in range(rng.choice([1, 2, 15])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 9))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
        rows.append(" ".join(passage + rng.choices(vocabulary, k=60)))
    rows += ["", None, "one", "One ", "two words", " \n", "x " * 5000, rows[0].upper(), rows[3]]
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    got = near_duplicates(docs(spark, rows), shingle=size)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, size)
    assert {r.doc_id for r in deduplicated(docs(spark, rows), size).collect()} == {d for d, _, _, kept in brute(rows, size) if kept}


def test_short_pairs_at_the_threshold(spark):
    """Nine words and the first eight of them: 4 of 5 shingles are common."""
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        ws = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(ws[:8]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert [d for d, _ in rows if got[d] != d - d % 2] == []


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g"
    rows = [(5, text), (5, text), (5, "other words here and more"), (None, text), (None, "alone in this group"), (None, "alone in this group")]
    got = near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (-1, 5, False), (5, 5, True), (5, 5, True), (5, 5, True)]
    kept = deduplicated(docs(spark, rows)).collect()
    assert {(r.key, r.k1, r.place, r.salt, r.hub) for r in kept} == {("clash", "mine", "own", 5, 6)}
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "alone in this group"), (5, text), (5, "other words here and more")]


def test_empty_table(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    assert deduplicated(docs(spark, [])).columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_components_of_chain_star_and_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 300), (5, 4)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r.node, r.comp) for r in got} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)} | {(i, 200) for i in range(200, 207)}


def test_hub_and_copies_are_dealt_over_tasks(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(i, " ".join(base[:k] + [f"edit{i}"] + base[k + 1 :])) for i, k in ((i, rng.randrange(80)) for i in range(60))]
    rows += [(100 + i, " ".join(base)) for i in range(40)] + [(200 + i, "") for i in range(30)] + [(300, "some other text that stays alone")]
    got = near_duplicates(docs(spark, rows))
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, 5)
    pairs = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 1)], "k long, v long")
    hot = common.hot_keys(pairs, "k")
    assert [(r.k, r.parts) for r in hot.collect()] == [(1, 10)]
    one = spark.createDataFrame([(1, "a"), (3, "c")], "k long, t string")
    assert sorted(r.v for r in common.salted_join(pairs, one, "k", hot).collect()) == list(range(100))
    assert common.salted_join(pairs, one, "k", hot, "left").count() == 101


def test_dealing_by_hash_does_not_depend_on_order(spark):
    """A task that runs again may read its rows in another order, and must deal them alike."""
    from tessera.llm import common

    pairs = spark.range(200).selectExpr("1L AS k", "id AS v").repartition(3)
    hot = spark.createDataFrame([(1, 8)], "k long, parts int")
    one = spark.createDataFrame([(1, "a")], "k long, t string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = []
        for order in (F.asc("v"), F.desc("v")):
            out = common.salted_join(pairs.sortWithinPartitions(order), one, "k", hot, by="v")
            dealt.append({r.v: r.p for r in out.select("v", F.spark_partition_id().alias("p")).collect()})
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert dealt[0] == dealt[1] and len(dealt[0]) == 200 and len(set(dealt[0].values())) > 1
