"""The replay of bounded caches against a plain walk over the log."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import cache_key
from tessera.operators import query_cache

ASKED = "at long, text string"


def plain(keys, capacity, start=()):
    cache, out = OrderedDict.fromkeys(start), []
    for k in keys:
        hit, gone = k in cache, None
        if not hit:
            if len(cache) >= capacity:
                gone = cache.popitem(last=False)[0]
            cache[k] = None
        out.append((hit, gone))
    return out, list(cache)


def texts(seed, n, kinds, hot=0.3):
    r = random.Random(seed)
    return ["hot" if r.random() < hot else f"q{int(kinds * r.random() ** 2)}" for _ in range(n)]


@pytest.mark.parametrize("capacity", [1, 7, 400])
def test_replay_equals_a_walk_in_one_piece(spark, capacity):
    keys = texts(capacity, 700, 60)
    log = spark.createDataFrame([(n, k) for n, k in enumerate(keys)], ASKED).repartition(5)
    for start in ([], ["q1", "q999"][:capacity]):
        out, held = query_cache.replay(log, ("at",), F.col("text"), capacity, start, segment=50)
        want, left = plain(keys, capacity, start)
        got = out.orderBy("at").collect()
        assert [(r.position, r.cache_key, r.hit, r.evicted_key) for r in got] == [(n, k, *w) for n, (k, w) in enumerate(zip(keys, want))]
        assert held.first()["keys"] == left


def test_caches_that_never_fill_and_new_keys_take_one_or_two_rounds(spark):
    for keys, capacity, most in ((texts(1, 600, 40), 100, 1), ([f"n{n}" for n in range(600)], 20, 2)):
        log = query_cache.numbered(spark.createDataFrame(list(enumerate(keys)), ASKED), F.col("text"), ("at",))
        held, rounds = query_cache.states(log, capacity, 50, [])
        assert rounds <= most and held.count() == 13
        assert {r.segment: list(r["keys"]) for r in held.collect()} == {s: plain(keys[: s * 50], capacity)[1] for s in range(13)}


def test_nulls_ties_repeats_empty_logs_and_clashing_names(spark):
    rows = [(None, None, "x"), (None, None, "x"), (1, "", "y"), (1, "b", "y"), (1, "a" * 300_000, "z"), (1, "b", "y"), (2, None, "w")]
    log = spark.createDataFrame(rows, "at long, text string, hit string")
    out, held = query_cache.replay(log, ("at",), F.col("text"), 2)
    assert out.columns == ["at", "text", "position", "cache_key", "hit", "evicted_key"]
    keys = ["", "", "", "a" * 300_000, "b", "b", ""]
    assert [(r.cache_key, r.hit, r.evicted_key) for r in out.orderBy("position").collect()] == [(k, *w) for k, w in zip(keys, plain(keys, 2)[0])]
    none, held = query_cache.replay(log.limit(0), ("at",), F.col("text"), 2, ["k"])
    assert none.count() == 0 and held.first()["keys"] == ["k"]
    with pytest.raises(ValueError):
        query_cache.replay(log, ("at",), F.col("text"), 1, ["a", "b"])


def test_stream_carries_keys_from_batch_to_batch(spark, tmp_path):
    keys = texts(4, 240, 50)
    for n in range(4):
        part = [(at, k) for at, k in enumerate(keys)][n * 60 : n * 60 + 60]
        spark.createDataFrame(part, ASKED).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    for n in range(4):
        asked = spark.readStream.schema(ASKED).parquet(f"{tmp_path}/in/[0-{n}]")
        query_cache.replay_stream(asked, ("at",), "text", f"{tmp_path}/out", f"{tmp_path}/log", 12, 20).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/rows")
    want = plain([r.k for r in spark.createDataFrame(list(enumerate(keys)), ASKED).orderBy("at").select(cache_key(F.col("text")).alias("k")).collect()], 12)[0]
    assert [(r.hit, r.evicted_key) for r in got.orderBy("at").collect()] == want
    assert got.select("batch").distinct().count() == 4
