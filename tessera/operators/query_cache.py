"""Replay of a bounded cache over a log of questions: which of them it holds, and what it lets go.

The cache lets the key go that came in first, however often it was asked for since. What it holds
is thus a state of at most ``capacity`` keys, in the order they came in, and a log can be replayed
in segments at once where the state at the start of each is known. Those states are guessed, first
from the keys that come first in the log, and then taken from the walks of the segments before,
until each segment started from what the one before it ended with. Walks double in length with
each round, so that there are no more rounds than the logarithm of the number of segments. Where
questions seldom repeat, states of any start soon agree; where the cache never fills, the first
guess is right. Only keys and positions go through tasks in Python, one state a task at a time.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import cache_key
from tessera.sources.scratch import delete, exists, scratch, stored

# Fixed value: keys that the cache of questions holds.
CAPACITY = 10_000
# Questions a segment holds at least; it also holds two states' worth, so that states are at most half of the log.
SEGMENT = 8_192


def numbered(asked: DataFrame, key: Column, order: tuple[str, ...]) -> DataFrame:
    """``position, key, row`` of all rows by ``order``, from 0, in a stored table.

    Nulls come first, and rows alike in ``order`` stand by key. The driver sees one number a
    partition of the sort.
    """
    sort = [F.col(f"row.{c}").asc_nulls_first() for c in order] + [F.col("key")]
    at = asked.select(key.alias("key"), F.struct(*asked.columns).alias("row")).orderBy(*sort).withColumn("id", F.monotonically_increasing_id())
    kept = stored(at)
    part = F.shiftright("id", 33)
    before, total = [], 0
    for p, n in sorted(map(tuple, kept.groupBy(part).count().collect())):
        before.append((p, total))
        total += n
    starts = kept.sparkSession.createDataFrame(before, "part long, before long")
    out = kept.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("position"), "key", "row")
    out.total, out.stored_at = total, kept.stored_at
    return out


def _walk(capacity: int, length: int, ends: bool):
    """Walks over chunks of the log, each of which begins with a row that holds its first state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, segment = OrderedDict(), None
        for frame in frames:
            done, rows = [], []
            for position, key, keys in zip(frame["position"], frame["key"], frame["keys"]):
                if ends and segment is not None and (keys is not None or position // length != segment):
                    done.append((segment, list(cache)))
                if keys is not None:
                    cache, segment = OrderedDict.fromkeys(keys), None
                    continue
                segment = position // length
                hit, gone = key in cache, None
                if not hit:
                    if len(cache) >= capacity:
                        gone = cache.popitem(last=False)[0]
                    cache[key] = None
                if not ends:
                    rows.append((position, hit, gone))
            yield pd.DataFrame(done, columns=["segment", "keys"]) if ends else pd.DataFrame(rows, columns=["position", "hit", "evicted_key"])
        if ends and segment is not None:
            yield pd.DataFrame([(segment, list(cache))], columns=["segment", "keys"])

    return run


def _chunks(log: DataFrame, starts: DataFrame, length: int, width: int) -> DataFrame:
    """The rows of chunks of ``width`` segments, in order within a partition, each after its first state."""
    none = F.lit(None).cast("array<string>")
    chunk = lambda x: F.floor(x / width).cast("long").alias("chunk")
    rows = log.select(chunk(F.floor(F.col("position") / length)), "position", "key", none.alias("keys"))
    first = starts.filter(F.col("segment") % width == 0).select(chunk(F.col("segment")), F.lit(-1).cast("long").alias("position"), F.lit(None).cast("string").alias("key"), "keys")
    return rows.unionByName(first).repartition("chunk").sortWithinPartitions("chunk", "position").select("position", "key", "keys")


def _first_guess(log: DataFrame, capacity: int, length: int, start: list[str]) -> DataFrame:
    """``segment, keys``: the first keys of the log that come before a segment, right until the cache is full."""
    spark = log.sparkSession
    held = spark.createDataFrame([(k,) for k in start], "key string")
    new = log.groupBy("key").agg(F.min("position").alias("position")).join(F.broadcast(held), "key", "left_anti")
    new = new.orderBy("position").limit(max(capacity - len(start), 0)).agg(F.sort_array(F.collect_list(F.struct("position", "key"))).alias("new"))
    # one row of at most ``capacity`` keys
    segments = spark.range(-(-log.total // length)).select(F.col("id").alias("segment"), F.lit(1).alias("one"))
    met = segments.join(F.broadcast(new.withColumn("one", F.lit(1))), "one")
    before = F.transform(F.filter("new", lambda x: x["position"] < F.col("segment") * length), lambda x: x["key"])
    begun = spark.createDataFrame([(1, start)], "one int, begun array<string>")
    return met.join(F.broadcast(begun), "one").select("segment", F.concat("begun", before).alias("keys"))


def states(log: DataFrame, capacity: int, length: int, start: list[str]) -> tuple[DataFrame, int]:
    """``segment, keys``: what the cache holds where each segment starts, one more for the log's end; and the rounds it took."""
    spark, width, rounds = log.sparkSession, 1, 1
    first = spark.createDataFrame([(0, start)], "segment long, keys array<string>")
    guess = stored(_first_guess(log, capacity, length, start))
    while True:
        walked = _chunks(log, guess, length, width).mapInPandas(_walk(capacity, length, True), "segment long, keys array<string>")
        ended = stored(walked.select((F.col("segment") + 1).alias("segment"), "keys").unionByName(first))
        told = guess.filter(F.col("segment") % width == 0).select("segment", F.col("keys").alias("told"))
        if ended.join(told, "segment").filter(F.col("keys") != F.col("told")).isEmpty():
            return ended, rounds
        guess, width, rounds = ended, 2 * width, rounds + 1


def replay(asked: DataFrame, order: tuple[str, ...], key: Column, capacity: int = CAPACITY, start: list[str] | None = None, segment: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``asked`` with ``position, cache_key, hit, evicted_key``, and the keys held at the end as ``keys``.

    A question is a hit if its key is held; else its key comes in, and if ``capacity`` keys are
    held the one that came in first goes: ``evicted_key``. ``start`` are keys held at the
    beginning, at most ``capacity``, the oldest first. Questions stand in the order of ``order``,
    nulls first, ties by key, so that rows alike in both count as any order of them. A null key
    counts as ''. Columns of ``asked`` that are named as one of the four give way. An empty log
    leaves ``start`` as it is. ``segment`` is the number of questions a segment holds.
    """
    start = list(start or [])
    if capacity < 1 or len(start) > capacity:
        raise ValueError("the capacity must be at least 1 and hold the first keys")
    spark, length = asked.sparkSession, segment or max(SEGMENT, 2 * capacity)
    with scratch(spark) as s:
        log = numbered(asked, F.coalesce(key, F.lit("")), order)
        if log.total:
            held, _ = states(log, capacity, length, start)
        else:
            held = stored(spark.createDataFrame([(0, start)], "segment long, keys array<string>"))
        s.keep(log, held)
    last = -(-log.total // length)
    walked = _chunks(log, held.filter(F.col("segment") < last), length, 1).mapInPandas(_walk(capacity, length, False), "position long, hit boolean, evicted_key string")
    made = ("position", "cache_key", "hit", "evicted_key")
    out = log.withColumnRenamed("key", "cache_key").join(walked, "position")
    return out.select(*(F.col("row")[c].alias(c) for c in asked.columns if c not in made), *made), held.filter(F.col("segment") == last).select("keys")


def replay_stream(asked: DataFrame, order: tuple[str, ...], text: str, folder: str, checkpoint: str, capacity: int = CAPACITY, segment: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Replays a stream of questions, micro-batch by micro-batch, into Parquet below ``folder``/rows.

    The keys held after a micro-batch are stored with it, below ``folder``/held, and the next one
    starts from them. A micro-batch that runs again starts from the same keys and replaces its
    rows. Within a micro-batch questions stand by ``order``. Both folders are shared ones.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before, start = f"{folder}/held/{number - 1}", []
        if number and exists(spark, before):
            start = list(spark.read.parquet(before).first()["keys"])
        with scratch(spark):
            out, held = replay(rows, order, cache_key(F.col(text)), capacity, start, segment)
            out.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            held.coalesce(1).write.mode("overwrite").parquet(f"{folder}/held/{number}")
        delete(spark, f"{folder}/held/{number - 2}")

    writer = asked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
