"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch, shared_dir, stored  # noqa: F401  used by the operators

#: A word is a run of anything but ASCII white space (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOT_ROWS, HOT_KEYS = 2_000, 10_000


def fresh(df: DataFrame, name: str = "x") -> str:
    """A column name that ``df`` lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """``key, parts`` of the keys of very many rows, and over how many tasks to deal each.

    Those are over ``HOT_ROWS`` rows and over one in ``HOT_KEYS`` of all, so that there are less than
    ``HOT_KEYS`` of them at any size and they may be broadcast. ``rows`` is a stored table.
    """
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    n = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return n.select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, how: str = "inner", by: str | None = None) -> DataFrame:
    """``many`` joined to ``one``, which holds each key at most once; rows of hot keys are dealt over tasks.

    They are dealt by the hash of the column ``by``; without one by their place in ``many``, which
    must then be read from a table and not from a shuffle: a task that runs again after an
    executor is lost has to deal its rows as it did before.
    """
    n, salt = fresh(many, "parts"), fresh(many, "salt")
    hot = F.broadcast(hot.withColumnRenamed("parts", n))
    parts = F.coalesce(n, F.lit(1))
    deal = F.xxhash64(by) if by else F.monotonically_increasing_id()
    left = many.join(hot, key, "left").withColumn(salt, F.pmod(deal, parts).cast("int")).drop(n)
    right = one.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return left.join(right.hint("merge"), [key, salt], how).drop(salt)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def handing_back(run):
    """``run`` for mapInArrow, which at its end gives free memory back to the system.

    Python workers serve one task after another, and what allocators keep from one stage would
    come on top of the next one's needs.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)(0)

    return wrapped


def words(text: str | None) -> list[bytes]:
    """Words of ``text`` with A-Z lower-cased; bytes.split and bytes.lower are ASCII-only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, kept for recurring words; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; bijective."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles of ``text``.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter((hashes[w] for w in ws), np.uint64, len(ws))
    n = min(size, len(ws))
    x = mix64(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(x)
