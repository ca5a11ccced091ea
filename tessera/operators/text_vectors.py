"""Learned vectors of texts: a randomised singular value decomposition of hashed terms.

A text is a row of a matrix: words (lower case, letters and digits) are hashed to ``buckets``, a
bucket that occurs c times weighs ``(1 + ln c) * (1 + ln((n + 1) / (d + 1)))`` with d of n texts
holding it, and rows are scaled to length 1. The leading right singular vectors of that matrix are
found by subspace iteration with some columns over: each pass multiplies by A'A in tasks, which
hold one dense block of ``buckets`` rows, and adds the blocks up by bucket in Spark. The driver
holds blocks of ``buckets * (rank + OVER)`` numbers (10 MB by default) whatever the corpus.

All rows take part in the fit. Runs agree to rounding errors of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch, stored

OVER = 16
ENTRIES = 50_000


def hashed(text: Column, buckets: int) -> Column:
    """The buckets of a text's words, in order; none for a null text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def _rows(lists: pa.Array, idf: np.ndarray):
    """Slices of texts as ``(texts, row, bucket, weight)``, entries by row and bucket, rows of length 1."""
    n = len(idf)
    sizes = np.diff(lists.offsets.to_numpy())
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        # at least one text; a text has at most as many entries as there are buckets
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right")))
        flat = lists.slice(at, upto - at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        key, count = np.unique(np.repeat(np.arange(upto - at), sizes[at:upto]) * n + flat, return_counts=True)
        row, bucket = key // n, key % n
        weight = (1 + np.log(count)) * idf[bucket]
        length = np.sqrt(np.bincount(row, weight**2, upto - at))
        yield upto - at, row, bucket, weight / np.where(length > 0, length, 1)[row]
        at = upto


def _times(texts: int, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The slice's rows times ``q``."""
    out = np.zeros((texts, q.shape[1]))
    edge = np.searchsorted(row, np.arange(texts + 1))
    for r in range(texts):
        a, b = edge[r], edge[r + 1]
        out[r] = weight[a:b] @ q[bucket[a:b]]
    return out


def _gram(rows: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'A times ``q``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((idf, q))
    width = q.shape[1]

    def partial(batches):
        idf, q = shared.value
        total = np.zeros_like(q)
        for batch in batches:
            for texts, row, bucket, weight in _rows(batch.column(0), idf):
                placed = _times(texts, row, bucket, weight, q)
                edge = np.searchsorted(row, np.arange(texts + 1))
                for r in range(texts):
                    a, b = edge[r], edge[r + 1]
                    total[bucket[a:b]] += weight[a:b, None] * placed[r]  # buckets of a text are distinct
        some = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(some), 1024):
            of = some[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(list(total[of]), pa.list_(pa.float64()))], ["bucket", "part"])

    # as many blocks as the cluster has cores, not as there are files
    parts = rows.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(partial, "bucket int, part array<double>")
    summed = parts.groupBy("bucket").agg(F.array(*(F.sum(F.col("part")[i]) for i in range(width))).alias("part"))
    out = np.zeros_like(q)
    for r in summed.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.part
    shared.destroy()
    return out


@dataclass
class TextVectors:
    """``idf`` of each bucket, and a ``basis`` of as many rows, a column for each component."""

    idf: np.ndarray
    basis: np.ndarray

    def column(self, text: Column) -> Column:
        """A text's vector of length 1, as ``embed`` of the pipelines; zeros without known words."""
        idf, basis = self.idf, self.basis

        @F.pandas_udf("array<double>")
        def place(words):
            lists = pa.array(list(words), pa.list_(pa.int32()))
            out = [_times(*part, basis) for part in _rows(lists, idf)]
            x = np.concatenate(out) if out else np.zeros((0, basis.shape[1]))
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            return pd.Series(list(x / np.where(length > 1e-12, length, 1)))

        place.__annotations__ = {}
        return place(hashed(text, len(idf)))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(b, float(self.idf[b]), self.basis[b].tolist()) for b in range(len(self.idf))]
        spark.createDataFrame(rows, "bucket int, idf double, part array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextVectors:
        rows = sorted(spark.read.parquet(path).collect())
        return TextVectors(np.array([r.idf for r in rows]), np.array([r.part for r in rows]))


def fit(texts: DataFrame, rank: int = 64, buckets: int = 1 << 14, passes: int = 3) -> TextVectors:
    """Vectors of ``rank`` components from the column ``text`` of all rows.

    Null and empty texts have no words and no say, repeated rows count as often as they stand, and
    other columns are ignored. Components beyond the rank of the matrix are zero, all of them for
    an empty table.
    """
    with scratch(texts.sparkSession):
        rows = stored(texts.select(hashed(F.col("text"), buckets).alias("words")).filter(F.size("words") > 0))
        n = rows.count()
        idf = np.zeros(buckets)
        for r in rows.select(F.explode(F.array_distinct("words")).alias("bucket")).groupBy("bucket").count().collect():
            idf[r[0]] = np.log((n + 1) / (r[1] + 1)) + 1
        q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((buckets, min(rank + OVER, buckets))))
        if n:
            for _ in range(passes):
                q, _ = np.linalg.qr(_gram(rows, idf, q))
            q_next = _gram(rows, idf, q)
            value, turn = np.linalg.eigh((q.T @ q_next + q_next.T @ q) / 2)
            turn, value = turn[:, ::-1][:, :rank], value[::-1][:rank]
            basis = q @ turn * (value > 1e-10 * max(value[0], 1e-300))
        else:
            basis = np.zeros((buckets, min(rank, buckets)))
    # a component's sign is free: the largest entry is positive
    top = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
    return TextVectors(idf, basis * np.where(top < 0, -1, 1))
