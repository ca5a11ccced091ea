"""Exact cosine search of a batch of queries, and the vector store's upsert."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024  # vectors of a block


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; zero rows stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def _packed(batches, keys: tuple[str, str]):
    """Blocks of vectors of one length: ``dim, shard, ids, rows``, numbered within the task."""
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            size = np.array([len(e) for e in part.column("embedding")], np.int64)
            for dim in np.unique(size):
                rows = part.filter(pa.array(size == dim))
                x = _unit(rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array([int(dim)]), pa.array([n]), pa.array([rows.column(keys[0]).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dim", "n", *keys[1].split()])
                n += 1


def _blocks(vectors: DataFrame, key: str, ids: str, rows: str) -> DataFrame:
    known = vectors.select(key, "embedding").filter(F.col(key).isNotNull() & F.col("embedding").isNotNull())
    return known.mapInArrow(lambda batches: _packed(batches, (key, f"{ids} {rows}")), f"dim long, n long, {ids} binary, {rows} binary")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k most similar vectors of each query.

    Both sides, ``queries(query_id, embedding)`` and ``vectors(vec_id, embedding)``, are packed in
    blocks of unit vectors. Blocks of vectors are dealt over shards and blocks of queries go to
    every shard, an equi-join that Spark turns into a broadcast of the queries where their size
    allows it, and else shuffles. A pair of blocks is one matrix product; each task hands on k
    rows a query. Nothing runs while the plan is made. Scores are rounded before they are ranked,
    ties go to the smaller id. A zero vector, on either side, has similarity 0. Rows with a null
    vector, or of another dimension than the query, take no part.
    """
    shards = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _blocks(vectors, "vec_id", "ids", "rows").withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
    asked = _blocks(queries, "query_id", "q_ids", "q_rows").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).drop("n")
    found = dealt.drop("n").join(asked, ["dim", "shard"]).mapInArrow(_search(k, digits), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(k: int, digits: int):
    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        least: dict[int, float] = {}  # the k-th score of each query that has so many
        for batch in batches:
            for dim, ids, rows, q_ids, q_rows in zip(*(batch.column(c) for c in ("dim", "ids", "rows", "q_ids", "q_rows"))):
                d = dim.as_py()
                ids, q_ids = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(q_ids.as_py(), np.int64)
                x, q = (np.frombuffer(v.as_py()).reshape(len(n), d) for v, n in ((rows, ids), (q_rows, q_ids)))
                score = q @ x.T
                known = q_ids.tolist()
                # most blocks hold nothing for most queries; half a digit and what rounding loses is allowed for
                none = score.max(axis=1, initial=-np.inf) < np.array([least.get(query, -np.inf) for query in known]) - 0.51 * 10.0**-digits
                for n in np.flatnonzero(~none).tolist():
                    query, i, s = known[n], ids, np.round(score[n], digits) + 0.0
                    if len(s) > k:  # what ties with the k-th stays
                        near = s >= np.partition(s, len(s) - k)[len(s) - k]
                        i, s = i[near], s[near]
                    if query in best:
                        i, s = np.append(best[query][0], i), np.append(best[query][1], s)
                    best[query] = _best(i, s, k)
                    if len(best[query][1]) >= k:
                        least[query] = float(best[query][1][-1])
        q = np.repeat(np.array(list(best), np.int64), [len(i) for i, _ in best.values()])
        i = np.concatenate([i for i, _ in best.values()]) if best else np.empty(0, np.int64)
        s = np.concatenate([s for _, s in best.values()]) if best else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, ids that repeat included: the store that never looks back."""
    return stored.unionByName(new)


def upsert(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both by ``key``, the one with the largest ``version``: the last write wins.

    An aggregation, so that each task keeps one row a key before anything is shuffled; of rows of
    one version that with the largest other columns is taken.
    """
    both = stored.unionByName(new)
    rest = [c for c in both.columns if c not in (key, version)]
    last = both.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("r"))
    return last.select(*(F.col(key) if c == key else F.col(f"r.{c}") for c in both.columns))


def with_payload(hits: DataFrame, chunks: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Hits joined to their chunks after the top-k; ``keep_missing`` fills defaults in."""
    joined = hits.join(chunks, hits["vec_id"] == chunks["chunk_id"], "left" if keep_missing else "inner")
    if keep_missing:
        joined = joined.withColumns({"chunk_id": F.coalesce("chunk_id", "vec_id"), "text": F.coalesce("text", F.lit(""))})
    return joined


def pseudo_embedding(width: int = 64):
    """Pandas UDF: a unit vector that only depends on the text, for runs without a model."""

    @F.pandas_udf("array<double>")
    def embed(texts):
        import hashlib

        numbers = np.random.RandomState(0)  # seeded again for each text; a new one would ask the system for randomness first

        def one(t):
            numbers.seed(int(hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest()[:8], 16))
            v = numbers.randn(width)
            return v / np.linalg.norm(v)

        return texts.map(one)

    embed.__annotations__ = {}
    return embed
