"""Nearest neighbours by randomly rotated one-bit codes (RaBitQ, Gao and Long 2024).

Vectors are dealt to the nearest of some cells' centres (k-means on a bounded sample; about
``CELL`` vectors a cell, at most ``MOST_CELLS``). A vector less its centre is normalised, padded to
at least ``BITS`` dimensions and rotated; its code is the sign of each rotated component, kept as
packed bits with three scalars (its norm, the inner product with its own code, its number of set
bits). A query is held against its ``PROBES`` nearest cells: less the cell's centre and rotated,
its components are rounded to ``PLANES`` bits, so that its inner product with a code is a weighted
sum of bit counts of the code and each plane. Divided by the second scalar it estimates that with
the vector, within ``EPSILON`` standard deviations of the known error and of the rounding's.

A first pass over the codes hands on the k + 1 vectors of least upper bound of each query and task;
the (k + 1)-th smallest exact distance of those that look nearest is a query's reach. A second
pass finds the vectors whose lower bound is within it, and only those are joined to their
components and reranked by exact distance. Vectors of other dimensions than the query are not
compared. Blocks of codes and of queries meet by an equi-join on cells; codes carry no vectors.

With at most ``PROBES`` cells, that is up to 131,072 vectors, every vector is held against every
query, and only the error bounds decide; beyond that also the probes do.

Equal vectors are coded once. Of their ids the k + 1 smallest are kept, since no others can be
among the k nearest of any query: at equal distance the smaller id comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import handing_back, scratch, stored

BITS, PLANES = 512, 6
EPSILON = 2.5
SAMPLE = 16_384  # vectors that the centres are taken from
CELL, MOST_CELLS, PROBES = 2048, 1024, 64
STEPS = 6  # of k-means
FAR = 1000
BLOCK, QUERY_BLOCK = 2048, 256  # rows of a block of codes, and of queries
FIRST = 4  # times k + 1 vectors of least upper bound give a query's reach
PIECE = 2_000_000  # codes of a cell that are dealt to one task
SEED = 7


def rotation(dim: int) -> np.ndarray:
    """Orthonormal rows: the first ``dim`` rows of a random rotation."""
    bits = max(BITS, -(-dim // 64) * 64)
    return np.linalg.qr(np.random.RandomState(SEED).randn(bits, bits))[0][:dim]


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T


def centres_of(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of ``cells`` clusters of the rows of x; a cluster that runs empty keeps its centre.

    Rows that are ``FAR`` times as long as the median one would pull a centre away from all others,
    and make their bounds useless; they are indexed like others, but have no say.
    """
    size = np.linalg.norm(x, axis=1)
    x = x[size <= FAR * np.median(size)]
    c = x[:cells].copy()
    for _ in range(STEPS if cells > 1 else 1):
        own = np.concatenate([_squared(x[at : at + 4096], c).argmin(axis=1) for at in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, k], len(c)) for k in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def valid(vectors: DataFrame) -> DataFrame:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = F.col("embedding")
    return vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, fine) & F.exists(e, lambda x: fine(x) & (x != 0))
    )


def _arrays(part, column: str) -> np.ndarray:
    """Vectors of one length as a matrix, in double precision: squares of floats may be too large for floats."""
    a = part.column(column)
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def _by_dim(part, column: str):
    size = np.asarray([len(x) for x in part.column(column)])
    for dim in np.unique(size):
        yield int(dim), part.filter(pa.array(size == dim))


def _centre(centres: dict, dim: int) -> np.ndarray:
    return centres.get(dim, np.zeros((1, dim)))


def _encode(centres):
    def run(batches):
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for dim, part in _by_dim(batch.slice(at, BLOCK), "embedding"):
                    p, c = turn.setdefault(dim, rotation(dim)), _centre(centres.value, dim)
                    x = _arrays(part, "embedding")
                    cell = _squared(x, c).argmin(axis=1)
                    x = x - c[cell]
                    norm = np.linalg.norm(x, axis=1)
                    r = (x / np.maximum(norm, 1e-30)[:, None]) @ p
                    own = np.abs(r).sum(axis=1) / np.sqrt(r.shape[1])
                    codes = np.packbits(r > 0, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(x), dim)), pa.array(cell.astype(np.int32)), part.column("class_id"), pa.array([v.tobytes() for v in codes], pa.binary()),
                            pa.array(norm.astype(np.float32)), pa.array(own.astype(np.float32)),
                        ],
                        ["dim", "cell", "class_id", "code", "norm", "own"],
                    )

    return run


def _queries(centres):
    """A row for each query and probed cell: its planes, and what scales their counts."""

    def run(batches):
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                for dim, part in _by_dim(batch.slice(at, QUERY_BLOCK), "embedding"):
                    p, c = turn.setdefault(dim, rotation(dim)), _centre(centres.value, dim)
                    x = _arrays(part, "embedding")
                    probes = np.argsort(_squared(x, c), axis=1, kind="stable")[:, :PROBES]
                    n, cell = np.repeat(np.arange(len(x)), probes.shape[1]), probes.ravel()
                    for lo in range(0, len(n), 4096):
                        i, k = n[lo : lo + 4096], cell[lo : lo + 4096]
                        q = (x[i] - c[k]) @ p
                        low = q.min(axis=1)
                        step = np.maximum(q.max(axis=1) - low, 1e-30) / (2**PLANES - 1)
                        u = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
                        gap = np.linalg.norm(q - low[:, None] - step[:, None] * u, axis=1)
                        planes = np.stack([np.packbits((u >> b) & 1, axis=1) for b in range(PLANES)], axis=1)
                        scale = np.stack([low, step, u.sum(axis=1), np.linalg.norm(q, axis=1), gap], axis=1).astype(np.float64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(i), dim)), pa.array(k.astype(np.int32)), part.column("ask_id").take(pa.array(i)), pa.array([v.tobytes() for v in planes], pa.binary()), pa.array([v.tobytes() for v in scale], pa.binary())],
                            ["dim", "cell", "query_id", "planes", "scale"],
                        )

    return run


def _blocks(columns: dict[str, str], size: int):
    """Consecutive rows of one dimension and cell as blocks: ids and fixed-size values end to end."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        key, n = None, 0

        def out():
            rows = pa.Table.from_batches(held)
            values = [b"".join(v if isinstance(v, bytes) else v.tobytes() for v in ([rows.column(c).to_numpy()] if k != "binary" else rows.column(c).to_pylist())) for c, k in columns.items()]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], ["dim", "cell", *(f"{c}s" for c in columns)])

        for batch in batches:
            dim, cell = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.append(True, (dim[1:] != dim[:-1]) | (cell[1:] != cell[:-1]))) if len(dim) else []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(dim))):
                own = (int(dim[lo]), int(cell[lo]))
                if held and own != key:
                    yield out()
                    held, n = [], 0
                key = own
                while lo < hi:
                    take = int(min(hi - lo, size - n))
                    held.append(batch.slice(lo, take).select(list(columns)))
                    lo, n = lo + take, n + take
                    if n == size:
                        yield out()
                        held, n = [], 0
        if held:
            yield out()

    return run


def _estimates(row: dict):
    """Of each query of a pair of blocks its id and the lower and upper bounds of its squared distances."""
    norm, own = (np.frombuffer(row[c], np.float32).astype(np.float64) for c in ("norms", "owns"))
    codes = np.frombuffer(row["codes"], np.uint8).reshape(len(norm), -1).view(np.uint64)
    bits = codes.shape[1] * 64
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    q_ids = np.frombuffer(row["query_ids"], np.int64)
    planes = np.frombuffer(row["planess"], np.uint8).reshape(len(q_ids), PLANES, -1).view(np.uint64)
    scale = np.frombuffer(row["scales"], np.float64).reshape(len(q_ids), 5)
    own = np.maximum(own, 1e-9)
    spread = EPSILON * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(bits - 1)
    for n, (low, step, total, q_norm, gap) in enumerate(scale.tolist()):
        both = np.zeros(len(norm), np.int64)
        for b in range(PLANES):
            both += np.bitwise_count(codes & planes[n, b]).sum(axis=1, dtype=np.int64) << b
        inner = (low * (2 * ones - bits) + step * (2 * both - total)) / np.sqrt(bits) / own * norm
        middle = q_norm * q_norm + norm**2 - 2 * inner
        slack = 2 * norm * (q_norm * spread + EPSILON * gap / np.sqrt(bits) / own) + 1e-5 * (q_norm * q_norm + norm**2)
        # a bound that can't be had in double precision excludes nothing
        lower, upper = np.nan_to_num(middle - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(middle + slack, nan=np.inf, posinf=np.inf, neginf=np.inf)
        yield int(q_ids[n]), lower, upper


def _likely(k: int):
    """``query_id, class_id, upper``: of each query the k + 1 vectors of least upper bound that the task has seen."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["class_ids"], np.int64)
                for q, _, upper in _estimates(row):
                    u, c = upper, ids
                    if q in best:
                        u, c = np.append(best[q][0], u), np.append(best[q][1], c)
                    if len(u) > k + 1:
                        keep = np.argpartition(u, k)[: k + 1]
                        u, c = u[keep], c[keep]
                    best[q] = u, c
        if best:
            ids = np.repeat(np.array(list(best), np.int64), [len(u) for u, _ in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([c for _, c in best.values()])), pa.array(np.concatenate([u for u, _ in best.values()]))], ["query_id", "class_id", "upper"])

    return run


def _within(batches):
    """``query_id, class_id`` of the vectors whose lower bound is within the query's reach."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, reach = np.frombuffer(row["class_ids"], np.int64), np.frombuffer(row["reachs"])
            near = [(q, ids[lower <= r]) for (q, lower, _), r in zip(_estimates(row), reach)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([q for q, _ in near], np.int64), [len(c) for _, c in near])), pa.array(np.concatenate([c for _, c in near]))], ["query_id", "class_id"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``vectors`` to each query.

    ``queries`` are rows ``(vec_id, embedding)``; a query is never its own neighbour, by id. The
    score is the Euclidean distance of the vectors as given, in double precision; ties go to the
    smaller id. Vectors that are null, zero or hold a null or non-finite component take no part,
    nor do rows without id. Rows that repeat id and vector count once; with several vectors under
    one id each counts. Queries with less than k candidates get all of them. Empty tables give an
    empty result. Columns besides ``vec_id`` and ``embedding`` are ignored.
    """
    with scratch(vectors.sparkSession) as s:
        found = _nearest(vectors, queries, k)
        s.keep(found)
    return found


def _nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = valid(vectors).dropDuplicates()
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    rows = stored(rows.withColumn("nth", F.row_number().over(by_vector)).filter(F.col("nth") <= k + 1))
    # one id may stand for several vectors, so a class is named by a number of its own
    classes = stored(rows.filter("nth = 1").select(F.monotonically_increasing_id().alias("class_id"), "embedding"))
    members = rows.select("vec_id", "embedding").join(classes, "embedding").select("class_id", "vec_id")

    n = classes.count()
    groups: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).select("embedding").collect():
        groups.setdefault(len(r[0]), []).append(r[0])
    size = lambda v: max(1, min(n * len(v) // min(n, SAMPLE) // CELL, MOST_CELLS, len(v)))
    centres = spark.sparkContext.broadcast({d: centres_of(np.array(v, np.float64), size(v)) for d, v in groups.items()})

    codes = classes.mapInArrow(handing_back(_encode(centres)), "dim long, cell int, class_id long, code binary, norm float, own float")
    piece = F.pmod("class_id", F.lit(-(-n // PIECE) or 1))
    codes = codes.repartition("dim", "cell", piece).sortWithinPartitions("dim", "cell")
    codes = stored(codes.mapInArrow(_blocks({"class_id": "long", "code": "binary", "norm": "float", "own": "float"}, BLOCK), "dim long, cell int, class_ids binary, codes binary, norms binary, owns binary"))
    asked = stored(valid(queries).dropDuplicates().withColumn("ask_id", F.monotonically_increasing_id()))
    probes = stored(asked.mapInArrow(handing_back(_queries(centres)), "dim long, cell int, query_id long, planes binary, scale binary"))

    def met(probes: DataFrame, run, schema: str, **more: str) -> DataFrame:
        by_cell = probes.repartition("dim", "cell").sortWithinPartitions("dim", "cell")
        kinds = {"query_id": "long", "planes": "binary", "scale": "binary", **more}
        blocks = by_cell.mapInArrow(_blocks(kinds, QUERY_BLOCK), "dim long, cell int, " + ", ".join(f"{c}s binary" for c in kinds))
        return codes.join(blocks, ["dim", "cell"]).mapInArrow(handing_back(run), schema)

    sides = asked.select(F.col("ask_id").alias("query_id"), F.col("vec_id").alias("asked_id"), F.col("embedding").alias("q"))
    gap = F.zip_with(F.col("q").cast("array<double>"), F.col("embedding").cast("array<double>"), lambda x, y: (x - y) * (x - y))

    def exact(pairs: DataFrame) -> DataFrame:
        both = pairs.join(classes, "class_id").join(sides, "query_id").filter(F.size("q") == F.size("embedding"))
        return both.select("query_id", "asked_id", "class_id", F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x).alias("squared"))

    def least(rows: DataFrame, by: str, n: int) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(by))).filter(F.col("nth") <= n)

    # the reach of a query: the exact distance of the (k + 1)-th of those that look nearest
    first = least(met(probes, _likely(k), "query_id long, class_id long, upper double"), "upper", FIRST * (k + 1)).select("query_id", "class_id")
    reach = least(exact(first), "squared", k + 1).groupBy("query_id").agg(F.max("squared").alias("reach"), F.count("*").alias("n"))
    reach = reach.select("query_id", F.when(F.col("n") > k, F.col("reach")).otherwise(float("inf")).alias("reach"))
    pairs = stored(met(probes.join(reach, "query_id"), _within, "query_id long, class_id long", reach="double"))
    found = exact(pairs).select(F.col("asked_id").alias("query_id"), "class_id", F.sqrt("squared").alias("score"))
    found = found.join(members, "class_id").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return stored(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
