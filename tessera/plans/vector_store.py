"""Vectors in cells around centres, each cell in files of its own, and exact search that reads few of them.

Cells are buckets of a store (:mod:`tessera.plans.store`). Each vector is in the cell of the centre
nearest to its direction, and a cell knows the farthest of its vectors. With a unit query ``q``, a
centre ``c`` and that radius ``r``, no vector of the cell has a similarity above ``q c + r``. A
search first reads the most promising cells that hold enough vectors, and then only those whose
bound reaches the k-th similarity found: all others can't have a better one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.vector import BLOCK, _search, _unit
from tessera.plans.store import Change, Snapshot
from tessera.sources.scratch import scratch, stored

SAMPLE = 16_384  # vectors that the centres are fitted to; all are indexed
STEPS = 8
QUERIES = 256  # of a block
EDGE = 1e-6  # scores are rounded to six digits


def centres_of(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of at most ``cells`` clusters of unit rows, from rows that are far from each other."""
    picked = [0]
    far = np.full(len(x), np.inf)
    while len(picked) < min(cells, len(x)):
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        picked.append(int(far.argmax()))
    c = x[picked]
    for _ in range(STEPS):
        own = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, k], len(c)) for k in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _fine(vectors: DataFrame, id_: str, dim: int) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_).cast("long").alias(id_), e.alias("embedding")).filter(F.col(id_).isNotNull() & (F.size("embedding") == dim) & whole)


def _placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vec_id, embedding, cell, gap``: the nearest centre, and how far it is from the unit vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _unit(_matrix(part.column("embedding"), c.shape[1]))
                cell = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
                gap = np.linalg.norm(x - c[cell], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(gap)], ["vec_id", "embedding", "cell", "gap"])

    return vectors.mapInArrow(run, "vec_id long, embedding array<double>, cell int, gap double")


def _centres(now: Snapshot) -> np.ndarray:
    rows = now.read("centres").orderBy("cell").collect()
    return np.array([r.centre for r in rows])


def create(vectors: DataFrame, folder: str, cells: int = 64, buckets: int = 16) -> Snapshot:
    """A store of ``vectors(vec_id, embedding)`` in ``folder``, which is new; see ``upsert``.

    Centres are fitted to the ``SAMPLE`` vectors of least hash; their number, which is bounded by
    ``cells``, is fixed with the store, and so is the length of the vectors: that of most of the sample.
    """
    spark = vectors.sparkSession
    rows = vectors.select("embedding").filter("embedding IS NOT NULL AND size(embedding) > 0").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).collect()
    lengths = [len(r[0]) for r in rows]
    dim = max(sorted(set(lengths)), key=lengths.count, default=1)
    x = np.array([r[0] for r in rows if len(r[0]) == dim], np.float64).reshape(-1, dim)
    x = _unit(x[np.isfinite(x).all(axis=1)])
    c = centres_of(x, cells) if len(x) else np.zeros((1, dim))
    change = Change(Snapshot.latest(spark, folder, buckets))
    if change.base.number:
        raise FileExistsError(f"{folder} holds a store")
    change.write("centres", spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(c)], "cell int, centre array<double>"), F.lit(0), [0])
    change.commit()
    return upsert(vectors, folder)


def upsert(vectors: DataFrame, folder: str) -> Snapshot:
    """Adds ``vectors(vec_id, embedding)``; one whose id is known replaces the old one, in whichever cell that is.

    Of rows that repeat an id in one call that with the largest vector counts. Rows without id,
    with a null or of another length than the store's, or with a component that is null or not
    finite, take no part. Only cells that lose or get a vector are written anew.
    """
    spark = vectors.sparkSession
    base = Snapshot.latest(spark, folder)
    change, c = Change(base), _centres(base)
    with scratch(spark):
        once = _fine(vectors, "vec_id", c.shape[1]).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
        new = stored(_placed(once, c))
        ids, at = new.select("vec_id"), change.bucket("vec_id")
        spots = sorted(r[0] for r in new.select(at.alias("b")).distinct().collect())
        place = new.select("vec_id", "cell")
        touched = place.select("cell")
        if base.has("places"):
            known = base.read("places", spots)
            touched = touched.unionByName(known.join(ids, "vec_id", "left_semi").select("cell"))
            place = known.join(ids, "vec_id", "left_anti").unionByName(place)
        cells = sorted(r[0] for r in touched.distinct().collect())
        change.write("places", place, ("vec_id",), spots)
        rows = new
        if base.has("vectors"):
            rows = base.read("vectors", cells).join(ids, "vec_id", "left_anti").unionByName(new)
        rows = change.write("vectors", rows, F.col("cell"), cells)
        extent = rows.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n"))
        if base.has("extents"):
            extent = base.read("extents").filter(~F.col("cell").isin(cells)).unionByName(extent)
        change.write("extents", extent, F.lit(0), [0])
        return change.commit()


def _bounds(queries: DataFrame, now: Snapshot, k: int) -> DataFrame:
    """``query_id, cell, upper, first``: bounds of all cells; ``first`` are the best that hold k vectors."""
    extent = {r.cell: (r.radius, r.n) for r in now.read("extents").collect()}
    c = _centres(now)
    radius, n = (np.array([extent.get(i, (0.0, 0))[j] for i in range(len(c))]) for j in (0, 1))
    shared = now.spark.sparkContext.broadcast((c[n > 0], radius[n > 0], n[n > 0], np.flatnonzero(n > 0).astype(np.int32)))

    def run(batches):
        c, radius, n, cell = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                q = _unit(_matrix(part.column("embedding"), c.shape[1]))
                upper = q @ c.T + radius * np.linalg.norm(q, axis=1, keepdims=True)
                order = np.argsort(-upper, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                ids = np.repeat(part.column("query_id").to_numpy(), len(c))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cell[order].ravel()), pa.array(np.take_along_axis(upper, order, 1).ravel()), pa.array((before < k).ravel())], ["query_id", "cell", "upper", "first"])

    return queries.mapInArrow(run, "query_id long, cell int, upper double, first boolean")


def _cell_blocks(id_: str, ids: str, rows: str, size: int):
    """Rows of one cell that follow each other as blocks of unit vectors."""

    def run(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist() if len(cell) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(cell)]):
                for at in range(lo, hi, size):
                    part = batch.slice(at, min(size, hi - at))
                    dim = len(part.column("embedding")[0])
                    x = _unit(_matrix(part.column("embedding"), dim))
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[lo])], pa.int32()), pa.array([dim]), pa.array([part.column(id_).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["cell", "dim", ids, rows])

    return run


def _hits(now: Snapshot, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query among the vectors of its cells; reads the files of these cells alone."""
    cells = sorted(r[0] for r in pairs.select("cell").distinct().collect())
    vectors = now.read("vectors", cells).select("vec_id", "embedding", "cell")
    dealt = vectors.mapInArrow(_cell_blocks("vec_id", "ids", "rows", BLOCK), "cell int, dim long, ids binary, rows binary")
    asked = pairs.join(queries, "query_id").select("query_id", "embedding", "cell").repartition("cell").sortWithinPartitions("cell")
    asked = asked.mapInArrow(_cell_blocks("query_id", "q_ids", "q_rows", QUERIES), "cell int, dim long, q_ids binary, q_rows binary").drop("dim")
    return dealt.join(asked, "cell").mapInArrow(_search(k, 6), "query_id long, vec_id long, score double")


def top_k(queries: DataFrame, folder: str, k: int = 5, now: Snapshot | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: as ``operators.vector.top_k`` over all vectors of the store.

    Two rounds over ``queries(query_id, embedding)``, of the store as it is when this is called.
    Ids of cells pass the driver, vectors never. Query ids are unique.
    """
    spark = queries.sparkSession
    now = now or Snapshot.latest(spark, folder)
    none = "query_id long, vec_id long, score double"
    with scratch(spark) as s:
        if not now.has("extents") or now.read("extents").isEmpty():
            found = spark.createDataFrame([], none)
        else:
            asked = stored(_fine(queries, "query_id", _centres(now).shape[1]))
            bounds = stored(_bounds(asked, now, k))
            first = stored(_hits(now, asked, bounds.filter("first"), k))
            nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            reach = first.withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", F.col("score").alias("reach"))
            rest = bounds.filter("NOT first").join(reach, "query_id").filter(F.col("upper") >= F.col("reach") - EDGE)
            found = first.unionByName(stored(_hits(now, asked, rest.select("query_id", "cell"), k)))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        out = stored(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        s.keep(out)
    return out
