"""The vector store in cells against exact search."""

import numpy as np
import pytest

from tessera.operators import vector
from tessera.plans import store, vector_store


def clustered(rng, n, dim=12, groups=15):
    centre = rng.standard_normal((groups, dim)) * 4
    return centre[rng.integers(0, groups, n)] + rng.standard_normal((n, dim))


def hits(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_search_equals_exact_and_reads_few_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    x = clustered(rng, 900)
    x[5] = 0
    x[6] = x[7]
    schema = "vec_id long, embedding array<double>"
    rows = [(n, v.tolist()) for n, v in enumerate(x)]
    odd = [(None, [1.0] * 12), (2000, None), (2001, [1.0]), (2002, [float("nan")] + [1.0] * 11), (2003, [None] + [1.0] * 11)]
    folder = str(tmp_path)
    made = vector_store.create(spark.createDataFrame(rows[:600] + odd, schema), folder, cells=20)
    with pytest.raises(FileExistsError):
        vector_store.create(spark.createDataFrame(rows[:6], schema), folder)
    assert len(made.tables["vectors"]) > 10
    # a vector that moves to another cell: only the two are written anew
    where = lambda s, i: [r.cell for r in s.read("vectors").filter(f"vec_id = {i}").collect()]
    before = where(made, 3)
    other = next(n for n in range(20, 600) if where(made, n) != before)
    moved = vector_store.upsert(spark.createDataFrame([(3, x[other].tolist()), (3, (x[other] - 1e9).tolist())], schema), folder)
    assert where(moved, 3) == where(made, other) != before
    changed = {int(b) for b, v in moved.tables["vectors"].items() if made.tables["vectors"].get(b) != v}
    assert changed == {before[0], where(made, other)[0]}
    x[3] = x[other]
    vector_store.upsert(spark.createDataFrame(rows[600:] + rows[:2], schema), folder)
    now = store.Snapshot.latest(spark, folder)
    everything = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], schema)
    asked = spark.createDataFrame([(n, x[n].tolist()) for n in (0, 3, 5, 7, 700)] + [(9000, (-x[1]).tolist()), (9001, [1.0])], "query_id long, embedding array<double>")
    for k in (1, 5, 2000):
        assert hits(vector_store.top_k(asked, folder, k)) == hits(vector.top_k(asked, everything, k).filter("query_id != 9001"))
    now.opened.clear()
    vector_store.top_k(asked.filter("query_id = 0"), folder, 5, now)
    files = len(now.opened["vectors"])
    assert files < 0.5 * len(now.tables["vectors"])
    scan = now.read("vectors", sorted(now.opened["vectors"])).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in scan} == {str(b) for b in now.opened["vectors"]}


def test_empty_stores_and_questions(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    vector_store.create(empty, f"{tmp_path}/a")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert vector_store.top_k(asked, f"{tmp_path}/a").count() == 0
    vector_store.create(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], empty.schema), f"{tmp_path}/b")
    assert vector_store.top_k(asked.limit(0), f"{tmp_path}/b").count() == 0
    assert hits(vector_store.top_k(asked, f"{tmp_path}/b")) == [(1, 1, 1, 0.447214), (1, 2, 2, 0.0)]


def test_append_keeps_ids_that_repeat(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"), spark.createDataFrame([("c", 2)], "t string, id long")
    assert sorted(map(tuple, vector.append(old, new).collect())) == [(1, "a"), (2, "b"), (2, "c")]
