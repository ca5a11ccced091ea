import numpy as np
from pyspark.sql import functions as F

from tessera.operators import text_vectors, vector
from tessera.plans import pipeline, registry


def _matrix(texts, model):
    """The whole matrix of ``texts(key, text)``, from the definition; rows by key."""
    n = len(model.idf)
    rows = sorted(texts.select("key", text_vectors.hashed(F.col("text"), n).alias("words")).collect())
    out = np.zeros((len(rows), n))
    for at, r in enumerate(rows):
        count = np.bincount(r.words, minlength=n)
        x = np.where(count > 0, (1 + np.log(np.maximum(count, 1))) * model.idf, 0)
        out[at] = x / (np.linalg.norm(x) or 1)
    return [r.key for r in rows], out


def test_subspace_is_that_of_a_full_decomposition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    model = text_vectors.fit(docs, rank=24, buckets=2048, passes=6)
    _, a = _matrix(docs, model)
    n = int((a.any(axis=1)).sum())
    assert np.allclose(model.idf[a.any(axis=0)], np.log((n + 1) / ((a > 0).sum(axis=0)[a.any(axis=0)] + 1)) + 1)
    assert np.allclose(model.basis.T @ model.basis, np.eye(24), atol=1e-9)
    s = np.linalg.svd(a, compute_uv=False)
    best = np.sqrt((s[24:] ** 2).sum())
    assert np.linalg.norm(a - a @ model.basis @ model.basis.T) <= 1.01 * best
    # another partitioning gives the same vectors, but for rounding
    again = text_vectors.fit(docs.repartition(7), rank=24, buckets=2048, passes=6)
    assert np.abs(again.basis @ again.basis.T - model.basis @ model.basis.T).max() < 1e-6


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {}
    for r in registry.QUERIES["learned_vectors_topk"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    model = text_vectors.fit(docs)
    ids, a = _matrix(docs.select(F.col("doc_id").alias("key"), "text"), model)
    asked, b = _matrix(items.select(F.col("item_id").alias("key"), "text"), model)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sim = unit(b @ model.basis) @ unit(a @ model.basis).T
    at = {d: n for n, d in enumerate(ids)}
    assert sorted(got) == asked
    for q, row in zip(asked, sim):
        hits = [got[q][k] for k in range(1, 6)]
        assert np.allclose([s for _, s in hits], np.sort(row)[::-1][:5], atol=2e-5)
        assert all(abs(row[at[d]] - s) < 2e-5 for d, s in hits)


def test_edges_and_saved_models(spark, tmp_path):
    schema = "text string, words string"
    empty = text_vectors.fit(spark.createDataFrame([], schema), rank=4, buckets=64)
    assert not empty.basis.any()
    rows = [(None, "x"), ("", None), ("...", "y"), ("One two", "z"), ("one TWO", "z"), ("three " * 30000, "w")]
    df = spark.createDataFrame(rows, schema)
    model = text_vectors.fit(df, rank=4, buckets=64)
    model.save(spark, str(tmp_path / "m"))
    saved = text_vectors.TextVectors.load(spark, str(tmp_path / "m"))
    assert np.array_equal(saved.basis, model.basis) and np.array_equal(saved.idf, model.idf)
    x = np.array([r[0] for r in df.select(saved.column(F.col("text"))).collect()])
    assert x.shape == (6, 4) and not x[:3].any() and np.allclose(np.linalg.norm(x[3:], axis=1), 1)
    assert np.allclose(x[3], x[4]) and abs(x[3] @ x[5]) < 1e-9


def test_paraphrases_find_their_pages_in_a_store(spark, tmp_path):
    rng = np.random.default_rng(3)
    lexicon = [[f"w{t}x{n}" for n in range(20)] for t in range(12)]
    pages = [(d, 1, " ".join(rng.choice(lexicon[d % 12], 15)) + f" name{d} name{d} name{d}") for d in range(60)]
    table = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    model = text_vectors.fit(table, rank=60, buckets=4096)
    store = pipeline.ingest(table, str(tmp_path / "store"), embed=model.column)
    # words in another order and case, a third of them left out; one question twice
    asked = []
    for d in range(0, 60, 5):
        words = pages[d][2].upper().split()
        asked.append((d, " ".join(rng.permutation(words[5:]))))
    asked.append((100, asked[0][1].lower() + " "))
    queries = spark.createDataFrame(asked, "query_id long, question string")
    of = {r.chunk_id: r.doc_id for r in store.chunks.select("chunk_id", "doc_id").collect()}
    hits = vector.top_k(pipeline.query_vectors(queries, model.column), store.vectors, 1).collect()
    found = {r.query_id: of[r.vec_id] for r in hits}
    assert found == {q: q if q < 100 else 0 for q, _ in asked}
