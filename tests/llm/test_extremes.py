"""Magnitudes and numbers of classes that are out of the ordinary."""

import numpy as np
import pytest

from tessera.llm import ann, language_id


@pytest.mark.parametrize("kind, large", [("float", (1e25,)), ("double", (1e39, -1e120)), ("double", (1e200, 3e307)), ("float", (1e15, 1e-30))])
def test_large_components_empty_no_result(spark, kind, large):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16)).astype(np.float32).astype(np.float64)
    for n, by in enumerate(large):
        x[7 + n] *= by
        if kind == "float":
            x[7 + n] = x[7 + n].astype(np.float32)
    rows = [(n, v.tolist()) for n, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = {}
    for r in ann.nearest(vectors, vectors.filter("vec_id % 7 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    with np.errstate(over="ignore"):
        for q in range(0, 60, 7):
            d = np.array([np.sqrt(np.add.accumulate((x[q] - v) * (x[q] - v))[-1]) for v in x])
            want = sorted((s, n) for n, s in enumerate(d.tolist()) if n != q)[:5]
            assert sorted(got[q]) == [(k + 1, n, s) for k, (s, n) in enumerate(want)]


def _languages(n):
    """Texts of ``n`` languages, each of words of its own."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    lexicon = [["".join(rng.choice(letters, 6)) for _ in range(6)] for _ in range(n)]
    return [(10 * k + t, " ".join(rng.choice(lexicon[k], 12)), f"l{k:03d}") for k in range(n) for t in range(3)]


def test_two_hundred_languages(spark):
    docs = spark.createDataFrame(_languages(200), "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.langs) == 200
    got = language_id.identified(docs, model).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == 600 and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 590
    assert language_id.spans(docs, model).select("doc_id").distinct().count() == 600
    assert language_id.accepted(docs, model).count() == 600


@pytest.mark.parametrize("partitions", [1, 2])
def test_an_empty_language_is_no_null(spark, partitions):
    rows = _languages(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    asked = spark.createDataFrame([(1, rows[0][1], ""), (2, rows[0][1], None), (3, rows[4][1], "zz")], docs.schema).repartitionByRange(partitions, "doc_id")
    assert {r.doc_id: r.lang for r in language_id.accepted(asked, model).collect()} == {1: "", 2: "l000", 3: "zz"}
