import duckdb
import pytest

import __spark_entry__
from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 25


def test_every_query_has_sql_or_is_known_to_have_none():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"pseudo_embedding", "learned_vectors_topk"}
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, tmp_path, name):
    registry.QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    spark.catalog.clearCache()
    duck.execute(f"CREATE OR REPLACE TABLE want AS {registry.ORACLE_SQL[name]}")
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    columns = sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    assert columns == sorted(r[0] for r in duck.execute("DESCRIBE got").fetchall())
    of = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert not duck.execute(f"SELECT {of} FROM {a} EXCEPT ALL SELECT {of} FROM {b} LIMIT 3").fetchall()


def test_pseudo_embedding_equals_its_definition(spark, sf):
    import hashlib

    import numpy as np

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = registry.QUERIES["pseudo_embedding"](spark, sf).collect()
    assert len(rows) == len(texts) == 40
    for r in rows:
        seed = int(hashlib.sha256(texts[r.item_id].encode()).hexdigest()[:8], 16)
        v = np.random.RandomState(seed).randn(8)
        assert np.allclose([float(x) for x in r.embedding.split(",")], v / np.linalg.norm(v), atol=1e-6)


def test_patterns_are_those_expected():
    """The SQL takes patterns from the operators; some literals, so that a slip doesn't pass on both sides."""
    from tessera.functions.text import ALIASES
    from tessera.operators import extraction, fusion, layout

    assert [(k, c) for k, c, _ in extraction.TRIGGERS] == [
        ("ACQUIRED", 1.0), ("SUBSIDIARY_OF", 0.95), ("PARTNERS_WITH", 0.9), ("DEVELOPS_AND_OWNS", 0.95), ("DEPENDS_ON", 0.9), ("INCREASED_BY", 0.9), ("REPORTED_METRIC", 0.9), ("LOCATED_IN", 0.9),
    ]
    assert extraction.TRIGGER_WORDS["PARTNERS_WITH"] == "partnered with|collaborated with|signed agreement with"
    assert extraction.CONFIDENCE == {"ORGANIZATION": 0.92, "TECHNOLOGY": 0.95, "METRIC": 0.88} and len(ALIASES) == 8
    assert (fusion.RRF_K, fusion.VECTOR_WEIGHT, fusion.GRAPH_WEIGHT, fusion.BONUS) == (60, 0.55, 0.45, 0.15)
    assert (layout.DEFAULT_SIZE, layout.HEADING, layout.TOP_HEADING, layout.OCR_CHARS) == (11.0, 1.3, 1.6, 50)
