"""Each registered query over whole tables, against its SQL or against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm.decontaminate import normal

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, tmp_path, name):
    queries.QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    duck.execute(f"CREATE TABLE want AS {queries.ORACLE_SQL[name]}")
    duck.execute(f"CREATE TABLE got AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    kinds = {r[0]: r[1] for r in duck.execute("DESCRIBE want").fetchall()}
    assert kinds == {r[0]: r[1] for r in duck.execute("DESCRIBE got").fetchall()}
    of = ", ".join(f'round("{c}", 6)' if k == "DOUBLE" else f'"{c}"' for c, k in sorted(kinds.items()))
    assert duck.execute("SELECT count(*) FROM got").fetchall()[0][0] > 0
    for a, b in (("want", "got"), ("got", "want")):
        assert not duck.execute(f"SELECT {of} FROM {a} EXCEPT ALL SELECT {of} FROM {b} LIMIT 3").fetchall()


def test_secret_scan_equals_plain_patterns(spark, sf, documents):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = [("assign", re.compile(assign, re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    want = []
    for d, text, _ in documents:
        found = sorted((m.start(), n, k, m.end()) for n, (k, p, g, least) in enumerate(rules) for m in p.finditer(text or "") if len(m.group(g)) >= least)
        shown = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        want.append((d, *(sum(f[2] == k for f in found) for k in ("assign", "access", "hex")), hashlib.sha256(shown.encode()).hexdigest(), set(shown.split(","))))
    got = {r.doc_id: r for r in queries.QUERIES["op10_secret_scan"](spark, sf).collect()}
    assert len(got) == len(want)
    for d, n_assign, n_access, n_hex, digest, spans in want:
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n_assign, n_access, n_hex, digest)
        assert spans <= set(r.spans.split(","))


def test_base_scores_equal_plain_counts(spark, sf, documents):
    tokens = {d: [*WORDS.findall((t or "").translate(LOWER)), None] for d, t, _ in documents}
    counts = Counter(w for d, ws in tokens.items() if crc(d) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = queries.QUERIES["op7_lm_scoring"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(tokens)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 5 == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def _edits(item, text):
    """Fewest edits between the item and any region of the text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    steps = np.arange(len(row))
    for ch in item:
        new = np.append(row[0] + 1, np.minimum(row[:-1] + (text != ch), row[1:] + 1))
        row = np.minimum.accumulate(new - steps) + steps
    return row.min()


def test_decontamination_equals_full_tables(spark, sf, documents):
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    items = [(r.item_id, codes(normal(r.text))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [(d, codes(normal(t))) for d, t, _ in documents]
    want = {(d, i) for d, t in texts for i, item in items if len(item) >= 8 and _edits(item, t) <= len(item) // 10}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_decontamination"](spark, sf).collect()}
    assert got == want and want


def test_model_queries_score_every_document_once(spark, sf, documents):
    quality = queries.QUERIES["op4_quality"](spark, sf).collect()
    assert sorted(r.doc_id for r in quality) == sorted(d for d, _, _ in documents)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in quality)
    language = {r.doc_id: r for r in queries.QUERIES["op5_language_id"](spark, sf).collect()}
    learned = {g for d, _, g in documents if g is not None and crc(d) % 5}
    assert len(language) == len(documents)
    for d, text, _ in documents:
        r = language[d]
        assert r.held_out == (crc(d) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred in learned if any(map(str.isalpha, text or "")) else r.lang_pred == "und"
