import math

from pyspark.sql import functions as F

from tessera.operators import answer, extraction, fusion, graph, layout, metrics, vector

TEXT = "Alpha Technologies Inc. acquired Beta Systems Corp. Beta Systems Corp is located in San Francisco."


def chunk(spark, *texts):
    return spark.createDataFrame([(n, n, t) for n, t in enumerate(texts)], "chunk_id long, doc_id long, text string")


def test_extraction_of_two_companies(spark):
    c = chunk(spark, TEXT, "", None)
    m = {r.canonical_name: (r.entity_type, r.confidence) for r in extraction.mentions(c).collect()}
    assert m == {"Alpha Technologies Inc.": ("ORGANIZATION", 0.92), "Beta Systems Corp.": ("ORGANIZATION", 0.92), "Be": ("CONCEPT", 0.8), "San Francisco": ("CONCEPT", 0.8)}
    r = {(x.source, x.relation_type, x.target) for x in extraction.relations(c).collect()}
    assert r == {("Alpha Technologies Inc.", "ACQUIRED", "Be"), ("Beta Systems Corp.", "LOCATED_IN", "San Francisco")}


def test_technologies_metrics_and_merge(spark):
    c = chunk(spark, "We run neo4j and Neo4j for $4.2 billion or 34.5 %.", "Neo4j again")
    m = extraction.mentions(c)
    assert {(r.chunk_id, r.canonical_name) for r in m.collect()} == {(0, "neo4j"), (0, "Neo4j"), (0, "$4.2 billion"), (0, "34.5 %"), (1, "Neo4j")}
    e = {r.canonical_name: (r.n_chunks, r.first_chunk) for r in extraction.merge_entities(m).collect()}
    assert e["Neo4j"] == (2, 0) and e["neo4j"] == (1, 0)


def test_clauses_are_what_lies_between_ends_that_no_match_can_cross(spark):
    import re

    end = re.compile(r"[^\w\s.$%]|(?<!Inc|Ltd)(?<!Corp)\.", re.I | re.A)
    texts = [TEXT, "A Corp. b; c.d INC.e ltd. Cor. x $4 5%.é z", "..", "Alpha Inc. " * 20_000]
    got = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, t string").select("n", F.regexp_extract_all("t", F.lit(extraction.CLAUSE), F.lit(0)).alias("c"))
    for r in got.collect():
        assert r.c == [p for p in end.split(texts[r.n]) if p]


def test_organisations_and_technologies_need_no_relations(spark):
    c = chunk(spark, TEXT, "Redis Labs depends on Redis. Redis bought Gamma Ltd", "", None)
    kinds = F.col("entity_type").isin("ORGANIZATION", "TECHNOLOGY")
    want = extraction.mentions(c).filter(kinds).collect()
    plan = extraction.mentions(c, ends_too=False)
    assert sorted(plan.collect()) == sorted(want) and len(want) > 3
    assert "acquired" not in plan._jdf.queryExecution().optimizedPlan().toString()


def graph_of(spark):
    entities = spark.createDataFrame([("A", "A", "ORGANIZATION"), ("B", "B", "ORGANIZATION"), ("C", "see", "CONCEPT")], "canonical_name string, name string, entity_type string")
    relations = spark.createDataFrame(
        [("A", "B", "ACQUIRED", "x", 1.0), ("A", "B", "ACQUIRED", "y", 1.0), ("B", "B", "OWNS", "", 1.0), ("D", "A", "OWNS", None, 1.0)],
        "source string, target string, relation_type string, description string, weight double",
    )
    return entities, relations


def seeds(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, seed string")


def test_bfs_and_induced_edges(spark):
    entities, relations = graph_of(spark)
    s = seeds(spark, (1, "A"), (1, "A"), (1, "missing"), (2, "C"))
    nodes = graph.bfs(s, graph.undirected(relations), entities, 2)
    assert {(r.query_id, r.node, r.hop_distance) for r in nodes.collect()} == {(1, "A", 0), (1, "B", 1), (2, "C", 0)}
    edges = graph.induced_edges(nodes, relations)
    assert {(r.source, r.target, r.relation, r.description) for r in edges.collect()} == {("A", "B", "ACQUIRED", "x"), ("B", "B", "OWNS", "")}
    assert graph.induced_edges(nodes, relations, limit=1).count() == 1


def test_co_mention_is_two_hops(spark):
    entities, _ = graph_of(spark)
    m = spark.createDataFrame([(7, 1, "A"), (7, 1, "B")], "chunk_id long, doc_id long, canonical_name string")
    got = graph.bfs(seeds(spark, (1, "A")), graph.mention_edges(m), entities, 2).collect()
    assert {(r.node, r.hop_distance) for r in got} == {("A", 0), ("B", 2)}


def test_neighbours_keep_lonely_seeds_and_match_names(spark):
    entities, relations = graph_of(spark)
    got = graph.neighbours(seeds(spark, (1, "see"), (2, "A")), entities, relations).collect()
    assert ("C", None) in {(r.source, r.target) for r in got} and ("A", "B") in {(r.source, r.target) for r in got}
    assert {r.canonical_name for r in graph.dangling_entities(entities, relations).collect()} == {"D"}


def test_shortest_path_and_unreachable(spark):
    _, relations = graph_of(spark)
    starts = spark.createDataFrame([("D",)], "start string")
    ends = spark.createDataFrame([("B",), ("C",)], "end string")
    got = graph.shortest_paths(starts, ends, relations).collect()
    assert [(r.end, r.hop_length, r.path) for r in got] == [("B", 2, "D > A > B")]


def test_bridges_equal_brute_force(spark):
    rows = [(c, c // 3, e) for c in range(12) for e in ("x", "y") if (c + len(e)) % 2 or e == "y"]
    m = spark.createDataFrame(rows, "chunk_id long, doc_id long, canonical_name string")
    chunks = spark.createDataFrame([(c, f"text {c}") for c in range(12)], "chunk_id long, text string")
    s = spark.createDataFrame([(1, 0, "y"), (1, 1, "x"), (2, 0, "none")], "query_id long, ord int, seed string")
    for limit in (1, 3, 5, 40):
        want = sorted((o, a[0], b[0]) for o, e in ((0, "y"), (1, "x")) for a in rows for b in rows if a[2] == b[2] == e and a[0] < b[0] and a[1] != b[1])[:limit]
        got = sorted((0 if r.shared_entity == "y" else 1, r.chunk1_id, r.chunk2_id) for r in graph.bridges(s, m, chunks, limit).collect())
        assert got == want, limit


def test_grounded_chunks_count_and_confidence(spark):
    m = spark.createDataFrame([(1, 1, "A", 0.5), (1, 1, "B", None), (2, 2, "A", 0.9)], "chunk_id long, doc_id long, canonical_name string, confidence double")
    s = spark.createDataFrame([(1, 0, "B"), (1, 1, "A"), (1, 2, "A")], "query_id long, ord int, seed string")
    got = {r.chunk_id: (r.graph_score, r.mentioned_entities) for r in graph.grounded_chunks(s, m).collect()}
    assert got == {1: (3.0, "B, A, A"), 2: (2.0, "A, A")}
    conf = {r.chunk_id: r.graph_score for r in graph.grounded_chunks(s, m, by_confidence=True).collect()}
    assert conf == {1: 1.5, 2: 0.9}


def test_rank_fusion_values(spark):
    v = spark.createDataFrame([(1, 10, 1, 0.95), (1, 11, 2, 0.5)], "query_id long, chunk_id long, rank int, score double")
    g = spark.createDataFrame([(1, 10, 1, 2.0, "A"), (1, 12, 2, 1.0, "B")], "query_id long, chunk_id long, rank int, graph_score double, mentioned_entities string")
    n = spark.createDataFrame([(1, "A")], "query_id long, node string")
    got = {r.chunk_id: r for r in fusion.fuse(v, g, n, digits=12).collect()}
    assert math.isclose(got[10].fused_score, 1.15 / 61, abs_tol=1e-11) and got[10].rank == 1 and got[10].overlap == 1
    assert math.isclose(got[11].fused_score, 0.55 / 62, abs_tol=1e-11) and math.isclose(got[12].fused_score, 0.45 / 62, abs_tol=1e-11)


def test_vector_search_zero_ties_and_small_sets(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 2.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.9, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vector.top_k(q, v, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 2, 0.0)]
    assert vector.top_k(q.limit(0), v).count() == 0 and vector.top_k(q, v.limit(0)).count() == 0


def test_upsert_last_write_wins(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 1, "kept")], "id long, v long, t string")
    b = spark.createDataFrame([(1, 2, "new")], "id long, v long, t string")
    assert {(r.id, r.t) for r in vector.upsert(a, b, "id", "v").collect()} == {(1, "new"), (2, "kept")}


def test_answers_with_and_without_hits(spark):
    q = spark.createDataFrame([(1, "who?"), (2, "nobody?")], "query_id long, question string")
    fused = spark.createDataFrame([(1, 10, 1)], "query_id long, chunk_id long, rank int")
    edges = spark.createDataFrame([(1, "A", "B", "OWNS", None, 1.0)], "query_id long, source string, target string, relation string, description string, weight double")
    chunks = spark.createDataFrame([(10, 3, 2, "", " body ")], "chunk_id long, doc_id long, page_number int, filename string, text string")
    got = {r.query_id: r.response for r in answer.answers(q, fused, edges, chunks).collect()}
    assert got[2] == answer.NOT_FOUND and "A -OWNS-> B" in got[1] and "[1] (Source: 3, p.2) body..." in got[1] and got[1].endswith("Sources: 3 (Page 2)")


def test_latency_summary(spark):
    log = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "ms double")
    r = metrics.latency_summary(log, F.col("ms"), budget=3.0).first()
    assert (r["count"], r.p50_ms, r.p95_ms, r.mean_ms, r.sla_compliance_pct) == (4, 2.5, 8.95, 4.0, 75.0)
    e = metrics.latency_summary(log.limit(0), F.col("ms")).first()
    assert (e["count"], e.p50_ms, e.sla_compliance_pct) == (0, 0.0, 100.0)


def test_percentiles_of_groups_ties_and_negatives(spark):
    import numpy as np

    rng = np.random.RandomState(3)
    rows = [(g, float(v)) for g in ("a", None, "b") for v in np.round(rng.randn(400) * (1 if g else 900), 2 if g == "a" else 0)] + [("c", 5.0), ("d", None)]
    log = spark.createDataFrame(rows, "g string, ms double")
    got = {r.g: r for r in metrics.latency_summary(log, F.col("ms"), "g").collect()}
    for g in ("a", None, "b", "c"):
        x = [v for k, v in rows if k == g]
        assert all(abs(got[g][f"p{p}_ms"] - np.percentile(x, p)) <= 0.0051 for p in (50, 95, 99)), g
    assert got["d"]["count"] == 0 and got["d"].p99_ms == 0.0


def test_clauses_change_no_match(spark):
    """Patterns run on clauses find what they find in whole texts."""
    import random

    rng = random.Random(2)
    bits = ["Alpha", "Beta Corp.", "Inc.", "acquired", "Ltd", ".", ",", " ", "\n", "owns", "the", "grew by", "$5", "12%", "_x", "bought", "is located in", "Paris", "é", "LLC", "Zinc.", "generated", "$1_0 a"]
    texts = [" ".join(rng.choices(bits, k=14)) for _ in range(250)]
    c = chunk(spark, *texts)
    whole = c
    for n, (_, _, pattern) in enumerate(extraction.TRIGGERS):
        whole = whole.withColumn(f"w{n}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    want = {r.chunk_id: sum(len(r[f"w{n}"]) for n in range(8)) for r in whole.collect()}
    got = {r.chunk_id: len(r.triples) for r in extraction.annotated(c).select("chunk_id", "triples").collect()}
    assert got == want and sum(want.values()) > 200


def test_layout_headings_and_order(spark):
    rows = [(1, 0, 0, 0, 0.0, 52.0, 10.0, "body"), (1, 1, 0, 0, 5.0, 11.0, 30.0, "Big"), (1, 1, 0, 1, 5.0, 11.0, 10.0, "small"), (1, 2, 0, 0, 1.0, 12.0, 10.0, "left"), (1, 3, 0, 0, 1.0, 90.0, 10.0, " ")]
    s = spark.createDataFrame(rows, "page_id long, block_no int, line_no int, span_no int, x double, y double, size double, text string")
    b = layout.heading_levels(s)
    assert {r.block_no: (r.is_heading, r.heading_level) for r in b.collect()}[1] == (True, 1)
    assert layout.reading_order(b).first().text == "left\n\n# Bigsmall\n\nbody"
    page = spark.createDataFrame([("t", ["|a|", " "]), ("t", [])], "text string, tables array<string>")
    assert [r[0] for r in page.select(layout.with_tables(F.col("text"), F.col("tables"))).collect()] == ["t\n\n\n### Structured Tables:\n|a|", "t"]


def test_grounded_chunks_rank_shared_seed_lists_once_and_equal_brute_force(spark):
    import random

    r = random.Random(3)
    said = sorted({(c, c // 2, r.choice("aaabbcdef")) for c in range(60) for _ in range(3)})
    rows = [(c, d, e, r.choice([0.5, 0.9, None])) for c, d, e in said]
    m = spark.createDataFrame(rows, "chunk_id long, doc_id long, canonical_name string, confidence double").cache()
    lists = {q: [r.choice("aabbcdefg") for _ in range(r.randint(1, 4))] for q in range(30)} | {30: list("fab"), 31: list("eab"), 32: list("gab")}
    s = spark.createDataFrame([(q, n, x) for q, seeds_ in lists.items() for n, x in enumerate(seeds_)], "query_id long, ord int, seed string")
    for by_confidence in (False, True):
        want = set()
        for q, asked in lists.items():
            score = {}
            for c, _, e, conf in rows:
                n = asked.count(e)
                if n:
                    score[c] = score.get(c, 0.0) + ((1.0 if conf is None else conf) if by_confidence else n)
            want |= {(q, c, round(x, 6), n + 1) for n, (c, x) in enumerate(sorted(score.items(), key=lambda i: (-round(i[1], 6), i[0]))[:5])}
        got = graph.grounded_chunks(s, m, by_confidence=by_confidence)
        assert {(x.query_id, x.chunk_id, x.graph_score, x.rank) for x in got.collect()} == want
    # f, e and an unknown seed before the same two: three ends of lists for one
    ends = graph._profiles(s.filter("query_id >= 30").withColumnRenamed("seed", "canonical_name"), m)
    assert ends.filter("rest[0].canonical_name not in ('e', 'f')").select("rest").distinct().count() == 2


def test_induced_edges_of_many_queries_drop_what_no_query_keeps(spark):
    """Queries of two words of bits: the first edges of each are those of plain Python, and batches hand on no others than may count."""
    import random

    import pyarrow as pa

    rng = random.Random(6)
    names = [f"N{i}" for i in range(30)]
    nodes = [(q, n) for q in range(70) for n in rng.sample(names, rng.randrange(0, 12))]
    edges = [(rng.choice(names), rng.choice(names), rng.choice("XY"), rng.choice("abc"), 1.0) for _ in range(400)]
    r = spark.createDataFrame(edges, "source string, target string, relation_type string, description string, weight double").repartition(5)
    n = spark.createDataFrame(nodes, "query_id long, node string")
    for limit in (2, None):
        got = sorted(tuple(x) for x in graph.induced_edges(n, r, limit).select("query_id", "source", "relation", "target", "description").collect())
        want = []
        for q in range(70):
            own = {m for p, m in nodes if p == q}
            least: dict = {}
            for s, t, kind, d, _ in edges:
                if s in own and t in own:
                    least[s, kind, t] = min(d, least.get((s, kind, t), d))
            want += [(q, *k, d) for k, d in sorted(least.items())[:limit]]
        assert got == sorted(want)
    of = {"word": [0, 0, 0, 1, 0], "bits": [3, 1, 1, 1, -(2**63)], "source": ["a", "b", "c", "a", "z"], "target": ["t"] * 5, "relation": ["r"] * 5}
    (kept,) = graph._first_of_bits(2)([pa.RecordBatch.from_pydict(of)])
    assert sorted(zip(*(kept.column(c).to_pylist() for c in ("word", "source")))) == [(0, "a"), (0, "b"), (0, "z"), (1, "a")]


def test_grounded_chunks_shuffles_mentions_once(spark, monkeypatch):
    """All that the seeds' mentions are read for comes from one table with a row for each chunk."""
    plans, kept = {}, graph.stored

    def noted(df):
        plans.setdefault("said" if "said" in df.columns else "other", []).append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df)

    monkeypatch.setattr(graph, "stored", noted)
    seeds = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, 0, "B")], "query_id long, ord int, seed string")
    mentions = kept(spark.createDataFrame([(10, 1, "A", 0.5), (10, 1, "B", None), (11, 1, "B", 0.9), (11, 1, "B", 0.7), (12, 2, "C", 1.0)], "chunk_id long, doc_id long, canonical_name string, confidence double"))
    rows = graph.grounded_chunks(seeds, mentions, by_confidence=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.graph_score) for r in rows] == [(1, 10, 1.5), (1, 11, 0.9), (2, 10, 1.0), (2, 11, 0.9)]
    (_, plan), = plans["said"]
    assert plan.count("Exchange hashpartitioning(chunk_id") == 1
    assert not any({"chunk_id", "canonical_name"} <= set(columns) for columns, _ in plans["other"])


def test_lists_of_seeds_read_postings_as_arrays_and_equal_brute_force(monkeypatch):
    """Blocks of a few chunks against all lists: the best of each block by its rarest seed, and only as many places as it takes."""
    import random

    import pyarrow as pa

    r = random.Random(8)
    monkeypatch.setattr(graph, "CHUNKS", 40)
    monkeypatch.setattr(graph, "LISTS", 7)
    kinds = pa.schema([("chunk_id", pa.string()), ("doc_id", pa.int64()), ("said", pa.list_(pa.struct([("canonical_name", pa.string()), ("worth", pa.float64())])))])
    asked_kinds = pa.schema([("tail", pa.int64()), ("rest", pa.list_(pa.struct([("n", pa.int64()), ("canonical_name", pa.string()), ("weight", pa.float64())])))])
    for worths in ((1.0,), (0.5, 0.9, 1.0, 0.0, 0.1234565)):
        rows = [{"chunk_id": f"c{r.randint(0, 60)}", "doc_id": d, "said": [{"canonical_name": n, "worth": r.choice(worths)} for n in r.sample("abcdefgh", r.randint(1, 5))]} for d in range(110)]
        lists = [{"tail": t, "rest": [{"n": 0, "canonical_name": n, "weight": float(r.randint(1, 2))} for n in r.sample("abcdefghxy", r.randint(1, 4))]} for t in range(30)]
        monkeypatch.setattr(graph, "MENTIONS", r.choice((60, 1 << 20)))
        blocks = list(graph._postings([pa.RecordBatch.from_pylist(rows[:50], kinds), pa.RecordBatch.from_pylist(rows[50:], kinds)]))
        asked = list(graph._asked([pa.RecordBatch.from_pylist(lists, asked_kinds)]))
        assert len(blocks) > 1 and len(asked) == 5
        pairs = [pa.RecordBatch.from_arrays([*b.columns, *a.columns], [*b.schema.names, *a.schema.names]) for b in blocks for a in asked]
        got = {}
        for batch in graph._ranked(3)(pairs):
            for x in batch.to_pylist():
                got.setdefault(x["tail"], []).append((-round(x["score"], 6), x["chunk_id"], x["doc_id"]))
        for t in lists:
            first = t["rest"][0]["canonical_name"]
            want = []
            for row in rows:
                said = {s["canonical_name"]: s["worth"] for s in row["said"]}
                if first in said:
                    want.append((-round(sum(s["weight"] * said.get(s["canonical_name"], 0.0) for s in t["rest"]), 6), row["chunk_id"], row["doc_id"]))
            assert sorted(got.get(t["tail"], []))[:3] == sorted(want)[:3]
    monkeypatch.undo()
    common = [{"chunk_id": f"{n:06}", "doc_id": n, "said": [{"canonical_name": c, "worth": 1.0} for c in "ab"]} for n in range(20_000)]
    (block,) = graph._postings([pa.RecordBatch.from_pylist(common, kinds)])
    (row,) = [{c: block.column(c)[0] for c in block.schema.names}]
    read, block = [], graph._Block(row)
    worth = graph._Block.worth
    monkeypatch.setattr(graph._Block, "worth", lambda self, i, at: read.append(len(at)) or worth(self, i, at))
    places, score = block.best([block.names["a"], block.names["b"]], [1.0, 1.0], 5)
    assert places.tolist() == [0, 1, 2, 3, 4] and score.tolist() == [2.0] * 5 and sum(read) < 2000


def test_vector_blocks_that_hold_nothing_better_change_nothing():
    """Many blocks against one block of queries, with ties, vectors that aren't numbers and scores at the edge of rounding."""
    import numpy as np
    import pyarrow as pa

    r = np.random.RandomState(2)
    x = np.round(vector._unit(r.randn(900, 4)), 2)
    x[7] = np.nan
    q = np.round(vector._unit(r.randn(6, 4)), 2)
    blocks = [(np.arange(n, n + 30, dtype=np.int64).tobytes(), x[n : n + 30].tobytes()) for n in range(0, 900, 30)]
    of = lambda rows: pa.array(rows, pa.binary())
    batch = pa.RecordBatch.from_arrays(
        [pa.array([4] * 30), of([b[0] for b in blocks]), of([b[1] for b in blocks]), of([np.arange(6, dtype=np.int64).tobytes()] * 30), of([q.tobytes()] * 30)], ["dim", "ids", "rows", "q_ids", "q_rows"]
    )
    (got,) = vector._search(4, 2)(iter([batch.slice(1)]))
    score = np.round(q @ x[30:].T, 2) + 0.0
    want = [(n, int(i) + 30, float(score[n, i])) for n in range(6) for i in np.lexsort((np.arange(870), -score[n]))[:4]]
    assert [tuple(d.values()) for d in got.to_pylist()] == want
