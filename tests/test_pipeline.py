import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, extraction, vector
from tessera.plans import pipeline, store
from tessera.plans.settings import Settings
from tessera.sources.scratch import stored

PAGES = [
    (1, 1, "a.pdf", "# Deals.\nAlpha Technologies Inc. acquired Beta Systems Corp.\nIt runs Neo4j."),
    (2, 1, "b.pdf", "## Places.\nBeta Systems Corp is located in San Francisco."),
    (3, 1, "", ""),
]


def counts(store):
    return {t: getattr(store, t).count() for t in ("chunks", "vectors", "mentions", "entities", "relations")}


def test_ingestion_may_be_repeated_and_split(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "doc_id long, page_number int, filename string, text string")
    s = Settings(vector_width=16)
    once = counts(pipeline.ingest(pages, f"{tmp_path}/once", s))
    pipeline.ingest(pages.filter("doc_id = 1"), f"{tmp_path}/split", s)
    split = pipeline.ingest(pages.filter("doc_id > 1"), f"{tmp_path}/split", s)
    assert counts(split) == once
    again = pipeline.ingest(pages.filter("doc_id > 1"), f"{tmp_path}/split", s)
    assert counts(again) == once and again.vectors.select("vec_id").distinct().count() == once["vectors"]
    q = spark.createDataFrame([(1, "what")], "query_id long, question string")
    hits = vector.top_k(pipeline.query_vectors(q, pipeline.default_embedding(16)), again.vectors, 5).collect()
    assert len({h.vec_id for h in hits}) == len(hits) == 2
    changed = spark.createDataFrame([(2, 1, "b.pdf", "## Places.\nGamma Labs uses Redis."), (2, 2, "b.pdf", "more")], pages.schema)
    new = pipeline.ingest(changed, f"{tmp_path}/split", s)
    names = {r.canonical_name for r in new.entities.collect()}
    assert "Gamma Labs" in names and "San Francisco" not in names and new.chunks.count() == 3
    links = {r.page_number: (r.prev_chunk_id, r.chunk_id, r.next_chunk_id) for r in new.chunks.filter("doc_id = 2").collect()}
    assert links[1][2] == links[2][1] and links[2][0] == links[1][1] and links[1][0] is None
    # an ingestion that stopped before its entities doesn't count
    (tmp_path / "split" / "v00000009" / "chunks").mkdir(parents=True)
    assert counts(pipeline.Store.open(spark, f"{tmp_path}/split")) == counts(new)


def test_seeds_of_questions(spark):
    q = spark.createDataFrame([(1, "Who says that Alpha Labs acquired Beta Group?"), (2, "what about Zed, or Amy?"), (3, "")], "query_id long, question string")
    got = {}
    for r in extraction.question_seeds(q).orderBy("query_id", "ord").collect():
        got.setdefault(r.query_id, []).append(r.seed)
    assert got == {1: ["Alpha Labs", "Beta Group", "Be"], 2: ["Zed", "Amy"]}


def test_ingest_and_answer(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "doc_id long, page_number int, filename string, text string")
    s = Settings(vector_width=16)
    store = pipeline.ingest(pages, str(tmp_path), s)
    assert store.chunks.count() == 2 and {r.section_title for r in store.chunks.collect()} == {"Deals.", "Places."}
    assert {r.canonical_name for r in store.entities.collect()} >= {"Alpha Technologies Inc.", "Beta Systems Corp.", "Neo4j", "San Francisco"}
    q = spark.createDataFrame([(1, "Who bought Beta Systems Corp?"), (2, "what else"), (3, "WHAT ELSE ")], "query_id long, question string")
    rows = {r.query_id: r for r in pipeline.answer_batch(q, store, s).collect()}
    assert "Beta Systems Corp. (LOCATED_IN) -> San Francisco" in rows[1].response and rows[1].provenance_documents == "a.pdf, b.pdf"
    assert rows[2].n_chunks == 2 and rows[2].n_edges == 0
    v = {r.query_id: r.embedding for r in pipeline.query_vectors(q, pipeline.default_embedding(4)).collect()}
    assert v[2] == v[3] != v[1]
    fused, nodes, _ = pipeline.retrieve(q, store, Settings(vector_width=16, mode="relations", max_hops=1))
    assert {r.node for r in nodes.filter("query_id = 1").collect()} == {"Beta Systems Corp.", "San Francisco", "Be", "Alpha Technologies Inc."}  # "Be" ends a relation of the question
    assert pipeline.scored_nodes(fused, store.chunks).filter(F.col("node").contains('"section_title":"Deals."')).count() > 0


SCHEMA = "doc_id long, page_number int, filename string, text string"
TABLES = ("chunks", "vectors", "mentions", "entities", "relations")


def contents(s):
    """All rows of a store's tables, in order."""
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    return {t: rows(getattr(s, t)) for t in TABLES}


def some_page(rng, doc, page):
    orgs, tools = ("Alpha Labs", "Beta Group", "Gamma Systems", "Delta Bank"), ("Redis", "Docker", "CUDA")
    heading = rng.choice(("", "", f"# Part {doc}-{page}\n", f"## Sub {page}\n", f"# A\n## B{page}\n", f"## C\n# D{page}\n"))
    said = f"{rng.choice(orgs)} acquired {rng.choice(orgs)}.\nIt runs {rng.choice(tools)}.\n" if rng.random() < 0.8 else rng.choice(("", "plain words\n"))
    tail = rng.choice(("", "## Late\nmore about it\n"))
    return (doc, page, f"f{doc}-{page % 2}.pdf", heading + said + tail)


def test_section_of_split_pages(spark, tmp_path):
    pages = lambda *rows: spark.createDataFrame([(1, n, "", t) for n, t in rows], SCHEMA)
    s = Settings(vector_width=4)
    pipeline.ingest(pages((1, "# Deals.\nfirst")), f"{tmp_path}/a", s)
    a = pipeline.ingest(pages((2, "plain")), f"{tmp_path}/a", s)
    assert {r.page_number: r.section_title for r in a.chunks.collect()} == {1: "Deals.", 2: "Deals."}
    # an earlier page that comes later, and one that is replaced, change the sections after it
    a = pipeline.ingest(pages((0, "# Front\n## Sub\nx"), (1, "no heading any more")), f"{tmp_path}/a", s)
    assert {r.page_number: r.section_path for r in a.chunks.collect()} == {n: ["Front", "Sub"] for n in (0, 1, 2)}


def test_any_series_of_ingestions_equals_one(spark, tmp_path):
    rng = random.Random(1)
    s = Settings(vector_width=4, chunk_size=12, chunk_overlap=3, buckets=3)
    last = {}
    for _ in range(3):
        batch = {}
        for _ in range(rng.randint(3, 9)):
            p = some_page(rng, rng.randint(1, 6), rng.randint(1, 4))
            batch[p[:2]] = p
        last |= batch
        got = pipeline.ingest(spark.createDataFrame(list(batch.values()), SCHEMA), f"{tmp_path}/many", s)
    want = pipeline.ingest(spark.createDataFrame(list(last.values()), SCHEMA), f"{tmp_path}/one", s)
    assert contents(got) == contents(want)
    # merged tables are those of all rows at once
    m = extraction.merge_entities(got.mentions)
    assert sorted(map(repr, m.collect())) == sorted(map(repr, got.entities.select(*m.columns).collect()))
    pipeline.rebucket(spark, f"{tmp_path}/many", 2)
    assert store.vacuum(spark, f"{tmp_path}/many") > 0
    assert contents(pipeline.Store.open(spark, f"{tmp_path}/many")) == contents(want)
    assert {p for p in os.listdir(f"{tmp_path}/many") if p.startswith("v")} == {store.Snapshot.latest(spark, f"{tmp_path}/many").tables["chunks"].popitem()[1]}


def test_an_ingestion_reads_and_writes_touched_buckets_only(spark, tmp_path, monkeypatch):
    s = Settings(vector_width=4, buckets=64)
    folder = str(tmp_path)
    text = lambda d: f"# Head {d}\nOrg{chr(65 + d % 26)}{d} Labs acquired Corp{d} Holdings.\n" + "word " * 200
    opened = []
    read = store.Snapshot.read

    def counted(self, table, buckets=None):
        paths = self.paths(table, buckets)
        if paths and buckets is not None:
            opened.extend(paths)
        assert buckets is not None or not counting
        return read(self, table, buckets)

    monkeypatch.setattr(store.Snapshot, "read", counted)
    cost = []
    for first in (0, 400):
        counting = False
        pipeline.ingest(spark.createDataFrame([(d, 1, "", text(d)) for d in range(first, 5 * first + 40)], SCHEMA), folder, s)
        before = store.Snapshot.latest(spark, folder)
        opened.clear()
        monkeypatch.setattr(pipeline.Store, "open", staticmethod(lambda *_: None))
        counting = True
        pipeline.ingest(spark.createDataFrame([(7, 2, "", "OrgH7 Labs acquired Corp7 Holdings.")], SCHEMA), folder, s)
        after = store.Snapshot.latest(spark, folder)
        monkeypatch.undo()
        monkeypatch.setattr(store.Snapshot, "read", counted)
        changed = {t: {b for b in at if before.tables[t].get(b) != at[b]} for t, at in after.tables.items()}
        assert all(len(changed[t]) == 1 for t in pipeline.BY_PAGE)
        names = {r.canonical_name for r in read(after, "mentions", [int(b) for b in changed["mentions"]]).filter("doc_id = 7 AND page_number = 2").collect()}
        assert 0 < len(changed["entities"]) <= len(names) and len(changed["relations"]) == 1
        assert changed["entity_parts"] == changed["entities"]
        cost.append(len(set(opened)))
    assert max(cost) <= 2 * (len(pipeline.BY_PAGE) + 2 * (len(names) + 1))


def test_of_two_changes_from_one_state_one_fails(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame(PAGES, "doc_id long, page_number int, filename string, text string")
    s = Settings(vector_width=4)
    pipeline.ingest(pages, str(tmp_path), s)
    base = store.Snapshot.latest(spark, str(tmp_path))
    late = store.Change(base)
    pipeline.ingest(pages.filter("doc_id = 2"), str(tmp_path), s)
    want = contents(pipeline.Store.open(spark, str(tmp_path)))
    late.write("pages", base.read("pages").limit(0), ("doc_id",), range(base.buckets))
    with pytest.raises(store.Conflict):
        late.commit()
    assert contents(pipeline.Store.open(spark, str(tmp_path))) == want
    # one that fails half way leaves nothing visible
    monkeypatch.setattr(store.Merge, "apply", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pipeline.ingest(pages.filter("doc_id = 1"), str(tmp_path), s)
    assert contents(pipeline.Store.open(spark, str(tmp_path))) == want


def test_large_buckets_double(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "doc_id long, page_number int, filename string, text string")
    got = pipeline.ingest(pages, f"{tmp_path}/a", Settings(vector_width=4, buckets=2, bucket_bytes=10))
    assert store.Snapshot.latest(spark, f"{tmp_path}/a").buckets == 4
    assert contents(got) == contents(pipeline.ingest(pages, f"{tmp_path}/b", Settings(vector_width=4)))


def test_unique_chunks_need_no_shuffle_for_mentions_and_agree(spark):
    """Rows that hold all of their chunk: mentions as by grouping, without an exchange, and the same entities."""
    texts = [
        "Acme Corp acquired Beta Labs. Acme Corp uses Redis, redis and 5%.", "Beta Labs relies on Acme Corp for $5 million ", None, "", "ünited Acme Group bought Zeta Bank; éAcme Labs owns x",
        "Acme_x Corp is located in Rome and Beta LLC. is a subsidiary of Acme Inc.. Acme Corp purchased 9% of Acme Inc", "REDIS 7 % of $3 B was bought by $4.5 ",
    ]
    chunks = stored(spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "chunk_id long, doc_id long, text string"))
    noted = stored(extraction.annotated(chunks))
    one, other = extraction.mentions(noted, unique=True), extraction.mentions(noted)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(one) == rows(other) and one.count() > 15
    assert rows(extraction.merge_entities(one, unique=True)) == rows(extraction.merge_entities(one))


def test_new_pages_meet_no_row_of_the_store(spark, tmp_path, monkeypatch):
    """Only pages that the store knows already are looked for among its rows, and such are taken back."""
    s = Settings(vector_width=4, buckets=2)
    pages = lambda *rows: spark.createDataFrame([(d, n, "", f"Alpha{'x' * n} Labs acquired Beta Group.") for d, n in rows], SCHEMA)
    pipeline.ingest(pages(*((d, 1) for d in range(6))), f"{tmp_path}/a", s)
    joins, write = {}, store.Change.write

    def noted(self, table, rows, *rest):
        joins[table] = "LeftAnti" in rows._jdf.queryExecution().optimizedPlan().toString()
        return write(self, table, rows, *rest)

    monkeypatch.setattr(store.Change, "write", noted)
    pipeline.ingest(pages(*((d, 2) for d in range(6))), f"{tmp_path}/a", s)
    assert not any(joins[t] for t in pipeline.BY_PAGE)
    got = pipeline.ingest(pages((3, 2), (3, 3)), f"{tmp_path}/a", s)
    assert all(joins[t] for t in pipeline.BY_PAGE)
    want = pipeline.ingest(pages(*((d, n) for d in range(6) for n in (1, 2)), (3, 3)), f"{tmp_path}/b", s)
    assert contents(got) == contents(want)


def test_pages_are_folded_where_they_are(spark):
    """Chunks of a page without a shuffle, with the white space and line ends of the JVM's patterns."""
    odd = ("# A \x85\nb\x1cc d e\n##   x  \n\x85 y", " \t# Top\r\none two \n\n##  Sub\x0b\nthree four five　six", "\x1c\n \n## only", "", None, "##\n# \n#no\n# One\n## Two\n# Three\nw w w w w w w w")
    rows = stored(spark.createDataFrame([(i, 1, t) for i, t in enumerate(odd)], "doc_id long, page_number int, text string"))
    for size, overlap in ((3, 1), (5, 0), (384, 64)):
        folded = chunking.page_chunks(rows, size, overlap)
        assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()
        got = chunking.sections(folded.select("doc_id", F.inline("chunks"), F.lit(None).cast("string").alias("c1"), F.lit(None).cast("string").alias("c2")))
        want = chunking.chunks(rows, size, overlap)
        columns = ["doc_id", "chunk_no", "text", "token_count", "section_title", "section_path"]
        assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
        heads = {(r.doc_id, r.h1, r.h2) for r in folded.collect() if r.h1 is not None or r.h2 is not None}
        assert heads == {(r.doc_id, r.h1, r.h2) for r in chunking.page_headings(chunking.lines(rows)).collect() if r.h1 is not None or r.h2 is not None}


def test_parts_of_entities_group_numbers_and_equal_counts(spark):
    rng = random.Random(4)
    rows = sorted({(c, rng.choice("ABC"), c % 4) for c in range(40) for _ in range(3)})
    rows = [(c, n, d, d % 2, rng.randint(0, 3), rng.choice((n, n.lower())), "K", 0.5) for c, n, d in rows]
    m = stored(spark.createDataFrame(rows, "chunk_id long, canonical_name string, doc_id long, doc_bucket int, ord int, name string, entity_type string, confidence double"))
    parts = extraction.entity_parts(m, ["canonical_name"])
    want = {}
    for c, n, d, b, o, spelt, *_ in rows:
        docs, chunks, first = want.get((n, b), (set(), 0, (99, 0, "")))
        want[n, b] = docs | {d}, chunks + 1, min(first, (c, o, spelt))
    got = {(r.canonical_name, r.doc_bucket): (r.n_docs, r.n_chunks, (r.e.chunk_id, r.e.ord, r.e.name)) for r in parts.collect()}
    assert got == {k: (len(docs), n, first) for k, (docs, n, first) in want.items()}
    plan = parts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert all("count(" not in line and "doc_id" not in line for line in plan.splitlines() if "SortAggregate" in line)


def test_verbs_and_tools_in_one_pass_equal_the_patterns():
    import re

    rng = random.Random(5)
    bits = ["alpha", "beta corp.", "inc.", "zinc.", "acquired", "ltd", ".", ",", "-", "\n", "owns", "_x", "bought", "é", "·", "gpt-4", "roberta", "bert", "redis", "cuda", "neo4j", "owned by", "ownso", "$5", "based in"]
    tools, clauses = extraction._compiled(extraction.TECHNOLOGY), extraction._compiled(extraction.CLAUSE)
    for _ in range(2000):
        text = "".join(b + rng.choice((" ", "")) for b in rng.choices(bits, k=rng.randint(1, 15)))
        found, verbs = extraction._found(text)
        assert found == [m.span() for m in tools.finditer(text)]
        for nth, _, _, words, _ in extraction._RULES:
            want = [(m.start(), m.end(), m.start() + max(m[0].rfind(w) for w in words)) for m in clauses.finditer(text) if any(w in m[0] for w in words)]
            assert [tuple(c) for c in extraction._clauses(text.encode("latin-1").translate(extraction._PARTS), verbs.get(nth, []))] == want
