"""Name -> query, and name -> DuckDB SQL, of every retrieval operator.

Each query reads the driver's tables, or corpora that Spark derives from them, whole. The SQL is
in :mod:`tessera.plans.oracles`, under the same names. Queries over the graph of the reports read
its tables as an ingestion leaves them, which the first such query of a session writes.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import answer, chunking, extraction, fulltext, fusion, gazetteer, graph, layout, metrics, query_cache, text_vectors, vector
from tessera.plans import calls, pipeline, vector_store
from tessera.plans.oracles import ORACLE_SQL as _SQL
from tessera.plans.settings import Settings
from tessera.sources.scratch import exists, scratch, shared_dir, stored
from tessera.sources.tables import TOOLS, document_pages, letters, reports, table, trade_graph

QUERIES: dict = {}
ORACLE_SQL: dict = dict(_SQL)


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- carriers ---------------------------------------------------------------------------------


def lexicon_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of documents, each document a chunk of its own."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))).alias("canonical_name"))
    return words.select(F.col("doc_id").alias("chunk_id"), "doc_id", "canonical_name", F.lit(1.0).alias("confidence"))


def benchmark_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, ord, seed``: up to four capitalised words of each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(fx.seeds_by_capitals(F.col("text"))).alias("ord", "seed"))
    return items.filter("seed <> ''")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per nation, about its company and a tool or a customer: ``query_id, question``."""
    n = table(spark, sf_dir, "nation")
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("n_nationkey") % len(TOOLS) + 1).cast("int"))
    org = F.concat(F.lit("Nation"), letters(F.col("n_nationkey")), F.lit(" Systems LLC"))
    plain = F.concat(F.lit("Who works with "), org, F.lit(", and does it use "), tool, F.lit("?"))
    deal = F.concat(F.lit("Who says that Cust"), letters(F.col("n_nationkey")), F.lit(" Corp acquired "), org, F.lit(" for "), tool, F.lit("?"))
    return n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.when(F.col("n_nationkey") % 5 == 1, deal).otherwise(plain).alias("question"))


_GRAPHS: dict = {}


def report_graph(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """``pages, mentions, entities, triples, relations`` of the reports, extracted once a session and stored."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _GRAPHS or not all(exists(spark, t.stored_at) for t in vars(_GRAPHS[key]).values()):
        _GRAPHS.clear()
        with scratch(spark) as s:
            pages = reports(spark, sf_dir)
            noted = stored(extraction.annotated(pages))
            # pages are columns of the same table, of which Parquet reads no more
            g = SimpleNamespace(pages=noted.select(*pages.columns))
            g.pages.stored_at = noted.stored_at
            unique = noted.groupBy("chunk_id").count().filter("count > 1").isEmpty()
            g.mentions, g.triples = stored(extraction.mentions(noted, unique=unique)), stored(extraction.relations(noted))
            g.entities, g.relations = stored(extraction.merge_entities(g.mentions, unique=unique)), stored(extraction.merge_relations(g.triples))
            s.keep(*vars(g).values())
        _GRAPHS[key] = g
    return _GRAPHS[key]


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("seed"))


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("seed"))


# --- vectors ----------------------------------------------------------------------------------


def _vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top_k(_vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), k=5)


@query
def vector_store_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store in cells, into which a third of the vectors came later and replaced others."""
    e, folder = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), shared_dir(spark)
    late = F.col("vec_id") % 3 == 0
    turned = F.transform("embedding", lambda x: -x)
    vector_store.create(e.withColumn("embedding", F.when(late, turned).otherwise(F.col("embedding"))), folder)
    vector_store.upsert(e.filter(late), folder)
    return vector_store.top_k(_vector_queries(spark, sf_dir), folder, k=5)


@query
def vector_topk_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector.top_k(_vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), k=5)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    whole = vector.with_payload(hits, docs)
    return whole.select("query_id", "rank", "chunk_id", "score", F.length("text").cast("long").alias("text_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query
def vector_missing_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector.top_k(_vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), k=5)
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_id"), F.left("url", F.lit(1000)).alias("text"))
    return vector.with_payload(hits, items, keep_missing=True).select("query_id", "rank", "chunk_id", "score", "text")


@query
def vector_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.left("event_type", F.lit(1000)).alias("event_type"))
    return vector.upsert(e.filter("event_type <> 'click'"), e.filter("event_type = 'click'"), "user_id", "event_id")


@query
def pseudo_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = vector.pseudo_embedding(8)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(embed("text"), lambda x: F.round(x, 6).cast("string")), ",").alias("embedding"))


@query
def learned_vectors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents most similar to each benchmark item, by vectors learned from all documents."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    place = text_vectors.fit(docs).column
    asked = items.select(F.col("item_id").alias("query_id"), place(F.col("text")).alias("embedding"))
    return vector.top_k(asked, docs.select(F.col("doc_id").alias("vec_id"), place(F.col("text")).alias("embedding")), k=5)


@query
def query_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").filter("role = 'user'").select(fx.cache_key(F.col("text")).alias("cache_key"))
    return q.groupBy("cache_key").agg(F.count("*").alias("n_asked"))


@query
def query_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What caches of 16, 128 and 10,000 keys do with each question of the conversations."""
    q = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    runs = [query_cache.replay(q, ("conv_id", "turn"), fx.cache_key(F.col("text")), size)[0].withColumn("capacity", F.lit(size)) for size in (16, 128, query_cache.CAPACITY)]
    return reduce(DataFrame.unionByName, runs).select("capacity", "conv_id", "turn", "cache_key", "hit", "evicted_key")


# --- chunks -----------------------------------------------------------------------------------


@query
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.lines(document_pages(spark, sf_dir)).select("doc_id", "line_no", "n_words", F.md5(F.encode("line", "UTF-8")).alias("line_md5"))


@query
def heading_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = chunking.headings(chunking.lines(reports(spark, sf_dir)))
    return h.select("doc_id", "page_number", "line_no", "section_title", F.array_join("section_path", " / ").alias("section_path"))


@query
def chunk_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_ranges(chunking.lines(document_pages(spark, sf_dir))).select("doc_id", "chunk_no", "start_word", "token_count")


@query
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(document_pages(spark, sf_dir))
    return c.select("doc_id", "chunk_no", "token_count", "section_title", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(reports(spark, sf_dir), size=16, overlap=4).select("doc_id", "page_number", "chunk_no", "token_count", "section_title", "text")


@query
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.links(table(spark, sf_dir, "conversations"), "conv_id", "turn", key="turn").select("conv_id", "turn", "prev_turn", "next_turn")


@query
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.links(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", key="text")


# --- extraction -------------------------------------------------------------------------------


def _extracted(spark, sf_dir, kind: str) -> DataFrame:
    m = extraction.mentions(reports(spark, sf_dir), ends_too=kind == "METRIC").filter(F.col("entity_type") == kind)
    return m.select("chunk_id", "canonical_name", "name", "entity_type", "confidence")


@query
def extract_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, "ORGANIZATION")


@query
def extract_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, "TECHNOLOGY")


@query
def extract_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, "METRIC")


@query
def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*map(F.lit, (" Inc", " Corp.", " LLC.", " Ltd", " Co.", ".", "!?", "")))
    raw = F.concat(F.lit(" ("), F.initcap(F.split("p_name", " ")[0]), F.lit("  "), F.col("p_brand"), F.element_at(endings, (F.col("p_partkey") % 8 + 1).cast("int")), F.lit(" "))
    alias = F.element_at(F.array(*map(F.lit, (" google ", "Apple", "NVIDIA", "meta.", "other"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fx.canonical(raw).alias("canonical_name"), fx.canonical(alias).alias("alias_name"))


@query
def relation_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = extraction.relations(reports(spark, sf_dir))
    return r.select("chunk_id", "source", "target", "relation_type", "position", "description", "weight", "confidence")


@query
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.merge_entities(extraction.mentions(reports(spark, sf_dir))).select("canonical_name", "entity_type", "confidence", "n_chunks", "n_docs", "first_chunk")


@query
def entity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.entity_sources(extraction.mentions(reports(spark, sf_dir)))


@query
def relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.merge_relations(extraction.relations(reports(spark, sf_dir)))


@query
def query_seeds_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_seeds(spark, sf_dir)


@query
def gazetteer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names that the reports' graph knows in all texts of the reports."""
    g = report_graph(spark, sf_dir)
    return gazetteer.occurrences(g.pages, g.entities).select("chunk_id", "canonical_name", "first_at")


# --- full text --------------------------------------------------------------------------------


def _bm25(spark, sf_dir, k: int):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return fulltext.top_k(fulltext.build(docs), asked, k)


@query
def fulltext_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest BM25 for each benchmark item."""
    return _bm25(spark, sf_dir, 10)


@query
def rrf_three_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of grounded documents and full-text hits of the benchmark items; vectors of the same ids as a third list."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = vector.top_k(asked, e, k=5).withColumnRenamed("vec_id", "chunk_id")
    grounded = graph.grounded_chunks(benchmark_seeds(spark, sf_dir), lexicon_mentions(spark, sf_dir))
    fused = fusion.fuse(hits, grounded, k=None, keyword_hits=_bm25(spark, sf_dir, 5))
    return fused.select("query_id", "chunk_id", "vector_score", "graph_score", "keyword_score", "fused_score", "rank")


# --- store ------------------------------------------------------------------------------------


def increment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports with headings on every third page only, which carry over to the next two."""
    bare = F.regexp_replace("text", r"#+ [^\n]*", "")
    return reports(spark, sf_dir).withColumn("text", F.when(F.col("page_number") % 3 == 1, F.col("text")).otherwise(bare))


_STORES: dict = {}


def increment_store(spark: SparkSession, sf_dir: str) -> pipeline.Store:
    """The reports in three ingestions, later pages first; drafts of a part are replaced by the last one."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORES or not exists(spark, _STORES[key]):
        folder, s = shared_dir(spark), Settings(vector_width=8)
        draft = F.lit("# Draft\nDraft Group acquired Alpha Labs.\n")
        third = F.col("page_number") % 3
        with scratch(spark):
            pages = stored(increment_pages(spark, sf_dir))
            drafts = pages.filter((third == 1) & (F.col("doc_id") % 4 == 0)).withColumn("text", draft)
            for part in (pages.filter(third == 0).unionByName(drafts), pages.filter(third == 2), pages.filter(third == 1)):
                pipeline.ingest(part, folder, s)
        _STORES[key] = folder
    return pipeline.Store.open(spark, _STORES[key])


@query
def chunk_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = increment_store(spark, sf_dir).chunks
    path = F.array_join("section_path", " / ").alias("section_path")
    place = F.concat_ws("|", F.col("doc_id").cast("string"), "page_number", "chunk_no")
    return c.select("doc_id", "page_number", "chunk_no", "token_count", "section_title", path, "filename", "text", (F.col("chunk_id") == F.xxhash64(place)).alias("id_of_place"), F.col("prev_chunk_id").isNull().alias("is_first"))


@query
def store_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return increment_store(spark, sf_dir).entities.select("canonical_name", "n_chunks", "n_docs")


@query
def store_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return increment_store(spark, sf_dir).relations.select("source", "target", "relation_type", "description", "weight", "confidence")


# --- graph ------------------------------------------------------------------------------------


@query
def grounded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.grounded_chunks(benchmark_seeds(spark, sf_dir), lexicon_mentions(spark, sf_dir))


@query
def grounded_chunks_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = extraction.question_seeds(questions(spark, sf_dir))
    return graph.grounded_chunks(seeds, report_graph(spark, sf_dir).mentions, by_confidence=True)


@query
def multi_doc_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return graph.bridges(benchmark_seeds(spark, sf_dir), lexicon_mentions(spark, sf_dir), docs)


@query
def multi_doc_bridges_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = report_graph(spark, sf_dir)
    titles = g.pages.groupBy("doc_id").agg(F.nullif(F.min("title"), F.lit("")).alias("title"))
    seeds = extraction.question_seeds(questions(spark, sf_dir))
    return graph.bridges(seeds, g.mentions, g.pages, both_orders=True, documents=titles).drop("chunk1_text", "chunk2_text")


@query
def neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = trade_graph(spark, sf_dir)
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("seed"))
    return graph.neighbours(seeds, entities, relations)


@query
def neighbors_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = trade_graph(spark, sf_dir)
    return graph.neighbours(_nations(spark, sf_dir), entities, relations, limit=10)


@query
def subgraph_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = trade_graph(spark, sf_dir)
    return graph.two_hop_edges(_nations(spark, sf_dir), entities, relations, limit=25)


@query
def subgraph_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = trade_graph(spark, sf_dir)
    return graph.two_hop_edges(_regions(spark, sf_dir), entities, relations)


@query
def bfs_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = trade_graph(spark, sf_dir)
    return graph.bfs(_regions(spark, sf_dir), graph.undirected(relations), entities, max_hops=2)


@query
def bfs_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = report_graph(spark, sf_dir)
    return graph.bfs(extraction.question_seeds(questions(spark, sf_dir)), graph.mention_edges(g.mentions), g.entities, max_hops=2)


@query
def bfs_whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hops from each region's company, through documents and neighbouring chunks as well."""
    g = report_graph(spark, sf_dir)
    seeds = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("Cust"), letters(F.col("r_regionkey") * 5 + 1), F.lit(" Corp.")).alias("seed"))
    return graph.bfs(seeds, graph.traversal_edges(g.pages, g.mentions, g.relations, 3), g.entities, max_hops=3)


@query
def bfs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = trade_graph(spark, sf_dir)
    nodes = graph.bfs(_regions(spark, sf_dir), graph.undirected(relations), entities, max_hops=2)
    return graph.induced_edges(nodes, relations, limit=25)


@query
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = trade_graph(spark, sf_dir)
    starts = _regions(spark, sf_dir).select(F.col("seed").alias("start"))
    ends = entities.filter("entity_type = 'CUSTOMER'").select(F.col("canonical_name").alias("end"))
    return graph.shortest_paths(starts, ends, relations, most=4)


@query
def dangling_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = trade_graph(spark, sf_dir)
    return graph.dangling_entities(entities.filter("entity_type <> 'NATION'"), relations)


@query
def mention_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return graph.guarded_mentions(lexicon_mentions(spark, sf_dir), known).groupBy("doc_id").agg(F.count("*").alias("n_mentions"))


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = report_graph(spark, sf_dir)
    e = graph.all_edges(g.pages, g.mentions, g.triples)
    return e.groupBy("rel_type", "explicit_rel").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), F.sum("page").alias("pages"))


# --- fusion and answers -----------------------------------------------------------------------


def _retrieved(spark: SparkSession, sf_dir: str, k: int | None = 5):
    """Questions, chunks, fused hits and edges of the batch over the reports: two hops on the whole graph."""
    g, q = report_graph(spark, sf_dir), questions(spark, sf_dir)
    seeds = stored(extraction.question_seeds(q))
    e = table(spark, sf_dir, "embeddings")
    q_vectors = e.join(q, F.col("vec_id") == F.col("query_id"), "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    known = e.join(g.pages, F.col("vec_id") == F.col("chunk_id"), "left_semi")
    hits = vector.top_k(q_vectors, known, k=5).withColumnRenamed("vec_id", "chunk_id")
    # read by the bonus and by both ends of the edges
    nodes = stored(graph.bfs(seeds.select("query_id", "seed"), graph.traversal_edges(g.pages, g.mentions, g.relations, 2), g.entities, max_hops=2))
    edges = graph.induced_edges(nodes, g.relations, limit=25)
    fused = stored(fusion.fuse(hits, graph.grounded_chunks(seeds, g.mentions), nodes, k=k))
    return q, g.pages, fused, edges


@query
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.posexplode(fx.seeds_by_capitals(F.col("text"))).alias("ord", "seed")))
    asked = _vector_queries(spark, sf_dir).join(docs.select("query_id").distinct(), "query_id", "left_semi")
    hits = vector.top_k(asked, table(spark, sf_dir, "embeddings"), k=5).withColumnRenamed("vec_id", "chunk_id")
    fused = fusion.fuse(hits, graph.grounded_chunks(docs.filter("seed <> ''"), lexicon_mentions(spark, sf_dir)), k=None)
    return fused.select("query_id", "chunk_id", "vector_score", "graph_score", "keyword_score", "fused_score", "rank")


@query
def rrf_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = _retrieved(spark, sf_dir)[2]
    return fused.select("query_id", "chunk_id", "vector_score", "graph_score", "keyword_score", "fused_score", "overlap", "rank", "graph_provenance")


@query
def triples_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.triples_context(bfs_edges(spark, sf_dir))


@query
def multi_hop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.multi_hop_paths(bfs_edges(spark, sf_dir))


@query
def provenance_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pages, fused, _ = _retrieved(spark, sf_dir)
    return answer.provenance(fused, pages)


@query
def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, pages, fused, edges = _retrieved(spark, sf_dir)
    edges = stored(edges)
    out = answer.answers(q, fused, edges, pages)
    return out.join(answer.provenance(fused, pages), "query_id", "left").join(answer.multi_hop_paths(edges), "query_id", "left")


@query
def scored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused chunks as JSON objects, of which the fields are read back."""
    _, pages, fused, _ = _retrieved(spark, sf_dir)
    nodes = pipeline.scored_nodes(fused, pages.withColumn("section_title", F.lit("General")))
    of = lambda path: F.get_json_object("node", path)
    return nodes.select(
        "query_id", "rank", of("$.id").alias("id"), F.md5(F.encode(of("$.text"), "UTF-8")).alias("text_md5"), of("$.score").cast("double").alias("score"), of("$.metadata.filename").alias("filename"),
        of("$.metadata.page_number").alias("page_number"), of("$.metadata.section_title").alias("section_title"), of("$.metadata.vector_score").cast("double").alias("vector_score"), of("$.metadata.graph_score").cast("double").alias("graph_score"),
    )


@query
def llm_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, pages, fused, edges = _retrieved(spark, sf_dir)
    return answer.prompts(q, fused, edges, pages).select("query_id", F.length("prompt").cast("long").alias("prompt_chars"), F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"))


def _summary(prompts: list[str]) -> list[str]:
    """Stands in for a model: the number of characters of a prompt, and its end."""
    return [f"{len(p)} characters, ending in {p[-12:]}" for p in prompts]


@query
def call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of conversations as prompts, in two runs: what the first has called for the second doesn't."""
    turns, folder = table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("prompt")), shared_dir(spark)
    calls.complete(turns.filter("conv_id % 2 = 0"), folder, _summary, model="stand-in", size=512)
    done = calls.complete(turns, folder, _summary, model="stand-in", size=512)
    return done.groupBy("key", "state", "answer", "run").agg(F.count("*").alias("n_asked"))


# --- metrics and layout -----------------------------------------------------------------------


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_summary(table(spark, sf_dir, "events"), F.col("value"), "event_type", budget=40.0)


@query
def latency_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of the log as partials of hours, put together; the summary of those of odd days."""
    e = table(spark, sf_dir, "events")
    part = lambda rows: stored(metrics.latency_partials(rows, "ts", F.col("value"), "event_type"))
    whole = metrics.merged_partials(part(e.filter("event_id % 2 = 0")), part(e.filter("event_id % 2 = 1 OR event_id IS NULL")))
    return metrics.summary_of_partials(whole.filter(F.dayofmonth("at") % 2 == 1), "event_type", budget=40.0)


@query
def latency_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_summary(table(spark, sf_dir, "events").filter("event_type = 'no such type'"), F.col("value"))


@query
def sla_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"compliant": F.col("value") <= 40.0, "exceeds": F.col("value") > 40.0})
    return e.groupBy("user_id").agg(F.count(F.when(F.col("compliant"), 1)).alias("n_compliant"), F.count(F.when(F.col("exceeds"), 1)).alias("n_exceeding"))


@query
def stage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select(*(F.when(F.col("event_id") % len(metrics.STAGES) == n, F.col("value")).alias(s) for n, s in enumerate(metrics.STAGES)))
    return metrics.stage_breakdown(log)


@query
def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary_lines(latency_percentiles(spark, sf_dir))


@query
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = report_graph(spark, sf_dir)
    c = chunking.chunk_ranges(chunking.lines(g.pages))
    return metrics.ingest_stats(g.pages, c, g.entities, g.triples, elapsed=12.5, ocr=F.length("text") < 150)


def _spans(spark, sf_dir):
    """All words of each page's texts between tags as spans of sizes and places that depend on their tag and order."""
    html = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(r"<([a-z0-9]+)[^<>]*>([^<>]+)"), F.lit(1)).alias("tags"), F.regexp_extract_all("html", F.lit(r"<([a-z0-9]+)[^<>]*>([^<>]+)"), F.lit(2)).alias("texts"))
    b = html.select("page_id", F.posexplode(F.arrays_zip("tags", "texts")).alias("block_no", "b"))
    w = b.select("page_id", "block_no", "b.tags", F.posexplode(F.split("b.texts", " ")).alias("n", "text"))
    n, k = F.col("n"), F.col("block_no")
    size = F.when(F.col("tags") == "h1", 24.0).when((F.col("tags") == "h2") | ((n + k) % 11 == 0), 16.0).otherwise(10.0)
    return w.select(
        "page_id", "block_no", F.floor(n / 8).cast("int").alias("line_no"), (n % 8).alias("span_no"), ((k * 37) % 50).cast("double").alias("x"), ((k * 53) % 97).cast("double").alias("y"), size.alias("size"), F.concat("text", F.lit(" ")).alias("text"),
    )


@query
def heading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.heading_levels(_spans(spark, sf_dir))


@query
def layout_blocks_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(layout.heading_levels(_spans(spark, sf_dir)))


@query
def ocr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against that of the next document as what OCR has found, whole."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("ocr"))
    chosen = d.join(other, "doc_id", "left").select("doc_id", layout.with_ocr(F.col("text"), F.col("ocr")).alias("text"))
    return chosen.select("doc_id", F.length("text").cast("long").alias("text_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query
def metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).groupBy("doc_id").agg(F.min("title").alias("title"), F.min("filename").alias("filename"))
    return r.select("doc_id", fx.or_else(F.col("title"), F.col("filename")).alias("title"), F.left(fx.or_else(F.col("title"), F.lit("General")), F.lit(12)).alias("section"))


@query
def synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir)
