"""Answers of query batches: one row per query, as strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import or_else

# Texts and limits of the answer's format, here and in the functions below.
NOT_FOUND = "No relevant information found in the knowledge base."
FACTS, EXCERPTS, EXCERPT_CHARS = 8, 3, 250
INTRO = "Based on hybrid multi-document retrieval for"


def _in_order(*columns: str):
    return F.sort_array(F.collect_list(F.struct(*columns)))


def triples_context(edges: DataFrame) -> DataFrame:
    """``query_id, context``: a query's edges as text for a prompt."""
    some = or_else(F.col("description"), F.lit(None))
    line = F.concat(F.lit("• ("), "source", F.lit(") -["), "relation", F.lit("]-> ("), "target", F.lit(")"), F.coalesce(F.concat(F.lit(": "), some), F.lit("")))
    lines = edges.withColumn("line", line).groupBy("query_id").agg(_in_order("source", "relation", "target", "line").alias("e"))
    head = F.lit("=== KNOWLEDGE GRAPH VERIFIED TRIPLETS (Ground Truth) ===\n")
    return lines.select("query_id", F.concat(head, F.array_join(F.transform("e", lambda e: e["line"]), "\n")).alias("context"))


def multi_hop_paths(edges: DataFrame) -> DataFrame:
    """``query_id, paths``: source, relation and target of each edge."""
    e = edges.groupBy("query_id").agg(_in_order("source", "relation", "target").alias("e"))
    return e.select("query_id", F.array_join(F.transform("e", lambda e: F.concat_ws(" | ", e["source"], e["relation"], e["target"])), "\n").alias("paths"))


def provenance(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, provenance_documents``: sorted distinct file names (or ids) of the chunks."""
    doc = or_else(F.col("filename"), F.col("doc_id").cast("string"))
    joined = fused.join(chunks.select("chunk_id", doc.alias("doc")), "chunk_id")
    return joined.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("doc")), ", ").alias("provenance_documents"))


def answers(queries: DataFrame, fused: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, response, n_chunks, n_edges``.

    ``queries(query_id, question)``. Up to ``FACTS`` edges, up to ``EXCERPTS`` excerpts of the
    best chunks, and the sources of those, sorted.
    """
    some = or_else(F.col("description"), F.lit(None))
    plain = F.concat("source", F.lit(" -"), "relation", F.lit("-> "), "target")
    fact = F.coalesce(F.concat("source", F.lit(" ("), "relation", F.lit(") -> "), "target", F.lit(" ["), some, F.lit("]")), plain)
    facts = edges.withColumn("fact", fact).groupBy("query_id").agg(_in_order("source", "relation", "target", "fact").alias("e"))
    doc = or_else(F.col("filename"), F.col("doc_id").cast("string"))
    shown = fused.join(chunks.select("chunk_id", "page_number", "text", doc.alias("doc")), "chunk_id")
    body = F.left(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit(EXCERPT_CHARS))
    excerpt = F.format_string("  [%d] (Source: %s, p.%d) %s...", F.col("rank"), "doc", "page_number", body)
    source = F.format_string("%s (Page %d)", F.col("doc"), F.col("page_number"))
    named = F.when(F.col("rank") <= EXCERPTS, F.col("source"))
    cited = shown.withColumns({"excerpt": excerpt, "source": source}).groupBy("query_id").agg(
        _in_order("rank", "excerpt").alias("x"), F.array_join(F.array_sort(F.collect_set(named)), ", ").alias("sources"), F.count("*").alias("n_chunks")
    )
    out = queries.join(facts, "query_id", "left").join(cited, "query_id", "left")
    fact_part = F.when(F.col("e").isNotNull(), F.concat(F.lit("Key Entity & Relational Insights:\n"), F.array_join(F.transform(F.slice("e", 1, FACTS), lambda e: F.concat(F.lit("  • "), e["fact"])), "\n"), F.lit("\n")))
    text_part = F.when(F.col("x").isNotNull(), F.concat(F.lit("Supporting Evidence:\n"), F.array_join(F.transform(F.slice("x", 1, EXCERPTS), lambda x: x["excerpt"]), "\n"), F.lit("\n")))
    intro = F.concat(F.lit(f"{INTRO} '"), F.col("question"), F.lit("':\n"))
    whole = F.concat_ws("\n", intro, fact_part, text_part, F.concat(F.lit("Sources: "), F.coalesce("sources", F.lit(""))))
    return out.select(
        "query_id", F.when(F.col("e").isNull() & F.col("x").isNull(), NOT_FOUND).otherwise(whole).alias("response"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce(F.size("e"), F.lit(0)).alias("n_edges")
    )


def prompts(queries: DataFrame, fused: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, prompt``: the text that a model would be asked to complete."""
    shown = fused.join(chunks.select("chunk_id", "text"), "chunk_id")
    listed = shown.groupBy("query_id").agg(_in_order("rank", "text").alias("x"))
    joined = F.array_join(F.transform("x", lambda x: F.concat(F.lit("Chunk "), x["rank"].cast("string"), F.lit(":\n"), x["text"])), "\n\n")
    out = queries.join(triples_context(edges), "query_id", "left").join(listed.select("query_id", joined.alias("docs")), "query_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(
        "query_id",
        F.concat(
            F.lit("Answer the user query based strictly on the verified knowledge graph and documents.\n\n"), empty("context"),
            F.lit("\n\nDOCUMENT CONTEXT:\n"), empty("docs"), F.lit("\n\nQuery: "), F.col("question"), F.lit("\nAnswer:"),
        ).alias("prompt"),
    )
