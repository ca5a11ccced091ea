"""Readers of the driver's tables, and corpora that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(number: Column) -> Column:
    """Decimal digits as letters a to j, for names that the organisation pattern accepts."""
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


SUFFIXES = ("Technologies Inc.", "Corp", "LLC", "Labs", "Holdings")
TOOLS = ("Kubernetes", "PostgreSQL", "Redis", "Docker", "Milvus", "FastAPI", "BERT")
VERBS = (
    "acquired", "is a subsidiary of", "partnered with", "developed", "depends on", "is located in", "officially bought", "relies on",
)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per customer with a page per order: ``chunk_id, doc_id, page_number, filename, title, text``.

    Pages name the customer's company, a company of its nation, a tool and an amount, so that all
    extraction rules have work that grows with ``orders``.
    """
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    o = o.withColumns(
        {
            "page_number": page,
            "org": F.concat(F.lit("Cust"), letters(F.col("o_custkey")), F.lit(" "), pick(SUFFIXES, F.col("o_custkey"))),
            "partner": F.concat(F.lit("Nation"), letters(F.col("c_nationkey")), F.lit(" Systems LLC")),
            "tool": pick(TOOLS, F.col("o_orderkey")),
            "verb": pick(VERBS, F.col("o_orderkey")),
            "amount": F.floor(F.col("o_totalprice") / 1000).cast("string"),
        }
    )
    # the patterns that read the texts are heavier than the rows' bytes tell: keep all partitions
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    text = F.concat(
        F.lit("# Order review "), F.col("page_number").cast("string"), F.lit("\n\n## Summary.\nThis year, "), "org", F.lit(" "), "verb", F.lit(" "), "partner",
        F.lit(".\nIts platform runs on "), "tool", F.lit(".\n\n## Results.\nIn total, "), "org", F.lit(" reported revenue of $"), "amount", F.lit(" million, and margins rose by "),
        (F.col("o_orderkey") % 90).cast("string"), F.lit("%.\n"),
    )
    return o.select(
        F.col("o_orderkey").alias("chunk_id"),
        F.col("o_custkey").alias("doc_id"),
        "page_number",
        F.concat(F.lit("report_"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Report of "), "org")).alias("title"),
        text.alias("text"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text of one page: ``doc_id, page_number, text``."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``entities(canonical_name, name, entity_type)`` and ``relations(source, target, relation_type,
    description, weight)``: customers and suppliers in nations, nations in regions."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    entity = lambda df, kind, key, name: df.select(node(kind, key).alias("canonical_name"), F.col(name).alias("name"), F.lit(kind.upper()).alias("entity_type"))
    entities = (
        entity(t("customer"), "customer", "c_custkey", "c_name")
        .unionByName(entity(t("supplier"), "supplier", "s_suppkey", "s_name"))
        .unionByName(entity(t("nation"), "nation", "n_nationkey", "n_name"))
        .unionByName(entity(t("region"), "region", "r_regionkey", "r_name"))
    )

    def edge(df, kind, key, to, fk, relation):
        return df.select(
            node(kind, key).alias("source"), node(to, fk).alias("target"), F.lit(relation).alias("relation_type"),
            F.concat_ws(" ", node(kind, key), F.lit(relation), node(to, fk)).alias("description"), F.lit(1.0).alias("weight"),
        )

    relations = (
        edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "LOCATED_IN")
        .unionByName(edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "LOCATED_IN"))
        .unionByName(edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "PART_OF"))
    )
    return entities, relations
