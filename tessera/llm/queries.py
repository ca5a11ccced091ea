"""``opN_<name>``: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, chat, decontaminate, language_id, license_scan, lm, mixing, oracles, prefix_trie, quality, secret_scan, token_align, warc
from tessera.llm.common import crc_mod, stored, table
from tessera.llm.near_dup import near_duplicates

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL["op9_minhash_near_dup"] = oracles.NEAR_DUP


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 whose two texts are made of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    formatted = stored(chat.render(chat.fold(chat.row_events(rows.unionByName(probe)))))
    return chat.digest(chat.parse(formatted))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op6_chat_formatting"] = oracles.CHAT
ORACLE_SQL["op3_mixing"] = oracles.MIXING


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in two increments, the second of which skips the blobs of the first."""
    found = secret_scan.document_secrets(table(spark, sf_dir, "documents"), increments=2)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = language_id.fit(docs, ~held_out)
    found = language_id.identified(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    chain = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    predicted = F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0)
    return quality.scored(docs, chain).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


ORACLE_SQL["op8_ann"] = oracles.ANN


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    found = lm.scored(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives, folder)


ORACLE_SQL["op2_warc"] = oracles.WARC


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.aligned(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op12_prefix_trie"] = oracles.TRIE


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licensed(table(spark, sf_dir, "documents"))
