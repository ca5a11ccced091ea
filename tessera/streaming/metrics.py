"""Structured Streaming forms of the latency log, the query cache and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import cache_key
from tessera.operators.metrics import BUDGET_MS


def windowed_latency(log: DataFrame, ts: str, value: Column, window: str = "10 minutes", late: str = "20 minutes", budget: float = BUDGET_MS) -> DataFrame:
    """Count, mean, approximate percentiles and compliance of each event-time window.

    Rows later than ``late`` are dropped, so the state is bounded; exact percentiles of a closed
    log are those of ``operators.metrics``.
    """
    log = log.withColumn("_ms", value.cast("double")).withWatermark(ts, late)
    p = F.percentile_approx("_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 10000)
    agg = log.groupBy(F.window(ts, window).alias("w")).agg(
        F.count("_ms").alias("count"), F.avg("_ms").alias("mean_ms"), p.alias("p"), (F.avg(F.when(F.col("_ms") <= budget, 1.0).otherwise(0.0)) * 100).alias("sla_compliance_pct")
    )
    return agg.select("w.start", "w.end", "count", F.round("mean_ms", 2).alias("mean_ms"), *(F.col("p")[i].alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))), F.round("sla_compliance_pct", 2).alias("sla_compliance_pct"))


def new_questions(asked: DataFrame, ts: str, text: str, late: str = "1 hour") -> DataFrame:
    """Questions whose cache key was not seen within the watermark: those to embed."""
    return asked.withColumn("cache_key", cache_key(F.col(text))).withWatermark(ts, late).dropDuplicatesWithinWatermark(["cache_key"])


def ingest_stream(pages: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs ``write_batch(chunks, batch_id)`` over each micro-batch of pages, chunked.

    For batches of whole documents: headings carry over the pages of a batch, not to the next one.
    ``streaming.sections.ingest_into`` takes pages as they come.
    """
    from tessera.operators.chunking import chunks

    writer = pages.writeStream.foreachBatch(lambda df, n: write_batch(chunks(df), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
