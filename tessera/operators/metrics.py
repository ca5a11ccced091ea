"""Latency and ingestion statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET_MS = 400.0
STAGES = ("entity_extraction_ms", "embedding_ms", "vector_search_ms", "graph_traversal_ms", "rrf_fusion_ms", "generation_ms")


def _cell(v: Column) -> Column:
    """A number that never falls where ``v`` rises: sign and binary logarithm, in 1/64."""
    size = F.floor(F.log2(1 + F.abs(v)) * 64).cast("long")
    return F.when(v < 0, -size - 1).otherwise(size)


def percentiles(log: DataFrame, value: str, points: tuple[float, ...], *by: str, times: Column | None = None) -> DataFrame:
    """``by..., p..., x``: exact percentiles, interpolated between the two nearest values.

    Each row counts once, or as many ``times`` as it says.

    Values are counted by cells of like size, and only the cells that hold a wanted rank are
    ordered within, so that no task orders or holds all values of a group.
    """
    g = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_g{n}") for n, c in enumerate(by)] + [F.isnull(c).alias(f"_n{n}") for n, c in enumerate(by)] or [F.lit(0).alias("_g")]
    names = [f"_g{n}" for n in range(len(by))] + [f"_n{n}" for n in range(len(by))] or ["_g"]
    counted = log.filter(F.col(value).isNotNull()).select(*g, F.col(value).alias("v"), (F.lit(1) if times is None else times).cast("long").alias("n")).groupBy(*names, "v").agg(F.sum("n").alias("n")).withColumn("cell", _cell(F.col("v")))
    cells = counted.groupBy(*names, "cell").agg(F.sum("n").alias("n"))
    total = Window.partitionBy(*names)
    cells = cells.withColumns({"before": F.sum("n").over(total.orderBy("cell")) - F.col("n"), "all": F.sum("n").over(total)})
    at = lambda p: F.lit(p) * (F.col("all") - 1)
    ranks = F.array(*(F.struct(F.lit(p).alias("p"), F.floor(at(p)).alias("lo"), F.ceil(at(p)).alias("hi"), (at(p) - F.floor(at(p))).alias("part")) for p in points))
    inside = lambda r, n="n": (F.col("before") <= r) & (r < F.col("before") + F.col(n))
    wanted = cells.select(*names, "cell", "before", F.col("n").alias("held"), F.explode(ranks).alias("r")).filter(inside(F.col("r.lo"), "held") | inside(F.col("r.hi"), "held"))
    near = counted.join(wanted, [*names, "cell"])
    upto = F.sum("n").over(Window.partitionBy(*names, "cell", "r.p").orderBy("v")) - F.col("n") + F.col("before")
    near = near.withColumn("before", upto)
    ends = near.groupBy(*names, F.col("r.p").alias("p"), F.col("r.part").alias("part")).agg(F.max(F.when(inside(F.col("r.lo")), F.col("v"))).alias("lo"), F.max(F.when(inside(F.col("r.hi")), F.col("v"))).alias("hi"))
    return ends.select(*names, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("x"))


def latency_summary(log: DataFrame, value: Column, *by: str, budget: float = BUDGET_MS) -> DataFrame:
    """``count, p50_ms, p95_ms, p99_ms, mean_ms, sla_budget_ms, sla_compliance_pct``, overall or by columns.

    Percentiles are exact and interpolated. An empty log is 0 everywhere and 100 % compliant.
    """
    return _summary(log.withColumn("_ms", value.cast("double")).withColumn("_times", F.lit(1).cast("long")), *by, budget=budget)


def _summary(log: DataFrame, *by: str, budget: float) -> DataFrame:
    """``latency_summary`` of ``log(_ms, _times)``, whose rows count as many times as they say."""
    points, known = (0.5, 0.95, 0.99), F.col("_ms").isNotNull()
    n = F.coalesce(F.sum(F.when(known, F.col("_times"))), F.lit(0).cast("long"))
    ok = F.try_divide(F.sum(F.when(F.col("_ms") <= budget, F.col("_times")).otherwise(0)).cast("double"), n) * 100
    rounded = lambda x, default=0.0: F.round(F.coalesce(x, F.lit(default)), 2)
    mean = F.try_divide(F.sum(F.col("_ms") * F.col("_times")), n)
    stats = log.groupBy(*by).agg(n.alias("count"), rounded(mean).alias("mean_ms"), rounded(ok, 100.0).alias("sla_compliance_pct"))
    p = percentiles(log, "_ms", points, *by, times=F.col("_times"))
    names = [c for c in p.columns if c not in ("p", "x")]
    wide = p.groupBy(*names).agg(*(F.max(F.when(F.col("p") == q, F.col("x"))).alias(f"p{int(q * 100)}") for q in points))
    keys = {f"_g{n}": F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in enumerate(by)} | {f"_n{n}": F.isnull(c) for n, c in enumerate(by)} or {"_g": F.lit(0)}
    out = stats.withColumns(keys).join(wide, names, "left")
    return out.select(*by, "count", *(rounded(F.col(f"p{int(q * 100)}")).alias(f"p{int(q * 100)}_ms") for q in points), "mean_ms", F.lit(budget).alias("sla_budget_ms"), "sla_compliance_pct")


def latency_partials(log: DataFrame, ts: str, value: Column, *by: str, period: str = "hour") -> DataFrame:
    """``at, by..., ms, times``: how often each value was seen in each period; what an exact summary needs.

    Partials of parts of a log are put together by ``merged_partials``, in any order; a summary of
    any range of periods, ``summary_of_partials``, reads no log again. They are as many rows as the
    periods have distinct values; values that are measured to a unit keep that small.
    """
    return log.select(F.date_trunc(period, ts).alias("at"), *by, value.cast("double").alias("ms")).groupBy("at", *by, "ms").agg(F.count("*").alias("times"))


def merged_partials(*partials: DataFrame) -> DataFrame:
    """Partials of disjoint parts of a log as those of all of it."""
    whole = partials[0]
    for p in partials[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*[c for c in whole.columns if c != "times"]).agg(F.sum("times").alias("times"))


def summary_of_partials(partials: DataFrame, *by: str, budget: float = BUDGET_MS) -> DataFrame:
    """``latency_summary`` of the rows that ``partials``, or those of some periods, were made from."""
    return _summary(partials.select(*by, F.col("ms").alias("_ms"), F.col("times").alias("_times")), *by, budget=budget)


def stage_breakdown(log: DataFrame) -> DataFrame:
    """Average of each stage of a query log; 0 for an empty one."""
    return log.agg(*(F.round(F.coalesce(F.avg(s), F.lit(0.0)), 2).alias(s) for s in STAGES))


def summary_lines(stats: DataFrame) -> DataFrame:
    """The summary as a printable text per row of ``stats``."""
    line = F.format_string(
        "%d queries: mean %.2f ms, p50 %.2f ms, p95 %.2f ms, p99 %.2f ms, %.2f%% within %.1f ms",
        "count", "mean_ms", "p50_ms", "p95_ms", "p99_ms", "sla_compliance_pct", "sla_budget_ms",
    )
    return stats.select(*[c for c in stats.columns if c not in ("count", "p50_ms", "p95_ms", "p99_ms", "mean_ms", "sla_budget_ms", "sla_compliance_pct")], line.alias("summary"))


def ingest_stats(pages: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame, elapsed: float, ocr: Column | None = None) -> DataFrame:
    """One row of totals and rates; ``elapsed`` seconds are at least a thousandth."""
    seconds = max(elapsed, 0.001)
    ocr_pages = F.count(F.when(ocr, 1)) if ocr is not None else F.lit(0).cast("long")
    p = pages.agg(F.countDistinct("doc_id").alias("total_documents"), F.count("*").alias("total_pages"), ocr_pages.alias("ocr_pages_count"))
    total = lambda df, name: df.agg(F.count("*").alias(name))
    out = p.join(total(chunks, "total_chunks")).join(total(entities, "total_entities")).join(total(relations, "total_relationships"))
    rate = F.col("total_pages") / F.lit(float(seconds))
    return out.select(
        "total_documents", "total_pages", "total_chunks", "total_entities", "total_relationships", "ocr_pages_count",
        F.round(F.lit(float(seconds)), 2).alias("elapsed_seconds"), F.round(rate * 3600, 1).alias("pages_per_hour"), F.round(rate, 2).alias("pages_per_second"),
    )
