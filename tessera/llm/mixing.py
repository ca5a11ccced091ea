"""Mixing sources to target weights with a low-discrepancy schedule.

A source's documents, in the order of the md5 of their ids, form a stream of words that repeats
up to ``MOST`` times and is cut into blocks of ``BLOCK`` words. Slot ``t`` of the mix has the
point ``t * G mod 2^31`` (a golden-ratio sequence in integers, so that every point is exact); the
cumulative targets map points to sources, and the r-th slot of a source takes its block r. After
``PERIOD`` slots, 1.4e11 words, every point has come once and the sequence begins again, which
leaves the shares as they are.

Nothing is ordered over a whole source in one task: documents and slots are numbered within
buckets of bounded size, and only the buckets' totals are added up per source. What is held per
source (its size, target and slots) is as long as the list of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST = 3  # a document is taken so many times at most
BLOCK = 64
PERIOD, GOLDEN = 2**31, 1327217885  # GOLDEN: odd, PERIOD over the golden ratio
CELLS = 4096  # of the range of points, for the lookup of sources
DOCS_A_BUCKET, SLOTS_A_CHUNK = 2000, 8192


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``source, source_size, rank, weight, target``, targets capped and reshared.

    In order of size over weight the sources that reach their cap come first; the share of what
    the capped ones leave, by the weights of the others, is the target of the rest.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    src = src.withColumn("rank", rank.cast("long")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    )
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    src = src.withColumns(
        {
            "left": F.sum("source_size").over(Window.partitionBy()) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "among": F.sum("weight").over(after),
        }
    )
    open_ = MOST * F.col("source_size") * F.col("among") > F.col("left") * F.col("weight")
    everyone = Window.partitionBy()
    src = src.withColumn("first", F.min(F.when(open_, F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("left"), F.col("among")))).over(everyone))
    level = F.struct(F.col("source_size") / F.col("weight"), F.col("rank"))
    capped = F.col("first").isNull() | (level < F.struct(F.col("first.col1"), F.col("first.rank")))
    target = F.when(capped, MOST * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.col("first.left") / F.col("first.among"))
    return src.select("source", "source_size", "rank", "weight", target.cast("double").alias("target"))


def _point(t: Column) -> Column:
    return (t % PERIOD) * GOLDEN % PERIOD


def schedule(src: DataFrame, total: int) -> DataFrame:
    """Slots ``(slot, rank, chunk, nth)``; ``nth`` counts a source's slots within its chunk, from 0."""
    spark = src.sparkSession
    share = F.round("target").cast("long")
    w = Window.orderBy("rank")
    ends = src.select("rank", F.sum(share).over(w).alias("end"), share.alias("share"), F.sum(share).over(Window.partitionBy()).alias("all"))
    at = lambda c: F.floor(c / F.col("all") * F.lit(float(PERIOD)))
    ends = ends.filter("all > 0").select("rank", at(F.col("end") - F.col("share")).alias("lo"), at(F.col("end")).alias("hi")).filter("lo < hi")
    cell = PERIOD // CELLS
    cells = ends.select("rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    slots = spark.range(-(-total // BLOCK)).select(F.col("id").alias("slot"), _point(F.col("id")).alias("p"))
    placed = slots.withColumn("cell", F.floor(F.col("p") / cell)).join(cells, "cell").filter("lo <= p and p < hi")
    chunk = F.floor(F.col("slot") / SLOTS_A_CHUNK)
    return placed.select("slot", "rank", chunk.alias("chunk")).withColumn(
        "nth", F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    )


def sized(docs: DataFrame) -> DataFrame:
    """``row, doc_id, source, size`` of every document, written to the shared folder."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size")))


def mix(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix of documents ``(row, doc_id, source, size)`` and the table of their sources.

    The mix has a row for each document piece of each slot: ``slot, rank, block, row, start,
    n_words`` (``start``: its first word within the document).
    """
    n_docs, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    src = stored(targets(sizes))
    slots = stored(schedule(src, total))
    counts = slots.groupBy("rank", "chunk").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("rank").orderBy("chunk")) - F.col("n")
    slots = slots.join(counts.withColumn("offset", offset).drop("n"), ["rank", "chunk"]).select(
        "slot", "rank", (F.col("offset") + F.col("nth")).alias("block")
    )
    src = src.join(counts.groupBy("rank").agg(F.sum("n").alias("slots")), "rank", "left").fillna(0, ["slots"])

    named = lambda df: df.withColumns({"s": F.coalesce("source", F.lit("")), "s_null": F.col("source").isNull()})
    buckets = max(1, -(-n_docs // DOCS_A_BUCKET))
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = named(sizes.filter("size > 0")).withColumn("h", h)
    docs = docs.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)))
    own = Window.partitionBy("s", "s_null", "bucket").orderBy("h", "doc_id", "size", "row")
    docs = docs.withColumn("local", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = docs.groupBy("s", "s_null", "bucket").agg(F.sum("size").alias("n"))
    start = F.sum("n").over(Window.partitionBy("s", "s_null").orderBy("bucket")) - F.col("n")
    totals = totals.withColumn("offset", start).drop("n").join(named(src).drop("source"), ["s", "s_null"])
    docs = docs.join(totals, ["s", "s_null", "bucket"]).withColumn("at", F.col("offset") + F.col("local"))

    epochs = F.least(F.lit(MOST), F.ceil(F.col("slots") * BLOCK / F.col("source_size"))).cast("int")
    docs = docs.filter("slots > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    docs = docs.select("row", "rank", "size", "slots", (F.col("at") + F.col("epoch") * F.col("source_size")).alias("a"))
    first, last = F.floor(F.col("a") / BLOCK), F.least(F.floor((F.col("a") + F.col("size") - 1) / BLOCK), F.col("slots") - 1)
    pieces = docs.filter(first <= last).select("row", "rank", "size", "a", F.explode(F.sequence(first, last)).alias("block"))
    lo, hi = F.greatest(F.col("a"), F.col("block") * BLOCK), F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * BLOCK)
    pieces = pieces.select("row", "rank", "block", (lo - F.col("a")).alias("start"), (hi - lo).alias("n_words"))
    return slots.join(pieces, ["rank", "block"]), src


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``row, doc_id, source, size, source_size, target, taken`` of every document.

    ``taken`` is the number of words that the mix takes from it, repeats counted. A null text has
    size 0 and is never taken; a null source is a source of its own, after all others. Rows that
    repeat a doc_id are documents of their own. An empty table gives an empty result.
    """
    sizes = sized(docs)
    pieces, src = mix(sizes)
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    named = src.select(F.col("source").alias("of"), "source_size", "target")
    out = sizes.join(taken, "row", "left").fillna(0, ["taken"])
    return out.join(named, out["source"].eqNullSafe(named["of"])).drop("of")
