"""Page layout of text spans ``(page_id, block_no, line_no, span_no, x, y, size, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes and marks of the page format.
DEFAULT_SIZE, HEADING, TOP_HEADING, OCR_CHARS = 11.0, 1.3, 1.6, 50
TABLES = "\n### Structured Tables:\n"


def heading_levels(spans: DataFrame) -> DataFrame:
    """``page_id, block_no, x, y, is_heading, heading_level, text``: one row per block that has text.

    A line is its spans without outer white space, a block its lines that aren't blank. A span
    larger than 1.3 times the page's average makes its block a heading; of several such spans the
    last decides on level 1 (more than 1.6 times) or 2.
    """
    solid = F.when(F.trim("text") != "", F.col("size"))
    avg = spans.groupBy("page_id").agg(F.coalesce(F.avg(solid), F.lit(DEFAULT_SIZE)).alias("avg_size"))
    s = spans.join(avg, "page_id")
    large = F.col("size") > HEADING * F.col("avg_size")
    level = F.when(F.col("size") > TOP_HEADING * F.col("avg_size"), 1).otherwise(2)
    of_line = F.sort_array(F.collect_list(F.struct("span_no", F.coalesce("text", F.lit("")).alias("text"))))
    lines = s.groupBy("page_id", "block_no", "line_no").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.when(large, F.struct("line_no", "span_no", level.alias("level")))).alias("head"), of_line.alias("spans")
    )
    line = F.regexp_replace(F.array_join(F.transform("spans", lambda x: x["text"]), ""), r"^\s+|\s+$", "")
    some = F.when(line != "", F.struct("line_no", line.alias("text")))
    blocks = lines.groupBy("page_id", "block_no").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("head").alias("head"), F.sort_array(F.collect_list(some)).alias("lines"))
    blocks = blocks.filter(F.size("lines") > 0).withColumn("heading_level", F.coalesce(F.col("head.level"), F.lit(0)))
    mark = F.when(F.col("heading_level") > 0, F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "))).otherwise("")
    text = F.concat(mark, F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    return blocks.select("page_id", "block_no", "x", "y", F.col("head").isNotNull().alias("is_heading"), "heading_level", text.alias("text"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """``page_id, text``: a page's blocks from top to bottom in bands of 10, then left to right."""
    band = F.bround(F.col("y") / 10) * 10
    page = blocks.withColumn("band", band).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("band", "x", "block_no", "text"))).alias("b"))
    return page.select("page_id", F.array_join(F.transform("b", lambda b: b["text"]), "\n\n").alias("text"))


def with_tables(text: Column, tables: Column) -> Column:
    """A page's text with its tables (an array of markdown texts) after it."""
    some = F.filter(F.transform(tables, lambda t: F.trim(t)), lambda t: t != "")
    shown = F.concat(F.lit(TABLES), F.array_join(some, "\n\n"))
    return F.when(F.size(some) > 0, F.concat_ws("\n\n", text, shown)).otherwise(text)


def with_ocr(text: Column, ocr: Column) -> Column:
    """The recognised text, where the page has few characters of its own and OCR found more."""
    own = F.trim(F.coalesce(text, F.lit("")))
    return F.when((F.length(own) < OCR_CHARS) & (F.length(F.trim(ocr)) > F.length(own)), ocr).otherwise(text)
