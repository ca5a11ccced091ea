"""Headings that carry across the pages of a document, as a stream of pages in any order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans import pipeline
from tessera.plans.settings import Settings


def headings_of_text(text: Column) -> Column:
    """``(h1, h2)`` that a page leaves set: ``chunking.page_headings`` of one text, within a row."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    rest = lambda line, at: strip(F.substring(line, at, 1 << 30))
    none = F.lit(None).cast("string")

    def step(acc: Column, line: Column) -> Column:
        first, second = F.startswith(line, F.lit("# ")), F.startswith(line, F.lit("## "))
        h1 = F.when(first, rest(line, 3)).otherwise(acc["h1"])
        return F.struct(h1.alias("h1"), F.when(first, none).when(second, rest(line, 4)).otherwise(acc["h2"]).alias("h2"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    return F.aggregate(lines, F.struct(none.alias("h1"), none.alias("h2")), step)


def _carried(key, frames, state):
    """State: a document's pages with what each sets, by number. Gives the pages that are new or carry something else now."""
    number, h1, h2 = state.get if state.exists else ([], [], [])
    pages = dict(zip(number, zip(h1, h2)))
    before = _carry(pages)
    changed = set()
    for rows in frames:
        for page, a, b in zip(rows["page_number"], rows["h1"], rows["h2"]):
            pages[int(page)] = (None if pd.isna(a) else a, None if pd.isna(b) else b)
            changed.add(int(page))
    after = _carry(pages)
    order = sorted(pages)
    state.update((order, [pages[n][0] for n in order], [pages[n][1] for n in order]))
    out = [n for n in order if n in changed or before.get(n) != after[n]]
    yield pd.DataFrame({"doc_id": [key[0]] * len(out), "page_number": out, "c1": [after[n][0] for n in out], "c2": [after[n][1] for n in out]})


def _carry(pages: dict) -> dict:
    now, out = (None, None), {}
    for n in sorted(pages):
        out[n] = now
        h1, h2 = pages[n]
        now = (h1, h2) if h1 is not None else (now[0], now[1] if h2 is None else h2)
    return out


def carried_headings(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, c1, c2`` of a stream of ``(doc_id, page_number, text)``: the headings in force where a page begins.

    A row a page, and another one for each later page whose headings change when an earlier page
    comes or comes again, so that the last row of a page is what ``chunking.carried`` gives for all
    pages so far. The state of a document is the headings of its pages, no texts. Of pages that one
    micro-batch repeats any one counts. Rows without a page number take no part.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()
    own = pages.filter(F.col("page_number").isNotNull()).select("doc_id", F.col("page_number").cast("int"), headings_of_text(F.col("text")).alias("h")).select("doc_id", "page_number", "h.h1", "h.h2")
    out, state = f"doc_id {kind}, page_number int, c1 string, c2 string", "number array<int>, h1 array<string>, h2 array<string>"
    return own.groupBy("doc_id").applyInPandasWithState(_carried, out, state, "update", "NoTimeout")


def ingest_into(pages: DataFrame, folder: str, checkpoint: str, settings: Settings = Settings(), embed: Callable | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Ingests each micro-batch of a stream of pages into the store in ``folder``.

    The store carries headings from one batch to the next and takes back replaced pages, so that
    it ends as one ingestion of all pages would leave it; a batch that runs again replaces its own.
    """
    writer = pages.writeStream.foreachBatch(lambda df, _: df.isEmpty() or pipeline.ingest(df, folder, settings, embed)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
