"""PDF directories as documents and pages.

Scanning, error routing, page layout, the choice of recognised text and the page table are
Spark's; the parser, a callable ``bytes -> dict``, only takes a file apart. PyMuPDF is the default
where it is installed.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import layout

_SPAN = pa.struct([("block_no", pa.int32()), ("line_no", pa.int32()), ("span_no", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("size", pa.float64()), ("text", pa.string())])
_ROW = pa.schema(
    [(n, pa.string()) for n in ("path", "filename", "title", "author")]
    + [("file_size_bytes", pa.int64()), ("total_pages", pa.int32()), ("page_number", pa.int32()), ("text", pa.string())]
    + [("spans", pa.list_(_SPAN)), ("tables", pa.list_(pa.string())), ("ocr", pa.string()), ("error", pa.string())]
)
_PAGES = (
    "path string, filename string, title string, author string, file_size_bytes long, total_pages int, page_number int, text string, "
    "spans array<struct<block_no: int, line_no: int, span_no: int, x: double, y: double, size: double, text: string>>, tables array<string>, ocr string, error string"
)


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, length, content`` of all files below a folder; none is an empty result."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def pymupdf_parser(content: bytes) -> dict:
    """Spans and tables of each page, title and author; an encrypted file that an empty password doesn't open has no pages."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        n = doc.page_count
        if doc.is_encrypted and not doc.authenticate(""):
            return {"pages": [], "n_pages": n}
        pages = []
        for p in doc:
            blocks = [b for b in p.get_text("dict")["blocks"] if b["type"] == 0]
            spans = [(i, j, k, b["bbox"][0], b["bbox"][1], s["size"], s["text"]) for i, b in enumerate(blocks) for j, line in enumerate(b["lines"]) for k, s in enumerate(line["spans"])]
            pages.append({"spans": spans, "tables": [t.to_markdown() for t in p.find_tables().tables]})
        meta = doc.metadata or {}
        return {"pages": pages, "n_pages": n, "title": meta.get("title"), "author": meta.get("author")}


def parse(files: DataFrame, parser: Callable[[bytes], dict] = pymupdf_parser) -> DataFrame:
    """A row per page, and one without page for files that have none or failed (``error`` says why).

    The parser's ``pages`` are texts, or dicts with any of ``text``, ``spans`` (block, line, span,
    x, y, size, text), ``tables`` (markdown) and ``ocr``. A page of spans gets its text from their
    layout: blocks in reading order, headings marked; tables follow, and recognised text takes the
    place of a text that is all but empty. The title falls back to the file's stem, the author to
    Unknown. A failed file stops nothing.
    """

    def run(batches):
        names = [f.name for f in _SPAN]
        for batch in batches:
            for path, size, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content"))):
                name = path.rsplit("/", 1)[-1]
                row = {"path": path, "filename": name, "title": name.rsplit(".", 1)[0], "author": "Unknown", "file_size_bytes": size, "total_pages": 0}
                try:
                    got = parser(content)
                    row |= {"title": got.get("title") or row["title"], "author": got.get("author") or "Unknown", "total_pages": got.get("n_pages", len(got["pages"]))}
                    rows = []
                    for n, page in enumerate(got["pages"], 1):
                        page = {"text": page} if isinstance(page, str) else dict(page)
                        page["spans"] = [dict(zip(names, s)) for s in page.get("spans") or []]
                        rows.append(row | {"page_number": n} | page)
                    rows = rows or [row]
                except Exception as e:  # noqa: BLE001  the row carries it
                    rows = [row | {"error": f"{type(e).__name__}: {e}"[:500]}]
                yield pa.RecordBatch.from_pylist(rows, _ROW)

    return with_layout(files.select("path", "length", "content").mapInArrow(run, _PAGES))


def with_layout(pages: DataFrame) -> DataFrame:
    """Pages whose ``text`` comes from their ``spans``, ``tables`` and ``ocr``, which are dropped; ``ocr_applied`` says where."""
    named = pages.withColumn("page_id", F.struct("path", "page_number"))
    spans = named.select("page_id", F.explode("spans").alias("s")).select("page_id", "s.*")
    read = layout.reading_order(layout.heading_levels(spans)).withColumnRenamed("text", "laid")
    own = F.when(F.size("spans") > 0, F.coalesce("laid", F.lit(""))).otherwise(F.col("text"))
    out = named.join(read, "page_id", "left").withColumn("text", layout.with_tables(own, F.coalesce("tables", F.array().cast("array<string>"))))
    out = out.withColumn("chosen", F.when(F.col("page_number").isNotNull(), layout.with_ocr(F.col("text"), F.col("ocr"))))
    applied = F.coalesce((F.col("chosen") != F.coalesce("text", F.lit(""))), F.lit(False))
    return out.withColumn("ocr_applied", applied).withColumn("text", F.col("chosen")).drop("spans", "tables", "ocr", "laid", "chosen", "page_id")


def documents(pages: DataFrame) -> DataFrame:
    """A row per file: ``doc_id, filename, title, author, raw_text, page_count, error``; page banners in the text."""
    banner = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.col("text"))
    texts = F.sort_array(F.collect_list(F.when(F.col("page_number").isNotNull(), F.struct("page_number", banner.alias("t")))))
    grouped = pages.groupBy("path", "filename", "title", "author").agg(texts.alias("p"), F.max("total_pages").alias("page_count"), F.max("error").alias("error"))
    return grouped.select(
        F.sha2("path", 256).alias("doc_id"), "filename", "title", "author", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("raw_text"), "page_count", "error"
    )


def chunkable(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, text`` for the chunker."""
    return pages.filter("page_number IS NOT NULL").select(F.sha2("path", 256).alias("doc_id"), "page_number", "text")
