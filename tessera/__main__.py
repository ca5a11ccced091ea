"""``python -m tessera ingest FOLDER --store DIR`` and ``python -m tessera query TEXT... --store DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="PDF files, or Parquet of (doc_id, page_number, text)")
    i.add_argument("path")
    q = sub.add_parser("query", help="one or more questions, answered as one batch")
    q.add_argument("text", nargs="+")
    for x in (i, q):
        x.add_argument("--store", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    from tessera.plans import pipeline

    if a.command == "ingest":
        if a.path.endswith(".parquet"):
            pages = spark.read.parquet(a.path)
        else:
            from tessera.sources import pdf

            pages = pdf.chunkable(pdf.parse(pdf.scan(spark, a.path)))
        store = pipeline.ingest(pages, a.store)
        print(f"{store.chunks.count()} chunks, {store.entities.count()} entities")
    else:
        questions = spark.createDataFrame(list(enumerate(a.text)), "query_id long, question string")
        for row in pipeline.answer_batch(questions, pipeline.Store.open(spark, a.store)).orderBy("query_id").collect():
            print(row.response, end="\n\n")


if __name__ == "__main__":
    main()
