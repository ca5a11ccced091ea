import datetime as dt
import random
import sys

from pyspark.sql import functions as F

from tessera.sources import scratch as scratch_module
from tessera.operators import chunking
from tessera.operators import metrics as latency
from tessera.plans import pipeline
from tessera.plans.settings import Settings
from tessera.sources import pdf
from tessera.streaming import metrics, sections


def test_folder_of_files(spark, tmp_path):
    def parser(content: bytes) -> dict:
        if content == b"bad":
            raise ValueError("no pdf")
        if content == b"laid":
            spans = [(0, 0, 0, 0.0, 60.0, 10.0, "body "), (0, 0, 1, 9.0, 60.0, 10.0, "text"), (1, 0, 0, 0.0, 5.0, 30.0, "Head")] + [(2, n, 0, 0.0, 90.0, 10.0, f"line {n}") for n in range(5)]
            return {"pages": [{"spans": spans, "tables": ["|x|"]}, {"text": "", "ocr": "found by OCR"}, {"spans": [], "text": "plain"}]}
        return {"pages": content.decode().split("|") if content != b"none" else [], "n_pages": 2, "title": ""}

    (tmp_path / "sub").mkdir()
    for name, data in (("a.pdf", b"one|two"), ("sub/b.pdf", b"bad"), ("c.pdf", b"none"), ("d.txt", b"x"), ("e.pdf", b"laid")):
        (tmp_path / name).write_bytes(data)
    pages = pdf.parse(pdf.scan(spark, str(tmp_path)), parser).cache()
    docs = {r.filename: r for r in pdf.documents(pages).collect()}
    assert set(docs) == {"a.pdf", "b.pdf", "c.pdf", "e.pdf"}
    laid = {r.page_number: (r.text, r.ocr_applied) for r in pages.filter("filename = 'e.pdf'").collect()}
    assert laid[1] == ("# Head\n\nbody text\n\nline 0\nline 1\nline 2\nline 3\nline 4\n\n\n### Structured Tables:\n|x|", False)
    assert laid[2] == ("found by OCR", True) and laid[3] == ("plain", False)
    assert docs["a.pdf"].raw_text == "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo" and docs["a.pdf"].title == "a" and docs["a.pdf"].author == "Unknown"
    assert docs["b.pdf"].error.startswith("ValueError") and docs["c.pdf"].raw_text == ""
    assert pdf.chunkable(pages).count() == 5
    empty = tmp_path / "none"
    empty.mkdir()
    assert pdf.parse(pdf.scan(spark, str(empty)), parser).count() == 0


def test_windows_and_new_questions(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(at(1), 100.0, "Hi"), (at(2), 500.0, " hi"), (at(12), 50.0, "Other")]
    spark.createDataFrame(rows, "ts timestamp, ms double, q string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, ms double, q string").parquet(str(tmp_path / "in"))
    w = metrics.windowed_latency(stream(), "ts", F.col("ms"))
    run = w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    run.awaitTermination(60)
    assert [(r["count"], r.mean_ms, r.sla_compliance_pct) for r in spark.table("w").orderBy("start").collect()] == [(2, 300.0, 50.0), (1, 50.0, 100.0)]
    run = metrics.new_questions(stream(), "ts", "q").writeStream.format("memory").queryName("n").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    run.awaitTermination(60)
    assert spark.table("n").count() == 2


def test_ingest_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, "# T\na b c")], "doc_id long, page_number int, text string").write.parquet(str(tmp_path / "pages"))
    pages = spark.readStream.schema("doc_id long, page_number int, text string").parquet(str(tmp_path / "pages"))
    out = str(tmp_path / "chunks")
    metrics.ingest_stream(pages, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "c3")).awaitTermination(60)
    assert spark.read.parquet(out).first().section_title == "T"


BATCHES = [
    [(1, 3, "plain"), (1, 2, "## Sub\n x"), (2, 1, "# Two\n## A\n# B")],
    [(1, 1, "  # One \ntext\n## Deep\n"), (2, 2, None), (2, 5, "##no heading")],
    [(1, 2, "nothing now"), (2, 1, "#\n# \n## only second"), (1, 9, "# Nine\n## Ten")],
]


def _pages_as_files(spark, folder):
    for n, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, "doc_id long, page_number int, text string").coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    stream = spark.readStream.schema("doc_id long, page_number int, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    last = {}
    for rows in BATCHES:
        last |= {r[:2]: r for r in rows}
    return stream, spark.createDataFrame(list(last.values()), "doc_id long, page_number int, text string")


def test_headings_carry_through_a_stream(spark, tmp_path):
    stream, whole = _pages_as_files(spark, f"{tmp_path}/in")
    seen = []
    run = sections.carried_headings(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect()))
    run.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    got = {(d, p): (a, b) for _, d, p, a, b in sorted(seen, key=lambda r: r[0])}
    heads = whole.select("doc_id", "page_number").join(chunking.page_headings(chunking.lines(whole)), ["doc_id", "page_number"], "left")
    assert got == {(r.doc_id, r.page_number): (r.c1, r.c2) for r in chunking.carried(heads).collect()}
    # pages 2 and 3 of the first document come again when page 1 does, though only that was new
    assert [r[2] for r in seen if r[1] == 1 and r[0] == 1] == [1, 2, 3]


def test_stream_into_a_store_equals_one_ingestion(spark, tmp_path):
    stream, whole = _pages_as_files(spark, f"{tmp_path}/in")
    s = Settings(vector_width=4, buckets=2)
    sections.ingest_into(stream, f"{tmp_path}/a", f"{tmp_path}/c", s).awaitTermination(300)
    got, want = pipeline.Store.open(spark, f"{tmp_path}/a").chunks, pipeline.ingest(whole, f"{tmp_path}/b", s).chunks
    rows = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert rows(got) == rows(want) and got.count() > 4


def test_partials_of_any_range_equal_the_log(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 5, 1)
    rows = [(start + dt.timedelta(minutes=rng.randint(0, 600)), rng.choice((None, *range(1, 60))), rng.choice("ab")) for _ in range(400)]
    log = spark.createDataFrame([(t, None if v is None else float(v), k) for t, v, k in rows], "ts timestamp, v double, kind string")
    parts = [latency.latency_partials(log.filter(F.pmod(F.hash("ts", "v", "kind"), F.lit(3)) == n), "ts", F.col("v"), "kind") for n in range(3)]
    whole = latency.merged_partials(*parts)
    assert whole.count() <= log.select(F.date_trunc("hour", "ts"), "v", "kind").distinct().count()
    for lo, hi in ((2, 5), (20, 21)):
        inside = lambda df, c: df.filter(F.hour(c).between(lo, hi - 1))
        for by in ((), ("kind",)):
            got = sorted(map(tuple, latency.summary_of_partials(inside(whole, "at"), *by, budget=30.0).collect()))
            assert got == sorted(map(tuple, latency.latency_summary(inside(log, "ts"), F.col("v"), *by, budget=30.0).collect()))


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from tessera.__main__ import main

    spark.createDataFrame([(1, 1, "# Deals.\nAlpha Labs acquired Beta Group.")], "doc_id long, page_number int, text string").write.parquet(f"{tmp_path}/p.parquet")
    main(["ingest", f"{tmp_path}/p.parquet", "--store", f"{tmp_path}/s"])
    assert capsys.readouterr().out.startswith("1 chunks, ")
    main(["query", "Who bought Beta Group?", "what does Alpha Labs own?", "--store", f"{tmp_path}/s"])
    out = capsys.readouterr().out
    assert out.count("Alpha Labs (ACQUIRED)") == 2
    monkeypatch.setattr(sys, "argv", ["tessera"])
    with __import__("pytest").raises(SystemExit):
        main()


def test_a_grown_heap_is_collected_when_a_table_is_stored(spark, monkeypatch):
    from types import SimpleNamespace

    asked = []
    heap = SimpleNamespace(totalMemory=lambda: 600, maxMemory=lambda: 1000)
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=lambda: asked.append(1)))
    fake = SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))
    monkeypatch.setattr(scratch_module, "_TRIMMED", [-10.0])
    assert scratch_module.trim(fake) and not scratch_module.trim(fake) and asked == [1]  # not twice at once
    monkeypatch.setattr(scratch_module, "_TRIMMED", [-10.0])
    heap.totalMemory = lambda: 500
    assert not scratch_module.trim(fake) and asked == [1]
    seen = []
    monkeypatch.setattr(scratch_module, "trim", seen.append)
    scratch_module.stored(spark.range(3)).count()
    assert len(seen) == 1
