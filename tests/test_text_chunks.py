from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import canonical, canonical_name, or_else, seeds_by_capitals
from tessera.operators import chunking


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, page_number int, text string")


def test_canonical_names(spark):
    names = {"Foo Corp": "Foo Corp.", "Foo LLC.": "Foo LLC", " google ": "Google LLC", "Bar.": "Bar", "Baz Co.": "Baz Co.", "(A  B)": "A B", "": ""}
    df = spark.createDataFrame([(k,) for k in names], "n string").select("n", canonical(F.col("n")).alias("c"))
    assert {r.n: r.c for r in df.collect()} == names


def test_names_with_legal_forms_take_a_quick_path_and_agree(spark):
    import re
    from itertools import product

    from tessera.functions import text

    names = ["".join(x) for x in product(("", "Ab ", "A  b ", "meta ", "x-", "é "), ("Inc", "Corp.", "Ltd", "LLC.", "Co", "LLC"), ("", ".", " ", "\n"))]
    assert text._FORMED.match("Ab Corp") and not text._FORMED.match("x-Corp")
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", canonical(F.col("n")).alias("c"))
    assert {r.n: r.c for r in df.collect()} == {n: canonical_name(n) for n in names}
    assert all(re.sub(r"\s", "", canonical_name(n)) for n in names)


def test_seeds_and_defaults(spark):
    df = spark.createDataFrame([("Who is Ann, and Bob?", "")], "q string, t string")
    r = df.select(seeds_by_capitals(F.col("q")).alias("s"), or_else(F.col("t"), F.lit("x")).alias("d")).first()
    assert r.s == ["Who", "Ann", "Bob"] and r.d == "x"


def test_headings_across_pages_and_levels(spark):
    df = pages(spark, (1, 1, "## early\na\n# Top\nb\n## Sub\nc"), (1, 2, "d\n# Next\n### not one\ne"), (2, 1, "x"))
    got = {(r.doc_id, r.line): r.section_title for r in chunking.headings(chunking.lines(df)).collect()}
    assert got[1, "a"] == "early" and got[1, "b"] == "Top" and got[1, "c"] == "Sub" and got[1, "d"] == "Sub"
    assert got[1, "e"] == "Next" and got[2, "x"] == "General"


def test_heading_that_closes_a_chunk_names_it(spark):
    df = pages(spark, (1, 1, "# One\na b c d\n# Two\ne f"))
    got = chunking.chunks(df, size=6, overlap=2).orderBy("chunk_no").collect()
    assert [(r.token_count, r.section_title) for r in got] == [(6, "Two"), (6, "Two")]
    assert got[1].text == "c d # Two e f"


def test_empty_pages_have_no_chunk(spark):
    assert chunking.chunks(pages(spark, (1, 1, ""), (2, 1, " \n\t"), (3, 1, None))).count() == 0


def brute(lines, size, overlap):
    out, buffer, n = [], [], 0
    for line in lines:
        w = line.split()
        if n + len(w) > size and n:
            out.append(buffer)
            buffer = (buffer[-overlap:] if overlap else []) + w
            n = len(buffer)
        else:
            buffer, n = buffer + w, n + len(w)
    return out + [buffer]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=9).map(" ".join), min_size=1, max_size=12), st.integers(1, 12), st.integers(0, 5))
def test_chunks_equal_a_text_buffer(spark, lines, size, overlap):
    got = chunking.chunks(pages(spark, (1, 1, "\n".join(lines))), size, overlap).orderBy("chunk_no").collect()
    assert [r.text.split() for r in got] == brute(lines, size, overlap)


def test_links_are_inverse(spark):
    df = spark.createDataFrame([(1, 5), (1, 2), (1, 9), (2, 1)], "g long, t long")
    rows = chunking.links(df, "g", "t", key="t").collect()
    nxt = {(r.g, r.t): r.next_t for r in rows}
    assert all(r.prev_t is None or nxt[r.g, r.prev_t] == r.t for r in rows)


def test_canonical_of_one_name_is_that_of_a_column(spark):
    names = ["Acme Corp", "Acme Corp.", "Acme  Labs", " Acme Inc ", "Corp", "Inc.", "x Ltd", "y LLC.", "Yes Co.", "Yes..", "(Beta)", "apple", "Meta.", "$5 million", "9%", "", "a b", "Incorp", "LLC", "big-Corp", "A\tB", "no Corp's", "Go Inc..", "tail \n"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", canonical(F.col("n")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: canonical_name(n) for i, n in enumerate(names)}
