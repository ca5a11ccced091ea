import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann, chat, decontaminate, mixing, secret_scan, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, cuts string, blob string, salt int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash", "mine", "own", 1) for d, t in rows], SCHEMA)


# --- decontamination ---


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, words(30)) for i in range(20)] + [(20, None), (21, ""), (22, "xyz")]
    rows, want = [(1000, None), (1001, ""), (1002, words(9000)), (1003, "the " * 3000)], set()
    for i, t in items[:20]:
        x, k = list(t), int(len(t) * decontaminate.RATE)
        for _ in range(rng.randrange(0, k + 1)):
            p = rng.randrange(len(x))
            x[p : p + 1] = rng.choice([[], ["q"], [x[p], "q"]])
        rows.append((i, words(rng.randrange(0, 80)) + "\n " + "".join(x).upper() + "  " + words(20)))
        want.add((i, i))
    rows.append((0, items[0][1] + " " + items[1][1]))
    want |= {(0, 1)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    texts = dict(rows[:-1])
    assert all(r.end <= len(texts[r.doc_id]) for r in got if r.doc_id)
    clean = decontaminate.uncontaminated(docs(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {1000, 1001, 1002, 1003} and clean.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.uncontaminated(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_banded_alignment_equals_full_table():
    rng = np.random.RandomState(8)
    for _ in range(60):
        item, region = rng.randint(0, 4, rng.randint(5, 25)), rng.randint(0, 4, rng.randint(5, 40))
        full = np.zeros((len(item) + 1, len(region) + 1), int)
        full[:, 0] = np.arange(len(item) + 1)
        for i in range(1, len(item) + 1):
            for j in range(1, len(region) + 1):
                full[i, j] = min(full[i - 1, j - 1] + (item[i - 1] != region[j - 1]), full[i - 1, j] + 1, full[i, j - 1] + 1)
        best = full[-1].min()
        edits, start, end = decontaminate.banded(item, region, 30, -len(item), len(item) + len(region) + 1)
        assert edits == best and 0 <= start <= end <= len(region)


def _edits(item, text):
    """Fewest edits between the item and any region of the text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    for ch in item:
        new = np.minimum(np.append(row[0] + 1, row[:-1] + np.array([ch != x for x in text], int)), row + 1)
        steps = np.arange(len(new))
        row = np.minimum.accumulate(new - steps) + steps
    return row.min()


def test_every_length_equals_brute_force(spark):
    """All rows against all items, by full tables: items of 1 to 70 characters, regions at and over the budget."""
    rng = random.Random(12)
    letters = "abcdefghijklmnop "
    text = lambda n: decontaminate.normal("".join(rng.choices(letters, k=n)))
    items = [(i, text(n) or "z") for i, n in enumerate([*range(1, 45), 60, 70] * 2)]
    rows = []
    for d in range(260):
        x = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, int(len(x) * 0.1) + 2)):
            p = rng.randrange(len(x)) if x else 0
            x[p : p + 1] = rng.choice([[], ["#"], x[p : p + 1] + ["#"]])
        rows.append((d, text(rng.randrange(0, 40)) + rng.choice([" ", ""]) + "".join(x) + rng.choice([" ", ""]) + text(rng.randrange(0, 40))))
    want = set()
    for d, t in rows:
        t = decontaminate.normal(t)
        for i, item in items:
            m = len(item)
            if m < 8:
                hit = re.search((r"(?<![^\W_])" if item[0].isalnum() else "") + re.escape(item) + (r"(?![^\W_])" if item[-1].isalnum() else ""), t)
                want |= {(d, i)} if hit else set()
            elif _edits(item, t) <= m // 10:
                want.add((d, i))
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {len(items[i][1]) for _, i in want} >= {12, 22}


def test_several_blocks_equal_one(spark, monkeypatch):
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog") for i in range(30)] + [(99, None)]
    items = spark.createDataFrame([(i, f"brown fox number {i} jumps") for i in range(10)], "item_id long, text string")
    one = sorted(decontaminate.contaminated(docs(spark, rows), items).collect())
    kept = sorted(r.doc_id for r in decontaminate.uncontaminated(docs(spark, rows), items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert sorted(decontaminate.contaminated(docs(spark, rows), items).collect()) == one
    assert sorted(r.doc_id for r in decontaminate.uncontaminated(docs(spark, rows), items).collect()) == kept


def test_several_blocks_write_digests_of_hits_only(spark, monkeypatch):
    """Repeated rows, null ids and a column named like the digest; what is written doesn't hold the texts."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    wrote, write = [], decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df: wrote.append(df.columns) or write(df))
    rows = [(i, f"the quick brown fox number {i} jumps over", "x") for i in range(30)] * 2 + [(None, None, "n"), (None, "brown fox number 3 jumps", "y"), (7, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    items = spark.createDataFrame([(i, f"brown fox number {i} jumps") for i in range(10)], "item_id long, text string")
    clean = decontaminate.uncontaminated(table, items)
    assert clean.columns == table.columns
    got = sorted(clean.collect(), key=str)
    # one edit in 24 characters is within the budget of two, so that all of the fifty numbers count
    assert [tuple(r) for r in got] == sorted([r for r in rows if not r[1] or "fox" not in r[1]], key=str)
    assert len(wrote) > 5 and all(c == ["digest"] for c in wrote)


def test_a_long_text_with_many_hits_is_mapped_once():
    text = "".join(f"Some  words {n} here.\n" for n in range(9000))
    norm, calls = decontaminate.normal(text), []
    starts = [m.start() for m in re.finditer("words", norm)][:400]
    walked = decontaminate.origins
    try:
        decontaminate.origins = lambda t: calls.append(1) or walked(t)
        spans = decontaminate._spans([None, text], [(1, k, 0, s, s + 5) for k, s in enumerate(starts)])
    finally:
        decontaminate.origins = walked
    assert len(calls) == 1 and {text[a:b] for a, b in spans} == {"words"}
    assert [a for a, _ in spans] == [m.start() for m in re.finditer("words", text)][:400]


def test_original_span_points_at_the_passage():
    text = "  Über\n\nden  FLUSS gehen "
    norm = decontaminate.normal(text)
    s = norm.index("den fluss")
    a, b = decontaminate.original_span(text, s, s + 9)
    assert text[a:b] == "den  FLUSS"


# --- secrets ---


def test_secret_rules_and_ledger(spark):
    long = "x" * 50_000 + " token: abcdef1 "
    texts = ["password=short", 'API_KEY" : "abcdef.', "AKIA" + "A" * 16 + "b", "f" * 24 + " " + "e" * 23, "secret=token:abcdefgh", "", None, long, "-----BEGIN RSA PRIVATE KEY-----", "paſſword=abcdefgh", "é token = 'abcdefgh'"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[0]), (2, texts[2]), (None, texts[2])]
    got = secret_scan.document_secrets(docs(spark, rows)).collect()
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = [("assign", re.compile(assign, re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    want = []
    for d, t in rows:
        s = sorted((m.start(), n, k, m.end()) for n, (k, p, g, least) in enumerate(rules) for m in p.finditer(t or "") if len(m.group(g)) >= least)
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        want.append((d or -1, *(sum(x[2] == k for x in s) for k in secret_scan.BASE), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    assert next(r.spans for r in got if r.doc_id == 8) == "pem:0:31"
    assert secret_scan.document_secrets(docs(spark, [])).count() == 0



def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch):
    texts = ["password=abcdefgh", "AKIA" + "A" * 16, "f" * 23, "clean", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[0])]
    ledger = f"file://{tmp_path}/ledger"
    assert secret_scan.scan(docs(spark, rows[:3]), ledger) == 3
    assert secret_scan.scan(docs(spark, rows[:3]), ledger) == 0
    assert secret_scan.scan(docs(spark, rows), ledger) == 2  # "clean" and the empty text
    found = lambda rules: {r.doc_id: r.spans for r in secret_scan.document_secrets(docs(spark, rows), rules, ledger).collect()}
    now = found(secret_scan.RULES)
    assert now == {0: "assign:0:17", 1: "access:0:20", 2: "", 3: "", 4: "", 9: "assign:0:17"}
    newer = secret_scan.RULES | {"hex": (2, "[0-9a-f]+", 0, 0, 23)}
    assert found(newer) == now | {2: "hex:0:23"}  # the new version on all blobs, the old findings still there
    assert secret_scan.scan(docs(spark, rows), ledger, newer) == 0
    both = secret_scan.document_secrets(docs(spark, rows), increments=2).collect()
    assert {r.doc_id: r.spans for r in both} == now
    monkeypatch.setattr(secret_scan, "BROADCAST_SPANS", 0)
    assert {r.doc_id: r.text for r in secret_scan.redacted(docs(spark, rows)).collect()} == {0: "[assign]", 1: "[access]", 2: "f" * 23, 3: "clean", 4: None, 9: "[assign]"}


def test_patterns_are_linear():
    import time

    body = "eyJ" + "a" * 12 + "." + "b" * 12 + ".c"
    assert secret_scan.scan_text(f"x {body}. y") == [("jwt", 2, 2 + len(body))]
    assert secret_scan.scan_text("-----BEGIN RSA PRIVATE KEY-----\nAAAA/+=\n-----END RSA PRIVATE KEY----- x") == [("pem", 0, 69)]
    for text in ("eyJ" * 350_000, "eyJ" + "a" * 500_000 + "." + "b" * 500_000, "-----BEGIN " * 90_000, "-----BEGIN " + "A" * 1_000_000, "token " * 170_000, "token" + " " * 1_000_000, "AKIA" * 250_000, "abc123" * 170_000):
        began = time.perf_counter()
        secret_scan.scan_text(text)
        assert time.perf_counter() - began < 1, text[:20]


def test_redaction(spark):
    rows = [(1, "a token=abcdefgh b"), (2, "clean"), (3, None), (4, "password=" + "a" * 30 + " AKIA" + "Z" * 16)]
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redacted(docs(spark, rows)).collect()}
    assert got == {1: ("a [assign] b", 12), 2: ("clean", 5), 3: (None, 0), 4: ("[assign] [access]", 17)}
    same = secret_scan.redacted(docs(spark, rows)).collect()
    assert {(r.kind, r.cuts, r.blob, r.salt) for r in same} == {("clash", "mine", "own", 1)}
    short = secret_scan.redacted(docs(spark, rows).select("text", "cuts"))
    assert short.columns == ["text", "cuts"] and short.count() == 4


def test_redaction_by_shuffle_equals_broadcast(spark, monkeypatch):
    rows = [(i, "a token=abcdefgh b") for i in range(40)] + [(i, f"secret: value{i:04d} end") for i in range(50, 60)] + [(70, "clean"), (71, None), (71, None)]
    columns = ["doc_id", "text", "n_chars", "salt"]
    of = lambda df: sorted(map(tuple, df.select(columns).collect()), key=str)
    want = of(secret_scan.redacted(docs(spark, rows)))
    monkeypatch.setattr(secret_scan, "BROADCAST_SPANS", 0)
    monkeypatch.setattr("tessera.llm.common.HOT_ROWS", 10)
    assert of(secret_scan.redacted(docs(spark, rows).repartition(3, "text"))) == want and len(want) == 53


# --- chat ---


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, 10, "message", "user", "hi"), (1, 2, 0, 11, "message", "assistant", ""), (1, 3, 0, 11, "delta", None, "wro"), (1, 4, 0, 11, "regenerate", None, None),
        (1, 5, 0, 11, "delta", None, "ri"), (1, 6, 0, 11, "delta", None, "ght"), (1, 7, 0, 10, "edit", None, "hello"), (2, 1, 0, 20, "delta", "user", "only"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, sub int, message_id long, kind string, role string, text string")
    got = {(r.conv_id, r.seq, r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {(1, 1, "user", "hello"), (1, 2, "assistant", "right"), (2, 1, "user", "only")}


def test_chat_round_trip_of_control_strings(spark):
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "x", "\n", "é", "[INST", "<\\/s>"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "</s>", "a[INST]b", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(0, 12)))])) for c in range(30) for t in range(4)]
    rows += [(7, 2, "user", "tie"), (7, 2, "user", "tie"), (None, None, "assistant", "z" * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat.parse(chat.render(chat.fold(chat.row_events(df)))).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", (r[3] or "").encode())):
        want.setdefault(c, []).append((role or "", text or "", role == "assistant"))
    assert got == want
    d = {r.conv_id: r for r in chat.digest(chat.parse(chat.render(chat.fold(chat.row_events(df))))).collect()}
    assert d[None].loss_chars == 30_000 and d[7].n_turns == 6
    assert chat.render(chat.fold(chat.row_events(df.limit(0)))).count() == 0


def test_chat_ignores_other_columns(spark):
    names = ["seq", "sub", "message_id", "kind", "log", "last", "turns", "formatted", "loss", "e", "events", "half"]
    plain = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "<s>"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    more = plain.select("*", *(F.lit("mine").alias(n) for n in names))
    clash = chat.row_events(more).select("*", *(F.lit("own").alias(n) for n in ("log", "last", "turns", "e")))
    done = lambda messages: sorted(chat.digest(chat.parse(chat.render(messages))).collect())
    want = done(chat.fold(chat.row_events(plain)))
    assert len(want) == 2 and done(chat.fold(clash)) == want
    assert done(chat.fold(clash).select("*", F.lit("own").alias("turns"), F.lit("own").alias("formatted"))) == want


# --- mixing ---


def test_mixture_meets_targets_and_caps(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([0, 1, 30, 300, 3000]), rng.choices(["a", "b", "c", "d", None], weights=[60, 5, 20, 10, 5])[0]) for i in range(400)] + [(3, "w " * 50, "a"), (None, "w " * 40, "b"), (999, None, "zero")]
    df = spark.createDataFrame([(d, t, "en", s, 0, 1) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size int")
    got = mixing.mixed_documents(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
    names = sorted((n for n in by if n is not None)) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, target, open_ = sum(s[0] for s in by.values()), {}, set(by)
    while True:
        left = total - sum(target.values())
        w = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / w > 3 * by[n][0]}
        if not over:
            break
        target |= {n: 3 * by[n][0] for n in over}
        open_ -= over
    target |= {n: left * weight[n] / w for n in open_}
    for n, (size, taken, t, source_size) in by.items():
        assert size == source_size and abs(t - target[n]) < 1e-6 and abs(taken - t) <= 0.03 * t + 3 * mixing.BLOCK, n
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mixed_documents(df.repartition(7)).collect())
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mixed_documents(df.filter("text is null")).collect()] == [0]


# --- neighbours ---


def test_neighbours_equal_brute_force_on_ties_and_odd_vectors(spark):
    rng = np.random.RandomState(2)
    rows = [(i, [float(x) for x in rng.randn(24)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(1000, 1040)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] + [1.0] * 23), (2004, [1.0, 2.0]), (2005, [2.0, 2.0]), (7, rows[7][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, score int")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0 or vec_id in (7, 2004)"), 10).collect()
    data = {}
    for r in df.collect():
        e = r.embedding
        if r.vec_id is not None and e and None not in e and np.isfinite(e).all() and any(e):
            data[r.vec_id] = np.array(e)
    for q in {r.query_id for r in got}:
        d = sorted((float(np.sqrt(((data[q] - x) ** 2).sum())), i) for i, x in data.items() if i != q and len(x) == len(data[q]))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in d] and np.allclose([m[2] for m in mine], [s for s, _ in d])
    assert {r.query_id for r in got} == {i for i in data if i % 20 == 0 or i in (7, 2004)}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_cells_and_probes_reach_nine_of_ten(spark, monkeypatch):
    """More cells than probes, on clustered vectors: recall against brute force."""
    monkeypatch.setattr(ann, "CELL", 40)
    monkeypatch.setattr(ann, "PROBES", 8)
    rng = np.random.RandomState(4)
    x = (rng.randn(60, 32)[rng.randint(0, 60, 3000)] + 0.4 * rng.randn(3000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x[q].astype(float) - x.astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = set(np.argsort(d, kind="stable")[:10].tolist())
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in mine)
        hits += len(want & {v for _, v, _ in mine})
    assert hits / 600 >= 0.9
    assert len(ann.centres_of(x, 75)) == 75


def test_bounds_hold_for_packed_codes(spark):
    """Estimates from bit counts lie around the true squared distances, within their bounds."""
    rng = np.random.RandomState(6)
    x, q = rng.randn(400, 48).astype(np.float32), rng.randn(30, 48).astype(np.float32)
    centre = {48: x.mean(axis=0, keepdims=True)}
    shared = type("B", (), {"value": centre})
    rows = lambda run, a, name: [b.to_pylist() for b in run([__import__("pyarrow").RecordBatch.from_pydict({name: np.arange(len(a)), "embedding": a.tolist()})])]
    coded, asked = sum(rows(ann._encode(shared), x, "class_id"), []), sum(rows(ann._queries(shared), q, "ask_id"), [])
    row = {
        "norms": np.array([r["norm"] for r in coded], np.float32).tobytes(), "owns": np.array([r["own"] for r in coded], np.float32).tobytes(), "codes": b"".join(r["code"] for r in coded),
        "query_ids": np.array([r["query_id"] for r in asked]).tobytes(), "planess": b"".join(r["planes"] for r in asked), "scales": b"".join(r["scale"] for r in asked),
    }
    assert len(row["codes"]) == 400 * ann.BITS // 8
    inside = total = 0
    for n, lower, upper in ann._estimates(row):
        true = ((x.astype(float) - q[n].astype(float)) ** 2).sum(axis=1)
        inside += ((lower <= true) & (true <= upper)).sum()
        total += len(true)
        assert np.corrcoef((lower + upper) / 2, true)[0, 1] > 0.85
    assert inside / total > 0.985


# --- archives ---


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a", big), (5, "http://b\r\nX: y", big), (3, None, big), (4, "u", "tiny"), (6, "u", "tiny"), (7, "u", None), (8, "u", "z" * 200_000), (5, "http://b", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    folder, archives = warc.write(pages, f"file://{tmp_path}/w")
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(archives, folder).collect())
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = data == big.encode() and p in (1, 3)
        want.append((p or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=lambda x: x[:4])
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    again, list_ = warc.write(pages, f"file://{tmp_path}/v")
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(list_, again).collect()) == got
    name = archives.first().path
    with open(name, "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"
    folder, none = warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read(none, folder).count() == 0


def test_dictionary_shrinks_similar_records():
    import zlib

    records = [warc.record(i, f"http://x/{i}", (f"<html><head><title>{i}</title></head><body>" + "common boilerplate of the site " * 8 + str(i * 7919)).encode(), None) for i in range(400)]
    packed = warc.archive(records)
    assert len(packed) < sum(len(zlib.compress(r)) for r in records) / 2
    import io

    assert list(warc.read_archive(io.BytesIO(packed))) == records
    assert list(warc.read_archive(io.BytesIO(warc.archive(records[:1])))) == records[:1]
