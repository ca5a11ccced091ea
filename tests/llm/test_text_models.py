import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language_id, lm, quality
from tessera.llm.common import crc_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, g, "s", 0, "clash") for d, t, g in rows], SCHEMA)


WORDS = {
    "en": "the of and with there shall nothing words thing",
    "de": "der die und nicht schön werden ungeheuer einheit",
    "el": "και της από θάλασσα λόγος άνθρωπος ημέρα",
}


def sample(lang, rng, n=40):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


def test_language_spans_scripts_and_odd_texts(spark):
    rng = random.Random(1)
    train = docs(spark, [(i, sample(g, rng), g) for i, g in enumerate(list(WORDS) * 20)] + [(900, None, "en"), (901, "x", None)])
    model = language_id.fit(train)
    odd = [(1, None, "en"), (2, "", None), (3, "12 .. 34\n", "en"), (4, sample("el", rng), None), (5, sample("en", rng, 30) + " " + sample("de", rng, 60), None), (5, "nothing", None), (6, "thing " * 9000, None), (7, "𠀀𠀁𠀂", None)]
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 2)) for r in language_id.identified(docs(spark, odd), model).collect())
    assert got[:4] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "el", 1.0)]
    assert [g[:2] for g in got[4:7]] == [(5, "de"), (5, "en"), (6, "en")]
    assert got[7][1] in WORDS  # letters of all planes are letters
    spans = [(r.start, r.end, r.lang) for r in language_id.spans(docs(spark, odd[4:5]), model).orderBy("start").collect()]
    assert [s[2] for s in spans] == ["en", "de"] and spans[0][0] == 0 and spans[1][1] == len(odd[4][1])
    kept = language_id.accepted(docs(spark, odd), model)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and sorted(r.doc_id for r in kept.collect()) == [4, 5, 5, 6, 7]
    assert {r.doc_id: r.lang for r in kept.collect()}[4] == "el"  # a null language is filled in


def test_language_stage_rejects_what_fits_no_learned_language(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null and lang is not null")
    rng = random.Random(8)
    one = {lang: max(t for (t,) in d.filter(F.col("lang") == lang).select("text").collect() if len(t) < 3000) for lang in ("en", "de", "fr", "es")}
    mixed = [" ".join(one[g][:600] for g in gs) for gs in (["en", "de"], ["fr", "es", "de"], list(one))]
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10))) for _ in range(n)) for n in (30, 300)]
    odd = ["все люди рождаются свободными и равными в своем достоинстве и правах", "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", k=800)), "12 .. 34", None]
    planted = [(10**9 + i, t, None) for i, t in enumerate(mixed + noise + odd)]
    rows = d.select("doc_id", "text", "lang", "source", "n_chars", F.lit("clash").alias("score")).unionByName(docs(spark, planted).withColumn("n_chars", F.lit(0).cast("long")))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, rows, sf).select("doc_id").collect()}
    assert {i for i, _, _ in planted if i in kept} == {10**9 + i for i in range(len(mixed))}
    assert kept >= {r.doc_id for r in d.select("doc_id").collect()}


def test_language_without_training_or_rows(spark):
    none = language_id.fit(docs(spark, []))
    assert [r.lang_pred for r in language_id.identified(docs(spark, [(1, "abc", None)]), none).collect()] == ["und"]
    assert language_id.identified(docs(spark, []), none).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.RandomState(3)
    from itertools import product

    score = rng.randn(14, 3) * 4
    text = np.array([0] * 6 + [1] * 1 + [3] * 7)
    got = language_id.viterbi(text, score, 3.0)
    for t in (0, 1, 3):
        at = np.flatnonzero(text == t)
        value = lambda p: sum(score[i, k] for i, k in zip(at, p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert math.isclose(value(got[at]), max(map(value, product(range(3), repeat=len(at)))))


def test_held_out_accuracy_on_the_driver_tables(spark):
    at = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    out = crc_mod(F.col("doc_id"), 5) == 0
    pred = language_id.identified(d, language_id.fit(d, ~out)).join(d.select("doc_id", "lang"), "doc_id").filter(out)
    assert pred.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    out = crc_mod(F.col("doc_id"), 4) == 2
    got = quality.scored(d, quality.fit(d, labels, ~out)).join(labels, "doc_id").filter(out)
    assert got.agg(F.avg(((F.col("score") >= quality.THRESHOLD).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.95


def test_quality_of_odd_texts(spark):
    good, bad = "This is a plain line of text.\nAnd another one follows it.", "$$$ ### BUY!!\nBUY!! BUY!! BUY!! ***\n### &&& %%%"
    rows = [(i, good if i % 2 else bad, None) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, quality int")
    chain = quality.fit(docs(spark, rows), labels, F.lit(True))
    odd = [(1, good, None), (2, bad, None), (3, None, None), (4, "", None), (5, " \n\r\n", None), (6, "word\n" * 4000, None), (1, good, None)]
    got = {}
    for r in quality.scored(docs(spark, odd), chain).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert got[1][0] > 0.7 > 0.3 > got[2][0] and got[1][0] == got[1][1] and got[3] == got[4] == got[5]
    assert all(0 <= s <= 1 for v in got.values() for s in v)
    assert quality.scored(docs(spark, []), chain).count() == 0
    empty = quality.fit(docs(spark, []), labels.limit(0), F.lit(True))
    assert [r.score for r in quality.scored(docs(spark, odd[:1]), empty).collect()] == [0.5]


def test_chain_marginals_equal_brute_force():
    from itertools import product

    rng = np.random.RandomState(5)
    u, moves = rng.randn(5), rng.randn(2, 2)
    got, pairs = quality.Layout(np.array([0, 0, 0, 0, 2])).forward_backward(u, moves)
    weight = {p: math.exp(sum(u[i] * p[i] for i in range(4)) + sum(moves[a][b] for a, b in zip(p, p[1:]))) for p in product((0, 1), repeat=4)}
    z = sum(weight.values())
    want = [sum(w for p, w in weight.items() if p[i]) / z for i in range(4)] + [1 / (1 + math.exp(-u[4]))]
    assert np.allclose(got, want)
    assert np.allclose(pairs[1, 0], sum(w * sum(a == 1 and b == 0 for a, b in zip(p, p[1:])) for p, w in weight.items()) / z)


def test_lm_counts_and_normalisation(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["The", "the", "cat", "dog", "ran", f"x{i}"], k=rng.randrange(1, 40))), None) for i in range(80)] + [(200, None, None), (201, "", None), (202, "cat " * 20000, None), (7, "new words", None)]
    got = lm.scored(docs(spark, rows), crc_mod(F.col("doc_id"), 5) != 1).collect()
    tokens = [((t or "").encode().lower().split() + [b"\n"], d) for d, t, _ in rows]
    c = Counter(w for ws, d in tokens if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((d, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for ws, d in tokens)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    none = lm.scored(docs(spark, rows[:3]), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)
    assert lm.scored(docs(spark, []), F.lit(True)).count() == 0


def test_lm_tables_are_normalised_and_learn_order(spark):
    rows, v, counts, bound = lm.encoded(docs(spark, [(i, " ".join(["a b"] * 200), None) for i in range(50)]), F.lit(True))
    one, two, z = lm.log_tables(lm.train(rows, v))
    p = np.exp(one[:, None, :] + two[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
    x, y = v.place[b"a"], v.place[b"b"]
    assert p[x, y, y] > 0.8 and p[y, x, x] > 0.8


def test_lm_scores_equal_brute_force_for_any_partitioning(spark, monkeypatch):
    """Whole texts against plain sums of normalised probabilities; 1 and 8 partitions, several shards."""
    monkeypatch.setattr(lm, "CLASSES", 12)
    monkeypatch.setattr(lm, "HEAD", 20)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 300)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=range(30, 0, -1), k=rng.randrange(0, 60))), None) for i in range(60)] + [(90, None, None), (91, "unseen words w1", None)]
    d, learn = docs(spark, rows), crc_mod(F.col("doc_id"), 5) != 1
    encoded, v, counts, bound = lm.encoded(d.coalesce(1), learn)
    params = lm.train(encoded, v)
    got = {r.doc_id: r.score for r in lm.scores(encoded, v, params, counts, bound).collect()}
    r, q, c1, c2, bias = (p.astype(float) for p in params)
    c = Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in (t or "").encode().split() + [b"\n"])
    ranked = sorted(c, key=lambda w: (-c[w], w))
    top = ranked[:11]
    rest = sum(c[w] for w in ranked[11:])
    place = lambda w: top.index(w) if w in top else 11
    for i, t, _ in rows:
        ws, total, a, b = (t or "").encode().split() + [b"\n"], 0.0, place(b"\n"), place(b"\n")
        for w in ws:
            u = (r[a] @ c1 + r[b] @ c2) @ q.T + bias
            total += u[place(w)] - math.log(np.exp(u).sum())
            if w not in top:
                total += math.log((c[w] + 0.5) / (rest + 0.5 * (len(c) - 11 + 1)))
            a, b = place(w), a
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-5, abs_tol=1e-4), i
    again = {x.doc_id: x.score for x in lm.scored(d.repartition(8), learn).collect()}
    assert again == got


def test_lm_gains_on_held_out_texts(spark):
    at = "/root/testdata/sf0.01"
    out = crc_mod(F.col("doc_id"), 5) == 1
    got = lm.scored(spark.read.parquet(f"{at}/documents.parquet"), ~out).filter(out).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.04  # log10 a token


def test_words_and_steps_of_the_language_model():
    """Words cut in Arrow are those of plain Python, of parts of arrays as well; rows that a step hasn't met don't change."""
    import pyarrow as pa

    from tessera.llm.common import words

    texts = [None, "", "  A b \x0b\x0c\x1c\x85 ÀB\n", "x  Y\tz", " ", "Ünder the BRIDGE"] * 50
    whole = pa.array(texts)
    for part in (whole, whole.slice(7, 100)):
        flat, sizes = lm._words(part)
        want = [words(t) for t in part.to_pylist()]
        assert flat.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]
    batch = pa.RecordBatch.from_arrays([whole], ["text"])
    counts = {w.as_py(): c.as_py() for b in lm._count([batch]) for w, c in zip(b.column(0), b.column(1))}
    assert counts == Counter(w for t in texts for w in [*words(t), lm.END])
    v = lm.Vocabulary([(b"w%d" % i, 100 - i) for i in range(50)], 3825, 50)
    params = lm.start(v)
    trainer = lm.Trainer(params, [np.full_like(p, 1e-2) for p in params], v.noise, 3)
    seen = np.array([3, 4, 5, 3], np.int64)
    trainer.step(seen, *lm.contexts(seen, np.array([0, 2]), 50))
    changed = np.flatnonzero((trainer.params[0] != params[0]).any(axis=1))
    assert changed.tolist() == [3, 5, 50]  # contexts: 4 ends a text


def test_calibrated_counts_and_measures_all_labelled_rows(spark):
    """More texts than a sample of ``SAMPLE`` holds, one of them longer than ``LONGEST``: counts and threshold of all."""
    rng = random.Random(3)
    rows = [(i, sample(g, rng, 12), g) for i, g in enumerate(["en", "de"] * (language_id.SAMPLE + 50))] + [(9000, "thing zzyzx " * 20_000, "en"), (9001, None, "en"), (9002, "qqq", None)]
    model = language_id.calibrated(docs(spark, rows).repartition(3))
    known = [(t, g) for _, t, g in rows if t and g]
    apart = [(t + "  ", g) for t, g in known]  # no gram reaches from one text to the next
    want = language_id.Model.fit(apart)
    assert model.langs == want.langs and all(np.allclose(a, b, atol=1e-6) for a, b in zip(model.tables + model.levels, want.tables + want.levels)) and (model.scripts == want.scripts).all()
    half = {r.text: r.half for r in docs(spark, rows).select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()}
    means = []
    for k in (0, 1):
        total, grams = language_id.Model.fit([r for r in apart if half[r[0][:-2]] != k]).fits([t for t, _ in known if half[t] == k])
        means += (total / grams).tolist()
    low = np.quantile(means, 0.01)
    assert abs(model.least - (low - (1 - language_id.FIT) * abs(low))) < 1e-6


def test_ranked_values_are_exact(spark, monkeypatch):
    monkeypatch.setattr(language_id, "FEW", 10)
    x = sorted([1.0] * 300 + [random.Random(4).uniform(-3, 9) for _ in range(200)] + [-1e9, 1e9])
    values = spark.createDataFrame([(v,) for v in x], "x double")
    assert [language_id._ranked(values, k) for k in (0, 1, 57, 150, 300, 501)] == [x[k] for k in (0, 1, 57, 150, 300, 501)]
