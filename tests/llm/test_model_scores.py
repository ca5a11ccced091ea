"""Scores of whole texts by the fitted quality and language models, against plain Python of every row."""

import math

import numpy as np
import pytest

from tessera.llm import language_id, quality, queries


def captured(monkeypatch, module):
    """What the query's own fit returns."""
    made, fit = [], module.fit
    monkeypatch.setattr(module, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    return made


# --- quality ----------------------------------------------------------------------------------


def plain_line(line, seen):
    solid = [ch for ch in line if not ch.isspace()]
    words, n, w = line.split(), max(len(solid), 1), max(len(line.split()), 1)
    letters, upper = sum(ch.isalpha() for ch in solid), sum(ch.isupper() for ch in solid)
    stops = sum(ch in ".,;:?" for ch in solid)
    marks = sum(not ch.isalnum() and ch not in ".,;:?'\"-()" for ch in solid)
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [
        math.log1p(len(solid)), math.log1p(len(words)), letters / n, upper / max(letters, 1), sum(ch.isdigit() for ch in solid) / n, stops / w, marks / w,
        min(marks / w, 0.5), n / w / 10, len(set(words)) / w, again / w, tuple(words) in seen, line[-1] in ".,;:?", line[0].isupper(),
    ], len(solid)


def plain_quality(chain, text):
    own, size, seen = [], [], set()
    for line in (text or "").replace("\r", "\n").split("\n"):
        if line.strip():
            x, solid = plain_line(line, seen)
            own.append(x)
            size.append(solid)
            seen.add(tuple(line.split()))
    none = [0.0] * 14
    unary = []
    for at in range(len(own)):
        x = [*own[at], *(own[at - 1] if at else none), *(own[at + 1] if at + 1 < len(own) else none)]
        z = [min(max((a - m) / s, -8), 8) for a, m, s in zip(x, chain.mean, chain.scale)]
        unary.append(sum(a * b for a, b in zip(z, chain.weights)) + chain.bias)
    if not unary:
        z = [min(max(-m / s, -8), 8) for m, s in zip(chain.mean, chain.scale)]
        return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, chain.weights)) + chain.bias)))
    potential = [(1.0, math.exp(u)) for u in unary]
    move = [[math.exp(chain.moves[a][b]) for b in (0, 1)] for a in (0, 1)]

    def normal(pair):
        return pair[0] / sum(pair), pair[1] / sum(pair)

    forward, backward = [normal(potential[0])], [(1.0, 1.0)]
    for p in potential[1:]:
        forward.append(normal([p[b] * sum(forward[-1][a] * move[a][b] for a in (0, 1)) for b in (0, 1)]))
    for p in potential[:0:-1]:
        backward.append(normal([sum(move[a][b] * p[b] * backward[-1][b] for b in (0, 1)) for a in (0, 1)]))
    good = [normal((f[0] * b[0], f[1] * b[1]))[1] for f, b in zip(forward, reversed(backward))]
    return sum(g * n for g, n in zip(good, size)) / sum(size)


def test_quality_scores_equal_plain_ones(spark, sf, monkeypatch):
    made = captured(monkeypatch, quality)
    got = {r.doc_id: r.score for r in queries.QUERIES["op4_quality"](spark, sf).collect()}
    (chain,) = made
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys() and len(texts) >= 200
    for d, text in texts.items():
        assert math.isclose(got[d], plain_quality(chain, text), abs_tol=1e-6), d
    odd = [None, "", " \n ", "One line.", "a a b\n\na a b\r\x0b \nZ!\n7", " x\n" * 40, "É" * 30_000]
    assert np.allclose(chain.score(odd), [plain_quality(chain, t) for t in odd], atol=1e-6)


# --- languages --------------------------------------------------------------------------------


def plain_cell(gram):
    h = gram[0]
    for c in gram[1:]:
        h = (h * 0x9E3779B1 + c) % 2**32
    h ^= h >> 15
    return (h * (0x85EBCA6B + 2 * len(gram)) % 2**32) >> 17


def plain_script(ch):
    return next((s for a, b, s in language_id.SCRIPTS if a <= ord(ch) < b), "other")


def plain_words(text):
    """Runs of letters: the word with a space on each side, lower-cased, and its first letter."""
    word, out = "", []
    for ch in (text or "") + " ":
        if ch.isalpha():
            word += ch
        elif word:
            out.append(([32, *(ord(c.lower()[0]) for c in word), 32], word[0]))
            word = ""
    return out


def plain_language(model, text, cells):
    words = plain_words(text)
    if not words:
        return "und", 0.0
    scores = []
    for code, first in words:
        total = np.zeros(len(model.langs))
        for table, n in zip(model.tables, language_id.SIZES):
            for at in range(len(code) - n + 1):
                gram = tuple(code[at : at + n])
                if gram not in cells:
                    cells[gram] = plain_cell(gram)
                total += table[cells[gram]]
        known = model.scripts[language_id.NAMES.index(plain_script(first))]
        scores.append(np.where(known, total, total - 1e4) if known.any() else total)
    best, came = scores[0], []
    for s in scores[1:]:
        top = int(best.argmax())
        switch = best < best[top] - language_id.PENALTY
        came.append([top if x else k for k, x in enumerate(switch)])
        best = np.where(switch, best[top] - language_id.PENALTY, best) + s
    label = [int(best.argmax())]
    for step in reversed(came):
        label.append(step[label[-1]])
    letters = [0] * len(model.langs)
    for (code, _), k in zip(words, reversed(label)):
        letters[k] += len(code) - 2
    return model.langs[letters.index(max(letters))], max(letters) / sum(letters)


def test_language_scores_equal_plain_ones(spark, sf, monkeypatch):
    made = captured(monkeypatch, language_id)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.QUERIES["op5_language_id"](spark, sf).collect()}
    (model,) = made
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys() and len(texts) >= 200
    cells = {}
    for d, text in texts.items():
        lang, score = plain_language(model, text, cells)
        assert got[d][0] == lang and math.isclose(got[d][1], score, abs_tol=1e-9), d


@pytest.mark.parametrize("last", ["a", "I", "é"])
def test_a_word_does_not_depend_on_the_text_after_it(last):
    model = language_id.Model.fit([("the cat is a pet and I am not", "en"), ("le chat a été à la maison", "fr")])
    alone = model.score(language_id.Words([f"so {last}"]))
    for other in ("zebra", "ab", "5", ""):
        w = language_id.Words([f"so {last}", other])
        assert np.allclose(model.score(w)[:2], alone, atol=1e-6)
        assert np.allclose(model.level(w)[0][:2], model.level(language_id.Words([f"so {last}"]))[0], atol=1e-6)
