"""Language identification of mixed-language texts.

Script ranges narrow the candidates: a word whose letters are of a script that only some of the
learned languages are written in can't be of another one. Each word then has a score per
language, the sum of hashed character n-gram log-probabilities within it and its edges, and
Viterbi with a switching penalty labels the words of a text with spans of languages.

The model of ``fit`` is counted from a bounded sample of labelled rows (``SAMPLE`` per language,
those with the smallest hash of id and text, of texts of at most ``LONGEST`` characters), in numpy
on the driver. That of ``calibrated``, and its threshold, come from all labelled rows, counted and
measured in tasks. Both are broadcast; their size is fixed by the table of n-grams and the number
of languages.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import handing_back, scratch, stored

SAMPLE = 400
LONGEST = 200_000  # characters of a text of the sample
SIZES = (2, 3, 4)
CELLS = 1 << 15
HASH_BITS = 12
PENALTY = 12.0
WIDTH = 64  # counts are added up in Spark this many to a row
HELD = 64  # languages whose counts a task holds before it hands them on
CHUNK_CHARS = 250_000
VITERBI_CHARS = 4_000_000
FEW = 10_000  # values that are sorted on the driver
#: A text fits if the mean of its grams reaches this share of what nearly all labelled texts
#: reach; of few grams it may fall short by ``SLACK`` over the root of their number.
FIT, SLACK = 0.4, 4.0

#: First code point, end and script; letters elsewhere are "other".
SCRIPTS = (
    (0x0041, 0x0250, "latin"), (0x0370, 0x0400, "greek"), (0x0400, 0x0530, "cyrillic"), (0x0590, 0x0600, "hebrew"),
    (0x0600, 0x0780, "arabic"), (0x0900, 0x0980, "devanagari"), (0x0E00, 0x0E80, "thai"), (0x1E00, 0x1F00, "latin"),
    (0x1F00, 0x2000, "greek"), (0x3040, 0x3100, "kana"), (0x3400, 0xA000, "han"), (0xAC00, 0xD7B0, "hangul"),
    (0x20000, 0x33480, "han"),
)
NAMES = ["none", "other", *dict.fromkeys(s for *_, s in SCRIPTS)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the lower-case letter (or space), and the script."""
    lower, script = np.full(sys.maxunicode + 1, 0x20, np.uint32), np.zeros(sys.maxunicode + 1, np.uint8)
    for p in range(sys.maxunicode + 1):
        if chr(p).isalpha():
            lo = chr(p).lower()
            lower[p], script[p] = ord(lo[0]), 1
    for a, b, s in SCRIPTS:
        script[a:b][script[a:b] == 1] = NAMES.index(s)
    return lower, script


class Words:
    """Words of a run of texts: n-gram cells of each position, and where words and texts begin."""

    lower: np.ndarray | None = None
    script: np.ndarray | None = None

    def __init__(self, texts: list[str | None]):
        if Words.lower is None:
            Words.lower, Words.script = _tables()
        raw = np.frombuffer("".join(" " + (t or "") for t in texts).encode("utf-32-le", "surrogatepass") + b"\x20\0\0\0" * 5, np.uint32)
        ends = np.cumsum([1 + len(t or "") for t in texts])
        c = Words.lower[raw]
        letter = c != 0x20
        self.c = c
        begins = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        stops = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        self.begin, self.stop = begins, stops
        self.text = np.searchsorted(ends, begins, "right")
        self.word_script = Words.script[raw[begins]] if len(begins) else np.empty(0, np.uint8)
        digit = (raw >= 0x30) & (raw <= 0x39)
        self.code = digit[begins - 1] | digit[stops]  # of keys, hashes and part numbers

    def cells(self, n: int) -> np.ndarray:
        """Cell of the n-gram that ends one after each position; a gram of only spaces has cell 0."""
        x = self.c.astype(np.uint32)
        h = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            h *= np.uint32(0x9E3779B1)
            h += x[k : len(x) - n + 1 + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B + 2 * n)
        return (h >> np.uint32(17)).astype(np.int64)


class Model:
    def __init__(self, langs: list[str], tables: list[np.ndarray], levels: list[np.ndarray], scripts: np.ndarray):
        self.langs, self.tables, self.levels, self.scripts = langs, tables, levels, scripts
        self.least = -np.inf

    @staticmethod
    def fit(rows: list[tuple[str, str]]) -> Model:
        """Counts of ``(text, lang)`` rows; without rows the model knows no language."""
        langs = sorted({lang for _, lang in rows})
        texts = [[t for t, g in rows if g == lang] for lang in langs]
        return Model.of_counts(langs, [sum(gram_counts(ts[at : at + 200]) for at in range(0, len(ts), 200)) for ts in texts])

    @staticmethod
    def of_counts(langs: list[str], counts: list[np.ndarray]) -> Model:
        """The model of languages in order, from the ``gram_counts`` of each."""
        scripts = np.array([c[: len(NAMES)] for c in counts], np.float64).reshape(len(langs), len(NAMES)).T
        tables = [np.array([c[WIDTH + k * CELLS : WIDTH + (k + 1) * CELLS] for c in counts], np.float64).T.reshape(CELLS, -1) + 0.1 for k in range(len(SIZES) if langs else 0)]
        out, levels = [], []
        for table in tables:
            p = np.log(table / table.sum(axis=0))
            mean = p.mean(axis=1, keepdims=True)
            out.append((p - mean).astype(np.float32))
            # above the background, for which all cells are equally likely
            levels.append((mean[:, 0] + np.log(CELLS)).astype(np.float32))
        # a language is written in the scripts of at least a hundredth of its words
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        return Model(langs, out, levels, share >= 0.01)

    def score(self, w: Words) -> np.ndarray:
        """Score of each word for each language; languages of other scripts are out of reach."""
        out = np.zeros((len(w.begin), len(self.langs)), np.float32)
        if not len(out):
            return out
        for table, n in zip(self.tables, SIZES):
            g = table[w.cells(n)]
            # grams from the edge before the word to the edge after it; a word too short for them has none
            lo, hi = w.begin - 1, np.maximum(w.stop - n + 2, w.begin - 1)
            for k in range(len(self.langs)):
                total = np.append(0.0, np.cumsum(g[:, k], dtype=np.float64))
                out[:, k] += total[hi] - total[lo]
        known = self.scripts[w.word_script]
        out[~known & known.any(axis=1, keepdims=True)] -= 1e4
        return out

    def level(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: what its score leaves out of log-likelihood over the background, and its number of grams."""
        out, grams = np.zeros(len(w.begin)), np.zeros(len(w.begin))
        for level, n in zip(self.levels, SIZES):
            lo, hi = w.begin - 1, np.maximum(w.stop - n + 2, w.begin - 1)
            total = np.append(0.0, np.cumsum(level[w.cells(n)], dtype=np.float64))
            out += total[hi] - total[lo]
            grams += hi - lo
        return out, grams

    def fits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: log-likelihood over the background of its words, each in the language it is labelled with, and the number of their grams.

        Letters next to a digit are of no language and don't count, where a text has others.
        """
        parts = []
        for at, upto in _runs(texts, CHUNK_CHARS):
            w = Words(texts[at:upto])
            parts.append((w.text + at, self.score(w), *self.level(w), w.code))
        text, score, level, grams, code = (np.concatenate(x) for x in zip(*parts))
        label = viterbi(text, score, PENALTY)
        own = score[np.arange(len(label)), label] if self.langs else np.zeros(len(label))
        counts = ~code | (np.bincount(text, ~code, len(texts)) == 0)[text]
        return np.bincount(text, (own + level) * counts, len(texts)), np.bincount(text, grams * counts, len(texts))

    def accepts(self, texts: list[str | None]) -> np.ndarray:
        """Which texts have letters and words that fit the languages they are labelled with."""
        if not self.langs:
            return np.zeros(len(texts), bool)
        total, grams = self.fits(texts)
        some = np.maximum(grams, 1)
        return (grams > 0) & (total / some >= self.least - SLACK / np.sqrt(some))

    def label(self, texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words' texts, begins and ends (in the run of texts), and labels."""
        parts, offset, base = [], 0, 0
        for at, upto in _runs(texts, CHUNK_CHARS):
            w = Words(texts[at:upto])
            parts.append((*((x + n).astype(np.int32) for x, n in ((w.text, at), (w.begin, base), (w.stop, base))), self.score(w)))
            base += sum(1 + len(t or "") for t in texts[at:upto])
        text, begin, stop, score = (np.concatenate(x) for x in zip(*parts))
        return text, begin, stop, viterbi(text, score, PENALTY)


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """Numbers of the texts' words by script, and from ``WIDTH`` on of their grams by size and cell.

    A gram may reach over one space from one word to the next, also to the next text.
    """
    out = np.zeros(WIDTH + len(SIZES) * CELLS, np.int64)
    w = Words(texts)
    inside = _inside(w)
    out[: len(NAMES)] = np.bincount(w.word_script, minlength=len(NAMES))
    for k, n in enumerate(SIZES):
        cells = w.cells(n)
        out[WIDTH + k * CELLS : WIDTH + (k + 1) * CELLS] = np.bincount(cells[_spans(inside, n, len(cells))], minlength=CELLS)
    return out


def _inside(w: Words) -> np.ndarray:
    edge = np.zeros(len(w.c) + 1, np.int32)
    np.add.at(edge, w.begin - 1, 1)
    np.add.at(edge, w.stop + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(inside: np.ndarray, n: int, size: int) -> np.ndarray:
    """Grams whose positions all lie within words and their edges."""
    total = np.append(0, np.cumsum(inside))
    return np.flatnonzero(total[n : n + size] - total[:size] == n)


def _runs(texts: list[str | None], most: int):
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (size < most or upto == at):
            size += 1 + len(texts[upto] or "")
            upto += 1
        yield at, upto
        at = upto


def viterbi(text: np.ndarray, score: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of the words of each text; changing the label costs ``penalty``.

    All texts step together: step t takes word t of every text that has one.
    """
    n, langs = score.shape
    kind = np.int8 if langs < 128 else np.int32
    label = np.zeros(n, kind)
    if not n or not langs:
        return label
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    count = np.diff(np.append(starts, n))
    order = np.argsort(-count, kind="stable")
    starts, count = starts[order], count[order]
    alive = np.searchsorted(-count, -np.arange(count[0]), "left")  # texts with more than t words
    best = score[starts].astype(np.float64)
    came = np.zeros((n, langs), kind)
    stay = np.arange(langs, dtype=kind)
    for t in range(1, int(count[0])):
        m = int(alive[t])
        b = best[:m]
        top = b.argmax(axis=1)
        move = b[np.arange(m), top] - penalty
        switch = b < move[:, None]
        at = starts[:m] + t
        came[at] = np.where(switch, top[:, None], stay)
        best[:m] = np.where(switch, move[:, None], b) + score[at]
    now = best.argmax(axis=1).astype(kind)
    label[starts + count - 1] = now
    for t in range(int(count[0]) - 1, 0, -1):
        m = int(alive[t])
        at = starts[:m] + t
        now[:m] = came[at, now[:m]]
        label[at - 1] = now[:m]
    return label


def training_rows(docs: DataFrame, learn: Column) -> list[tuple[str, str]]:
    """``SAMPLE`` labelled rows of each language, those with the smallest hash of id and text.

    The rows are chosen by their hashes alone. Hashes are counted in 2^``HASH_BITS`` cells
    a language, and only those in the first cells that hold a sample are ranked, so that no task
    reads all of a language's; rows that repeat id, text and language count once. Texts of more
    than ``LONGEST`` characters are not learned from.
    """
    fine = learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LONGEST)
    known = docs.filter(fine).select("lang", F.xxhash64("doc_id", "text").alias("k"), "text")
    with scratch(docs.sparkSession):
        keys = stored(known.select("lang", "k").distinct())
        cell = F.shiftrightunsigned(F.col("k").bitwiseXOR(F.lit(-(2**63))), 64 - HASH_BITS)
        cells = keys.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("lang").orderBy("cell")) - F.col("n")
        upto = cells.withColumn("before", before).filter(F.col("before") < SAMPLE).groupBy("lang").agg(F.max("cell").alias("upto"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
        near = keys.join(F.broadcast(upto), "lang").filter(cell <= F.col("upto")).drop("upto")
        chosen = stored(near.withColumn("n", rank).filter(F.col("n") <= SAMPLE).drop("n"))
        rows = known.join(F.broadcast(chosen), ["lang", "k"]).dropDuplicates(["lang", "k"]).orderBy("lang", "k")
        return [(r.text, r.lang) for r in rows.collect()]


def fit(docs: DataFrame, learn: Column | None = None) -> Model:
    return Model.fit(training_rows(docs, F.lit(True) if learn is None else learn))


def counted(rows: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """``(lang, half) -> gram_counts`` of all ``rows(lang, half, text)``.

    A task holds the counts of at most ``HELD`` languages' halves and hands on the blocks of
    ``WIDTH`` that aren't all zero; there are as many tasks as the cluster has cores.
    """

    def run(batches):
        held: dict[tuple[str, int], np.ndarray] = {}

        def out():
            for (lang, half), c in held.items():
                parts = c.reshape(-1, WIDTH)
                some = np.flatnonzero(parts.any(axis=1))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(parts[some].ravel()), WIDTH).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([half] * len(some), pa.int32()), pa.array(some, pa.int32()), flat], ["lang", "half", "block", "part"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                texts: dict[tuple[str, int], list] = {}
                for lang, half, text in zip(*(c.to_pylist() for c in batch.slice(at, 2048).columns)):
                    # with room behind, so that no gram reaches into the next text, whichever that is
                    texts.setdefault((lang, half), []).append(text + "  ")
                for key, some in texts.items():
                    if key not in held and len(held) >= HELD:
                        yield from out()
                        held.clear()
                    held[key] = sum(gram_counts(some[lo:hi]) for lo, hi in _runs(some, CHUNK_CHARS)) + held.get(key, 0)
        yield from out()

    spark = rows.sparkSession
    parts = rows.select("lang", "half", "text").coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(handing_back(run), "lang string, half int, block int, part array<long>")
    summed = parts.groupBy("lang", "half", "block").agg(F.array(*(F.sum(F.col("part")[i]) for i in range(WIDTH))).alias("part")).toArrow()
    found: dict[tuple[str, int], np.ndarray] = {}
    for batch in summed.to_batches():
        part = batch.column("part").flatten().to_numpy().reshape(-1, WIDTH)
        for n, (lang, half, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "half", "block")))):
            if (lang, half) not in found:
                found[lang, half] = np.zeros(WIDTH + len(SIZES) * CELLS, np.int64)
            found[lang, half][block * WIDTH : (block + 1) * WIDTH] = part[n]
    return found


def _ranked(values: DataFrame, rank: int) -> float:
    """The value ``x`` of that rank, from 0, of a stored table, exactly; cells that can't hold it are left out until few values stay."""
    while True:
        low, high, n = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
        if low == high:
            return low
        if n <= FEW:
            return sorted(r.x for r in values.collect())[rank]
        cell = F.least(F.floor((F.col("x") - low) / (high - low) * 1024), F.lit(1023))
        for _, n, a, b in values.groupBy(cell.alias("cell")).agg(F.count("*"), F.min("x"), F.max("x")).orderBy("cell").collect():
            if rank < n:
                values = values.filter(F.col("x").between(a, b))
                break
            rank -= n


def calibrated(docs: DataFrame) -> Model:
    """A model of all labelled rows that knows how well texts of its languages fit.

    Texts are dealt in halves by their hash, and each is held against a model of the other half,
    so that no text is measured by its own n-grams or those of its copies. Texts in languages that
    the other half lacks are not measured. The threshold comes from the exact hundredth of all.
    """
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", half, "text")
    counts = counted(rows)

    def of(*halves: int) -> Model:
        langs = sorted({g for g, h in counts if h in halves})
        return Model.of_counts(langs, [sum(counts[g, h] for h in halves if (g, h) in counts) for g in langs])

    model, context = of(0, 1), docs.sparkSession.sparkContext
    if not model.langs:
        return model
    others = context.broadcast((of(1), of(0)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048).to_pydict()
                for h, m in enumerate(others.value):
                    texts = [t for t, k, g in zip(part["text"], part["half"], part["lang"]) if k == h and g in m.langs]
                    for lo, hi in _runs(texts, VITERBI_CHARS):
                        total, grams = m.fits(texts[lo:hi])
                        yield pa.RecordBatch.from_arrays([pa.array(np.round(total[grams > 0] / grams[grams > 0], 9))], ["x"])

    with scratch(docs.sparkSession):
        means = stored(rows.mapInArrow(handing_back(run), "x double"))
        n = means.count()
        if n:
            low, high = (_ranked(means, k) for k in (int(0.01 * (n - 1)), min(int(0.01 * (n - 1)) + 1, n - 1)))
            at = low + (0.01 * (n - 1) % 1) * (high - low)
            model.least = float(at - (1 - FIT) * abs(at))
    return model


def _predict(model, emit):
    def run(batches):
        m = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = part.column("text").to_pylist()
                for lo, hi in _runs(texts, VITERBI_CHARS):
                    yield emit(part.slice(lo, hi - lo), *_document(m, texts[lo:hi]))

    return run


def _document(m: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    n, langs = len(texts), max(1, len(m.langs))
    text, begin, stop, label = m.label(texts)
    letters = np.bincount(text * langs + label, weights=stop - begin, minlength=n * langs).reshape(n, langs)
    total = letters.sum(axis=1)
    top = letters.argmax(axis=1)
    share = np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)
    pred = [m.langs[k] if t > 0 and m.langs else "und" for k, t in zip(top.tolist(), total.tolist())]
    return pred, np.where([p == "und" for p in pred], 0.0, share).tolist()


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of ``docs``.

    ``lang_pred`` is the language of most letters of the text, ``score`` their share of all its
    letters. Texts that are null or have no letter are ``und`` with score 0; so is every text if
    no language was learned. Of languages with equally many letters the first by name is taken.
    """
    emit = lambda part, pred, score: pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(handing_back(_predict(shared, emit)), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose words fit the languages they are labelled with.

    Texts without letters go, and those of random letters, encoded data or languages that were
    not learned; texts of several learned languages stay. A model that isn't ``calibrated``
    rejects only texts without letters. A null ``lang``, if there is that column, becomes the
    language of most letters. Rows that repeat are judged alike; an empty table stays empty.
    """
    kinds = [f for f in docs.schema if f.name == "lang" and f.dataType.simpleString() == "string"]

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = part.column("text").to_pylist()
                for lo, hi in _runs(texts, VITERBI_CHARS):
                    fine = np.flatnonzero(m.accepts(texts[lo:hi])) + lo
                    kept = part.take(pa.array(fine))
                    where = kept.schema.get_field_index("lang")
                    if kinds and kept.column(where).null_count:
                        lang = kept.column(where).to_pylist()
                        pred = _document(m, [texts[i] if g is None else None for i, g in zip(fine, lang)])[0]
                        kept = kept.set_column(where, kept.schema.field(where), pa.array([p if g is None else g for g, p in zip(lang, pred)], kept.schema.field(where).type))
                    yield kept

    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(handing_back(run), docs.schema)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, start, end, lang``: the runs of words of one language in each text, code points."""

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                text, begin, stop, label = m.label(texts)
                if not len(text) or not m.langs:
                    continue
                base = np.append(0, np.cumsum([1 + len(t or "") for t in texts]))[text] + 1
                first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (label[1:] != label[:-1])))
                last = np.append(first[1:], len(text)) - 1
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"doc_id": [ids[i] for i in text[first]], "start": begin[first] - base[first], "end": stop[last] - base[first], "lang": [m.langs[k] for k in label[first]]}),
                    pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]),
                    preserve_index=False,
                )

    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(handing_back(run), "doc_id long, start long, end long, lang string")
