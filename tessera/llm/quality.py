"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its features are shape statistics of its own and of the lines before
and after it. The chain is fitted by gradient ascent in numpy on the driver, on a bounded sample
of labelled documents (``SAMPLE``, of at most ``LONGEST`` characters), each line with its document's label. A document's score is
the mean of its lines' forward-backward marginals, weighted by the lines' lengths.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import handing_back

SAMPLE = 4000
LONGEST = 100_000  # characters of a text of the sample
ROUNDS, RATE, DECAY = 150, 0.1, 1e-3
CHUNK_CHARS = 500_000
THRESHOLD = 0.7

_CLASSES: np.ndarray | None = None
_SPACE, _LETTER, _UPPER, _DIGIT, _STOP, _MARK = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    """Bits of each code point."""
    global _CLASSES
    if _CLASSES is None:
        out = np.zeros(sys.maxunicode + 1, np.uint8)
        for p in range(sys.maxunicode + 1):
            ch = chr(p)
            out[p] = (
                _SPACE * ch.isspace() | _LETTER * ch.isalpha() | _UPPER * ch.isupper() | _DIGIT * ch.isdigit()
                | _STOP * (ch in ".,;:?") | _MARK * (not ch.isspace() and not ch.isalnum() and ch not in ".,;:?'\"-()")
            )
        _CLASSES = out
    return _CLASSES


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each non-blank line, its length and the number of its text.

    A text without such a line (null, empty or blank) has none.
    """
    joined = "\n".join((t or "").replace("\r", "\n") for t in texts) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(c == 10)
    begins = np.append(0, ends[:-1] + 1)
    text_end = np.cumsum([len(t or "") + 1 for t in texts]) - 1
    text = np.searchsorted(text_end, ends, "left")
    bits = _classes()[c]
    total = lambda mask: (lambda s: s[ends] - s[begins])(np.append(0, np.cumsum(mask)).astype(np.int64))
    space = (bits & _SPACE) > 0
    solid = total(~space)
    keep = solid > 0
    if not keep.any():
        return np.zeros((0, 3 * 14)), np.zeros(0), np.zeros(0, np.int64)
    word = np.flatnonzero(~space & np.append(True, space[:-1]))
    size = np.diff(np.append(word, len(c)))
    where = np.arange(len(c), dtype=np.uint64) - np.repeat(word, size).astype(np.uint64) if len(word) and word[0] == 0 else None
    if where is None:
        where = np.zeros(len(c), np.uint64)
        where[word[0] :] = np.arange(word[0], len(c), dtype=np.uint64) - np.repeat(word, size).astype(np.uint64)
    x = (c.astype(np.uint64) + (where << np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x[space] = 0
    whash = np.add.reduceat(x, word)
    wline = np.searchsorted(ends, word)
    n_words = np.bincount(wline, minlength=len(ends))
    again = np.bincount(wline[1:][(whash[1:] == whash[:-1]) & (wline[1:] == wline[:-1])], minlength=len(ends))
    key = np.sort((wline.astype(np.uint64) << np.uint64(32)) | (whash >> np.uint64(32)))
    distinct = np.bincount((key[np.append(True, key[1:] != key[:-1])] >> np.uint64(32)).astype(np.int64), minlength=len(ends))
    # a line's hash is the sum of its words' hashes by place
    lhash = np.zeros(len(ends), np.uint64)
    np.add.at(lhash, wline, whash * (np.arange(len(word), dtype=np.uint64) - np.searchsorted(wline, wline).astype(np.uint64) + np.uint64(3)))
    order = np.lexsort((np.arange(len(ends)), lhash, text))
    same = np.append(False, (lhash[order][1:] == lhash[order][:-1]) & (text[order][1:] == text[order][:-1]))
    repeated = np.zeros(len(ends))
    repeated[order] = same

    w, n = np.maximum(n_words, 1), np.maximum(solid, 1)
    letters, upper, digits = total((bits & _LETTER) > 0), total((bits & _UPPER) > 0), total((bits & _DIGIT) > 0)
    stops, marks = total((bits & _STOP) > 0), total((bits & _MARK) > 0)
    last = bits[np.maximum(ends - 1, 0)]
    own = np.stack(
        [
            np.log1p(solid), np.log1p(n_words), letters / n, upper / np.maximum(letters, 1), digits / n, stops / w, marks / w,
            np.minimum(marks / w, 0.5), n / w / 10, distinct / w, again / w, repeated, (last & _STOP) > 0, (bits[begins] & _UPPER) > 0,
        ],
        axis=1,
    )[keep].astype(np.float64)
    text = text[keep]
    edge = text[1:] != text[:-1]
    before = np.vstack([np.zeros((1, own.shape[1])), own[:-1]])
    after = np.vstack([own[1:], np.zeros((1, own.shape[1]))])
    before[np.append(True, edge)] = 0
    after[np.append(edge, True)] = 0
    return np.hstack([own, before, after]), solid[keep].astype(np.float64), text


class Chain:
    """Weights of a fitted chain; state 1 is good. Parameters: unary weights and a 2 x 2 table."""

    def __init__(self, mean, scale, weights, bias, moves):
        self.mean, self.scale, self.weights, self.bias, self.moves = mean, scale, weights, bias, moves

    def unary(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    @staticmethod
    def fit(texts: list[str], good: list[int]) -> Chain:
        parts, offset = [], 0
        for at, upto in _runs(texts):
            x, _, text = line_features(texts[at:upto])
            parts.append((x, text + at))
        x = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, 42))
        text = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        if not len(x):
            return Chain(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), 0.0, np.zeros((2, 2)))
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.clip((x - mean) / scale, -8, 8)
        y = np.asarray(good)[text]
        layout = Layout(text)
        both = y[1:][text[1:] == text[:-1]]
        seen = np.array([[np.sum(both == 0), 0], [0, np.sum(both == 1)]], float)
        p = np.zeros(x.shape[1] + 5)
        m, v = np.zeros_like(p), np.zeros_like(p)
        docs = len(np.unique(text))
        for step in range(1, ROUNDS + 1):
            moves = p[-4:].reshape(2, 2)
            marginal, pairs = layout.forward_backward(z @ p[:-5] + p[-5], moves)
            d = y - marginal
            g = np.concatenate([z.T @ d, [d.sum()], (seen - pairs).ravel()]) / docs - DECAY * p
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return Chain(mean, scale, p[:-5], p[-5], p[-4:].reshape(2, 2))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text; one without lines has the score that the chain gives a featureless line."""
        x, weight, text = line_features(texts)
        none = 1 / (1 + np.exp(-self.unary(np.zeros((1, len(self.mean))))[0]))
        out = np.full(len(texts), none)
        if len(x):
            marginal, _ = Layout(text).forward_backward(self.unary(x), self.moves)
            total = np.bincount(text, weight, minlength=len(texts))
            mean = np.bincount(text, weight * marginal, minlength=len(texts)) / np.maximum(total, 1)
            out = np.where(total > 0, mean, out)
        return np.clip(out, 0.0, 1.0)


class Layout:
    """Lines of many texts, so that step t takes line t of each text that has one."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        count = np.diff(np.append(starts, n))
        order = np.argsort(-count, kind="stable")
        starts, count = starts[order], count[order]
        alive = np.searchsorted(-count, -np.arange(count[0]), "left")
        self.n, self.at = n, [starts[: alive[t]] + t for t in range(count[0])]

    def forward_backward(self, u: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of state 1 of each line, and expected numbers of moves; log-odds messages."""
        r, s = np.zeros(self.n), np.zeros(self.n)
        (t00, t01), (t10, t11) = moves
        r[self.at[0]] = u[self.at[0]]
        for prev, at in zip(self.at, self.at[1:]):
            x = r[prev[: len(at)]]
            r[at] = u[at] + np.logaddexp(x + t11, t01) - np.logaddexp(x + t10, t00)
        for at, nxt in zip(self.at[-2::-1], self.at[:0:-1]):
            x = u[nxt] + s[nxt]
            s[at[: len(nxt)]] = np.logaddexp(t11 + x, t10) - np.logaddexp(t01 + x, t00)
        pairs = np.zeros(4)
        for at, nxt in zip(self.at, self.at[1:]):
            a, x = r[at[: len(nxt)]], u[nxt] + s[nxt]
            e = np.stack([np.full(len(a), t00), t01 + x, a + t10, a + t11 + x])
            e = np.exp(e - e.max(axis=0))
            pairs += (e / e.sum(axis=0)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(r + s, -60, 60))), pairs.reshape(2, 2)


def _runs(texts: list[str | None]):
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (size < CHUNK_CHARS or upto == at):
            size += 1 + len(texts[upto] or "")
            upto += 1
        yield at, upto
        at = upto


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Chain:
    """A chain fitted on ``SAMPLE`` labelled documents, those with the smallest hash of their id.

    Labels without doc_id or quality don't count; of several labels of a document the lowest does,
    and of several documents of one id the one with the least hash of its text. Texts that are
    null or longer than ``LONGEST`` are not learned from.
    """
    known = labels.filter(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").filter(F.length("text") <= LONGEST).join(F.broadcast(some), "doc_id")
    once = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("k"), "text")).alias("t"))
    rows = once.orderBy("doc_id").select("t.text", "quality").collect()
    return Chain.fit([r[0] for r in rows], [int(r[1] >= 1) for r in rows])


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id, score`` of every row; whole texts, null and blank ones included.

    Those get the score of a line of zero features. Rows that repeat get equal scores; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column("text").to_pylist()
                score = np.concatenate([m.score(texts[lo:hi]) for lo, hi in _runs(texts)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(handing_back(run), "doc_id long, score double")
