"""Language-model scores of a log-bilinear model trained with noise-contrastive estimation.

A token is a lower-cased word or the end of a text. The ``CLASSES - 1`` most frequent tokens are
predicted each, all others as one class; a word of that class then has its add-half unigram
probability within it. With vectors ``r`` of the two tokens before and ``q`` of the token,

    log P(w | a, b) = (r_a C1 + r_b C2) . q_w + bias_w - log Z(a, b),

and the normalisers of all contexts are one matrix product, ``exp(T1 + bias) @ exp(T2).T`` with
``T = r C q.T``, so that every token's log-probability is normalised.

Words are counted over all training texts. The ``HEAD`` most frequent are broadcast, a bounded
table; the counts of others are joined to the texts that have them. Each text is then kept as its
tokens' classes, two bytes each, and training and scoring read those.

Training goes over all training texts, in shards of about ``SHARD_TOKENS`` tokens that hashes of
the texts and ids make up. In each round all shards take gradient steps from the same start, and
their parameters are averaged by numbers of tokens, as integers, so that the result is the same
for any partitioning. There are as many rounds as give each shard ``SEEN_TOKENS`` tokens, at
least ``LEAST_ROUNDS``.
"""

from __future__ import annotations

import copy
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import handing_back, scratch, stored

END = b"\n"  # no word has white space
HEAD = 1 << 17
CLASSES, WIDTH = 2048, 16
NOISE, BATCH, RATE = 64, 1024, 0.3
SHARD_TOKENS, SEEN_TOKENS = 2_000_000, 4_000_000
LEAST_ROUNDS, MOST_ROUNDS = 2, 12
UNIT = 2**20  # parameters are averaged as multiples of 1 / UNIT
COUNTER = 2_000_000  # words that a task counts before it hands their counts on
SLICE = 4_000_000  # bytes of text that are cut into words at once


# --- counts -----------------------------------------------------------------------------------


def _slices(batch: pa.RecordBatch):
    """Parts of a batch of about ``SLICE`` bytes of text, at least a row each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and how many each text has; those of :func:`common.words`."""
    # a copy: of a part of an array the kernel splits other rows (seen with pyarrow 23)
    own = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(own))
    flat = lists.values.cast(pa.large_binary())
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty piece
    return flat.filter(pa.array(some)), np.diff(np.append(0, np.cumsum(some))[lists.offsets.to_numpy()])


def _count(batches):
    held, n, texts = [], 0, 0

    def out():
        pairs = pc.value_counts(pa.chunked_array([*held, pa.array([], pa.large_binary())]))
        return pa.RecordBatch.from_arrays([pairs.field("values").cast(pa.binary()), pairs.field("counts").cast(pa.int64())], ["word", "c"])

    for batch in batches:
        for part in _slices(batch.select(["text"])):
            flat, _ = _words(part.column("text"))
            held.append(flat)
            n, texts = n + len(flat), texts + part.num_rows
            if n > COUNTER:
                yield out()
                held, n = [], 0
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], ["word", "c"])


def token_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` of all tokens of ``docs``, written to the shared folder."""
    partial = docs.select("text").mapInArrow(handing_back(_count), "word binary, c long")
    return stored(partial.groupBy("word").agg(F.sum("c").alias("c")))


def head_bound(counts: DataFrame, most: int = HEAD) -> int:
    """Least count c such that at most ``most`` words have it or more."""
    total = 0
    bound = None
    for c, n in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most + 1).collect():
        total += n
        if total > most:
            break
        bound = c
    return bound if bound is not None else 1 << 62


# --- model ------------------------------------------------------------------------------------


class Vocabulary:
    """The head: words by descending count. Token ids: place in the head, -1 for all others."""

    def __init__(self, rows: list[tuple[bytes, int]], n_all: int, n_distinct: int):
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.head = pa.array([w for w, _ in rows], pa.large_binary())
        self.count = np.array([c for _, c in rows] + [0], np.float64)  # the last: id -1
        self.n_all, self.n_distinct = n_all, n_distinct
        self.classes = min(CLASSES, len(rows) + 1)
        top = self.count[: self.classes - 1]
        self.rest_all = n_all - float(top.sum())
        self.rest_distinct = n_distinct - len(top)
        self.end = next((i for i, (w, _) in enumerate(rows) if w == END), -1)
        share = np.append(top, max(self.rest_all, 0) + 0.5) + 0.5
        self.noise = share / share.sum()

    @property
    def place(self) -> dict[bytes, int]:
        """Words of the head and their ids."""
        return {w: i for i, w in enumerate(self.head.to_pylist())}

    def training(self) -> Vocabulary:
        """What training needs of it, without the words."""
        out = copy.copy(self)
        out.head, out.count = None, None
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Token ids of the texts one after the other, where each begins, and the words without an id and their texts."""
        flat, sizes = _words(texts)
        place = pc.fill_null(pc.index_in(flat, value_set=self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        ids = np.full(len(place) + len(sizes), self.end, np.int64)
        ids[np.arange(len(place)) + of] = place
        unknown, lost = flat.filter(pa.array(place < 0)), of[place < 0]
        if self.end < 0:  # no training text at all
            unknown, lost = pa.concat_arrays([unknown, pa.array([END] * len(sizes), pa.large_binary())]), np.append(lost, np.arange(len(sizes)))
        return ids, np.append(0, np.cumsum(sizes + 1))[:-1], unknown, lost

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        last = self.classes - 1
        return np.where((ids < 0) | (ids > last), last, ids)

    @property
    def end_class(self) -> int:
        last = self.classes - 1
        return last if self.end < 0 or self.end > last else self.end


def contexts(w: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the first and second token before each; before a text, ends."""
    a = np.append(end, w[:-1])
    a[begins] = end
    b = np.append(end, a[:-1])
    b[begins] = end
    return a, b


def start(v: Vocabulary) -> list[np.ndarray]:
    """r, q, C1, C2 and bias before training: the unigram model."""
    rng = np.random.RandomState(11)
    n = v.classes
    return [x.astype(np.float32) for x in (0.1 * rng.randn(n, WIDTH), 0.1 * rng.randn(n, WIDTH), np.eye(WIDTH), 0.5 * np.eye(WIDTH), np.log(v.noise))]


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that ``at`` names, and the sums of their rows."""
    d = rows.shape[1]
    some = np.flatnonzero(np.bincount(at, minlength=n))
    slot = np.empty(n, np.int64)
    slot[some] = np.arange(len(some)) * d
    flat = (slot[at][:, None] + np.arange(d)).ravel()
    return some, np.bincount(flat, rows.ravel(), len(some) * d).reshape(-1, d).astype(np.float32)


class Trainer:
    """Noise-contrastive steps with Adagrad; all tokens of a batch share ``NOISE`` noise tokens.

    A step changes only the rows of classes that it has met: the gradient of others is zero.
    """

    def __init__(self, params: list[np.ndarray], memory: list[np.ndarray], noise: np.ndarray, seed: int):
        self.params, self.memory = [p.copy() for p in params], [m.copy() for m in memory]
        self.cut = np.cumsum(noise)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.rng = np.random.RandomState(seed % 2**32)
        self.false = np.empty((BATCH, NOISE), np.float32)

    def step(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        r, q, c1, c2, bias = self.params
        n = len(bias)
        x = np.minimum(np.searchsorted(self.cut, self.rng.rand(NOISE)), n - 1)
        ra, rb, qw, qx = r.take(a, 0), r.take(b, 0), q.take(w, 0), q.take(x, 0)
        h = ra @ c1
        h += rb @ c2
        over = bias - self.log_noise
        true = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, qw) + over[w], -30, 30)))
        false = np.matmul(-h, qx.T, out=self.false[: len(w)])
        false -= over[x]
        np.clip(false, -30, 30, out=false)
        np.exp(false, out=false)
        false += 1
        np.divide(-1, false, out=false)
        qw *= true[:, None]
        dh = qw
        dh += false @ qx
        both = np.append(w, x)
        dq = _scatter(both, np.concatenate([true[:, None] * h, false.T @ h]), n)
        db = np.bincount(both, np.append(true, np.ones(len(w), np.float32) @ false), n).astype(np.float32)
        # the second context of a token is the first one of the token before, but where texts begin
        one, two = dh @ c1.T, dh @ c2.T
        same = a[:-1] == b[1:]
        one[:-1] += two[1:] * same[:, None]
        rest = np.append(0, np.flatnonzero(~same) + 1)
        dr = _scatter(np.append(a, b[rest]), np.concatenate([one, two[rest]]), n)
        every = slice(None)
        for p, m, (at, g) in zip(self.params, self.memory, (dr, dq, (every, ra.T @ dh), (every, rb.T @ dh), (every, db))):
            g /= np.float32(len(w))
            now = m[at] + g * g
            m[at] = now
            p[at] += np.float32(RATE) * g / np.sqrt(now)


def _encode(shared):
    """Of each text its tokens' classes, its sums over known words, and the words outside the head."""

    def run(batches):
        v = shared.value
        base = np.log10((v.count + 0.5) / (v.n_all + 0.5 * (v.n_distinct + 1)))
        rest = np.log10((v.count + 0.5) / (v.rest_all + 0.5 * (v.rest_distinct + 1)))
        for batch in batches:
            for part in _slices(batch):
                ids, begins, unknown, lost = v.ids(part.column("text"))
                w = v.classes_of(ids)
                known = ids >= 0
                inside = np.where((w == v.classes - 1) & known, rest[ids], 0.0)
                sums = [np.add.reduceat(x, begins) for x in (np.where(known, base[ids], 0.0), inside, known.astype(np.int64))]
                each = unknown.dictionary_encode()
                kinds = max(1, len(each.dictionary))
                tail, times = np.unique(lost * kinds + each.indices.to_numpy(), return_counts=True)
                cuts = pa.array(np.searchsorted(tail, np.arange(part.num_rows + 1) * kinds), pa.int32())
                bounds = np.append(begins, len(ids))
                w = w.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("row", "doc_id", "k", "learn")), pa.array(np.diff(bounds)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]),
                        pa.array([w[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:])], pa.binary()),
                        pa.ListArray.from_arrays(cuts, each.dictionary.take(pa.array(tail % kinds)).cast(pa.binary())), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64))),
                    ],
                    ["row", "doc_id", "k", "learn", "n_tokens", "n_known", "base_score", "inside", "classes", "tail", "times"],
                )

    return run


def encoded(docs: DataFrame, learn: Column) -> tuple[DataFrame, Vocabulary, DataFrame, int]:
    """Rows of all texts as classes, the vocabulary, the stored counts, and the least count of its head."""
    counts = token_counts(docs.filter(learn).select("text"))
    n_all, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    bound = head_bound(counts.filter("c > 0"))
    v = Vocabulary([(bytes(r[0]), r[1]) for r in counts.filter(F.col("c") >= max(bound, 1)).collect()], n_all, n_distinct)
    shared = docs.sparkSession.sparkContext.broadcast(v)
    schema = "row long, doc_id long, k long, learn boolean, n_tokens long, n_known long, base_score double, inside double, classes binary, tail array<binary>, times array<long>"
    named = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("k"), F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    return stored(named.mapInArrow(handing_back(_encode(shared)), schema)), v, counts, bound


def _pack(batches):
    """Consecutive rows of one shard as one row: ``shard, classes, sizes``."""
    held: list[tuple[bytes, int]] = []
    now = None

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int64()), pa.array([b"".join(c for c, _ in held)], pa.binary()), pa.array([np.array([n for _, n in held], np.int64).tobytes()], pa.binary())], ["shard", "classes", "sizes"]
        )

    for batch in batches:
        for shard, classes, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "classes", "n_tokens"))):
            if held and shard != now:
                yield out()
                held = []
            now = shard
            held.append((classes, n))
    if held:
        yield out()


def _round(shared, turn: int):
    """The sum over a task's shards of parameters times tokens, in units."""

    def run(batches):
        v, params, memory = shared.value
        total, weight = None, 0
        for batch in batches:
            for shard, classes, sizes in zip(*(batch.column(c) for c in ("shard", "classes", "sizes"))):
                w = np.frombuffer(classes.as_py(), np.uint16).astype(np.int64)
                begins = np.append(0, np.cumsum(np.frombuffer(sizes.as_py(), np.int64)))[:-1]
                a, b = contexts(w, begins, v.end_class)
                t = Trainer(params, memory, v.noise, 7919 * shard.as_py() + turn)
                for lo in range(0, len(w), BATCH):
                    t.step(w[lo : lo + BATCH], a[lo : lo + BATCH], b[lo : lo + BATCH])
                n = max(1, len(w) >> 10)
                flat = np.rint(np.concatenate([x.ravel() for x in t.params + t.memory]).astype(np.float64) * UNIT).astype(np.int64) * n
                total, weight = flat if total is None else total + flat, weight + n
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight], pa.int64())], ["sums", "weight"])

    return run


def _add(batches):
    flat, weight = None, 0
    for batch in batches:
        for s, n in zip(batch.column("sums"), batch.column("weight").to_pylist()):
            x = np.frombuffer(s.as_py(), np.int64)
            flat, weight = x if flat is None else flat + x, weight + n
    if flat is not None:
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([weight], pa.int64())], ["sums", "weight"])


def train(rows: DataFrame, v: Vocabulary) -> list[np.ndarray]:
    """Parameters after all rounds over the training rows; without any those of the unigram model.

    A round's sums are added by trees of 32 to a node, so that no task and not the driver reads
    more than 32 times the parameters.
    """
    params = start(v)
    memory = [np.full_like(p, 1e-2) for p in params]
    tokens = rows.filter("learn").agg(F.sum("n_tokens")).first()[0] or 0
    if not tokens:
        return params
    shards = -(-tokens // SHARD_TOKENS)
    rounds = min(MOST_ROUNDS, max(LEAST_ROUNDS, -(-SEEN_TOKENS * shards // tokens)))
    dealt = rows.filter("learn").select(F.pmod(F.xxhash64("k"), F.lit(shards)).alias("shard"), "k", "classes", "n_tokens")
    parts = int(min(shards, 20_000))
    context, schema = rows.sparkSession.sparkContext, "sums binary, weight long"
    with scratch(rows.sparkSession):
        packed = stored(dealt.repartition(parts, "shard").sortWithinPartitions("shard", "k", "n_tokens").mapInArrow(handing_back(_pack), "shard long, classes binary, sizes binary"))
        for turn in range(rounds):
            shared = context.broadcast((v.training(), params, memory))
            sums, n = packed.mapInArrow(handing_back(_round(shared, turn)), schema), parts
            while n > 1:
                n = -(-n // 32)
                sums = sums.repartition(n).mapInArrow(_add, schema)
            flat, weight = np.zeros(0), 0
            for s, k in sums.collect():
                flat, weight = np.frombuffer(s, np.int64) + (flat if weight else 0), weight + k
            cuts = np.cumsum([p.size for p in params + memory])[:-1]
            mean = [x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat / weight / UNIT, cuts), params + memory)]
            params, memory = mean[: len(params)], [np.maximum(m, np.float32(1e-3)) for m in mean[len(params) :]]
            shared.destroy()
    return params


def log_tables(params: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``T1 + bias``, ``T2`` and ``log Z`` over all classes; natural logarithms."""
    r, q, c1, c2, bias = (p.astype(np.float32) for p in params)
    one, two = r @ c1 @ q.T + bias, r @ c2 @ q.T
    top, top2 = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
    z = np.log(np.exp(one - top) @ np.exp(two - top2).T) + top + top2.T
    return one, two, z


# --- scores -----------------------------------------------------------------------------------

_TABLES: dict = {}  # of the model that this worker used last


def _score(shared):
    def run(batches):
        end, key, params = shared.value
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = log_tables(params)
        one, two, z = _TABLES[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                w = np.frombuffer(b"".join(part.column("classes").to_pylist()), np.uint16).astype(np.int64)
                begins = np.append(0, np.cumsum(part.column("n_tokens").to_numpy()))[:-1]
                a, b = contexts(w, begins, end)
                logp = (one[a, w] + two[b, w] - z[a, b]).astype(np.float64) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "n_tokens", "n_known", "base_score", "inside")), pa.array(np.add.reduceat(logp, begins))], ["row", "doc_id", "n_tokens", "n_known", "base_score", "inside", "model"])

    return run


def scores(rows: DataFrame, v: Vocabulary, params: list[np.ndarray], counts: DataFrame, bound: int) -> DataFrame:
    """The scores of encoded rows; words outside the head are joined to their counts."""
    shared = rows.sparkSession.sparkContext.broadcast((v.end_class, uuid.uuid4().hex, params))
    schema = "row long, doc_id long, n_tokens long, n_known long, base_score double, inside double, model double"
    first = rows.select("row", "doc_id", "n_tokens", "n_known", "base_score", "inside", "classes").mapInArrow(handing_back(_score(shared)), schema)
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("m"))
    tail = tail.join(counts.filter((F.col("c") > 0) & (F.col("c") < bound)), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = lambda n, d: F.col("m") * F.log10((F.col("c") + 0.5) / F.lit(float(n + 0.5 * (d + 1))))
    more = tail.groupBy("row").agg(
        F.sum(log(v.n_all, v.n_distinct)).alias("t_base"), F.sum(log(v.rest_all, v.rest_distinct)).alias("t_score"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("t_known")
    )
    out = first.join(more, "row", "left").fillna(0, ["t_base", "t_score", "t_known"])
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("t_known")).alias("n_known"), F.lit(v.n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("t_base")).alias("base_score"), (F.col("inside") + F.col("model") + F.col("t_score")).alias("score"),
    )


def scored(docs: DataFrame, learn: Column) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    The rows that ``learn`` holds for are the training texts. A null text is empty: its one token
    is the end. Rows that repeat are counted, and scored, each. Without training texts all counts
    are 0 and the model is uniform. Columns besides ``doc_id`` and ``text`` are ignored. An empty
    table gives an empty result. Results don't depend on how ``docs`` is partitioned.
    """
    with scratch(docs.sparkSession) as s:
        rows, v, counts, bound = encoded(docs, learn)
        params = train(rows, v)
        s.keep(rows, counts)
    return scores(rows, v, params, counts, bound)
