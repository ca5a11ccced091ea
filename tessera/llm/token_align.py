"""Alignment of the tokens of two tokenizers over the bytes of each text.

Either tokenizer's tokens and the bytes they hold are a sparse incidence matrix, in compressed rows
(CSR) built from the tokens' lengths; the texts of a batch are blocks of one matrix. A row product
of A by the transpose of B, by Gustavson's rule, sums for each token of A the rows of the bytes it
holds: its entries are the pairs that overlap and by how many bytes. Offsets where tokens of both
end cut a text into groups; the product of the tokens' group incidences has the pairs that share
one. No pair of the products crosses a group, so that long texts are cut at group ends.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import handing_back, hot_keys, salted_join, scratch, stored

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
RUN = 1 << 20  # bytes of the blocks that are multiplied at once, but for a longer group
TEXTS = 1 << 21  # characters that are encoded at once, but for a longer text
ENTRIES = 1 << 20  # entries of a product that are handed on at once
KNOWN_PAIRS = 1 << 20  # pairs of ids, at 16 bytes, up to which their counts are broadcast


def folder() -> str:
    """Where the vocabularies are: an installed package of every machine."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(A_FILE))


# --- sparse matrices --------------------------------------------------------------------------


class Rows:
    """A sparse matrix of ones in compressed rows: ``ends[i]`` entries precede row ``i + 1``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray):
        self.starts, self.columns = starts, columns

    @staticmethod
    def of_lengths(lengths: np.ndarray) -> Rows:
        """Tokens by bytes: token ``i`` holds the next ``lengths[i]`` bytes."""
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return Rows(starts, np.arange(starts[-1]))

    def transposed(self, width: int) -> Rows:
        """The transpose, of ``width`` rows, by counting the entries of each column."""
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        return Rows(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=width))]), row[order])


def product(a: Rows, b: Rows, entries: int = ENTRIES):
    """Entries ``(row, column, value)`` of ``a`` times ``b``, by rows, in parts of about ``entries``.

    Gustavson's rule: row ``i`` of the product is the sum of the rows of ``b`` that the columns of
    row ``i`` of ``a`` name. Equal columns of a row are added up. A part ends with a row.
    """
    size = np.diff(b.starts)[a.columns]
    upto = np.concatenate([[0], np.cumsum(size)])[a.starts]  # terms before each row
    row, n = 0, len(a.starts) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(upto, upto[row] + entries, "right")) - 1)
        span = slice(a.starts[row], a.starts[end])
        each = size[span]
        terms = int(each.sum())
        at = np.arange(terms) - np.repeat(np.cumsum(each) - each, each) + np.repeat(b.starts[:-1][a.columns[span]], each)
        i = np.repeat(np.repeat(np.arange(row, end), np.diff(a.starts[row : end + 1])), each)
        j = b.columns[at]
        if np.any((i[1:] == i[:-1]) & (j[1:] < j[:-1])):
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])[:terms])
        yield i[first], j[first], np.diff(np.append(first, terms))
        row = end


# --- one run of texts -------------------------------------------------------------------------


def overlaps(a: np.ndarray, b: np.ndarray, run: int = RUN):
    """Links ``(token of A, token of B, shared bytes)`` of tokens of the given byte lengths."""
    for (a0, a1), (b0, b1) in _runs(a, b, run):
        left, right = Rows.of_lengths(a[a0:a1]), Rows.of_lengths(b[b0:b1])
        for i, j, n in product(left, right.transposed(int(left.starts[-1]))):
            yield i + a0, j + b0, n


def group_of(lengths: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The group of each token; ``cuts`` are the offsets where both tokenizers' tokens end."""
    return np.searchsorted(cuts, np.cumsum(lengths) - lengths, "right")


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.intersect1d(np.cumsum(a), np.cumsum(b), assume_unique=True)


def shared_groups(a: np.ndarray, b: np.ndarray, entries: int = ENTRIES):
    """Links ``(token of A, token of B)`` of one group, in parts: group incidence times transpose."""
    cuts = common_ends(a, b)
    incidence = lambda x: Rows(np.arange(len(x) + 1), group_of(x, cuts))
    for i, j, _ in product(incidence(a), incidence(b).transposed(len(cuts)), entries):
        yield i, j


def _runs(a: np.ndarray, b: np.ndarray, run: int):
    """Ranges of tokens of A and B that hold the same bytes, of about ``run`` bytes, between groups."""
    cuts, ends_a, ends_b = common_ends(a, b), np.cumsum(a), np.cumsum(b)
    at = a0 = b0 = 0
    while at < (cuts[-1] if len(cuts) else 0):
        n = np.searchsorted(cuts, at + run, "right") - 1
        at = cuts[n] if n >= 0 and cuts[n] > at else cuts[np.searchsorted(cuts, at, "right")]
        a1, b1 = np.searchsorted(ends_a, at, "right"), np.searchsorted(ends_b, at, "right")
        yield (a0, a1), (b0, b1)
        a0, b0 = a1, b1


class Pair:
    """Two tokenizers, and the bytes of each of their ids."""

    def __init__(self, path: str, a: str = A_FILE, b: str = B_FILE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(path, a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(path, b))
        # byte-level alphabet: printable characters stand for themselves, the others follow from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(c): c for c in plain} | {chr(256 + n): c for n, c in enumerate(sorted(set(range(256)) - set(plain)))}
        self.bytes_a = [bytes(shown[c] for c in self.a.id_to_token(n)) for n in range(self.a.get_vocab_size())]
        self.bytes_b = [bytes([int(self.b.id_to_piece(n)[1:-1], 16)]) if self.b.is_byte(n) else self.b.id_to_piece(n).replace("▁", " ").encode() for n in range(self.b.get_piece_size())]
        self.ranked = _ranked(os.path.join(path, a), self.bytes_a)
        # ids as they are shown: within a group, and at the end of its tokens of A or B
        self.shown = [f"{n}{c}" for n in range(len(self.bytes_a)) for c in ",|"] + [f"{n}{c}" for n in range(len(self.bytes_b)) for c in ",;"]
        self.size_a, self.size_b = (np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b))

    def encode(self, raw: list[bytes | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B of each text in UTF-8; none where a text is empty or doesn't come back."""
        texts = [(t or b"").decode("utf-8", "replace") for t in raw]
        some = [n for n, t in enumerate(texts) if t]
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(raw)
        if self.ranked:
            a = [self.ranked.encode_ordinary(" " + texts[n]) for n in some]
        else:
            a = [x.ids for x in self.a.encode_batch([" " + texts[n] for n in some], add_special_tokens=False)]
        for n, x, y in zip(some, a, self.b.encode([texts[n] for n in some], num_threads=1)):
            whole = b" " + raw[n]
            if b"".join(map(self.bytes_a.__getitem__, x)) == whole and b"".join(map(self.bytes_b.__getitem__, y)) == whole:
                out[n] = x, y
        return out


def _ranked(file: str, known: list[bytes]):
    """The tokenizer of a file as ranks of byte strings, which run about three times as fast.

    That is the same where the file splits by the byte-level pattern and each merge makes the next
    id; None where it doesn't.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(file) as f:
        whole = json.load(f)
    model, split = whole["model"], whole["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    n = len(known) - len(whole["added_tokens"]) - len(merges)
    in_order = n == 256 and all(model["vocab"].get(x + y) == n + i for i, (x, y) in enumerate(merges))
    if whole["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not in_order:
        return None
    ranks = {b: i for i, b in enumerate(known[: n + len(merges)])}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _shown(pair: Pair, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: int) -> str:
    """The ids of each of ``n`` groups, ``a1,a2|b1;a3|b2,b3``."""
    last = lambda of: np.append(of[1:] != of[:-1], True)
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.searchsorted(of_b, np.arange(n))[of_a]] = 2 * a + last(of_a)
    code[np.arange(len(b)) + np.searchsorted(of_a, np.arange(n), "right")[of_b]] = 2 * (len(pair.bytes_a) + b) + last(of_b)
    return "".join(map(pair.shown.__getitem__, code.tolist()))[:-1]


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _aligned(path: str, files: tuple[str, str]):
    def run(batches):
        from pyspark import TaskContext

        pair, row = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            doc, raw = batch.column("doc_id").to_pylist(), batch.column("raw")
            size = np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in raw]) // TEXTS
            for at in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(size)) + 1):
                pair = pair or Pair(path, *files)
                out = []
                for n, (a, b) in zip(at.tolist(), pair.encode([raw[i].as_py() for i in at.tolist()])):
                    out.append((row, doc[n], *_of_text(pair, a, b)))
                    row += 1
                if out:
                    kinds = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in _ALIGNED.split(", ")])

    return run


def _of_text(pair: Pair, a: list[int], b: list[int]) -> tuple:
    if not a:
        return 0, 0, 0, 0, "", [], []
    ia, ib = np.array(a), np.array(b)
    size_a, size_b = pair.size_a[ia], pair.size_b[ib]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    linked = []
    for i, j, _ in overlaps(size_a, size_b):
        together = end_a[i] == end_b[j]
        linked.append((ia[i[together]].astype(np.int64) << 32) | ib[j[together]])
    pairs, times = np.unique(np.concatenate(linked), return_counts=True)
    cuts = common_ends(size_a, size_b)
    shown = _shown(pair, ia, ib, group_of(size_a, cuts), group_of(size_b, cuts), len(cuts))
    return len(a), len(b), len(cuts), int(times.sum()), hashlib.sha256(shown.encode()).hexdigest(), pairs, times


# --- Spark ------------------------------------------------------------------------------------


def links(docs: DataFrame, kind: str = "overlap", path: str | None = None, files: tuple[str, str] = (A_FILE, B_FILE)) -> DataFrame:
    """``doc_id, token_a, token_b, id_a, id_b, shared_bytes``: all linked tokens of ``docs(doc_id, text)``.

    Tokens are numbered within their text. Kinds: ``overlap``, and ``group``, of tokens of one group
    (shared bytes null): those of long groups come in parts, so that no task holds them all.
    """
    path = path or folder()
    schema = "doc_id long, token_a long, token_b long, id_a long, id_b long, shared_bytes long"

    def linked(a: np.ndarray, b: np.ndarray):
        if kind == "overlap":
            yield from overlaps(a, b)
        else:
            for i, j in shared_groups(a, b):
                yield i, j, pa.nulls(len(i), pa.int64())

    def run(batches):
        pair = None
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw")):
                pair = pair or Pair(path, *files)
                a, b = (np.array(x, np.int64) for x in pair.encode([raw.as_py()])[0])
                for i, j, n in linked(pair.size_a[a], pair.size_b[b]):
                    columns = ([doc] * len(i), i, j, a[i], b[j], n)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: links of each pair of ids, and whether its B id has no more frequent one."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l")).groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("count"))
    return counts.withColumn("id_b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))


def aligned(docs: DataFrame, path: str | None = None, files: tuple[str, str] = (A_FILE, B_FILE), known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: a row per row of ``docs``.

    Links are the pairs of tokens that overlap and end together. Texts that are null, empty, or
    whose tokens' bytes are not those of the text with a space before it, have no tokens: zeros and
    an empty digest. Rows that repeat count each for itself; other columns don't matter. A text is
    read whole, and its links are stored by pairs of ids. Counts of up to ``known_pairs`` pairs are
    broadcast; more, of which the vocabularies' sizes are the bound, are joined by a shuffle in
    which common pairs are dealt over tasks.
    """
    path = path or folder()
    with scratch(docs.sparkSession) as s:
        raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw"))
        rows = stored(raw.mapInArrow(handing_back(_aligned(path, files)), _ALIGNED))
        counts = stored(pair_counts(rows))
        most = counts.groupBy("id_b").agg(F.max("count").alias("most"))
        counts = stored(counts.join(most, "id_b").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best")))
        linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
        if counts.count() <= known_pairs:
            linked = linked.join(F.broadcast(counts), "pair")
        else:
            linked = stored(linked)
            linked = salted_join(linked, counts, "pair", hot_keys(linked, "pair"), by="row")
        sums = stored(linked.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")))
        s.keep(rows, sums)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
