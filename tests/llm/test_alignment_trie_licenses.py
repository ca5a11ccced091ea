"""Cross-tokenizer alignment, the prefix trie of conversations and licence scans."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import license_scan, prefix_trie, queries, token_align
from tessera.llm.token_align import Pair

# --- alignment --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return Pair(token_align.folder())


def tokens(pair, text):
    """Ids and end offsets of both tokenizers, or nothing."""
    if not text:
        return [], [], [], []
    whole = b" " + text.encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.bytes_a[x] for x in a) != whole or b"".join(pair.bytes_b[x] for x in b) != whole:
        return [], [], [], []
    ends = lambda ids, known: np.cumsum([len(known[x]) for x in ids]).tolist()
    return a, b, ends(a, pair.bytes_a), ends(b, pair.bytes_b)


def plain(pair, texts):
    """The query's columns but the id, by plain loops."""
    each, count = [], Counter()
    for text in texts:
        a, b, ea, eb = tokens(pair, text)
        at_b = {e: y for e, y in zip(eb, b)}
        links = [(x, at_b[e]) for e, x in zip(ea, a) if e in at_b]
        count.update(links)
        groups, ga, gb, ends, k = [], [], [], set(ea) & set(eb), 0
        for e, x in zip(ea, a):
            ga.append(x)
            if e in ends:
                while eb[k] < e:
                    gb.append(b[k])
                    k += 1
                groups.append((ga, gb + [b[k]]))
                ga, gb, k = [], [], k + 1
        each.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for n_a, n_b, groups, links in each:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if n_a else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query_equals_plain(spark, sf, pair):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_token_alignment"](spark, sf).collect()}
    assert got == dict(zip(docs, plain(pair, docs.values()))) and sum(v[0] > 0 for v in got.values()) > 150


def test_alignment_of_odd_texts(spark, pair):
    texts = [None, "", " ", "a", "a", "<|endoftext|> </s><s> <unk>", "▁x", "naïve 日本語 \U0001f600\u0000 <0x41>", "x" * 3000, "  two  spaces\n\n\ttab", "é é", "word " * 4000]
    rows = [(n if n != 4 else 3, t, "clash", 1) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, row int")
    want = sorted(zip([r[0] for r in rows], plain(pair, texts)))
    for known in (token_align.KNOWN_PAIRS, 0):
        got = sorted((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in token_align.aligned(docs, known_pairs=known).collect())
        assert got == want
    assert want[0][1][:6] == (0,) * 6 and want[0][1][6] == "" and want[5][1][0] > 0
    assert token_align.aligned(docs.limit(0)).count() == 0


def test_all_kinds_of_links(spark, pair):
    texts = ["Größe naïve unbelievable tokens", "日本語 text \U0001f600!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    overlap = {(r.doc_id, r.token_a, r.token_b, r.shared_bytes) for r in token_align.links(docs).collect()}
    group = {(r.doc_id, r.token_a, r.token_b) for r in token_align.links(docs, "group").collect()}
    want, together = set(), set()
    for d, text in enumerate(texts):
        a, b, ea, eb = tokens(pair, text)
        cuts = sorted(set(ea) & set(eb))
        of = lambda start: sum(c <= start for c in cuts)
        for i, (s, e) in enumerate(zip([0, *ea], ea)):
            for j, (t, f) in enumerate(zip([0, *eb], eb)):
                if min(e, f) > max(s, t):
                    want.add((d, i, j, min(e, f) - max(s, t)))
                if of(s) == of(t):
                    together.add((d, i, j))
    assert overlap == want and group == together and len(group) > len(overlap) - 5


def test_row_products_equal_dense():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.random((7, 9)) < 0.3, rng.random((9, 6)) < 0.3
        rows = lambda m: token_align.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
        for entries in (1, 5, 1000):
            dense = np.zeros((7, 6), int)
            for i, j, n in token_align.product(rows(x), rows(y), entries):
                dense[i, j] += n
            assert (dense == x.astype(int) @ y).all()
        assert (rows(x).transposed(9).columns == rows(x.T).columns).all()
    a, b = np.array([2, 1, 3, 1, 1]), np.array([1, 2, 1, 2, 2])
    whole = sorted(t for part in token_align.overlaps(a, b) for t in zip(*(x.tolist() for x in part)))
    assert whole == sorted(t for part in token_align.overlaps(a, b, run=1) for t in zip(*(x.tolist() for x in part)))


# --- prefix trie ------------------------------------------------------------------------------


def trie_by_dictionaries(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    members = {}
    ends = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = {}
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: [y for y in members if len(y) == len(x) + 1 and y[:-1] == x]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        row = (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids(node)), sum(not kids(x) for x in below), saved, sha)
        out[row] = out.get(row, 0) + 1
    return Counter(out)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("shard", [1, 7, prefix_trie.SHARD])
def test_trie_equals_dictionaries(spark, shard):
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(0, 40), 1000, 1001, 5003, 70_000_000_003]:
        for turn in range(int(rng.integers(1, 12))):
            rows.append((c, turn if turn != 3 else None, ("user", "assistant", None)[int(rng.integers(0, 3))], ("é", "ab", "", None)[int(rng.integers(0, 4))]))
    rows += [(41, 0, "user", "ab"), (41, 0, "user", "ab"), (None, 0, "user", "no id"), (45, 1, "a", "b" * 50_000)] + [(c, 0, "user", "same") for c in range(100, 140)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("role", "role")
    got = Counter(tuple(r[c] for c in NODE) for r in prefix_trie.conversation_trie(df.selectExpr("*", "1 AS key", "'x' AS sequence"), shard).collect())
    assert got == trie_by_dictionaries(rows)


def test_trie_of_empty_and_turnless(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(empty).count() == 0
    alone = [(c, 0, "user", "x") for c in (11, 12, 13, 14)]  # their first turns go, and conversation 10 is absent
    got = Counter(tuple(r[c] for c in NODE) for r in prefix_trie.conversation_trie(spark.createDataFrame(alone, empty.schema)).collect())
    assert got == trie_by_dictionaries(alone) and any(r[1] == 0 and r[3] == 4 for r in got)


def test_parentheses_by_stack():
    rng = np.random.default_rng(5)
    for n in (1, 2, 33, 500, 3000):
        depth = [0]
        while len(depth) < n:
            depth.append(int(rng.integers(1, depth[-1] + 2)) if rng.random() < 0.6 else depth[-1] + 1)
        tree = prefix_trie.Parentheses(np.array(depth))
        close = tree.findclose(tree.open)
        size = [next((k for k in range(i + 1, n) if depth[k] <= depth[i]), n) - i for i in range(n)]
        assert ((close - tree.open + 1) // 2 == size).all()
        leaves = [sum(k + 1 == n or depth[k + 1] <= depth[k] for k in range(i, i + size[i])) for i in range(n)]
        assert (tree.leaf_pairs(close) - tree.leaf_pairs(tree.open) == leaves).all()


# --- licences ---------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_by_loops(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        found = [n for n in range(len(words)) if words[n : n + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_query_equals_loops(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_license_scan"](spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {d: base_by_loops(t) for d, t in docs.items()}
    assert len(rows) == len(docs) and any(r.n_base for r in rows)
    for r in rows:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licenses_of_odd_texts(spark):
    texts = [None, "", "...", "MIT-License\nmit\x00LICENSE mit license", "ÀMIT License", "CC BY-SA, cc by", "GNU General Public License", "Apache License " * 5000, "mit mit license license", "The MIT License\r\nSPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"]
    docs = spark.createDataFrame([(n, t, "x", 2) for n, t in enumerate([*texts, texts[3]])], "doc_id long, text string, labels string, score int")
    rows = {r.doc_id: r for r in license_scan.licensed(docs).collect()}
    for n, t in enumerate([*texts, texts[3]]):
        r = rows[n]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_loops(t)
    assert (rows[0].labels, rows[0].score) == ("", 0.0) and rows[5].labels == "cc-by,cc-by-sa" and rows[9].labels == "gpl,mit" and rows[9].score == pytest.approx(0.7)
    assert license_scan.licensed(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, post, labels, score",
    [
        ("mit", "mit", {"mit"}, 1.0),
        ("mit or gpl-2.0-only and cc-by-nc-4.0", "mit gpl-2.0-only cc-by-nc-4.0 and or", {"mit", "gpl", "cc-by-nc"}, 1.0),
        ("(mit or gpl-3.0+) and cc-by-nc-4.0 */", "mit gpl-3.0+ or cc-by-nc-4.0 and", {"mit", "gpl", "cc-by-nc"}, 0.2),
        ("gpl-2.0 with classpath-exception-2.0 and mit", "gpl-2.0 classpath-exception-2.0 with mit and", {"gpl", "mit"}, 0.7),
        ("mit and", "mit", {"mit"}, 1.0),
        ("((agpl-3.0", "agpl-3.0", {"agpl"}, 0.3),
        ("mit) or gpl", "mit", {"mit"}, 1.0),
        ("foo-1.0 bar", "foo-1.0", {"foo-1.0"}, 0.1),
        ("and mit", "", None, None),
        ("", "", None, None),
    ],
)
def test_expressions(text, post, labels, score):
    assert " ".join(license_scan.postfix(text)) == post
    found = license_scan.evaluated(text)
    assert found is None if labels is None else (found[0] == labels and found[1] == pytest.approx(score))
