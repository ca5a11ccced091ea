"""Prefix trie of conversations: what a cache of shared beginnings would save.

Sequences of turns are sorted and cut into shards, each a range of the order. A shard's trie is a
string of balanced parentheses in preorder, ``(`` for each node at its first sight and ``)`` at its
end. Blocks of the running excess with a tree of their minima answer ``findclose``, which delimits
a subtree; the rank of ``()`` pairs counts its leaves, and cumulative arrays in preorder give its
members and savings. Nodes on a path that a shard shares with its neighbours, its spines, are
partial: their numbers add up over shards. A node belongs to the first shard that holds it, which
alone counts it as a child and subtracts its text once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import hot_keys, salted_join, scratch, stored

SHARED, GROUP = 9, 5  # conversation c begins with crc32(c) % SHARED turns of conversation c - c % GROUP
SHARD = 1 << 17  # turns of a shard, but for a longer sequence
IDS = 12  # bits of conversation ids that are joined to one text before the digest
WIDTH = 16  # bytes of a turn's digest
BLOCK = 64  # parentheses of a block
_NO_ENDS = hashlib.sha256(b"").digest()


# --- balanced parentheses ---------------------------------------------------------------------


class Parentheses:
    """The tree of the depths of its nodes in preorder, root first, as balanced parentheses."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.open = 2 * np.arange(n) - depth
        step = np.full(2 * n, -1, np.int64)
        step[self.open] = 1
        self.pairs = np.concatenate([[0], np.cumsum((step[:-1] == 1) & (step[1:] == -1)), [0]])
        self.pairs[-1] = self.pairs[-2]
        big = np.int64(1) << 40
        self.excess = np.concatenate([np.cumsum(step), np.full(-2 * n % BLOCK, big)])
        self.least = [self.excess.reshape(-1, BLOCK).min(axis=1)]
        while len(self.least[-1]) > 1:
            if len(self.least[-1]) % 2:
                self.least[-1] = np.append(self.least[-1], big)
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))

    def _first(self, at: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first place of ``at``'s block, from it on, where the excess is as wanted; else -1."""
        found, end = np.full(len(at), -1), (at // BLOCK + 1) * BLOCK
        live = np.arange(len(at))
        at = at.copy()
        while len(live):
            hit = self.excess[at[live]] == want[live]
            found[live[hit]] = at[live[hit]]
            at[live] += 1
            live = live[~hit]
            live = live[at[live] < end[live]]
        return found

    def findclose(self, opened: np.ndarray) -> np.ndarray:
        """For each place of a ``(`` that of its ``)``: where the excess first falls below it."""
        want = self.excess[opened] - 1
        found = self._first(opened, want)
        far = np.flatnonzero(found < 0)
        node, level = opened[far] // BLOCK, np.full(len(far), -1)
        for n, least in enumerate(self.least[:-1]):
            up = np.flatnonzero(level < 0)
            right = up[node[up] % 2 == 0]
            right = right[least[node[right] + 1] <= want[far[right]]]
            node[right] += 1
            level[right] = n
            rest = level < 0
            node[rest] //= 2
        for n in range(len(self.least) - 2, 0, -1):
            down = np.flatnonzero(level == n)
            left = self.least[n - 1][2 * node[down]] <= want[far[down]]
            node[down] = 2 * node[down] + ~left
            level[down] = n - 1
        found[far] = self._first(node * BLOCK, want[far])
        return found

    def leaf_pairs(self, upto: np.ndarray) -> np.ndarray:
        """Rank: how many ``()`` begin before each place."""
        return self.pairs[upto]


def common_prefix(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(s, f"V{WIDTH}", n) for s in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def shard_nodes(sequences: list[bytes], sizes: list[np.ndarray], members: np.ndarray, conv: np.ndarray, ends: list[bytes], before: bytes | None = None, after: bytes | None = None) -> dict:
    """Nodes of the trie of one shard, in preorder.

    ``sequences`` are distinct and sorted, each with the ``sizes`` of its turns' texts, the number
    and the smallest id of its conversations and the digest of their ids. ``before`` and ``after``
    are the sequences next to the shard, if there are any. Nodes shared with them have a ``key``.
    """
    length = np.array([len(s) // WIDTH for s in sequences], np.int64)
    lcp = np.array([0] + [common_prefix(a, b) for a, b in zip(sequences, sequences[1:])], np.int64)
    fresh_nodes = length - lcp
    n = 1 + int(fresh_nodes.sum())
    start = 1 + np.cumsum(fresh_nodes) - fresh_nodes
    depth, size, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    path = [0]
    for i, (s, c, d) in enumerate(zip(start.tolist(), fresh_nodes.tolist(), lcp.tolist())):
        depth[s : s + c] = np.arange(d + 1, d + c + 1)
        size[s : s + c] = sizes[i][d:]
        parent[s : s + c] = np.arange(s - 1, s + c - 1)
        if c:
            parent[s] = path[d]
        path[d + 1 :] = range(s, s + c)
    end = np.where(length == 0, 0, start + fresh_nodes - 1)
    left = -1 if before is None else common_prefix(before, sequences[0])
    right = -1 if after is None else common_prefix(sequences[-1], after)
    new = np.ones(n, bool)
    new[: left + 1] = False  # the first sequence's nodes come first, by depth

    tree = Parentheses(depth)
    close = tree.findclose(tree.open)
    upto = np.arange(n) + (close - tree.open + 1) // 2
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    ending = np.zeros(n, np.int64)
    ending[end] = members
    ended = total(ending)
    n_convs = ended[upto] - ended[:n]
    n_leaves = tree.leaf_pairs(close) - tree.leaf_pairs(tree.open)
    if right == length[-1]:  # the last leaf goes on in the next shard
        n_leaves = n_leaves - (upto == n)
    saved = total(size * (n_convs - new))
    saved = saved[upto] - saved[:n]
    n_children = np.bincount(parent[1:], weights=new[1:], minlength=n).astype(np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    least[end] = conv
    by_depth = np.argsort(-depth, kind="stable")
    at = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, at)[: int(depth.max())]:
        np.minimum.at(least, parent[level], least[level])

    digest: list[bytes | None] = [None] * n
    for e, d in zip(end.tolist(), ends):
        digest[e] = d
    key: list[bytes | None] = [None] * n
    for sequence, nodes in ((sequences[0], range(left + 1)), (sequences[-1], path[: right + 1])):
        h = hashlib.sha256()
        for d, node in enumerate(nodes):
            if d:
                h.update(sequence[(d - 1) * WIDTH : d * WIDTH])
            key[node] = h.copy().digest()
    parent_key = [None if p < 0 else key[p] for p in parent.tolist()]
    parent_conv = pa.array(np.where(parent < 0, 0, least[parent]), mask=parent < 0)
    return {
        "conv_id": least, "depth": depth, "parent_conv_id": parent_conv, "n_convs": n_convs, "n_children": n_children, "n_leaves": n_leaves, "saved_tokens": saved,
        "ends": pa.array(digest, pa.binary()), "key": pa.array(key, pa.binary()), "parent_key": pa.array(parent_key, pa.binary()),
    }


# --- Spark ------------------------------------------------------------------------------------


def rebuilt(conversations: DataFrame, shared: int = SHARED, group: int = GROUP) -> DataFrame:
    """``conv_id, sequence, sizes``: each conversation's turns as digests in a row, with text sizes.

    ``conversations(conv_id, turn, role, text)``; other columns don't count. A conversation begins
    with the first ``h = crc32(conv_id) % shared`` turns of that whose id is a multiple of
    ``group``, and goes on with its own after its first ``h``. Turns are ordered by turn (null
    first), role and text; null roles and texts are empty, rows without conversation take no part.
    Only digests (16 bytes) and sizes are gathered, those of one conversation in one row.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text")).filter(F.col("conv_id").isNotNull())
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turn = F.struct(F.row_number().over(w).alias("pos"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"), F.octet_length("text").alias("size"))
    own = t.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    heads = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    turns = both.select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))).alias("turns"))
    sequence = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    return turns.select("conv_id", sequence.alias("sequence"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


_SEQUENCE = "sequence binary, sizes array<int>, n long, conv_id long, ends binary"


def _distinct(batches):
    """Rows sorted by sequence and block of ids to one row a sequence, digesting the ids as they come."""
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary())
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _SEQUENCE.split(", ")])
    made, now = [], None
    for batch in batches:
        for seq, sizes, ids, c, first in zip(*(batch.column(x) for x in ("sequence", "sizes", "ids", "n", "first"))):
            seq = seq.as_py()
            if seq != now:
                if now is not None:
                    made.append((now, size, n, conv, h.digest()))
                now, size, n, conv, h = seq, sizes.as_py(), 0, first.as_py(), hashlib.sha256()
            h.update(("," * (n > 0) + ids.as_py()).encode())
            n += c.as_py()
        if made:
            yield packed(made)
        made = []
    if now is not None:
        yield packed([(now, size, n, conv, h.digest())])


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """``sequence, sizes, n, conv_id, ends``: each distinct sequence of turns once.

    ``n`` conversations have it, of which ``conv_id`` is the smallest; ``ends`` is the SHA-256 of
    their ids in order. Ids of a common sequence are joined in blocks of up to 4,096 before they
    meet, and are digested as a stream.
    """
    block = F.shiftright("conv_id", IDS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = conversations.groupBy("sequence", block.alias("block")).agg(F.first("sizes").alias("sizes"), ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    blocks = blocks.repartition("sequence").sortWithinPartitions("sequence", "block")
    return blocks.mapInArrow(_distinct, _SEQUENCE)


_SHARD = "part int, no int, last boolean, first_seq binary, last_seq binary, sequences array<binary>, sizes array<array<int>>, members array<long>, convs array<long>, ends array<binary>"


def _shards(shard: int):
    def run(batches):
        from pyspark import TaskContext

        part, no, turns, held = TaskContext.get().partitionId(), 0, 0, []

        def packed(last):
            cols = list(zip(*held))
            kinds = (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary())
            values = [pa.array([list(c)], pa.list_(k)) for c, k in zip(cols, kinds)]
            head = [pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([last]), pa.array([cols[0][0]], pa.binary()), pa.array([cols[0][-1]], pa.binary())]
            return pa.RecordBatch.from_arrays([*head, *values], [c.split()[0] for c in _SHARD.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("sequence", "sizes", "n", "conv_id", "ends"))):
                if turns >= shard:
                    yield packed(False)
                    no, turns, held = no + 1, 0, []
                held.append(tuple(x.as_py() for x in row))
                turns += 1 + len(held[-1][1])
        if held:
            yield packed(True)

    return run


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, key binary, parent_key binary"


def _tries(batches):
    for batch in batches:
        for r in batch.to_pylist():
            sizes = [np.array(s, np.int64) for s in r["sizes"]]
            nodes = shard_nodes(r["sequences"], sizes, np.array(r["members"], np.int64), np.array(r["convs"], np.int64), r["ends"], r["before"], r["after"])
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in nodes.values()], list(nodes))


def trie(sequences: DataFrame, within: scratch, shard: int = SHARD) -> DataFrame:
    """A row for each node of the trie of ``distinct_sequences``; ``within`` keeps the tables it reads."""
    ranged = sequences.repartitionByRange("sequence").sortWithinPartitions("sequence")
    shards = stored(ranged.mapInArrow(_shards(shard), _SHARD))
    # neighbours: within a range by number, across ranges by their order; there are as many ranges as tasks
    w, in_order = Window.partitionBy("part").orderBy("no"), Window.orderBy("part")
    near = stored(shards.select("part", "no", "last", "first_seq", "last_seq").withColumns({"before": F.lag("last_seq").over(w), "after": F.lead("first_seq").over(w)}))
    first, last = F.col("no") == 0, F.col("last")
    edges = near.groupBy("part").agg(F.max(F.when(first, F.col("first_seq"))).alias("f"), F.max(F.when(last, F.col("last_seq"))).alias("l"))
    edges = edges.select("part", F.lag("l").over(in_order).alias("part_before"), F.lead("f").over(in_order).alias("part_after"))
    near = near.join(edges, "part").select("part", "no", F.when(first, F.col("part_before")).otherwise(F.col("before")).alias("before"), F.when(last, F.col("part_after")).otherwise(F.col("after")).alias("after"))
    nodes = shards.join(near, ["part", "no"]).select("before", "after", "sequences", "sizes", "members", "convs", "ends")
    nodes = stored(nodes.mapInArrow(_tries, _NODE))
    added = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = nodes.filter("key IS NOT NULL").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *added, F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key"))
    spine = stored(spine.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*nodes.columns))
    # children of spine nodes get their parent's smallest member, which all shards have a say in
    below = stored(nodes.filter("key IS NULL AND parent_key IS NOT NULL").unionByName(spine.filter("parent_key IS NOT NULL")))
    known = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("known"))
    found = salted_join(below, known, "parent_key", hot_keys(below, "parent_key"))
    found = found.withColumn("parent_conv_id", F.col("known")).select(*nodes.columns)
    within.keep(nodes, spine, below)
    return nodes.filter("key IS NULL AND parent_key IS NULL").unionByName(found).unionByName(spine.filter("parent_key IS NULL")).drop("key", "parent_key")


def conversation_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A row for each distinct beginning of the rebuilt conversations, the empty one (root) included:
    its smallest member, its parent's, members, children, leaves below, UTF-8 bytes that are saved
    in its subtree if each text is kept once, and the digest of the ids that end there. An empty
    table has no node; a conversation without turns left ends at the root.
    """
    with scratch(conversations.sparkSession) as s:
        out = trie(stored(distinct_sequences(rebuilt(conversations))), s, shard)
    return out.withColumn("ends", F.lower(F.hex(F.coalesce("ends", F.lit(_NO_ENDS))))).withColumnRenamed("ends", "ends_sha256")
