"""Property-graph operators over ``entities``, ``relations`` and ``mentions`` DataFrames.

``relations(source, target, relation_type, description, weight)`` are directed edges; traversal
ignores direction. Every result that a limit cuts is totally ordered first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import stored


def undirected(relations: DataFrame) -> DataFrame:
    one = relations.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def mention_edges(mentions: DataFrame) -> DataFrame:
    """Undirected edges between entities and the chunks that mention them, chunks as ``chunk:<id>``.

    ``to_entity`` tells which edges lead to entities.
    """
    chunk = F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))
    one = mentions.select(chunk.alias("src"), F.col("canonical_name").alias("dst"), F.lit(True).alias("to_entity"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("to_entity")))


def _numbered(queries: DataFrame) -> DataFrame:
    """``query_id, word, bit``: a bit of a word of 64 for each query; a stored table."""
    # numbers have gaps, which only leaves bits unused
    n = stored(queries.select("query_id").distinct().withColumn("n", F.monotonically_increasing_id()))
    return n.select("query_id", F.shiftright("n", 6).alias("word"), F.col("n").bitwiseAND(63).cast("int").alias("bit"))


def _each_bit(rows: DataFrame) -> DataFrame:
    """A row for each bit that is set in ``bits``."""
    return rows.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("bits", b) == 1)))


def bfs(seeds: DataFrame, edges: DataFrame, entities: DataFrame, max_hops: int = 2) -> DataFrame:
    """``query_id, node, entity_type, hop_distance``: entities within ``max_hops`` of a query's seeds.

    ``seeds(query_id, seed)``; seeds that are no entity don't count. The distance is that to the
    nearest seed. ``edges(src, dst[, to_entity])`` are undirected and may pass through other kinds
    of nodes; the last hop follows only those that may lead ``to_entity``.
    Queries travel together: a row is a node with a word of 64 bits, one for each query that has
    come there, so that an edge is followed once for 64 queries and hubs that many queries share
    cost as one. Words of a node are combined before they are shuffled. Each frontier but the last
    is written out before the next one is joined, so that the plan grows by one join a hop.
    """
    start = seeds.join(entities, seeds["seed"] == entities["canonical_name"], "left_semi").select("query_id", F.col("seed").alias("node"))
    numbered = _numbered(start)
    one = F.expr("shiftleft(1L, bit)")
    seen = start.join(numbered, "query_id").groupBy("node", "word").agg(F.bit_or(one).alias("bits")).withColumn("hop_distance", F.lit(0))
    frontier = seen = stored(seen)
    for hop in range(1, max_hops + 1):
        if hop == max_hops and "to_entity" in edges.columns:
            edges = edges.filter("to_entity")
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        before = seen.groupBy("node", "word").agg(F.bit_or("bits").alias("before"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("before", F.lit(0).cast("long"))))
        frontier = step.join(before, ["node", "word"], "left").select("node", "word", fresh.alias("bits")).filter("bits <> 0").withColumn("hop_distance", F.lit(hop))
        if hop < max_hops:
            frontier = stored(frontier)
        seen = seen.unionByName(frontier)
    found = seen.join(entities.select(F.col("canonical_name").alias("node"), "entity_type"), "node")
    return _each_bit(found).join(numbered, ["word", "bit"]).select("query_id", "node", "entity_type", "hop_distance")


def _first_of_bits(limit: int):
    """Of each batch the edges that are among the first ``limit`` of any query of their word."""

    def run(batches):
        for batch in batches:
            rows = batch.take(pc.sort_indices(batch, [(c, "ascending") for c in ("word", "source", "relation", "target")]))
            word = rows.column("word").to_numpy()
            held = (rows.column("bits").to_numpy()[:, None] >> np.arange(64)) & 1
            nth = np.cumsum(held, axis=0)
            begin = np.searchsorted(word, word)  # of the word's rows
            nth -= np.vstack([np.zeros(64, nth.dtype), nth])[begin]
            yield rows.filter(pa.array(((held == 1) & (nth <= limit)).any(axis=1)))

    return run


def induced_edges(nodes: DataFrame, relations: DataFrame, limit: int | None = 25) -> DataFrame:
    """``query_id, source, target, relation, description, weight``: edges between a query's nodes.

    One edge of each source, target and type, that with the least description; at most ``limit``
    a query, by source, type and target. An edge meets the queries of both ends as bits of words;
    a task drops edges that enough earlier ones of its own precede in all of their queries before
    there is a row for each query.
    """
    numbered = _numbered(nodes)
    n = nodes.select("query_id", "node").join(numbered, "query_id").groupBy("node", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    e = relations.groupBy("source", "target", F.col("relation_type").alias("relation")).agg(F.min(F.struct("description", "weight")).alias("d"))
    e = e.select("source", "target", "relation", "d.description", "d.weight").join(n.select(F.col("node").alias("source"), "word", F.col("bits").alias("a")), "source")
    e = e.join(n.select(F.col("node").alias("target"), "word", F.col("bits").alias("b")), ["target", "word"])
    e = e.select("word", F.col("a").bitwiseAND(F.col("b")).alias("bits"), "source", "target", "relation", "description", "weight").filter("bits <> 0")
    if limit is not None:
        e = e.mapInArrow(_first_of_bits(limit), e.schema)
    e = _each_bit(e).join(numbered, ["word", "bit"]).select("query_id", "source", "target", "relation", "description", "weight")
    return _first(e, limit, "source", "relation", "target")


def match_seeds(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """``query_id, canonical_name`` of entities whose canonical or given name is a seed."""
    by_canonical = seeds.join(entities, seeds["seed"] == entities["canonical_name"]).select("query_id", "canonical_name")
    by_name = seeds.join(entities, seeds["seed"] == entities["name"]).select("query_id", "canonical_name")
    return by_canonical.union(by_name).distinct()


def _first(rows: DataFrame, limit: int | None, *order: str) -> DataFrame:
    if limit is None:
        return rows
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def neighbours(seeds: DataFrame, entities: DataFrame, relations: DataFrame, limit: int | None = None) -> DataFrame:
    """One-hop neighbours of matched seeds; a seed without any keeps a row of nulls.

    At most ``limit`` rows a query, by source, type and target.
    """
    r = relations.select(F.col("source").alias("canonical_name"), "relation_type", "description", "weight", F.col("target").alias("other"))
    back = relations.select(F.col("target").alias("canonical_name"), "relation_type", "description", "weight", F.col("source").alias("other"))
    kinds = entities.select(F.col("canonical_name").alias("other"), F.col("entity_type").alias("target_type"))
    out = match_seeds(seeds, entities).join(r.unionByName(back).join(kinds, "other"), "canonical_name", "left")
    out = out.select("query_id", F.col("canonical_name").alias("source"), "relation_type", "description", "weight", F.col("other").alias("target"), "target_type")
    return _first(out, limit, "source", "relation_type", "target", "description")


def two_hop_edges(seeds: DataFrame, entities: DataFrame, relations: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct edges, in stored direction, on paths of one or two edges from matched seeds.

    That is, edges at a seed or at a neighbour of a seed. At most ``limit`` a query, by source,
    type and target.
    """
    start = match_seeds(seeds, entities).select("query_id", F.col("canonical_name").alias("node"))
    both = undirected(relations)
    near = start.join(both, start["node"] == both["src"]).select("query_id", F.col("dst").alias("node"))
    reached = start.union(near).distinct()
    at = lambda end: relations.join(reached, relations[end] == reached["node"]).select("query_id", "source", F.col("relation_type").alias("relation"), "description", "weight", "target")
    kinds = entities.select(F.col("canonical_name").alias("target"), F.col("entity_type").alias("target_type"))
    out = at("source").union(at("target")).distinct().join(kinds, "target").select("query_id", "source", "relation", "description", "weight", "target", "target_type")
    return _first(out, limit, "source", "relation", "target", "description")


def shortest_paths(starts: DataFrame, ends: DataFrame, relations: DataFrame, most: int = 4) -> DataFrame:
    """``start, end, hop_length, path``: shortest paths of 1 to ``most`` edges; of several the least.

    ``starts(start)`` and ``ends(end)``; the search keeps one path for each start and node, so its
    size is that of the reached part of the graph.
    """
    both = undirected(relations)
    seen = starts.select("start", F.col("start").alias("node"), F.col("start").alias("path"), F.lit(0).alias("hop_length")).distinct()
    frontier = seen
    for hop in range(1, most + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select("start", F.col("dst").alias("node"), F.concat_ws(" > ", "path", "dst").alias("path"))
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = step.groupBy("start", "node").agg(F.min("path").alias("path")).withColumn("hop_length", F.lit(hop))
        if hop < most:
            frontier = stored(frontier)
        seen = seen.unionByName(frontier)
    found = seen.filter("hop_length > 0").join(ends.select(F.col("end").alias("node")).distinct(), "node", "left_semi")
    return found.select("start", F.col("node").alias("end"), "hop_length", "path")


def _profiles(named: DataFrame, said: DataFrame) -> DataFrame:
    """``query_id, profile, rest``: each query's known seeds ``(n, name, weight)``, rarest first, and all their ends.

    ``rest`` is the list from one seed on. The rarer seeds of a list come before those of more
    mentions, in one order for all queries, so that queries share the ends that hold common seeds.
    """
    known = said.groupBy("canonical_name").agg(F.count("*").alias("n"))
    lists = named.groupBy("query_id", "canonical_name").agg(F.count("*").cast("double").alias("weight")).join(known, "canonical_name")
    lists = lists.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "canonical_name", "weight"))).alias("profile"))
    every = F.transform(F.sequence(F.lit(1), F.size("profile")), lambda i: F.slice("profile", i, F.size("profile")))
    return lists.select("query_id", F.explode(every).alias("rest"))


CHUNKS = 1 << 16  # chunks of a block of postings
MENTIONS = 1 << 21  # and mentions, after which a block is closed
LISTS = 1 << 12  # lists of seeds of a block
_DECIMAL = 1e-6  # scores are rounded to it


def _postings(batches):
    """Blocks of chunks ``chunk_id, doc_id, said`` in order of their ids: the places and worths of each name.

    ``chunks`` and ``docs`` are the ids; ``names`` has its names, ``starts`` where the places of each begin
    in ``places`` and ``worths``; the latter are empty where all are 1.
    """

    def block(parts):
        rows = pa.Table.from_batches(parts).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("chunk_id", "ascending"), ("doc_id", "ascending")])).combine_chunks()
        said = rows.column("said").combine_chunks()
        lists = said.chunk(0) if isinstance(said, pa.ChunkedArray) else said
        name, worth = lists.flatten().flatten()
        coded = name.dictionary_encode()
        code, worth = coded.indices.to_numpy(), worth.to_numpy()
        order = np.argsort(code, kind="stable")
        places = np.repeat(np.arange(rows.num_rows, dtype=np.int32), pc.list_value_length(lists).to_numpy())[order]
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).astype(np.int64)
        ids = [rows.column(c).combine_chunks() for c in ("chunk_id", "doc_id")]
        ids = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in ids]
        each = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (*ids, coded.dictionary)]
        packed = (starts, places, np.empty(0) if (worth == 1).all() else worth[order])
        return pa.RecordBatch.from_arrays([*each, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["chunks", "docs", "names", "starts", "places", "worths"])

    parts, n, said = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            parts.append(batch.slice(at, 1024))
            n, said = n + parts[-1].num_rows, said + pc.sum(pc.list_value_length(parts[-1].column("said"))).as_py()
            if n >= CHUNKS or said >= MENTIONS:
                yield block(parts)
                parts, n, said = [], 0, 0
    if parts:
        yield block(parts)


def _asked(batches):
    """Blocks of lists of seeds ``tail, rest``: ``tails, sizes, names, weights``."""
    for batch in batches:
        for at in range(0, batch.num_rows, LISTS):
            part = batch.slice(at, LISTS)
            size = pc.list_value_length(part.column("rest")).to_numpy().astype(np.int64)
            _, name, weight = part.column("rest").flatten().flatten()
            names = pa.ListArray.from_arrays(pa.array([0, len(name)], pa.int32()), name)
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (part.column("tail").to_numpy(), size)]
            yield pa.RecordBatch.from_arrays([*packed, names, pa.array([weight.to_numpy().tobytes()], pa.binary())], ["tails", "sizes", "seeds", "weights"])


class _Block:
    """The postings of one block, and what is asked of them."""

    def __init__(self, row: dict):
        self.names = {n: i for i, n in enumerate(row["names"].values.to_pylist())}
        self.starts = np.frombuffer(row["starts"].as_py(), np.int64)
        self.places = np.frombuffer(row["places"].as_py(), np.int32)
        worths = np.frombuffer(row["worths"].as_py())
        self.worths = worths if len(worths) else None
        self.size = len(row["chunks"].values)
        self.known: dict[int, tuple] = {}

    def of(self, i: int) -> tuple:
        """``places, worths, most, dense`` of a name: null worths are 1, ``dense`` has those of all places if the name is common."""
        if i not in self.known:
            span = slice(self.starts[i], self.starts[i + 1])
            places, worths, dense = self.places[span], None if self.worths is None else self.worths[span], None
            if len(places) * 16 >= self.size:
                dense = np.zeros(self.size, np.uint8 if worths is None else np.float64)
                dense[places] = 1 if worths is None else worths
            self.known[i] = places, worths, 1.0 if worths is None else float(worths.max()), dense
        return self.known[i]

    def worth(self, i: int, at: np.ndarray):
        """The worths of a name in the chunks ``at``, 0 where it isn't mentioned."""
        places, worths, _, dense = self.of(i)
        if dense is not None:
            return dense[at]
        nth = np.searchsorted(places, at)
        nth[nth == len(places)] = 0
        return (places[nth] == at) * (1.0 if worths is None else worths[nth])

    def best(self, seeds: list[int], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of chunks that mention the first of ``seeds``, with the best ``k`` among them.

        Chunks are read in their order, until ``k`` have the highest score that there can be. What
        may be as good once it is rounded is handed on too, but no more than ``k`` of one score.
        """
        places, worths, most, _ = self.of(seeds[0])
        bound = 0.0 + weights[0] * most
        for i, weight in zip(seeds[1:], weights[1:]):
            bound += weight * self.of(i)[2]
        found, at, step, n = [], 0, 1024, 0
        while at < len(places) and n < k:
            part = places[at : at + step]
            score = np.full(len(part), 0.0 + weights[0]) if worths is None else 0.0 + weights[0] * worths[at : at + step]
            for i, weight in zip(seeds[1:], weights[1:]):
                score += weight * self.worth(i, part)
            n += np.count_nonzero(score == bound)
            found.append((part, score))
            at, step = at + step, 4 * step
        part, score = found[0] if len(found) == 1 else map(np.concatenate, zip(*found))
        if len(score) > k:
            good = score >= np.partition(score, len(score) - k)[len(score) - k] - 2 * _DECIMAL
            part, score = part[good], score[good]
            if len(score) > k:
                order = np.argsort(-score, kind="stable")
                part, score = part[order], score[order]
                first = np.searchsorted(-score, -score)
                keep = np.arange(len(score)) - first < k
                part, score = part[keep], score[keep]
        return part, score


def _ranked(k: int):
    """Of each block of chunks the best ``k`` of each list that mention its first seed, ``tail, chunk_id, doc_id, score``."""

    def run(batches):
        last, block = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in batch.schema.names}
                key = row["places"].as_buffer(), row["starts"].as_buffer()
                if last is None or not all(a.equals(b) for a, b in zip(last, key)):
                    last, block = key, _Block(row)
                tails, sizes = (np.frombuffer(row[c].as_py(), np.int64) for c in ("tails", "sizes"))
                weights, names = np.frombuffer(row["weights"].as_py()).tolist(), [block.names.get(x) for x in row["seeds"].values.to_pylist()]
                out, at = [], 0
                for tail, size in zip(tails.tolist(), sizes.tolist()):
                    if names[at] is not None:
                        some = [i for i in range(at, at + size) if names[i] is not None]
                        out.append((tail, *block.best([names[i] for i in some], [weights[i] for i in some], k)))
                    at += size
                if out:
                    place = pa.array(np.concatenate([p for _, p, _ in out]))
                    tail = np.repeat(np.array([t for t, _, _ in out], np.int64), [len(p) for _, p, _ in out])
                    ids = [row[c].values.take(place) for c in ("chunks", "docs")]
                    yield pa.RecordBatch.from_arrays([pa.array(tail), *ids, pa.array(np.concatenate([s for _, _, s in out]))], ["tail", "chunk_id", "doc_id", "score"])

    return run


def _best_of_lists(tails: DataFrame, chunk: DataFrame, k: int) -> DataFrame:
    """``tail, chunk_id, doc_id``: of each list ``tails(tail, rest)`` the best ``k`` of ``chunk(chunk_id, doc_id, said)`` that mention its first seed.

    Chunks are packed in blocks of postings and lists in blocks that meet each of them, an equi-join
    on shards: a list reads the places of its rarest seed and looks the others up, as arrays.
    """
    shards = int(tails.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = {c: chunk.schema[c].dataType for c in ("chunk_id", "doc_id")}
    of = ", ".join(f"{name} array<{kind.simpleString()}>" for name, kind in zip(("chunks", "docs"), ids.values()))
    blocks = chunk.select("chunk_id", "doc_id", "said").mapInArrow(_postings, f"{of}, names array<string>, starts binary, places binary, worths binary")
    asked = tails.select("tail", "rest").mapInArrow(_asked, "tails binary, sizes binary, seeds array<string>, weights binary")
    blocks = blocks.withColumn("shard", F.pmod(F.xxhash64("places", "chunks"), F.lit(shards)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = blocks.join(asked, "shard").drop("shard").mapInArrow(_ranked(k), f"tail long, {', '.join(f'{c} {kind.simpleString()}' for c, kind in ids.items())}, score double")
    few = Window.partitionBy("tail").orderBy(F.desc("graph_score"), "chunk_id", "doc_id")
    ranked = found.select("tail", "chunk_id", "doc_id", F.round("score", 6).alias("graph_score"))
    return ranked.withColumn("rank", F.row_number().over(few)).filter(F.col("rank") <= k).select("tail", "chunk_id", "doc_id")


def grounded_chunks(seeds: DataFrame, mentions: DataFrame, k: int = 5, by_confidence: bool = False) -> DataFrame:
    """``query_id, chunk_id, doc_id, mentioned_entities, graph_score, rank``: chunks that mention seeds.

    ``seeds(query_id, ord, seed)``. The score counts the seeds a chunk mentions, repeated ones
    again, or adds up the confidences of the mentions (a missing one is 1; none is below 0). Best k
    a query, ties by chunk_id.

    A query's chunks are not all listed, which would be queries times chunks for common seeds.
    The best k of a list of seeds are among those that mention its rarest seed and the best k of
    the rest of the list: k chunks that are as good by the rest alone are no worse by the whole.
    So each end of a list is ranked once for all queries that share it, over the mentions of its
    rarest seed only, in arrays.
    """
    named = seeds.select("query_id", "ord", F.col("seed").alias("canonical_name"))
    if by_confidence:
        named = named.groupBy("query_id", "canonical_name").agg(F.min("ord").alias("ord"))
    said = mentions.select("chunk_id", "doc_id", "canonical_name", "confidence").join(named.select("canonical_name").distinct(), "canonical_name", "left_semi")
    worth = F.max(F.coalesce("confidence", F.lit(1.0))) if by_confidence else F.count("*").cast("double")
    # shuffled once for both groupings; read by the counts, the ranking and the names
    said = said.repartition("chunk_id", "doc_id").groupBy("chunk_id", "doc_id", "canonical_name").agg(worth.alias("worth"))
    chunk = stored(said.groupBy("chunk_id", "doc_id").agg(F.collect_list(F.struct("canonical_name", "worth")).alias("said")))
    said = chunk.select("chunk_id", "doc_id", F.inline("said"))
    profiles = stored(_profiles(named, said))
    tails = stored(profiles.select("rest").distinct().select("rest", F.monotonically_increasing_id().alias("tail")))
    few = _best_of_lists(tails, chunk, k)
    candidates = profiles.join(tails, "rest").join(few, "tail").select("query_id", "chunk_id", "doc_id").distinct()
    hit = candidates.join(chunk, ["chunk_id", "doc_id"]).select("query_id", "chunk_id", "doc_id", F.inline("said")).join(named, ["query_id", "canonical_name"])
    times = F.lit(1) if by_confidence else F.col("worth").cast("int")
    names = F.transform(F.sort_array(F.flatten(F.collect_list(F.array_repeat(F.struct("ord", "canonical_name"), times)))), lambda s: s["canonical_name"])
    out = hit.groupBy("query_id", "chunk_id", "doc_id").agg(F.round(F.sum("worth"), 6).alias("graph_score"), F.array_join(names, ", ").alias("mentioned_entities"))
    w = Window.partitionBy("query_id").orderBy(F.desc("graph_score"), "chunk_id")
    out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("query_id", "chunk_id", "doc_id", "mentioned_entities", "graph_score", "rank")


def bridges(seeds: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int = 5, both_orders: bool = False, documents: DataFrame | None = None) -> DataFrame:
    """Pairs of chunks of different documents that mention one seed; the first ``limit`` a query.

    Order: the seed's place, then the two chunk ids. Only the first ``limit`` chunks of each of
    the first ``limit + 1`` documents of an entity can be in that many pairs, so no more are
    paired, however often an entity is mentioned. With ``documents(doc_id, title)`` the pairs have
    ``title1`` and ``title2``: null for a document without title, the id for an unknown document.
    """
    hit = mentions.select("chunk_id", "doc_id", "canonical_name").distinct().join(seeds.select(F.col("seed").alias("canonical_name")).distinct(), "canonical_name", "left_semi")
    in_doc = Window.partitionBy("canonical_name", "doc_id").orderBy("chunk_id")
    hit = hit.withColumn("nth", F.row_number().over(in_doc)).filter(F.col("nth") <= limit)
    docs = hit.filter("nth = 1").withColumn("d", F.row_number().over(Window.partitionBy("canonical_name").orderBy("chunk_id"))).filter(F.col("d") <= limit + 1)
    hit = hit.join(docs.select("canonical_name", "doc_id"), ["canonical_name", "doc_id"])
    side = lambda n: hit.select("canonical_name", F.col("chunk_id").alias(f"chunk{n}_id"), F.col("doc_id").alias(f"doc{n}"))
    pairs = side(1).join(side(2), "canonical_name").filter(F.col("doc1") != F.col("doc2"))
    if not both_orders:
        pairs = pairs.filter("chunk1_id < chunk2_id")
    pairs = seeds.withColumnRenamed("seed", "canonical_name").join(pairs, "canonical_name")
    w = Window.partitionBy("query_id").orderBy("ord", "chunk1_id", "chunk2_id")
    pairs = pairs.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= limit)
    text = lambda n: chunks.select(F.col("chunk_id").alias(f"chunk{n}_id"), F.left("text", F.lit(200)).alias(f"chunk{n}_text"))
    out = pairs.join(text(1), "chunk1_id", "left").join(text(2), "chunk2_id", "left")
    titles = []
    for n in (1, 2) if documents is not None else ():
        named = documents.select(F.col("doc_id").alias(f"doc{n}"), F.struct("title").alias(f"known{n}"))
        out = out.join(named, f"doc{n}", "left")
        titles.append(F.when(F.col(f"known{n}").isNull(), F.col(f"doc{n}").cast("string")).otherwise(F.col(f"known{n}.title")).alias(f"title{n}"))
    return out.select("query_id", "nth", F.col("canonical_name").alias("shared_entity"), "doc1", "chunk1_id", "chunk1_text", "doc2", "chunk2_id", "chunk2_text", *titles)


def dangling_entities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that relations name and ``entities`` lacks, as CONCEPT."""
    ends = relations.select(F.col("source").alias("canonical_name")).union(relations.select("target")).distinct()
    return ends.join(entities, "canonical_name", "left_anti").select("canonical_name", F.col("canonical_name").alias("name"), F.lit("CONCEPT").alias("entity_type"))


def guarded_mentions(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mentions of chunks that are known."""
    return mentions.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def all_edges(chunks: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """``src, dst, rel_type, explicit_rel, page``: the four kinds of edges of the property graph.

    ``page`` is the page of a document's chunk, for CONTAINS_CHUNK edges.
    """
    tag = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    w = Window.partitionBy("doc_id").orderBy("page_number", "chunk_id")
    nxt = chunks.withColumn("next_id", F.lead("chunk_id").over(w)).filter("next_id IS NOT NULL")
    none, no_page = F.lit(None).cast("string").alias("explicit_rel"), F.lit(None).cast("int").alias("page")
    return (
        chunks.select(tag("doc", "doc_id").alias("src"), tag("chunk", "chunk_id").alias("dst"), F.lit("CONTAINS_CHUNK").alias("rel_type"), none, F.col("page_number").cast("int").alias("page"))
        .unionByName(nxt.select(tag("chunk", "chunk_id").alias("src"), tag("chunk", "next_id").alias("dst"), F.lit("NEXT_CHUNK").alias("rel_type"), none, no_page))
        .unionByName(mentions.select(tag("chunk", "chunk_id").alias("src"), tag("entity", "canonical_name").alias("dst"), F.lit("MENTIONS").alias("rel_type"), none, no_page))
        .unionByName(relations.select(tag("entity", "source").alias("src"), tag("entity", "target").alias("dst"), F.lit("RELATION").alias("rel_type"), F.col("relation_type").alias("explicit_rel"), no_page))
    )


def traversal_edges(chunks: DataFrame, mentions: DataFrame, relations: DataFrame, max_hops: int = 2) -> DataFrame:
    """Undirected ``(src, dst, to_entity)`` over the whole graph; entities keep their names as node ids.

    Edges between chunks, and between documents and chunks, connect entities from three hops on,
    and are left out for shorter searches.
    """
    rel = relations.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(True).alias("to_entity"))
    one = rel.unionByName(rel.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "to_entity")).unionByName(mention_edges(mentions))
    if max_hops < 3:
        return one
    none = mentions.select("chunk_id", "doc_id", "canonical_name").limit(0)
    e = all_edges(chunks, none, relations.select("source", "target", "relation_type").limit(0)).select("src", "dst", F.lit(False).alias("to_entity"))
    return one.unionByName(e).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "to_entity"))
