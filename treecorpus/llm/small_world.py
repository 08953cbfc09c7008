"""Approximate nearest neighbours: a hierarchical small-world graph per shard, kept as flat neighbour arrays."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from treecorpus.llm.common import cut, discard, id_back, id_of, release, small_batches, small_broadcasts
from treecorpus.llm.topk import ASKED, finite, ranges

#: Different vectors of a shard (fewer where they have over WIDE components), and queries of a block.
SHARD, WIDE, QUERIES = 8192, 256, 1024
#: Neighbours of a node in the upper layers (twice that in the lowest), and one in so many nodes rises a layer.
DEGREE, RISE = 16, 16
#: Nodes held in mind while a node's neighbours are sought, and while a query is answered.
BUILD_BEAM, QUERY_BEAM = 64, 128
#: Nodes that a search opens at a time, and that are inserted at a time.
OPENED, INSERTED = 4, 1024
#: The first nodes of a layer meet each other.
FIRST = 256
#: The longest vector of a shard is at most so many times as long as its shortest.
SPREAD = 8
#: Shards that a task searches at most.
MOST = 64

_LEAST = -np.inf


def search(links: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For every query the ``beam`` nodes found nearest, and their products, best first; -1 where there are fewer.

    All queries walk one layer's graph together. Each opens the best nodes of its beam that it has not
    opened yet and takes their unseen neighbours into the beam, until the beam holds opened nodes only.
    """
    n, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((n, len(links)), bool)
    ids = np.full((n, beam), -1, np.int64)
    scores = np.full((n, beam), _LEAST, np.float32)
    opened = np.ones((n, beam), bool)

    def take(rows, new):
        """Bring the nodes ``new`` (-1: none) into the beams of ``rows``."""
        fresh = new >= 0
        fresh &= ~seen[rows[:, None], new]
        r, c = np.nonzero(fresh)
        seen[rows[r], new[r, c]] = True
        value = np.full(new.shape, _LEAST, np.float32)
        value[r, c] = np.einsum("nd,nd->n", vectors[new[r, c]], queries[rows[r]])
        every = np.concatenate([scores[rows], value], 1)
        best = np.argsort(-every, axis=1, kind="stable")[:, :beam]
        scores[rows] = np.take_along_axis(every, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, new, -1)], 1), best, 1)
        opened[rows] = np.take_along_axis(np.concatenate([opened[rows], ~fresh], 1), best, 1)

    for k in range(entries.shape[1]):  # one at a time, as entries may repeat
        take(rows, entries[:, k:k + 1])
    while len(rows):
        closed = ~opened[rows]
        rows, closed = rows[closed.any(axis=1)], closed[closed.any(axis=1)]
        found = []
        for _ in range(OPENED):
            at = closed.argmax(axis=1)
            there = closed[np.arange(len(rows)), at]
            closed[np.arange(len(rows)), at] = False
            opened[rows[there], at[there]] = True
            new = np.where(there[:, None], links[ids[rows, at]], -1)
            for old in found:  # a node may be the neighbour of two
                new = np.where((new[:, :, None] == old[:, None, :]).any(axis=2), -1, new)
            found.append(new)
        if len(rows):
            take(rows, np.concatenate(found, 1))
    return ids, scores


def select(vectors: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) ``most`` that lie in different directions.

    A candidate is taken if it is nearer to the node than to any taken before; what room is left goes
    to the nearest of the others.
    """
    out = np.full((len(ids), most), -1, np.int64)
    for start in range(0, len(ids), 256):
        part, near = ids[start:start + 256], scores[start:start + 256]
        there = part >= 0
        own = vectors[part]
        between = own @ own.transpose(0, 2, 1)
        taken = np.zeros(part.shape, bool)
        closest = np.full(part.shape, _LEAST, np.float32)
        for c in range(part.shape[1]):
            good = there[:, c] & (closest[:, c] < near[:, c]) & (taken.sum(axis=1) < most)
            taken[:, c] = good
            closest = np.where(good[:, None], np.maximum(closest, between[:, c]), closest)
        order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
        out[start:start + 256, :order.shape[1]] = np.take_along_axis(part, order, 1)
    return out


class Graph:
    """Layers of neighbour arrays over unit vectors. The nodes of a layer are the first ``sizes[layer]``; the lowest layer comes first."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.sizes, self.links = vectors, sizes, links

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        """``levels`` (descending) says how far each node rises; layers are filled from the top, so each is entered from the one above."""
        sizes = np.array([(levels >= level).sum() for level in range(int(levels.max(initial=0)) + 1)])
        graph = cls(vectors, sizes, [np.zeros((0, 0), np.int64)] * len(sizes))
        for level in reversed(range(len(sizes))):
            graph._fill(level, DEGREE if level else 2 * DEGREE)
        return graph

    def _fill(self, level: int, degree: int) -> None:
        n = int(self.sizes[level])
        links = np.full((n, degree), -1, np.int64)
        start, above = 0, int(self.sizes[level + 1]) if level + 1 < len(self.sizes) else 0
        while start < n:  # searches of the layer may enter at any node of the one above
            stop = min(n, max(FIRST, above) if not start else start + min(start, INSERTED))
            own = self.vectors[start:stop]
            mates = own @ own.T
            np.fill_diagonal(mates, _LEAST)
            best = np.argsort(-mates, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, scores = best + start, np.take_along_axis(mates, best, 1)
            ids[scores == _LEAST] = -1
            if start:
                entries = self._descend(own, level)
                old, value = search(links[:start], self.vectors, own, entries, BUILD_BEAM)
                ids, scores = np.concatenate([old, ids], 1), np.concatenate([value, scores], 1)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :BUILD_BEAM + DEGREE]
                ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
            links[start:stop] = select(self.vectors, ids, scores, degree)
            self._link_back(links, start, stop)
            start = stop
        self.links[level] = links

    def _descend(self, queries: np.ndarray, level: int, width: int = 8) -> np.ndarray:
        """Where to enter a layer: what the layers above found."""
        entries = np.zeros((len(queries), 1), np.int64)
        for upper in range(len(self.sizes) - 1, level, -1):
            entries = search(self.links[upper], self.vectors, queries, entries, width)[0]
        return entries

    def _link_back(self, links: np.ndarray, start: int, stop: int) -> None:
        """Nodes that were chosen as neighbours get the chooser as a candidate."""
        degree = links.shape[1]
        source, place = np.nonzero(links[start:stop] >= 0)
        source, target = source + start, links[source + start, place]
        value = np.einsum("nd,nd->n", self.vectors[source], self.vectors[target])
        order = np.lexsort((-value, target))
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        new = np.full((len(nodes), degree), -1, np.int64)
        near = rank < degree
        new[np.searchsorted(nodes, target[near]), rank[near]] = source[near]
        old = links[nodes]
        new = np.where((new[:, :, None] == old[:, None, :]).any(axis=2), -1, new)
        ids = np.concatenate([old, new], 1)
        scores = np.einsum("nkd,nd->nk", self.vectors[ids], self.vectors[nodes])
        scores[ids < 0] = _LEAST
        best = np.argsort(-scores, axis=1, kind="stable")
        links[nodes] = select(self.vectors, np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1), degree)

    def nearest(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """The nodes of the lowest layer found nearest to each query (-1 where there are fewer)."""
        return search(self.links[0], self.vectors, queries, self._descend(queries, 0), beam)[0]

    def packed(self) -> bytes:
        """The neighbour arrays, one after the other."""
        return np.concatenate([x.ravel() for x in self.links]).astype("<i4").tobytes()

    @classmethod
    def unpacked(cls, vectors: np.ndarray, sizes: np.ndarray, links: bytes) -> Graph:
        flat, layers, at = np.frombuffer(links, "<i4"), [], 0
        for level, n in enumerate(sizes):
            degree = DEGREE if level else 2 * DEGREE
            layers.append(flat[at:at + n * degree].reshape(n, degree).astype(np.int64))
            at += n * degree
        return cls(vectors, sizes, layers)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors with one more component, whose products with (query, 0) order as the inner products do.

    The longest vector keeps its direction; a shorter one leans into the new component.
    """
    most = np.abs(vectors).max(initial=0) or 1.0
    scaled = vectors / most
    length = np.linalg.norm(scaled, axis=1)
    longest = length.max(initial=0) or 1.0
    lean = np.sqrt(np.maximum(0, 1 - (length / longest) ** 2))
    return np.c_[scaled / longest, lean].astype(np.float32)


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added from the first to the last."""
    total = np.zeros(len(queries))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(queries.shape[1]):
            total += queries[:, j].astype(np.float64) * vectors[:, j].astype(np.float64)
    return total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column, shorter ones filled up with zeros."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def usable(vec: Column) -> Column:
    """Whether a vector takes part: it is there, finite, and not zero."""
    return finite(vec) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def index(rows: DataFrame, keep: int, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``shard, width, kind, vectors, ids, offsets, sizes, links``: the shards of a graph index over all rows.

    Equal vectors are one node, which names its ``keep`` smallest ids. Shards are ranges of the
    vectors' lengths, none ``SPREAD`` times as long as another, since next to a long vector the
    differences among short ones vanish. A node's layer follows from a hash of its vector: the same table gives the same index.
    """
    spark = rows.sparkSession
    valid = rows.select(id_of(id).alias("id"), F.col(vec).alias("vec")).filter(usable(F.col("vec"))).distinct()
    placed = valid.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("place") <= keep)
    nodes = placed.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn(
        "most", F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))  # no overflow
    nodes = cut(nodes.select("vec", "ids", (F.col("most") * F.sqrt(square)).alias("length"), F.xxhash64("vec").alias("hash")), "vectors")
    release(spark)
    n, width = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    most = max(FIRST, SHARD * WIDE // max(width, WIDE))
    # Places in the order of lengths: where a row stands in its range, and how many stand in the ranges ahead.
    ranged = nodes.repartitionByRange(-(-n // most) or 1, "length", "hash").sortWithinPartitions("length", "hash")
    ranged = cut(ranged.withColumn("m", F.monotonically_increasing_id()), "ordered-vectors")
    discard(nodes)
    release(spark)
    part = F.shiftright("m", 33)
    sizes = sorted(map(tuple, ranged.groupBy(part.alias("part")).count().collect()))  # one row per range
    before = np.cumsum([0, *(rows for _, rows in sizes)])
    ahead = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "part long, ahead long")
    place = F.col("ahead") + F.col("m").bitwiseAND(2**33 - 1)
    dealt = ranged.withColumn("part", part).join(F.broadcast(ahead), "part").select("vec", "ids", "length", "hash", F.floor(place / most).alias("group"))
    schema = pa.schema([("width", pa.int32()), ("kind", pa.string()), ("vectors", pa.binary()), ("ids", pa.binary()), ("offsets", pa.binary()),
                        ("sizes", pa.list_(pa.int32())), ("links", pa.binary())])

    def build(key, table):
        table = table.combine_chunks().sort_by([("length", "ascending"), ("hash", "ascending")])
        length, rows, start = table.column("length").to_numpy(), [], 0
        while start < len(length):
            stop = int(np.searchsorted(length, SPREAD * length[start], "right"))
            own = table.slice(start, stop - start)
            vectors, ids = _matrix(own.column("vec").combine_chunks(), width), own.column("ids").combine_chunks()
            hashes = own.column("hash").to_numpy()
            share = ((hashes.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 1) / 2**53
            levels = np.floor(-np.log(share) / math.log(RISE)).astype(np.int64)
            order = np.lexsort((hashes, -levels))
            vectors, ids = vectors[order], ids.take(pa.array(order))
            graph = Graph.build(lifted(vectors.astype(np.float64)), levels[order])
            kind = "<f4" if vectors.dtype == np.float32 else "<f8"
            rows.append({
                "width": width, "kind": kind, "vectors": vectors.astype(kind).tobytes(), "ids": ids.flatten().to_numpy().astype("<i8").tobytes(),
                "offsets": np.cumsum(np.r_[0, ids.value_lengths().to_numpy()]).astype("<i4").tobytes(), "sizes": graph.sizes.tolist(), "links": graph.packed()})
            start = stop
        return pa.Table.from_pylist(rows, schema=schema)

    made = dealt.groupBy("group").applyInArrow(
        build, "width int, kind string, vectors binary, ids binary, offsets binary, sizes array<int>, links binary")
    made = cut(made, "shards")
    discard(ranged)
    release(spark)
    named = made.withColumn("part", F.monotonically_increasing_id())
    # One row per shard.
    numbers = {part: i for i, part in enumerate(sorted(r[0] for r in named.select("part").collect()))}
    of = spark.createDataFrame(list(numbers.items()), "part long, shard int")
    return named.join(F.broadcast(of), "part").drop("part")


def _turns(blocks: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of ``block`` whose queries take at most ``most`` bytes, or one block. One row per block comes to the driver."""
    return ranges(blocks.select("block", F.octet_length("q_vectors") + 2 * F.octet_length("q_ids")), most)


def _ask(k: int, beam: int):
    def answers(row):
        width = max(row["width"], row["q_width"])

        def matrix(raw, kind, own):
            values = np.frombuffer(raw, kind).reshape(-1, own)
            return np.pad(values, ((0, 0), (0, width - own))) if own < width else values

        vectors, queries = matrix(row["vectors"], row["kind"], row["width"]), matrix(row["q_vectors"], row["q_kind"], row["q_width"])
        ids, offsets, q_ids, q_rows = (np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("offsets", "<i4"), ("q_ids", "<i8"), ("q_rows", "<i8")))
        graph = Graph.unpacked(lifted(vectors.astype(np.float64)), np.array(row["sizes"]), row["links"])
        turned = queries.astype(np.float64)
        turned = turned / np.abs(turned).max(axis=1, keepdims=True)
        turned = np.c_[turned / np.linalg.norm(turned, axis=1, keepdims=True), np.zeros(len(turned))].astype(np.float32)
        found = graph.nearest(turned, beam)
        q, place = np.nonzero(found >= 0)
        node = found[q, place]
        score = inner(queries[q], vectors[node])
        # A node stands for its copies.
        copies = (offsets[node + 1] - offsets[node]).astype(np.int64)
        at = np.repeat(offsets[node] - np.r_[0, np.cumsum(copies)[:-1]], copies) + np.arange(copies.sum())
        q, score, vec = np.repeat(q, copies), np.repeat(score, copies), ids[at]
        other = vec != q_ids[q]
        return q_rows[q[other]], q_ids[q[other]], vec[other], score[other]

    def merged(*parts):
        row, query, vec, score = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((vec, -np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf), row))
        sorted_ = row[order]
        first = order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]
        return row[first], query[first], vec[first], score[first]

    def run(batches):
        best = {}  # of each query block what the task's shards have given so far
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                best[row["block"]] = merged(*(best[row["block"]],) if row["block"] in best else (), answers(row))
        for found in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["row", "query", "vec", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, beam: int | None = None, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries`` the ``k`` rows found with the largest inner products.

    Candidates are all rows but those with the query's own id; the score is the inner product of the
    vectors as given, in double precision, added up from the first component to the last; ties go to the
    smaller id, and a query without ``k`` candidates gets all that there are. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part; a shorter vector is filled up
    with zeros; a sum beyond the doubles is infinite, one that is no number ranks last. Rows that
    repeat an id and a vector are one row; rows without an id rank behind ties with one; other columns
    play no part.

    Every row is in the graph of one shard, every query is searched in all shards (``beam`` nodes are
    held in mind in each), and the shards' best are merged, first in the task, then over all tasks. Shards stay where they are read;
    queries come to them, so many at a time that a broadcast of them, and what a task holds of their results, stay small however many there are.
    What a search misses are nodes that its walk does not meet: measured recall is in the README.
    """
    spark = rows.sparkSession
    small_broadcasts(spark)
    beam = max(beam or QUERY_BEAM, k + 1)
    shards = index(rows, k + 1, id, vec)
    asked = queries.select(id_of(id).alias("id"), F.col(vec).alias("vec")).filter(usable(F.col("vec"))).distinct()
    asked = cut(asked.withColumn("row", F.monotonically_increasing_id()), "queries")
    small_batches(spark, QUERIES, "16m")

    def pack(batches):
        for batch in batches:
            width = int(max(batch.column("vec").value_lengths().to_numpy(zero_copy_only=False), default=0))
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vec"), width)
            kind = "<f4" if vectors.dtype == np.float32 else "<f8"
            yield pa.RecordBatch.from_pydict({
                "q_width": pa.array([width], pa.int32()), "q_kind": [kind], "q_vectors": [vectors.astype(kind).tobytes()],
                "q_ids": [batch.column("id").to_numpy().astype("<i8").tobytes()], "q_rows": [batch.column("row").to_numpy().astype("<i8").tobytes()]})

    blocks = asked.select("id", "vec", "row").mapInArrow(pack, "q_width int, q_kind string, q_vectors binary, q_ids binary, q_rows binary")
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    n = shards.count()
    # So many shards a task that all cores have two tasks, and at most MOST of them: only the best of a task's shards leave it.
    tasks = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-n // MOST))))
    shards = cut(shards.repartitionByRange(tasks, "shard").drop("shard"), "small-worlds") if tasks > 1 else shards.drop("shard")
    release(spark)
    found = []
    for first, last in _turns(blocks, min(ASKED, ASKED * 64 // max(k, 1))):
        asked_now = F.broadcast(blocks.filter(F.col("block").between(first, last)))
        found.append(cut(shards.crossJoin(asked_now).mapInArrow(_ask(k, beam), "row long, query long, vec long, score double"), "found"))
        release(spark)  # else the broadcasts stay on the driver
    found = reduce(DataFrame.union, found)
    order = Window.partitionBy("row").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(id_back("query").alias("query_id"), "rank", id_back("vec").alias("vec_id"), "score")
