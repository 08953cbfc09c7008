"""Embedding near-dedup with a pivot-permutation index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treecorpus.llm.common import cut, id_back, id_of, small_batches
from treecorpus.llm.components import components, spanning
from treecorpus.llm.topk import finite

#: Bounds of the number of pivots; in between it is four times the root of the number of vectors.
FEWEST, MOST = 64, 4096
#: Nearest pivots that describe a vector, and how many of them two vectors must share.
NEAREST, SHARED = 8, 2
#: No two pivots are nearer than this cosine, so a dense region doesn't take most of them.
APART = 0.9
#: Vectors in a block of an inverted list.
BLOCK = 1024


def unit(flat: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of unit length; a shorter vector is filled up with zeros."""
    rows = np.zeros((len(lengths), width))
    rows[np.arange(width)[None, :] < lengths[:, None]] = flat
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _unit_of(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return unit(flat, column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), width)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` rows of the sample that are no nearer than ``APART`` to an earlier one."""
    chosen: list[int] = []
    open_ = np.ones(len(sample), bool)
    for i in range(len(sample)):
        if open_[i] and len(chosen) < n:
            chosen.append(i)
            open_ &= sample @ sample[i] < APART
    return sample[chosen]


def _verify(width: int, shared: int, least: float):
    def nodes_of(blocks):
        items = blocks.values
        return (items.field("node").to_numpy(), items.field("copies").to_numpy(),
                np.array(items.field("tops").to_pylist(), dtype=np.int32).reshape(len(items), -1), _unit_of(items.field("vec"), width))

    def run(batches):
        for batch in batches:
            out = []
            for pivot, x, y in zip(batch.column("pivot").to_pylist(), batch.column("x"), batch.column("y")):
                a_node, a_copies, a_tops, a = nodes_of(x)
                own = not y.is_valid
                b_node, b_copies, b_tops, b = (a_node, a_copies, a_tops, a) if own else nodes_of(y)
                link = a @ b.T >= least
                if own:
                    link = np.triu(link, 1)
                rows, columns = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
                if not len(rows):
                    continue
                link = link[np.ix_(rows, columns)]
                names = np.unique(np.r_[a_tops[rows].ravel(), b_tops[columns].ravel()])
                has = [np.zeros((len(t), len(names)), np.float32) for t in (rows, columns)]
                for one, tops in zip(has, (a_tops[rows], b_tops[columns])):
                    one[np.arange(len(tops))[:, None], np.searchsorted(names, tops)] = 1
                before = np.searchsorted(names, pivot)
                link &= has[0] @ has[1].T >= shared
                link &= has[0][:, :before] @ has[1][:, :before].T == 0  # a pair counts in its first common list
                if not link.any():
                    continue
                nodes = np.r_[a_node[rows], b_node[columns]]
                n = np.r_[link @ b_copies[columns], link.T @ a_copies[rows]]
                source, target = spanning(link)
                out.append((np.r_[nodes[n > 0], nodes[source]], np.r_[np.full((n > 0).sum(), -1), nodes[target]],
                            np.r_[n[n > 0], np.zeros(len(source), np.int64)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["node", "other", "n"])

    return run


def near_vectors(rows: DataFrame, least: float = 0.95, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Two vectors link at a cosine of ``least`` or more, in double precision; ``n_links`` counts the
    other rows linked directly, equal vectors among them, and the component is the least id
    reachable. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing. A shorter vector is filled up with zeros. Rows without an id come last; repeated rows
    are rows like any other; other columns play no part.

    Pivots are drawn from a sample of at most 2 * ``MOST`` vectors and every vector is indexed: it
    stands in the lists of its ``NEAREST`` nearest pivots. Within a list, blocks meet blocks; a pair
    that shares ``SHARED`` pivots and reaches the cosine is a link, found in the first list both
    stand in. Equal vectors are one node, links are counted per block and only spanning edges are
    written, so groups of copies cost no pairs. What the index misses are pairs that share fewer
    pivots: measured recall is in the README.
    """
    spark = rows.sparkSession
    small_batches(spark, 1024, "16m")
    named = rows.select(id_of(id).alias("id"), F.col(vec).alias("vec"))
    usable = finite(F.col("vec")) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    valid = named.filter(usable)
    nodes = cut(valid.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn(
        "node", F.monotonically_increasing_id()), "vectors")
    n, width = nodes.agg(F.count("*"), F.max(F.size("vec"))).first()
    wanted = min(MOST, max(FEWEST, 1 << math.ceil(math.log2(4 * math.sqrt(max(n, 1))))))
    sample = [r[0] for r in nodes.orderBy(F.xxhash64("vec"), "first").select("vec").limit(2 * wanted).collect()]
    flat = np.array([x for v in sample for x in v], dtype=np.float64)
    pivots = choose_pivots(unit(flat, np.array([len(v) for v in sample], np.int64), width or 0), wanted) if sample else np.zeros((0, 0))
    nearest = min(NEAREST, len(pivots))

    def describe(batches):
        for batch in batches:
            likeness = _unit_of(batch.column("vec"), width) @ pivots.T
            tops = np.argsort(-likeness, axis=1, kind="stable")[:, :nearest].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(tops), pa.list_(pa.int32()))], [*batch.schema.names, "tops"])

    kind = nodes.schema["vec"].dataType.simpleString()
    described = cut(nodes.select("node", "copies", "vec").mapInArrow(describe, f"node long, copies long, vec {kind}, tops array<int>"), "described")
    listed = described.select("*", F.explode("tops").alias("pivot"))
    # One row per pivot: at most MOST of them.
    sizes = listed.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    filled = cut(listed.join(F.broadcast(sizes), "pivot").groupBy(
        "pivot", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).agg(
        F.collect_list(F.struct("node", "copies", "tops", "vec")).alias("items")), "inverted-lists")
    left = filled.select("pivot", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("items").alias("x"))
    right = filled.filter("block > 0").select("pivot", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.col("items").alias("y"))
    met = left.join(right, ["pivot", "i", "j"], "left").select("pivot", "x", "y")
    found = cut(met.mapInArrow(_verify(width or 0, min(SHARED, len(pivots)), least), "node long, other long, n long"), "vector-links")
    counts = found.filter("other < 0").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other >= 0").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    rooted = nodes.join(counts, "node", "left").join(roots, "node", "left").select(
        "vec", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = cut(rooted.groupBy("root").agg(F.min("first").alias("component")), "least-vectors")
    done = cut(rooted.join(smallest, "root").select("vec", "n_links", "component"), "linked-vectors")
    linked = valid.join(done, "vec").select("id", "n_links", "component")
    alone = named.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).select(id_back("id").alias("vec_id"), "n_links", id_back("component").alias("component_id"),
                                      (F.col("id") == F.col("component")).alias("kept"))
