"""Connected components as joins, and spanning edges of a block of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from treecorpus.llm.common import cut, small_broadcasts


def spanning(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (first of a group, other node) that join what a boolean matrix of links joins.

    Nodes are numbered rows first, then columns. At most rows + columns edges come out, however
    many links there are.
    """
    rows, columns = links.shape
    source, target = [], []
    open_rows = links.any(axis=1)
    for r in np.flatnonzero(open_rows):
        if not open_rows[r]:
            continue
        new_rows = np.array([r])
        in_columns = np.zeros(columns, bool)
        group = []
        while len(new_rows):
            open_rows[new_rows] = False
            group.append(new_rows)
            new_columns = links[new_rows].any(axis=0) & ~in_columns
            in_columns |= new_columns
            new_rows = np.flatnonzero(links[:, new_columns].any(axis=1) & open_rows)
        others = np.r_[np.concatenate(group)[1:], rows + np.flatnonzero(in_columns)]
        source.append(np.full(len(others), r))
        target.append(others)
    if not source:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(source), np.concatenate(target)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (src, dst)``: the least node of its component.

    Alternating large and small stars: every node hands its larger neighbours, then its smaller
    ones, to the least it knows, until nothing changes (a number of rounds that grows with the
    logarithm of the longest chain). Minima are aggregated before the shuffle and written, so that
    the joins read two shuffles and a node with very many neighbours can be split.
    """

    def print_of(frame):
        return frame.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    small_broadcasts(edges.sparkSession)
    pairs = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(), "edges")
    seen = print_of(pairs)
    while seen[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        handed = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(handed.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star")
        now = print_of(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))
