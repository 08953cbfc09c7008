"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from treecorpus.llm.common import cut, release, small_batches, small_broadcasts

#: Rows of a block; a block pair of 64 dimensions takes about 1.5 MB with its scores.
QUERY_BLOCK, ROW_BLOCK = 256, 1024
#: Cells of a score histogram.
CELLS = 2048
#: Row blocks in a file, and bytes of query blocks that are broadcast at once.
TOGETHER, ASKED = 8, 16 << 20


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(vec.isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def _blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks of at most ``size`` rows: their ids, and their floor(scale * x) as packed numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, size):
                part = vectors[start:start + size]
                lengths = np.array([len(x) for x in part], dtype=np.int64)
                width = int(lengths.max(initial=0))
                values = np.zeros((len(part), width))
                flat = np.asarray(part.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
                inside = np.arange(width)[None, :] < lengths[:, None]
                with np.errstate(over="ignore"):
                    values[inside] = np.floor(flat * scale)
                if not np.isfinite(values).all():  # beyond the doubles: numbers of any length, written out
                    whole = np.zeros((len(part), width), object)
                    whole[inside] = [floor_of(x, scale) for x in flat.tolist()]
                    values = whole
                yield pa.RecordBatch.from_pydict({
                    "ids": [ids[start:start + size].to_numpy(zero_copy_only=False).astype("<i8").tobytes()],
                    "width": pa.array([width], pa.int32()), "cells": [_packed(values)]})

    return rows.mapInArrow(pack, "ids binary, width int, cells binary")


def floor_of(x: float, scale: float) -> int:
    """floor(scale * x) for any finite x."""
    return math.floor(Fraction(x) * Fraction(scale)) if math.isinf(x * scale) else math.floor(x * scale)


#: Ahead of cells that are written out.
WRITTEN = b"written "


def _packed(values: np.ndarray) -> bytes:
    if values.dtype == object:
        return WRITTEN + " ".join(map(str, values.ravel())).encode()
    return values.astype("<f4" if np.abs(values).max(initial=0) < 2**24 else "<f8").tobytes()


def _matrix(ids: bytes, width: int, cells: bytes, to: int) -> np.ndarray:
    n = len(ids) // 8
    if cells.startswith(WRITTEN):
        values = np.zeros((n, to), object)
        values[:, :width] = np.array([int(x) for x in cells[len(WRITTEN):].split()], object).reshape(n, width)
        return values
    kind = "<f4" if len(cells) == 4 * n * width else "<f8"
    values = np.zeros((n, to))
    values[:, :width] = np.frombuffer(cells, kind).reshape(n, width)
    return values


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, and integer scores; a query's own id scores as absent (the least long)."""
    width = max(row["q_width"], row["width"])
    q, c = _matrix(row["q_ids"], row["q_width"], row["q_cells"], width), _matrix(row["ids"], row["width"], row["cells"], width)
    written = object in (q.dtype, c.dtype)
    if not written and width * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < 2**53:
        scores = (q @ c.T).astype(np.int64)
    else:  # beyond what doubles add exactly
        whole = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in c], dtype=object).T
        scores = np.clip(whole, -2**62, 2**62).astype(np.int64)
    q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
    scores[q_ids[:, None] == c_ids[None, :]] = np.iinfo(np.int64).min
    return q_ids, c_ids, scores


def _pairs(queries: DataFrame, state: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every query block, at most ``ASKED`` bytes in all, next to every row block, which stays where it is read."""
    bounds = state.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high", "need"))).alias("bounds"))
    ready = queries.join(bounds, "block").select(
        "block", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("cells").alias("q_cells"), "bounds")
    return blocks.crossJoin(F.broadcast(ready))


def ranges(sizes: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of blocks that take at most ``most`` bytes, or hold one block; ``sizes`` has number and bytes of each, which come to the driver."""
    out, held = [], 0
    for block, size in sorted(map(tuple, sizes.collect())):
        if not out or held + size > most:
            out, held = [*out, (block, block)], 0
        out[-1], held = (out[-1][0], block), held + size
    return out or [(0, 0)]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The ``k`` rows of highest score for every query: ``query_id, rank, vec_id, score``.

    A component x counts as floor(``scale`` * x) in double precision; the score is the inner
    product (a shorter vector is filled up with zeros), ties go to the smaller id, and rows that
    carry the query's own id are no candidates. Rows whose id or vector is null, or whose vector
    holds null or non-finite components, take no part. A repeated query row gets its result again;
    repeated candidate rows count each. Fewer than ``k`` candidates: all of them. Products are added
    up in whole numbers of any length; the score is a long, and what lies beyond ±2**62 is given as
    ±2**62, where the smaller id ranks first.

    Every pass scores all pairs block by block and counts scores per query in a histogram over the
    range that still holds the k-th score; cells below the block's own k-th score cannot matter and
    are not sent. When each range is one value wide, a last pass takes what reaches it. Row blocks are
    never shuffled again: queries come to them, so many at a time that a broadcast of them stays small
    however many there are.
    """
    spark = rows.sparkSession
    small_broadcasts(spark)
    small_batches(spark, 1024, "32m")

    def valid(frame):
        return frame.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec")).filter(
            F.col("id").isNotNull() & finite(F.col("vec")))

    asked, table = valid(queries), valid(rows)
    norm = F.aggregate(F.col("vec"), F.lit(0.0), lambda a, x: a + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale).cast("double"))
    most_q, n_q = asked.agg(F.max(norm), F.count("*")).first()
    most_c, n_c = table.agg(F.max(norm), F.count("*")).first()
    bound = int(min(2.0**62, math.sqrt(most_q or 0.0) * math.sqrt(most_c or 0.0) * (1 + 1e-9) + 1))
    q_blocks = cut(_blocks(asked.repartition(max(1, -(-n_q // QUERY_BLOCK))), QUERY_BLOCK, scale).withColumn(
        "block", F.monotonically_increasing_id()), "topk-queries")
    blocks = cut(_blocks(table.repartition(max(1, -(-n_c // (TOGETHER * ROW_BLOCK)))), ROW_BLOCK, scale), "topk-rows")
    turns = ranges(q_blocks.select("block", F.octet_length("cells") + F.octet_length("ids")), ASKED)
    if len(turns) == 1:
        return _found(q_blocks, blocks, k, bound)
    found = []
    for first, last in turns:
        found.append(cut(_found(q_blocks.filter(F.col("block").between(first, last)), blocks, k, bound), "topk-found"))
        release(spark)  # else the broadcasts stay on the driver
    return reduce(DataFrame.union, found)


def _found(q_blocks: DataFrame, blocks: DataFrame, k: int, bound: int) -> DataFrame:
    """:func:`top_k` of the query blocks, whose scores lie within ±``bound``."""

    def first_state(batches):
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(ids) // 8
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block] * n, pa.int64()), "place": pa.array(range(n), pa.int32()),
                    "low": pa.array([-bound] * n, pa.int64()), "high": pa.array([bound] * n, pa.int64()),
                    "need": pa.array([k] * n, pa.int32())})

    schema = "block long, place int, low long, high long, need int"
    state = q_blocks.select("block", "ids").mapInArrow(first_state, schema)

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, scores = _scores(row)
                low, high = (np.array([b[x] for b in row["bounds"]], dtype=np.int64)[:, None] for x in ("low", "high"))
                step = np.maximum(1, -(-(high - low + 1) // CELLS))
                best = -np.sort(-scores, axis=1)[:, :k] if scores.shape[1] > k else scores
                inside = (best >= low) & (best <= high)
                place, _ = np.nonzero(inside)
                cell = np.where(inside, (best - low) // step, -1)[inside]
                pairs, n = np.unique(np.c_[place, cell], axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["block"]] * len(n), pa.int64()), "place": pa.array(pairs[:, 0], pa.int32()),
                    "cell": pa.array(pairs[:, 1], pa.int64()), "n": pa.array(n, pa.int64())})

    width = 2 * bound + 1
    while width > 1:
        counted = _pairs(q_blocks, state, blocks).mapInArrow(count, "block long, place int, cell long, n long")
        cells = counted.groupBy("block", "place", "cell").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("block", "place").orderBy(F.desc("cell"))
        reached = cells.withColumn("upto", F.sum("n").over(down)).join(state, ["block", "place"])
        kth = reached.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / CELLS)).cast("long")
        kth = kth.select("block", "place", (F.col("low") + F.col("cell") * step).alias("new_low"), step.alias("step"),
                         (F.col("need") - (F.col("upto") - F.col("n"))).cast("int").alias("new_need"))
        # A query with fewer candidates than it needs keeps its lowest bound and is done.
        state = cut(state.join(kth, ["block", "place"], "left").select(
            "block", "place", F.coalesce("new_low", "low").alias("low"),
            F.when(F.col("new_low").isNull(), F.col("low")).otherwise(
                F.least(F.col("high"), F.col("new_low") + F.col("step") - 1)).alias("high"),
            F.coalesce("new_need", "need").cast("int").alias("need")), "topk-state")
        width = state.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 0

    def take(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids, scores = _scores(row)
                low = np.array([b["low"] for b in row["bounds"]], dtype=np.int64)
                out = []
                for i in range(len(q_ids)):
                    at = np.flatnonzero(scores[i] >= max(low[i], -bound))
                    at = at[np.lexsort((c_ids[at], -scores[i][at]))[:k]]
                    out += [(row["block"], i, int(q_ids[i]), int(c_ids[j]), int(scores[i][j])) for j in at]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[j], pa.int32() if j == 1 else pa.int64()) for j in range(5)],
                    ["block", "place", "query_id", "vec_id", "score"])

    found = _pairs(q_blocks, state, blocks).mapInArrow(
        take, "block long, place int, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
