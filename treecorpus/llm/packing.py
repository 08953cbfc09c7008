"""Packing along a space-filling curve."""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from treecorpus.llm.common import cut, id_back, id_of, slices, small_batches, small_broadcasts
from treecorpus.llm.tokens import PieceEncoder

#: Buckets of the hashed document vector, axes of its projection, and bits of each axis.
BUCKETS, AXES, BITS = 256, 4, 12
TOGETHER = 2 << 20


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """Ids by the ``tokenizers`` file; texts that hold one of its special tokens are encoded whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return PieceEncoder(
        lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)],
        lambda text: any(s in text for s in special))


def id_type(path: str, end: int | None) -> str:
    """The narrowest type for the ids of the vocabulary; what is written and shuffled is mostly ids."""
    from tokenizers import Tokenizer

    most = max([end or 0, *Tokenizer.from_file(path).get_vocab().values()])
    return "<u2" if most < 1 << 16 else "<u4"


@functools.cache
def axes() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, AXES))


def place_in_space(ids: np.ndarray) -> np.ndarray:
    """The cell of a document: its hashed bag of ids, projected and squeezed into 2**BITS steps per axis."""
    bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
    weight = np.log1p(np.bincount(bucket, minlength=BUCKETS))
    weight = weight - weight.mean()
    length = np.linalg.norm(weight)
    steps = 1 / (1 + np.exp(-1.7 * (weight / length if length else weight) @ axes()))
    return np.minimum((steps * 2**BITS).astype(np.int64), 2**BITS - 1)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates (n x axes, ``bits`` bits each).

    The published transform by Skilling: undo the rotations from the highest bit down, Gray-encode
    across the axes, and interleave the bits.
    """
    x = [c.copy() for c in np.asarray(cells, dtype=np.int64).T]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[-1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ flip) >> b) & 1)
    return key


def _tokenise(path: str, end: int | None, kind: str):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(pc.binary_length(texts).to_pylist(), TOGETHER):
                ids = encoder(path).many(texts[a:b].to_pylist())
                if end is not None:
                    ids = [np.append(x, np.uint32(end)) for x in ids]
                keys = hilbert_key(np.array([place_in_space(x) for x in ids]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc")[a:b], pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], ["doc", "key", "n", "ids"])

    return run


def tail_lengths(rest: int) -> list[int]:
    """The last, partly filled sequence as sequences of powers of two, which need no padding."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces_of(begin: int, n: int, size: int, total: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of a document's pieces, whose first id is the ``begin``-th of all."""
    out, at, stop = [], begin, begin + n
    full = total // size * size
    while at < stop:
        if at < full:
            sequence, first, length = at // size, at // size * size, size
        else:
            sequence, first = full // size, full
            for length in tail_lengths(total - full):
                if at < first + length:
                    break
                first, sequence = first + length, sequence + 1
        end = min(stop, first + length)
        out.append((at - begin, end - at, sequence, at - first))
        at = end
    return out


def pack(docs: DataFrame, path: str, size: int = 1024, end: int | None = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of all documents.

    Documents are tokenised with the ``tokenizers`` file at ``path``, followed by the id ``end``, laid
    end to end in the order of their places on a Hilbert curve through the space of projected hashed
    id counts, and cut every ``size`` ids, so neighbours in a sequence are alike. What is left at the
    very end is cut into powers of two; nothing is padded. ``ids`` is packed unsigned little-endian
    32-bit. Null and empty texts give the end id alone (no piece if ``end`` is None). Ties on the
    curve go by id; repeated rows are packed as often as they occur; other columns play no part.

    The tokenised documents are written once. Only keys and lengths are sorted: ranges of the curve
    number their own documents, and one row per range is summed in one place.
    """
    spark = docs.sparkSession
    small_batches(spark)
    small_broadcasts(spark)
    named = docs.select(id_of(id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = id_type(path, end)
    tokens = cut(named.mapInArrow(_tokenise(path, end, kind), "doc long, key long, n long, ids binary").withColumn(
        "row", F.monotonically_increasing_id()), "pack-tokens")
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(tokens.select("row", "key", "doc", "n").repartitionByRange(ranges, "key", "doc", "row").withColumn(
        "range", F.spark_partition_id()), "pack-order")
    sums = placed.groupBy("range").agg(F.sum("n").alias("ids_in"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("range", F.coalesce(F.sum("ids_in").over(upto), F.lit(0)).alias("before"))
    total = placed.agg(F.sum("n")).first()[0] or 0
    inner = Window.partitionBy("range").orderBy("key", "doc", "row").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(before, "range").select(
        "row", (F.col("before") + F.col("within")).alias("begin"))

    def cut_up(batches):
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column("ids")).to_pylist(), TOGETHER):
                docs_, begin, n, ids = (batch.column(c)[a:b].to_pylist() for c in ("doc", "begin", "n", "ids"))
                ids = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in ids]
                out = [(docs_[i], start, length, ids[i][4 * start:4 * (start + length)], n[i], sequence, offset)
                       for i in range(b - a) for start, length, sequence, offset in pieces_of(begin[i], n[i], size, total)]
                columns = list(zip(*out)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if j == 3 else pa.int64()) for j, c in enumerate(columns)],
                    ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    done = tokens.select("row", "doc", "n", "ids").join(begins, "row").mapInArrow(
        cut_up, "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return done.select(id_back("doc").alias("doc_id"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
