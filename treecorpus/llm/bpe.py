"""Byte-level BPE encoding and decoding with overlapping chunks of long texts."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from treecorpus.llm.common import id_back, id_of, slices, small_batches
from treecorpus.llm.tokens import PieceEncoder, trusted

#: Code points of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 32_768, 2_048
#: Bytes of text that are encoded together.
TOGETHER = 2 << 20


@functools.cache
def codec(path: str, pattern: str) -> tuple[PieceEncoder, list[bytes]]:
    """The encoder and the bytes of each id, once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    engine = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for raw, rank in ranks.items():
        table[rank] = raw
    return PieceEncoder(lambda texts: list(map(engine.encode_ordinary, texts))), table


def chunk_bounds(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text of ``n`` code points; neighbours share ``overlap``."""
    starts = list(range(0, max(1, n - overlap), chunk))
    return [(a, min(n, a + chunk + overlap)) for a in starts]


CHUNK_TYPE = "doc long, digest long, copies long, chunk int, chunks int, start long, text string"


def _split(chunk: int, overlap: int):
    """Long texts as chunks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bounds = chunk_bounds(len(row["text"]), chunk, overlap)
                for i, (a, b) in enumerate(bounds):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in (
                            (row["doc"], pa.int64()), (row["digest"], pa.int64()), (row["copies"], pa.int64()),
                            (i, pa.int32()), (len(bounds), pa.int32()), (a, pa.int64()), (row["text"][a:b], pa.string()))],
                        ["doc", "digest", "copies", "chunk", "chunks", "start", "text"])

    return run


def _mark(chunk: int, overlap: int):
    """The trusted boundaries of what a chunk shares with the one before it and the one after it."""

    def run(batches):
        for batch in batches:
            heads, tails = [], []
            for row in batch.to_pylist():
                final = row["chunk"] == row["chunks"] - 1
                at = trusted(row["text"], final) + row["start"]
                heads.append([] if row["chunk"] == 0 else at[at < row["start"] + overlap].tolist())
                tails.append([] if final else at[at >= row["start"] + chunk].tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                [*batch.schema.names, "heads", "tails"])

    return run


def stitched_pieces(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Pieces ``doc, digest, copies, piece, text`` of long texts, cut where the scans of neighbouring chunks agree.

    Two scans that share a boundary agree from there on, so the first shared boundary of an overlap
    starts a new piece. The proof runs from chunk to chunk: once an overlap has no shared boundary
    (one run longer than the overlap), the rest of that text is one piece.
    """
    # Chunks of one text go to many tasks, each of which scans its own.
    chunks = docs.mapInArrow(_split(chunk, overlap), CHUNK_TYPE).repartition("doc", "digest", "chunk")
    marked = chunks.mapInArrow(_mark(chunk, overlap), CHUNK_TYPE + ", heads array<long>, tails array<long>")
    order = Window.partitionBy("doc", "digest").orderBy("chunk")
    shared = F.array_min(F.array_intersect("tails", F.lead("heads").over(order)))
    found = marked.withColumn("stop", F.when(F.col("chunk") == F.col("chunks") - 1, F.lit(2**62)).otherwise(shared)).drop("heads", "tails")
    proven = F.min(F.when(F.col("stop").isNull(), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("proven", F.coalesce(proven, F.lit(1))).withColumn("from", F.coalesce(F.lag("stop").over(order), F.lit(0)))
    # Unproven chunks go on from the first chunk without an agreement; they add only what the one before lacks.
    broken = F.when((F.col("proven") == 1) & F.col("stop").isNull(), F.col("chunk"))
    found = found.withColumn("piece", F.when(F.col("proven") == 1, F.col("chunk")).otherwise(
        F.max(broken).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    begin = F.when(F.col("proven") == 1, F.col("from")).otherwise(F.col("start") + overlap)
    end = F.when((F.col("proven") == 1) & F.col("stop").isNotNull(), F.col("stop")).otherwise(F.lit(2**62))
    text = F.substring("text", (begin - F.col("start") + 1).cast("int"), F.least(end - begin, F.lit(2**31 - 1)).cast("int"))
    parts = found.select("doc", "digest", "copies", "piece", "chunk", text.alias("text"))
    return parts.groupBy("doc", "digest", "copies", "piece").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc, ids`` per row: ids as packed little-endian unsigned 32-bit numbers.

    Texts of up to ``chunk + overlap`` code points are one piece; longer ones are chunked,
    pre-tokenised in parallel, stitched and encoded piece by piece. Null texts are empty and give no
    ids. ``doc`` is the id (``common.NO_ID`` for null). Repeated rows give a row each, and rows with
    the same id and other texts are told apart.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(id_of(id).alias("doc"), F.xxhash64(body).alias("digest"), body.alias("text"))
    is_long = F.char_length("text") > chunk + overlap

    def run(batches):
        encoder, _ = codec(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            lengths = pa.compute.binary_length(texts).to_pylist()
            for a, b in slices(lengths, TOGETHER):
                ids = [x.astype("<u4").tobytes() for x in encoder.many(texts[a:b].to_pylist())]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc", "digest", "copies", "piece")), pa.array(ids, pa.binary())],
                    ["doc", "digest", "copies", "piece", "ids"])

    schema = "doc long, digest long, copies long, piece int, ids binary"
    one = F.lit(1).cast("long").alias("copies")
    short = named.filter(~is_long).select("doc", "digest", one, F.lit(0).alias("piece"), "text").mapInArrow(run, schema)
    distinct_long = named.filter(is_long).groupBy("doc", "digest").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    pieces = stitched_pieces(distinct_long, chunk, overlap).repartition("doc", "digest", "piece").mapInArrow(run, schema)
    whole = pieces.groupBy("doc", "digest", "copies").agg(
        F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("parts"))

    def joined(batches):
        for batch in batches:
            ids = [b"".join(p["ids"] for p in parts) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("copies"), pa.array(ids, pa.binary())], ["doc", "copies", "ids"])

    whole = whole.mapInArrow(joined, "doc long, copies long, ids binary").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return short.select("doc", "ids").unionByName(whole.select("doc", "ids"))


def decode(ids: bytes, table: list[bytes]) -> bytes:
    """The concatenated bytes of the ids."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def round_trip(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of its encoding and of what it decodes to."""

    def digest(batches):
        _, table = codec(path, pattern)
        names = [str(i) for i in range(len(table))]
        for batch in batches:
            packed = batch.column("ids").to_pylist()
            listed = [" ".join(map(names.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in packed]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]),
                pa.array([hashlib.sha256(decode(x, table)).hexdigest() for x in packed])],
                ["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    done = encode(docs, path, pattern, id, text, chunk, overlap).mapInArrow(
        digest, "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.select(id_back("doc").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
