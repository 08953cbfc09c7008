"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.llm.common import cut, fresh, id_back, id_of, small_batches, small_broadcasts, utf8
from treecorpus.llm.components import components, spanning

#: Fingerprints in a block; a block pair compares at most 4 M of them at once.
BLOCK = 2048
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's word shingles."""
    words = text.lower().split()  # on bytes: A-Z, and the ASCII white space
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths).tolist()
    ends = ends.tolist()[min(n, width) - 1:]
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(ends)
    for a in range(0, total, AT_ONCE):
        hashes = np.array([digest(joined[p:q], seed) for p, q in zip(begins[a:a + AT_ONCE], ends[a:a + AT_ONCE])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, print`` of every row: the id (never null) and the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x, width, seed) for x in utf8(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(prints.view(np.int64))], ["doc", "print"])

    return docs.select(id_of(id).alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc long, print long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of so many segments that ``distance`` differing bits leave one with at most one."""
    n = distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(column: str, shift: int, bits: int) -> Column:
    part = F.shiftrightunsigned(column, shift)
    return part if bits == 64 else part.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Edges ``src, dst`` that join all distinct ``print`` values linked at ``distance`` or fewer bits.

    Some segment of two linked fingerprints differs by at most one bit. Segment values that differ
    in just one bit are found by an equality join of their one-wildcard variants: the side with the
    bit off meets the side with it on, so one key brings at most two values together. Fingerprints
    with equal or neighbouring segment values are then compared in blocks, and of the links of a
    block only spanning edges go on; nothing is written per pair.
    """
    small_batches(prints.sparkSession, 256)
    small_broadcasts(prints.sparkSession)
    cuts = segments(distance)
    parts = prints.select("print", F.explode(F.array(*[
        F.struct(F.lit(i).alias("segment"), _segment("print", *c).alias("value")) for i, c in enumerate(cuts)])).alias("part")).select(
        "print", "part.*")
    values = cut(parts.groupBy("segment", "value").agg(F.count("*").alias("n")), "segment-values")
    sizes = F.element_at(F.array(*[F.lit(b) for _, b in cuts]), F.col("segment") + 1)
    spots = values.select("segment", "value", "n", F.explode(F.sequence(F.lit(0), sizes - 1)).alias("spot"))
    bit = F.expr("shiftleft(1L, spot)")
    spots = spots.withColumn("on", F.col("value").bitwiseAND(bit) != 0).withColumn("rest", F.col("value").bitwiseAND(F.bitwise_not(bit)))
    off = spots.filter(~F.col("on")).select("segment", "spot", "rest", F.col("value").alias("a"), F.col("n").alias("n_a"))
    on = spots.filter("on").select("segment", "spot", "rest", F.col("value").alias("b"), F.col("n").alias("n_b"))
    # Both sides have a row per bit of a value, which Spark does not count when it sizes them.
    near = off.hint("merge").join(on.hint("merge"), ["segment", "spot", "rest"]).select("segment", "a", "n_a", "b", "n_b")
    same = values.filter("n > 1").select("segment", F.col("value").alias("a"), F.col("n").alias("n_a"),
                                         F.col("value").alias("b"), F.col("n").alias("n_b"))
    pairs = cut(near.union(same), "segment-pairs")

    def blocks(n):
        return F.ceil(F.col(n) / BLOCK).cast("long")

    asked = pairs.select("segment", F.col("a").alias("value"), F.col("n_a").alias("n")).union(
        pairs.select("segment", "b", "n_b")).distinct()
    filled = parts.join(asked, ["segment", "value"]).groupBy(
        "segment", "value", F.pmod(F.xxhash64("print"), blocks("n")).alias("block")).agg(F.collect_list("print").alias("prints"))
    filled = cut(filled, "segment-blocks")
    todo = pairs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks("n_a") - 1)).alias("i"))
    todo = todo.select("*", F.explode(F.sequence(
        F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(F.lit(0).cast("long")), blocks("n_b") - 1)).alias("j"))
    left = filled.select("segment", F.col("value").alias("a"), F.col("block").alias("i"), F.col("prints").alias("x"))
    right = filled.select("segment", F.col("value").alias("b"), F.col("block").alias("j"), F.col("prints").alias("y"))
    # Blocks are lists, which Spark sizes as if they held one number each.
    met = todo.join(left.hint("merge"), ["segment", "a", "i"]).join(right.hint("merge"), ["segment", "b", "j"]).select("x", "y")

    def verify(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x = x.values.to_numpy(zero_copy_only=False)
                y = y.values.to_numpy(zero_copy_only=False)
                close = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= distance
                close &= x[:, None] != y[None, :]
                if close.any():
                    nodes = np.r_[x, y]
                    a, b = spanning(close)
                    out.append((nodes[a], nodes[b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["src", "dst"])

    return met.mapInArrow(verify, "src long, dst long").filter("src <> dst")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, seed: int = 42, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, print, component`` of every row; ids never null, the component is its least id.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; shingles of ``width`` words
    count with repeats; a shorter text is one shingle, and a text without words (null, empty) has
    the fingerprint zero, linked like any other. Fingerprints link at ``distance`` or fewer
    differing bits; equal ones are one node, so copies cost nothing. Rows without an id come last
    (``common.NO_ID``); repeated rows get a row each; other columns play no part.
    """
    small_broadcasts(docs.sparkSession)
    rows = cut(fingerprints(docs, width, seed, id, text), "fingerprints")
    nodes = cut(rows.groupBy("print").agg(F.min("doc").alias("first")), "distinct-fingerprints")
    found = components(links(nodes.select("print"), distance))
    rooted = nodes.join(found, nodes["print"] == found["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component")), "least-ids")
    named = cut(rooted.join(least, "root").select("print", "component"), "fingerprint-components")
    return rows.join(named, "print").select("doc", "print", "component")


def drop_near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; of rows with one id all stay together.

    Texts are read as by :func:`near_duplicates`, whatever their length; no rows give no rows. All columns
    come out as they are, whatever their names.
    """
    found, name = near_duplicates(docs, width, distance), fresh(docs, "gone")
    gone = found.filter(F.col("doc") != F.col("component")).select(F.col("doc").alias(name)).distinct()
    return docs.join(gone, id_of("doc_id") == F.col(name), "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` with the fingerprint as 16 hex digits."""
    found = near_duplicates(docs)
    return found.select(id_back("doc").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
                        id_back("component").alias("component_id"))
