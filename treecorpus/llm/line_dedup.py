"""Line dedup with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.llm.common import SPACES, ascii_lower, cut, id_of, small_broadcasts


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_length: int = 10, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped`` added.

    A key of at least ``min_length`` code points found in at least ``min_docs`` documents loses all
    its lines except in the smallest id that holds it. Null and empty texts are one empty line.
    Rows with the same id are one document, which keeps its lines in each of its rows; rows without
    an id are one document that comes last. Other columns stay; the two counts replace columns of
    that name.

    Only 128-bit hashes of the lines are grouped, so a line that a third of all documents share is
    combined before the shuffle; the join of its places is one that Spark splits when skewed. Lines
    are taken out of a text by position inside its own row.
    """
    small_broadcasts(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.struct(*own).alias("_row"), id_of(id).alias("_doc"), F.xxhash64(body).alias("_text"), F.split(body, "\n", -1).alias("_lines"))
    keyed = base.select("_doc", "_text", F.posexplode(F.transform("_lines", line_key)).alias("_place", "_key")).filter(
        F.char_length("_key") >= min_length)
    places = keyed.select("_doc", "_text", "_place", F.xxhash64("_key").alias("_h1"),
                          F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"))
    if min_docs <= 2:  # two documents differ exactly when the smallest and the largest id do
        repeated = places.groupBy("_h1", "_h2").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"))
        repeated = repeated.filter(F.col("_first") < F.col("_last")) if min_docs == 2 else repeated
    else:
        repeated = places.groupBy("_h1", "_h2").agg(
            F.min("_doc").alias("_first"), F.count_distinct("_doc").alias("_n")).filter(F.col("_n") >= min_docs)
    # Written, so that the join reads two plain shuffles: then Spark can split a line found in very many documents.
    repeated = cut(repeated.select("_h1", "_h2", "_first"), "repeated-lines")
    dropped = (
        places.join(repeated, ["_h1", "_h2"])
        .filter(F.col("_doc") != F.col("_first"))
        .groupBy("_doc", "_text").agg(F.collect_set("_place").alias("_gone")))
    none = F.array().cast("array<int>")
    joined = base.join(dropped, ["_doc", "_text"], "left").withColumn("_gone", F.coalesce("_gone", none))
    all_places = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.array_join(F.transform(F.array_except(all_places, F.col("_gone")), lambda i: F.get("_lines", i)), "\n")
    return joined.select(
        *[kept.alias(c) if c == text else F.col("_row")[c].alias(c) for c in own],
        F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"))
