"""The pipeline over ``documents``: quality, lines, near duplicates, repeats, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its result is
written as Parquet under the shared folder and read again. All but the last return the columns of
documents; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treecorpus.llm import line_dedup, packing, quality, shingles, suffix_dedup
from treecorpus.llm.common import cut, fresh

#: Documents that score below this are rejected.
LEAST_QUALITY = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels that are not held out, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels), LEAST_QUALITY)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten code points or more stay only in the smallest id that holds them."""
    # The operator adds counts; columns of the documents that have their names step aside meanwhile.
    aside = {c: fresh(docs, c) for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(aside)).select(*[aside.get(c, c) for c in docs.columns])
    return _counted(kept.withColumnsRenamed({new: c for c, new in aside.items()}))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of texts whose five-word shingles are 0.8 alike the smallest id stays."""
    return shingles.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier in the corpus are cut out."""
    return _counted(suffix_dedup.without_repeats(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, neighbours on the curve packed together."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("repeat_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: A trained model decides the first stage, so there is no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
