"""Vectors of texts, encoded once each and kept in a table that grows by versions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from treecorpus.functions.hashing import text_digest
from treecorpus.operators.ranking import DIM, _Buckets, _dense

VECTORS = "key string, vector array<double>"
#: Texts that are encoded at a time.
BATCH = 1024


def trigram_encoder(dim: int = DIM) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder made in the task: unit vectors of trigram counts."""

    def make():
        buckets = _Buckets(dim)
        return lambda texts: _dense(pd.Series(texts), buckets)

    return make


def known_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``key, vector, version`` of all that was ever encoded into ``folder``; nothing for a new one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{VECTORS}, version int")
    return spark.read.schema(f"{VECTORS}, version int").parquet(folder)


def encoded(rows: DataFrame, text: str, folder: str, make: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> tuple[DataFrame, int]:
    """``rows`` with ``key`` and ``vector`` of their ``text``, and how many texts had to be encoded.

    A text's key is its digest, so equal texts are one entry, whatever rows they stand in, and a row
    whose text has changed finds another entry; nothing is ever rewritten. Texts without an entry are
    encoded, each once, by the function that ``make`` gives in the task, and appended as the next version, which becomes
    visible as a whole. A null text has neither key nor vector. One writer at a time.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("key", text_digest(F.col(text), 16))
    known = known_vectors(spark, folder)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    new = keyed.filter(F.col(text).isNotNull()).groupBy("key").agg(F.min(text).alias("text")).join(known.select("key"), "key", "left_anti")
    make = make or trigram_encoder()

    def encode(batches):
        encoder = make()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                vectors = np.asarray(encoder(part.column("text").to_pylist()), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(vectors), pa.list_(pa.float64()))], ["key", "vector"])

    made = 0
    if not new.isEmpty():  # a version without rows would not show among those that are known
        path = f"{folder}/version={version}"
        new.mapInArrow(encode, VECTORS).write.parquet(path)
        made = spark.read.schema(VECTORS).parquet(path).count()
    return keyed.join(known_vectors(spark, folder).select("key", "vector"), "key", "left"), made
