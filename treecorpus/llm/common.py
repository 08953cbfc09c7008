"""What several operators share: row identity, lineage cuts, batch slices, labelled samples."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treecorpus.session import scratch_path

#: Stands for a missing id inside operators; a row without an id sorts after all others.
NO_ID = 2**63 - 1
#: The white space of the text contracts.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def id_of(name: str) -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_back(name: str) -> Column:
    """The id as it was given."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII texts take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def fresh(frame: DataFrame, name: str) -> str:
    """The name, with underscores behind it as long as the frame has a column of that name."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: lost executors read files again."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables that :func:`cut` has written, when all that was made of them is written as well."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.inputFiles()[0]).getParent()
        path.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what one Arrow batch of texts or blocks takes in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: What Spark may broadcast on its own, in bytes as it sizes tables.
BROADCAST = 256 << 10


def small_broadcasts(spark: SparkSession) -> None:
    """Let Spark choose a broadcast only for what is small by far.

    It sizes a written table by its files, in which a row may take a byte or two, and does not count
    the rows that an explode adds, so what it takes for some megabytes may be gigabytes on the driver.
    A lower limit of the session stays.
    """
    key = "spark.sql.autoBroadcastJoinThreshold"
    now = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if now > BROADCAST:
        spark.conf.set(key, str(BROADCAST))


def slices(lengths, most: int):
    """Row ranges (a, b) of a batch that hold at most ``most`` bytes, or one row."""
    total, start = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            total, start = 0, i
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id) -> bool:
    """Whether a document's label is kept from training: crc32 of its id as text, mod 5, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Texts and labels of a bounded sample: per class the ``per_class`` ids that come first in hash order.

    Held-out ids, null ids and null labels take no part. Only the ids are gathered (at most
    2 * ``per_class``), so the documents are filtered where they are read.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out_column(F.col("doc_id")))
    chosen = []
    for value in (0, 1):
        chosen += usable.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    ids = spark.createDataFrame(sorted({(r[0], r[1]) for r in chosen}), "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Bounded: at most 2 * per_class rows of 12 bytes.
    return texts.join(F.broadcast(ids), "doc_id")


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose frames are gone.

    It does so when the driver's garbage is collected, which may be hours after the last use.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
