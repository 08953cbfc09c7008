"""Exact positions in large orders without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treecorpus.session import scratch_path

#: Rows of a range that one task numbers.
RANGE_ROWS = 1 << 20


def hashed_position(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Add ``pos`` (0-based place in md5 order of ``seed:key``) and ``total``.

    Rows are numbered inside each of 65,536 md5 prefixes (even by construction, also for equal
    keys when ``key`` is unique) and shifted by the sizes of the smaller prefixes. The running
    sum sees at most 65,536 rows, whatever the table size.
    """
    drawn = rows.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn(
        "_prefix", F.substring("_draw", 1, 4))
    by_prefix = Window.orderBy("_prefix")
    sizes = drawn.groupBy("_prefix").agg(F.count("*").alias("_size")).select(
        "_prefix",
        (F.sum("_size").over(by_prefix) - F.col("_size")).alias("_before"),
        F.sum("_size").over(by_prefix.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("total"))
    inner = Window.partitionBy("_prefix").orderBy("_draw", key)
    return (
        drawn.withColumn("_n", F.row_number().over(inner))
        .join(sizes, "_prefix")
        .withColumn("pos", F.col("_before") + F.col("_n") - 1)
        .drop("_draw", "_prefix", "_n", "_before")
    )


def grouped_position(rows: DataFrame, group: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Add ``pos`` (0-based place by ``order`` inside ``group``).

    ``bucket`` must grow with ``order`` and hold a bounded number of rows of one group (an hour of
    events, a block of ids). A hot group is then numbered bucket by bucket in parallel; only its
    bucket sizes are summed in one place.
    """
    cut = rows.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*group, "_bucket").agg(F.count("*").alias("_size"))
    upto = Window.partitionBy(*group).orderBy("_bucket")
    before = sizes.select(*group, "_bucket", (F.sum("_size").over(upto) - F.col("_size")).alias("_before"))
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = cut.withColumn("_n", F.row_number().over(inner))
    return (
        numbered.join(before, [*group, "_bucket"])
        .withColumn("pos", (F.col("_before") + F.col("_n") - 1).cast("long"))
        .drop("_n", "_before", "_bucket")
    )


def dense_position(rows: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``pos``: the 0-based place of every row by ``order`` over the whole table.

    Rows are sorted into ranges of about ``range_rows`` (Spark samples the bounds, so the values may lie
    as unevenly as they like), numbered inside their range where they were sorted, and shifted by the
    sizes of the ranges ahead; only those sizes meet in one place. Ties are in no certain order. The
    sorted table is written, so that a lost executor does not number anew.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "ranges")
    ranges = max(1, -(-rows.count() // range_rows))
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_range", F.shiftright("_m", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size")).sort("_range").collect()  # one row per range
    before, ahead = 0, []
    for r in sizes:
        ahead.append((r["_range"], before))
        before += r["_size"]
    shift = spark.createDataFrame(ahead, "_range long, _ahead long")
    return placed.join(F.broadcast(shift), "_range").withColumn("pos", F.col("_ahead") + F.col("_m").bitwiseAND(2**33 - 1)).drop("_range", "_m", "_ahead")


def dense_index(rows: DataFrame, key: str, order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``key, id``: the distinct keys numbered from 0 by their first ``order``, ties by key.

    The same table is the inverse: join it on ``id``.
    """
    firsts = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return dense_position(firsts, ["_first", key], range_rows).select(key, F.col("pos").alias("id"))


def one_hot(id: Column, size: int) -> Column:
    """An array of ``size`` zeros with a one at place ``id``; all zeros for an id outside."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == id, 1).otherwise(0))
