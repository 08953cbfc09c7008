"""Exact percentiles without holding the values of a group in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CELLS = 4096


def exact_percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``(by, name…)``: per group the linearly interpolated percentiles named in ``shares``.

    Order statistics are found by narrowing: the value range around each wanted rank is cut into
    4,096 even cells, the cells are counted, and the one that holds the rank is cut again, each time
    between the least and the greatest value it holds. After three cuts only the rows of one cell are
    ordered by value. Infinities are values like others.
    """
    group, by = by, "_group"
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias(by), F.col(value).cast("double").alias("v")).agg(
        F.count("*").alias("c"))
    spans = counted.groupBy(by).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rank = {name: (F.col("n") - 1) * F.lit(share) for name, share in shares.items()}
    places = spans.select(by, "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), r.alias("rank"), F.floor(r).alias("low"),
                 F.least(F.floor(r) + 1, F.col("n") - 1).alias("high")) for name, r in rank.items()
    ])).alias("p")).select(by, "p.*")
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(r), F.least(F.floor(r) + 1, F.col("n") - 1)) for r in rank.values()])))
    targets = spans.select(by, F.explode(ranks).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("before"))
    for _ in range(3):
        near = counted.join(targets, by).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        width = F.col("hi") - F.col("lo")
        infinite = F.lit(float("inf"))
        even = F.least(F.floor((F.col("v") - F.col("lo")) / width * CELLS), F.lit(CELLS - 1))
        # An unbounded range is first cut into what is finite and what is not.
        cell = F.when(width == infinite, F.when(F.col("v") == -infinite, 0).when(F.col("v") == infinite, 2).otherwise(1)).when(
            width > 0, even).otherwise(0)
        cells = near.groupBy(by, "k", "before", cell.alias("cell")).agg(
            F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(by, "k").orderBy("cell"))
        targets = cells.withColumn("upto", upto).filter(
            (F.col("upto") - F.col("c") <= F.col("k")) & (F.col("k") < F.col("upto"))
        ).select(by, "k", "lo", "hi", (F.col("upto") - F.col("c")).alias("before"))
    near = counted.join(targets, by).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(by, "k").orderBy("v"))
    found = near.withColumn("upto", upto).filter(
        (F.col("upto") - F.col("c") <= F.col("k")) & (F.col("k") < F.col("upto"))).select(by, "k", "v")
    both = places.select(by, "name", "rank", "low", F.explode(F.array_distinct(F.array("low", "high"))).alias("k"))
    share = F.col("rank") - F.col("low")
    at = lambda low: F.max(F.when((F.col("k") == F.col("low")) if low else (F.col("k") > F.col("low")), F.col("v")))
    joined = both.join(found, [by, "k"]).withColumn("share", share).groupBy(by, "name", "share").agg(
        at(True).alias("a"), at(False).alias("b"))
    between = F.col("a") + (F.coalesce("b", "a") - F.col("a")) * F.col("share")
    result = joined.withColumn("q", F.when((F.col("share") == 0) | (F.coalesce("b", "a") == F.col("a")), F.col("a")).otherwise(between))
    return result.groupBy(F.col(by).alias(group)).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in shares])
