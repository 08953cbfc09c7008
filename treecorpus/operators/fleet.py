"""Fleet reports: health, predicates, log archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Severities from best to worst.
SEVERITY = ["OK", "Warning", "Critical"]


def severity(health: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), health) - 1


def health_rollup(resources: DataFrame, required: list[str]) -> DataFrame:
    """Per host: worst health, resources without a status, missing required classes, pass flag.

    ``resources(host, class, body)``; a host passes when nothing is Critical.
    """
    health = F.get_json_object("body", "$.Status.Health")
    rows = resources.select("host", "class", health.alias("health"))
    seen = [F.max((F.col("class") == c).cast("int")) for c in required]
    absent = F.lit(len(required))
    for flag in seen:
        absent = absent - F.coalesce(flag, F.lit(0))
    worst = F.max(severity(F.col("health")))
    return rows.groupBy("host").agg(
        F.count("*").alias("n"), worst.cast("int").alias("worst_rank"),
        F.count_if(F.col("health").isNull()).alias("n_without_status"), absent.cast("int").alias("n_missing_classes"),
        F.coalesce(worst < 2, F.lit(True)).alias("passed"))


def class_health(resources: DataFrame) -> DataFrame:
    """Resources per host class and health."""
    health = F.coalesce(F.get_json_object("body", "$.Status.Health"), F.lit("missing"))
    return resources.groupBy("class", health.alias("health")).agg(F.count("*").alias("n"))


def fleet_predicate(leaves: DataFrame, predicates: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(url, n_held, done)``: a node is done when every predicate ``(path, value)`` holds on it.

    ``by`` are the columns that say whose URL it is. Predicates are distinct pairs, so two that ask a path for different values never both hold.
    """
    asked = predicates.select("path", "value").distinct()
    held = leaves.join(asked, ["path", "value"], "left_semi").select(*by, "url", "path", "value").distinct().groupBy(*by, "url").agg(
        F.count("*").alias("n_held"))
    wanted = asked.agg(F.count("*")).scalar()
    return nodes.select(*by, "url").join(held, [*by, "url"], "left").select(
        *by, "url", F.coalesce("n_held", F.lit(0)).alias("n_held"),
        (F.coalesce("n_held", F.lit(0)) == wanted).alias("done"))


def log_archive_since(entries: DataFrame, start: str, by: list[str]) -> DataFrame:
    """Entries at or after ``start`` per group, with their time range."""
    return entries.filter(F.col("ts") >= F.lit(start).cast("timestamp")).groupBy(*by).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
