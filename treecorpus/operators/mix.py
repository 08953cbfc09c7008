"""Composing sources: dedup by trust, hash split, sampling, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from treecorpus.functions.hashing import md5_fraction, unit_hash
from treecorpus.operators.positions import hashed_position
from treecorpus.schemas import TRUST, trust_name


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Concatenate sources; ``(adapter, seq)`` keeps the order of adapters and of rows in each."""
    tagged = [s.withColumn("adapter", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged)


def dedup_by_trust(records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per URL: highest trust, earliest on a tie; ``pos`` is the URL's first appearance.

    max_by/min combine before the shuffle, so a URL copied into a third of all rows costs one
    partial row per map task.
    """
    order = order or ["seq"]
    cols = [c for c in records.columns if c != "url"]
    earliest = F.struct(*[(-F.col(c)).alias(c) for c in order])
    return (
        records.groupBy("url")
        .agg(F.max_by(F.struct(*cols), F.struct(F.col("trust").alias("t"), earliest.alias("e"))).alias("r"),
             F.min(F.struct(*order)).alias("pos"))
        .select("url", "r.*", "pos")
    )


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order``."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys seen more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def hash_split(records: DataFrame, fraction: float = 0.15, floor: str = "REAL", seed: int = 0,
               mode: str = "md5") -> DataFrame:
    """``split``: eval when trust is at the floor and the URL's hash is below the fraction.

    The hash depends only on the URL, so a larger fraction gives a superset of eval rows.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"eval fraction must be in [0.0, 1.0], got {fraction}")
    held = (F.col("trust") >= TRUST[floor]) & (unit_hash(F.col("url"), seed, mode) < fraction)
    return records.withColumn("split", F.when(held, "eval").otherwise("train"))


def split_policy_id(fraction: float = 0.15, floor: str = "REAL", seed: int = 0) -> str:
    return f"floor={floor}:frac={fraction}:seed={seed}"


def mix_manifest(records: DataFrame, policy: str) -> DataFrame:
    """``(dimension, key, n, n_train, n_eval, policy)`` by source, trust and vendor, and the total."""
    rows = records.select(
        "source", trust_name(F.col("trust")).alias("trust"),
        F.coalesce(F.nullif("vendor", F.lit("")), F.lit("unknown")).alias("vendor"), "split")
    counted = rows.groupingSets(
        [["source"], ["trust"], ["vendor"], []], "source", "trust", "vendor"
    ).agg(
        F.grouping_id("source", "trust", "vendor").alias("gid"), F.count("*").alias("n"),
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "eval").alias("n_eval"))
    dimension = F.when(F.col("gid") == 3, "source").when(F.col("gid") == 5, "trust").when(
        F.col("gid") == 6, "vendor").otherwise("total")
    return counted.select(
        dimension.alias("dimension"), F.coalesce("source", "trust", "vendor", F.lit("")).alias("key"),
        "n", "n_train", "n_eval", F.lit(policy).alias("policy"))


def seeded_split(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Exactly ``int(n * ratio)`` rows go to ``train``, chosen by hashed order."""
    placed = hashed_position(rows, key, seed)
    cut = F.floor(F.col("total") * F.lit(ratio))
    return placed.withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("rest")).drop("pos", "total")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by hashed order (all when there are fewer, none when ``n`` is not positive).

    Each task sends its first ``n`` rows only; the table is not shuffled.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.orderBy(draw, key).limit(max(n, 0))


def sample_contexts(candidates: DataFrame, records: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """For each ``candidate`` draw ``k`` different records: ``(candidate, slot, record…)``.

    The draws are indices into the hashed order of the records, so the sample is an equi-join on
    the index; candidates never meet all records.
    """
    if k not in (1, 2, 3):
        raise ValueError("sample width must be one of 1, 2, or 3")
    placed = hashed_position(records, key, seed)
    size = records.agg(F.count("*")).scalar()
    draws = []
    for slot in range(k):
        name = F.concat(F.lit(f"{seed}:{slot}:"), F.col("candidate").cast("string"))
        at = F.floor(md5_fraction(name) * (size - slot))
        # Step over the earlier picks, smallest first, so that all picks differ.
        for earlier in _ascending(draws):
            at = at + F.when(at >= earlier, 1).otherwise(0)
        draws.append(at)
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), d.cast("long").alias("pos")) for i, d in enumerate(draws)])
    asked = candidates.select("candidate", F.explode(slots).alias("s")).select("candidate", "s.slot", "s.pos")
    return asked.join(placed.drop("total"), "pos").drop("pos")


def _ascending(picks: list[Column]) -> list[Column]:
    if len(picks) < 2:
        return picks
    return [F.least(*picks), F.greatest(*picks)]


def sample_endpoints(rows: DataFrame, key: str, batch: int, seed: int) -> DataFrame:
    """``batch`` draws with replacement: ``(draw, row…)``."""
    placed = hashed_position(rows, key, seed)
    size = rows.agg(F.count("*")).scalar()
    draws = rows.sparkSession.range(batch).select(
        F.col("id").alias("draw"),
        F.floor(md5_fraction(F.concat(F.lit(f"{seed}:draw:"), F.col("id").cast("string"))) * size).alias("pos"))
    return draws.join(placed.drop("total"), "pos").drop("pos")


def entry_point(records: DataFrame) -> DataFrame:
    """The shortest URL, earliest on a tie."""
    return records.agg(F.min_by("url", F.struct(F.length("url"), "seq")).alias("url"))
