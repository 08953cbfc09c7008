"""Incremental operators as Structured Streaming jobs.

Each source is read with a trigger that takes what is there and stops. Results go to Parquet under
the shared folder, one folder per micro-batch (rewritten when a batch is retried), never through
the driver. The latest row per key is the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from treecorpus.functions.classify import is_sidecar
from treecorpus.functions.urls import trim_url
from treecorpus.operators import cards, judge
from treecorpus.session import scratch_path


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    # Event time must be an instant; files may hold it without a zone (taken as the session's).
    plain = [f.name for f in schema if isinstance(f.dataType, T.TimestampNTZType)]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else rows


def follow(spark: SparkSession, rows: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Run a stream over what there is since the progress in ``state``; micro-batches are folders ``epoch=n`` of ``out``."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    # An empty first batch would leave no schema to read.
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{out}/epoch=-1")
    stream = (
        rows.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(save)
        .trigger(availableNow=True).start())
    try:
        stream.awaitTermination()
    finally:
        stream.stop()


def drain(spark: SparkSession, rows: DataFrame, name: str, mode: str) -> str:
    """Run a stream over the present input; its micro-batches are folders ``epoch=n`` of the path returned."""
    out = scratch_path(spark, name)
    follow(spark, rows, out, scratch_path(spark, f"{name}-state"), mode)
    return out


def run(spark: SparkSession, rows: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over the present input and return its result."""
    out = drain(spark, rows, name, mode)
    schema = T.StructType([*rows.schema.fields, T.StructField("epoch", T.LongType())])
    saved = spark.read.schema(schema).parquet(out)
    if keys is None:
        return saved.drop("epoch")
    values = [c for c in rows.columns if c not in keys]
    return saved.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v")).select(*keys, "v.*")


def card_tallies(spark: SparkSession, claims: DataFrame, observations: DataFrame) -> DataFrame:
    """Tallies per card; verdicts are stateless, so the fold is an ordinary streaming count."""
    tallies = cards.judge_observations(claims, observations).groupBy("tool", "op").agg(
        F.count_if("verdict").alias("confirmations"), F.count_if(~F.col("verdict")).alias("contradictions"))
    done = run(spark, tallies, "tallies", "update", ["tool", "op"])
    return done.withColumn("status", cards.grounding_status(F.col("confirmations"), F.col("contradictions")))


def replay(spark: SparkSession, transitions: DataFrame, buffer: str, order: list[str], n: int) -> DataFrame:
    """The most recent ``n`` rows per buffer.

    Each micro-batch is cut to ``n`` rows per buffer, merged with the kept rows of the last version
    and written as the next version, so that memory is bounded by ``n`` per buffer.
    """
    out, state = scratch_path(spark, "replay"), scratch_path(spark, "replay-state")
    newest = Window.partitionBy(buffer).orderBy(*[F.desc(c) for c in order])
    cut = lambda rows: rows.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n).drop("age")
    spark.createDataFrame([], transitions.schema).write.parquet(f"{out}/version=-1")

    def merge(batch: DataFrame, epoch: int) -> None:
        kept = batch.sparkSession.read.schema(transitions.schema).parquet(f"{out}/version={epoch - 1}")
        cut(kept.unionByName(cut(batch))).write.mode("overwrite").parquet(f"{out}/version={epoch}")

    stream = (
        transitions.writeStream.option("checkpointLocation", state).foreachBatch(merge).trigger(availableNow=True)
        .start())
    try:
        stream.awaitTermination()
        last = stream.lastProgress["batchId"] if stream.lastProgress else -1
    finally:
        stream.stop()
    rows = spark.read.schema(transitions.schema).parquet(f"{out}/version={last}")
    return rows.withColumn("age", F.row_number().over(newest))


def judge_counters(spark: SparkSession, drafts: DataFrame, by: list[str]) -> DataFrame:
    rows = judge.judge_counters(judge.coverage(judge.parse_judge(drafts)), by)
    return run(spark, rows, "judge", "update", by)


def episode_returns(spark: SparkSession, steps: DataFrame, episode: str, gap: str, delay: str) -> DataFrame:
    """Returns per session of an episode's events; a session is emitted once the watermark passes its
    end, and rows behind the watermark are dropped."""
    sessions = (
        steps.withWatermark("ts", delay).groupBy(episode, F.session_window("ts", gap).alias("w"))
        .agg(F.sum("reward").alias("total"), F.count("*").alias("n_steps"))
        .select(episode, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n_steps"))
    return run(spark, sessions, "returns", "append")


def ingest(spark: SparkSession, records: DataFrame, order: list[str]) -> DataFrame:
    """Records of a growing source: per URL the first by ``order``, however late it arrives.

    Sidecar files are no records. State is one row per URL.
    """
    rows = records.filter(~is_sidecar(F.substring_index("path", "/", -1), F.col("body"))) if "path" in records.columns else records
    rows = rows.withColumn("url", trim_url(F.col("url")))
    others = [c for c in rows.columns if c != "url"]
    first = rows.groupBy("url").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"))
    return run(spark, first, "ingest", "update", ["url"]).select("url", "r.*")
