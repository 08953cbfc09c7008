"""The argument value spaces of a growing set of captures: a stateful stream and a merge by micro-batch.

The stream keeps the best capture of each URL. Whenever it changes, it tells every slot name that the
URL ever had what the name is now, or that it is gone. Each micro-batch of what was told is written, and
merged into a version of the index, which has for each method and slot name the fragment that comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from treecorpus.operators.slots import record_slots
from treecorpus.session import scratch_path

#: State lives beside the heap, and a batch writes what it changed, not what it holds.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
SLOT, FRAGMENT = ["schema", "name"], ["type", "required", "choices", "extracted_from"]


def changes(records: DataFrame) -> DataFrame:
    """One row per name that the best capture of a URL has, or that one of its other captures had (``there`` false)."""
    slots = record_slots(records)
    names = F.transform("slots", lambda s: F.struct(s["schema"].alias("schema"), s["name"].alias("name")))
    best = slots.groupBy("url").agg(
        F.max_by(F.struct("trust", "seq", "slots"), F.struct("trust", -F.col("seq"))).alias("b"),
        F.array_distinct(F.flatten(F.collect_set(F.array_distinct(names)))).alias("names"))
    each = best.select("url", "b", F.explode("names").alias("n"))
    own = F.filter("b.slots", lambda s: (s["schema"] == F.col("n.schema")) & (s["name"] == F.col("n.name")))
    # A body may hold a name twice: the better tier, then the earlier place.
    first = F.array_min(F.transform(own, lambda s: F.struct(s["tier"].alias("tier"), s["ord"].alias("ord"), s.alias("s"))))["s"]
    return each.withColumn("s", first).select(
        "n.schema", "n.name", "url", "b.trust", "b.seq", F.col("s").isNotNull().alias("there"),
        *[F.col(f"s.{c}") for c in ("tier", "ord", "type", "required", "choices", "extracted_from")])


def place():
    """What fragments of a name are ordered by: tier, trust from the highest, seq, URL, position."""
    return F.struct("tier", (-F.col("trust")).alias("trust"), "seq", "url", "ord")


def first_fragments(said: DataFrame) -> DataFrame:
    """The rows of ``said`` that come first under their name, of those that are there."""
    others = [c for c in said.columns if c not in SLOT]
    return said.filter("there").groupBy(*SLOT).agg(F.min_by(F.struct(*others), place()).alias("f")).select(*SLOT, "f.*")


def merged(index: DataFrame, told: DataFrame, log: DataFrame) -> DataFrame:
    """The index after ``told``, the changes of one micro-batch; ``log (…, epoch)`` is all that was told, ``told`` included.

    A name whose first fragment stays where it is takes the lesser of it and of what was told. Only names whose
    first fragment was withdrawn or moved back are looked up in the log again, by what each URL said last.
    """
    own = index.select(*SLOT, "url", place().alias("before"))
    again = told.join(own, [*SLOT, "url"]).filter(~F.col("there") | (place() > F.col("before"))).select(*SLOT).distinct()
    kept = first_fragments(index.join(again, SLOT, "left_anti").unionByName(told.join(again, SLOT, "left_anti")))
    others = [c for c in index.columns if c not in (*SLOT, "url")]
    last = log.join(again, SLOT).groupBy(*SLOT, "url").agg(F.max_by(F.struct(*others), "epoch").alias("s")).select(*SLOT, "url", "s.*")
    return kept.unionByName(first_fragments(last))


def enum_index(spark: SparkSession, records: DataFrame) -> DataFrame:
    """``schema, name, type, required, choices, extracted_from`` of the stream ``records (url, trust, seq, body)``.

    Equal to :func:`slots.patch_schema` (``schema`` PATCH) and :func:`slots.post_schema` (POST) over the
    captures of highest trust and then least ``seq`` per URL, in whatever order they arrive: a better
    fragment that comes late takes over, and what a better capture no longer has, or has as
    read-only, is withdrawn. A name may stand in any number of URLs: minima are combined before the
    shuffle, and nothing is kept per name but its first fragment.
    """
    told = changes(records)
    said, index, state = (scratch_path(spark, name) for name in ("slot-changes", "slot-index", "slot-state"))
    shape = told.schema
    logged = T.StructType([*shape.fields, T.StructField("epoch", T.LongType())])
    none = spark.createDataFrame([], shape)
    none.write.parquet(f"{said}/epoch=-1")
    none.write.parquet(f"{index}/version=-1")
    done = [-1]

    def merge(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        # A retried batch writes the same folders again.
        batch.write.mode("overwrite").parquet(f"{said}/epoch={epoch}")
        new = own.read.schema(shape).parquet(f"{said}/epoch={epoch}")
        log = own.read.schema(logged).parquet(said).filter(F.col("epoch") <= epoch)
        held = own.read.schema(shape).parquet(f"{index}/version={epoch - 1}")
        merged(held, new, log).write.mode("overwrite").parquet(f"{index}/version={epoch}")
        done.append(epoch)

    old = {key: spark.conf.get(key, None) for key in ROCKS}
    for key, value in ROCKS.items():
        spark.conf.set(key, value)
    try:
        stream = told.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(merge).trigger(availableNow=True).start()
        try:
            stream.awaitTermination()
        finally:
            stream.stop()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(shape).parquet(f"{index}/version={done[-1]}").select(*SLOT, *FRAGMENT)
