"""Usage counters, sessions and request batches, as Structured Streaming queries and their batch equivalents."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnstone.sources.files import delete, matching

FLUSH = "30 minutes"
IDLE = "60 minutes"
EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def tool_stats(events: DataFrame, name: str = "event_type") -> DataFrame:
    """tool, total, grand_total."""
    totals = events.groupBy(F.col(name).alias("tool")).agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("grand_total", F.sum("total").over(Window.partitionBy(F.lit(1))))


def load_counters(spark: SparkSession, json_text: DataFrame) -> DataFrame:
    """tool, total from JSON objects of names and numbers; below zero counts as zero, and what is no object as empty."""
    rows = spark.sql("SELECT e.key AS tool, try_variant_get(e.value, '$', 'bigint') AS total FROM {j} j, LATERAL variant_explode(try_parse_json(j.json)) e WHERE schema_of_variant(try_parse_json(j.json)) LIKE 'OBJECT%'", j=json_text)
    return rows.filter("total IS NOT NULL").select("tool", F.greatest(F.lit(0), "total").cast("long").alias("total"))


def merge_counters(base: DataFrame, delta: DataFrame) -> DataFrame:
    return base.unionByName(delta).groupBy("tool").agg(F.sum("total").alias("total"))


def tumbling(events: DataFrame, every: str = FLUSH) -> DataFrame:
    """start, tool, n of fixed windows."""
    return events.groupBy(F.window("ts", every).alias("w"), F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "tool", "n")


def sessions(events: DataFrame, idle: str = IDLE) -> DataFrame:
    """user_id, start, n of sessions that end after an idle time."""
    return events.groupBy(F.session_window("ts", idle).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def stream_events(spark: SparkSession, folder: str, schema: T.StructType = EVENT, name: str = "events.parquet") -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)


def epochs(spark: SparkSession, sink: str) -> list[int]:
    """The flushes that were written whole, oldest first."""
    return sorted(int(x.rsplit("/", 2)[1].removeprefix("epoch=")) for x in matching(spark, f"{sink}/epoch=*/_SUCCESS"))


def flush_counters(changed: DataFrame, epoch: int, sink: str, keep: int = 2) -> None:
    """Writes counters after a flush: the newest whole flush before this epoch, with the changed ones (tool, total) put in.

    Each flush has a folder of its own, so what readers have open stays whole until `keep` later ones are written; an epoch
    that is flushed again gives the same rows again.
    """
    spark = changed.sparkSession
    whole = epochs(spark, sink)
    before = [e for e in whole if e < epoch]
    new = changed.select("tool", "total", F.lit(epoch).cast("long").alias("changed"))
    if before:
        old = spark.read.parquet(f"{sink}/epoch={before[-1]}")
        new = new.unionByName(old.join(changed.select(F.col("tool").alias("of")), F.col("tool").eqNullSafe(F.col("of")), "left_anti"))
    new.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
    for old_epoch in before[: -keep] if len(before) > keep else []:
        delete(spark, f"{sink}/epoch={old_epoch}")


def flushed_counters(spark: SparkSession, sink: str, base: DataFrame | None = None) -> DataFrame:
    """tool, total of the newest whole flush, added to the base that was loaded when the counting began."""
    whole = epochs(spark, sink)
    now = spark.read.parquet(f"{sink}/epoch={whole[-1]}").select("tool", "total") if whole else spark.createDataFrame([], "tool string, total long")
    return now if base is None else merge_counters(base, now)


def count_stream(events: DataFrame, checkpoint: str, sink: str, trigger: dict[str, Any] | None = None):
    """Counts of a stream kept in state; each trigger flushes those that have changed (see flush_counters).

    In service, the trigger is {"processingTime": FLUSH}; unset, the query ends when all that is there has been counted.
    """
    counts = events.groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("total"))

    def flush(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            flush_counters(batch, epoch, sink)
        batch.unpersist()

    return counts.writeStream.outputMode("update").foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def window_stream(events: DataFrame, checkpoint: str, sink: str, every: str = FLUSH, late: str = "10 minutes"):
    """start, tool, n of fixed windows of a stream, appended when the watermark passes a window's end.

    Events that come later than `late` behind the newest one seen, after their window was written, are left out of it.
    """
    counted = tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), every)
    return counted.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """start, tool, n of the windows that a window_stream which has ended still holds in its state, not told yet."""
    held = spark.read.format("statestore").load(checkpoint)
    window, tool = held.schema["key"].dataType.names
    return held.select(F.col("key").getField(window)["start"].alias("start"), F.col("key").getField(tool).alias("tool"), F.col("value.count").alias("n"))


def session_states(events: DataFrame) -> DataFrame:
    """session, event_id, accepted: a request counts only after its session has begun; 'view' begins one, 'click' needs none."""
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(F.col("event_type") == "view", 1).otherwise(0)).over(so_far)
    return events.select(F.col("user_id").alias("session"), "event_id", ((begun == 1) | (F.col("event_type") == "click")).alias("accepted"))


REQUEST = "array<struct<id:bigint,method:string,params:string>>"


def request_batches(batches: DataFrame) -> DataFrame:
    """batch_id, id, method of the requests of JSON arrays."""
    return batches.select("batch_id", F.explode(F.from_json("body", REQUEST)).alias("q")).select("batch_id", "q.id", "q.method")


def request_status(requests: DataFrame, known: list[str]) -> DataFrame:
    """result for known methods, isError for those that fail, else a protocol error."""
    return requests.withColumn("status", F.when(~F.col("method").isin(known), "error").when(F.col("failed"), "isError").otherwise("result"))
