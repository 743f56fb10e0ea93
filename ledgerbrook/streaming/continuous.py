"""Continuous queries: named filters, per-bucket aggregates and triggers over a stream of log rows.

A stream reads parquet files as they arrive in a folder. Time is nanoseconds in the log and a Spark timestamp (of
microseconds) in the stream. Rows later than the watermark leave a bucket's aggregate unchanged here; the batch reads of
``Multilog`` are over the whole log and count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerbrook.errors import InvalidOperation
from ledgerbrook.functions.aggregates import AGGREGATES, parse_aggregate
from ledgerbrook.functions.arith import compare
from ledgerbrook.functions.types import typed_text
from ledgerbrook.operators.predicate import compiled
from ledgerbrook.operators.schema import LogSchema
from ledgerbrook.sources.multilog import nanoseconds, parse_trigger


def read_stream(spark: SparkSession, folder: str, schema: LogSchema | None = None, struct=None, files_per_batch: int = 64) -> DataFrame:
    """Rows of the parquet files in a folder, those to come included."""
    reader = spark.readStream.schema(struct if struct is not None else schema.struct()).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("recursiveFileLookup", "true").parquet(folder)


def filtered(stream: DataFrame, schema: LogSchema, expression: str) -> DataFrame:
    return stream.where(compiled(expression, schema))


def event_time(stream: DataFrame, time_column: str) -> Column:
    """The time column as an instant, for watermarks and windows."""
    ns = nanoseconds(F.col(f"`{time_column}`"), stream.schema[time_column].dataType.typeName())
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000).cast("long")))


def bucket_aggregates(stream: DataFrame, schema: LogSchema, expression: str, aggregate: str, resolution_ns: int, late: str = "10 seconds", out: str = "value") -> DataFrame:
    """(time_bucket, value) of a filter's rows per tumbling time bucket, under a watermark of ``late``."""
    if resolution_ns % 1000:
        raise InvalidOperation("streams keep microseconds; the resolution must be a whole number of them")
    name, column = parse_aggregate(aggregate)
    made = AGGREGATES.get(name)
    if made.whole is None:
        raise InvalidOperation("folds don't run on streams")
    rows = filtered(stream, schema, expression).withColumn("event_time", event_time(stream, schema.time_column)).withWatermark("event_time", late)
    grouped = rows.groupBy(F.window("event_time", f"{resolution_ns // 1000} microseconds").alias("w")).agg(made.whole(F.col(f"`{schema[column].name}`")).alias(out))
    return grouped.select(F.call_function("div", F.unix_micros("w.start") * 1000, F.lit(resolution_ns).cast("long")).alias("time_bucket"), out)


def alerts(buckets: DataFrame, name: str, expression: str, aggregate_type) -> DataFrame:
    """Alerts of one trigger over per-bucket aggregates."""
    source, op, number = parse_trigger(expression)
    value = aggregate_type.parse(number)
    text = f"{source} {op} {typed_text(aggregate_type, value)}"
    hit = buckets.where(compare(op, F.col("value"), F.lit(value), aggregate_type.name == "DOUBLE"))
    return hit.select("time_bucket", F.lit(name).alias("trigger_name"), F.lit(text).alias("trigger_expr"), F.col("value").cast("double").alias("value"))


def write_alerts(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write alerts of an updating stream, each (bucket, trigger, value) once. A batch that runs again replaces its own files."""
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates(["time_bucket", "trigger_name", "value"])
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    started = stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    del spark
    return started.trigger(**(trigger or {"availableNow": True})).start()


def read_alerts(spark: SparkSession, folder: str, begin: int | None = None, end: int | None = None, trigger: str = "") -> DataFrame:
    """Alerts written so far, without repeats, by bucket range and trigger name."""
    rows = spark.read.parquet(folder).drop("batch").dropDuplicates(["time_bucket", "trigger_name", "value"])
    if begin is not None:
        rows = rows.where(F.col("time_bucket") >= begin)
    if end is not None:
        rows = rows.where(F.col("time_bucket") <= end)
    return rows.where(F.col("trigger_name") == trigger) if trigger else rows
