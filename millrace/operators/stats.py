"""Roll-ups, health and rates over messages, partitions and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import micros

OPS = ("ENQUEUE", "POP", "ACK", "NACK", "EXTEND")


def message_rollup(messages: DataFrame) -> DataFrame:
    """Counts for each partition, topic and over all in one pass; level 0 partition, 1 topic, 3 all."""
    rows = messages.rollup("topic", "partition_id").agg(
        F.grouping_id().alias("level"), F.count("*").alias("messages"), F.min("priority").alias("min_priority"), F.max("priority").alias("max_priority")
    )
    return rows.select(F.coalesce("topic", F.lit("*")).alias("topic"), F.coalesce("partition_id", F.lit(-1)).alias("partition_id"), "level", "messages", "min_priority", "max_priority")


def operation_counts(log: DataFrame, by: list[str]) -> DataFrame:
    """One column per kind of operation."""
    return log.groupBy(*by).agg(*(F.count_if(F.col("op") == op).alias(op.lower()) for op in OPS))


def lease_counts(held: DataFrame, now: Column) -> DataFrame:
    return held.agg(F.count("*").alias("leases"), F.count_if(F.col("deadline") >= now).alias("active"), F.count_if(F.col("deadline") < now).alias("timed_out"))


def topic_summary(per_partition: DataFrame, health: DataFrame) -> DataFrame:
    """Per topic: partitions, messages, unhealthy and throttled ones, and its state: error if any
    partition is unhealthy, warning if over a tenth of all is dead letters or over a fifth of the
    operations are retries, else healthy. ``health`` has one row per partition and is broadcast only by
    the optimizer's own size check."""
    rows = health.join(per_partition, ["topic", "partition_id"], "left").na.fill(0)
    out = rows.groupBy("topic").agg(
        F.count("*").alias("partitions"),
        F.sum("messages").alias("messages"),
        F.sum("dead").alias("dead"),
        F.sum("retries").alias("retries"),
        F.sum("operations").alias("operations"),
        F.count_if(~F.col("is_healthy")).alias("unhealthy"),
        F.count_if("is_throttled").alias("throttled"),
    )
    return out.withColumn("state", health_state(F.col("unhealthy"), F.col("dead"), F.col("messages"), F.col("retries"), F.col("operations")))


def health_state(unhealthy: Column, dead: Column, total: Column, retries: Column, operations: Column) -> Column:
    return (
        F.when(unhealthy > 0, "error").when((total > 0) & (dead > total * 0.1), "warning").when((operations > 0) & (retries > operations * 0.2), "warning")
    ).otherwise("healthy")


def status_shares(totals: DataFrame) -> DataFrame:
    """Rows (topic, status, n, share) of total, inflight and dead counts: active, in flight and dead
    letters, without empty slices."""
    active = (F.col("total") - F.col("inflight") - F.col("dead")).alias("active")
    rows = totals.select("topic", active, "inflight", "dead").unpivot("topic", ["active", "inflight", "dead"], "status", "n")
    rows = rows.where("n > 0")
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("topic")))


def rates(counts: DataFrame, age_minutes: float) -> DataFrame:
    """Success and retry rates against pops (at least one), enqueues per minute (of at least one)."""
    pops = F.greatest(F.col("pop"), F.lit(1))
    return counts.withColumns(
        {"success_rate": F.col("ack") / pops, "retry_rate": F.col("nack") / pops, "enqueues_per_minute": F.col("enqueue") / max(age_minutes, 1.0)}
    )


def series(log: DataFrame, seconds: int = 30) -> DataFrame:
    """Operations in buckets of so many seconds, with the bucket's start."""
    us = seconds * 1_000_000
    start = (F.floor(micros(F.col("ts")) / us) * us).cast("long")
    return operation_counts(log.withColumn("bucket_us", start), ["bucket_us"])


def selections(selected: DataFrame) -> DataFrame:
    return selected.groupBy("partition_id").agg(F.count("*").alias("selections"))


def worst_status(components: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts by status and the worst over all, or for each of ``by``."""
    level = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    out = components.groupBy(*by).agg(
        F.count_if(F.col("status") == "healthy").alias("healthy"),
        F.count_if(F.col("status") == "degraded").alias("degraded"),
        F.count_if(F.col("status") == "unhealthy").alias("unhealthy"),
        F.max(level).alias("level"),
    )
    worst = F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("level") + 1)
    return out.withColumn("overall", worst).drop("level")
