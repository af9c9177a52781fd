"""Idempotent producers: duplicates, sequence windows and producer state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["topic", "producer_id", "epoch", "sequence"]


def first_wins(enqueued: DataFrame, arrival: list[str]) -> DataFrame:
    """Every row with original_id, the id of the first arrival of its key, and is_duplicate."""
    w = Window.partitionBy(*KEY).orderBy(*arrival)
    return enqueued.withColumn("original_id", F.first("message_id").over(w)).withColumn("is_duplicate", F.row_number().over(w) > 1)


def against_known(enqueued: DataFrame, known: DataFrame, now) -> DataFrame:
    """Enqueues checked against stored keys that have not expired: existing_id, null for a new one."""
    alive = known.where(F.col("expires_at") > now).select(*KEY, F.col("message_id").alias("existing_id"))
    return enqueued.join(alive, KEY, "left")


def duplicate_counts(enqueued: DataFrame) -> DataFrame:
    """Hits and misses per topic: partial counts, so no key is gathered."""
    per = enqueued.groupBy(*KEY).agg(F.count("*").alias("n"))
    return per.groupBy("topic").agg(F.count("*").alias("misses"), F.sum(F.col("n") - 1).alias("hits"))


def sequence_window(enqueued: DataFrame, size: int) -> DataFrame:
    """The ``size`` highest sequences of each producer and epoch; lower ones are forgotten."""
    keys = enqueued.select(*KEY).distinct()
    w = Window.partitionBy("topic", "producer_id", "epoch").orderBy(F.col("sequence").desc())
    return keys.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).drop("r")


def producer_windows(kept: DataFrame) -> DataFrame:
    return kept.groupBy("topic", "producer_id", "epoch").agg(
        F.count("*").alias("held"), F.min("sequence").alias("min_sequence"), F.max("sequence").alias("max_sequence")
    )


def in_order(enqueued: DataFrame, arrival: list[str]) -> DataFrame:
    """Every row with last_sequence, the greatest before it in its producer, epoch and topic, and
    whether it is in order: greater, or the first."""
    w = Window.partitionBy("topic", "producer_id", "epoch").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    rows = enqueued.withColumn("last_sequence", F.max("sequence").over(w))
    return rows.withColumn("in_order", F.coalesce(F.col("sequence") > F.col("last_sequence"), F.lit(True)))


def producer_state(enqueued: DataFrame, time: str = "enqueued_at") -> DataFrame:
    """Per producer: its latest epoch, first and last activity, messages, topics, and the greatest
    sequence of the latest epoch with the next one to expect."""
    by_epoch = enqueued.groupBy("producer_id", "epoch").agg(
        F.count("*").alias("n"),
        F.count_distinct("sequence").alias("unique_n"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        F.max("sequence").alias("last_sequence"),
        F.collect_set("topic").alias("topics"),
    )
    state = by_epoch.groupBy("producer_id").agg(
        F.max("epoch").alias("epoch"),
        F.sum("n").alias("messages"),
        F.sum(F.col("n") - F.col("unique_n")).alias("duplicates"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("last_sequence", "epoch").alias("last_sequence"),
        F.size(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("n_topics"),
    )
    return state.withColumn("next_sequence", F.coalesce(F.col("last_sequence") + 1, F.lit(1)))


def active(state: DataFrame, now, idle_days: int = 7) -> DataFrame:
    """Producers seen within the idle limit; the others are forgotten."""
    return state.where(F.col("last_seen") >= now - F.make_dt_interval(F.lit(idle_days)))


def producer_totals(enqueued: DataFrame) -> DataFrame:
    """Over all: active producers, messages, duplicates, topics; and producers by topic and by epoch, as
    rows (scope, name, producers, messages)."""
    rows = enqueued.select("producer_id", "topic", F.col("epoch").cast("string").alias("epoch"))
    sets = rows.groupingSets([[], ["topic"], ["epoch"]], "topic", "epoch")
    out = sets.agg(F.grouping("topic").alias("gt"), F.grouping("epoch").alias("ge"), F.count_distinct("producer_id").alias("producers"), F.count("*").alias("messages"))
    scope = F.when(F.col("gt") == 0, "topic").when(F.col("ge") == 0, "epoch").otherwise("all")
    return out.select(scope.alias("scope"), F.coalesce("topic", "epoch", F.lit("")).alias("name"), "producers", "messages")
