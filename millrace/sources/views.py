"""The relational tables seen as message tables, operation logs and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import read_table

#: What each kind of event does to the message named by its user.
OPERATIONS = {"signup": "ENQUEUE", "view": "POP", "purchase": "ACK", "error": "NACK", "click": "EXTEND"}


def order_messages(spark: SparkSession, folder: str, partitions: int = 4) -> DataFrame:
    """Ready messages, one per order: urgency 1 to 5, dealt to partitions by customer."""
    orders = read_table(spark, folder, "orders")
    return orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("message_id"),
        F.lit("orders").alias("topic"),
        (F.col("o_custkey") % partitions).cast("int").alias("partition_id"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"),
        F.col("o_orderdate").alias("enqueued_at"),
        F.col("o_custkey").cast("string").alias("partition_key"),
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("producer_id"),
        F.col("o_orderstatus").alias("payload"),
    )


def produced_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of idempotent producers: an order is a producer, a line number its sequence; lines
    arrive by ship date, and a line number that comes again is a retry."""
    line = read_table(spark, folder, "lineitem")
    key = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    cents = [F.round(F.col(c) * 100).cast("long").cast("string") for c in ("l_quantity", "l_extendedprice")]
    return line.select(
        F.concat_ws("-", *key, *cents).alias("message_id"),
        F.lit("lines").alias("topic"),
        F.col("l_orderkey").alias("producer_id"),
        F.lit(1).cast("long").alias("epoch"),
        F.col("l_linenumber").cast("long").alias("sequence"),
        F.col("l_shipdate").alias("enqueued_at"),
        F.col("l_shipdate").alias("not_before"),
        (F.col("l_linenumber") - 1).cast("int").alias("retry_count"),
        (F.col("l_suppkey") % 4).cast("int").alias("partition_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("flag"),
    )


def operations(spark: SparkSession, folder: str) -> DataFrame:
    """The operation log: one row per event, in the order of ``seq``."""
    events = read_table(spark, folder, "events")
    kind = F.create_map(*(F.lit(x) for pair in OPERATIONS.items() for x in pair))
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.col("user_id").alias("message_id"),
        (F.col("user_id") % 4).cast("int").alias("partition_id"),
        F.element_at(kind, F.col("event_type")).alias("op"),
        F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("holder"),
        F.col("value"),
        F.col("props"),
    )


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Failed deliveries: one row per error event."""
    events = read_table(spark, folder, "events").where("event_type = 'error'")
    reason = (
        F.when(F.col("value") < 10, "max retries exceeded").when(F.col("value") < 30, "Timeout waiting for ack").when(F.col("value") < 80, "handler error")
    ).otherwise("payload rejected")
    return events.select(
        F.concat(F.lit("m"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("message_id"),
        F.concat(F.lit("topic-"), (F.col("user_id") % 4).cast("string")).alias("topic"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("producer_id"),
        reason.alias("reason"),
        F.base64(F.col("props").cast("binary")).alias("payload"),
        (F.col("event_id") % 7).cast("int").alias("attempts"),
        F.col("ts").alias("moved_at"),
    )


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """A topic per brand: even brands pop the least priority first, odd ones the greatest."""
    part = read_table(spark, folder, "part")
    one = part.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("p"), F.min("p_partkey").alias("k"))
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return one.select(
        F.col("p_brand").alias("topic"),
        F.when(number % 2 == 0, "MIN").otherwise("MAX").alias("mode"),
        F.col("p").cast("int").alias("partitions"),
        (F.col("n") % 5).cast("int").alias("replication_factor"),
        F.col("n").cast("int").alias("top_k_bound"),
        F.col("k").alias("created_order"),
    )


def partition_health(spark: SparkSession, folder: str, partitions: int = 8) -> DataFrame:
    """State of each partition of the topic orders."""
    rows = spark.range(partitions).select(F.col("id").cast("int").alias("partition_id"))
    return rows.select(
        F.lit("orders").alias("topic"),
        "partition_id",
        (F.col("partition_id") % 3 == 1).alias("is_throttled"),
        (F.col("partition_id") % 5 != 4).alias("is_healthy"),
        (1.0 + F.col("partition_id") % 3).cast("double").alias("weight"),
    )
