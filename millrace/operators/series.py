"""Frames over time: last points, moving averages and fixed-window limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import micros


def last_points(rows: DataFrame, key: str, order: str, n: int = 20) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def moving_average(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """The exponential moving average at the end of each key's rows, begun with the first value. It is a
    weighted sum, (1 - alpha)^(rows after) each, so it needs a rank and partial sums, no fold."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    ranked = rows.select(key, value, (F.row_number().over(w) - 1).alias("after"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    weight = F.pow(F.lit(1 - alpha), F.col("after")) * F.when(F.col("after") == F.col("n") - 1, 1.0).otherwise(alpha)
    return ranked.groupBy(key).agg(F.sum(weight * F.col(value)).alias("average"))


def rate_limited(requests: DataFrame, key: str, limit: int, window_s: float) -> DataFrame:
    """Each request (key, seq, ts) with whether it is allowed and how many were left. A key's window
    begins with its first request and again with the first one after it has run out, so windows depend on
    the requests before them: each key's requests stream by in order, and one window is held."""
    width = int(window_s * 1_000_000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start, count = None, 0, 0
        for batch in batches:
            allowed, left = [], []
            for who, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if who != current or at - start >= width:
                    current, start, count = who, at, 0
                allowed.append(count < limit)
                count += count < limit
                left.append(limit - count)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(allowed), pa.array(left, pa.int32())], names=["key", "seq", "allowed", "remaining"])

    rows = requests.select(F.col(key).alias("key"), "seq", micros(F.col("ts")).alias("us"))
    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.repartition("key").sortWithinPartitions("key", "us", "seq")
    return dealt.mapInArrow(fold, f"key {kind}, seq long, allowed boolean, remaining int")


def windows(log: DataFrame, length_s: int, slide_s: int | None = None) -> DataFrame:
    """Operations in tumbling or sliding event-time windows."""
    slide = f"{slide_s or length_s} seconds"
    w = F.window(F.col("ts").cast("timestamp"), f"{length_s} seconds", slide)
    rows = log.groupBy(w.alias("w"), "op").agg(F.count("*").alias("n"))
    return rows.select(F.unix_micros("w.start").alias("start_us"), "op", "n")


def sessions(log: DataFrame, key: str, gap_s: int) -> DataFrame:
    """Runs of a key's operations without a gap longer than ``gap_s``."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    us = micros(F.col("ts"))
    new = (us - F.lag(us).over(w) > gap_s * 1_000_000).cast("int")
    rows = log.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(us).alias("start_us"), F.max(us).alias("end_us"))


def token_bucket(requests: DataFrame, key: str, per_minute: float, burst: int) -> DataFrame:
    """Each request (key, seq, ts) with whether a token was there and how many are left: a bucket of
    ``burst`` tokens refills evenly. Requests of a key stream by in order; one bucket is held."""
    per_us = per_minute / 60_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, tokens = None, 0, 0.0
        for batch in batches:
            allowed, left = [], []
            for who, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if who != current:
                    current, last, tokens = who, at, float(burst)
                tokens = min(float(burst), tokens + (at - last) * per_us)
                last = at
                allowed.append(tokens >= 1)
                tokens -= tokens >= 1
                left.append(tokens)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(allowed), pa.array(left, pa.float64())], names=["key", "seq", "allowed", "tokens"])

    rows = requests.select(F.col(key).alias("key"), "seq", micros(F.col("ts")).alias("us"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.repartition("key").sortWithinPartitions("key", "us", "seq").mapInArrow(fold, f"key {kind}, seq long, allowed boolean, tokens double")


def running_balance(log: DataFrame, key: str, order: str, change) -> DataFrame:
    """Every row with the running sum of ``change`` over its key: connections, credits, depth."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("balance", F.sum(change).over(w))
