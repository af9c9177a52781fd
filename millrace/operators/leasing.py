"""Pops with their leases, peeks, renewals and what the lease store keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import extension_seconds, lease_token, seconds_after
from millrace.operators.ordering import select_best


def pop(messages: DataFrame, n: int, holder: str, now: Column, visibility_s: int = 30, mode: str = "MIN", fanout: int | None = 4, partitions: DataFrame | None = None) -> DataFrame:
    """The best n, leased to the holder: in priority order, each with a token and a deadline. What the
    caller stores is this result; the messages left are the anti-join with it."""
    best = select_best(messages, n, mode, fanout, n, partitions)
    lease = F.struct(
        lease_token(F.col("message_id"), F.lit(1)).alias("token"),
        F.lit(holder).alias("holder"),
        now.alias("granted_at"),
        seconds_after(now, F.lit(visibility_s)).alias("deadline"),
        F.lit(0).alias("extensions"),
    )
    return best.withColumn("lease", lease)


def peek(messages: DataFrame, dead: DataFrame | None, limit: int, mode: str = "MIN") -> DataFrame:
    """The first ``limit`` (100 at most) without a lease, dead letters among them if given, with whether
    there are more."""
    limit = max(0, min(limit, 100))
    rows = messages.withColumn("is_dead", F.lit(False))
    if dead is not None:
        rows = rows.unionByName(dead.withColumn("is_dead", F.lit(True)))
    found = select_best(rows, limit + 1, mode, None, limit + 1)
    more = F.max("rank").over(Window.partitionBy()) >= limit
    return found.withColumn("has_more", more).where(F.col("rank") < limit)


def filtered(messages: DataFrame, topic: str, partition_ids: list[int] | None = None) -> DataFrame:
    rows = messages.where(F.col("topic") == topic)
    return rows if not partition_ids else rows.where(F.col("partition_id").isin(partition_ids))


def stored(held: DataFrame, grace_s: int = 300) -> DataFrame:
    """Lease rows as they are kept: until some time after their deadline."""
    return held.withColumn("expires_at", seconds_after(F.col("deadline"), F.lit(grace_s)))


def renewed(held: DataFrame, now: Column, threshold_s: int = 30, extension_s: int = 15) -> DataFrame:
    """Live leases with no more than the threshold left are renewed: deadline after the extension."""
    live = now <= F.col("deadline")
    due = live & (F.col("deadline") <= seconds_after(now, F.lit(threshold_s)))
    return held.withColumn("due", due).withColumn("deadline", F.when(due, seconds_after(F.col("deadline"), F.lit(extension_s))).otherwise(F.col("deadline")))


def extensions(tracked: DataFrame, n: str, age_s: str, most: int = 10, lifetime_s: int = 600) -> DataFrame:
    """What the extension policy allows each lease: its next extension's seconds, and why not."""
    reason = F.when(F.col(n) >= most, "too many extensions").when(F.col(age_s) > lifetime_s, "lifetime over")
    return tracked.withColumn("refused", reason).withColumn("next_s", F.when(F.col("refused").isNull(), extension_seconds(F.col(n))))


def flow_control(state: DataFrame, prefetch: int, threshold: float = 0.3) -> DataFrame:
    """Credits a consumer asks for: when its available ones fall to the threshold, what is missing to
    the prefetch after those in flight."""
    missing = F.greatest(F.lit(prefetch) - F.col("available") - F.col("in_flight"), F.lit(0))
    return state.withColumn("request", F.when(F.col("available") <= prefetch * threshold, missing).otherwise(0))


def extension_decisions(asked: DataFrame, n: str, age_s: str, late_s: str, since_s: str, foreign: str, most: int = 10, lifetime_s: int = 600, grace_s: int = 5) -> DataFrame:
    """The extension policies in their order: token, grace after the deadline, count, lifetime, and from
    the second extension on a pause that grows by half each time. Refused requests have no length."""
    pause = extension_seconds(F.col(n) - 1, base=1.0)
    reason = (
        F.when(F.col(foreign), "wrong token")
        .when(F.col(late_s) > grace_s, "grace over")
        .when(F.col(n) >= most, "too many extensions")
        .when(F.col(age_s) > lifetime_s, "lifetime over")
        .when((F.col(n) >= 1) & (F.col(since_s) < pause), "too soon")
    )
    return asked.withColumn("refused", reason).withColumn("next_s", F.when(F.col("refused").isNull(), extension_seconds(F.col(n))))
