"""Dead letters: intake, search, replay, compaction and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import micros


def intake(moved: DataFrame, capacity: int = 10_000, order: tuple[str, ...] = ("moved_at", "message_id")) -> DataFrame:
    """What a topic's dead letters take in: each message once (its first move), up to the capacity, which
    a message that is there already does not use up. The rank filter bounds what each task passes on."""
    once = Window.partitionBy("topic", "message_id").orderBy(*order)
    first = moved.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    place = Window.partitionBy("topic").orderBy(*order)
    return first.withColumn("position", F.row_number().over(place)).where(F.col("position") <= capacity)


def decoded(payload: Column) -> Column:
    """Base64 payload as text, the payload itself where it is not Base64."""
    return F.coalesce(F.decode(F.try_to_binary(payload, F.lit("base64")), "UTF-8"), payload)


def search(letters: DataFrame, term: str) -> DataFrame:
    """Rows whose id, topic, reason, producer or payload holds the term, without regard to case."""
    fields = [F.col(c) for c in ("message_id", "topic", "reason", "producer_id")] + [decoded(F.col("payload"))]
    found = F.lit(False)
    for field in fields:
        found = found | F.coalesce(F.lower(field).contains(term.lower()), F.lit(False))
    return letters.where(found)


def filtered(
    letters: DataFrame,
    topic: str = "",
    reason: str = "",
    producer: str = "",
    since: str | None = None,
    until: str | None = None,
    min_attempts: int | None = None,
    max_attempts: int | None = None,
) -> DataFrame:
    """All the facets that are given, ends included. Topic and producer match by case, the reason does not."""
    if since and until and since > until:
        raise ValueError("since is after until")
    for n in (min_attempts, max_attempts):
        if n is not None and not 0 <= n <= 1000:
            raise ValueError("attempts must be within 0 and 1000")
    if min_attempts is not None and max_attempts is not None and min_attempts > max_attempts:
        raise ValueError("min_attempts is over max_attempts")
    rows = letters
    if topic:
        rows = rows.where(F.col("topic").contains(topic))
    if reason:
        rows = rows.where(F.lower("reason").contains(reason.lower()))
    if producer:
        rows = rows.where(F.col("producer_id").contains(producer))
    if since:
        rows = rows.where(F.col("moved_at") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        rows = rows.where(F.col("moved_at") <= F.lit(until).cast("timestamp_ntz"))
    if min_attempts is not None:
        rows = rows.where(F.col("attempts") >= min_attempts)
    if max_attempts is not None:
        rows = rows.where(F.col("attempts") <= max_attempts)
    return rows


def facets(letters: DataFrame) -> DataFrame:
    """Distinct topics, reasons and producers with their counts, as rows (facet, value, n)."""
    each = letters.select(
        F.explode(
            F.array(
                *(F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("topic", "topic"), ("reason", "reason"), ("producer", "producer_id")))
            )
        ).alias("x")
    )
    return each.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def replay(letters: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replayed, left): the named messages with their attempts at zero again, and the rest. Ids that
    are not there are ignored."""
    chosen = letters.join(ids, "message_id", "left_semi").withColumn("attempts", F.lit(0))
    return chosen, delete(letters, ids)


def delete(letters: DataFrame, ids: DataFrame) -> DataFrame:
    return letters.join(ids, "message_id", "left_anti")


def compact(letters: DataFrame, now: Column, retention_days: int = 7) -> DataFrame:
    """Without those past their retention."""
    return letters.where(F.col("moved_at") + F.make_dt_interval(F.lit(retention_days)) >= now)


def stats(letters: DataFrame, now: Column, capacity: int = 10_000, retention_days: int = 7) -> DataFrame:
    """Per topic: count, expired, the oldest move, the share of the capacity, and by how many it is over."""
    gone = F.col("moved_at") + F.make_dt_interval(F.lit(retention_days)) < now
    return letters.groupBy("topic").agg(
        F.count("*").alias("n"),
        F.count_if(gone).alias("expired"),
        micros(F.min("moved_at")).alias("oldest_us"),
        (F.count("*") / capacity).alias("usage"),
        F.greatest(F.count("*") - capacity, F.lit(0)).alias("over_capacity"),
    )


def retry_history(letters: DataFrame) -> DataFrame:
    """One row per past attempt: the i-th failed 2^(i-1) minutes after the message was moved in."""
    rows = letters.where("attempts > 0").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.col("attempts"))))
    at = micros(F.col("moved_at")) + (F.pow(F.lit(2.0), F.col("attempt") - 1) * 60_000_000).cast("long")
    return rows.select("message_id", "attempt", at.alias("failed_us"))
