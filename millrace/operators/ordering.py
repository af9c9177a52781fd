"""Priority order, top-n and the selection of candidates over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import micros


def order(mode: str = "MIN") -> list[Column]:
    """The total order: priority, the earlier enqueued, the lesser id. MAX turns the priority only."""
    if mode not in ("MIN", "MAX"):
        raise ValueError(f"unknown mode {mode!r}")
    priority = F.col("priority").asc() if mode == "MIN" else F.col("priority").desc()
    return [priority, F.col("enqueued_at").asc(), F.col("message_id").asc()]


def top_n(messages: DataFrame, n: int, mode: str = "MIN") -> DataFrame:
    """The first n of the order; none for n of zero or less. No row is removed from ``messages``."""
    return messages.orderBy(*order(mode)).limit(max(0, n))


def ranked_result(top: DataFrame, mode: str = "MIN", name: str = "rank") -> DataFrame:
    """Ranks from 0 for a result that is already bounded by a limit."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order(mode))) - 1)


def candidates(messages: DataFrame, fanout: int, mode: str = "MIN") -> DataFrame:
    """Each partition's first ``fanout`` messages with their rank (from 0) in the partition. The filter
    on the rank lets the window keep no more than that in each task before the shuffle."""
    within = Window.partitionBy("topic", "partition_id").orderBy(*order(mode))
    found = messages.withColumn("candidate_rank", F.row_number().over(within))
    return found.where(F.col("candidate_rank") <= fanout).withColumn("candidate_rank", F.col("candidate_rank") - 1)


def available(found: DataFrame, partitions: DataFrame) -> DataFrame:
    """Without the candidates of unknown or throttled partitions."""
    open_ones = partitions.where(~F.col("is_throttled")).select("topic", "partition_id")
    return found.join(open_ones, ["topic", "partition_id"], "left_semi")


def select_best(
    messages: DataFrame, n: int, mode: str = "MIN", fanout: int | None = 4, bound: int = 100, partitions: DataFrame | None = None
) -> DataFrame:
    """The best n over all partitions, with ``rank``. With a fanout, each partition offers no more than
    that many, and a partition that owns more of the true best yields to others; ``None`` is exact.
    Throttled partitions are left out before anything is cut to the bound."""
    n = max(0, min(n, bound))
    found = messages if partitions is None else available(messages, partitions)
    if fanout is not None:
        found = candidates(found, fanout, mode)
    return ranked_result(top_n(found, n, mode), mode)


def rank_error(messages: DataFrame, n: int, mode: str = "MIN", fanout: int = 4) -> DataFrame:
    """What the fanout costs: each selected message's true rank over all, minus its rank here. The true
    rank is counted by comparing with the selected rows only, which are at most n."""
    best = select_best(messages, n, mode, fanout, n).select("message_id", "priority", "enqueued_at", "rank")
    mine = best.select(F.col("message_id").alias("i"), F.col("priority").alias("p"), F.col("enqueued_at").alias("e"), "rank")
    ahead = F.col("priority") < F.col("p") if mode == "MIN" else F.col("priority") > F.col("p")
    later = (F.col("enqueued_at") < F.col("e")) | ((F.col("enqueued_at") == F.col("e")) & (F.col("message_id") < F.col("i")))
    before = ahead | ((F.col("priority") == F.col("p")) & later)
    # at most n rows are broadcast; the counts are summed in each task before the shuffle
    counted = messages.select("message_id", "priority", "enqueued_at").join(F.broadcast(mine), before)
    counted = counted.groupBy("i").agg(F.count("*").alias("true_rank"))
    out = best.join(counted, best.message_id == counted.i, "left").withColumn("true_rank", F.coalesce("true_rank", F.lit(0)))
    return out.select("message_id", "rank", "true_rank", (F.col("true_rank") - F.col("rank")).alias("rank_error"))


def fresh(found: DataFrame, now: Column, most_s: float = 5.0, least_s: float = 0.1) -> DataFrame:
    """``found`` with age_us, ``stale`` (too old, a violation) and ``kept``. Zero switches a bound off."""
    age = micros(now) - micros(F.col("updated_at"))
    stale = (age > int(most_s * 1e6)) if most_s > 0 else F.lit(False)
    early = (age < int(least_s * 1e6)) if least_s > 0 else F.lit(False)
    return found.withColumns({"age_us": age, "stale": stale, "kept": ~stale & ~early})


def select_round_robin(found: DataFrame, n: int, last: int = 0, mode: str = "MIN") -> DataFrame:
    """One candidate per partition and round. Round r takes each partition's r-th, starting with the
    partition (by index among those with candidates) at (last + r) modulo their number."""
    inner = Window.partitionBy("partition_id").orderBy(*order(mode))
    found = found.withColumn("round", F.row_number().over(inner) - 1)
    found = found.where(F.col("round") < n)
    having = found.select("partition_id").distinct()
    # one row per partition
    having = having.withColumns({"index": F.row_number().over(Window.orderBy("partition_id")) - 1, "p": F.count("*").over(Window.partitionBy())})
    turn = F.pmod(F.col("index") - last - F.col("round"), F.col("p"))
    found = found.join(F.broadcast(having), "partition_id").withColumn("turn", turn)
    top = found.orderBy("round", "turn").limit(max(0, n))
    return top.withColumn("position", F.row_number().over(Window.orderBy("round", "turn")) - 1)


def select_weighted(found: DataFrame, weights: DataFrame, n: int, mode: str = "MIN") -> DataFrame:
    """Partitions share n by weight: floor(n * w / sum of w), one at least, dealt in order of partition
    until n is reached; what is left over goes to the best of the rest. Weight 0 or none counts as 1."""
    inner = Window.partitionBy("partition_id").orderBy(*order(mode))
    found = found.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= n)
    having = found.groupBy("partition_id").agg(F.count("*").alias("have"))
    w = F.coalesce(F.when(F.col("weight") != 0, F.col("weight")), F.lit(1.0))
    having = having.join(weights.select("partition_id", "weight"), "partition_id", "left").withColumn("w", w)
    total = F.sum("w").over(Window.partitionBy())
    quota = F.least(F.greatest(F.floor(F.lit(n) * F.col("w") / total), F.lit(1)), F.col("have"))
    running = Window.orderBy("partition_id").rowsBetween(Window.unboundedPreceding, -1)
    having = having.withColumn("quota", quota).withColumn("before", F.coalesce(F.sum("quota").over(running), F.lit(0)))
    having = having.withColumn("take", F.greatest(F.least(F.col("quota"), F.lit(n) - F.col("before")), F.lit(0)))
    found = found.join(F.broadcast(having.select("partition_id", "take")), "partition_id")
    by_quota = F.col("r") <= F.col("take")
    # the rest fills up in order; at most n rows of each partition have come so far
    top = found.withColumn("filled", ~by_quota).orderBy("filled", *order(mode)).limit(max(0, n))
    return top.drop("r", "take")


def page(rows: DataFrame, key: str, token: int = 0, size: int = 50) -> DataFrame:
    """One page in order of ``key``, from the offset the token names, with the next token (null on the
    last page). Sizes are held within 1 to 1000, zero means 50."""
    size = min(size or 50, 1000)
    found = rows.orderBy(key).offset(token).limit(size + 1)
    found = found.withColumn("position", F.row_number().over(Window.orderBy(key)) - 1)
    more = F.max("position").over(Window.partitionBy()) >= size
    return found.withColumn("next_token", F.when(more, token + size)).where(F.col("position") < size)


def timers_ready(delayed: DataFrame, now: Column) -> DataFrame:
    """Delayed messages whose time has come."""
    return delayed.where(F.col("not_before") <= now)


def timer_stats(delayed: DataFrame, now: Column) -> DataFrame:
    """Scheduled, the next time, and the mean of the positive delays over all entries."""
    delay = (micros(F.col("not_before")) - micros(now)) / 1e6
    return delayed.agg(
        F.count("*").alias("scheduled"),
        micros(F.min("not_before")).alias("next_ready_us"),
        (F.sum(F.greatest(delay, F.lit(0.0))) / F.count("*")).alias("mean_delay_s"),
    )
