"""Topics, partitions and their stored rows: upserts, patches, batches, plans and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = ("m", "l", "d", "c", "t", "tc", "pi")


def upserted(stored: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with the changed rows in place of those with their key."""
    return stored.join(changes, key, "left_anti").unionByName(changes)


def last_write(ops: DataFrame, key: list[str], order: str) -> DataFrame:
    """A batch applied at once: for each key its last operation. A partial maximum, so a key written
    often moves once per task."""
    rest = [c for c in ops.columns if c not in key]
    best = F.max(F.struct(order, *(c for c in rest if c != order))).alias("w")
    return ops.groupBy(*key).agg(best).select(*key, *(F.col(f"w.{c}").alias(c) for c in rest))


def applied(stored: DataFrame, ops: DataFrame, key: list[str], order: str) -> DataFrame:
    """``stored`` after a batch of operations (op STORE or DELETE); the last one of each key holds."""
    last = last_write(ops, key, order)
    kept = last.where("op = 'STORE'").select(*stored.columns)
    return stored.join(last, key, "left_anti").unionByName(kept)


def patched(stored: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the patch's non-null values in place of their own."""
    values = [c for c in stored.columns if c != key]
    named = patch.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in values if c in patch.columns))
    rows = stored.join(named, key, "left")
    return rows.select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in patch.columns else F.col(c) for c in values))


def health_updated(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """Partition rows after health reports: a missing row is made; unhealthy with a reason throttles,
    healthy lifts the throttle."""
    rows = stored.join(reports, ["topic", "partition_id"], "full_outer")
    bad = F.col("healthy").isNotNull() & ~F.col("healthy") & (F.coalesce("reason", F.lit("")) != "")
    throttled = F.when(bad, True).when(F.col("healthy"), False).otherwise(F.coalesce("is_throttled", F.lit(False)))
    return rows.select("topic", "partition_id", F.coalesce("healthy", "is_healthy").alias("is_healthy"), throttled.alias("is_throttled"))


def partition_rows(topics: DataFrame) -> DataFrame:
    """One row per partition of each topic, numbered from 0."""
    return topics.select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition_id"))


def fanout(bound: Column, partitions: Column) -> Column:
    """How many candidates each partition offers for a bound over all: its share, within 1 and 10."""
    return F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(bound / partitions))).cast("int")


def rebalance_plan(current: DataFrame, target: DataFrame) -> DataFrame:
    """What to add and what to remove, as rows with ``action``."""
    add, remove = target.exceptAll(current), current.exceptAll(target)
    return add.withColumn("action", F.lit("add")).union(remove.withColumn("action", F.lit("remove")))


def exactly_once(produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """What breaks exactly-once, as rows (message_id, problem): lost, unknown or repeated ids."""
    counts = consumed.groupBy("message_id").agg(F.count("*").alias("n"))
    both = produced.select("message_id").distinct().withColumn("p", F.lit(True)).join(counts, "message_id", "full_outer")
    problem = F.when(F.col("n").isNull(), "lost").when(F.col("p").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return both.select("message_id", problem.alias("problem")).where("problem is not null")


def message_key(topic: Column, partition: Column, message_id: Column, prefix: str = "m") -> Column:
    return F.concat_ws("/", F.lit(prefix), topic, partition.cast("string"), message_id)


def parsed_key(key: Column) -> dict[str, Column]:
    """kind, topic, partition_id, rest and valid of a storage key. m, l and d keys have four parts, with
    more for d; c, t and pi three; tc two. Partitions must be numbers."""
    parts = F.split(key, "/")
    kind, size = F.try_element_at(parts, F.lit(1)), F.size(parts)
    number = F.try_element_at(parts, F.lit(3)).try_cast("int")
    shape = (
        F.when(kind.isin("m", "l"), (size == 4) & number.isNotNull())
        .when(kind == "d", size == 5)
        .when(kind.isin("c", "t", "pi"), (size == 3) & number.isNotNull())
        .when(kind == "tc", size == 2)
    )
    valid = F.coalesce(shape & (F.try_element_at(parts, F.lit(2)) != ""), F.lit(False))
    return {
        "kind": F.when(valid, kind),
        "topic": F.when(valid, F.try_element_at(parts, F.lit(2))),
        "partition_id": F.when(valid & kind.isin("m", "l", "c", "t", "pi"), number),
        "rest": F.when(valid & kind.isin("m", "l"), F.try_element_at(parts, F.lit(4))),
        "valid": valid,
    }


def counted_by_kind(keys: DataFrame, key: str) -> DataFrame:
    """Stored keys by kind; checkpoints and timers count together."""
    kind = F.split(F.col(key), "/")[0]
    return keys.groupBy(F.when(kind.isin("c", "t"), "snapshot").otherwise(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length(key)).alias("key_bytes"))
