"""Point reads, membership, heap contents after operations, and other small reads of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import order, top_n


def found(requests: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Each request with the stored row of its key and whether there is one."""
    rows = stored.withColumn("found", F.lit(True))
    return requests.join(rows, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def after_operations(held: DataFrame, inserted: DataFrame, removed: DataFrame, extracted: int, mode: str = "MIN") -> DataFrame:
    """A heap's rows after inserts, removals by id and the extraction of its best ``extracted``."""
    rows = held.unionByName(inserted).join(removed.select("message_id").distinct(), "message_id", "left_anti")
    gone = top_n(rows, extracted, mode).select("message_id")  # bounded by the parameter
    return rows.join(F.broadcast(gone), "message_id", "left_anti")


def out_of_order(rows: DataFrame, position: str, mode: str = "MIN") -> DataFrame:
    """Rows of a stored list that come, by ``position`` in their partition, after one they should precede."""
    first = -F.col("priority") if mode == "MAX" else F.col("priority")
    key = F.struct(first.alias("p"), "enqueued_at", "message_id")
    before = F.lag(key).over(Window.partitionBy("partition_id").orderBy(position))
    return rows.withColumn("_before", before).where(F.col("_before") > key).drop("_before")


def positions(rows: DataFrame) -> DataFrame:
    """Each message's place within its partition's order, from 0."""
    w = Window.partitionBy("partition_id").orderBy(*order("MIN"))
    return rows.withColumn("position", F.row_number().over(w) - 1)


def same_key_as_before(rows: DataFrame) -> DataFrame:
    """Whether a row's comparison key but for its id is that of the row before it in its partition."""
    w = Window.partitionBy("partition_id").orderBy(*order("MIN"))
    key = F.struct("priority", "enqueued_at")
    return rows.withColumn("same", F.coalesce(F.lag(key).over(w) == key, F.lit(False)))


def by_participant(ops: DataFrame, txn: str) -> DataFrame:
    """What each participant of each transaction has to do: its operations, counted."""
    return ops.groupBy(txn, "topic", "partition_id").agg(F.count("*").alias("operations"), F.min("message_id").alias("first_message"))


def nodes(leader: Column, replicas: Column) -> Column:
    """Leader, then replicas; a node named twice is there twice."""
    return F.concat(F.array(leader), replicas)


def next_cleanup(last: Column, now: Column, every_s: int) -> tuple[Column, Column]:
    """When the next cleanup runs, and whether it is due."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(every_s))
    return F.coalesce(last, now) + step, F.coalesce(last + step <= now, F.lit(False))


def numbered(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Sequence numbers from 1 for each of ``keys``, in the order of ``by``."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def partitions_changed(stored: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(topic, partitions): sorted and without repeats, after additions and removals."""
    rows = stored.unionByName(add).join(remove, ["topic", "partition_id"], "left_anti")
    return rows.groupBy("topic").agg(F.array_sort(F.collect_set("partition_id")).alias("partitions"))
