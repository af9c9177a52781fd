"""Which partition a key goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import fnv1a_mod, rendezvous_weight


def rendezvous(key: Column, partitions: list[int]) -> Column:
    """The partition with the greatest weight for the key, of equals the least; null without partitions.
    Weights are compared in place, one hash per partition and row, so nothing is joined or shuffled."""
    if not partitions:
        return F.lit(None).cast("int")
    weights = [F.struct(rendezvous_weight(key, F.lit(p)).alias("w"), F.lit(-p).alias("minus")) for p in sorted(set(partitions))]
    best = F.greatest(*weights) if len(weights) > 1 else weights[0]
    return -best["minus"]


def hashed(key: Column, partitions: list[int]) -> Column:
    """The partition at FNV-1a of the key modulo their number, in the order given."""
    return F.element_at(F.array(*(F.lit(p) for p in partitions)), fnv1a_mod(key, len(partitions)).cast("int") + 1)


def moved_keys(keys: DataFrame, key: str, before: list[int], after: list[int]) -> DataFrame:
    """Keys with their partition before and after a change of topology."""
    rows = keys.select(F.col(key).alias("key"), rendezvous(F.col(key), before).alias("before"), rendezvous(F.col(key), after).alias("after"))
    return rows.withColumn("moved", F.col("before") != F.col("after"))


def topology(partitions: DataFrame) -> DataFrame:
    """Topic and its partition ids in order."""
    return partitions.groupBy("topic").agg(F.sort_array(F.collect_set("partition_id")).alias("partition_ids"))
