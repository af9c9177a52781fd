"""Batches that commit as a whole: validation, two phases, visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown_participants(ops: DataFrame, registered: DataFrame) -> DataFrame:
    """Operations on participants that are not registered; a transaction with any must not begin."""
    return ops.join(registered, ["topic", "partition_id"], "left_anti")


def outcomes(ops: DataFrame, txn: str, valid: str, applied: str) -> DataFrame:
    """Per transaction: prepared if all its operations are valid; committed if prepared, with an error
    count where some could not be applied after the decision, which stands; else aborted."""
    per = ops.groupBy(txn).agg(
        F.count("*").alias("operations"),
        F.count_distinct("topic", "partition_id").alias("participants"),
        F.bool_and(valid).alias("prepared"),
        F.count_if(~F.col(applied)).alias("failed"),
    )
    state = F.when(~F.col("prepared"), "aborted").when(F.col("failed") > 0, "committed with errors").otherwise("committed")
    return per.select(txn, "operations", "participants", state.alias("state"), F.when(F.col("prepared"), F.col("failed")).otherwise(0).alias("errors"))


def visible(ops: DataFrame, decided: DataFrame, txn: str) -> DataFrame:
    """The operations of committed transactions only."""
    committed = decided.where(F.col("state").startswith("committed")).select(txn)
    return ops.join(committed, txn, "left_semi")


def commit_errors(commits: DataFrame, prepares: DataFrame, txn: str) -> DataFrame:
    """Commits without a prepare."""
    return commits.join(prepares, txn, "left_anti")


def timed_out(pending: DataFrame, now, seconds: int = 300) -> DataFrame:
    """Prepared transactions that nobody decided in time."""
    return pending.where(F.col("prepared_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)) < now)


def all_or_nothing(batch: DataFrame, batch_id: str, valid: str) -> DataFrame:
    """Rows of batches in which every row is valid."""
    good = batch.groupBy(batch_id).agg(F.bool_and(valid).alias("ok")).where("ok").select(batch_id)
    return batch.join(good, batch_id, "left_semi")


def participants(ops: DataFrame) -> DataFrame:
    return ops.select("topic", "partition_id").distinct()
