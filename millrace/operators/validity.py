"""Predicates over messages, leases and configurations, and ordered validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failure(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds, null if none does. A null check does not hold."""
    return F.coalesce(*(F.when(bad, F.lit(name)) for bad, name in checks))


def split_valid(rows: DataFrame, error: Column, name: str = "error") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); the rejected keep their reason."""
    marked = rows.withColumn(name, error)
    return marked.where(F.col(name).isNull()).drop(name), marked.where(F.col(name).isNotNull())


def is_leased(deadline: Column, now: Column) -> Column:
    """A lease counts up to and including its deadline."""
    return F.coalesce(now <= deadline, F.lit(False))


def is_ready(not_before: Column, deadline: Column, now: Column) -> Column:
    return F.coalesce(not_before <= now, F.lit(True)) & ~is_leased(deadline, now)


def can_extend(extensions: Column, deadline: Column, now: Column, most: int = 5) -> Column:
    return (extensions < most) & (now <= deadline)


def can_retry(attempts: Column, most: Column) -> Column:
    return attempts < most


def message_error(message_id: Column, topic: Column, payload: Column, enqueued_at: Column, max_payload: int = 1 << 20) -> Column:
    return first_failure(
        (F.coalesce(message_id, F.lit("")) == "", "id required"),
        (F.coalesce(topic, F.lit("")) == "", "topic required"),
        (F.coalesce(F.octet_length(payload), F.lit(0)) == 0, "payload required"),
        (F.octet_length(payload) > max_payload, "payload too large"),
        (enqueued_at.isNull(), "enqueue time required"),
    )


def enqueue_error(topic: Column, payload: Column, priority: Column, delay_s: Column) -> Column:
    return first_failure(
        (F.coalesce(topic, F.lit("")) == "", "topic required"),
        (F.coalesce(F.octet_length(payload), F.lit(0)) == 0, "payload required"),
        (F.abs(priority) > 1_000_000, "priority out of range"),
        ((delay_s < 0) | (delay_s > 365 * 86_400), "delay out of range"),
    )


def bad_replication(replication: Column) -> tuple[Column, str]:
    return (replication < 1) | (replication > 7), "replication out of range"


def topic_error(
    name: Column, partitions: Column, replication: Column, bound: Column, retention_s: Column, visibility_s: Column, max_payload: Column
) -> Column:
    """A bound that is null, of a topic that has none of its own, is not checked."""
    return first_failure(
        (~F.coalesce(name, F.lit("")).rlike("^[a-zA-Z0-9_-]+$") | (F.length(name) > 255), "bad name"),
        ((partitions < 1) | (partitions > 1000), "partitions out of range"),
        bad_replication(replication),
        (replication > partitions, "replication over partitions"),
        ((bound < 1) | (bound > 10_000), "bound out of range"),
        ((retention_s <= 0) | (retention_s > 365 * 86_400), "retention out of range"),
        ((visibility_s <= 0) | (visibility_s > 12 * 3_600), "visibility out of range"),
        ((max_payload <= 0) | (max_payload > 256 << 20), "payload limit out of range"),
    )


def producer_error(producer: Column, epoch: Column) -> Column:
    return first_failure(
        (F.coalesce(producer, F.lit("")) == "", "producer required"),
        (F.length(producer) > 255, "producer too long"),
        (epoch <= 0, "epoch must be positive"),
    )


def goes_to_dead_letters(policy: Column, retry_count: Column, max_retries: Column, age_s: Column, max_ttl_s: Column) -> Column:
    """none: never; max_retries: retries used up; ttl: older than allowed."""
    return F.when(policy == "max_retries", retry_count >= max_retries).when(policy == "ttl", age_s > max_ttl_s).otherwise(False)
