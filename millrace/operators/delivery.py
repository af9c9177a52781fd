"""Leases and deliveries as a fold over the operation log."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import exponential_backoff, micros, seconds_after

OUTCOME = "seq long, message_id long, op string, holder string, outcome string, deadline_us long, extensions int"


class Lease:
    """The lease of one message: at most one at a time."""

    __slots__ = ("holder", "deadline", "extensions", "visibility", "extension", "most")

    def __init__(self, visibility: int, extension: int, most: int):
        self.visibility, self.extension, self.most = visibility, extension, most
        self.release()

    def release(self) -> None:
        self.holder, self.deadline, self.extensions = None, None, 0

    def apply(self, op: str, holder: str, at: int) -> str:
        """The outcome of one operation. Checks in order: a lease there, its holder, its deadline (which
        still counts), the number of extensions. A late ack or extension ends the lease; a late nack is
        taken; a pop replaces a lease that has run out."""
        if op == "POP":
            if self.holder is not None and at <= self.deadline:
                return "ALREADY_LEASED"
            outcome = "LEASED" if self.holder is None else "REDELIVERED"
            self.holder, self.deadline, self.extensions = holder, at + self.visibility, 0
            return outcome
        if op not in ("ACK", "NACK", "EXTEND"):
            return "NONE"
        if self.holder is None:
            return "NOT_FOUND"
        if holder != self.holder:
            return "INVALID_LEASE"
        if op == "NACK":
            self.release()
            return "NACKED"
        if at > self.deadline:
            self.release()
            return "LEASE_EXPIRED"
        if op == "ACK":
            self.release()
            return "ACKED"
        if self.extensions >= self.most:
            return "TOO_MANY_EXTENSIONS"
        self.deadline += self.extension
        self.extensions += 1
        return "EXTENDED"


def lease_outcomes(log: DataFrame, visibility_s: int = 30, extension_s: int = 300, max_extensions: int = 10) -> DataFrame:
    """The outcome of every operation, with the lease after it.

    A rejected pop leaves the lease as it is, so outcomes depend on all that came before. Each message's
    operations come to one task in order and are folded as they stream by: the state of one lease is all
    that is held, however long a message's log is. Extensions are capped at five minutes each.
    """
    extension = min(extension_s, 300) * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lease, current = Lease(visibility_s * 1_000_000, extension, max_extensions), None
        for batch in batches:
            outcomes, deadlines, extensions = [], [], []
            for message, op, holder, at in zip(*(batch.column(c).to_pylist() for c in ("message_id", "op", "holder", "us"))):
                if message != current:
                    current = message
                    lease.release()
                outcomes.append(lease.apply(op, holder, at))
                deadlines.append(lease.deadline)
                extensions.append(lease.extensions)
            columns = [batch.column(c) for c in ("seq", "message_id", "op", "holder")]
            columns += [pa.array(outcomes, pa.string()), pa.array(deadlines, pa.int64()), pa.array(extensions, pa.int32())]
            yield pa.record_batch(columns, names=["seq", "message_id", "op", "holder", "outcome", "deadline_us", "extensions"])

    rows = log.select("seq", "message_id", "op", "holder", micros(F.col("ts")).alias("us"))
    return rows.repartition("message_id").sortWithinPartitions("message_id", "seq").mapInArrow(fold, OUTCOME)


def ack_after_pop(log: DataFrame, ops: tuple[str, ...] = ("ACK",)) -> DataFrame:
    """Each ack with the last pop of its message before it (null if none) and the time between: an as-of
    join by a running last value, one shuffle, no join."""
    w = Window.partitionBy("message_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    popped = F.when(F.col("op") == "POP", F.struct(F.col("seq").alias("s"), F.col("ts").alias("t"), F.col("holder").alias("h")))
    rows = log.withColumn("pop", F.last(popped, ignorenulls=True).over(w)).where(F.col("op").isin(*ops))
    return rows.select(
        "seq",
        "message_id",
        "op",
        F.col("pop.s").alias("pop_seq"),
        F.col("pop.h").alias("pop_holder"),
        (micros(F.col("ts")) - micros(F.col("pop.t"))).alias("held_us"),
    )


def attempts(log: DataFrame) -> DataFrame:
    """Pops with the number of the delivery they begin."""
    w = Window.partitionBy("message_id").orderBy("seq")
    return log.where("op = 'POP'").withColumn("attempt", F.row_number().over(w)).select("seq", "message_id", "attempt")


def nacks_routed(log: DataFrame, max_retries: int = 3, backoff: Column | None = None) -> DataFrame:
    """Each nack's retry count and where the message goes: to the dead letters once its retries are used
    up, else back after its backoff (at once where that is zero)."""
    w = Window.partitionBy("message_id").orderBy("seq")
    rows = log.where("op = 'NACK'").withColumn("retry_count", F.row_number().over(w))
    wait = exponential_backoff(F.col("retry_count")) if backoff is None else backoff
    dead = F.col("retry_count") >= max_retries
    route = F.when(dead, "dlq").when(wait > 0, "delayed").otherwise("ready")
    rows = rows.withColumn("wait", wait)
    return rows.select(
        "seq",
        "message_id",
        "retry_count",
        route.alias("route"),
        F.when(~dead, micros(seconds_after(F.col("ts"), F.col("wait")))).alias("not_before_us"),
    )


def leases(log: DataFrame, visibility_s: int = 30) -> DataFrame:
    """The last pop of each message as a lease, with its deadline."""
    last = log.where("op = 'POP'").groupBy("message_id").agg(F.max(F.struct("seq", "ts", "holder")).alias("l"))
    return last.select(
        "message_id", F.col("l.holder").alias("holder"), F.col("l.ts").alias("granted_at"), seconds_after(F.col("l.ts"), F.lit(visibility_s)).alias("deadline")
    )


def expired(held: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Leases past their deadline, the first ``limit`` in key order."""
    rows = held.where(F.col("deadline") < now)
    return rows if limit is None else rows.orderBy("message_id").limit(limit)


def redelivered(held: DataFrame, finished: DataFrame, now: Column) -> DataFrame:
    """Messages whose lease ran out without an ack: ready again at once."""
    return expired(held, now).join(finished, "message_id", "left_anti")
