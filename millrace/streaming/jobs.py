"""The engine's live forms, as Structured Streaming queries."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.delivery import Lease
from millrace.operators.ordering import candidates, order, ranked_result, top_n
from millrace.sources.views import OPERATIONS

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Messages that share a call and its state; a checkpoint is bound to the number.
BUCKETS = 256


def event_stream(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """The operation log as a stream of new Parquet files; ``files_each`` per trigger, the counterpart of
    a consumer's credits."""
    found = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_each).parquet(folder)
    kind = F.create_map(*(F.lit(x) for pair in OPERATIONS.items() for x in pair))
    return found.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("message_id"),
        F.element_at(kind, F.col("event_type")).alias("op"),
        F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("holder"),
        "value",
    )


def first_arrivals(stream: DataFrame, key: list[str], ttl: str = "24 hours") -> DataFrame:
    """Each key once within its time to live; state older than that is dropped by the watermark."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(key)


def windowed_operations(stream: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Operations by event-time window; rows later than ``late`` are left out."""
    w = F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w, "op").agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "op", "n")


def live_outcomes(stream: DataFrame, visibility_s: int = 30, extension_s: int = 300, max_extensions: int = 10) -> DataFrame:
    """Outcomes of operations as they come in: the lease of each message is its state between batches.
    Within a batch operations are taken in order of ``seq``."""
    visibility, extension = visibility_s * 1_000_000, min(extension_s, 300) * 1_000_000

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lease = Lease(visibility, extension, max_extensions)
        if state.exists:
            (held,) = state.get
            lease.holder, lease.deadline, lease.extensions = json.loads(held)
        rows = pd.concat(list(parts)).sort_values("seq")
        out = [lease.apply(op, holder, at) for op, holder, at in zip(rows["op"], rows["holder"], rows["us"])]
        state.update((json.dumps([lease.holder, lease.deadline, lease.extensions]),))
        yield pd.DataFrame({"seq": rows["seq"].to_numpy(), "message_id": key[0], "op": rows["op"].to_numpy(), "outcome": out})

    rows = stream.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("message_id").applyInPandasWithState(
        fold, "seq long, message_id long, op string, outcome string", "lease string", "append", GroupStateTimeout.NoTimeout
    )


def lease_expiries(stream: DataFrame, visibility_s: int = 30, grace_s: int = 2) -> DataFrame:
    """(message_id, deadline_us) of each lease that ran out: a pop watches its message, another pop updates
    the deadline, an acknowledgement ends the watch. A lease runs out some grace after its deadline, when
    the message's next operation comes later than that or the watermark passes it; its state then goes, so
    what is held are the live leases only.

    Messages share state and timer by bucket, as a call for each message costs far more than what it does:
    a bucket holds the live leases of its messages, and its timer is that of the first to run out."""
    visibility, grace = visibility_s * 1_000_000, grace_s * 1000

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, deadlines = np.frombuffer(state.get[0] if state.exists else b"", np.int64).reshape(2, -1)
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values("seq")
            at = rows["us"].to_numpy()
            # what is held comes first, then the operations as they follow each other; -1: nothing to watch
            ids = np.concatenate([ids, rows["message_id"].to_numpy()])
            deadlines = np.concatenate([deadlines, np.where(rows["op"] == "POP", at + visibility, -1)])
            at = np.concatenate([np.zeros(len(ids) - len(at), np.int64), at])
            order = np.argsort(ids, kind="stable")
            ids, deadlines, at = ids[order], deadlines[order], at[order]
            last = np.append(ids[1:] != ids[:-1], True)
            late = ~last & (deadlines >= 0) & (deadlines // 1000 + grace < np.append(at[1:], 0) // 1000)
            out.append((ids[late], deadlines[late]))
            held = last & (deadlines >= 0)
            ids, deadlines = ids[held], deadlines[held]
        over = deadlines // 1000 + grace < state.getCurrentWatermarkMs()
        out.append((ids[over], deadlines[over]))
        ids, deadlines = ids[~over], deadlines[~over]
        if len(ids):
            state.update((np.stack([ids, deadlines]).tobytes(),))
            state.setTimeoutTimestamp(int(deadlines.min()) // 1000 + grace)
        elif state.exists:
            state.remove()
        ids, deadlines = (np.concatenate(x) for x in zip(*out))
        named = ids if key[0] >= 0 else pd.array([None] * len(ids), "Int64")
        yield pd.DataFrame({"message_id": named, "deadline_us": deadlines})

    rows = stream.where("op in ('POP', 'ACK')").withWatermark("ts", "0 seconds").withColumn("us", F.unix_micros("ts"))
    # operations without a message are watched as those of one message, in a bucket of their own
    bucket = F.when(F.col("message_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("message_id"), F.lit(BUCKETS)))
    rows = rows.withColumn("bucket", bucket).withColumn("message_id", F.coalesce("message_id", F.lit(0)))
    return rows.groupBy("bucket").applyInPandasWithState(
        watch, "message_id long, deadline_us long", "held binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def in_steps(spark: SparkSession, steps: list[DataFrame], job) -> DataFrame:
    """The rows of an appending ``job`` (a function of a folder's stream) to which the steps' rows come one
    after the other: each run takes up the state that the one before left in the checkpoint."""
    target, out = _folder(spark), None
    for step in steps:
        step.write.mode("append").parquet(f"{target}/landing")
        out = job(event_stream(spark, f"{target}/landing", 1 << 20))
        run_once(out.writeStream.format("parquet").outputMode("append").option("path", f"{target}/rows"), f"{target}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{target}/rows")


def best_in_steps(spark: SparkSession, steps: list[DataFrame], messages, n: int, mode: str = "MIN") -> DataFrame:
    """The best n of all steps' ``messages`` (a function of the stream), kept from step to step."""
    target, found = _folder(spark), None
    for step in steps:
        step.write.mode("append").parquet(f"{target}/landing")
        found = best_of_stream(spark, messages(event_stream(spark, f"{target}/landing", 1 << 20)), n, n, mode, f"{target}/best")
    return found


def merge_best(n: int, fanout: int, mode: str, sink: str):
    """For ``foreachBatch``: each batch's ready messages are merged with the best so far, first within
    partitions, then over them; what is kept is bounded by n."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        best = top_n(candidates(batch, fanout, mode).drop("candidate_rank"), n, mode)
        if number:
            best = top_n(best.unionByName(spark.read.parquet(f"{sink}/{number - 1}")), n, mode)
        best.write.mode("overwrite").parquet(f"{sink}/{number}")

    return merge


def best_of_stream(spark: SparkSession, stream: DataFrame, n: int, fanout: int, mode: str, sink: str) -> DataFrame:
    """Runs the stream to its present end and returns the best n with their rank."""
    writer = stream.writeStream.foreachBatch(merge_best(n, fanout, mode, sink))
    run_once(writer, f"{sink}-checkpoint")
    paths = spark._jvm.org.apache.hadoop.fs.Path(sink)
    names = [f.getPath().getName() for f in paths.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(paths)]
    return ranked_result(spark.read.parquet(f"{sink}/{max(map(int, names))}").orderBy(*order(mode)).limit(n), mode)


def run_once(writer: DataStreamWriter, checkpoint: str) -> None:
    """Everything that is there now, then stop. The checkpoint folder carries state to the next run."""
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


def results(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs an appending stream to its present end into Parquet and returns the rows written."""
    spark = stream.sparkSession
    target = _folder(spark, folder)
    run_once(stream.writeStream.format("parquet").outputMode("append").option("path", f"{target}/rows"), f"{target}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


def _folder(spark: SparkSession, folder: str | None = None) -> str:
    """A new folder below the one that driver and executors share; one of this machine in local mode only."""
    base = folder or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='millrace-')}/stream-{uuid.uuid4().hex}"
