"""Queries: streams run to their present end, compared with what batch SQL finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.common import LOG, query
from millrace.plans.deliveries import HOURS_12, lease_outcomes
from millrace.plans.common import ORACLES
from millrace.sources.tables import read_table
from millrace.streaming import jobs


@query(f"with {LOG} select message_id, op from log group by 1, 2")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The first arrival of each message and operation, within a time to live that spans the table."""
    stream = jobs.event_stream(spark, f"{folder}/events.parquet*")
    return jobs.results(jobs.first_arrivals(stream, ["message_id", "op"], "60 days")).select("message_id", "op")


@query(f"select seq, message_id, op, outcome from ({ORACLES[lease_outcomes.__name__]}) o")
def stream_pop_state(spark: SparkSession, folder: str) -> DataFrame:
    stream = jobs.event_stream(spark, f"{folder}/events.parquet*")
    return jobs.results(jobs.live_outcomes(stream, HOURS_12))


@query(f"""
with {LOG} select epoch_us(ts) // 3600000000 * 3600000000 as start_us, op, count(*) as n from log group by 1, 2
having start_us + 3600000000 <= (select epoch_us(max(ts)) - 600000000 from log)
""")
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Closed event-time windows: those the watermark has passed."""
    stream = jobs.event_stream(spark, f"{folder}/events.parquet*")
    return jobs.results(jobs.windowed_operations(stream))


def _quarters(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The event table in four deliveries, in its order."""
    events = read_table(spark, folder, "events")
    n = F.floor(F.col("event_id") * 4 / (events.agg(F.max("event_id")).first()[0] or 1))
    return [events.where(F.least(n, F.lit(3)) == k) for k in range(4)]


@query(f"with {LOG} select message_id, op from log group by 1, 2")
def stream_dedup_in_steps(spark: SparkSession, folder: str) -> DataFrame:
    """First arrivals over four runs: what an earlier run has seen stays known."""

    def job(stream: DataFrame) -> DataFrame:
        return jobs.first_arrivals(stream, ["message_id", "op"], "60 days").select("message_id", "op")

    return jobs.in_steps(spark, _quarters(spark, folder), job)


@query(f"""
with {LOG}, w as (select message_id, op, epoch_us(ts) + 30000000 as deadline_us, epoch_us(lead(ts) over (partition by message_id order by seq)) as next_us, (select max(epoch_us(ts)) from log where op in ('POP', 'ACK')) as last_us
  from log where op in ('POP', 'ACK'))
select message_id, deadline_us from w where op = 'POP' and deadline_us // 1000 + 2000 < coalesce(next_us, last_us) // 1000
""")
def stream_lease_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Leases that run out, by state timers, over four runs."""
    return jobs.in_steps(spark, _quarters(spark, folder), jobs.lease_expiries)


@query(f"""
with {LOG} select lpad(seq::varchar, 12, '0') as message_id, row_number() over (order by floor(value)::bigint, ts, lpad(seq::varchar, 12, '0')) - 1 as rank
from log where op = 'ENQUEUE' qualify rank < 20
""")
def stream_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best messages of a stream, kept from run to run."""

    def messages(stream: DataFrame) -> DataFrame:
        return stream.where("op = 'ENQUEUE'").select(
            F.lit("events").alias("topic"), (F.col("message_id") % 4).cast("int").alias("partition_id"), F.floor("value").alias("priority"), F.col("ts").alias("enqueued_at"), F.lpad(F.col("seq").cast("string"), 12, "0").alias("message_id")
        )

    return jobs.best_in_steps(spark, _quarters(spark, folder), messages, 20).select("message_id", "rank")
