"""Queries: leases, retries, dead letters, transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import deadletter, delivery, transactions, validity
from millrace.plans.common import EVENTS_NOW, LETTERS, LINES, LINES_NOW, LOG, query
from millrace.sources import views

HOURS_12 = 12 * 3600


def _now(at: str):
    return F.lit(at).cast("timestamp_ntz")


@query(f"""
with recursive {LOG}, o as (
  select *, epoch_us(ts) as us, row_number() over (partition by message_id order by seq) as n from log
), f as (
  select message_id, 0::bigint as n, null::bigint as seq, null::varchar as op, null::varchar as holder, null::varchar as outcome,
         null::varchar as lh, null::bigint as dl, 0 as ext from (select distinct message_id from o)
  union all
  select message_id, n, seq, op, holder, outcome,
    case when outcome in ('LEASED', 'REDELIVERED') then holder when outcome in ('NACKED', 'ACKED', 'LEASE_EXPIRED') then null else lh end,
    case when outcome in ('LEASED', 'REDELIVERED') then us + {HOURS_12}000000 when outcome in ('NACKED', 'ACKED', 'LEASE_EXPIRED') then null
         when outcome = 'EXTENDED' then dl + 300000000 else dl end,
    case when outcome in ('LEASED', 'REDELIVERED', 'NACKED', 'ACKED', 'LEASE_EXPIRED') then 0 when outcome = 'EXTENDED' then ext + 1 else ext end
  from (
    select o.message_id, o.n, o.seq, o.op, o.holder, o.us, f.lh, f.dl, f.ext,
      case when o.op = 'POP' then case when f.lh is null then 'LEASED' when o.us <= f.dl then 'ALREADY_LEASED' else 'REDELIVERED' end
           when o.op = 'ENQUEUE' then 'NONE'
           when f.lh is null then 'NOT_FOUND' when o.holder != f.lh then 'INVALID_LEASE'
           when o.op = 'NACK' then 'NACKED' when o.us > f.dl then 'LEASE_EXPIRED'
           when o.op = 'ACK' then 'ACKED' when f.ext >= 10 then 'TOO_MANY_EXTENSIONS' else 'EXTENDED' end as outcome
    from f join o on o.message_id = f.message_id and o.n = f.n + 1
  ) s
)
select seq, message_id, op, holder, outcome, dl as deadline_us, ext::int as extensions from f where n > 0
""")
def lease_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.lease_outcomes(views.operations(spark, folder), HOURS_12)


@query(f"""
with {LOG}
select a.seq, a.message_id, a.op, p.seq as pop_seq, p.holder as pop_holder, epoch_us(a.ts) - epoch_us(p.ts) as held_us
from (select * from log where op = 'ACK') a asof left join (select * from log where op = 'POP') p on a.message_id = p.message_id and a.seq > p.seq
""")
def ack_asof_pop(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.ack_after_pop(views.operations(spark, folder))


@query(f"with {LOG} select seq, message_id, row_number() over (partition by message_id order by seq)::int as attempt from log where op = 'POP'")
def delivery_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.attempts(views.operations(spark, folder))


@query(f"""
with {LOG}, n as (select *, row_number() over (partition by message_id order by seq)::int as retry_count from log where op = 'NACK')
select seq, message_id, retry_count, case when retry_count >= 5 then 'dlq' else 'delayed' end as route,
  case when retry_count < 5 then epoch_us(ts) + (least(pow(2, retry_count - 1), 300) * 1000000)::bigint end as not_before_us
from n
""")
def nack_route(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.nacks_routed(views.operations(spark, folder), max_retries=5)


LEASE_SQL = f"""lease as (
  select message_id, arg_max(holder, seq) as holder, arg_max(ts, seq) as granted_at, arg_max(ts, seq) + interval 12 hour as deadline from log where op = 'POP' group by 1
)"""


@query(f"with {LOG}, {LEASE_SQL} select message_id, holder, epoch_us(deadline) as deadline_us from lease where deadline < timestamp '2024-01-30 00:00:00' order by message_id limit 20")
def expired_leases(spark: SparkSession, folder: str) -> DataFrame:
    held = delivery.leases(views.operations(spark, folder), HOURS_12)
    rows = delivery.expired(held, _now("2024-01-30 00:00:00"), 20)
    return rows.select("message_id", "holder", scalars.micros(F.col("deadline")).alias("deadline_us"))


@query(f"""
with {LOG}, {LEASE_SQL} select message_id from lease where deadline < timestamp '2024-01-30 00:00:00'
and message_id not in (select message_id from log where op = 'ACK' and ts >= timestamp '2024-01-29 00:00:00')
""")
def lease_gc(spark: SparkSession, folder: str) -> DataFrame:
    log = views.operations(spark, folder)
    done = log.where((F.col("op") == "ACK") & (F.col("ts") >= _now("2024-01-29 00:00:00"))).select("message_id").distinct()
    return delivery.redelivered(delivery.leases(log, HOURS_12), done, _now("2024-01-30 00:00:00")).select("message_id")


@query(f"""
with {LINES} select message_id, retry_count, case when retry_count <= 0 then 0 else least(pow(2.0, retry_count - 1.0), 60.0) end as exponential_s,
  case when retry_count <= 0 then 0 else least(1.0 + (retry_count - 1), 10.0)::double end as linear_s, least(pow(2.0, least(retry_count, 20)), 300.0) as partition_s from line
""")
def backoff_delays(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("retry_count")
    return views.produced_lines(spark, folder).select(
        "message_id",
        "retry_count",
        scalars.exponential_backoff(n, most=60.0).alias("exponential_s"),
        scalars.linear_backoff(n, most=10.0).alias("linear_s"),
        scalars.partition_backoff(n).alias("partition_s"),
    )


@query(f"""
with {LINES}, d as (
  select message_id, case when retry_count <= 0 then 0.0 else least(power(2.0, retry_count - 1.0), 300.0) end::double as d,
         ('0x' || substr(md5(message_id), 1, 13))::bigint::double / 4503599627370496.0 as u from line
)
select message_id, d as none_s, d * u as full_s, d / 2 + d / 2 * u as equal_s, d + greatest(least(d * 3, 300.0) - d, 0.0) * u as decorrelated_s from d
""")
def backoff_jitter(spark: SparkSession, folder: str) -> DataFrame:
    """The delay of each retry under each kind of jitter."""
    delay, u = scalars.exponential_backoff(F.col("retry_count")), scalars.unit_hash(F.col("message_id"))
    rows = views.produced_lines(spark, folder)
    return rows.select("message_id", *(scalars.jittered(delay, how, u).alias(f"{how}_s") for how in ("none", "full", "equal", "decorrelated")))


@query(f"""
with {LINES} select message_id, deadline_left, is_leased, not_before <= timestamp '{LINES_NOW}' and not is_leased as is_ready, is_leased and sequence - 1 < 5 as can_extend from (
  select *, not_before + to_days((retry_count * 10)::int) >= timestamp '{LINES_NOW}' and flag = 'A' as is_leased,
    case when flag = 'A' then greatest(datediff('second', timestamp '{LINES_NOW}', not_before + to_days((retry_count * 10)::int)), 0) end as deadline_left from line)
""")
def ready_and_leased(spark: SparkSession, folder: str) -> DataFrame:
    now = _now(LINES_NOW)
    deadline = F.when(F.col("flag") == "A", F.col("not_before") + F.make_dt_interval(F.col("retry_count") * 10))
    leased = validity.is_leased(deadline, now)
    return views.produced_lines(spark, folder).select(
        "message_id",
        F.when(deadline.isNotNull(), scalars.seconds_left(deadline, now)).alias("deadline_left"),
        leased.alias("is_leased"),
        validity.is_ready(F.col("not_before"), deadline, now).alias("is_ready"),
        F.coalesce(validity.can_extend(F.col("sequence") - 1, deadline, now), F.lit(False)).alias("can_extend"),
    )


@query(f"""
with {LETTERS} select message_id, topic, reason from letter where contains(lower(reason), 'timeout') or contains(lower(body), '"k": 7')
  or contains(lower(topic), 'timeout') or contains(message_id, 'timeout') or contains(producer_id, 'timeout')
""".replace("""contains(lower(body), '"k": 7')""", "contains(lower(body), 'timeout')"))
def dlq_search(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.search(views.dead_letters(spark, folder), "TimeOut").select("message_id", "topic", "reason")


@query(f"""with {LETTERS} select message_id, body from letter where contains(body, '"k": 7')""")
def dlq_search_payload(spark: SparkSession, folder: str) -> DataFrame:
    found = deadletter.search(views.dead_letters(spark, folder), '"K": 7')
    return found.select("message_id", deadletter.decoded(F.col("payload")).alias("body"))


@query(f"""
with {LETTERS} select message_id, attempts from letter where contains(topic, 'topic-1') and contains(lower(reason), 'err')
and moved_at between timestamp '2024-01-05' and timestamp '2024-01-25' and attempts between 2 and 5
""")
def dlq_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = deadletter.filtered(views.dead_letters(spark, folder), "topic-1", "ERR", "", "2024-01-05", "2024-01-25", 2, 5)
    return rows.select("message_id", "attempts")


@query(f"""
with {LETTERS} select 'topic' as facet, topic as value, count(*) as n from letter group by 2 union all select 'reason', reason, count(*) from letter group by 2
union all select 'producer', producer_id, count(*) from letter group by 2
""")
def dlq_facets(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.facets(views.dead_letters(spark, folder))


@query(f"""
with {LETTERS} select message_id, topic, row_number() over (partition by topic order by moved_at, message_id)::int as position from letter qualify position <= 100
""")
def dlq_capacity(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.intake(views.dead_letters(spark, folder), 100).select("message_id", "topic", "position")


@query(f"with {LETTERS} select message_id from letter where moved_at + interval 7 day >= timestamp '{EVENTS_NOW}'")
def dlq_compact(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.compact(views.dead_letters(spark, folder), _now(EVENTS_NOW)).select("message_id")


@query(f"""
with {LETTERS} select message_id, case when attempts = 6 then 0 else attempts end as attempts, attempts = 6 as replayed from letter
""")
def dlq_replay(spark: SparkSession, folder: str) -> DataFrame:
    letters = views.dead_letters(spark, folder)
    again, left = deadletter.replay(letters, letters.where("attempts = 6").select("message_id"))
    rows = again.withColumn("replayed", F.lit(True)).union(left.withColumn("replayed", F.lit(False)))
    return rows.select("message_id", "attempts", "replayed")


@query(f"""
with {LETTERS} select topic, count(*) as n, count(*) filter (moved_at + interval 7 day < timestamp '{EVENTS_NOW}') as expired, epoch_us(min(moved_at)) as oldest_us,
  count(*) / 10000 as usage, greatest(count(*) - 10000, 0) as over_capacity from letter group by topic
""")
def dlq_stats(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.stats(views.dead_letters(spark, folder), _now(EVENTS_NOW))


@query(f"""
with {LETTERS} select message_id, a::int as attempt, epoch_us(moved_at) + (pow(2, a - 1) * 60000000)::bigint as failed_us from letter, range(1, 10) r(a) where a <= attempts
""")
def dlq_retry_history(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.retry_history(views.dead_letters(spark, folder))


@query(f"""
with {LETTERS} select message_id, case attempts % 3 when 0 then false when 1 then attempts >= 4 else datediff('second', moved_at, timestamp '{EVENTS_NOW}') > 864000 end as dead from letter
""")
def dlq_policy(spark: SparkSession, folder: str) -> DataFrame:
    policy = F.element_at(F.array(F.lit("none"), F.lit("max_retries"), F.lit("ttl")), F.col("attempts") % 3 + 1)
    age = F.timestamp_diff("SECOND", F.col("moved_at"), _now(EVENTS_NOW))
    dead = validity.goes_to_dead_letters(policy, F.col("attempts"), F.lit(4), age, F.lit(864_000))
    return views.dead_letters(spark, folder).select("message_id", dead.alias("dead"))


TXN = f"""{LINES}, ops as (
  select *, 'lines' as topic, producer_id as txn, discount < 0.09 as valid, quantity < 49 as applied from line
), txn as (
  select txn, count(*) as operations, count(distinct partition_id) as participants, bool_and(valid) as prepared, count(*) filter (not applied) as failed from ops group by txn
), outcome as (
  select txn, operations, participants, case when not prepared then 'aborted' when failed > 0 then 'committed with errors' else 'committed' end as state,
         case when prepared then failed else 0 end as errors from txn
)"""


def _txn_ops(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.produced_lines(spark, folder)
    return rows.withColumns({"txn": F.col("producer_id"), "valid": F.col("discount") < 0.09, "applied": F.col("quantity") < 49})


@query(f"with {TXN} select * from outcome")
def txn_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.outcomes(_txn_ops(spark, folder), "txn", "valid", "applied")


@query(f"with {TXN} select message_id, txn from ops where txn in (select txn from outcome where state like 'committed%')")
def txn_visibility(spark: SparkSession, folder: str) -> DataFrame:
    ops = _txn_ops(spark, folder)
    return transactions.visible(ops, transactions.outcomes(ops, "txn", "valid", "applied"), "txn").select("message_id", "txn")


@query(f"with {TXN} select message_id, txn from ops where txn in (select txn from ops group by txn having bool_and(valid))")
def batch_all_or_nothing(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.all_or_nothing(_txn_ops(spark, folder), "txn", "valid").select("message_id", "txn")


@query(f"with {TXN} select distinct txn, partition_id from ops where partition_id = 3")
def txn_unknown_participants(spark: SparkSession, folder: str) -> DataFrame:
    known = spark.range(3).select(F.lit("lines").alias("topic"), F.col("id").cast("int").alias("partition_id"))
    return transactions.unknown_participants(_txn_ops(spark, folder), known).select("txn", "partition_id").distinct()
