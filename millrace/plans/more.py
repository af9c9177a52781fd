"""Queries: pops and peeks, stored state, operation-log checks, flow and health figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import catalog, deadletter, leasing, ordering, routing, series, stats, validity
from millrace.operators.delivery import leases
from millrace.plans.common import LETTERS, LOG, MSG_ORDERS, TOPICS, query
from millrace.sources import views
from millrace.sources.tables import read_table

NOW = "1998-06-01 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(f"""
with {MSG_ORDERS}, cand as (select * from msg qualify row_number() over (partition by partition_id order by priority, enqueued_at, message_id) <= 4)
select message_id, row_number() over (order by priority, enqueued_at, message_id) - 1 as rank, sha256(message_id || '|1') as token, 'c1' as holder,
  epoch_us(timestamp '{NOW}') + 45000000 as deadline_us from cand qualify rank < 12
""")
def global_pop(spark: SparkSession, folder: str) -> DataFrame:
    rows = leasing.pop(views.order_messages(spark, folder), 12, "c1", _at(NOW), 45)
    return rows.select("message_id", "rank", "lease.token", "lease.holder", scalars.micros(F.col("lease.deadline")).alias("deadline_us"))


@query(f"""
with {MSG_ORDERS}, u as (select *, false as is_dead from msg where payload = 'O' union all select *, true from msg where payload = 'F')
select message_id, is_dead, row_number() over (order by priority, enqueued_at, message_id) - 1 as rank, true as has_more from u qualify rank < 30
""")
def peek_with_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    m = views.order_messages(spark, folder)
    return leasing.peek(m.where("payload = 'O'"), m.where("payload = 'F'"), 30).select("message_id", "is_dead", "rank", "has_more")


@query(f"with {MSG_ORDERS} select message_id from msg where partition_id in (1, 3)")
def pop_filter(spark: SparkSession, folder: str) -> DataFrame:
    return leasing.filtered(views.order_messages(spark, folder), "orders", [1, 3]).select("message_id")


@query(f"with {MSG_ORDERS} select message_id, row_number() over (order by message_id) - 1 as position from msg where partition_id = 2 qualify position < 25")
def list_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = leasing.filtered(views.order_messages(spark, folder), "orders", [2])
    return ordering.page(rows, "message_id", 0, 25).select("message_id", "position")


@query(f"""
with {MSG_ORDERS} select message_id, candidate_rank - 1 as candidate_rank from (
  select message_id, row_number() over (partition by partition_id order by priority, enqueued_at, message_id) - 1 as candidate_rank from msg) where candidate_rank between 1 and 6
""")
def without_best_candidate(spark: SparkSession, folder: str) -> DataFrame:
    found = ordering.candidates(views.order_messages(spark, folder), 7).where("candidate_rank > 0")
    return found.select("message_id", (F.col("candidate_rank") - 1).alias("candidate_rank"))


LEASE = f"""{LOG}, lease as (select message_id, arg_max(holder, seq) as holder, arg_max(ts, seq) + interval 12 hour as deadline from log where op = 'POP' group by 1)"""


@query(f"with {LEASE} select message_id, epoch_us(deadline) + 300000000 as expires_us from lease")
def lease_store(spark: SparkSession, folder: str) -> DataFrame:
    rows = leasing.stored(leases(views.operations(spark, folder), 12 * 3600))
    return rows.select("message_id", scalars.micros(F.col("expires_at")).alias("expires_us"))


@query(f"""
with {LEASE} select message_id, due, epoch_us(deadline) + case when due then 15000000 else 0 end as deadline_us from (
  select *, deadline between timestamp '2024-01-30' and timestamp '2024-01-30' + interval 7200 second as due from lease)
""")
def lease_renewals(spark: SparkSession, folder: str) -> DataFrame:
    rows = leasing.renewed(leases(views.operations(spark, folder), 12 * 3600), _at("2024-01-30"), 7200)
    return rows.select("message_id", "due", scalars.micros(F.col("deadline")).alias("deadline_us"))


@query(f"""
with {LOG}, t as (select message_id, count(*) as n, datediff('second', min(ts), max(ts)) // 3600 as age_s from log where op = 'EXTEND' group by 1)
select message_id, n, case when n >= 10 then 'too many extensions' when age_s > 600 then 'lifetime over' end as refused,
  case when n < 10 and age_s <= 600 then least(30 * pow(1.5, n), 120.0) end as next_s from t
""")
def extension_policy(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.operations(spark, folder).where("op = 'EXTEND'").groupBy("message_id")
    rows = rows.agg(F.count("*").alias("n"), F.floor(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 3600).alias("age_s"))
    return leasing.extensions(rows, "n", "age_s").select("message_id", "n", "refused", "next_s")


@query(f"""
with {LOG}, s as (select seq, (seq % 11)::int as available, (seq % 3)::int as in_flight from log)
select seq, case when available <= 3.0 then greatest(10 - available - in_flight, 0) else 0 end as request from s
""")
def flow_control(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.operations(spark, folder).select("seq", (F.col("seq") % 11).cast("int").alias("available"), (F.col("seq") % 3).cast("int").alias("in_flight"))
    return leasing.flow_control(rows, 10).select("seq", "request")


@query(f"""
with {LOG} select seq, sum(case op when 'ENQUEUE' then 1 when 'ACK' then -1 else 0 end) over (partition by partition_id order by seq) as balance from log
""")
def running_depth(spark: SparkSession, folder: str) -> DataFrame:
    change = F.when(F.col("op") == "ENQUEUE", 1).when(F.col("op") == "ACK", -1).otherwise(0)
    return series.running_balance(views.operations(spark, folder), "partition_id", "seq", change).select("seq", "balance")


@query(f"""
with recursive {LOG}, o as (select message_id as key, seq, epoch_us(ts) as us, row_number() over (partition by message_id order by ts, seq) as n from log), f as (
  select key, 0::bigint as n, null::bigint as seq, null::bigint as at, 3.0::double as tokens, false as allowed from (select distinct key from o)
  union all
  select key, n, seq, us, case when t >= 1 then t - 1 else t end, t >= 1 from (
    select o.key, o.n, o.seq, o.us, case when f.at is null then 3.0 else least(3.0, f.tokens + (o.us - f.at) * (0.0005::double / 60000000)) end as t
    from f join o on o.key = f.key and o.n = f.n + 1) s
)
select key, seq, allowed, round(tokens, 6) as tokens from f where n > 0
""")
def rate_limit_bucket(spark: SparkSession, folder: str) -> DataFrame:
    found = series.token_bucket(views.operations(spark, folder), "message_id", 0.0005, 3)
    return found.withColumn("tokens", F.round("tokens", 6))


@query(f"""
with {LOG}, e as (select *, case when value > 150 then 'data required' when op = 'EXTEND' and value < 2 then 'bad duration' end as error from log)
select op, count(*) as n, count(*) filter (error is null) as applied, count(*) filter (error is not null) as failed, count(distinct partition_id) as partitions from e group by op
""")
def log_applied(spark: SparkSession, folder: str) -> DataFrame:
    """The operation log applied: entries checked in order, counted by kind."""
    error = validity.first_failure((F.col("value") > 150, "data required"), ((F.col("op") == "EXTEND") & (F.col("value") < 2), "bad duration"))
    rows = views.operations(spark, folder).withColumn("error", error).groupBy("op")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("applied"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_distinct("partition_id").alias("partitions"))


@query("select user_id, arg_max(props, event_id) as props, arg_max(value, event_id) as value from events where event_type = 'click' group by 1")
def config_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "events").where("event_type = 'click'").select("user_id", "event_id", "props", "value")
    return catalog.last_write(rows, ["user_id"], "event_id").select("user_id", "props", "value")


@query(f"""
with {MSG_ORDERS}, cand as (select * from msg qualify row_number() over (partition by partition_id order by priority, enqueued_at, message_id) <= 8),
best as (select * from cand qualify row_number() over (order by priority, enqueued_at, message_id) <= 20) select partition_id, count(*) as selections from best group by 1
""")
def selection_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.selections(ordering.select_best(views.order_messages(spark, folder), 20, "MIN", 8))


@query("""
select s as service, count(*) filter (v < 10) as healthy, count(*) filter (v between 10 and 49) as degraded, count(*) filter (v > 49) as unhealthy,
  case when max(v) > 49 then 'unhealthy' when max(v) >= 10 then 'degraded' else 'healthy' end as overall
from (select event_type as s, floor(value)::int as v from events) group by 1
""")
def component_health(spark: SparkSession, folder: str) -> DataFrame:
    v = F.floor("value")
    status = F.when(v < 10, "healthy").when(v <= 49, "degraded").otherwise("unhealthy")
    rows = read_table(spark, folder, "events").select(F.col("event_type").alias("service"), status.alias("status"))
    return stats.worst_status(rows, ["service"])


@query(f"""
with {LOG}, b as (select epoch_us(ts) // 3600000000 as h, count(*) as n, avg(value) as latency, count(*) filter (op = 'NACK') as errors from log group by 1)
select floor(avg(n))::bigint as throughput, floor(avg(latency))::bigint as latency, sum(errors) as errors, sum(errors) / sum(n) as error_rate from b
""")
def series_kpis(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.floor(scalars.micros(F.col("ts")) / 3_600_000_000)
    b = views.operations(spark, folder).groupBy(hour.alias("h"))
    b = b.agg(F.count("*").alias("n"), F.avg("value").alias("latency"), F.count_if(F.col("op") == "NACK").alias("errors"))
    return b.agg(
        F.floor(F.avg("n")).alias("throughput"), F.floor(F.avg("latency")).alias("latency"), F.sum("errors").alias("errors"), (F.sum("errors") / F.sum("n")).alias("error_rate")
    )


@query(f"""
with {LETTERS} select topic, count(*) filter (moved_at + interval 12 hour < timestamp '2024-01-15') as cleaned, count(*) as runs,
  count(*) filter (attempts < 5) / count(*) as success_rate, count(*) filter (attempts >= 5) * 2 > count(*) as unhealthy from letter group by 1
""")
def cleanup_efficiency(spark: SparkSession, folder: str) -> DataFrame:
    """Cleanup of expired rows: how many go, how often runs succeed, unhealthy when over half fail."""
    rows = views.dead_letters(spark, folder).groupBy("topic")
    gone = F.col("moved_at") + F.make_dt_interval(F.lit(0), F.lit(12)) < _at("2024-01-15")
    failed = F.count_if(F.col("attempts") >= 5)
    return rows.agg(
        F.count_if(gone).alias("cleaned"), F.count("*").alias("runs"), (F.count_if(F.col("attempts") < 5) / F.count("*")).alias("success_rate"), (failed * 2 > F.count("*")).alias("unhealthy")
    )


@query(f"with {TOPICS} select topic, partitions from topic where contains(lower(topic), 'and#1')")
def topic_search(spark: SparkSession, folder: str) -> DataFrame:
    return views.topics(spark, folder).where(F.lower("topic").contains("AND#1".lower())).select("topic", "partitions")


@query("""
select c_custkey, left(c_name, 4) || repeat('•', 8) || right(c_name, 4) as masked from customer where contains(lower(c_name), '0001') and c_acctbal > 0
""")
def key_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "customer").where(F.lower("c_name").contains("0001") & (F.col("c_acctbal") > 0))
    return rows.select("c_custkey", scalars.masked_key(F.col("c_name")).alias("masked"))


@query(f"""
with {MSG_ORDERS} select message_id, 'priority=' || priority || ';partition=' || partition_id || ';enqueued_at=' || strftime(enqueued_at, '%Y-%m-%dT%H:%M:%SZ') as metadata from msg
""")
def message_metadata(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"priority": F.col("priority").cast("string"), "partition": F.col("partition_id").cast("string"), "enqueued_at": F.date_format("enqueued_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    made = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))
    rows = views.order_messages(spark, folder).withColumn("m", made)
    return rows.select("message_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


@query(f"with {LETTERS} select message_id, body as payload_text, json_extract(body, '$.k')::int as k from letter")
def payload_json(spark: SparkSession, folder: str) -> DataFrame:
    text = deadletter.decoded(F.col("payload"))
    return views.dead_letters(spark, folder).select("message_id", text.alias("payload_text"), F.from_json(text, "k int")["k"].alias("k"))


@query(f"""
with {LOG} select partition_id, count(*) as entries, sum(24 + 6 + strlen(props))::bigint as log_bytes, count(*) >= 1000 as snapshot_due, count(*) > 10000 as compaction_due from log group by 1
""")
def log_metrics(spark: SparkSession, folder: str) -> DataFrame:
    size = scalars.log_entry_bytes(F.lit("events"), F.octet_length("props"))
    n = F.count("*")
    return views.operations(spark, folder).groupBy("partition_id").agg(n.alias("entries"), F.sum(size).alias("log_bytes"), (n >= 1000).alias("snapshot_due"), (n > 10_000).alias("compaction_due"))


@query("""
select ttl, least(greatest(case when ttl = 0 then 86400 else ttl end, 60), 604800) as clamped from (select (event_id * 97 % 1000000)::int as ttl from events)
union all select 0, 86400
""")
def ttl_clamp(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "events").select((F.col("event_id") * 97 % 1_000_000).cast("int").alias("ttl"))
    rows = rows.union(spark.range(1).select(F.lit(0)))
    return rows.select("ttl", scalars.ttl_clamped(F.col("ttl")).alias("clamped"))


@query("""
select t as topic, p as producer, case when p = '' then t else t || ':' || p end as key from (select event_type as t, case when user_id % 3 = 0 then '' else 'p' || user_id end as p from events)
""")
def routing_keys(spark: SparkSession, folder: str) -> DataFrame:
    producer = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("p"), F.col("user_id").cast("string")))
    rows = read_table(spark, folder, "events").select(F.col("event_type").alias("topic"), producer.alias("producer"))
    return rows.select("topic", "producer", scalars.routing_key(F.col("topic"), F.col("producer")).alias("key"))


@query("select 'orders' as topic, 8::bigint as partitions, count(*) as keys from customer")
def routing_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "customer").select(routing.rendezvous(F.col("c_name"), list(range(8))).alias("p"))
    return rows.agg(F.count_distinct("p").alias("partitions"), F.count("*").alias("keys")).withColumn("topic", F.lit("orders"))
