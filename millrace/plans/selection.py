"""Queries: order, top-n, candidates and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import ordering, routing
from millrace.plans.common import HEALTH, LINES, LINES_NOW, MSG_ORDERS, TOPICS, query
from millrace.sources import views
from millrace.sources.tables import read_table

SHOWN = ("message_id", "partition_id", "priority", "rank")


def _best_sql(direction: str, n: int, fanout: int | None, extra: str = "") -> str:
    qualify = f"qualify row_number() over (partition by partition_id order by priority {direction}, enqueued_at, message_id) <= {fanout}" if fanout else ""
    return f"""
with {MSG_ORDERS}, {HEALTH}, cand as (select * from msg {extra} {qualify})
select message_id, partition_id, priority, row_number() over (order by priority {direction}, enqueued_at, message_id) - 1 as rank
from cand qualify rank < {n}
"""


@query(_best_sql("asc", 10, 4))
def spine_select_min(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.select_best(views.order_messages(spark, folder), 10, "MIN", 4).select(*SHOWN)


@query(_best_sql("desc", 10, 4))
def spine_select_max(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.select_best(views.order_messages(spark, folder), 10, "MAX", 4).select(*SHOWN)


@query(_best_sql("asc", 50, None))
def spine_select_exact(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.select_best(views.order_messages(spark, folder), 50, "MIN", None).select(*SHOWN)


@query(_best_sql("asc", 20, 4, "where partition_id in (select partition_id from health where not is_throttled)"))
def spine_throttled(spark: SparkSession, folder: str) -> DataFrame:
    health = views.partition_health(spark, folder)
    return ordering.select_best(views.order_messages(spark, folder), 20, "MIN", 4, partitions=health).select(*SHOWN)


@query(f"""
with {MSG_ORDERS}, ranked as (
  select *, row_number() over (order by priority, enqueued_at, message_id) - 1 as true_rank,
         row_number() over (partition by partition_id order by priority, enqueued_at, message_id) as r from msg
), best as (
  select message_id, true_rank, row_number() over (order by priority, enqueued_at, message_id) - 1 as rank from ranked where r <= 4 qualify rank < 16
)
select message_id, rank, true_rank, true_rank - rank as rank_error from best
""")
def spine_rank_error(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.rank_error(views.order_messages(spark, folder), 16)


@query(f"""
with {MSG_ORDERS}
select message_id, partition_id, priority, row_number() over (partition by partition_id order by priority, enqueued_at, message_id) - 1 as candidate_rank
from msg qualify candidate_rank < 5
""")
def peek_partition_topn(spark: SparkSession, folder: str) -> DataFrame:
    found = ordering.candidates(views.order_messages(spark, folder), 5)
    return found.select("message_id", "partition_id", "priority", "candidate_rank")


@query(f"""
with {MSG_ORDERS}, cand as (
  select *, row_number() over (partition by partition_id order by priority, enqueued_at, message_id) - 1 as round from msg qualify round < 4
), having_ as (select partition_id, row_number() over (order by partition_id) - 1 as index, count(*) over () as p from (select distinct partition_id from cand))
select message_id, partition_id, round,
       row_number() over (order by round, (((index - 1 - round) % p) + p) % p) - 1 as position
from cand join having_ using (partition_id) qualify position < 10
""")
def select_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    found = ordering.candidates(views.order_messages(spark, folder), 4)
    out = ordering.select_round_robin(found, 10, last=1)
    return out.select("message_id", "partition_id", F.col("round").cast("long").alias("round"), "position")


@query(f"""
with {MSG_ORDERS}, {HEALTH}, cand as (
  select *, row_number() over (partition by partition_id order by priority, enqueued_at, message_id) as r from msg qualify r <= 10
), having_ as (
  select c.partition_id, count(*) as have, any_value(weight) as w from cand c left join health h on h.partition_id = c.partition_id group by 1
), quota as (
  select *, least(greatest(floor(10 * w / sum(w) over ()), 1), have) as q from having_
), take as (
  select partition_id, greatest(least(q, 10 - coalesce(sum(q) over (order by partition_id rows between unbounded preceding and 1 preceding), 0)), 0) as take from quota
)
select message_id, partition_id, r > take as filled from cand join take using (partition_id)
qualify row_number() over (order by r > take, priority, enqueued_at, message_id) <= 10
""")
def select_weighted(spark: SparkSession, folder: str) -> DataFrame:
    found = ordering.candidates(views.order_messages(spark, folder), 10)
    return ordering.select_weighted(found, views.partition_health(spark, folder), 10).select("message_id", "partition_id", "filled")


@query("""
select event_id, 1705708800000000 - epoch_us(ts) as age_us, 1705708800000000 - epoch_us(ts) > 432000000000 as stale,
       1705708800000000 - epoch_us(ts) between 86400000000 and 432000000000 as kept
from events
""")
def staleness_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "events").withColumn("updated_at", F.col("ts"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return ordering.fresh(rows, now, most_s=5 * 86_400, least_s=86_400).select("event_id", "age_us", "stale", "kept")


@query(f"""
with {TOPICS}
select topic, mode, row_number() over (order by topic) - 1 as position,
       case when count(*) over () > 20 then 20 end as next_token
from topic qualify position between 10 and 19
""".replace("row_number() over (order by topic) - 1 as position", "row_number() over (order by topic) - 11 as position").replace("position between 10 and 19", "position between 0 and 9"))
def heaps_page(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.page(views.topics(spark, folder), "topic", token=10, size=10).select("topic", "mode", "position", "next_token")


@query(f"""
with {LINES} select message_id, sequence, epoch_us(not_before) as not_before_us from line where not_before <= timestamp '{LINES_NOW}'
""")
def timer_ready(spark: SparkSession, folder: str) -> DataFrame:
    rows = ordering.timers_ready(views.produced_lines(spark, folder), F.lit(LINES_NOW).cast("timestamp_ntz"))
    return rows.select("message_id", "sequence", scalars.micros(F.col("not_before")).alias("not_before_us"))


@query(f"""
with {LINES} select count(*) as scheduled, epoch_us(min(not_before)) as next_ready_us,
  sum(greatest((epoch_us(not_before) - epoch_us(timestamp '{LINES_NOW}')) / 1e6, 0)) / count(*) as mean_delay_s
from line where not_before > timestamp '{LINES_NOW}'
""")
def timer_stats(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit(LINES_NOW).cast("timestamp_ntz")
    return ordering.timer_stats(views.produced_lines(spark, folder).where(F.col("not_before") > now), now)


def _route_sql(p: int) -> str:
    return f"""arg_max(p, struct_pack(w := sha, m := -p)) filter (p < {p})"""


RENDEZVOUS = """weight as (
  select c_custkey, c_name, p,
         (select string_agg(substr(d, i, 2), '' order by i desc) from range(1, 16, 2) r(i)) as sha
  from (select c_custkey, c_name, p, sha256(c_name::blob || unhex(printf('%02x000000', p))) as d from customer, range(0, 9) q(p))
)"""


@query(f"with {RENDEZVOUS} select c_name as key, {_route_sql(8)}::int as partition_id from weight group by c_custkey, c_name")
def route_rendezvous(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "customer")
    return rows.select(F.col("c_name").alias("key"), routing.rendezvous(F.col("c_name"), list(range(8))).alias("partition_id"))


@query(f"""
with {RENDEZVOUS}, pair as (select c_name as key, {_route_sql(8)}::int as before, {_route_sql(9)}::int as after from weight group by c_custkey, c_name)
select *, before != after as moved from pair
""")
def route_minimal_move(spark: SparkSession, folder: str) -> DataFrame:
    return routing.moved_keys(read_table(spark, folder, "customer"), "c_name", list(range(8)), list(range(9)))


@query("""
with recursive f as (
  select c_name, 1 as i, 14695981039346656037::uhugeint as h from customer
  union all
  select c_name, i + 1, (xor(h, ascii(substr(c_name, i, 1))::uhugeint) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint from f where i <= length(c_name)
)
select c_name as key, (h % 8)::int as partition_id from f where i = length(c_name) + 1
""")
def route_fnv(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "customer")
    return rows.select(F.col("c_name").alias("key"), routing.hashed(F.col("c_name"), list(range(8))).alias("partition_id"))


@query(f"with {HEALTH} select topic, list_sort(list(partition_id))::varchar as partition_ids from health group by topic")
def topology(spark: SparkSession, folder: str) -> DataFrame:
    found = routing.topology(views.partition_health(spark, folder))
    return found.select("topic", F.concat(F.lit("["), F.array_join("partition_ids", ", "), F.lit("]")).alias("partition_ids"))
