"""Queries: point reads, lists, heap contents, membership, catalog changes, formats, timeouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import catalog, leasing, lookups, ordering, transactions, validity
from millrace.plans.common import LETTERS, LINES, LOG, MSG_ORDERS, TOPICS, query
from millrace.sources import views
from millrace.sources.tables import read_table

NODES = ("n0", "n1", "n2", "n3")


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Message ids that consumers ask for: some exist, some do not."""
    rows = read_table(spark, folder, "lineitem").where("l_linenumber = 6")
    key = F.col("l_orderkey") + F.when(F.col("l_partkey") % 2 == 0, 0).otherwise(1_000_000_000)
    return rows.select(F.lpad(key.cast("string"), 12, "0").alias("message_id")).distinct()


@query(f"""
with {MSG_ORDERS}, req as (
  select distinct lpad((l_orderkey + case when l_partkey % 2 = 0 then 0 else 1000000000 end)::varchar, 12, '0') as message_id from lineitem where l_linenumber = 6
) select message_id, partition_id, priority, msg.message_id is not null as found from req left join msg using (message_id)
""")
def get_messages(spark: SparkSession, folder: str) -> DataFrame:
    got = lookups.found(_requests(spark, folder), views.order_messages(spark, folder), ["message_id"])
    return got.select("message_id", "partition_id", "priority", "found")


@query(f"""
with {LOG}, held as (select message_id, max_by(op, seq) as op, max_by(holder, seq) as holder, epoch_us(max_by(ts, seq)) + 30000000 as deadline_us from log where op in ('POP', 'ACK') group by 1),
req as (select distinct message_id from log where op = 'EXTEND')
select message_id, holder, deadline_us, holder is not null as found from req left join (select * from held where op = 'POP') using (message_id)
""")
def get_leases(spark: SparkSession, folder: str) -> DataFrame:
    """The stored lease of each message that asks for an extension: its last pop, unless acknowledged since."""
    log = views.operations(spark, folder)
    last = catalog.last_write(log.where("op in ('POP', 'ACK')").select("message_id", "seq", "ts", "op", "holder"), ["message_id"], "seq").where("op = 'POP'")
    held = last.select("message_id", "holder", (scalars.micros(F.col("ts")) + 30_000_000).alias("deadline_us"))
    return lookups.found(log.where("op = 'EXTEND'").select("message_id").distinct(), held, ["message_id"])


@query(f"with {TOPICS} select topic, mode, partitions, replication_factor, top_k_bound, row_number() over (order by topic) - 1 as position from topic")
def list_topic_configs(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.topics(spark, folder)
    return ordering.page(rows, "topic", 0, 1000).select("topic", "mode", "partitions", "replication_factor", "top_k_bound", "position")


@query(f"with {TOPICS} select r as topic, mode, topic.topic is not null as found from (select unnest(['Brand#11', 'Brand#23', 'none']) as r) left join topic on topic.topic = r")
def get_topic_config(spark: SparkSession, folder: str) -> DataFrame:
    wanted = spark.createDataFrame([("Brand#11",), ("Brand#23",), ("none",)], "topic string")
    return lookups.found(wanted, views.topics(spark, folder), ["topic"]).select("topic", "mode", "found")


@query("""
select i::int as partition_id, i % 3 = 1 as is_throttled, i % 5 != 4 as is_healthy, i in (2, 4) as asked from range(8) r(i)
""")
def partition_infos(spark: SparkSession, folder: str) -> DataFrame:
    """All partitions of a topic, and which of them a point read asked for."""
    asked = spark.createDataFrame([("orders", 2), ("orders", 4), ("orders", 99)], "topic string, partition_id int")
    rows = views.partition_health(spark, folder)
    return lookups.found(rows, asked, ["topic", "partition_id"]).select("partition_id", "is_throttled", "is_healthy", F.col("found").alias("asked"))


@query(f"with {TOPICS} select p_partkey as message_id, topic, mode, top_k_bound from part join topic on topic = p_brand")
def messages_with_config(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "part").select(F.col("p_partkey").alias("message_id"), F.col("p_brand").alias("topic"))
    return rows.join(views.topics(spark, folder), "topic").select("message_id", "topic", "mode", "top_k_bound")


@query(f"""
with {MSG_ORDERS}, cand as (select * from msg qualify row_number() over (partition by partition_id order by priority, enqueued_at, message_id) <= 6),
best as (select message_id from cand qualify row_number() over (order by priority, enqueued_at, message_id) <= 9)
select message_id, partition_id from cand where message_id not in (select message_id from best)
""")
def remaining_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates that a selection left over, which fill it up when weights round down."""
    cand = ordering.candidates(views.order_messages(spark, folder), 6)
    best = ordering.top_n(cand, 9).select("message_id")
    return cand.join(F.broadcast(best), "message_id", "left_anti").select("message_id", "partition_id")


@query("""
select case when value < 10 then 'active' when value < 60 then 'completed' else 'failed' end as state, count(*) as plans from events group by 1
""")
def rebalance_states(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("value") < 10, "active").when(F.col("value") < 60, "completed").otherwise("failed")
    return read_table(spark, folder, "events").groupBy(state.alias("state")).agg(F.count("*").alias("plans"))


@query(f"with {TOPICS}, {MSG_ORDERS} select (select count(*) from msg) as messages, count(*) as topics, sum(partitions)::bigint as partitions from topic")
def recovery_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = views.topics(spark, folder).agg(F.count("*").alias("topics"), F.sum("partitions").alias("partitions"))
    m = views.order_messages(spark, folder).agg(F.count("*").alias("messages"))
    return t.withColumn("_one", F.lit(1)).join(m.withColumn("_one", F.lit(1)), "_one").select("messages", "topics", "partitions")


@query(f"""
with {MSG_ORDERS}, held as (select * from msg where payload in ('O', 'P') and partition_key::bigint % 10 != 0),
gone as (select message_id from held qualify row_number() over (order by priority, enqueued_at, message_id) <= 15)
select message_id, partition_id from held where message_id not in (select message_id from gone)
""")
def heap_after_operations(spark: SparkSession, folder: str) -> DataFrame:
    m = views.order_messages(spark, folder)
    removed = m.where(F.col("partition_key").cast("long") % 10 == 0)
    left = lookups.after_operations(m.where("payload = 'O'"), m.where("payload = 'P'"), removed, 15)
    return left.select("message_id", "partition_id")


@query(f"""
with {MSG_ORDERS}, b as (select *, lag({{'p': priority, 'e': enqueued_at, 'm': message_id}}) over (partition by partition_id order by message_id) as before from msg)
select message_id, partition_id from b where before > {{'p': priority, 'e': enqueued_at, 'm': message_id}}
""")
def order_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Validation of a stored list: what stands after a message it should precede."""
    return lookups.out_of_order(views.order_messages(spark, folder), "message_id").select("message_id", "partition_id")


@query(f"with {LETTERS} select message_id, row_number() over (order by moved_at, message_id) - 1 as position from letter qualify position < 50")
def dlq_peek(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.dead_letters(spark, folder).orderBy("moved_at", "message_id").limit(50)
    return lookups.numbered(rows.withColumn("all", F.lit(0)), ["all"], ["moved_at", "message_id"]).select("message_id", (F.col("number") - 1).alias("position"))


@query(f"with {MSG_ORDERS} select message_id, partition_id, row_number() over (partition by partition_id order by priority, enqueued_at, message_id) - 1 as position from msg")
def message_positions(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.positions(views.order_messages(spark, folder)).select("message_id", "partition_id", "position")


@query(f"""
with {MSG_ORDERS} select partition_id, count(*) as candidates, min(priority) as best from (
  select * from msg qualify row_number() over (partition by partition_id order by priority, enqueued_at, message_id) <= 5) group by 1
""")
def candidate_union(spark: SparkSession, folder: str) -> DataFrame:
    m = views.order_messages(spark, folder)
    lists = [ordering.candidates(m.where(F.col("partition_id") == p), 5) for p in range(4)]
    union = lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3])
    return union.groupBy("partition_id").agg(F.count("*").alias("candidates"), F.min("priority").alias("best"))


@query(f"with {LINES} select producer_id as txn, partition_id, count(*) as operations, min(message_id) as first_message from line group by 1, 2")
def ops_by_participant(spark: SparkSession, folder: str) -> DataFrame:
    ops = views.produced_lines(spark, folder).withColumn("txn", F.col("producer_id"))
    return lookups.by_participant(ops, "txn").select("txn", "partition_id", "operations", "first_message")


@query(f"with {LINES} select distinct 'lines' as topic, partition_id from line")
def txn_participants(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.participants(views.produced_lines(spark, folder))


@query("""
with p as (select i::int as partition_id, 'n' || (i % 4) as leader, ['n' || ((i + 1) % 4), 'n' || ((i + 2) % 4)] as replicas from range(8) r(i))
select partition_id, array_to_string([leader] || replicas, ',') as nodes, leader = 'n1' as leads, list_contains(replicas, 'n1') as replicates from p
""")
def partition_nodes(spark: SparkSession, folder: str) -> DataFrame:
    names, n = F.array(*map(F.lit, NODES)), F.col("partition_id")
    at = [F.element_at(names, (n + k) % 4 + 1) for k in range(3)]
    rows = views.partition_health(spark, folder).select("partition_id", at[0].alias("leader"), F.array(*at[1:]).alias("replicas"))
    return rows.select(
        "partition_id", F.array_join(lookups.nodes(F.col("leader"), F.col("replicas")), ",").alias("nodes"), (F.col("leader") == "n1").alias("leads"), F.array_contains("replicas", "n1").alias("replicates")
    )


@query(f"""
with {LETTERS} select message_id, attempts < 5 as may_retry, attempts + 1 as next_attempts, case when attempts < 5 then epoch_us(moved_at) + (power(2, attempts)::bigint) * 1000000 end as not_before_us from letter
""")
def retry_states(spark: SparkSession, folder: str) -> DataFrame:
    """Whether to retry, the attempts after it, and the backoff set; cleared where there is no retry."""
    a = F.col("attempts")
    retry = validity.can_retry(a, F.lit(5))
    until = scalars.micros(F.col("moved_at")) + scalars.partition_backoff(a).cast("long") * 1_000_000
    return views.dead_letters(spark, folder).select("message_id", retry.alias("may_retry"), (a + 1).alias("next_attempts"), F.when(retry, until).alias("not_before_us"))


@query("""
select event_id as seq, case event_id % 4 when 0 then 'PENDING' when 1 then 'READY' when 2 then 'LEASED' else 'UNKNOWN' end as state from events
""")
def enum_names(spark: SparkSession, folder: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in enumerate(("PENDING", "READY", "LEASED")) for x in pair))
    code = (F.col("event_id") % 4).cast("int")
    return read_table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.coalesce(F.try_element_at(names, code), F.lit("UNKNOWN")).alias("state"))


@query(f"""
with {LOG} select seq, ts + interval 24 hour < timestamp '2024-01-20' as expired,
  epoch_us(case when seq % 5 = 0 then timestamp '2024-01-20' else ts end) + 3600000000 as next_cleanup_us, seq % 5 != 0 and ts + interval 1 hour <= timestamp '2024-01-20' as due from log
""")
def cleanup_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Expiry of stored keys by time to live; when the next cleanup runs after the last one, if there was any."""
    now = _at("2024-01-20")
    at, due = lookups.next_cleanup(F.when(F.col("seq") % 5 != 0, F.col("ts")), now, 3600)
    expired = F.col("ts") + F.make_dt_interval(F.lit(1)) < now
    return views.operations(spark, folder).select("seq", expired.alias("expired"), scalars.micros(at).alias("next_cleanup_us"), due.alias("due"))


@query(f"""
with {MSG_ORDERS} select message_id, coalesce(lag({{'p': priority, 'e': enqueued_at}}) over (partition by partition_id order by priority, enqueued_at, message_id)
  = {{'p': priority, 'e': enqueued_at}}, false) as same from msg
""")
def equal_keys(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.same_key_as_before(views.order_messages(spark, folder)).select("message_id", "same")


@query("""
with x as (select event_id as seq, event_id * 977 as n, event_id * 31 as s from events)
select seq, case when n < 1024 then n || ' B' when n < 1048576 then ((n * 10 + 512) // 1024) // 10 || '.' || ((n * 10 + 512) // 1024) % 10 || ' KB'
    else ((n * 10 + 524288) // 1048576) // 10 || '.' || ((n * 10 + 524288) // 1048576) % 10 || ' MB' end as bytes,
  case when n < 1000 then n || 'ms' when n < 60000 then ((n * 10 + 500) // 1000) // 10 || '.' || ((n * 10 + 500) // 1000) % 10 || 's'
    else ((n * 10 + 30000) // 60000) // 10 || '.' || ((n * 10 + 30000) // 60000) % 10 || 'm' end as duration,
  case when s < 60 then 'just now' when s < 3600 then s // 60 || 'm ago' when s < 86400 then s // 3600 || 'h ago' else s // 86400 || 'd ago' end as ago from x
""")
def human_formats(spark: SparkSession, folder: str) -> DataFrame:
    n, s = F.col("event_id") * 977, F.col("event_id") * 31
    rows = read_table(spark, folder, "events")
    return rows.select(F.col("event_id").alias("seq"), scalars.short_bytes(n).alias("bytes"), scalars.short_duration(n).alias("duration"), scalars.time_ago(s).alias("ago"))


@query(f"with {MSG_ORDERS} select message_id, row_number() over (partition by producer_id, partition_id order by enqueued_at, message_id) as number from msg")
def producer_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The counter of an idempotent producer for each place it writes to, from 1."""
    return lookups.numbered(views.order_messages(spark, folder), ["producer_id", "partition_id"], ["enqueued_at", "message_id"]).select("message_id", "number")


@query(f"""
with {LOG}, x as (select *, seq % 12 as n, (seq * 37) % 700 as age_s, (seq * 7) % 9 as late_s, (seq * 3) % 5 as since_s, seq % 13 = 0 as foreign_token from log where op = 'EXTEND')
select seq, case when foreign_token then 'wrong token' when late_s > 5 then 'grace over' when n >= 10 then 'too many extensions' when age_s > 600 then 'lifetime over'
  when n >= 1 and since_s < least(power(1.5, n - 1), 120) then 'too soon' end as refused,
  case when foreign_token or late_s > 5 or n >= 10 or age_s > 600 or (n >= 1 and since_s < least(power(1.5, n - 1), 120)) then null else least(30 * power(1.5, n), 120.0) end as next_s from x
""")
def extension_decisions(spark: SparkSession, folder: str) -> DataFrame:
    seq = F.col("seq")
    rows = views.operations(spark, folder).where("op = 'EXTEND'").select(
        "seq", (seq % 12).alias("n"), (seq * 37 % 700).alias("age_s"), (seq * 7 % 9).alias("late_s"), (seq * 3 % 5).alias("since_s"), (seq % 13 == 0).alias("foreign_token")
    )
    return leasing.extension_decisions(rows, "n", "age_s", "late_s", "since_s", "foreign_token").select("seq", "refused", "next_s")


@query(f"""
with {LINES}, t as (select producer_id as txn, min(enqueued_at) as prepared_at, bool_or(flag = 'R') as decided, count(*) > 6 as committed from line group by 1)
select txn, not decided and prepared_at + interval 300 second < timestamp '1996-01-01' as timed_out, decided and prepared_at + interval 3600 second < timestamp '1996-01-01' as dropped,
  committed and not decided as unprepared from t
""")
def txn_timeouts(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions that nobody decided in time are aborted, finished ones dropped after an hour; commits
    without a prepare are errors."""
    now = _at("1996-01-01")
    t = views.produced_lines(spark, folder).groupBy(F.col("producer_id").alias("txn"))
    t = t.agg(F.min("enqueued_at").alias("prepared_at"), F.bool_or(F.col("flag") == "R").alias("decided"), (F.count("*") > 6).alias("committed"))
    late = transactions.timed_out(t.where("not decided"), now).select("txn", F.lit(True).alias("timed_out"))
    old = transactions.timed_out(t.where("decided"), now, 3600).select("txn", F.lit(True).alias("dropped"))
    wrong = transactions.commit_errors(t.where("committed"), t.where("decided"), "txn").select("txn", F.lit(True).alias("unprepared"))
    out = t.select("txn").join(late, "txn", "left").join(old, "txn", "left").join(wrong, "txn", "left")
    return out.na.fill(False)


@query(f"""
with {TOPICS}, req as (select 'Brand#' || i as topic from range(1, 40) r(i))
select topic, case when exists (select 1 from topic t where t.topic = req.topic) then 'already exists' else 'created' end as outcome from req
""")
def create_topics(spark: SparkSession, folder: str) -> DataFrame:
    wanted = spark.range(1, 40).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("topic"))
    got = lookups.found(wanted, views.topics(spark, folder), ["topic"])
    return got.select("topic", F.when(F.col("found"), "already exists").otherwise("created").alias("outcome"))


@query(f"""
with {TOPICS}, req as (select topic, created_order % 2 = 0 as force from topic where partitions >= 45)
select topic, coalesce(force, false) as deleted, force is not null and not force as refused from topic left join req using (topic)
""")
def delete_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics go only where the request forces it."""
    t = views.topics(spark, folder)
    asked = t.where("partitions >= 45").select("topic", (F.col("created_order") % 2 == 0).alias("force"))
    rows = t.select("topic").join(asked, "topic", "left")
    return rows.select("topic", F.coalesce("force", F.lit(False)).alias("deleted"), (F.col("force").isNotNull() & ~F.col("force")).alias("refused"))


@query(f"with {MSG_ORDERS} select message_id from msg where partition_id != 2")
def purge_partition(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.order_messages(spark, folder)
    purged = leasing.filtered(rows, "orders", [2]).select("message_id")
    return rows.join(purged, "message_id", "left_anti").select("message_id")


@query("select 'orders' as topic, '0,1,2,4,6,7,9' as partitions")
def partition_changes(spark: SparkSession, folder: str) -> DataFrame:
    stored = views.partition_health(spark, folder).select("topic", "partition_id")
    add = spark.createDataFrame([("orders", 9), ("orders", 4), ("orders", 9)], "topic string, partition_id int")
    remove = spark.createDataFrame([("orders", 3), ("orders", 5), ("orders", 77)], "topic string, partition_id int")
    return lookups.partitions_changed(stored, add, remove).select("topic", F.array_join("partitions", ",").alias("partitions"))


@query(f"""
with {LINES}, s as (select producer_id, sequence, min(message_id) as message_id from line where flag != 'R' group by 1, 2),
c as (select producer_id, sequence, max(message_id) as message_id from line where flag = 'R' group by 1, 2)
select producer_id, sequence, coalesce(c.message_id, s.message_id) as message_id from s full join c using (producer_id, sequence)
""")
def dedup_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Stored entries overwritten by later ones, whatever they held."""
    rows = views.produced_lines(spark, folder)
    key = ["producer_id", "sequence"]
    stored = rows.where("flag != 'R'").groupBy(*key).agg(F.min("message_id").alias("message_id"))
    later = rows.where("flag = 'R'").groupBy(*key).agg(F.max("message_id").alias("message_id"))
    return catalog.upserted(stored, later, key)


@query(f"""
with {LINES}, ready as (select message_id, partition_id, sequence as priority, enqueued_at from line where not_before <= timestamp '1995-01-01')
select message_id, partition_id, row_number() over (partition by partition_id order by priority, enqueued_at, message_id) - 1 as candidate_rank from ready qualify candidate_rank < 5
""")
def promoted_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The scheduler's pass: delayed messages whose time has come join their partition's candidates."""
    rows = views.produced_lines(spark, folder).where(F.col("not_before") <= _at("1995-01-01")).withColumn("priority", F.col("sequence"))
    return ordering.candidates(rows, 5).select("message_id", "partition_id", "candidate_rank")


@query(f"""
with {LINES}, x as (select producer_id % 50 as producer_id, sequence % 2 as epoch, partition_id, sequence, message_id from line)
select producer_id, epoch, partition_id, max(sequence) as last_sequence, max(sequence) + 1 as expected, count(*) as messages from x group by 1, 2, 3
""")
def producer_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Producer state over several epochs and places: a new epoch starts its own sequence."""
    rows = views.produced_lines(spark, folder).select((F.col("producer_id") % 50).alias("producer_id"), (F.col("sequence") % 2).alias("epoch"), "partition_id", "sequence")
    out = rows.groupBy("producer_id", "epoch", "partition_id").agg(F.max("sequence").alias("last_sequence"), F.count("*").alias("messages"))
    return out.withColumn("expected", F.col("last_sequence") + 1)
