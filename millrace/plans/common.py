"""Registration of queries beside the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The evaluation times; nothing reads the clock.
ORDERS_NOW = "1998-06-01 00:00:00"
LINES_NOW = "1998-06-01 00:00:00"
EVENTS_NOW = "2024-01-20 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with its DuckDB SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The views of ``millrace.sources.views`` as DuckDB common table expressions.
MSG_ORDERS = """msg as (
  select lpad(o_orderkey::varchar, 12, '0') as message_id, (o_custkey % 4)::int as partition_id, substr(o_orderpriority, 1, 1)::bigint as priority,
         o_orderdate as enqueued_at, o_custkey::varchar as partition_key, 'cust-' || o_custkey as producer_id, o_orderstatus as payload
  from orders
)"""
LINES = """line as (
  select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 100)::bigint, round(l_extendedprice * 100)::bigint) as message_id,
         l_orderkey as producer_id, 1::bigint as epoch, l_linenumber::bigint as sequence, l_shipdate as enqueued_at, l_shipdate as not_before,
         (l_linenumber - 1)::int as retry_count, (l_suppkey % 4)::int as partition_id, l_quantity as quantity, l_discount as discount, l_returnflag as flag
  from lineitem
)"""
LOG = """log as (
  select event_id as seq, ts, user_id as message_id, (user_id % 4)::int as partition_id,
         case event_type when 'signup' then 'ENQUEUE' when 'view' then 'POP' when 'purchase' then 'ACK' when 'error' then 'NACK' when 'click' then 'EXTEND' end as op,
         'c' || (event_id % 3) as holder, value, props
  from events
)"""
LETTERS = """letter as (
  select 'm' || lpad(event_id::varchar, 8, '0') as message_id, 'topic-' || (user_id % 4) as topic, 'p' || user_id as producer_id,
         case when value < 10 then 'max retries exceeded' when value < 30 then 'Timeout waiting for ack' when value < 80 then 'handler error'
              else 'payload rejected' end as reason,
         props as body, (event_id % 7)::int as attempts, ts as moved_at
  from events where event_type = 'error'
)"""
TOPICS = r"""topic as (
  select p_brand as topic, case when regexp_extract(p_brand, '(\d+)$', 1)::int % 2 = 0 then 'MIN' else 'MAX' end as mode,
         max(p_size)::int as partitions, (count(*) % 5)::int as replication_factor, count(*)::int as top_k_bound, min(p_partkey) as created_order
  from part group by p_brand
)"""
HEALTH = """health as (
  select 'orders' as topic, i::int as partition_id, i % 3 = 1 as is_throttled, i % 5 != 4 as is_healthy, (1.0 + i % 3)::double as weight from range(8) r(i)
)"""
