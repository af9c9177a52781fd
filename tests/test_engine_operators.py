"""Small fixtures for single operators: the order, selections, routing, leases, backoff."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import catalog, deadletter, delivery, ordering, producers, routing, series, transactions, validity
from millrace.plans import registry
from millrace.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def messages(spark, rows):
    """(id, partition, priority, seconds) as ready messages."""
    data = [(i, "t", p, pr, T0 + dt.timedelta(seconds=s)) for i, p, pr, s in rows]
    return spark.createDataFrame(data, "message_id string, topic string, partition_id int, priority long, enqueued_at timestamp")


def ids(df):
    return [r["message_id"] for r in df.collect()]


def test_total_order(spark):
    m = messages(spark, [("zzzz", 0, 10, 0), ("aaaa", 0, 10, 0), ("early", 0, 10, -1), ("best", 0, 5, 9), ("worst", 0, 15, 0)])
    assert ids(ordering.top_n(m, 9)) == ["best", "early", "aaaa", "zzzz", "worst"]
    assert ids(ordering.top_n(m, 9, "MAX")) == ["worst", "early", "aaaa", "zzzz", "best"]
    assert ids(ordering.top_n(m, 0)) == ids(ordering.top_n(m, -3)) == []
    with pytest.raises(ValueError):
        ordering.order("MID")


def test_fanout_yields_to_other_partitions(spark):
    m = messages(spark, [(f"a{i}", 1, 100 + i, 0) for i in range(5)] + [(f"b{i}", 2, 200 + i, 0) for i in range(5)])
    assert ids(ordering.select_best(m, 4, fanout=3).orderBy("rank")) == ["a0", "a1", "a2", "b0"]
    assert ids(ordering.select_best(m, 4, fanout=None).orderBy("rank")) == ["a0", "a1", "a2", "a3"]
    error = {r["message_id"]: r["rank_error"] for r in ordering.rank_error(m, 4, fanout=3).collect()}
    assert error == {"a0": 0, "a1": 0, "a2": 0, "b0": 2}


def test_throttled_partitions_do_not_starve_others(spark):
    m = messages(spark, [("a", 1, 1, 0), ("b", 2, 2, 0)])
    state = spark.createDataFrame([("t", 1, True), ("t", 2, False)], "topic string, partition_id int, is_throttled boolean")
    assert ids(ordering.select_best(m, 1, bound=1, partitions=state)) == ["b"]


def test_round_robin_turns(spark):
    m = messages(spark, [("a", 1, 10, 0), ("d", 1, 20, 0), ("b", 2, 11, 0), ("e", 2, 21, 0), ("c", 3, 12, 0), ("f", 3, 22, 0)])
    assert ids(ordering.select_round_robin(m, 6).orderBy("position")) == ["a", "b", "c", "e", "f", "d"]


def test_weighted_quotas(spark):
    m = messages(spark, [(f"a{p}", 1, p, 0) for p in (10, 20, 30, 40)] + [(f"b{p}", 2, p, 0) for p in (11, 21)])
    w = spark.createDataFrame([(1, 3.0), (2, 1.0)], "partition_id int, weight double")
    assert sorted(ids(ordering.select_weighted(m, w, 4))) == ["a10", "a20", "a30", "b11"]


def test_pages(spark):
    rows = spark.createDataFrame([(f"t{i}",) for i in range(5)], "topic string")
    first = ordering.page(rows, "topic", 0, 2).collect()
    assert [(r["topic"], r["next_token"]) for r in first] == [("t0", 2), ("t1", 2)]
    last = ordering.page(rows, "topic", 4, 2).collect()
    assert [(r["topic"], r["next_token"]) for r in last] == [("t4", None)]


def test_backoff_tables(spark):
    rows = spark.range(9).select(
        scalars.exponential_backoff(F.col("id"), most=60.0).alias("e"), scalars.linear_backoff(F.col("id"), most=10.0).alias("l"), scalars.partition_backoff(F.col("id") * 9).alias("p")
    ).collect()
    assert [r["e"] for r in rows] == [0, 1, 2, 4, 8, 16, 32, 60, 60]
    assert [r["l"] for r in rows] == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [r["p"] for r in rows][:2] == [1, 300] and rows[8]["p"] == 300


def test_routing_is_stable_and_minimal(spark):
    keys = spark.createDataFrame([(f"key-{i}",) for i in range(100)] + [("ключ",)], "k string")
    moved = routing.moved_keys(keys, "k", [1, 2, 3, 4], [1, 2, 3, 4, 5]).collect()
    assert {r["before"] for r in moved} == {1, 2, 3, 4}
    assert all(r["after"] == 5 for r in moved if r["moved"])
    assert routing.moved_keys(keys, "k", [4, 2, 1, 3], [1, 2, 3, 4]).where("moved").count() == 0


def test_hash_routing_by_definition(spark):
    words = ["", "a", "key-7", "ключ", "😀" * 5]

    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h % 7

    rows = spark.createDataFrame([(w,) for w in words], "k string").select("k", routing.hashed(F.col("k"), list(range(7))).alias("p"))
    assert {r["k"]: r["p"] for r in rows.collect()} == {w: fnv(w) for w in words}


def log(spark, rows):
    data = [(i, T0 + dt.timedelta(seconds=s), m, op, h) for i, (s, m, op, h) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, ts timestamp, message_id long, op string, holder string")


def test_lease_outcomes(spark):
    rows = log(
        spark,
        [
            (0, 1, "ACK", "a"),
            (1, 1, "POP", "a"),
            (2, 1, "POP", "b"),
            (3, 1, "ACK", "b"),
            (31, 1, "EXTEND", "a"),
            (61, 1, "ACK", "a"),
            (62, 1, "POP", "b"),
            (99, 1, "POP", "c"),
            (200, 1, "NACK", "c"),
            (201, 1, "NACK", "c"),
            (0, 2, "POP", "a"),
            (31, 2, "ACK", "a"),
        ],
    )
    found = {r["seq"]: r["outcome"] for r in delivery.lease_outcomes(rows, 30, 30).collect()}
    assert [found[i] for i in range(12)] == [
        "NOT_FOUND", "LEASED", "ALREADY_LEASED", "INVALID_LEASE", "EXTENDED", "ACKED", "LEASED", "REDELIVERED", "NACKED", "NOT_FOUND", "LEASED", "LEASE_EXPIRED",
    ]


def test_dedup_window_and_order(spark):
    rows = spark.createDataFrame(
        [("x", "t", 1, 1, 1, 1), ("y", "t", 1, 1, 1, 2), ("z", "t", 1, 1, 5, 3), ("v", "t", 1, 2, 1, 4)],
        "message_id string, topic string, producer_id long, epoch long, sequence long, at long",
    )
    first = {r["message_id"]: (r["original_id"], r["is_duplicate"]) for r in producers.first_wins(rows, ["at"]).collect()}
    assert first == {"x": ("x", False), "y": ("x", True), "z": ("z", False), "v": ("v", False)}
    assert {r["message_id"] for r in producers.in_order(rows, ["at"]).where("in_order").collect()} == {"x", "z", "v"}
    assert producers.sequence_window(rows, 1).count() == 2


def test_dead_letters(spark):
    rows = spark.createDataFrame([("m1", "t", "r", "p", "bm90IGpzb24=", 3, T0), ("m2", "t", "r", "p", "%%%", 1, T0), ("m3", "t", None, "p", None, 1, T0)],
                                 "message_id string, topic string, reason string, producer_id string, payload string, attempts int, moved_at timestamp")
    assert ids(deadletter.search(rows, "JSON")) == ["m1"]
    assert ids(deadletter.search(rows, "%%")) == ["m2"]
    assert deadletter.intake(rows.union(rows), 2).count() == 2
    again, left = deadletter.replay(rows, spark.createDataFrame([("m3",), ("m1",), ("no",)], "message_id string"))
    assert sorted(ids(again)) == ["m1", "m3"] and ids(left) == ["m2"] and {r["attempts"] for r in again.collect()} == {0}
    for bad in ({"since": "b", "until": "a"}, {"min_attempts": 3, "max_attempts": 2}, {"max_attempts": 2000}):
        with pytest.raises(ValueError):
            deadletter.filtered(rows, **bad)


def test_transactions(spark):
    ops = spark.createDataFrame([(1, "t", 0, True, True), (1, "t", 1, True, False), (2, "t", 0, False, True)], "txn int, topic string, partition_id int, valid boolean, applied boolean")
    state = {r["txn"]: (r["state"], r["participants"]) for r in transactions.outcomes(ops, "txn", "valid", "applied").collect()}
    assert state == {1: ("committed with errors", 2), 2: ("aborted", 1)}


def test_keys_and_ulids(spark):
    keys = ["m/t/1/id", "m/t/x/id", "tc/t", "pi/t/3", "d/t/p/1/9", "zz/t", "m//1/id"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    valid = [r["v"] for r in rows.select(catalog.parsed_key(F.col("k"))["valid"].alias("v")).collect()]
    assert valid == [True, False, True, True, True, False, False]
    ulid = spark.createDataFrame([("01ARZ3NDEKTSV4RRFFQ69G5FAV",), ("81ARZ3NDEKTSV4RRFFQ69G5FAV",), ("short",), (None,)], "u string")
    assert [r[0] for r in ulid.select(scalars.ulid_millis(F.col("u"))).collect()] == [1469922850259, None, None, None]


def test_moving_average_is_the_fold(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
    want = values[0]
    for v in values[1:]:
        want = 0.9 * want + 0.1 * v
    assert series.moving_average(rows, "k", "i", "v").first()["average"] == pytest.approx(want)


def test_message_validation_order(spark):
    rows = spark.createDataFrame([("", "", None), ("i", "", "p"), ("i", "t", ""), ("i", "t", "p" * 9), ("i", "t", "p")], "i string, t string, p string")
    error = validity.message_error(F.col("i"), F.col("t"), F.col("p"), F.lit(T0), 8)
    assert [r[0] for r in rows.select(error).collect()] == ["id required", "topic required", "payload required", "payload too large", None]


@pytest.mark.parametrize("name", ["topic_fanout", "topic_validate"])
def test_topics_of_many_parts_match_sql(spark, tmp_path, name):
    """More parts of a brand than a configured bound may be."""
    duckdb = pytest.importorskip("duckdb")
    parts = spark.range(10_006).select(F.col("id").alias("p_partkey"), F.when(F.col("id") < 4, "Brand-1").otherwise("Brand-22").alias("p_brand"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    found = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"select {', '.join(found.columns)} from ({registry.ORACLES[name]}) o").fetchall())


def test_topic_bound_is_limited(spark):
    error = validity.topic_error(F.lit("t"), F.lit(1), F.lit(1), F.col("b"), F.lit(1), F.lit(1), F.lit(1))
    rows = spark.createDataFrame([(10_000,), (10_001,), (None,)], "b int")
    assert [r[0] for r in rows.select(error).collect()] == [None, "bound out of range", None]


def test_lease_expiry_shares_state_between_messages(spark, tmp_path):
    """As many calls and state rows as there are buckets, whatever the number of messages."""
    n, kinds = 2000, ("view", "view", "purchase", "click")
    rows = [(i, T0 + dt.timedelta(seconds=i // 50), None if i in (4, 8) else i * 31 % 1500, kinds[i * 7 % 4]) for i in range(2 * n)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").withColumn("value", F.lit(0.0)).withColumn("props", F.lit(""))
    want, held = [], {}
    epoch = dt.datetime(1970, 1, 1)
    for _, ts, message, kind in rows:
        at = (ts - epoch) // dt.timedelta(microseconds=1)
        if kind != "click":
            if message in held and held[message] // 1000 + 2000 < at // 1000:
                want.append((message, held[message]))
            held.pop(message, None)
            if kind == "view":
                held[message] = at + 30_000_000
    end = max(ts for _, ts, _, kind in rows if kind != "click")
    end = (end - epoch) // dt.timedelta(microseconds=1)
    want += [x for x in held.items() if x[1] // 1000 + 2000 < end // 1000]
    steps = [events.where(F.col("event_id") < n), events.where(F.col("event_id") >= n)]
    found = [tuple(r) for r in jobs.in_steps(spark, steps, jobs.lease_expiries).collect()]
    assert sorted(found, key=str) == sorted(want, key=str) and any(m is None for m, _ in want)

    events.write.parquet(f"{tmp_path}/in")
    out = jobs.lease_expiries(jobs.event_stream(spark, f"{tmp_path}/in", 100))
    run = out.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at")
    run = run.trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(s["numRowsUpdated"] for p in run.recentProgress for s in p["stateOperators"]) <= jobs.BUCKETS + 1
