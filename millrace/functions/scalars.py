"""Scalar functions of the message engine, as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def micros(ts: Column) -> Column:
    """Microseconds since 1970; does not depend on the session's time zone for timestamps without one."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def seconds_after(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


# -- backoff -----------------------------------------------------------------------------------


def exponential_backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 300.0) -> Column:
    """Seconds before the next try: none before the first attempt, then base * factor^(a-1) up to most."""
    return F.when(attempt <= 0, 0.0).otherwise(F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1.0), F.lit(most)))


def linear_backoff(attempt: Column, base: float = 1.0, step: float = 1.0, most: float = 300.0) -> Column:
    return F.when(attempt <= 0, 0.0).otherwise(F.least(F.lit(base) + (attempt - 1) * step, F.lit(most)))


def partition_backoff(retry_count: Column, most: float = 300.0) -> Column:
    """The partition's own rule: 2^retries seconds up to most; the exponent is bounded before it is used."""
    return F.least(F.pow(F.lit(2.0), F.least(F.greatest(retry_count, F.lit(0)), F.lit(20))), F.lit(most))


def unit_hash(*keys: Column) -> Column:
    """A reproducible stand-in for a random number in [0, 1): 52 bits of the keys' MD5."""
    digest = F.md5(F.concat_ws("|", *(k.cast("string") for k in keys)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def jittered(delay: Column, how: str, u: Column, most: float = 300.0) -> Column:
    """full: [0, d); equal: [d/2, d); decorrelated: [d, min(3 d, most)), d itself where that is empty."""
    if how == "full":
        return delay * u
    if how == "equal":
        return delay / 2 + delay / 2 * u
    if how == "decorrelated":
        return delay + F.greatest(F.least(delay * 3, F.lit(most)) - delay, F.lit(0.0)) * u
    if how == "none":
        return delay
    raise ValueError(f"unknown jitter {how!r}")


def ttl_clamped(ttl: Column, default: int = 86_400, least: int = 60, most: int = 604_800) -> Column:
    """Seconds to live: zero or null means the default; the rest is held within bounds."""
    wanted = F.when(ttl.isNull() | (ttl == 0), F.lit(default)).otherwise(ttl)
    return F.least(F.greatest(wanted, F.lit(least)), F.lit(most))


# -- hashing and keys ------------------------------------------------------------------------------


def rendezvous_weight(key: Column, partition: Column) -> Column:
    """Sort key of a partition's weight for a routing key: SHA-256 of the key and the partition's number
    as four little-endian bytes; its first eight bytes as a little-endian number, in hexadecimal digits
    of fixed width, so that text order is number order."""
    pid = F.lpad(F.hex(partition.cast("long")), 8, "0")
    swapped = F.concat(*(F.substring(pid, i, 2) for i in (7, 5, 3, 1)))
    digest = F.sha2(F.concat(F.encode(key, "UTF-8"), F.unhex(swapped)), 256)
    return F.concat(*(F.substring(digest, i, 2) for i in range(15, 0, -2)))


def fnv1a_mod(key: Column, buckets: int) -> Column:
    """FNV-1a of the key's UTF-8 bytes, 64 bits unsigned, modulo ``buckets``. The state is held as two
    halves of 32 bits, so that no product leaves 64 bits."""
    digits = F.hex(F.encode(key, "UTF-8"))
    octets = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.length(digits).cast("int") - 2, F.lit(0)), F.lit(2)), lambda i: i < F.length(digits)),
        lambda i: F.conv(F.substr(digits, i + 1, F.lit(2)), 16, 10).cast("long"),
    )
    low32 = (1 << 32) - 1
    # prime 2^40 + 0x1B3: the low half times 2^40 only reaches the high half
    offset_hi, offset_lo, prime = 0xCBF29CE4, 0x84222325, 0x1B3

    def step(state: Column, octet: Column) -> Column:
        lo = state["lo"].bitwiseXOR(octet)
        low = lo * prime
        high = state["hi"] * prime + F.shiftright(low, 32) + F.shiftleft(lo.bitwiseAND((1 << 24) - 1), 8)
        return F.struct(high.bitwiseAND(low32).alias("hi"), low.bitwiseAND(low32).alias("lo"))

    begin = F.struct(F.lit(offset_hi).cast("long").alias("hi"), F.lit(offset_lo).cast("long").alias("lo"))
    rest = (1 << 32) % buckets
    return F.aggregate(octets, begin, step, lambda s: ((s["hi"] % buckets) * rest + s["lo"] % buckets) % buckets)


def routing_key(topic: Column, producer: Column) -> Column:
    """The topic, or topic:producer where there is a producer."""
    return F.when(F.coalesce(producer, F.lit("")) == "", topic).otherwise(F.concat_ws(":", topic, producer))


def producer_key(producer: Column, epoch: Column) -> Column:
    return F.concat_ws(":", producer.cast("string"), epoch.cast("string"))


def ulid_valid(ulid: Column) -> Column:
    """26 Crockford characters whose time fits 48 bits; nothing else is taken."""
    return F.coalesce(ulid, F.lit("")).rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")


def ulid_millis(ulid: Column) -> Column:
    """The 48-bit time of a ULID, null where it is not valid."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.instr(F.lit(CROCKFORD), F.substr(ulid, i, F.lit(1))).cast("long") - 1)
    return F.when(ulid_valid(ulid), F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 32 + d))


def ulid_of(millis: Column, tail: Column) -> Column:
    """A ULID with the given time; ``tail``: 16 Crockford characters."""
    digits = [F.substr(F.lit(CROCKFORD), F.shiftright(millis, 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(9, -1, -1)]
    return F.concat(*digits, tail)


def lease_token(message_id: Column, attempt: Column) -> Column:
    """A token that is unique per delivery and the same in every run."""
    return F.sha2(F.concat_ws("|", message_id.cast("string"), attempt.cast("string")), 256)


# -- leases -------------------------------------------------------------------------------------------


def extension_seconds(n: Column, base: float = 30.0, growth: float = 1.5, most: float = 120.0) -> Column:
    """The extension policy: the n-th extension (from 0) lasts base * growth^n seconds, up to most."""
    return F.least(F.lit(base) * F.pow(F.lit(growth), n.cast("double")), F.lit(most))


def seconds_left(deadline: Column, now: Column) -> Column:
    return F.greatest(F.timestamp_diff("SECOND", now, deadline), F.lit(0).cast("long"))


def log_entry_bytes(topic: Column, data_bytes: Column) -> Column:
    """Size of an operation-log record: five fixed fields around the topic and the data."""
    return 4 + 4 + F.octet_length(topic) + 4 + 4 + data_bytes + 8


# -- for people -----------------------------------------------------------------------------------------


def _tenths(n: Column, unit: int) -> Column:
    """n in units with one decimal, halves rounded up, in whole numbers."""
    tenths = F.floor((n * 10 + unit // 2) / unit).cast("long")
    return F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def short_number(n: Column) -> Column:
    """999, 1.2K, 3.4M, for numbers that are not negative; halves are rounded up."""
    return (
        F.when(n >= 1_000_000, F.concat(_tenths(n, 1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(_tenths(n, 1_000), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def short_bytes(n: Column) -> Column:
    """512 B, 1.5 KB, 3.0 MB: units of 1024."""
    return (
        F.when(n >= 1 << 20, F.concat(_tenths(n, 1 << 20), F.lit(" MB")))
        .when(n >= 1 << 10, F.concat(_tenths(n, 1 << 10), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def time_ago(seconds: Column) -> Column:
    """just now, 5m ago, 3h ago, 2d ago."""

    def whole(unit: int, mark: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("long").cast("string"), F.lit(f"{mark} ago"))

    return F.when(seconds < 60, "just now").when(seconds < 3600, whole(60, "m")).when(seconds < 86_400, whole(3600, "h")).otherwise(whole(86_400, "d"))


def short_duration(ms: Column) -> Column:
    """850ms, 12.0s, 3.5m, of whole milliseconds."""
    return (
        F.when(ms < 1_000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(_tenths(ms, 1_000), F.lit("s")))
        .otherwise(F.concat(_tenths(ms, 60_000), F.lit("m")))
    )


def masked_key(key: Column) -> Column:
    """First and last four characters; the rest dots, always eight."""
    return F.when(F.length(key) <= 8, F.repeat(F.lit("•"), 8)).otherwise(F.concat(F.left(key, F.lit(4)), F.repeat(F.lit("•"), 8), F.right(key, F.lit(4))))
