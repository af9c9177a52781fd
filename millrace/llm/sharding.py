"""Sharding by extendible hashing.

A document's hash is a string of bits. The directory starts with one bucket, the empty prefix; a bucket
over the byte limit splits on its next bit, and only such a bucket, until all fit. So the shard of a
document is the shortest prefix of its hash whose documents fit together. Byte counts are gathered by
prefix before anything moves; rows then look up their shard by the prefix of their cell, and cells that
must split further than the first look foresaw are the only ones looked at again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, materialize

LIMIT = 1 << 20
#: Bits of the id's hash; rows that share an id split on that many more, from their row number.
ID_BITS = 60


def hash_bits(key: Column, row: Column) -> Column:
    """120 bits as text: the first 60 bits of the key's MD5, then 60 of the row's."""

    def bits(c: Column) -> Column:
        digest = F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
        return F.lpad(F.conv(F.substring(digest, 1, ID_BITS // 4), 16, 2), ID_BITS, "0")

    return F.concat(bits(key), bits(row))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, shard, depth, shard_bytes, shard_docs, oversize).

    ``shard`` is the hash prefix (empty: all documents fit one shard), ``depth`` its bits. n_bytes is the
    text's length in UTF-8; null and empty texts weigh nothing. Every shard is within ``limit`` bytes but
    for one that holds a single longer document (oversize). Rows that share an id, or have none, split on
    their row number. Other columns are ignored; an empty table gives an empty result.
    """
    return _sharded(docs, id_col, text_col, limit).drop("_row")


def _first_fit(rows: DataFrame, depth: int, limit: int) -> int:
    """A depth above which no bucket fits: it is looked for upward from a guess. What does not fit makes
    all above it not fit, so nothing above needs to be looked at, and no bucket gathers all cells."""
    while depth > 0:
        nodes = rows.groupBy(F.substring("bits", 1, depth)).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        if nodes.where((F.col("b") <= limit) | (F.col("n") == 1)).isEmpty():
            return depth + 1
        depth = max(0, depth - 4)
    return 0


def _sharded(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    row = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    row = row.withColumn("bits", hash_bits(F.col("id"), F.col("_row")))
    pending = materialize(row)
    total = pending.agg(F.sum("n_bytes")).first()[0] or 0
    high, found = min(ID_BITS, max(1, total // limit).bit_length() + 6), []
    low = _first_fit(pending, max(0, high - 10), limit)
    while True:
        cell = F.substring("bits", 1, high) if high else F.lit("")
        cells = materialize(pending.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
        each = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        each = each.withColumn("shard", F.expr("substring(cell, 1, depth)"))
        nodes = each.groupBy("shard", "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == 2 * ID_BITS)
        fit = nodes.where(fits)
        first = each.join(fit, ["shard", "depth"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("s"))
        leaf = materialize(cells.select("cell").join(first, "cell", "left"))
        joined = pending.withColumn("cell", cell).join(leaf, "cell", "left")
        found.append(joined.where("s is not null").select("id", "_row", "n_bytes", "s.*"))
        if leaf.where("s is null").isEmpty():
            break
        pending = materialize(joined.where("s is null").select("id", "_row", "n_bytes", "bits"))
        low, high = high + 1, min(high + 8, 2 * ID_BITS)
    out = reduce(DataFrame.union, found)
    return out.select(
        F.col("id").alias(id_col), "_row", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversize")
    )


def directory(found: DataFrame) -> DataFrame:
    """The directory behind a result of ``shards``: (shard, depth, shard_bytes, shard_docs, slots), slots
    the number of entries that point to the shard in a directory indexed by the greatest depth's bits."""
    one = found.select("shard", "depth", "shard_bytes", "shard_docs").distinct()
    deepest = one.agg(F.max("depth").alias("deepest"))
    return one.crossJoin(F.broadcast(deepest)).select(*one.columns, F.pow(F.lit(2.0), F.col("deepest") - F.col("depth")).alias("slots"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Writes the rows with all their columns as Parquet, one folder per shard below ``path``. Rows with
    no id go to the shard of the empty id. Ids must be unique."""
    shard, key = free_name(docs, "shard"), free_name(docs, "key")
    of = shards(docs, id_col, text_col, limit).select(F.col(id_col).alias(key), F.concat(F.lit("b"), "shard").alias(shard))
    rows = docs.join(of, docs[id_col].eqNullSafe(of[key])).drop(key)
    rows.repartition(shard).write.partitionBy(shard).parquet(path)
