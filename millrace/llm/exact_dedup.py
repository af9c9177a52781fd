"""Exact deduplication through recipes of content-defined chunks. DataFrame functions only.

Each normalised text is cut where its content says so: after a sentence end, at least ``CHUNK_MIN``
code points on, at most ``CHUNK_MAX`` on. A chunk's identifier is its 64-bit hash. To verify the
identifiers, distinct (hash, chunk) pairs are gathered once, copies merged before the shuffle; a hash
that stands for several chunks is ambiguous, and those chunks alone get their whole content as their
identifier. A document is then its recipe, the ordered list of verified identifiers, and documents are
equal when their recipes are. Only distinct chunks and recipes move, never the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, as_table, free_name, materialize, spread_join

CHUNK_MIN, CHUNK_MAX = 512, 4096
#: At most so many rows (an id and 16 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1 << 17


def normalised(text: Column) -> Column:
    """The text without the six ASCII spaces; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES + "+", "")


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The text cut at content-defined places; the pieces joined are the text, the empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<=[.!?])|.{{1,{most}}}"), F.lit(0))


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64, least: int = CHUNK_MIN, most: int = CHUNK_MAX
) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after the six ASCII spaces are deleted; null counts as empty, and
    all empty texts are equal. Of a group, the row with the most code points in its original text, then
    the smallest id (of any type that can be ordered), stays; a null id comes after all others. Of rows
    repeated with the same id and length one stays. An empty table gives an empty result; other columns
    are ignored. ``hash_of``: any deterministic hash to a long; a poor one costs time, not rightness.
    """
    found = _grouped(docs, id_col, text_col, hash_of, least, most)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, hash_of=F.xxhash64, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> DataFrame:
    """``groups`` under names of its own, with the hashes t1, t2 of the original text."""
    row = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    row = row.select("id", F.monotonically_increasing_id().alias("row"), F.length("t").cast("long").alias("n"), *text_keys(F.col("t")), normalised(F.col("t")).alias("t"))
    plain = ("id", "row", "n", "t1", "t2")
    cut = row.select(*plain, F.sha2("t", 256).alias("sha"), chunks(F.col("t"), least, most).alias("c"))
    pairs = row.select(F.explode(chunks(F.col("t"), least, most)).alias("chunk"))
    pairs = pairs.select(hash_of("chunk").alias("h"), "chunk").groupBy("h", "chunk").agg(F.lit(1))
    several = materialize(pairs.groupBy("h").count().where("count > 1").select("h"))
    recipes = as_table(cut.select(*plain, "sha", F.transform("c", lambda c: hash_of(c)).alias("r")))
    recipes = recipes.withColumn("x", F.lit("").cast("string"))
    if not several.isEmpty():
        recipes = _with_contents(row, several, hash_of, least, most)
    recipes = recipes.withColumn("h", F.xxhash64("r", "x"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("id").isNull().alias("none"), "id", "row"))
    found = recipes.groupBy("h", "r", "x").agg(best.alias("best"), F.count("*").alias("group_size"))
    found = materialize(found.select(F.col("h").alias("gh"), F.col("r").alias("gr"), F.col("x").alias("gx"), "best", "group_size"))
    joined = spread_join(recipes, found, {"h": "gh", "r": "gr", "x": "gx"}, "group_size", F.xxhash64("row"))
    return joined.select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha", "t1", "t2"
    )


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a whole text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _with_contents(row: DataFrame, several: DataFrame, hash_of, least: int, most: int) -> DataFrame:
    """Recipes in which x holds the contents of chunks whose hash is ambiguous, in order."""
    plain = ("id", "row", "n", "t1", "t2")
    some = as_table(row.select(*plain, F.sha2("t", 256).alias("sha"), chunks(F.col("t"), least, most).alias("c")))
    each = some.select("row", F.posexplode("c").alias("at", "chunk")).withColumn("h", hash_of("chunk"))
    each = each.join(several, "h", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "chunk"))).alias("l"))
    each = each.select("row", F.to_json("l").alias("l"))
    out = some.select(*plain, "sha", F.transform("c", lambda c: hash_of(c)).alias("r")).join(each, "row", "left")
    return out.select(*plain, "sha", "r", F.coalesce("l", F.lit("")).alias("x"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, exactly one of each group of equal texts; all columns are kept.

    Rows are told apart by id and whole text, so other texts with the same id are left alone. Ids may
    repeat, be null or of any type; of rows that repeat in id and text any one stays."""
    found = materialize(_grouped(docs, id_col, text_col).select("id", "t1", "t2", "kept"))
    found = found.groupBy("id", "t1", "t2").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    return keep_rows(docs, materialize(found.where("n > 1 or not stays")), id_col, text_col)


def keep_rows(docs: DataFrame, judged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``judged`` (id, t1, t2, stays, n; materialized) rejects; of n equal
    rows that stay, one does. Rows that it does not name stay as they are."""
    names = {c: free_name(docs, f"judged_{c}") for c in ("id", "t1", "t2", "stays", "n")}
    judged = judged.select(*(F.col(c).alias(names[c]) for c in names))
    few = judged.count() <= MAX_BROADCAST
    t1, t2 = text_keys(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    met = F.col(id_col).eqNullSafe(F.col(names["id"])) & (t1 == F.col(names["t1"])) & (t2 == F.col(names["t2"]))
    joined = docs.join(F.broadcast(judged) if few else judged, met, "left")
    plain = joined.where(F.col(names["n"]).isNull()).select(*docs.columns)
    if judged.where(names["stays"]).isEmpty():
        return plain
    again = joined.where(F.col(names["stays"])).groupBy(*(names[c] for c in ("id", "t1", "t2")))
    one = again.agg(F.first(F.struct(*docs.columns)).alias(names["n"]))
    return plain.union(one.select(*(F.col(names["n"])[c].alias(c) for c in docs.columns)))
