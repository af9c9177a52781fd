"""SpotSigs fingerprints. DataFrame functions only.

Common words are anchors. A signature is the chain of the next content words after an anchor (or a run of
anchors), and a document's fingerprint is the set of its signatures. Fingerprints are compared by Jaccard
similarity. In a join, documents are dealt out by the size of their sets: sets within the threshold have
sizes within a factor, so only equal and adjacent size classes meet, on signatures rare enough that any
pair over the threshold shares one of them; the sizes prune what is left before sets are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import as_table, materialize

#: Common words of four languages, the default anchors.
ANCHORS = tuple(
    (
        "a an and are as at be but by can for from had has have he her his if in is it its of on or she that the their there they this to was we "
        "were which will with you "
        "aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für ich im ist mit nicht oder sie sich sind und vom "
        "von wie zu zum zur "
        "au aux avec ce cette dans de du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qui que sa se ses son "
        "sont sur un une vous "
        "al como con del el ella en era es esta este la las lo los más muy no nos para pero por que se sin su sus un una y"
    ).split()
)
CHAIN = 3


def _anchor_pattern(anchors: tuple[str, ...]) -> str:
    """The words as one pattern, by first letter, so that most words are ruled out by one look."""
    by: dict[str, list[str]] = {}
    for word in sorted(set(anchors)):
        by.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{a}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for a, rest in sorted(by.items()))


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """The text's set of signatures, as sorted 32-bit hashes; the start of a text counts as an anchor.

    Words are runs of letters and digits, lower-cased. Chains are shorter where the text ends. A text
    without content words has one signature, of the whole text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    # one anchor at a time: a repeated group would recurse once per word of a long run
    marked = F.regexp_replace(F.regexp_replace(words, f"(?<= )(?:{_anchor_pattern(anchors)}) ", "~"), "~+", "~")
    spots = F.lit(rf"(?:^ ~?|~)(?=([^ ~]+(?: ~?[^ ~]+){{0,{chain - 1}}}))")
    found = F.array_distinct(F.transform(F.regexp_extract_all(marked, spots, F.lit(1)), lambda c: F.hash(c)))
    return F.array_sort(F.when(F.size(found) > 0, found).otherwise(F.array(F.hash(text))))


def as_string(found: Column) -> Column:
    """A set of signatures as text: 8 hexadecimal digits each, in the set's order."""
    return F.array_join(F.transform(found, lambda x: F.right(F.lpad(F.lower(F.hex(x)), F.lit(16), F.lit("0")), F.lit(8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures (never empty)."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) of distinct ids, not null: the next in ascending order, the first after the last.
    Range partitions are ordered each by itself; what crosses a border is one row a partition."""
    ranged = materialize(ids.repartitionByRange("id").select("id", F.spark_partition_id().alias("part")))
    first = ranged.groupBy("part").agg(F.min("id").alias("first"))
    least = ranged.agg(F.min("id")).first()[0]
    border = first.select(F.col("part").alias("p"), F.lead("first").over(Window.orderBy("part")).alias("border"))
    inner = ranged.withColumn("inner", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    joined = inner.join(border, inner.part == border.p)
    return joined.select("id", F.coalesce("inner", "border", F.lit(least)).alias("next_id"))


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document in ascending order of ids, the first after the last. near_edited and near_next
    liken the fingerprint to that of the edited text and of the next document. Null texts count as empty.
    Where ids repeat, each row is edited with the next greater id, and of its rows the one whose beginning
    is least is taken. Rows without an id have no next document: what depends on it is null. An empty
    table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    rows = every.where("id is not null")
    sizes = materialize(rows.groupBy("id").agg(F.max(F.length("t")).alias("n")))
    after = _next_ids(sizes.select("id"))
    wanted = sizes.join(after.withColumnRenamed("id", "k"), F.col("id") == F.col("k"))
    wanted = materialize(wanted.select("k", "next_id", F.floor(F.col("n") / 4).cast("int").alias("q")))
    signed = rows.withColumn("s", signatures(F.col("t"))).repartition("id")
    begin = signed.join(wanted, signed.id == wanted.next_id).select("k", F.expr("substring(t, 1, q)").alias("begin"), F.col("s").alias("next_s"))
    begin = begin.groupBy("k").agg(F.min(F.struct("begin", "next_s")).alias("b"))
    n = F.length("t")
    q = F.floor(n / 4).cast("int")
    both = signed.join(begin, signed.id == begin.k).select(
        "id",
        n.cast("long").alias("n_chars"),
        "s",
        F.concat(F.substring("t", F.lit(1), n - q), F.substring(F.col("b.begin"), F.lit(1), q)).alias("e"),
        F.col("b.next_s").alias("next_s"),
    )
    both = both.withColumn("es", signatures(F.col("e")))
    alone = every.where("id is null").select("id", n.cast("long").alias("n_chars"), signatures(F.col("t")).alias("s"))
    none = {"e": F.lit(None).cast("string"), "next_s": F.lit(None).cast("array<int>"), "es": F.lit(None).cast("array<int>")}
    both = both.unionByName(alone.withColumns(none))
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("e", 256).alias("edited_sha256"),
        as_string(F.col("s")).alias("fingerprint"),
        as_string(F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es")).alias("near_edited"),
        likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id): documents with equal fingerprints, named by the least id. Null ids are left out."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("s"))
    rows = as_table(rows)
    least = materialize(rows.groupBy("s").agg(F.min("id").alias("class_id")))
    return rows.join(least, "s").select("id", "class_id", "s")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, class_id) of every document, and (a, b, likeness) of all pairs of classes
    whose fingerprints are at least ``threshold`` alike, a < b. Nothing is capped."""
    found = classes(docs, id_col, text_col)
    members = materialize(found.select("id", "class_id"))
    sets = as_table(found.where("id = class_id").select("id", "s").dropDuplicates(["id"]))
    size = F.size("s")
    each = sets.select("id", size.alias("n"), F.explode("s").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("id").orderBy("df", "sig")
    each = each.join(common, "sig").withColumn("rank", F.row_number().over(rarest))
    prefix = each.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    step = math.log(1 / threshold) if threshold < 1 else 1e-9
    prefix = materialize(prefix.select("id", "n", "sig", F.floor(F.log(F.col("n").cast("double")) / step).alias("size_class")))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("size_class", F.col("size_class") + 1)).alias("size_class"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", "size_class")
    fits = (F.col("na") <= F.col("nb")) & (F.col("a") != F.col("b")) & (F.col("na") >= F.col("nb") * threshold - 1e-9)
    pairs = left.join(right, ["sig", "size_class"]).where(fits)
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    one, two = (sets.select(F.col("id").alias(f"i{k}"), F.col("s").alias(f"s{k}")) for k in "ab")
    compared = pairs.join(one, F.col("a") == F.col("ia")).join(two, F.col("b") == F.col("ib"))
    compared = materialize(compared.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")))
    return members, compared.where(F.col("likeness") >= threshold)
