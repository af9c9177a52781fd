"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that count as white space wherever a contract says [\x20\x09-\x0D].
SPACES = r"[\x20\x09-\x0D]"
#: A key with more than one row in so many is hot; so there are fewer hot keys than this.
HOT_SHARE = 1000
#: Edges of a graph, or other short rows, that are kept in one file.
ROWS_A_FILE = 1 << 16
#: So many short rows at most are gathered in few files.
FEW_ROWS = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's own setting, or a new one in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame) -> tuple[DataFrame, int]:
    """``df``, of short rows, materialized, and how many they are. Few rows come in few files: else each later
    step over a handful of them is as many tasks, files and entries in the logs as there are shuffle partitions."""
    df = materialize(df)
    n = df.count()
    return (materialize(df.coalesce(n // ROWS_A_FILE + 1)) if n <= FEW_ROWS else df), n


def as_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: for wide rows, which
    Parquet keeps smaller than a checkpoint does."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def any_of(words: list[str] | tuple[str, ...]) -> str:
    """A pattern for any of the words, by first letter, so that most places are ruled out by one look."""
    by: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        by.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{a}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for a, rest in sorted(by.items()))


def spread_join(rows: DataFrame, info: DataFrame, keys: dict[str, str], weight: str, spread: Column) -> DataFrame:
    """``rows`` with the columns of ``info``, of which each key has at most one row, joined left.

    ``keys`` maps columns of ``rows`` to those of ``info``; ``weight`` tells how many rows a key has.
    Keys that hold over a thousandth of all rows are fewer than a thousand: they are broadcast, and
    their rows go wherever ``spread`` (a hash of what tells rows apart) sends them, so that no task gets
    a hot key whole. Names of the two sides must not clash, and the first key must be a long.
    """
    total = info.agg(F.sum(weight)).first()[0] or 0
    more = [c for c in info.columns if c not in keys.values()]
    kept = info.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys.values())), F.struct(*more).alias("_found"), F.col(weight).alias("_w"))
    hot = kept.where(F.col("_w") * HOT_SHARE > total).select(*(F.col(f"_k{n}").alias(f"_h{n}") for n in range(len(keys))), F.col("_found").alias("_hot"))
    out = rows
    met = reduce(lambda a, b: a & b, (rows[k] == hot[f"_h{n}"] for n, k in enumerate(keys)))
    out = out.join(F.broadcast(hot), met, "left").drop(*(f"_h{n}" for n in range(len(keys))))
    cold = kept.where(F.col("_w") * HOT_SHARE <= total).drop("_w")
    first, *rest = keys
    at = F.when(F.col("_hot").isNull(), F.col(first)).otherwise(spread)
    out = out.withColumn("_at", at)
    met = reduce(lambda a, b: a & b, (out[k] == cold[f"_k{n + 1}"] for n, k in enumerate(rest)), out["_at"] == cold["_k0"])
    out = out.join(cold, met, "left").withColumn("_found", F.coalesce("_hot", "_found"))
    return out.select(*rows.columns, *(F.col("_found")[c].alias(c) for c in more))


def _contracted(whole: bool):
    """Edges (u, v) of longs to (u, v), with ``whole`` (node, root): of each ``ROWS_A_FILE`` edges, each node with the least one that they
    connect it with, and with ``whole`` that one with itself. Memory: so many edges and a batch."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while (apart := root[a] != root[b]).any():
            x, y = root[a[apart]], root[b[apart]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
        keep = np.ones(len(nodes), bool) if whole else root != np.arange(len(nodes))
        return pa.record_batch([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["node", "root"] if whole else ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if (n := n + len(batch)) >= ROWS_A_FILE:
                yield stars(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield stars(*map(np.concatenate, zip(*held)))

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the least node reachable.

    Each task first puts stars in the place of the edges that it holds (nodes that are longs); then the large-star
    and small-star steps alternate until no edge changes or what is left fits one file of ``ROWS_A_FILE`` edges,
    which is solved at once: a step is five shuffles, however few its edges. Only nodes that have an
    edge are returned. The smallest neighbour of a node is a partial aggregate; a node with very many
    edges is split over tasks by adaptive execution's skew join, as both joins look up one row a node.
    Null ends and self-loops are ignored; an empty input gives an empty result.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    # u > v throughout: v is the smaller end
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    longs = {kind for _, kind in e.dtypes} == {"bigint"}
    e = materialize(e.mapInArrow(_contracted(False), "u long, v long") if longs else e.distinct())
    last = None
    while (now := state(e)) != last:
        if longs and now[0] < ROWS_A_FILE:
            return e.coalesce(1).mapInArrow(_contracted(True), "node long, root long")
        last = now
        # large star: each node hands its least neighbour to its larger neighbours
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        lower = least.select(F.col("u").alias("k"), "m")
        large = e.join(lower, e.v == lower.k, "left").select("u", F.coalesce("m", "v").alias("v"))
        # small star: each node hands its least neighbour to its smaller neighbours and keeps it
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
        small = rest.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(e.coalesce(now[0] // ROWS_A_FILE + 1))  # few edges in few files
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select("v", "v").distinct())
