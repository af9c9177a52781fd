"""SimHash near-duplicates, compared through tables of distances to reference fingerprints (pivots).

Method. Every whole text gets a 64-bit SimHash of its word shingles; equal fingerprints are merged at
once, so only distinct ones are compared. Two fingerprints within ``radius`` bits differ by at most
``radius`` in their distance to any reference fingerprint. Each task keeps a table of the distances of
its fingerprints to ``PIVOTS``, throws out every pair with a larger difference in some coordinate, and
verifies the pairs left by counting differing bits.

Pivot distances alone cannot deal the work out to tasks without losing pairs: distances to random
references lie so close together that a cell of the table would hold nearly everything. So tasks get
their fingerprints by the pigeonhole rule, which loses no pair: of ``radius + m`` bit segments, two
linked fingerprints agree in at least ``m``; each choice of ``m`` segments is a key. ``m`` follows from
the number of distinct fingerprints, so that a key holds about 64 of them at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, materialize, spread_join

SEED = 42
#: Reference fingerprints: fixed pseudo-random 64-bit words, from a rule.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), seed=SEED) for i in range(16)], dtype=np.uint64)
#: A key with more fingerprints than this is searched outward from seeds, not pair by pair.
SMALL = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def simhash64(text: bytes | None, words_each: int = 4) -> int:
    """The SimHash of a UTF-8 text: A-Z lower-cased, words cut at the six ASCII spaces, XXH64 of
    each run of ``words_each`` words. No words (or a null text) give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_each + 1)
    flat = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, x: a + x + 1))  # of word i, before its space
    starts = [0, *(e + 1 for e in ends)]
    last = ends[min(words_each, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        some = [digest(flat[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], last[at : at + BLOCK])][: n - at]
        bits = np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _hashed(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((simhash64(t.as_py(), words_each) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4) -> DataFrame:
    """(id, fp long) for every row; null and empty texts get 0. Other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        _hashed(words_each), f"id {kind}, fp long"
    )


def segment_keys(n_distinct: int, radius: int, bits: int = 64) -> list[list[int]]:
    """Bit masks (each a list of bit numbers) such that fingerprints within ``radius`` agree on one."""
    m = 1
    while n_distinct / 2 ** (bits * m / (radius + m)) > SMALL and m < 8:
        m += 1
    parts = [list(p) for p in np.array_split(np.arange(bits), radius + m)]
    return [sorted(int(b) for p in some for b in p) for some in combinations(parts, m)]


def _links(radius: int):
    """Rows (key, fp, id) sorted by key in, links (a, b) between ids out. Memory: one batch and the
    key that is still open."""

    def screened(table: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        for k in range(table.shape[1]):  # the largest coordinate difference must not pass the radius
            keep = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        return np.stack([i[keep], j[keep]])

    def grown(fps: np.ndarray, table: np.ndarray, first: int, last: int) -> list[np.ndarray]:
        """Links that connect what is linked: outward from seeds, each fingerprint reached once."""
        out, rest = [], np.arange(first, last)
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                at = todo.pop()
                near = np.abs(table[rest] - table[at]).max(axis=1) <= radius
                near[near] = np.bitwise_count(fps[rest[near]] ^ fps[at]) <= radius
                hit = rest[near]
                if len(hit):
                    out.append(np.stack([np.full(len(hit), at), hit]))
                    todo.extend(hit)
                    rest = rest[~near]
        return out

    def solve(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(keys)]
        size = last - first
        out = [np.empty((2, 0), np.int64)]
        for k in np.flatnonzero(size > SMALL):
            out += grown(fps, table, first[k], last[k])
        end = np.repeat(np.where(size > SMALL, 0, last), size)  # of the key's rows; none if many
        i, shift = np.arange(len(keys)), 1
        while len(i := i[i + shift < end[i]]):
            out.append(screened(table, fps, i, i + shift))
            shift += 1
        return np.concatenate(out, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table) -> pa.RecordBatch:
            keys, fps = (rows.column(k).to_numpy() for k in (0, 1))
            found = solve(keys, fps.view(np.uint64))
            ends = [rows.column(2).take(pa.array(x)).combine_chunks() for x in found]
            return pa.record_batch(ends, names=["a", "b"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(held):
                continue
            keys = held.column(0).to_numpy()
            n = int(np.searchsorted(keys, keys[-1]))  # before the key that is still open
            if n:
                yield out(held.slice(0, n))
                held = held.slice(n)
        if held is not None and len(held):
            yield out(held)

    return run


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between ids that connect all fingerprints within ``radius`` bits: every such pair of
    a key with few members, a spanning set where a key has many. ``distinct``: (fp long, id), no fp twice.

    Rows per fingerprint are the number of keys, whatever the groups; a key's members (8 bytes and an
    id each) must fit a task, and since they are distinct and agree in the key's bits only a dense ball
    of fingerprints makes a key large."""
    keys = []
    for k, bits in enumerate(segment_keys(distinct.count(), radius)):
        mask = sum(1 << b for b in bits)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))))
    rows = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "id")
    kind = distinct.schema["id"].dataType.simpleString()
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(radius), f"a {kind}, b {kind}").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, radius: int = 4
) -> DataFrame:
    """One row per row of ``docs``: (id, fingerprint string, component_id).

    component_id is the least id reachable over links of at most ``radius`` differing bits, itself
    included. Null, empty and wordless texts have fingerprint 0 and are linked like any other; repeated
    rows share a component. A row with a null id names no component: it takes that of the rows with an
    id and its fingerprint, and null where there is none. An empty table gives an empty result. Columns
    other than the two named are ignored, whatever their names.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words_each))
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    some = distinct.where("id is not null")
    found = components(links(some.select("fp", "id"), radius))
    joined = distinct.join(found, distinct.id == found.node, "left")
    of = materialize(joined.select(F.col("fp").alias("f"), F.coalesce("root", "id").alias("component_id"), "n"))
    fps = fps.withColumn("at", F.monotonically_increasing_id())
    return spread_join(fps, of, {"fp": "f"}, "n", F.xxhash64("at")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
