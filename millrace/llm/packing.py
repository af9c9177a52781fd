"""Packing of token sequences by best fit in bulk-synchronous rounds.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces of equal length are interchangeable,
and so are open sequences with equal gaps; there are at most ``capacity`` lengths and gaps, however many
documents. So a round works on classes: the longest class not yet placed takes its successor among the
gap classes, the smallest gap that holds it, in bulk; who gets which sequence is settled by the pieces'
rank in their class; the gaps are updated; and so on to the next class. A class that fits no gap opens
new sequences. That is best-fit decreasing. The sweep over the two class tables (at most ``capacity``
rows each, whatever the input) needs no job of its own; ranks are dealt out by a distributed sort of the
pieces, and each piece then looks up its place in the rounds' moves.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import Cutter
from millrace.llm.common import materialize

#: The ranks of the vocabulary that the tokenizer file byte_bpe_50k.json describes. The ids are the same once
#: texts are cut at the tokens that the tokenizer file adds to the ranks.
VOCABULARY = "byte_bpe_50k.tiktoken"
END_ID = 2

_cutters: dict[str, WithAdded] = {}


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokens that a tokenizer file adds to its vocabulary; none without such a file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if any(t[k] for t in found for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that look at what surrounds them")
    return {t["content"]: t["id"] for t in found}


class WithAdded(Cutter):
    """Cuts texts at the added tokens, the longest where several begin; each part is encoded by itself."""

    def __init__(self, encode_piece, added: dict[str, int]):
        super().__init__(encode_piece)
        self.ids = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split

    def encode(self, text: str) -> bytes:
        if not any(t in text for t in self.ids):
            return super().encode(text)
        parts = self.cut(text)
        return b"".join(self.ids[x] if k % 2 else super(WithAdded, self).encode(x) for k, x in enumerate(parts))


def _cutter(name: str) -> WithAdded:
    """One per Python worker. A bare file name is looked up among the public vocabularies; the tokenizer
    file lies beside the ranks."""
    if name not in _cutters:
        path = name if "/" in name else public_tokenizers.path(name)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ids = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        added = added_tokens(os.path.splitext(path)[0] + ".json")
        _cutters[name] = WithAdded(lambda text: array("I", ids(text)).tobytes(), added)
    return _cutters[name]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32[, ids binary]) for each piece of each row's ids and
    the end id. Only documents over ``capacity`` are cut: the first piece takes what is over, the others
    are full. ``row`` tells repeated ids apart. Null and empty texts are the end id alone."""
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _cutter(vocabulary).encode
        for batch in batches:
            for at in range(0, len(batch), 512):
                some, rows, out = batch.slice(at, 512), [], ([], [], [], [], [])
                for k, text in enumerate(some.column(2)):
                    ids = encode(text.as_py() or "") + end
                    start, n = 0, 0
                    while start < len(ids):
                        part = ids[start : start + (width if n else (len(ids) - 1) % width + 1)]
                        rows.append(k)
                        for column, value in zip(out, (n, start // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(value)
                        start, n = start + len(part), n + 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(out, kinds)][: 5 if keep_ids else 4]
                which = pa.array(rows, pa.int32())
                yield pa.record_batch([some.column(0).take(which), some.column(1).take(which), *columns], names=names)

    names = ["id", "row", "piece", "start", "length", "ids_crc32", "ids"][: 7 if keep_ids else 6]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("t")
    )
    schema = f"id {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return rows.mapInArrow(run, schema)


def moves(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The rounds of best fit over length classes: (length, first rank, end rank, first sequence, pieces
    in each sequence, offset). ``counts``: pieces by length."""
    out, opened = [], 0
    gaps: dict[int, deque] = {}  # gap -> runs (first, end) of sequences that have it
    order: list[int] = []  # the gaps there are, ascending

    def give(gap: int, first: int, end: int) -> None:
        if gap and first < end:
            if gap not in gaps:
                gaps[gap] = deque()
                insort(order, gap)
            gaps[gap].append((first, end))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            left = total - rank
            at = bisect_left(order, length)
            if at == len(order):  # nothing holds it: new sequences
                gap, first = capacity, opened
                end = opened = opened + -(-left // (capacity // length))
            else:
                gap = order[at]
                first, end = gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // length
            full = min(end - first, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - gap))
                give(gap - each * length, first, first + full)
                rank, left = rank + full * each, left - full * each
            first += full
            if left and first < end and left < each:  # one more takes the rest of the class
                out.append((length, rank, total, first, left, capacity - gap))
                give(gap - left * length, first, first + 1)
                rank, first = total, first + 1
            give(gap, first, end)
    return out


def assign(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """``rows`` (materialized, with length, row and piece) with sequence_id and offset added: as few
    sequences as best-fit decreasing needs, each filled from offset 0 without holes."""
    spark = rows.sparkSession
    rows = rows.withColumn("part", F.spark_partition_id())
    parts = rows.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))))
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("count")).collect()}  # at most capacity rows
    plan = spark.createDataFrame(
        moves(counts, capacity), "plan_length long, first long, end long, sequence long, each long, at long"
    )
    place = F.row_number().over(Window.partitionBy("part", "length").orderBy("row", "piece")) - 1
    ranked = rows.withColumn("rank", place)
    parts = parts.select(F.col("part").alias("p"), F.col("length").alias("l"), "before")
    ranked = ranked.join(parts, (ranked.part == parts.p) & (ranked.length == parts.l))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    # the moves are few whatever the input: at most about as many as there are lengths and gaps
    found = ranked.join(
        F.broadcast(plan), (ranked.length == plan.plan_length) & (ranked["rank"] >= plan["first"]) & (ranked["rank"] < plan["end"])
    )
    nth = F.col("rank") - F.col("first")
    inner = nth % F.col("each")
    return found.withColumn("sequence_id", F.col("sequence") + ((nth - inner) / F.col("each")).cast("long")).withColumn(
        "offset", F.col("at") + inner * F.col("length")
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Every row is packed, repeated rows each by themselves; null and empty texts are one token (the end
    id); a null id stays null. An empty table gives an empty result. Other columns are ignored.
    """
    found = assign(materialize(pieces(docs, id_col, text_col, capacity, vocabulary)), capacity)
    return found.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
