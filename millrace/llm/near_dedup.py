"""Near-dedup of whole texts by the exact Jaccard likeness of their sets of word shingles.

Method. Texts with equal shingle sets are one class at once; only the classes' first documents are
compared. Candidates are the SimHash links of ``simhash`` and the members of equal MinHash bands: of
``BANDS`` bands of ``ROWS`` rows, a pair that is 0.8 alike shares none once in a million. Every candidate
that the sets' sketches leave open is then verified by the two whole shingle sets, and only verified pairs become links, whose connected
components are the groups.

A band's members are first compared with one of them each, so that a band that holds many copies of one text
costs pairs in proportion to its members. Then, of those that no link connects yet, the members of small bands are compared each with each, and all that are in some large band (which a passage brings
together that many texts share) by a join on the rarest shingles of each, which loses no pair either: first
each with the likeliest and the least of those it meets, then all that are still apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import as_table, components, gathered, materialize, spread_join
from millrace.llm.exact_dedup import keep_rows, text_keys

BANDS, ROWS = 35, 5
#: With so many of its bands' least members each member is compared first.
SEEDS = 4
#: At most so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1 << 17
#: Shingles whose rows are minimised at once.
CHUNK = 1 << 12
#: Members of a token that one task compares with all of its members.
BLOCK = 1 << 10
#: At most so many tokens, the most frequent ones, are told to every task (16 bytes each).
MAX_FREQUENT = 1 << 16
#: Rounds in which each member of a token is compared with the likeliest and the least other only.
BEST_ROUNDS = 1
#: Slots of a set's sketch.
SLOTS = 256
#: Bands with more members than this, not yet connected, are compared by their rarest shingles.
SMALL = 8

_words = [xxhash.xxh64_intdigest(f"row {i}".encode(), seed=simhash.SEED) for i in range(2 * BANDS * ROWS)]
_XOR = np.array(_words[::2], np.uint64)[:, None]
_TIMES = np.array(_words[1::2], np.uint64)[:, None] | np.uint64(1)


def shingles(text: bytes | None, words_each: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; words and hashes are those of ``simhash64``."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, x: a + x + 1))
    digest, seed = xxhash.xxh64_intdigest, simhash.SEED
    last = ends[min(words_each, len(words)) - 1 :]
    return np.unique(np.array([digest(flat[s:e], seed) for s, e in zip([0, *(e + 1 for e in ends)], last)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each MinHash band of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), CHUNK):
        mixed = (hashes[None, at : at + CHUNK] ^ _XOR) * _TIMES
        mixed ^= mixed >> np.uint64(32)
        mixed *= _TIMES
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(rows)], np.uint64)


def _banded(words_each: int):
    """(id, t1, t2, text) to (id, t1, t2, w1, w2, fp, keys): w1 and w2 stand for the whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, keys, fps = [], [], []
            for t in batch.column(3).cast(pa.binary()):
                found = shingles(t.as_py(), words_each)
                whole.append(np.frombuffer(hashlib.md5(found.tobytes()).digest(), np.int64))
                keys.append(bands(found).view(np.int64))
                fps.append(simhash.simhash64(t.as_py(), words_each))
            whole = np.array(whole, np.int64).reshape(-1, 2)
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            columns = [*(batch.column(k) for k in range(3)), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), fp, lists]
            yield pa.record_batch(columns, names=["id", "t1", "t2", "w1", "w2", "fp", "keys"])

    return run


def _sets(words_each: int):
    """(row, text) to (row, s, sketch): the shingle set, and how many of its hashes fall into each of
    SLOTS slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                found = [shingles(t.as_py(), words_each) for t in some.column(1).cast(pa.binary())]
                slots = [np.minimum(np.bincount((x % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS), 255).astype(np.uint8).tobytes() for x in found]
                whole = pa.array([x.tobytes() for x in found], pa.binary())
                yield pa.record_batch([some.column(0), whole, pa.array(slots, pa.binary())], names=["row", "s", "sketch"])

    return run


def maybe_alike(a: bytes, b: bytes, n: int, m: int, tenths: int) -> bool:
    """Whether the sketches of two sets of n and m hashes leave it open that they are alike: what two
    sets share falls into the same slots. A full slot (255) may hold any number."""
    if 10 * min(n, m) < tenths * max(n, m):
        return False
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    both = int(np.minimum(x, y).sum()) if max(x.max(), y.max()) < 255 else min(n, m)
    return 10 * both >= tenths * (n + m - both)


def alike(a: bytes, b: bytes, tenths: int) -> bool:
    """The Jaccard likeness of two sets of hashes is at least ``tenths`` / 10, in whole numbers."""
    n, m = len(a) // 8, len(b) // 8
    if 10 * min(n, m) < tenths * max(n, m):
        return False
    both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return 10 * both >= tenths * (n + m - both)


def _screened(tenths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ka", "kb", "na", "nb")]
            keep = [maybe_alike(*x, tenths) for x in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(tenths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(a.as_py(), b.as_py(), tenths) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _of(rows: DataFrame, ids: DataFrame, n: int, key: str = "row") -> DataFrame:
    """The rows whose ``key`` is among ``n`` ``ids`` (id, repeated or not), without a shuffle of ``rows`` where those are few."""
    return rows.join(F.broadcast(ids) if n <= MAX_BROADCAST else ids, rows[key] == ids["id"], "left_semi")


def _labelled(members: DataFrame, of: DataFrame) -> DataFrame:
    """The members (key, id) of the bands that are not connected yet, with their root and the band's size.
    ``of``: (node, root) of connected rows."""
    rows = members.select("key", "id").join(of.withColumnRenamed("node", "_n"), F.col("id") == F.col("_n"), "left")
    rows = rows.select("key", "id", F.coalesce("root", "id").alias("root"))
    every = Window.partitionBy("key")
    rows = rows.withColumns({"lo": F.min("root").over(every), "hi": F.max("root").over(every), "size": F.count("*").over(every)})
    return rows.where("lo < hi").select("key", "id", "root", "size")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set) to (token, df): how many of some sets hold a hash."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            flat = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(0).slice(at, 256)]
            token, df = np.unique(np.concatenate(flat), return_counts=True)
            yield pa.record_batch([pa.array(token), pa.array(df)], names=["token", "df"])


def frequent(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """A number, and the tokens of ``counts`` (token, df) that more sets hold than that, ascending, with how
    many do: ``MAX_FREQUENT`` tokens at most."""
    sizes = counts.groupBy(F.ceil(F.log2("df")).cast("int").alias("k")).agg(F.count("*").alias("c"))  # 65 at most
    above, most = 0, 1
    for k, c in sorted(map(tuple, sizes.collect()), reverse=True):
        if (above := above + c) > MAX_FREQUENT:
            most = 1 << k
            break
    rows = counts.where(F.col("df") > most).toArrow()
    token, df = (rows.column(c).to_numpy() for c in ("token", "df"))
    order = np.argsort(token)
    return most, token[order], df[order]


def _listed(tenths: int, shared: Broadcast):
    """(row, set, root) to (id, root, n, token, rare, df): the rare hashes of the set, whose number is ``rare`` (df
    0), and of the ``frequent`` ones, which come behind those, as many as its prefix has room for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, df = shared.value
        padded = np.append(token, 0)
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                found, counts, sizes = [], [], []
                for x in some.column(1):
                    own = np.frombuffer(x.as_py(), np.int64)
                    place = np.searchsorted(token, own)
                    often = (place < len(token)) & (padded[place] == own)
                    rare, known, times = own[~often], own[often], df[place[often]]
                    first = np.lexsort((known, times))[: max(0, len(own) + (-len(own) * tenths) // 10 + 1 - len(rare))]
                    found.append(np.concatenate([rare, known[first]]))
                    counts.append(np.concatenate([np.zeros(len(rare), np.int64), times[first]]))
                    sizes.append((len(own), len(rare), len(found[-1])))
                n, rare, made = np.array(sizes, np.int64).T
                which = pa.array(np.repeat(np.arange(len(found)), made))
                columns = [some.column(0).take(which), some.column(2).take(which), pa.array(np.repeat(n, made))]
                columns += [pa.array(x) for x in (np.concatenate(found), np.repeat(rare, made), np.concatenate(counts))]
                yield pa.record_batch(columns, names=["id", "root", "n", "token", "rare", "df"])

    return run


def prefix_tokens(some: DataFrame, tenths: int) -> tuple[DataFrame, DataFrame]:
    """Of sets (row, s, root), none empty: rows (id, root, n, token, rare, df) that may lie in the prefixes, and (token, df) of
    the rare hashes that two sets or more hold. The df of a row is 0 where that table has to tell it."""
    counts = some.select("s").mapInArrow(_counted, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    counts = materialize(counts.where("df > 1"))
    most, *often = frequent(counts)
    shared = some.sparkSession.sparkContext.broadcast(often)
    rows = some.mapInArrow(_listed(tenths, shared), "id long, root long, n long, token long, rare long, df long")
    return as_table(rows), counts.where(F.col("df") <= most)


def prefixes(sets: DataFrame, members: DataFrame, tenths: int) -> DataFrame:
    """(token, id, root, n, parts, sketch): the rarest shingles of each of ``members`` (id, root, each once), among
    them: two sets that are alike share one of the n - ceil(n * tenths / 10) + 1 rarest of each. Shingles that
    many share, as of a passage, come last in that order, so they bring together those only that hold little
    else. The most frequent ones are told to every task, and only those within a prefix become rows; how many
    hold a rarer one is looked up, by keys of few rows. ``parts`` blocks hold a token's members. Empty sets have none."""
    n = members.count()
    some = _of(sets.select("row", "s"), members.select("id"), n).join(members, F.col("row") == F.col("id")).select("row", "s", "root")
    tokens, counts = prefix_tokens(some.where("octet_length(s) > 0"), tenths)
    size = F.col("n") - F.ceil(F.col("n") * tenths / 10) + 1
    rare = tokens.where("df = 0").drop("df").join(counts, "token")
    alone = F.col("rare") - F.count("*").over(Window.partitionBy("id"))  # hashes that no other set holds come first
    rare = rare.withColumn("rank", alone + F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))).where(F.col("rank") <= size)
    ranked = rare.select("token", "id", "root", "n").union(tokens.where("df > 0").select("token", "id", "root", "n"))
    ranked = ranked.withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("token")) / BLOCK).cast("int"))
    return materialize(ranked.join(_of(sets.select("row", "sketch"), members.select("id"), n), F.col("id") == F.col("row")).drop("row"))


def prefix_pairs(ranked: DataFrame, tenths: int, best: bool = False) -> DataFrame:
    """(a, b): all pairs of different roots that may be alike, from ``prefixes``. With ``best``, only for each
    member of a token the likeliest and the least of those in its own block: two rows a member at most."""
    columns = ("id", "root", "n", "sketch")
    own = F.pmod(F.xxhash64("id"), "parts").cast("int")
    index = ranked.select("token", own.alias("part"), F.lit(0).alias("probe"), *columns)
    at = F.array(own) if best else F.sequence(F.lit(0), F.col("parts") - 1)
    probe = ranked.select("token", F.explode(at).alias("part"), F.lit(1).alias("probe"), *columns)
    dealt = index.union(probe).repartition("token", "part").sortWithinPartitions("token", "part", "probe")
    return dealt.mapInArrow(_met(tenths, best), "a long, b long").distinct()


def _merged(ranked: DataFrame, of: DataFrame) -> DataFrame:
    """``ranked`` with the roots that ``of`` (node, root) puts in their place, without the tokens whose members all have
    one root."""
    new = of.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    ranked = ranked.join(new, F.col("root") == F.col("_n"), "left").withColumn("root", F.coalesce("_r", "root")).drop("_n", "_r")
    ends = ranked.groupBy(F.col("token").alias("_t")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
    ranked = spread_join(ranked, gathered(ends)[0], {"token": "_t"}, "size", F.xxhash64("id", "token"))
    return ranked.where("lo < hi").drop("lo", "hi", "size")


def _met(tenths: int, best: bool):
    """Rows (token, part, probe, id, root, n, sketch), sorted by the first three, to the pairs that their
    sketches leave open, or the likeliest and the least of them for each probe. Memory: one batch, and the part of a token that the
    others are compared with."""

    def open_pairs(x: tuple, y: tuple) -> tuple:
        near = (10 * x[2][:, None] >= tenths * y[2][None, :]) & (10 * y[2][None, :] >= tenths * x[2][:, None])
        near &= x[1][:, None] != y[1][None, :]
        i, j = np.nonzero(near if best else near & (x[0][:, None] < y[0][None, :]))
        keep, bound = [], []
        for at in range(0, len(i), 1 << 14):
            p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            s, t = x[3][p], y[3][q]
            both = np.minimum(s, t).sum(axis=1, dtype=np.int64)
            full = (s.max(axis=1) == 255) | (t.max(axis=1) == 255)
            n, m = x[2][p], y[2][q]
            both = np.where(full, np.minimum(n, m), both)
            keep.append(10 * both >= tenths * (n + m - both))
            bound.append(both / (n + m - both))
        keep = np.concatenate(keep) if keep else np.empty(0, bool)
        return x[0][i[keep]], y[0][j[keep]], (np.concatenate(bound) if bound else np.empty(0))[keep]

    def of_probes(index: list, y: tuple) -> np.ndarray:
        a, b, bound = (np.concatenate(c) for c in zip(*(open_pairs(x, y) for x in index)))
        if best:
            firsts = []
            for order in (np.lexsort((a, b)), np.lexsort((-bound, b))):
                firsts.append(order[np.append(True, b[order][1:] != b[order][:-1])[: len(b)]])
            firsts = np.unique(np.concatenate(firsts))
            a, b = a[firsts], b[firsts]
        return np.stack([np.minimum(a, b), np.maximum(a, b)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, []
        for batch in batches:
            token, part, probe, ids, roots, n = (batch.column(k).to_numpy() for k in range(6))
            if not len(token):
                continue
            sketch = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, SLOTS)
            change = (token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (probe[1:] != probe[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1), len(token)]
            found = []
            for lo, hi in zip(cuts, cuts[1:]):
                now, some = (token[lo], part[lo]), tuple(c[lo:hi] for c in (ids, roots, n, sketch))
                if now != key:
                    key, index = now, []
                if probe[lo] == 0:
                    index.append(some)
                elif index:
                    found += [of_probes(index, tuple(c[at : at + 256] for c in some)) for at in range(0, hi - lo, 256)]
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _ends(rows: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The rows at either end of the ``n`` ``pairs``."""
    ids, n = pairs.select(F.explode(F.array("a", "b")).alias("id")), 2 * n
    if n > MAX_BROADCAST:
        ids, n = gathered(ids.distinct())
    return _of(rows, ids, n)


def links(texts: DataFrame, rows: DataFrame, words_each: int, radius: int, tenths: int) -> DataFrame:
    """Verified links (a, b) between rows that connect all pairs that are alike. ``rows``: (row, t1, t2,
    fp, keys) of the documents to compare; ``texts``: (t1, t2, t), among others theirs."""
    many = Window.partitionBy("key")
    members = rows.select(F.explode("keys").alias("key"), F.col("row").alias("id")).withColumn("_size", F.count("*").over(many))
    members = materialize(members.where("_size > 1").select("key", "id"))

    # each member with those least members of its bands with which it shares the most bands
    seeds = members.withColumn("seed", F.min("id").over(many)).where("id != seed")
    seeds = seeds.groupBy("id", "seed").agg(F.count("*").alias("shared")).groupBy("id")
    seeds = seeds.agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "seed")), asc=False), 1, SEEDS).alias("s"))  # a band each at most
    first = seeds.select(F.col("id").alias("b"), F.explode("s.seed").alias("a")).select("a", "b")
    by_bits = simhash.links(materialize(rows.groupBy("fp").agg(F.min("row").alias("id"))), radius)
    by_bits, _ = gathered(by_bits.select(*_pair(F.col("a"), F.col("b"))).where("a != b").distinct())
    ids = gathered(members.select("id").union(by_bits.select("a")).union(by_bits.select("b")).distinct())
    wanted, n = gathered(_of(rows, *ids).select("row", F.col("t1").alias("_1"), F.col("t2").alias("_2")))
    small = n <= MAX_BROADCAST
    found = texts.join(F.broadcast(wanted) if small else wanted, (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")))
    sets = found.select("row", "t").mapInArrow(_sets(words_each), "row long, s binary, sketch binary")
    sets = as_table(sets.dropDuplicates(["row"]))
    sketches = sets.select("row", "sketch", (F.octet_length("s") / 8).cast("int").alias("n"))

    def both(pairs: DataFrame, some: DataFrame, *columns: str) -> DataFrame:
        a, b = (some.select(F.col("row").alias(f"_{c}"), *(F.col(x).alias(x[0] + c) for x in columns)) for c in "ab")
        return pairs.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).drop("_a", "_b")

    def verified(pairs: DataFrame) -> DataFrame:
        """First by the sketches, which move little; then by the whole sets of what is left."""
        pairs, n = gathered(pairs)
        short = both(pairs, _ends(sketches, pairs, n).withColumnRenamed("sketch", "ketch"), "ketch", "n").select("a", "b", "ka", "kb", "na", "nb")
        return by_sets(short.mapInArrow(_screened(tenths), "a long, b long"))

    def by_sets(pairs: DataFrame) -> DataFrame:
        pairs, n = gathered(pairs)
        whole = both(pairs, _ends(sets, pairs, n), "s").select("a", "b", "sa", "sb")
        return gathered(whole.mapInArrow(_verified(tenths), "a long, b long"))[0]

    found = verified(first)
    of = materialize(components(found))
    members, _ = gathered(_labelled(members, of))
    few = members.where(F.col("size") <= SMALL)
    other = few.select(F.col("key").alias("_k"), F.col("id").alias("_i"), F.col("root").alias("_r"))
    met = (F.col("key") == F.col("_k")) & (F.col("id") < F.col("_i")) & (F.col("root") != F.col("_r"))
    more = few.join(other, met).select(*_pair(F.col("id"), F.col("_i")))
    for c in "ab":
        root = of.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"r{c}"))
        by_bits = by_bits.join(root, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    found = found.union(verified(more.union(by_bits.where(apart).select("a", "b")).distinct()))
    many_in, n = gathered(members.where(F.col("size") > SMALL).select("id", "root").distinct())
    if n:
        # the likeliest first: what they connect is not compared again, so that a family costs rows in proportion
        # to its members; then all pairs that are still apart
        ranked = prefixes(sets, many_in, tenths)
        roots = many_in.select(F.col("id").alias("_i"), "root")
        for _ in range(BEST_ROUNDS):
            likely = by_sets(prefix_pairs(ranked, tenths, best=True))
            found = found.union(likely)
            for c in "ab":
                likely = likely.join(roots.withColumnRenamed("root", f"r{c}"), F.col(c) == F.col("_i")).drop("_i")
            of = materialize(components(likely, "ra", "rb"))
            ranked = materialize(_merged(ranked, of))
            new = of.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            roots = roots.join(new, F.col("root") == F.col("_n"), "left").select("_i", F.coalesce("_r", "root").alias("root"))
        found = found.union(by_sets(prefix_pairs(ranked, tenths)))
    return found


def grouped(docs: DataFrame, id_col: str, text_col: str, words_each: int, radius: int, tenths: int) -> DataFrame:
    """(id, row, t1, t2, component_id, stays) of each row. Rows are told apart by numbers of their own."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), *text_keys(text), text.alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(_banded(words_each), f"id {kind}, t1 long, t2 long, w1 long, w2 long, fp long, keys array<long>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    firsts = rows.groupBy("w1", "w2").agg(F.min_by(F.struct("row", "t1", "t2", "fp", "keys"), rank).alias("x"), F.min(rank).alias("best"), F.count("*").alias("n"))
    firsts = materialize(firsts.select("w1", "w2", "best", "n", "x.*"))
    found = links(texts.select("t1", "t2", "t"), firsts.select("row", "t1", "t2", "fp", "keys"), words_each, radius, tenths)
    of = components(found).select(F.col("node").alias("_n"), "root")
    classes = firsts.select("w1", "w2", "best", "n", "row").join(of, F.col("row") == F.col("_n"), "left")
    classes = materialize(classes.select("w1", "w2", "best", "n", F.coalesce("root", "row").alias("root")))
    least = classes.groupBy("root").agg(F.min("best").alias("least")).withColumnRenamed("root", "_r")
    classes = classes.join(least, F.col("root") == F.col("_r")).select(F.col("w1").alias("_1"), F.col("w2").alias("_2"), "n", "least")
    all_rows = rows.select("id", "row", "t1", "t2", "w1", "w2")
    out = spread_join(all_rows, materialize(classes), {"w1": "_1", "w2": "_2"}, "n", F.xxhash64("row"))
    return out.select("id", "row", "t1", "t2", F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("stays"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, radius: int = 6, tenths: int = 8) -> DataFrame:
    """(id, component_id) of each row: the least id reachable over pairs whose shingle sets are at least
    ``tenths`` / 10 alike, itself included. Texts without words (null, empty) are alike; repeated rows
    share a component; an id that is null counts as greater than any other, and is the component's where
    no row has another. Rows of other texts with the same id are rows of their own. An empty table gives
    an empty result."""
    return grouped(docs, id_col, text_col, words_each, radius, tenths).select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, radius: int = 6, tenths: int = 8) -> DataFrame:
    """The rows of ``docs`` without the near copies: of each component exactly one row stays, that of the
    least id (a null id last). All columns are kept. Rows are told apart by id and whole text, so another
    text with the same id is left alone."""
    found = grouped(docs, id_col, text_col, words_each, radius, tenths)
    found = found.groupBy("id", "t1", "t2").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    return keep_rows(docs, materialize(found.where("n > 1 or not stays")), id_col, text_col)
