"""The training-data operators on small fixtures, against brute force or by definition."""

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, common, exact_dedup, html_text, license_scan, line_dedup, near_dedup, packing, quality, sharding, simhash, spotsigs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def documents(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


#: Nulls, empty, white space, copies, one very long text, ties, no ASCII.
HARD = [None, "", " \t\n", "same text here.", "same  text\nhere.", "same text here.", "word " * 30_000, "ß" * 5_000 + "😀" * 2_000, "a", "\x00 \x1c é", "the of and"]


@pytest.fixture(scope="module")
def hard(spark):
    """The hard texts with null ids, repeated rows and columns whose names clash with inner ones."""
    rows = [(i, t, None, None, None, 1, "x", "y") for i, t in enumerate(HARD)] + [(None, "same text here.", None, None, None, 1, "x", "y"), (3, "same text here.", "en", "s", 1, 2, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA + ", id int, t string, gone string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 2 and 5: tokens ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def test_bpe_equals_the_library(encoder, library):
    rng = random.Random(1)
    alphabet = " \t\n\x0b\x1c\x85\xa0　 abcAB'stre1٣½.,!é漢字😀́\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(3000)] + [t or "" for t in HARD]
    for text in texts:
        ids = encoder.encode(text)
        assert list(np.frombuffer(ids, "<u4")) == library.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


def test_prefix_table_appends_and_edits(encoder):
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"the and ing") for _ in range(rng.randint(0, 20)))
        more = bytes(rng.choice(b"the and ing") for _ in range(rng.randint(0, 9)))
        table = bpe.PrefixTable(encoder.vocabulary, data)
        table.append(more)
        assert table.ids() == bpe.PrefixTable(encoder.vocabulary, data + more).ids()
        assert [encoder.tokens[i] for i in table.ids()] == encoder.vocabulary.merged(data + more)
        a, b = sorted(rng.randint(0, len(data)) for _ in range(2))
        table.edit(a, b, b"xyz")
        assert table.ids() == bpe.PrefixTable(encoder.vocabulary, data[:a] + b"xyz" + (data + more)[b:]).ids()


def test_pairs_are_told_apart_without_merging(encoder, monkeypatch):
    """Whether two tokens stay apart is what merging their bytes says, and texts are encoded without merging any."""
    v, rng = encoder.vocabulary, random.Random(22)
    ranks = list(v.halves)
    pairs = [(rng.choice(ranks[: rng.choice((300, 3000, len(ranks)))]), rng.choice(ranks[: rng.choice((300, 3000, len(ranks)))])) for _ in range(20_000)]
    pairs += [(r, r) for r in ranks[:3000]]
    want = [v.merged(v.tokens[a] + v.tokens[b]) == [v.tokens[a], v.tokens[b]] for a, b in pairs]
    assert [v.apart(a, b) for a, b in pairs] == want and 500 < want.count(False)
    text = "".join(rng.choice("abcdefghij stu é") for _ in range(3000))
    ids = encoder.encode(text)
    monkeypatch.setattr(v, "merged", None)
    v.known.clear()
    again = bpe.Cutter(lambda piece: b"".join(encoder._match(m) for m in encoder.find(piece)))
    assert again.encode(text) == ids


def test_texts_edited_in_place(encoder, library):
    rng = random.Random(21)
    alphabet = " \t\n abcAB'st1,.é漢"
    for _ in range(1500):
        text, new = ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, n))) for n in (40, 5))
        a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
        after, ids = encoder.edited(text, encoder.encode(text), a, b, new)
        assert after == text[:a] + new + text[b:] and list(np.frombuffer(ids, "<u4")) == library.encode_ordinary(after), (text, a, b, new)


def test_edit_stops_where_nothing_changes(encoder):
    data = ("the quick brown fox and " * 400).encode()
    table = bpe.PrefixTable(encoder.vocabulary, data)
    asked = []
    append, table.append = table.append, lambda more: (asked.append(len(more)), append(more))
    table.edit(10, 12, b"xy")
    assert sum(asked) < 4 * max(64, encoder.vocabulary.longest)
    assert table.ids() == bpe.PrefixTable(encoder.vocabulary, data[:10] + b"xy" + data[12:]).ids()


def test_bpe_rows(spark, hard, empty, library):
    found = bpe.round_trip(hard).collect()
    assert len(found) == len(HARD) + 2
    for r in found:
        text = "same text here." if r["doc_id"] is None else HARD[r["doc_id"]] or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(empty).count() == 0


def test_moves_fill_sequences():
    rng = random.Random(3)
    for capacity in (1, 10, 64, 1024):
        for _ in range(20):
            counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, capacity))}
            got, sequences = {}, {}
            for length, first, end, sequence, each, offset in packing.moves(counts, capacity):
                got[length] = got.get(length, 0) + end - first
                for r in range(end - first):
                    sequences.setdefault(sequence + r // each, []).append((offset + r % each * length, length))
            assert got == counts
            for parts in sequences.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= capacity


def test_packing(spark, hard, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack(hard).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in enumerate(HARD):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        rows = sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))
        if i == 3:  # the repeated row
            assert len(rows) == 2
            rows = rows[:1]
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        assert sum(r["length"] for r in rows) == len(ids) and all(r["length"] == 1024 for r in rows[1:])
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)][:-1]))
        assert sum(n for _, n in parts) <= 1024
    total = sum(r["length"] for r in found)
    assert len(by_sequence) <= math.ceil(total / 1024) + 1
    assert packing.pack(empty).count() == 0


def test_packing_added_tokens(spark):
    """A text that holds the end marker as text has the id that the tokenizer file adds for it."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [mark, f"one{mark}two", f" a {mark} b ", mark * 3, f"{mark}\n é", f"x {mark[:-1]} y{mark}", f"<|{mark}|>", "word " * 3000 + mark + " word" * 3000]
    rows = packing.pieces(documents(spark, texts), keep_ids=True).orderBy("id", "piece").collect()
    for i, text in enumerate(texts):
        got = np.frombuffer(b"".join(r["ids"] for r in rows if r["id"] == i), "<u4")
        assert list(got) == [*tokenizer.encode(text, add_special_tokens=False).ids, 2] and 50256 in got


# -- 8, 10: copies --------------------------------------------------------------------------------------


def test_exact_groups(spark, hard, empty):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in HARD]
    for how in ({}, {"hash_of": lambda c: F.length(c).cast("long") % 3, "least": 4, "most": 9}):
        found = [r for r in exact_dedup.groups(hard, **how).collect()]
        assert len(found) == len(HARD) + 2
        for r in found:
            if r["doc_id"] is None or r["doc_id"] == 3:
                continue
            i = r["doc_id"]
            same = [k for k in range(len(HARD)) if norm[k] == norm[i]]
            extra = 2 if norm[i] == norm[3] else 0
            keep = max(same, key=lambda k: (len(HARD[k] or ""), -k))
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(same) + extra, keep == i)
            assert r["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()
    assert exact_dedup.groups(empty).count() == 0
    kept = exact_dedup.drop_copies(hard)
    assert kept.columns == hard.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 6, 7, 8, 9, 10]


def simhash_by_hand(text, each=4):
    lower = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + each]) for i in range(max(1, len(w) - each + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash_components(spark, hard, empty):
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(25)]
    texts = [t for b in base for t in (b, b + " " + words(rng, 1), words(rng, 1) + " " + b)] + [t for t in HARD if t != HARD[6]]
    fps = [simhash_by_hand(t) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert found == {i: (format(fps[i], "016x"), find(i)) for i in range(len(texts))}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(hard).count() == len(HARD) + 2


def test_near_dedup_goes_by_the_shingles(spark, hard, empty):
    """Groups are those of brute force over shingle sets: pairs far apart in SimHash bits are found, and
    texts near in bits by one repeated passage but unlike as sets are not linked."""
    rng = random.Random(14)
    base = [words(rng, 120).split(" ") for _ in range(40)]
    texts = [" ".join(w) for w in base]
    texts += [" ".join(w[:k] + ["other"] * (k < 120) + w[k + 1 :] + words(rng, n).split(" ")) for w, k, n in ((w, rng.randint(5, 110), rng.randint(1, 15)) for w in base)]
    texts += [" ".join([*(["one", "two", "three", "four", "five", "six"] * 60), words(rng, 12)]) for _ in range(6)]
    texts += [" ".join([*base[0][: 100 - k], *words(rng, k).split(" ")]) for k in range(1, 90)] + ["a b", "A  b", "a c", ""]
    cut = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t)) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in cut]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    far = 0
    for a in range(len(texts)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                far += bin(simhash_by_hand(texts[a], 5) ^ simhash_by_hand(texts[b], 5)).count("1") > 6
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert far
    found = near_dedup.near_groups(documents(spark, texts)).collect()
    assert {r["id"]: r["component_id"] for r in found} == {i: find(i) for i in range(len(texts))}
    kept = corpus_pipeline.without_near_copies(spark, documents(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if find(i) == i]
    assert near_dedup.keep_one(hard).columns == hard.columns and near_dedup.keep_one(empty).count() == 0


REUSED = [(5, "alpha"), (5, "beta"), (3, "beta"), (7, "alpha"), (None, "gamma"), (8, "de lta"), (8, "delta"), (8, "de lta"), (9, "delta"), (None, "beta")]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_copies_of_reused_ids(spark, kind):
    """One row of each group stays and no other text goes, though ids repeat, are null or are strings."""
    rows = [(None if i is None else (i if kind == "long" else f"id {i}"), t) for i, t in REUSED]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    named = [None if i is None else (i if kind == "long" else f"id {i}") for i in (5, 3, None, 8)]
    want = sorted(zip(map(str, named), ("alpha", "beta", "gamma", "de lta")))
    assert sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.drop_copies(docs).collect()) == want
    assert exact_dedup.groups(docs).where("kept").count() == 4
    kept = sorted((str(r["doc_id"]), r["text"]) for r in near_dedup.keep_one(docs).collect())
    near = sorted(zip(map(str, [named[0], named[1], None, named[3], named[3]]), ("alpha", "beta", "gamma", "de lta", "delta")))
    assert kept == near


def test_links_in_a_dense_ball(spark):
    """A key with many fingerprints: connected as brute force connects them, by fewer links than pairs."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(600):
        fps.add(0xABCDEF0123456789 ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, id long")
    found = simhash.links(rows)
    got = {r["node"]: r["root"] for r in common.components(found).collect()}
    root = list(range(len(signed)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    pairs = 0
    for a in range(len(signed)):
        for b in range(a):
            if bin((signed[a] ^ signed[b]) & (1 << 64) - 1).count("1") <= 4:
                pairs += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert [got.get(i, i) for i in range(len(signed))] == [find(i) for i in range(len(signed))]
    assert found.count() < pairs / 2


def test_segment_keys_lose_no_pair():
    rng = random.Random(6)
    for n in (10, 10**7, 10**9):
        keys = simhash.segment_keys(n, 4)
        for _ in range(300):
            flipped = set(rng.sample(range(64), 4))
            assert any(not flipped & set(k) for k in keys)


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jobs_of(spark, run):
    """What ``run`` returns, and in how many jobs."""
    name = f"jobs {random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_small_graphs_take_few_jobs(spark):
    """A graph of a few thousand edges is solved without a shuffle, however long its paths are."""
    rng = random.Random(9)
    nodes = rng.sample(range(-(10**12), 10**12), 3000)
    edges = [(a, b) for a, b in zip(nodes, nodes[1:]) if rng.random() < 0.99]
    found, jobs = jobs_of(spark, lambda: common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {r["node"]: r["root"] for r in found} == roots(edges) and len(found) == len(roots(edges))
    assert jobs <= 8


def roots(edges):
    root = {x: x for e in edges for x in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_over_many_files(spark, monkeypatch, kind):
    """Graphs beyond one file, and nodes that are no longs, have the same components."""
    monkeypatch.setattr(common, "ROWS_A_FILE", 16)
    rng = random.Random(10)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(30)]
    if kind == "string":
        edges = [(f"n{a}", f"n{b}") for a, b in edges]
    found = common.components(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(5)).collect()
    linked = [(a, b) for a, b in edges if a != b]
    assert {r["node"]: r["root"] for r in found} == roots(linked) and len(found) == len(roots(linked))


def test_few_rows_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 100)
    few, n = common.gathered(spark.range(0, 90, 1, 20))
    assert n == 90 and few.rdd.getNumPartitions() == 1 and sorted(r["id"] for r in few.collect()) == list(range(90))
    many, n = common.gathered(spark.range(0, 120, 1, 20))
    assert n == 120 and many.rdd.getNumPartitions() == 20 and many.count() == 120
    none, n = common.gathered(spark.range(0))
    assert n == 0 and none.count() == 0


# -- 3, 7, 9 --------------------------------------------------------------------------------------------


def test_spotsigs(spark, hard, empty):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "of", "und", "la"]) + " " + words(rng, 3) for _ in range(n)) for n in (1, 5, 40, 80)] + ["", "the of", "!!"]
    found = {r["doc_id"]: r for r in spotsigs.against_edits(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        after, q, r = texts[(i + 1) % len(texts)], len(text) // 4, found[i]
        edited = text[: len(text) - q] + after[:q]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])
        assert r["near_next"] == (1 if r["fingerprint"] == found[(i + 1) % len(texts)]["fingerprint"] else r["near_next"])
    assert found[3]["near_edited"] > 0.4 and found[3]["near_next"] < 0.1
    rows = spotsigs.against_edits(hard).collect()
    assert len(rows) == len(HARD) + 2 and sum(r["near_next"] is None for r in rows) == 1
    assert spotsigs.against_edits(empty).count() == 0


def test_spotsigs_chains(spark):
    row = spark.createDataFrame([("The cat, of the big red dog and",)], "t string")
    hashed = row.select(F.array_sort(F.array(*(F.hash(F.lit(x)) for x in ("cat ~big red", "big red dog")))).alias("want"), spotsigs.signatures(F.col("t")).alias("got")).first()
    assert hashed["want"] == hashed["got"]


def test_spotsigs_join(spark):
    rng = random.Random(8)
    base = [" ".join("the " + words(rng, 3) for _ in range(30)) for _ in range(12)]
    texts = base + [b + " the one more end" for b in base] + base[:3] + [words(rng, 50)]
    docs = documents(spark, texts)
    sets = {r["doc_id"]: set(r["s"]) for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    members, pairs = spotsigs.near_pairs(docs)
    assert {r["id"]: r["class_id"] for r in members.collect()} == {i: first[frozenset(s)] for i, s in sets.items()}
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want


def test_license_scan(spark, hard, empty):
    rng = random.Random(9)
    mit = license_scan.TEMPLATES[2][1]
    cut = mit.split(" ")
    near = " ".join(cut[:20] + ["really"] + cut[20:])
    texts = [words(rng, 40) + " " + mit + " " + words(rng, 9), near.upper(), words(rng, 7) + "\nReleased  under the MIT License.", "license of no kind", " ".join(cut[:20]), None]
    found = license_scan.scan(documents(spark, texts)).collect()
    assert {(r["doc_id"], r["template"]) for r in found} == {(0, 2), (1, 2), (2, 0)}
    assert all(r["containment"] >= 0.8 for r in found)
    assert license_scan.scan(hard).count() == license_scan.scan(empty).count() == 0
    assert license_scan.scan(documents(spark, texts), texts=()).count() == 0
    twice = documents(spark, texts).union(documents(spark, texts[:1])).withColumns({"row": F.lit("x"), "s": F.lit(1), "license": F.lit(None).cast("string")})
    assert license_scan.scan(twice).where("template = 2").count() == 3
    with pytest.raises(ValueError):
        license_scan.templates((("MIT", "MIT License"),))
    for t in license_scan.templates():
        n, rows = license_scan.bands(len(t.words), t.window)
        size, shared = max(1, len(t.words) - 4), math.ceil(0.8 * max(1, len(t.words) - 4))
        jaccard = shared / (size + max(1, t.window - 4) - shared)
        assert (1 - min(1, jaccard) ** rows) ** n <= 1e-9
    hits = license_scan.hitting_words(license_scan.templates())
    assert all(set(s.split(" ")) & set(hits) for t in license_scan.templates() for s in t.shingles)


def edited(rng, line, n):
    out = list(line)
    for _ in range(n):
        k, how = rng.randint(0, len(out)), rng.random()
        if how < 0.34:
            out.insert(k, rng.choice("abcé😀"))
        elif out:
            k = min(k, len(out) - 1)
            out[k : k + 1] = [] if how < 0.67 else [rng.choice("abcé😀")]
    return "".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance(spark):
    rng = random.Random(10)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randint(0, 14)))
        pairs.append(tuple(sorted((a, edited(rng, a, rng.randint(0, 4))), key=len)))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, short string, long string")
    for r in line_dedup.within(rows, 2).collect():
        d = distance(*pairs[r["i"]])
        assert r["distance"] == (d if d <= 2 else None), pairs[r["i"]]


def test_line_classes_and_links(spark, hard, empty):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(3, 60))).strip() or "x" for _ in range(30)]
    texts = ["\n".join(rng.choice([b, b, edited(rng, b, 1), edited(rng, b, 2), edited(rng, b, 3), ""]) for b in rng.sample(base, 8)) for _ in range(12)]
    lines = [(i, k, line.strip(" ")) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    first = {}
    for i, k, line in lines:
        first.setdefault(line, (i, k))

    def linked(a, b):
        t = min(2, min(len(a), len(b)) // 10)
        return a != b and abs(len(a) - len(b)) <= t and distance(a, b) <= t

    near = {a: [b for b in first if b and linked(a, b)] for a in first if a}
    found = {(r["doc_id"], r["line_no"]): r for r in line_dedup.duplicates(documents(spark, texts)).collect()}
    assert len(found) == len(lines)
    for i, k, line in lines:
        r = found[i, k]
        if not line:
            assert (r["class_id"], r["n_links"], r["kept"]) == (None, 0, True)
            continue
        assert (r["class_id"], r["class_line"]) == first[line]
        assert r["n_copies"] == sum(x == line for _, _, x in lines) and r["n_links"] == len(near[line])
        assert r["kept"] == (first[line] == (i, k) and all(first[b] > first[line] for b in near[line]))
    assert any(near.values())
    assert line_dedup.duplicates(hard).count() == sum((t or "").count("\n") + 1 for t in HARD) + 2
    assert line_dedup.duplicates(empty).count() == 0


# -- 1, 4, 6 --------------------------------------------------------------------------------------------


def test_sharding(spark, hard, empty):
    rng = random.Random(12)
    texts = ["x" * rng.randint(0, 90) for _ in range(300)] + ["y" * 500, None, ""]
    found = sharding.shards(documents(spark, texts), limit=400).collect()
    sizes = {}
    for r in found:
        assert r["n_bytes"] == len(texts[r["doc_id"]] or "")
        sizes.setdefault(r["shard"], []).append(r["n_bytes"])
    for r in found:
        assert r["shard_bytes"] == sum(sizes[r["shard"]]) and r["shard_docs"] == len(sizes[r["shard"]]) and r["depth"] == len(r["shard"])
        assert r["shard_bytes"] <= 400 or r["oversize"] and r["shard_docs"] == 1
    for s in sizes:  # only oversized buckets split: a shard's parent does not fit
        assert not s or sum(sum(v) for k, v in sizes.items() if k.startswith(s[:-1])) > 400
        assert not any(k != s and k.startswith(s) for k in sizes)
    slots = sharding.directory(sharding.shards(documents(spark, texts), limit=400)).agg(F.sum("slots"), F.max("depth")).first()
    assert 0.9 * 2 ** slots[1] < slots[0] <= 2 ** slots[1]  # what is missing points to empty shards
    assert sharding.shards(hard, limit=10).count() == len(HARD) + 2
    same = spark.createDataFrame([(7, "x" * 30)] * 50, "doc_id long, text string")  # one id for all
    assert max(r["shard_bytes"] for r in sharding.shards(same, limit=100).collect()) <= 100
    assert sharding.shards(empty).count() == 0


def test_written_shards(spark, tmp_path):
    docs = documents(spark, ["x" * 50] * 20)
    sharding.write_shards(docs, str(tmp_path / "out"), limit=200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 20 and set(docs.columns) < set(back.columns)
    assert max(r["b"] for r in back.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).collect()) <= 200


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><div class="cookie-notice">We use cookies</div><nav><a href="/x">Menu</a></nav>'
    '<div id="sidebar"><p>Side, stuff</p></div><div class="post-content"><h1>T &amp; t</h1><p>One, two,\n three.</p><div class="ad">Buy, buy</div>'
    "<script>if (a<b) {}</script><p>Four<b>five</b> six<br>seven&nbsp;&eacute;&#233;</p><!-- <p>no</p> --></div><form><p>f</p></form>"
    '<section id="comments"><p>Nice, very nice, thanks, a lot, long long comment here, yes</p></section><footer>F</footer></body></html>'
)


def test_html(spark):
    assert html_text.main_text(PAGE) == "T & t One, two, three. Fourfive six seven éé"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<p>a<p>b") == "a b"
    assert html_text.main_text("<article><h1>x &am") == "x &am" and html_text.main_text("<article>x &amp") == "x &"
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert html_text.main_text("<p class='a>b") == "b"
    rows = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 1), (None, "u", "<p>z", 2), (1, "u", PAGE, 3)], "page_id long, url string, html string, text int")
    found = html_text.extract(rows).collect()
    assert [r["n_chars"] for r in found] == [len(r["text"]) for r in found] and len(found) == 4
    assert html_text.extract(rows.limit(0)).count() == 0


PROSE = "<p>A long paragraph of the article, with commas, and some more words, so that it counts.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a>m</a></nav><div class='content has-ads'>{PROSE * 5}</div>",
        f"<div class='post-content comments-open'>{PROSE * 5}</div><div class='comment'>{PROSE[:40]}</div>",
        f"<body><form action='/x'><input><label>l</label><div>{PROSE * 5}</div></form></body>",
        f"<div class='widget'>{PROSE * 5}</div>",
        f"<body><article><header></header>{PROSE * 5}</article><form><p>Send, send.</p></form></body>",
    ],
)
def test_html_keeps_articles(page):
    assert html_text.main_text(page) == " ".join([PROSE[3:-4]] * 5)


def test_html_keeps_siblings():
    lead = "<div class='lead'><p>The lead stands alone in its own container, but it is a part of the article as well, of course.</p></div>"
    page = f"<body><h1>Title</h1><p>Short lead.</p>{lead}<div>{PROSE * 30}</div><pre>code(here)</pre><div><a href='/'>more links, more, more</a></div></body>"
    found = html_text.main_text(page)
    assert found.startswith("Title Short lead. The lead stands") and found.endswith("code(here)") and "more links" not in found
    assert html_text.main_text(f"<article><header><h1>T</h1></header>{PROSE}</article>") == "T " + PROSE[3:-4]
    assert len(html_text.main_text("<div><p>word, word</p>" * 20_000)) == 20_000 * 11 - 1


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(13)
    good = [words(rng, rng.randint(20, 60)) + "." for _ in range(160)]
    bad = [" ".join(w + "!!" for w in words(rng, rng.randint(20, 60)).upper().split(" ")) for _ in range(80)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 160), 0) for i in range(240) if i % 3]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_co_training(spark, graded, hard, empty):
    docs, labels = graded
    found = quality.classify(docs, labels).collect()
    held = [r["keep"] == (r["doc_id"] < 160) for r in found if r["doc_id"] % 3 == 0]
    assert len(found) == 240 and sum(held) / len(held) > 0.95
    clashing = docs.withColumns({"y": F.lit(1), "_id": F.lit("x"), "_t": F.lit("x"), "p_text": F.lit(0)})
    assert {(r["doc_id"], r["keep"]) for r in quality.classify(clashing, labels).collect()} == {(r["doc_id"], r["keep"]) for r in found}
    kept = quality.keep_good(docs.withColumnRenamed("lang", "score"), labels)
    assert kept.columns == ["doc_id", "text", "score", "source", "n_chars"] and 120 < kept.count() < 190
    model = quality.train(docs, labels)
    assert model.score(hard).count() == len(HARD) + 2 and model.score(empty).count() == 0


def test_nothing_to_learn_from(spark, graded, empty):
    docs, labels = graded
    for some in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        rows = quality.classify(docs.limit(5), some).collect()
        assert [r["keep"] for r in rows] == [True] * 5 and all(r["score"] is None for r in rows)
    assert quality.classify(empty, labels).count() == 0


def test_family_costs_prefix_rows_in_proportion(spark):
    """Near copies that are all alike are compared with few others first, and not again once connected."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(200):
        some = list(words)
        some[rng.randrange(150)] = f"x{k}"
        texts.append((k, " ".join(some)))
    texts.append((200, " ".join(words[:50] + [f"y{i}" for i in range(100)])))
    sets = spark.createDataFrame(texts, "row long, t string").mapInArrow(near_dedup._sets(5), "row long, s binary, sketch binary")
    members = spark.range(201).select("id", F.col("id").alias("root"))
    ranked = near_dedup.prefixes(sets, members, 8)
    every = {tuple(r) for r in near_dedup.prefix_pairs(ranked, 8).collect()}
    assert len(every) > 10_000  # each with nearly each
    likely = near_dedup.prefix_pairs(ranked, 8, best=True)
    assert likely.count() <= 2 * ranked.count() and {tuple(r) for r in likely.collect()} <= every
    of = near_dedup.components(likely)
    again = {tuple(r) for r in near_dedup.prefix_pairs(near_dedup._merged(ranked, of), 8).collect()}
    root = {r["node"]: r["root"] for r in of.collect()}
    assert again == {(a, b) for a, b in every if root[a] != root[b]} and len(again) < len(every) / 20


@pytest.mark.parametrize("most", [1 << 16, 20])
def test_prefixes_make_few_rows(spark, monkeypatch, most):
    """Shingles that a family shares become rows within a prefix only; the prefixes are those of the definition."""
    monkeypatch.setattr(near_dedup, "MAX_FREQUENT", most)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(150)]
    texts = [(0, ""), (1, "one"), (2, "one"), (3, " ".join(words[:50] + [f"y{i}" for i in range(100)]))]
    for k in range(4, 150):
        some = words[: rng.choice((150, 120, 60))]
        some[rng.randrange(len(some))] = f"x{k}"
        texts.append((k, " ".join(some)))
    by = {k: set(near_dedup.shingles(t.encode(), 5).view(np.int64).tolist()) for k, t in texts}
    df = {}
    for own in by.values():
        for h in own:
            df[h] = df.get(h, 0) + 1
    want = set()
    for k, own in by.items():
        first = sorted(own, key=lambda h: (df[h], h))[: len(own) - math.ceil(len(own) * 8 / 10) + 1]
        want |= {(h, k, -k, len(own)) for h in first if df[h] > 1}
    sets = spark.createDataFrame(texts, "row long, t string").mapInArrow(near_dedup._sets(5), "row long, s binary, sketch binary")
    members = spark.createDataFrame([(k, -k) for k in by], "id long, root long")
    found = [tuple(r) for r in near_dedup.prefixes(sets, members, 8).select("token", "id", "root", "n").collect()]
    assert set(found) == want and len(found) == len(want) and len(want) > 2000
    some = sets.join(members, F.col("id") == F.col("row")).where("octet_length(s) > 0")
    tokens, rare = near_dedup.prefix_tokens(some.select("row", "s", "root"), 8)
    every, alone, asked = sum(df.values()), sum(c == 1 for c in df.values()), rare.count()
    assert tokens.where("df > 0").count() <= len(want)
    assert len(df) - alone - asked <= most
    if most > 20:
        assert asked == 0 and tokens.count() <= len(want) + alone and tokens.count() < every / 3


def test_lines_of_one_length_meet_one_way(spark):
    """Of a pair of equal length one direction is enough; no pair within the allowed edits is lost."""
    rng = random.Random(6)
    lines = {"".join(rng.choice("abcd ") for _ in range(rng.choice((12, 25, 25)))).strip() + "end" for _ in range(8)}
    for line in sorted(lines):
        for _ in range(12):
            at = rng.randrange(len(line))
            lines.add(line[:at] + rng.choice(("", "q", line[at] + "z")) + line[at + 1 :])
            lines.add(line[:at] + line[at + 1 :] + "d")
    named = sorted(lines)
    met = line_dedup.meetings(spark.createDataFrame(list(enumerate(named)), "k long, line string"))
    rows = line_dedup.meeting_pairs(met)
    twice = rows.groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(F.countDistinct("a").alias("ways"))
    assert twice.where("ways > 1").count() == 0

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(i, j) for i, a in enumerate(named) for j, b in enumerate(named[i + 1 :], i + 1) if distance(a, b) <= min(2, min(len(a), len(b)) // 10)}
    assert want <= {tuple(r) for r in line_dedup.candidates(met).collect()} and len(want) > 200


@pytest.mark.parametrize("max_edits", [1, 2, 3])
def test_lines_have_few_keys_and_lose_no_pair(spark, max_edits):
    """A line has few keys, and one within the allowed edits of a line that is not longer has a key that is that one's own."""
    rng = random.Random(13)
    pairs, sizes = [], [*range(10, 70)] * 3 + [rng.randrange(70, 500) for _ in range(150)]
    for n in sizes:
        line = "".join(rng.choice(rng.choice(("ab", "abcdefgh   ", "aé😀 "))) for _ in range(n))
        other = line
        for _ in range(min(max_edits, n // 10)):
            at = rng.choice((0, rng.randrange(len(other) + 1), len(other)))
            other = other[:at] + rng.choice(("", "q", " ", other[at : at + 1] + "z")) + other[at + 1 :]
        pairs.append(sorted((line, other), key=len))
    lines = [(2 * i + k, line, len(line), 0) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    some = spark.createDataFrame(lines, "k long, line string, length int, s long")
    by = {}
    for r in line_dedup.keys(some, max_edits).collect():
        assert r["x"] // 2 == len(pairs[r["k"] // 2][r["k"] % 2])
        by.setdefault(r["k"], []).append((r["h"], r["x"] % 2))
    for i, (a, b) in enumerate(pairs):
        t = min(max_edits, len(a) // 10)
        if t and distance(a, b) <= t:
            assert {h for h, own in by[2 * i] if own} & {h for h, _ in by[2 * i + 1]}, (a, b)
        assert sum(own for _, own in by.get(2 * i, [])) == (t + 1 if t else 0)
    if max_edits == 2:
        words = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 70))) for _ in range(500)]
        some = spark.createDataFrame([(i, w, len(w), 0) for i, w in enumerate(words)], "k long, line string, length int, s long")
        assert line_dedup.keys(some, 2).count() < 5 * len(words)


def test_what_pairs_of_lines_are_asked_is_compiled(spark):
    """The virtual machine interprets methods of over 8,000 bytes, which made a pair of lines cost five microseconds."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = spark.createDataFrame([(1, 2, 3, 60, 2), (1, 3, 5, 61, 2)], "h long, k long, s long, x long, c long")
        stages = line_dedup.meeting_pairs(met)._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_lines_are_compared_with_those_of_lengths_they_can_match_only(spark):
    """Before, the members of a segment were all compared with each other, whatever their lengths."""
    # of each of 40 lengths 5 lines, all on one segment, with sketches that rule out nothing
    met = spark.createDataFrame([(7, 100 * n + i, 0, 2 * n + 1, 200) for n in range(100, 140) for i in range(5)], "h long, k long, s long, x long, c long")
    rows = line_dedup.meeting_pairs(met)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "(other#" in plan.split("Join Inner", 1)[1].split("\n", 1)[0]
    assert rows.count() == rows.distinct().count() == 40 * 10 + 39 * 25 + 38 * 25


def test_sketches_of_lines_lose_no_pair(spark):
    """Sketches differ in as many bits as the letter counts do round a circle of eight, and lines within the allowed edits pass."""
    rng = random.Random(17)
    pairs = []
    for _ in range(300):
        line = "".join(rng.choice(rng.choice(("e", "entairsodhlucmg", "xyz é😀"))) for _ in range(rng.randint(10, 80)))
        other = edited(rng, line, rng.choice((1, 2, 2, 9)))
        pairs.append(tuple(sorted((line, other), key=len)))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, short string, long string")
    a, b = (line_dedup.sketch(F.col(c)) for c in ("short", "long"))
    rows = rows.withColumns({"a": a, "b": b}).withColumn("bits", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
    rows = rows.withColumn("passes", line_dedup._alike(F.col("a"), F.col("b"), F.length("short"), F.length("long"), 2))
    kept = 0
    for r in rows.collect():
        short, long = pairs[r["i"]]
        apart = [abs(short.count(x) % 8 - long.count(x) % 8) for x in line_dedup.LETTERS]
        assert r["bits"] == sum(min(x, 8 - x) for x in apart) and r["a"] > 0 and r["b"] > 0
        near = distance(short, long) <= min(2, len(short) // 10)
        assert r["passes"] or not near
        kept += near
    assert 100 < kept < 300 and rows.where("not passes").count() > 20


def test_texts_of_many_lines_are_fetched_without_moving_the_others(spark, monkeypatch):
    """Over MAX_BROADCAST ids, all texts were shuffled before."""
    rng = random.Random(19)
    known = [rng.getrandbits(64) - (1 << 63) for _ in range(4000)]
    rows = spark.createDataFrame([(k, f"line {k}") for k in known] * 2, "k1 long, line string")
    ids = spark.createDataFrame([(k,) for k in [*known[:300], 0, -1, (1 << 63) - 1]], "id long")
    few = sorted(tuple(r) for r in line_dedup._of(rows, ids, "k1").collect())
    assert [k for k, _ in few] == sorted(known[:300] * 2)
    maybe = line_dedup._maybe_of(rows, ids, "k1")
    assert 600 <= maybe.count() < 610
    docs = documents(spark, ["one line of some length\nanother line of some length", "one line of some lengths\nanother line of same length", "else", None])
    whole = sorted(map(str, line_dedup.duplicates(docs).collect()))
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", 0)
    assert sorted(tuple(r) for r in line_dedup._of(rows, ids, "k1").collect()) == few
    assert sorted(map(str, line_dedup.duplicates(docs).collect())) == whole


def test_lines_are_trimmed_of_ascii_spaces_only(spark):
    texts = [a + "x y" + b for a in ("", " ", "\t ", "\r", "\x0b", "\x0c", "\xa0", "　 ") for b in ("", " ", " \t", "\r", "\x0b", "\x0c", "\xa0 ", "\x1c")] + [" ", "\t\r", ""]
    found = {r["id"]: r["line"] for r in line_dedup.lines(documents(spark, texts)).collect()}
    assert found == {i: t.strip(" \t\r\x0b\x0c") for i, t in enumerate(texts)}
