"""Line deduplication by a segment-partition edit join. DataFrame functions only.

Only distinct lines are compared, and texts are shuffled for those that met another line only. A line of length l that allows t edits
has t + 1 segments; a line within t edits contains at least one of them unchanged, at a place that
the lengths and the segment's number pin down to a few. So segments are indexed by (t, number, size, content),
and each line probes the substrings at those places, for every size of a line that it could match; its own segments
are index and probe in one row. Lines of about one length have segments of one size, so that a line probes for one
size mostly. Candidates whose
letter counts differ too much are left out; the others are verified by a bit-parallel automaton over the
2t + 1 diagonals of the band, after what both lines begin and end with is cut off.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import HOT_SHARE, as_table, materialize, spread_join

#: A line allows one edit for each so many code points, up to MAX_EDITS.
CODE_POINTS_AN_EDIT, MAX_EDITS = 10, 2
#: Their counts, modulo 8, make up a line's sketch, in four bits each that stand for a count so that two codes differ in as many
#: bits as the counts are apart, round the circle: 0000, 0001, 0011, 0111, 1111, 1110, 1100, 1000.
LETTERS = "entairsodhlucmg"
CODES = sum(code << 4 * count for count, code in enumerate((0, 1, 3, 7, 15, 14, 12, 8)))
#: Lines of up to so many code points are sketched at once; longer ones, whose segments rule out most others,
#: where they meet more than CROWD others on a segment.
SKETCHED, CROWD = 96, 64
#: Of a segment in a line's midst, so many code points at most, and half of them at most, are left out before its first space.
SKIPPED = 16
#: Members of a key that one task compares with all of the key's members.
BLOCK = 1 << 10
#: At most so many rows (one to four longs) are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1 << 19
#: Bits of the bitmap that is broadcast in place of more ids (8 MB), and words of 64 bits in a row of it.
BITS, WORDS_A_ROW = 1 << 26, 1 << 9


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line) for each line, without ASCII spaces at its ends. A null or empty text is one
    empty line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    spaces = " \t\r\x0b\f"
    # trimming walks through the whole line, so it is left to those that need it
    edges = (f(F.col("line"), F.lit(c)) for f in (F.startswith, F.endswith) for c in spaces)
    return each.withColumn("line", F.when(reduce(or_, edges), F.btrim("line", F.lit(spaces))).otherwise(F.col("line")))


def _keys(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def edits(length: Column, max_edits: int = MAX_EDITS) -> Column:
    """How many edits the shorter line of a pair allows."""
    return F.least(F.lit(max_edits), F.floor(length / CODE_POINTS_AN_EDIT)).cast("int")


def _looks(max_edits: int) -> list[tuple[int, int, int, int]]:
    """(t, less, i, shift): where to look in a line for segment i of a line ``less`` shorter, or more, that allows
    t edits, as a shift of the segment's place. The line's own segments are those without less or shift."""
    out = []
    for t in range(1, max_edits + 1):
        for less in range(t + 1):
            out += [(t, less, 1, 0), (t, less, t + 1, 0)]
            out += [(t, less, i, shift) for i in range(2, t + 1) for shift in range(max(1 - i, less - (t + 1 - i)), i)]
    return out


def _base(n: Column) -> Column:
    """A length of 8 or more but for its three highest bits."""
    return n.bitwiseAND(F.call_function("shiftleft", F.lit(-1), (F.floor(F.log2(n)) - 2).cast("int")))


def _segment(n: Column, t: Column | int) -> Column:
    """The size of each of the t + 1 segments of a line of length n, in whole 64ths of ``_base``."""
    share = F.lit(64 // (t + 1)) if isinstance(t, int) else F.element_at(F.array(*(F.lit(64 // (k + 1)) for k in range(1, 16))), t)
    return F.shiftright(_base(n).cast("long") * share, 6).cast("int")


def _skipped(q: Column) -> Column:
    return F.least(F.shiftright(q, 1), F.lit(SKIPPED))


def keys(some: DataFrame, max_edits: int) -> DataFrame:
    """(h, k, s, x): hashes of the substrings of each line (k, line, length, s) that could be a segment of
    a line that is not longer; x is twice the length, and one more where the substring is a segment of the
    line itself.

    A line has t + 1 segments of one size: the last one is its end, the others follow each other from its beginning.
    Of two lines within t edits, let i be the first for which i - 1 edits at most are within or before segment i of the
    shorter one. They all are before it then, so it is whole and shifted by i - 1 at most, and t + 1 - i at most are left
    after it. The first and the last segment are looked for at the beginning and the end only. One look serves all
    lengths of one t and size, which most lines share with those a little shorter. Segments are no shorter than the shifts
    are wide, so every place lies within the line.

    In place of a segment in the line's midst stands what it has from its first space on, if one comes early, cut to
    one size: a function of the segment, so that equal ones stay equal, and mostly the same for all shifts.

    One small expression over a list of places: spelled out place by place it would be too long a method
    for the compiler."""

    def listed(places: list) -> Column:
        return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("t", "less", "i", "shift"), x))) for x in places))

    every = _looks(max_edits)
    own = [x for x in every if x[:2] == (max_edits, 0)]
    # most lines are long enough to allow max_edits whatever they are compared with
    long = F.col("length") >= CODE_POINTS_AN_EDIT * max_edits + max_edits
    q = F.col("q")
    alike = long & (_base(F.col("length") - max_edits) == _base(F.col("length")))
    single = alike
    for i in range(2, max_edits + 1):
        first = (q - 1) * (i - 1) + 1  # where the looks for segment i begin
        space = F.call_function("locate", F.lit(" "), F.col("line"), first)
        single = single & space.between(first + 2 * (i - 1), first + _skipped(q))
    looks = F.when(F.col("single"), listed([x for x in own if x[3] == 0])).when(alike, listed(own))
    looks = looks.when(long, listed([x for x in every if x[0] == max_edits])).otherwise(listed(every))
    rows = some.select("k", "s", "line", "length").withColumn("q", _segment(F.col("length"), max_edits)).withColumn("single", single)
    rows = rows.select("k", "s", "line", "length", F.explode(looks).alias("p")).select("k", "s", "line", "length", "p.*")
    t, i, shift, n = F.col("t"), F.col("i"), F.col("shift"), F.col("length") - F.col("less")
    low, most = t * CODE_POINTS_AN_EDIT, t == max_edits
    again = (F.col("less") > 0) & (most | (n + 1 < low + CODE_POINTS_AN_EDIT)) & (_base(n + 1) == _base(n))
    rows = rows.where((n >= low) & (most | (n < low + CODE_POINTS_AN_EDIT)) & ~again).withColumn("q", _segment(n, t))
    inner = (i > 1) & (i <= t)
    start = F.when(i <= t, (i - 1) * q + shift).otherwise(F.col("length") - q) + 1
    rows = rows.withColumn("text", F.substring("line", start, q))
    rows = rows.withColumn("space", F.when(inner, F.instr("text", " ")).otherwise(F.lit(0)))
    text = F.when(F.col("space").between(1, _skipped(q) + 1), F.substring("text", F.col("space"), q - _skipped(q))).otherwise(F.col("text"))
    mine = (F.col("less") == 0) & (shift == 0)
    return rows.select(F.xxhash64("t", "i", "q", text).alias("h"), "k", "s", (2 * F.col("length") + mine.cast("int")).alias("x"))


def sketch(line: Column) -> Column:
    """Never 0, which stands for a sketch that is not known."""
    out = F.lit(1 << 60)
    for k, letter in enumerate(LETTERS):
        count = F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))
        code = F.call_function("shiftright", F.lit(CODES), count.bitwiseAND(7) * 4).bitwiseAND(15)
        out = out.bitwiseOR(F.shiftleft(code.cast("long"), 4 * k))
    return out


def _alike(a: Column, b: Column, short: Column, long: Column, max_edits: int) -> Column:
    """No edit changes the letter counts by more than two in all, and as many as the lengths ``short`` and
    ``long`` differ by change them by one only. Sketches differ in no more bits than the counts do. This is asked of each pair that
    meets, so it must stay short: a condition of letter by letter was too long a method for the compiler."""
    return (a == 0) | (b == 0) | (F.bit_count(a.bitwiseXOR(b)) <= 2 * edits(short, max_edits) - (long - short))


def _shared_prefix(a: Column, b: Column) -> Column:
    """The number of code points that both begin with: by halving steps."""
    most = F.least(F.length(a), F.length(b))

    def step(have: Column, more: Column) -> Column:
        longer = have + more <= most
        same = F.substring(a, have + 1, more) == F.substring(b, have + 1, more)
        return F.when(longer, F.when(same, have + more).otherwise(have)).otherwise(have)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(24, -1, -1))), F.lit(0), step)


def within(pairs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """``pairs`` with columns short and long (the longer text), with their edit distance in
    their place, null where it is over ``max_edits``. Other columns are kept."""
    k, mask = max_edits, (1 << (2 * max_edits + 1)) - 1
    keep = [c for c in pairs.columns if c not in ("short", "long")]
    for _ in range(2):  # from the front, and reversed from the back
        pairs = pairs.withColumn("_same", _shared_prefix(F.col("short"), F.col("long")))
        pairs = pairs.withColumns({c: F.reverse(F.expr(f"substring({c}, _same + 1)")) for c in ("short", "long")})
    chars = {f"_{c}": F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)) for c in ("short", "long")}
    pairs = pairs.withColumns(chars)
    p, t, m, n = F.col("_short"), F.col("_long"), F.size("_short"), F.size("_long")

    def matches(i: Column) -> Column:
        """Bit d + k: text code point i equals pattern code point i + d."""
        bits = F.lit(0)
        for d in range(-k, k + 1):
            equal = (i + d >= 1) & (i + d <= m) & (F.try_element_at(p, F.greatest(i + d, F.lit(1))) == F.element_at(t, i))
            bits = bits + F.when(equal, 1 << (d + k)).otherwise(0)
        return bits

    masks = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), matches)).otherwise(F.array().cast("array<int>"))

    def row(state: Column, e: int) -> Column:
        return F.shiftright(state, 8 * e).bitwiseAND(mask)

    def step(state: Column, equal: Column) -> Column:
        """Row e: diagonals reached with at most e edits. A match or substitution stays on the diagonal,
        a text code point too many leads one down, a missing one leads one up."""
        new, out = None, F.lit(0)
        for e in range(k + 1):
            reached = row(state, e).bitwiseAND(equal)
            if e:
                before = row(state, e - 1)
                reached = reached.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new, 1))
            new = reached.bitwiseAND(mask)
            out = out.bitwiseOR(F.shiftleft(new, 8 * e))
        return out

    begin = sum(((((1 << (e + 1)) - 1) << k) & mask) << (8 * e) for e in range(k + 1))
    pairs = pairs.withColumn("_masks", masks)
    pairs = pairs.withColumn("_end", F.aggregate("_masks", F.lit(begin), step))
    down = n - m
    distance = F.lit(None).cast("int")
    for e in range(k, -1, -1):
        for d in range(k + 1):
            reached = row(F.col("_end"), e).bitwiseAND(1 << (k - d)) != 0
            distance = F.when((down == d) & reached, F.lit(e)).otherwise(distance)
    return pairs.select(*keep, distance.alias("distance"))


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, first struct<id, line_no>, n) of the distinct lines, empty ones left out. Texts stay
    where they are: only hashes and places are shuffled."""
    one = lines(docs, id_col, text_col).where("line != ''").select("id", "line_no", *_keys(F.col("line")))
    return materialize(one.groupBy("k1", "k2").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count("*").alias("n")))


def _maybe_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key``, a hash, has a bit in a bitmap of ``ids`` (id): all that are among them and, of a million ids, one in
    60 or so of the others. The bitmap's size does not depend on the ids."""

    def word(c: Column) -> Column:
        return F.shiftright(c.bitwiseAND(BITS - 1), 6)

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))
    none = ids.sparkSession.range(BITS // 64).select("id", F.lit(0).cast("long"))
    words = ids.select(word(F.col("id")).alias("word"), bit.alias("bits")).union(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = words.groupBy(F.floor(F.col("word") / WORDS_A_ROW).alias("row")).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits"))
    at = word(F.col(key))
    bits = F.get("bits", at.bitwiseAND(WORDS_A_ROW - 1).cast("int"))
    there = F.call_function("shiftright", bits, F.col(key).bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return rows.join(F.broadcast(bitmap), (F.floor(at / WORDS_A_ROW) == F.col("row")) & there, "left_semi")


def _of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``ids`` (id; materialized), without a shuffle where those are few, else with one of little
    more than these rows."""
    few = ids.count() <= MAX_BROADCAST
    rows = rows if few else _maybe_of(rows, ids, key)
    return rows.join(F.broadcast(ids) if few else ids, rows[key] == ids["id"], "left_semi")


def meetings(some: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(h, k, s, x, c) as of ``keys`` for lines (k, line), for those hashes that several lines share and that
    are a segment of one; c counts them. Lines repeated in any number give one. What met nothing is
    dropped where it arrives, so that little is left."""
    size = F.length("line")
    s = F.when(size <= SKETCHED, sketch(F.col("line"))).otherwise(F.lit(0))
    rows = some.select("k", "line", size.alias("length"), s.alias("s")).where(edits(size, max_edits) >= 1)
    same = Window.partitionBy("h")
    # one of each line: its own segment, where a look beside it found the same
    met = keys(rows, max_edits).repartition("h").groupBy("h", "k", "s", F.shiftright("x", 1)).agg(F.max("x").alias("x")).select("h", "k", "s", "x")
    met = met.withColumns({"c": F.count("*").over(same), "own": F.max(F.col("x") % 2).over(same)})
    return materialize(met.where("c > 1 and own = 1").drop("own"))


def meeting_pairs(met: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(a, b) for each segment of a that b holds, a the shorter, or the lesser of two that are equally long:
    those find each other from either side. From ``meetings``. A member is set beside those of the few lengths that it can match
    only: a segment's members are of many. A hash with many members is dealt out in blocks of BLOCK, each of which meets all of
    its members."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    length, na, nb = F.shiftright("x", 1), F.col("na"), F.col("nb")
    index = met.where("x % 2 = 1").select("h", F.col("k").alias("a"), F.col("s").alias("sa"), length.alias("na"), F.pmod(F.xxhash64("k"), blocks).cast("int").alias("part"))
    index = index.select("*", F.explode(F.sequence(na, na + edits(na, max_edits))).alias("other"))
    probe = met.select(F.col("h").alias("ph"), F.col("k").alias("b"), F.col("s").alias("sb"), length.alias("nb"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("at"))
    meet = (F.col("h") == F.col("ph")) & (F.col("part") == F.col("at")) & (F.col("other") == nb)
    once = (na < nb) & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b"))
    return index.join(probe, meet & once & _alike(F.col("sa"), F.col("sb"), na, nb, max_edits)).select("a", "b")


def candidates(met: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(a, b): pairs of values of k, each once, that may be within the allowed edits of each other, from
    ``meetings``."""
    pairs = meeting_pairs(met, max_edits)
    return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def links(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, max_edits: int = MAX_EDITS) -> DataFrame:
    """(a struct<k1, k2>, b, distance): pairs of distinct lines within the allowed edits, each once.
    ``found``: the ``classes``. A line counts once, however often it is there: those with more than a
    thousandth of all lines are looked up once, as they are fewer than a thousand."""
    rows = lines(docs, id_col, text_col).where("line != ''").select(*_keys(F.col("line")), "line")
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") * HOT_SHARE > total).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("first.id").alias("i"))
    hot = F.broadcast(materialize(hot))
    is_hot = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    where = lines(docs.join(hot, docs[id_col].eqNullSafe(F.col("i")), "left_semi"), id_col, text_col)
    once = where.select(*_keys(F.col("line")), "line").join(hot, is_hot, "left_semi").groupBy("k1", "k2").agg(F.first("line").alias("line"))
    once = materialize(once)  # read three times
    texts = rows.join(hot, is_hot, "left_anti").unionByName(once)
    # k1 alone tells lines apart here; should two share it, both are compared
    met = meetings(texts.select(F.col("k1").alias("k"), "line"), max_edits)
    crowded = materialize(met.where((F.col("s") == 0) & (F.col("c") > CROWD)).select(F.col("k").alias("id")).distinct())
    if not crowded.isEmpty():
        known = _of(texts, crowded, "k1").dropDuplicates(["k1", "k2"]).groupBy("k1")
        known = materialize(known.agg(F.collect_list(sketch(F.col("line"))).alias("of")))  # one; several where lines share k1
        few = known.count() <= MAX_BROADCAST
        met = met.join(F.broadcast(known) if few else known, F.col("k") == F.col("k1"), "left")
        met = met.withColumn("s", F.when(F.size("of") == 1, F.col("of")[0]).otherwise(F.col("s"))).drop("k1", "of")
    pairs = candidates(materialize(met), max_edits)
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = as_table(_of(texts, ids, "k1").dropDuplicates(["k1", "k2"]).withColumn("s", sketch(F.col("line"))))
    left, right = (texts.select(F.col("k1").alias(f"{c}_k"), F.struct("k1", "k2").alias(f"{c}_key"), F.col("line").alias(f"{c}_line"), F.col("s").alias(f"{c}_s")) for c in "ab")
    both = pairs.join(left, F.col("a") == F.col("a_k")).join(right, F.col("b") == F.col("b_k"))
    sizes = (f(F.length("a_line"), F.length("b_line")) for f in (F.least, F.greatest))
    both = both.where(_alike(F.col("a_s"), F.col("b_s"), *sizes, max_edits))
    swap = F.length("a_line") > F.length("b_line")
    both = both.select(
        F.col("a_key").alias("a"),
        F.col("b_key").alias("b"),
        F.when(swap, F.col("b_line")).otherwise(F.col("a_line")).alias("short"),
        F.when(swap, F.col("a_line")).otherwise(F.col("b_line")).alias("long"),
    ).withColumn("t", edits(F.length("short"), max_edits))
    # kept before it is filtered: a filter would be pushed down with the whole automaton copied into it
    return materialize(within(both, max_edits)).where("distance <= t").select("a", "b", "distance")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS) -> DataFrame:
    """One row per line of every row of ``docs``: (id, line_no, class_id, class_line, n_copies, n_links, kept).

    A line's class is that of its equals, named by their first occurrence (least id, then line number);
    n_links counts the other classes within the allowed edits of it. kept is true for the first occurrence
    in a class that has no link to a class whose first occurrence is earlier. Empty lines are in no class
    (nulls, no links) and kept; so is the one empty line of a null or empty text. Rows with a null id come
    first in order. Repeated rows are lines of their own that share the first occurrence's fate. An empty
    table gives an empty result; columns other than the two named are ignored.
    """
    distinct = classes(docs, id_col, text_col)
    found = links(docs, distinct, id_col, text_col, max_edits)
    # the ends' first occurrences, for linked classes only
    ends = found.select("a", "b").union(found.select("b", "a"))
    ids = materialize(ends.select(F.col("a.k1").alias("id")).distinct())
    firsts = materialize(_of(distinct, ids, "k1").select(F.struct("k1", "k2").alias("key"), "first"))
    of = ends.join(firsts.select(F.col("key").alias("ka"), F.col("first").alias("fa")), F.col("a") == F.col("ka"))
    of = of.join(firsts.select(F.col("key").alias("kb"), F.col("first").alias("fb")), F.col("b") == F.col("kb"))
    linked = of.groupBy("a").agg(F.count("*").alias("n_links"), F.max(F.col("fb") < F.col("fa")).alias("late"))
    linked = materialize(linked.select(F.col("a.k1").alias("l1"), F.col("a.k2").alias("l2"), "n_links", "late"))
    few = linked.count() <= MAX_BROADCAST
    info = distinct.join(F.broadcast(linked) if few else linked, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")
    info = info.select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), "first", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("late", F.lit(False)).alias("late")
    )
    rows = lines(docs, id_col, text_col)
    one = rows.where("line != ''").select("id", "line_no", *_keys(F.col("line")))
    full = spread_join(one, info, {"k1": "c1", "k2": "c2"}, "n", F.xxhash64("id", "line_no")).select(
        F.col("id").alias(id_col),
        "line_no",
        F.col("first.id").alias("class_id"),
        F.col("first.line_no").alias("class_line"),
        F.col("n").alias("n_copies"),
        "n_links",
        (~F.col("late") & F.col("first").eqNullSafe(F.struct("id", "line_no"))).alias("kept"),
    )
    kind = docs.schema[id_col].dataType
    empty = rows.where("line = ''").select(
        F.col("id").alias(id_col), "line_no", F.lit(None).cast(kind), F.lit(None).cast("int"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(True)
    )
    return full.union(empty)


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, text) of each id: its kept lines in order, joined by line ends; an id whose lines are all
    dropped has an empty text. Ids must be unique."""
    kept = duplicates(docs, id_col, text_col, **how).select(F.col(id_col).alias("i"), F.col("line_no").alias("k"), F.col("kept"))
    rows = lines(docs, id_col, text_col)
    rows = rows.join(kept, rows.id.eqNullSafe(kept.i) & (rows.line_no == kept.k))
    texts = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("line_no", "line")))).alias("l"))
    return texts.select(F.col("id").alias(id_col), F.array_join("l.line", "\n").alias("text"))
