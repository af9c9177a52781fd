"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that its encoding can end with: the token
that ends the prefix, is its own encoding, and stays apart from the last token of what precedes it. So
one token per prefix is the whole state. Walking the table backwards gives the ids; bytes can be appended
without touching what is there; and after an edit only the prefixes behind it are computed anew.

Texts are first cut by the vocabulary's pattern, and each match is encoded by itself. Matches repeat, so
a task keeps the ids of those it has met lately in a cache of bounded size.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class Vocabulary:
    """Ranks of byte strings, and which pairs of tokens stay apart when they meet."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        self.longest = max(map(len, self.ranks))
        #: The two tokens that the last merge on the way to a token joins; those of one byte have none. Only
        #: tokens that their bytes merge to have an entry: an encoding holds no other.
        self.halves: dict[int, tuple[int, int] | None] = {}
        for token, rank in self.ranks.items():
            parts = self.merged(token, 2)
            if len(token) == 1:
                self.halves[rank] = None
            elif len(parts) == 2:  # their own merge comes last
                self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        self.joined = {h: rank for rank, h in self.halves.items() if h}
        self.own = {self.tokens[rank]: rank for rank in self.halves}
        self.known: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes, least_parts: int = 1) -> list[bytes]:
        """The plain definition: merge the adjacent pair of least rank until there is none, or so few parts."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(pairs) >= least_parts and (least := min(pairs)) != none:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether both stay as they are when one follows the other. Merges run by rank, so the two tokens are
        taken apart in the reverse order; they do not stay where two parts that meet would have merged before
        the whole that one of them went into."""
        if len(self.known) >= 1 << 19:
            self.known.clear()
        key, joined, halves = (left, right), self.joined.get, self.halves
        found, before = True, 1 << 60
        while True:
            if joined((left, right), before) < before:
                found = False
                break
            a, b = halves[left], halves[right]
            if left > right and a or not b:  # of equal tokens the right one comes second
                if not a:
                    break
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]
        self.known[key] = found
        return found


class PrefixTable:
    """The last token (its rank) of every prefix of a byte string (one match of the pattern)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: prefixes that are already there keep their token."""
        v, last = self.vocabulary, self.last
        own, known, longest = v.own.get, v.known.get, v.longest
        self.data = data = self.data + more
        for end in range(len(last), len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                if (token := own(data[start:end])) is not None:
                    if start and (fits := known((last[start], token))) is not True:
                        if fits is False or not v.apart(last[start], token):
                            continue
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Bytes start..end become ``new``. Prefixes up to ``start`` are kept, and so are those behind the
        edit from where as many last tokens in a row as the longest token has bytes are what they were: a
        last token depends on no more than that."""
        tail, old = self.data[end:], self.last[end + 1 :]
        step = max(64, self.vocabulary.longest)
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new)
        for at in range(0, len(tail), step):
            self.append(tail[at : at + step])
            if len(tail) >= at + step and self.last[-step:] == old[at : at + step]:
                self.data += tail[at + step :]
                self.last += old[at + step :]
                return

    def ids(self) -> list[int]:
        out, last, tokens, end = [], self.last, self.vocabulary.tokens, len(self.data)
        while end:
            token = last[end]
            out.append(token)
            end -= len(tokens[token])
        return out[::-1]


class Recent(dict):
    """A cache of two generations: when the young one is full it becomes the old one. Long keys are not
    kept, so that the number of entries bounds its bytes."""

    def __init__(self, make, most: int, longest: int = 256):
        self.make, self.most, self.old, self.longest = make, most, {}, longest

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Cutter:
    """Whole texts to ids as little-endian unsigned 32-bit integers, word by word.

    A place between a non-space and a single space that a non-space follows always is a border of the
    pattern's matches, so the words between such places can be encoded each by itself, and a cache holds
    what the recent ones came to. A text with any other white space beside a space is encoded whole.
    """

    def __init__(self, encode_piece, most: int = 1 << 18):
        self.piece = encode_piece
        self.words = Recent(self._word, most)  # by the word without the space before it

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError
        return self.piece(" " + word)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace() or rest and not first:
                raise LookupError
            return self.piece(first) + b"".join(map(self.words.__getitem__, rest))
        except LookupError:
            return self.piece(text)


class Encoder(Cutter):
    """Encodes by prefix tables, and decodes."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, most: int = 1 << 18):
        super().__init__(self._piece, most)
        compiled = regex.compile(pattern)
        self.find, self.matcher = compiled.findall, compiled.finditer
        self.matches = Recent(self._match, most)
        self.vocabulary = Vocabulary(path)
        self.tokens = [self.vocabulary.tokens.get(i, b"") for i in range(max(self.vocabulary.tokens) + 1)]

    def _piece(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.find(text)))

    def _match(self, match: str) -> bytes:
        return array("I", PrefixTable(self.vocabulary, match.encode()).ids()).tobytes()

    def edited(self, text: str, ids: bytes, start: int, end: int, new: str) -> tuple[str, bytes]:
        """The text with code points start..end replaced, and its ids from those of the text: only matches
        near the edit are encoded again. Matches before the last two that end ahead of the edit do not see
        it; behind the edit, old matches hold from the first place where an old and a new one end together."""
        after = text[:start] + new + text[end:]
        old = [m.span() for m in self.matcher(text)]
        ahead = max(0, sum(e < start for _, e in old) - 2)
        begin, shift, old_ends = old[ahead][0] if ahead < len(old) else 0, len(after) - len(text), {e: k for k, (_, e) in enumerate(old)}
        fresh, rest = [], len(old)
        for m in self.matcher(after, begin):
            fresh.append(self.matches[m[0]])
            if m.end() > start + len(new) and (k := old_ends.get(m.end() - shift)) is not None and m.end() - shift >= end:
                rest = k + 1
                break
        sizes = [len(self.matches[text[a:b]]) for a, b in (*old[:ahead], *old[rest:])]
        head, tail = sum(sizes[:ahead]), sum(sizes[ahead:])
        return after, ids[:head] + b"".join(fresh) + (ids[len(ids) - tail :] if tail else b"")

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, pattern: str) -> Encoder:
    """One per Python worker, kept from task to task. A bare file name is looked up among the public
    vocabularies where the task runs."""
    if (name, pattern) not in _encoders:
        _encoders[name, pattern] = Encoder(name if "/" in name else public_tokenizers.path(name), pattern)
    return _encoders[name, pattern]


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """(id, ids binary) for every row: the ids as little-endian unsigned 32-bit integers. Null and
    empty texts have no ids; repeated rows are encoded each; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(vocabulary, pattern).encode
        for batch in batches:
            for at in range(0, len(batch), 512):  # ids need up to four times the bytes of a text
                some = batch.slice(at, 512)
                ids = [work(t.as_py() or "") for t in some.column(1)]
                yield pa.record_batch([some.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, ids binary")


def decode(ids: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, ids, bytes) of rows (id, ids binary); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(vocabulary, pattern).decode
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                found = pa.array([work(x.as_py() or b"") for x in some.column(1)], pa.binary())
                yield pa.record_batch([some.column(0), some.column(1), found], names=["id", "ids", "bytes"])

    kind = ids.schema["id"].dataType.simpleString()
    return ids.select("id", "ids").mapInArrow(run, f"id {kind}, ids binary, bytes binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes they decode to."""
    found = decode(encode(docs, id_col, text_col, vocabulary), vocabulary)
    return found.select(
        F.col("id").alias(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
