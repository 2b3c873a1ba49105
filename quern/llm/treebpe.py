"""Byte-level BPE by monoid tree reduction.

A text is halved down to leaves, the leaves are encoded, and neighbours are
joined on the way up. A join encodes anew what lies at the border, in a window
that grows until the tokens outside are proved to stay:

* words (matches of the pattern): a match is decided by the characters up to
  the second one after it, so all matches of the left side but those that end
  within its last two characters stay. The window starts at the first of those
  and takes in words of the right side until one of its own settled matches
  ends where a word of the right side starts; as the pattern never looks back,
  all words from there on stay.
* tokens of a word that lies on both sides: a sequence of tokens is the
  encoding of its bytes exactly if every two neighbours are the encoding of
  theirs. (Take the first merge that crosses a border between two tokens: up to
  it, both tokens' bytes went the way that they go alone, so it would cross
  there as well; the converse holds for the same reason.) So a window is large
  enough once its first and its last token are the encoding of themselves with
  their neighbours outside.

Texts of up to SEGMENT characters are reduced within a task. Longer ones are
dealt out in segments, and FAN neighbouring segments a group are joined in each
level, so a text's leaves are encoded by many tasks.

Defined results: a null text is the empty text, which has no ids; repeated
rows are encoded each; an empty table gives no row; extra columns are ignored,
whatever their names; strings of special tokens are ordinary text; equal ranks
are merged from the left. Very long words are reduced by halves of their bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 4096  # characters that are matched at once
SEGMENT = 1 << 16  # characters of a row of a long text
FAN = 16  # segments that a group joins
WORD = 16  # bytes that are merged at once
KNOWN = 400_000  # words and pairs of tokens that a process remembers
BATCH = 4 << 20  # bytes of ids in a record batch
IDS = "doc_id long, ids array<int>"
PART = "row long, doc_id long, seg long, ids array<int>, sizes array<int>"


class Memo(dict):
    """Results by argument; starts anew when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        made = self.make(key)
        if len(self) >= KNOWN:
            self.clear()
        self[key] = made
        return made


class Merges:
    """Tokens of single words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.apart = Memo(lambda pair: self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == list(pair))

    def merge(self, data: bytes) -> list[int]:
        """Ids of data: neighbours of least rank are merged first, from the left."""
        n, rank = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))  # a part's end by its start (0: none starts there), and the start of the part before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != to:
                continue  # its parts have been merged with others
            end[i], end[mid] = to, 0
            if to < n:
                before[to] = i
                if (r := rank(data[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (p := before[i]) >= 0 and (r := rank(data[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : end[at]]])
            at = end[at]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up the tree."""
        if len(ids) > LEAF:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Ids of two neighbouring strings of bytes -> ids of the whole."""
        if not a or not b:
            return a or b
        i = j = 1  # tokens of either side in the window
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self.merge(self.decode(a[len(a) - i :] + b[:j]))
            left = i == len(a) or self.apart[a[-i - 1], window[0]]
            right = j == len(b) or self.apart[window[-1], b[j]]
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= WORD:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def whole(self, data: bytes) -> list[int]:
        """Ids of a word: one that is in the vocabulary is its own token, however the merges go."""
        one = self.ranks.get(data)
        return self.tree(data) if one is None else [one]


Part = tuple[list[str], list[list[int]]]  # words, and the ids of each


class Encoder:
    """Words and ids of texts, as a monoid: part() of a leaf, join() of neighbours; the empty part is neutral."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.every, self.basic = (re.compile(plain_pattern(pattern, most)).findall for most in (0x10FFFF, 0xFFFF))
        self.known = Memo(lambda word: self.merges.whole(word.encode()))

    def words(self, text: str) -> list[str]:
        """Matches; where no character needs two units of UTF-16, by classes without such characters, which are looked up faster."""
        return (self.basic if len(text.encode("utf-16-le")) == 2 * len(text) else self.every)(text)

    def ids(self, word: str) -> list[int]:
        return self.known[word] if len(word) <= LEAF // 16 else self.merges.whole(word.encode())

    def part(self, text: str) -> Part:
        if len(text) > LEAF:
            half = len(text) // 2
            return self.join(self.part(text[:half]), self.part(text[half:]))
        words = self.words(text)
        long = max(map(len, words), default=0) > LEAF // 16
        return words, [self.ids(w) for w in words] if long else list(map(self.known.__getitem__, words))

    def join(self, a: Part, b: Part) -> Part:
        if not a[0] or not b[0]:
            return a if a[0] else b
        open_, after = 0, 0  # words of a that the characters to come can change
        while open_ < len(a[0]) and after < 2:
            open_ += 1
            after += len(a[0][-open_])
        tail, keep, take = "".join(a[0][len(a[0]) - open_ :]), len(a[0]) - open_, 1
        while True:
            take = min(take, len(b[0]))
            window = tail + "".join(b[0][:take])
            found = self.words(window)
            starts, at = {}, len(tail)  # where words of b start in the window
            for i, w in enumerate(b[0][:take]):
                starts[at] = i
                at += len(w)
            starts[at] = take
            to, settled = 0, len(window) if take == len(b[0]) else len(window) - 2
            for i, w in enumerate(found):
                to += len(w)
                if to > settled:
                    break
                if to in starts:
                    ids = [self.across(w, a, b) for w in found[: i + 1]]
                    return a[0][:keep] + found[: i + 1] + b[0][starts[to] :], a[1][:keep] + ids + b[1][starts[to] :]
            take *= 2

    def across(self, word: str, a: Part, b: Part) -> list[int]:
        """Ids of a word in the window; a long one that is the last of a and the first of b is joined from theirs."""
        if len(word) > LEAF // 16 and word == a[0][-1] + b[0][0]:
            data = word.encode()
            one = self.merges.ranks.get(data)
            ids = self.merges.join(a[1][-1], b[1][0]) if one is None else [one]
            return ids
        return self.ids(word)

    def all_of(self, parts: list[Part]) -> Part:
        if len(parts) > 1:
            half = len(parts) // 2
            return self.join(self.all_of(parts[:half]), self.all_of(parts[half:]))
        return parts[0]


@cache
def classes() -> dict[str, list[tuple[int, int]]]:
    """Character classes of the pattern as ranges of code points (inclusive), as tiktoken's own tables have them: those of Python know other versions of Unicode."""
    import tiktoken

    every, out = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000), {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        codes = np.array([ord(c) for c in found.decode_bytes(found.encode_ordinary(every)).decode()])
        cuts = np.nonzero(np.diff(codes) != 1)[0]
        first, last = codes[np.append(0, cuts + 1)], codes[np.append(cuts, len(codes) - 1)]
        out[name] = list(zip(first.tolist(), last.tolist(), strict=True))
    return out


def plain_pattern(pattern: str, most: int) -> str:
    """The pattern with its classes written out, up to a code point: inside brackets as they are, else in brackets of their own."""
    named = {name: "".join(f"\\U{a:08x}-\\U{min(b, most):08x}" for a, b in ranges if a <= most) for name, ranges in classes().items()}
    out, inside = [], False
    for piece in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        ranges = named.get(piece)
        out.append(piece if ranges is None else ranges if inside else f"[{ranges}]")
        inside = piece == "[" or (inside and piece != "]")
    return "".join(out)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process."""
    return Encoder(read_ranks(path), pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _lists(parts: Iterable[list[int]]) -> pa.Array:
    parts = list(parts)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(parts), np.int32, int(ends[-1]))))


def _batches(rows: Iterable[tuple], lists: tuple[int, ...], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about BATCH bytes; the columns at `lists` are lists of ids."""

    def built() -> pa.RecordBatch:
        return pa.record_batch([_lists(c) if i in lists else pa.array(c, kinds[i]) for i, c in enumerate(zip(*held, strict=True))], names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 4 * sum(len(row[i]) for i in lists) + 32
        if size >= BATCH:
            yield built()
            held, size = [], 0
    if held:
        yield built()


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids: those of each word (match of the pattern) by the rank file. docs should be a stored table, as rows of long texts are numbered."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    longest = whole.agg(F.max(F.length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(ranks, pattern)
        for batch in batches:
            rows = ((doc.as_py(), list(chain.from_iterable(known.part(text.as_py())[1]))) for doc, text in zip(batch.column(0), batch.column(1), strict=True))
            yield from _batches(rows, (1,), ["doc_id", "ids"], [pa.int64(), None])

    short = whole.where(F.length("text") <= SEGMENT).mapInArrow(run, IDS)
    if longest <= SEGMENT:
        return short
    return short.unionByName(_long(whole.where(F.length("text") > SEGMENT), -(-longest // SEGMENT), ranks, pattern))


def _long(docs: DataFrame, segments: int, ranks: str, pattern: str) -> DataFrame:
    """Texts of many segments: leaves by segment, then a level of joins for each power of FAN."""
    names, kinds = ["row", "doc_id", "seg", "ids", "sizes"], [pa.int64(), pa.int64(), pa.int64(), None, None]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                for at in range(0, len(text), SEGMENT):
                    yield pa.record_batch([pa.array([row.as_py()], pa.int64()), pa.array([doc.as_py()], pa.int64()), pa.array([at // SEGMENT], pa.int64()), pa.array([text[at : at + SEGMENT]], pa.string())], ["row", "doc_id", "seg", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(ranks, pattern)
        for batch in batches:
            parts = ((*(batch.column(i)[at].as_py() for i in range(3)), known.part(batch.column(3)[at].as_py())[1]) for at in range(len(batch)))
            yield from _batches(((row, doc, seg, list(chain.from_iterable(ids)), [len(i) for i in ids]) for row, doc, seg, ids in parts), (3, 4), names, kinds)

    def level(group: pa.Table) -> pa.Table:
        """Neighbouring segments of one text -> one."""
        known = encoder(ranks, pattern)
        group = group.sort_by("seg")
        parts = []
        for ids, sizes in zip(group["ids"], group["sizes"], strict=True):
            cuts = np.split(np.asarray(ids.values), np.cumsum(np.asarray(sizes.values))[:-1])
            tokens = [c.tolist() for c in cuts]
            parts.append(([known.merges.decode(t).decode() for t in tokens], tokens))
        _, found = known.all_of(parts)
        columns = [group["row"][:1], group["doc_id"][:1], pa.array([group["seg"][0].as_py() // FAN]), _lists([list(chain.from_iterable(found))]), _lists([[len(i) for i in found]])]
        return pa.table(columns, names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    out = numbered.mapInArrow(cut, "row long, doc_id long, seg long, text string").repartition("row", "seg").mapInArrow(leaves, PART)
    while segments > 1:
        out = out.groupBy("row", F.floor(F.col("seg") / FAN)).applyInArrow(level, PART)
        segments = -(-segments // FAN)
    return out.select("doc_id", "ids")


def decode(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """rows with a column ids -> the same with `decoded` (binary), the ids' bytes."""
    names = rows.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(ranks, pattern).merges
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                data = pa.array([merges.decode(np.asarray(ids.values).tolist()) for ids in some.column(at)], pa.binary())
                yield pa.record_batch([*some.columns, data], [*names, "decoded"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, decoded binary")


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    told = decode(encode(docs, path, pattern), path, pattern)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
