"""Removal of passages that repeat: suffix arrays in a logarithmic index family.

A byte goes if a string of `span` bytes that covers it also starts anywhere
else. Any such string has a winnowing anchor: the gram of GRAM bytes with the
least hash, which depends on the string alone. So only suffixes at anchors
whose gram occurs twice are indexed, each with the text before it, and equal
strings meet in the group of their anchor:

1. anchors of all texts, grams counted, texts with repeated ones kept;
2. the strings of each such anchor, as one context, go to bounded groups;
3. in a group, batches of suffixes are sorted, merge-scanned with the levels
   that exist, and levels of equal size are merged;
4. spans are united by text and cut.

A second, longer span shares anchors and groups: a string of `longer` bytes
belongs to the anchor of its first `span` bytes, so contexts reach further and
what repeats for `span` is scanned again for `longer`.

Equal texts are handled once: if there are two, all of a text of `span` bytes
or more goes. An anchor with more than GROUP contexts is split in chunks, and
each pair of chunks is a group, so memory is bounded for any skew.

Defined results: a null text is empty; texts shorter than `span` keep all;
repeated rows are repeats of each other; an empty table gives no rows; extra
columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, materialise, small, text_key

SPAN = 400
SHORT = 240  # bytes: 51 words, each of 3.7 letters or more and a space
GRAM = 64
BLOCK = 1 << 17  # bytes that are hashed at once; positions in a block have 17 bits
ROWS = 1024  # texts that are taken from a batch at once
HELD = 1 << 23  # bytes of contexts that a task holds before it sends them
GROUP = 16_384  # contexts of a chunk of an anchor; groups of several anchors have half as many on average
BATCH = 2048  # contexts of a batch of the index family
_ODD = 0x9E3779B97F4A7C15
_SPREAD = np.int64(0x1E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads all of them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, and a number for each byte."""
    n = BLOCK + 1

    def of(base: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        out[1:] = base
        return np.multiply.accumulate(out)

    return of(_ODD), of(pow(_ODD, -1, 1 << 64)), np.random.default_rng(3).integers(1 << 63, size=256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each gram of a block: it depends on the gram's bytes alone."""
    up, down, of = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of[data] * down[: len(data)], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * up[: len(data) - gram + 1])


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each window."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Of all strings of `span` bytes in the texts: text's index, place and gram hash of their anchors, and the places where the first and the last string of an anchor start."""
    todo: list[tuple[int, int, bytes]] = []
    held = 0

    def work() -> tuple[np.ndarray, ...]:
        sizes = np.array([len(t) for _, _, t in todo])
        data = np.frombuffer(b"".join(t for _, _, t in todo), np.uint8)
        hashes = gram_hashes(data, gram)
        low = np.uint64(BLOCK - 1)
        least = window_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), span - gram + 1)
        starts = np.cumsum(sizes) - sizes
        begin = np.nonzero(np.repeat(starts + sizes, sizes)[: len(least)] - np.arange(len(least)) >= span)[0]
        at = (least[begin] & low).astype(np.int64)
        new = np.ones(len(at) + 1, bool)  # an anchor's strings are neighbours
        new[1:-1] = at[1:] != at[:-1]
        first, last, at = begin[new[:-1]], begin[new[1:]], at[new[:-1]]
        owner = np.searchsorted(starts, at, side="right") - 1
        shift = np.array([b for _, b, _ in todo])[owner] - starts[owner]
        return np.array([i for i, _, _ in todo])[owner], at + shift, hashes[at].view(np.int64), first + shift, last + shift

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - span + 1), BLOCK - span):  # pieces share span - 1 bytes: no string is missed
            piece = text[at : at + BLOCK - 1]
            if len(piece) < span:
                continue
            if held + len(piece) >= BLOCK:
                yield work()
                todo, held = [], 0
            todo.append((i, at, piece))
            held += len(piece)
    if todo:
        yield work()


class Level:
    """Suffixes in sorted order, and the texts before them in sorted order of their reversed bytes.

    keys: (item, byte) arrays that begin with the anchor's hash; bytes are one
    higher than in the text, and 0 pads.
    """

    def __init__(self, items: np.ndarray, right: np.ndarray, left: np.ndarray, order: tuple[np.ndarray, np.ndarray] | None = None):
        self.items, self.right, self.left = items, right, left
        self.order = order or (_sorted(right), _sorted(left))

    def __len__(self) -> int:
        return len(self.items)

    def merged(self, other: Level) -> Level:
        """Both, by merging their sorted orders (a stable sort of two runs is a merge)."""
        n = len(self)
        both = [np.concatenate([getattr(self, x), getattr(other, x)]) for x in ("items", "right", "left")]
        order = []
        for keys, mine, theirs in zip(both[1:], self.order, other.order, strict=True):
            run = np.concatenate([mine, theirs + n])
            order.append(run[_sorted(keys[run])])
        return Level(*both, order=tuple(order))


def _sorted(keys: np.ndarray) -> np.ndarray:
    keys = np.ascontiguousarray(keys)
    return np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")


def _common(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each item of a sorted order shares with the next, without the hash; pads don't count."""
    a, b = keys[order[:-1]], keys[order[1:]]
    differ = (a != b) | (a == 0)
    differ[:, :8] = a[:, :8] != b[:, :8]
    out = np.where(differ.any(1), differ.argmax(1), keys.shape[1]) - 8
    return np.where(out < 0, -1, out)


def repeats(level: Level, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items with a string of `span` bytes across their anchor that another item has at the same place, and the
    most and the least bytes before the anchor at which such a string starts.

    No string starts further out than the neighbours in the two orders share.
    Where a neighbour reaches that, the item is done; the others are settled
    by a sweep: a string that starts d bytes before the anchor is a class of
    the left order at depth d together with one of the right order at span - d.
    """
    n = len(level)
    if n < 2:
        return (np.empty(0, np.int64),) * 3
    (ro, lo), rc, lc = level.order, _common(level.right, level.order[0]), _common(level.left, level.order[1])
    reach_r, reach_l = np.full(n, -1), np.full(n, -1)
    most, least = np.full(n, -1), np.full(n, span + 1)
    for reach, order, common in ((reach_r, ro, rc), (reach_l, lo, lc)):
        np.maximum.at(reach, order[:-1], common)
        np.maximum.at(reach, order[1:], common)
    for order, common, other, right in ((ro, rc, level.left, True), (lo, lc, level.right, False)):
        i = np.nonzero((common >= 0) & (reach_r[order[:-1]] + reach_l[order[:-1]] >= span))[0]
        ends = np.stack([order[i], order[i + 1]], 1)
        beyond = _common(other, ends.ravel())[::2] if len(i) else np.empty(0, np.int64)
        r, left = (common[i], beyond) if right else (beyond, common[i])
        good = r + left >= span
        for end in ends[good].T:
            np.maximum.at(most, end, left[good])
            np.minimum.at(least, end, span - r[good])
    live = (reach_r >= 0) & (reach_r + reach_l >= span)
    open_ = live & ((most < reach_l) | (least > span - reach_r))
    if open_.any():
        head = level.right[:, :8].copy().view(np.uint64).ravel()
        live = np.nonzero(live & np.isin(head, head[open_]))[0]
        for d in range(max(0, span - reach_r[open_].max()), min(span, reach_l[open_].max()) + 1):
            some = live[(reach_l[live] >= d) & (reach_r[live] >= span - d)]
            if len(some) < 2 or not (open_[some] & ((most[some] < d) | (least[some] > d))).any():
                continue
            classes = []
            for order, common, depth in ((lo, lc, d), (ro, rc, span - d)):
                mark = np.zeros(n, np.int64)
                mark[order[1:]] = np.cumsum(common < depth)
                classes.append(mark[some])
            key = classes[0] * n + classes[1]
            by = np.argsort(key)
            same = key[by[1:]] == key[by[:-1]]
            hit = np.zeros(len(some), bool)
            hit[by[1:][same]] = hit[by[:-1][same]] = True
            found = some[hit]
            most[found] = np.maximum(most[found], d)
            least[found] = np.minimum(least[found], d)
    found = np.nonzero(most >= 0)[0]
    return level.items[found], most[found], least[found]


class IndexFamily:
    """Levels of suffixes whose sizes are powers of two, in batches: a new batch is scanned with each, then equal levels merge."""

    def __init__(self, span: int = SPAN):
        self.span, self.levels = span, {}

    def add(self, level: Level) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The repeats that the batch has in itself and with what is there, on both sides."""
        yield repeats(level, self.span)
        for old in self.levels.values():
            yield repeats(old.merged(level), self.span)
        rank = 0
        while rank in self.levels:
            level = self.levels.pop(rank).merged(level)
            rank += 1
        self.levels[rank] = level


def _padded(parts: list[bytes], width: int, head: np.ndarray) -> np.ndarray:
    """Rows of the 8 bytes of `head` without zeros, then the parts' bytes plus one, padded by 0."""
    out = np.zeros((len(parts), 8 + width), np.uint8)
    out[:, :8] = head
    sizes = np.array([len(p) for p in parts])
    flat = np.frombuffer(b"".join(parts), np.uint8) + np.uint8(1)  # 255 isn't a byte of UTF-8
    at = np.repeat(np.arange(len(parts)) * (8 + width) + 8 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
    out.ravel()[at] = flat
    return out


def scan_group(hashes: np.ndarray, left: list[bytes], right: list[bytes], span: int = SPAN, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a group -> items, most and least bytes before the anchor."""
    if not len(hashes):
        return (np.empty(0, np.int64),) * 3
    _, head = np.unique(hashes, return_inverse=True)
    digits = np.stack([head // 255**i % 255 + 1 for i in range(7, -1, -1)], 1).astype(np.uint8)
    family = IndexFamily(span)
    n = len(hashes)
    wide_r, wide_l = max(map(len, right)), max(map(len, left))
    most, least = np.full(n, -1), np.full(n, span + 1)
    for at in range(0, n, batch):
        part = slice(at, min(n, at + batch))
        level = Level(np.arange(part.start, part.stop), _padded(right[part], wide_r, digits[part]), _padded(left[part], wide_l, digits[part]))
        for items, d_most, d_least in family.add(level):
            most[items] = np.maximum(most[items], d_most)
            least[items] = np.minimum(least[items], d_least)
    found = np.nonzero(most >= 0)[0]
    return found, most[found], least[found]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]])


def _anchored(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """k1, k2, data -> k1, k2, h, often: a row for each anchor gram of a text, and whether the text has it at several places."""
    for batch in _parts(batches):
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = [(i, h) for i, _, h, _, _ in anchors(batch.column(2).to_pylist(), span)]
        if found:  # at once, as a long text's blocks come one after the other
            i, h = (np.concatenate(c) for c in zip(*found, strict=True))
            by = np.lexsort((h, i))
            i, h = i[by], h[by]
            new = np.nonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (h[1:] != h[:-1])]))[0]
            often = np.diff(np.append(new, len(by))) > 1
            yield pa.record_batch([pa.array(k1[i[new]]), pa.array(k2[i[new]]), pa.array(h[new]), pa.array(often)], ["k1", "k2", "h", "often"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def _contexts(batches: Iterator[pa.RecordBatch], span: int, longer: int) -> Iterator[pa.RecordBatch]:
    """k1, k2, data, hs -> the strings of each anchor in hs as one context; equal contexts that are held together are one row with all their places.

    `reach` bytes of `after` belong to strings of `span` bytes, all of it to those of `longer` bytes.
    """
    kinds = {"h": pa.int64(), "reach": pa.int32(), "before": pa.binary(), "after": pa.binary(), "k1": pa.list_(pa.int64()), "k2": pa.list_(pa.int64()), "pos": pa.list_(pa.int32())}
    rows: dict[tuple[int, int, bytes, bytes], tuple[list, list, list]] = {}

    def taken() -> pa.RecordBatch:
        columns = (*zip(*rows, strict=True), *zip(*rows.values(), strict=True))
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))
        rows.clear()
        return out

    held = 0
    for part in _parts(batches):
        k1, k2, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
        own = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(part.column(3))))
        wanted = np.unique(np.asarray(part.column(3).flatten()) ^ own * _SPREAD)  # a chance hit is one more context, which repeats nothing
        for i, pos, h, first, last in anchors(texts, span):
            live = np.isin(h ^ i * _SPREAD, wanted)
            for of, at, gram, lo, hi in zip(*(x[live].tolist() for x in (i, pos, h, first, last)), strict=True):
                text = texts[of]
                context = gram, hi + span - at, text[lo:at][::-1], text[at : hi + longer]
                if context not in rows:
                    rows[context] = [], [], []
                    held += len(context[2]) + len(context[3])
                held += 32
                for column, value in zip(rows[context], (k1[of], k2[of], at), strict=True):
                    column.append(value)
            if held > HELD:
                yield taken()
                held = 0
    if rows:
        yield taken()


def repeated_spans(texts: DataFrame, span: int = SPAN, longer: int | None = None) -> DataFrame:
    """texts (k1, k2, data) -> k1, k2, data, spans: the distinct texts of `span` bytes or more that have repeats, and the runs to remove; with `longer`, also long_spans, the runs for strings of so many bytes.

    Texts that equal another are not told here unless a part of them repeats elsewhere.

    A gram repeats if two texts have it (their least and greatest key differ)
    or one has it twice; so copies of a text need no deduplication before the
    count, which combines on the map side. Places are found again for texts
    with repeated grams only, which keeps the counted rows thin.
    """
    texts = texts.where(F.octet_length("data") >= span).select("k1", "k2", "data")
    every = materialise(anchor_rows(texts, span))
    counts = every.groupBy("h").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.max("often").alias("often"))
    wanted = materialise(every.join(counts.where("a <> b or often").select("h"), "h").select("h", "k1", "k2").distinct())
    return spans_at(texts, wanted, span, longer)


def anchor_rows(texts: DataFrame, span: int) -> DataFrame:
    """texts (k1, k2, data) -> k1, k2, h, often: a row for each anchor gram of a text, and whether the text has it at several places."""
    return texts.select("k1", "k2", "data").mapInArrow(lambda b: _anchored(b, span), "k1 long, k2 long, h long, often boolean")


def spans_at(texts: DataFrame, wanted: DataFrame, span: int, longer: int | None = None) -> DataFrame:
    """texts (k1, k2, data) and wanted (h, k1, k2), stored: the anchors to compare -> what repeated_spans() tells."""
    lengths = [span] if longer is None else [span, longer]
    hot = small(wanted.groupBy("h").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("chunks")).where("chunks > 1"))
    places = wanted.groupBy("k1", "k2").agg(F.collect_list("h").alias("hs"))
    keys = wanted.select("k1", "k2").distinct()
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then only these texts are shuffled
        texts = texts.join(F.broadcast(keys), ["k1", "k2"], "left_semi")
    texts = materialise(texts.groupBy("k1", "k2").agg(F.first("data").alias("data")).join(places, ["k1", "k2"]))
    groups = max(1, -(-2 * wanted.count() // GROUP))
    cut_out = texts.mapInArrow(lambda b: _contexts(b, span, lengths[-1]), "h long, reach int, before binary, after binary, k1 array<long>, k2 array<long>, pos array<int>")
    dealt = cut_out.join(hot, "h", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("before", "after"), F.col("chunks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j"))))
    dealt = dealt.withColumn("chunk", chunk).select("*", pair.alias("pair"))
    key = F.when(F.col("chunks") > 1, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(groups)))
    which = F.when(F.col("chunks") > 1, F.col("pair.i")).otherwise(-1)
    dealt = dealt.select(key.alias("g"), which.alias("i"), F.col("pair.j").alias("j"), "h", "reach", "before", "after", "k1", "k2", "pos")

    def scan(table: pa.Table) -> pa.Table:
        hashes, before, after, pos, k1, k2 = table["h"].to_numpy(), *(table[c].to_pylist() for c in ("before", "after", "pos", "k1", "k2"))
        once = table["i"][0].as_py() in (-1, table["j"][0].as_py())  # of a chunk's groups, one tells what its batches had told
        out, some, right = [], np.arange(len(pos)), [a[:r] for a, r in zip(after, table["reach"].to_pylist(), strict=True)]
        for length in lengths:
            if length != span:  # a longer repeat begins with one of `span` bytes
                some = np.array([i for i in sorted(repeating) if len(before[i]) + len(after[i]) >= length], np.int64)
                right = [after[i] for i in some]
            found, most, least = scan_group(hashes[some], [before[i] for i in some], right, length)
            ends = {i: (m, e) for i, m, e in zip(some[found].tolist(), most.tolist(), least.tolist(), strict=True)}
            repeating = set(ends)
            for i, a in zip(some.tolist(), right, strict=True):
                if len(pos[i]) > 1:  # equal contexts: all their strings repeat
                    repeating.add(i)
                    ends.pop(i, None)
                    if once:
                        ends[i] = len(before[i]), length - len(a)
            out += [(a, b, p - m, p - e + length, length != span) for i, (m, e) in ends.items() for a, b, p in zip(k1[i], k2[i], pos[i], strict=True)]
        kinds = [*[pa.int64()] * 4, pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["k1", "k2", "start", "end", "long"])

    spans = dealt.groupBy("g", "i", "j").applyInArrow(scan, "k1 long, k2 long, start long, end long, long boolean")
    run = F.struct("start", "end")
    of = {"spans": ~F.col("long"), "long_spans": F.col("long")}
    spans = spans.groupBy("k1", "k2").agg(*(F.collect_list(F.when(of[c], run)).alias(c) for c in list(of)[: len(lengths)]))
    return texts.select("k1", "k2", "data").join(spans, ["k1", "k2"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs (text) -> k1, k2, data (UTF-8)."""
    return docs.select(*text_key(F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))


def _cut(found: DataFrame, whole: bool) -> DataFrame:
    """found (k1, k2, data, spans) -> k1, k2, removed, runs, sha and, if `whole`, kept; if there are long_spans, these are cut, and `short` is what spans would remove."""
    longer = "long_spans" in found.columns
    columns = ["spans", "long_spans"] if longer else ["spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            out = []
            for data, *lists in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                short, runs = (union([(s["start"], s["end"]) for s in spans]) for spans in (lists[0], lists[-1]))
                kept = cut(data, runs)
                less = sum(e - s for s, e in short) if longer else None
                out.append((sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if whole else None, less))
            if out:
                told = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch([*batch.columns[:2], *told], ["k1", "k2", "removed", "runs", "sha", "kept", "short"])

    return found.select("k1", "k2", "data", *columns).mapInArrow(run, "k1 long, k2 long, removed long, runs long, sha string, kept string, short long")


def _copies(docs: DataFrame, span: int) -> DataFrame:
    """k1, k2, size, n of the texts of `span` bytes or more that several rows have."""
    size = F.octet_length("text").alias("size")
    return docs.where(F.octet_length("text") >= span).select(*text_key(F.col("text")), size).groupBy("k1", "k2").agg(F.max("size").alias("size"), F.count("*").alias("n")).where("n > 1")


def _told(docs: DataFrame, known: DataFrame, keep: tuple[str, ...], *more: Column) -> DataFrame:
    """The columns in `keep`, n_bytes, n_removed, n_spans, kept_sha256, kept (null: all is kept) and `more` of each row; known: _cut() joined with _copies()."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    all_sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), *text_key(F.col("text")), size.alias("n_bytes"), all_sha.alias("all_sha"))
    equal = F.col("n").isNotNull()
    return rows.join(known, ["k1", "k2"], "left").select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)),
        "n_bytes",
        F.when(equal, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(equal, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(equal, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "all_sha")).alias("kept_sha256"),
        F.when(equal, "").otherwise(F.col("kept")).alias("kept"),
        *more,
    )


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with the repeats cut from text (and n_chars, if there is one, counted anew). Documents of which nothing is left go.

    A cut can split a character; what is left of it goes too. Null and empty
    texts stay as they are; repeated rows are repeats of each other; columns
    of any name pass.
    """
    columns = docs.columns
    known = materialise(_cut(repeated_spans(keyed(docs), span), True).join(_copies(docs, span), ["k1", "k2"], "full"))
    cut_docs = _told(docs.select(F.struct(*columns).alias("_row"), "text"), known, ("_row",))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_row.text"))
    out = cut_docs.where("n_removed < n_bytes or n_bytes = 0").select(*(text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def query(docs: DataFrame) -> DataFrame:
    """What a span of SPAN bytes removes, and n_removed_short, what one of SHORT bytes would."""
    twins = _copies(docs, SHORT).select("k1", "k2", F.col("n").alias("twins"), F.when(F.col("size") >= SPAN, F.col("n")).alias("n"))
    known = _cut(repeated_spans(keyed(docs), SHORT, SPAN), False).join(twins, ["k1", "k2"], "full")
    less = F.when(F.col("twins").isNotNull(), F.col("n_bytes")).otherwise(F.coalesce("short", F.lit(0))).cast("long")
    return _told(docs, known, ("doc_id",), less.alias("n_removed_short")).drop("kept")
