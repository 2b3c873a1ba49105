"""Spelling variants: words one edit apart, by range searches in k-d trees over letter counts.

One inserted or deleted letter changes a word's letter counts by one, a
replaced one by two (one up, one down), so near words lie within L1 distance 2.
Counts are kept as one 64-bit code: each of 32 letter classes (a to z, and six
that share all other code points) has the bits "at least one" and "at least
two". A node of a k-d tree splits words by one of these bits, which is a
threshold on one count; its box is the bits that all and that any of its words
have. A search of a word leaves out every box that would need more letters up
or down than one edit gives: one of each for words of its own length, one up
for the next length. Classes and counts above two only ever lessen distances,
so nothing is lost; words that remain are compared letter by letter.

The trees have two storeys. The upper one, a tree for each length, is fitted on
a sample of SAMPLE words and deals all words to cells of about CELL words; a
word is sent to the cells of its own and the next length that its box search
reaches. Within a cell (or a share of it, where the sample misjudged: shares
have at most CELL words on average, by hash) a tree is grown over all its words, and
the words that ask stream past it. Memory is a cell's words and a batch.

Defined results: null and empty texts have no words; a null doc_id is empty in
the hash; repeated rows count each; ties go to the first word in code-point
order; an empty table gives no row; extra columns are ignored, whatever their
names; very long texts are read in pieces that end between words, and a very
long word is a word like others.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
EVERY = 97  # a run loses a letter if this divides its hash
SHORTEST, RAREST = 5, 3  # code points and occurrences of a word
SAMPLE = 1 << 16  # words that the upper trees are fitted on
CELL = 1 << 14  # words of a cell
LEAF = 48  # words of a leaf of a cell's tree
PIECE = 1 << 20  # characters of a text that are read at once
HELD = 200_000  # words that a task counts before it sends them
ASKED = 1 << 22  # pairs that are compared at once
LOWERED = str.maketrans(UPPER, LOWER)


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that end where no run goes on."""
    at = 0
    while at < len(text):
        to = at + PIECE
        if to < len(text) and (m := RUN.match(text, to - 1)):
            to = m.end()
        yield text[at:to]
        at = to


def document_words(doc_id: int | None, text: str) -> Counter:
    """The words of a text and how often each occurs, each with its letter deleted where the hash says so."""
    runs: Counter = Counter()
    for piece in pieces(text):
        runs.update(RUN.findall(piece))
    lowered: dict[str, int] = defaultdict(int)
    for run, n in runs.items():
        lowered[run.lower() if run.isascii() else run.translate(LOWERED)] += n
    out, start = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in lowered.items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def words(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, n: the words that are long and frequent enough. Tasks send sums of many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)

        def sent() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in document_words(doc.as_py(), text.as_py()).items():
                    if len(word) >= SHORTEST:
                        held[word] += n
                if len(held) >= HELD:
                    yield sent()
        yield sent()

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


# letter counts


def letters(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length -> their code points (all below 256) as a matrix, and codes of their letter counts."""
    n = len(some[0]) if some else 0
    points = np.frombuffer("".join(some).encode("latin-1"), np.uint8).reshape(len(some), n)
    kind = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % 6)
    code = np.zeros(len(some), np.uint64)
    for i in range(n):  # a letter's second occurrence finds its first bit set
        first = np.uint64(1) << (2 * kind[:, i]).astype(np.uint64)
        code |= np.where(code & first, first << np.uint64(1), first)
    return points, code


def split_bit(codes: np.ndarray) -> int | None:
    """The bit that parts the codes most evenly; None if all are equal."""
    ones = np.array([np.count_nonzero(codes & (np.uint64(1) << np.uint64(b))) for b in range(64)])
    even = np.minimum(ones, len(codes) - ones)
    best = int(np.argmax(even))
    return best if even[best] else None


class Tree:
    """A k-d tree over codes: places of the words by leaf, and the box of every node."""

    def __init__(self, codes: np.ndarray, leaf: int, boxes: bool = True):
        self.nodes: list[tuple] = []  # (all, any, bit, left, right) or (all, any, None, leaf's number, None)
        self.leaves: list[np.ndarray] = []
        self._grow(codes, np.arange(len(codes)), leaf, np.uint64(0), ~np.uint64(0), boxes)

    def _grow(self, codes: np.ndarray, at: np.ndarray, leaf: int, low: np.uint64, high: np.uint64, boxes: bool) -> int:
        own = codes[at]
        if boxes and len(own):
            low, high = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
        me, bit = len(self.nodes), split_bit(own) if len(own) > leaf else None
        self.nodes.append(())
        if bit is None:
            self.nodes[me] = (low, high, None, len(self.leaves), None)
            self.leaves.append(at)
        else:
            mark = np.uint64(1) << np.uint64(bit)
            has = (own & mark) > 0
            left = self._grow(codes, at[~has], leaf, low, high & ~mark, boxes)
            right = self._grow(codes, at[has], leaf, low | mark, high, boxes)
            self.nodes[me] = (low, high, bit, left, right)
        return me

    def search(self, codes: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves whose boxes lie within `up` letters more and `down` letters less, and the places of the codes that reach them."""
        todo = [(0, np.arange(len(codes)))]
        while todo:
            node, who = todo.pop()
            low, high, bit, left, right = self.nodes[node]
            c = codes[who]
            who = who[(np.bitwise_count(low & ~c) <= up) & (np.bitwise_count(c & ~high) <= down)]
            if len(who) and bit is None:
                yield left, who
            elif len(who):
                todo += [(left, who), (right, who)]

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(codes), np.int64), [(0, np.arange(len(codes)))]
        while todo:
            node, who = todo.pop()
            _, _, bit, left, right = self.nodes[node]
            if bit is None:
                out[who] = left
            else:
                has = (codes[who] & (np.uint64(1) << np.uint64(bit))) > 0
                todo += [(left, who[~has]), (right, who[has])]
        return out


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in one place."""
    return np.count_nonzero(a != b, axis=1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of b that are those of a with one code point more: a's common beginning and common end with b reach over all of a."""
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


def near_pairs(tree: Tree, points: np.ndarray, codes: np.ndarray, asked: np.ndarray, asked_codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (asked, own) of near words; the asked ones have the length of the tree's words, or one less."""
    longer = points.shape[1] - asked.shape[1]
    up, down = 1, 1 - longer
    check = inserted if longer else replaced
    for leaf, who in tree.search(asked_codes, up, down):
        own = tree.leaves[leaf]
        step = max(1, ASKED // max(1, len(own)))
        for at in range(0, len(who), step):
            some = who[at : at + step]
            a, b = asked_codes[some][:, None], codes[own][None, :]
            i, j = np.nonzero((np.bitwise_count(b & ~a) <= up) & (np.bitwise_count(a & ~b) <= down))
            for k in range(0, len(i), ASKED // 16):
                x, y = some[i[k : k + ASKED // 16]], own[j[k : k + ASKED // 16]]
                ok = check(asked[x], points[y])
                yield x[ok], y[ok]


# cells


def upper_trees(found: DataFrame, total: int) -> dict[int, Tree]:
    """A tree for each length that fills more than a cell, fitted on at most SAMPLE words, by hash; its boxes are the regions, which hold words that the sample hasn't."""
    some = found
    if total > 4 * SAMPLE:  # by other bits of the hash than it is ordered by, so that partitions don't all send SAMPLE words to the driver
        some = found.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < (4 * SAMPLE << 30) // total)
    sample = some.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word").collect()
    by: dict[int, list[str]] = defaultdict(list)
    for r in sample:
        by[len(r[0])].append(r[0])
    leaf = max(1, CELL * len(sample) // max(1, total))
    return {n: Tree(letters(some)[1], leaf, boxes=False) for n, some in by.items() if len(some) > leaf}


def _by_length(some: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in some])
    for n in np.unique(sizes).tolist():
        yield n, np.nonzero(sizes == n)[0]


def dealt(found: DataFrame, trees: dict[int, Tree], asks: bool) -> DataFrame:
    """found (word, n) -> len, cell, word, n: each word's own cell, or all cells of its own and the next length that its search reaches."""
    sent = found.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            some = batch.column(0).to_pylist()
            for n, at in _by_length(some):
                codes = letters([some[i] for i in at.tolist()])[1]
                for length in (n, n + 1) if asks else (n,):
                    tree = known.get(length)
                    if tree is None:
                        hits = [(0, np.arange(len(at)))]
                    elif asks:
                        hits = tree.search(codes, 1, 1 - (length - n))
                    else:
                        own = tree.leaf_of(codes)
                        hits = [(c, np.nonzero(own == c)[0]) for c in np.unique(own).tolist()]
                    for cell, who in hits:
                        rows = pa.array(at[who])
                        yield pa.record_batch([pa.array(np.full(len(who), length)), pa.array(np.full(len(who), cell)), batch.column(0).take(rows), batch.column(1).take(rows)], ["len", "cell", "word", "n"])

    return found.select("word", "n").mapInArrow(run, "len long, cell long, word string, n long")


def pairs(found: DataFrame) -> DataFrame:
    """found (word, n), a stored table -> word, other, n: all near words of each word, with their numbers."""
    total = found.count()
    trees = upper_trees(found, total)
    own, asking = dealt(found, trees, False), dealt(found, trees, True)
    shares = own.groupBy("len", "cell").agg(F.ceil(F.count("*") / CELL).cast("long").alias("shares"))  # a row for each cell that has words
    own = own.join(shares, ["len", "cell"]).withColumn("share", F.pmod(F.xxhash64("word"), F.col("shares"))).drop("shares")
    asking = asking.join(shares, ["len", "cell"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    both = own.withColumn("asks", F.lit(0)).unionByName(asking.withColumn("asks", F.lit(1)))
    at = ["len", "cell", "share"]
    sorted_ = both.select(*at, "asks", "word", "n").repartition(*at).sortWithinPartitions(*at, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tree = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in range(4)], 1)
            cuts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1, [len(keys)]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                cell, asks = tuple(keys[a, :3].tolist()), keys[a, 3]
                some = batch.slice(a, b - a)
                if cell != now:
                    now, parts, tree = cell, [], None
                if not asks:
                    parts.append(some)  # a share's own words come first
                    continue
                if not parts:
                    continue
                if tree is None:
                    held = pa.Table.from_batches(parts).combine_chunks()
                    points, codes = letters(held["word"].to_pylist())
                    tree = Tree(codes, LEAF)
                yield from found_in(tree, points, codes, held, some)

    def found_in(tree: Tree, points: np.ndarray, codes: np.ndarray, held: pa.Table, some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked_words = some.column(4).to_pylist()
        for n, at in _by_length(asked_words):
            asked, asked_codes = letters([asked_words[i] for i in at.tolist()])
            for x, y in near_pairs(tree, points, codes, asked, asked_codes):
                if not len(x):
                    continue
                a, b = some.take(pa.array(at[x])), held.take(pa.array(y))
                yield pa.record_batch([a.column(4), b["word"].combine_chunks(), b["n"].combine_chunks()], ["word", "other", "n"])
                if n < points.shape[1]:  # words of one length ask each other; of two lengths, only the shorter asks
                    yield pa.record_batch([b["word"].combine_chunks(), a.column(4), a.column(5)], ["word", "other", "n"])

    return sorted_.mapInArrow(run, "word string, other string, n long")


# forms


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) of words that have one -> word, root. A form is twice as frequent, so chains end; each step doubles the way that is known."""
    out = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while out.where("open").limit(1).count():
        further = out.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out = materialise(out.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open")))
    return out.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n: a row for each word."""
    found = materialise(words(docs))
    best = F.min(F.struct((-F.col("n")).alias("least"), F.col("other").alias("other")))
    near = pairs(found).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    likely = F.col("best.least") <= -2 * F.col("n")
    told = found.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(likely, F.col("best.other")).alias("form"), F.when(likely, -F.col("best.least")).alias("form_n")
    )
    told = materialise(told)
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return group_variants(docs)
