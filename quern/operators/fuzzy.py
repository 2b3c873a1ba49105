"""Exact fuzzy search: every text is held against every query, and bounds leave out what can't be among the best."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import lcs

QUERIES = 256  # queries that are broadcast at once
TEXTS = 512  # texts that a task holds against them at once
CHARS = 1 << 20  # characters of either, where there are more than one
CLASSES = 64  # letters are counted by code point modulo this: classes that letters share only raise a bound
WINDOWS = 4096  # windows compared at once
SLACK = 1e-9


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(points: np.ndarray) -> np.ndarray:
    return np.bincount(points % CLASSES, minlength=CLASSES)


def lcs_windows(a: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a with each window begin..end of text: 64 letters of a to a word, all windows step by step together."""
    n, words = len(a), -(-len(a) // 64)
    alphabet, which = np.unique(a, return_inverse=True)
    masks = np.zeros((words, len(alphabet) + 1), np.uint64)  # the last one is of letters that a lacks
    place = np.arange(n)
    np.bitwise_or.at(masks, (place // 64, which), np.uint64(1) << (place % 64).astype(np.uint64))
    code = np.minimum(np.searchsorted(alphabet, text), len(alphabet) - 1)
    code = np.where(alphabet[code] == text, code, len(alphabet))
    out = np.zeros(len(begin), np.int64)
    longest = np.argsort(begin - end, kind="stable")
    for some in np.split(longest, range(WINDOWS, len(longest), WINDOWS)):
        at, size = begin[some], (end - begin)[some]
        state = np.full((words, len(some)), ~np.uint64(0))
        live = np.searchsorted(-size, -np.arange(size[0] if len(some) else 0), side="left")  # windows longer than the step
        for step, k in enumerate(live):
            letter = code[at[:k] + step]
            carry = None
            for w in range(words):
                s = state[w, :k]
                u = s & masks[w][letter]
                total = s + u
                over = total < s
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                state[w, :k] = total | (s ^ u)
                carry = over.astype(np.uint64)
        out[some] = 64 * words - np.bitwise_count(state).sum(0, dtype=np.int64)
    return out


class Windows:
    """Windows of several texts that lie behind each other, in order, and a bound of each one's ratio with a."""

    def __init__(self, a: np.ndarray, text: np.ndarray, spans: list[tuple[int, np.ndarray, np.ndarray]], texts: int) -> None:
        """spans: the number of a text, and where its windows begin and end, both rising."""
        self.a, self.text, self.texts = a, text, texts
        sizes = np.array([len(b) for _, b, _ in spans], np.int64)
        self.owner = np.repeat(np.array([i for i, _, _ in spans], np.int64), sizes)
        self.begin, self.end = (np.concatenate([np.zeros(0, np.int64), *(s[c] for s in spans)]) for c in (1, 2))
        self.span, self.place = np.repeat(np.arange(len(spans)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.bound = np.ones(len(self.owner))

    def most(self) -> np.ndarray:
        out = np.zeros(self.texts)
        np.maximum.at(out, self.owner, self.bound)
        return out

    def narrow(self, need: np.ndarray, stride: int) -> None:
        """Compares the letters that `stride` windows in a row cover together: none of them has a longer subsequence. Only windows that may reach their text's `need`; with stride 1, bounds become ratios."""
        live = np.nonzero(self.bound >= need[self.owner] - SLACK)[0]
        if not len(live):
            return
        group = np.append(True, (np.diff(self.span[live]) != 0) | (np.diff(self.place[live] // stride) != 0))
        first = np.nonzero(group)[0]
        last = np.append(first[1:], len(live)) - 1
        found = lcs_windows(self.a, self.text, self.begin[live[first]], self.end[live[last]])[np.cumsum(group) - 1]
        length = (self.end - self.begin)[live]
        self.bound[live] = np.minimum(self.bound[live], 2 * np.minimum(found, length) / (len(self.a) + length))


class Text(NamedTuple):
    """A text in the forms that scores need."""

    ids: list[int]
    text: str
    words: list[str]
    distinct: set[str]
    set_length: int
    dense: np.ndarray
    spaced: np.ndarray
    bags: np.ndarray  # letters without spaces, with spaces, and of distinct words


def prepared(rows: list[tuple[int, str]]) -> list[Text]:
    """Texts that differ, each with its ids; those without words go."""
    by: dict[str, list[int]] = {}
    for key, text in rows:
        by.setdefault(" ".join(text.lower().split()), []).append(key)
    return [forms(ids, text) for text, ids in by.items() if text]


def forms(ids: list[int], joined: str) -> Text:
    words = joined.split(" ")
    distinct = set(words)
    dense, spaced, once = points_of("".join(words)), points_of(joined), points_of(" ".join(distinct))
    return Text(ids, joined, words, distinct, len(once), dense, spaced, np.stack([letters(dense), letters(spaced), letters(once)]))


def set_ratio(q: Text, d: Text, need: float) -> float:
    """The token set ratio if that is `need` at least, else a number below it."""
    both = q.distinct & d.distinct
    if both and (len(both) == len(q.distinct) or len(both) == len(d.distinct)):
        return 1.0
    n = len(" ".join(both))
    known = max(2 * n / (n + q.set_length), 2 * n / (n + d.set_length)) if both else 0.0
    most = 2 * np.minimum(q.bags[2], d.bags[2]).sum() / (q.set_length + d.set_length)
    if most <= known or most < need - SLACK:
        return known
    one, other = (" ".join(filter(None, (" ".join(sorted(both)), " ".join(sorted(t.distinct - both))))) for t in (q, d))
    return max(known, 2 * lcs(*sorted((one, other), key=len, reverse=True)) / (len(one) + len(other)))


def scores_at_least(q: Text, texts: list[Text], need: float, most: np.ndarray) -> np.ndarray:
    """Fuzzy scores where they are `need` at least, else numbers below it; most: bounds of the three ratios, (text, 3)."""
    held = np.array([q.text in d.text for d in texts])
    sets = np.array([0.0 if h else set_ratio(q, d, 3 * need - m[0] - m[1]) for d, h, m in zip(texts, held, most, strict=True)])
    rest = [i for i in np.nonzero(~held & ((most[:, 0] + most[:, 1] + sets) / 3 >= need - SLACK))[0]]
    n, k = len(q.dense), len(q.words)
    dense, spaced, at, to = [], [], 0, 0
    for i in rest:
        m, words = len(texts[i].dense), len(texts[i].words)
        starts = to + np.cumsum([0, *(len(w) + 1 for w in texts[i].words)])
        if n >= m:
            dense.append((i, np.array([at]), np.array([at + m])))
        else:  # as long as the query, and what of it lies inside at both ends
            dense.append((i, at + np.maximum(0, np.arange(1 - n, m)), at + np.minimum(m, np.arange(1, m + n))))
        spaced += [(i, starts[: words - g + 1], starts[g:] - 1) for g in (k - 1, k) if 0 < g <= words]
        at, to = at + m, to + len(texts[i].spaced)
    together = lambda parts: np.concatenate([np.zeros(0, np.uint32), *parts])
    whole = Windows(q.dense, together([texts[i].dense for i in rest]), dense, len(texts))
    grams = Windows(q.spaced, together([texts[i].spaced for i in rest]), spaced, len(texts))
    for share in (8, 40, 0):
        for windows, other, size in ((whole, grams, n), (grams, whole, k)):
            windows.narrow(3 * need - other.most() - sets, max(1, size // share) if share else 1)
    return np.where(held, 1.0, (whole.most() + grams.most() + sets) / 3)


class Searcher:
    """Queries of one block, and each one's best texts so far."""

    def __init__(self, queries: list[tuple[int, str]], k: int, at_least: float) -> None:
        self.queries = prepared(queries)
        self.k, self.at_least = k, at_least
        self.bags = np.stack([q.bags for q in self.queries]) if self.queries else np.zeros((0, 3, CLASSES), np.int64)
        self.lengths = np.array([(len(q.dense), len(q.spaced), q.set_length) for q in self.queries]).reshape(-1, 3)
        self.sizes = np.array([len(q.distinct) for q in self.queries])
        self.where: dict[str, list[int]] = {}
        for i, q in enumerate(self.queries):
            for w in q.distinct:
                self.where.setdefault(w, []).append(i)

    def bounds(self, d: Text) -> tuple[np.ndarray, np.ndarray]:
        """(query, 3): none of the three ratios with d is larger. And whether d may hold the query."""
        shared = np.minimum(self.bags, d.bags).sum(2)
        window = 2 * shared[:, :2] / (self.lengths[:, :2] + shared[:, :2])  # a window has no more letters than it shares, at best
        hits = [(i, len(w) + 1) for w in d.distinct for i in self.where.get(w, ())]
        at, size = np.array(hits, np.int64).reshape(-1, 2).T
        met, n = np.bincount(at, minlength=len(self.bags)), np.maximum(np.bincount(at, size, len(self.bags)) - 1, 0)
        sets = np.maximum(2 * shared[:, 2] / (self.lengths[:, 2] + d.set_length), np.maximum(2 * n / (n + self.lengths[:, 2]), 2 * n / (n + d.set_length)))
        sets = np.where((met > 0) & ((met == self.sizes) | (met == len(d.distinct))), 1.0, sets)
        return np.column_stack([window, sets]), shared[:, 1] == self.lengths[:, 1]

    def search(self, batches: Iterator[list[tuple[int, str]]]) -> list[tuple[int, int, float]]:
        best: list[list[tuple[float, int]]] = [[] for _ in self.queries]  # heaps of (score, -id)
        for batch in batches:
            texts = prepared(batch)
            if not texts or not self.queries:
                continue
            found = [self.bounds(d) for d in texts]
            parts = np.stack([b for b, _ in found])
            whole = np.where(np.stack([h for _, h in found]), 1.0, parts.sum(2) / 3)
            for i, (q, heap) in enumerate(zip(self.queries, best, strict=True)):
                order = np.argsort(-whole[:, i], kind="stable")
                for some in np.split(order, [n for n in (2 * self.k, 8 * self.k) if n < len(order)]):  # the likeliest first: what they reach, the others need
                    need = max(self.at_least, heap[0][0] if len(heap) == self.k else 0.0)
                    some = some[whole[some, i] >= need - SLACK]
                    if not len(some):
                        break
                    for j, score in zip(some, scores_at_least(q, [texts[j] for j in some], need, parts[some, i]).tolist(), strict=True):
                        if score <= 0 or score < need:
                            continue
                        for key in texts[j].ids:
                            if len(heap) < self.k:
                                heapq.heappush(heap, (score, -key))
                            elif (score, -key) > heap[0]:
                                heapq.heapreplace(heap, (score, -key))
        return [(key, -doc, score) for q, heap in zip(self.queries, best, strict=True) for score, doc in heap for key in q.ids]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str]]]:
    """Rows in blocks of TEXTS, with CHARS characters where there are more than one."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (len(held) == TEXTS or size + len(text) > CHARS):
                yield held
                held, size = [], 0
            held.append((key, text))
            size += len(text)
    yield held


def fuzzy_best(docs: DataFrame, queries: DataFrame, k: int, at_least: float = 0.0) -> DataFrame:
    """docs (doc_id, text), queries (query_id, text): each query's k best texts by fuzzy score, of `at_least` and above 0 -> query_id, doc_id, score, rank.

    Nothing is recalled first, so nothing is missed: the score is a mean of three ratios, each bounded by letters and
    words that both texts have, then by subsequences of many windows together. A task takes its likeliest texts first and
    leaves out what can't come among its k best; only windows that still can are compared one by one. Equal texts of a
    block are compared once. Queries are broadcast in blocks of QUERIES; the
    shuffle carries k rows a query and task. Null and empty texts match nothing; ties go to the smaller id; ids are unique.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    schema = "query_id long, doc_id long, score double"

    def block(asked: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Searcher(sent.value, k, at_least).search(blocks(batches))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array([r[c] for r in found], t) for c, t in enumerate(kinds)], ["query_id", "doc_id", "score"])

        return rows.mapInArrow(run, schema)

    out, held, size = None, [], 0
    for r in queries.select(F.col("query_id").cast("long"), F.col("text").cast("string").alias("text")).where("query_id is not null and text is not null").toLocalIterator():
        if held and (len(held) == QUERIES or size + len(r[1]) > CHARS):
            out, held, size = block(held) if out is None else out.unionByName(block(held)), [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held or out is None:
        out = block(held) if out is None else out.unionByName(block(held))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
