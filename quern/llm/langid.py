"""Language identification by cross-parsing entropy.

One suffix automaton per language, over a bounded sample of labelled text.
A text is parsed greedily into the longest phrases that occur in a language's
sample; phrases times log2 of the sample's length, over the text's length,
estimate the cross entropy, and the language with the least wins.

Whole texts are parsed. numpy walks the automata for many pieces of `piece`
bytes at once, each as if a phrase began there; then the state in which the
piece before ends is carried over, and a piece is walked again until its
states meet those found before, from where on nothing changes.

Defined results: `und` with score 0 if a text is null or has no letter (\\p{L}),
or if nothing could be learned; ties go to the smaller language by code point;
score is 1 - least / second least entropy, and 1 for a single language;
repeated rows are judged each; an empty table gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_batches, remainder, small

LETTER = regex.compile(r"\p{L}")
BATCH = 4 << 20  # bytes that are parsed at once (or one text)
_SPACED = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower-case UTF-8 in which a single space stands for each run of ASCII characters that aren't letters."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def suffix_automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Transitions (state, symbol) -> state of the automaton of all substrings; -1 where there is none."""
    links, length, nexts, last = [-1], [0], [{}], 0
    for c in symbols.tolist():
        cur = len(length)
        length.append(length[last] + 1)
        nexts.append({})
        links.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                links[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                nexts.append(dict(nexts[q]))
                links.append(links[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = links[p]
                links[q] = links[cur] = clone
        last = cur
    table = np.full((len(nexts), width), -1, np.int32)
    for state, out in enumerate(nexts):
        if out:
            table[state, list(out)] = list(out.values())
    return table


class Model:
    """Automata as tables that hold, for a state and a symbol, twice the next state, plus one if a phrase ends before the symbol.

    A symbol that the sample lacks is a phrase of its own.
    """

    def __init__(self, samples: dict[str, bytes], piece: int = 512):
        seen = sorted(set().union(*(set(s) for s in samples.values()), b" "))
        self.width, self.piece = len(seen) + 1, piece
        self.classes = np.full(256, len(seen), np.uint8)
        self.classes[seen] = np.arange(len(seen))
        self.languages = sorted(samples)
        self.tables, self.bits = [], []
        for lang in self.languages:
            table = suffix_automaton(self.classes[np.frombuffer(samples[lang], np.uint8)], self.width)
            alone = len(table)  # the state after a symbol that the sample lacks
            root = np.where(table[0] < 0, alone, table[0])
            table = np.concatenate([table, np.full_like(table[:1], -1)])
            steps = np.where(table >= 0, table * 2, root * 2 + 1)
            steps[0] = root * 2  # a text begins in its first phrase
            self.tables.append(steps.astype(np.int32).ravel())
            self.bits.append(np.log2(max(2, len(samples[lang]))))

    def phrases(self, table: np.ndarray, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrase ends inside each piece; follows: whether a piece goes on where the one before ended."""
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        active = np.searchsorted(-size, -np.arange(self.piece), side="left")  # pieces longer than t
        trace = np.empty(len(symbols), np.int32)
        count, state = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
        for t in range(self.piece):
            k = active[t]
            if not k:
                break
            x = table.take(state[:k] * self.width + symbols[at[:k] + t])
            trace[at[:k] + t] = x
            count[:k] += x & 1
            state[:k] = x >> 1
        out = np.empty_like(count)
        out[order] = count
        todo = np.nonzero(follows)[0]
        while len(todo):
            state, place, left = trace[starts[todo] - 1] >> 1, starts[todo].copy(), lengths[todo].copy()
            piece, ended = todo, []
            while len(piece):
                x = table.take(state * self.width + symbols[place])
                old = trace[place]
                out[piece] += (x & 1) - (old & 1)
                trace[place] = x
                state, left = x >> 1, left - 1
                differ = state != old >> 1
                ended.append(piece[differ & (left == 0)])
                go = differ & (left > 0)
                piece, state, place, left = piece[go], state[go], place[go] + 1, left[go]
            todo = np.concatenate(ended) + 1  # these ended elsewhere than before
            todo = todo[todo < len(starts)]
            todo = todo[follows[todo]]
        return out

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """Bits a byte, (text, language)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        symbols = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        pieces = -(-sizes // self.piece)
        owner = np.repeat(np.arange(len(texts)), pieces)
        inside = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * self.piece
        starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + inside
        lengths = np.minimum(self.piece, np.repeat(sizes, pieces) - inside)
        total = [1 + np.bincount(owner, self.phrases(t, symbols, starts, lengths, inside > 0), len(texts)) for t in self.tables]
        return np.stack(total, 1) * np.array(self.bits) / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, scores = ["und"] * len(texts), np.zeros(len(texts))
        judged = [i for i, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        part = np.cumsum([len(texts[i]) for i in judged]) // BATCH
        for some in np.split(np.array(judged, np.int64), np.nonzero(np.diff(part))[0] + 1) if judged else ():
            h = self.entropies([normal(texts[i]) for i in some])
            best, two = h.argmin(1), np.sort(h, 1)[:, :2]
            scores[some] = 1 - two[:, 0] / two[:, 1] if h.shape[1] > 1 else 1.0
            for i, b in zip(some, best, strict=True):
                codes[i] = self.languages[b]
        return codes, scores


def learn(labelled: DataFrame, docs_per_language: int = 300, chars: int = 100_000, piece: int = 512) -> Model:
    """labelled (text, lang) -> Model.

    The sample is bounded: of each language's distinct texts those with the
    smallest hashes, docs_per_language at most and whole, as long as they have
    `chars` characters divided by the number of languages together. Texts that
    are longer than that alone come last, shortest first, and one is taken only
    where there is nothing else. Copies count once. Hashes above a threshold that leaves
    about 32 times docs_per_language texts are dropped before anything is
    shuffled; a language with fewer texts keeps all. That changes what is drawn
    only where nearly all of a language's texts are longer than its share: then
    shorter ones above the threshold aren't seen.
    """
    rows = labelled.where("lang is not null and text is not null and text rlike '\\\\p{L}'").select("lang", F.xxhash64("text", "lang").alias("h"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts"))
    sizes = small(sizes.withColumn("most", F.floor(F.lit(float(1 << 63)) * F.least(F.lit(1.0), 32.0 * docs_per_language / F.col("texts")))))
    share = max(1, chars // max(1, sizes.count()))
    drawn = rows.join(sizes.select("lang", "most"), "lang").where("most >= 9223372036854775807 or abs(h) <= most").groupBy("lang", "h").agg(F.min("text").alias("text"))
    length = F.length("text")
    drawn = drawn.withColumn("long", F.when(length > share, length).otherwise(0))
    order = Window.partitionBy("lang").orderBy("long", "h", "text")
    drawn = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language).withColumn("held", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    found = drawn.where(f"n = 1 or held <= {share}").groupBy("lang").agg(texts.alias("text")).collect()
    return Model({r["lang"]: s for r in found if (s := normal(r["text"]))}, piece)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with a text column -> the columns in `keep` (all by default), then the language and its score under `names`."""
    keep = tuple(docs.columns) if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # learn() bounds its sample
    columns = [docs[c].alias(f"_{i}") for i, c in enumerate(keep)]
    rows = docs.select(*columns, F.col("text").cast("string").alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, scores = shared.value.predict(batch.column(len(keep)).to_pylist())
        return pa.record_batch([*batch.columns[: len(keep)], pa.array(codes, pa.string()), pa.array(scores)], [*batch.schema.names[: len(keep)], "_lang", "_score"])

    schema = ", ".join([*(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "_lang string", "_score double"])
    out = map_batches(rows, run, schema)
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), F.col("_lang").alias(names[0]), F.col("_score").alias(names[1]))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 0


def learn_documents(docs: DataFrame) -> Model:
    return learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))


def query(docs: DataFrame) -> DataFrame:
    found = identify(docs, learn_documents(docs), ("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
