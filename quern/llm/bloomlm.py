"""Language model scoring with a log-frequency Bloom filter.

Training counts words exactly and bigrams in hash ranges. A bigram that
occurs at least `min_count` times is put in the filter once for each level
1..q of its quantised count, q = 1 + floor(log2(count / min_count)); probes
for level 1, 2, ... until one misses give the count back as
min_count * 2**(q - 1), never more than the count but for false positives.

A word w after h has probability (1 - a) * base(w) + a * (count(h w) - D) / count(h)
with base the add-half unigram probability and the absolute discount D, which
tells a bigram seen once from one seen often; it sums to 1 at most. The
weight a is not fixed: a text's probability is the mean over WEIGHTS, so a
text that repeats the corpus and one that doesn't each get what suits them,
and no text loses more than log10(len(WEIGHTS)) against the base.

The filter has `bits_per_entry` bits an entry or more, whatever the input's
size. It is broadcast up to MOST_FILTER bytes, as are word counts up to
`most_words` words; beyond either, each block of texts asks the hash ranges
of its own words and bigrams, and the same probes answer there.

Defined results: a null text is empty and has the end token alone; without
training text every token is unknown with base probability 1 / (0 + 1);
repeated rows are scored each; an empty table gives no rows; extra columns
are ignored, whatever their names; ties don't occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, remainder

WEIGHTS = (0.0, 0.02, 0.1, 0.3, 0.6, 0.9)
END = b" end"  # no word holds a space
PART_BYTES = 24 << 20  # text for which there is one hash range
SLICE = 6 << 20  # bytes of text that are tokenised at once
MOST_FILTER = 96 << 20  # bytes of a filter that is broadcast
DISCOUNT = 0.75
PROBES = 4


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens; each token's index among them; the end of each text. Every text ends in END."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, sizes = words.flatten(), pc.list_value_length(words).to_numpy()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves empty ones
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), real, len(sizes)).astype(np.int64) if len(flat) else sizes.astype(np.int64)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in [*coded.dictionary.to_pylist(), END]), np.uint64)
    ends = np.cumsum(sizes + 1)
    codes = np.full(ends[-1] if len(ends) else 0, len(hashes) - 1, np.int64)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = False
    codes[inner] = coded.indices.to_numpy()
    return hashes, codes, ends


def bigram_hashes(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """48 bits for each token and the one before; a text's first follows END."""
    before = np.empty_like(codes)
    before[:1], before[1:] = len(hashes) - 1, codes[:-1]
    return mix(hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[codes]) >> np.uint64(16)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about SLICE bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE)))
        yield at, to - at
        at = to


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers in 1, 2, 4 or 8 bytes, told by the first byte."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or x.max(initial=0) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack_numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.uint64)


def counted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and their summed weights."""
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    first = np.nonzero(np.diff(values, prepend=~values[:1]))[0]
    return values[first], np.add.reduceat(weights, first) if len(first) else weights


def probe(keys: np.ndarray, level: int, i: int, bits: np.ndarray) -> np.ndarray:
    """Bit places of keys for a level's i-th probe, in filters of `bits` bits."""
    h = mix(keys + np.uint64(level * 0xD1342543DE82EF95 % (1 << 64)))
    return (h + np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1))) % bits


def levels(counts: np.ndarray, min_count: int) -> np.ndarray:
    return 1 + np.floor(np.log2(counts.astype(np.float64) / min_count)).astype(np.int64)


def filter_of(keys: np.ndarray, counts: np.ndarray, min_count: int, bits_per_entry: float) -> bytes:
    """The filter of a hash range."""
    q = levels(counts, min_count)
    bits = max(1, int(np.ceil(bits_per_entry * q.sum() / 64))) * 64
    flags = np.zeros(bits, bool)
    for level in range(1, q.max(initial=0) + 1):
        for i in range(PROBES):
            flags[probe(keys[q >= level], level, i, np.uint64(bits))] = True
    return np.packbits(flags, bitorder="little").tobytes()


class Filter:
    """Filters of all hash ranges, one after the other."""

    def __init__(self, ranges: list[bytes], min_count: int, shift: int | None = None):
        self.min_count = min_count
        self.shift = np.uint64(48 - (len(ranges).bit_length() - 1) if shift is None else shift)
        sizes = np.array([len(r) for r in ranges], np.uint64)
        self.bits, self.base = sizes * np.uint64(8), np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(ranges), np.uint8)

    @classmethod
    def of(cls, sizes: np.ndarray, data: np.ndarray, min_count: int) -> Filter:
        """The same from the ranges' sizes in bytes and their bytes."""
        made = cls([bytes(0)] * len(sizes), min_count)
        made.bits, made.base = sizes.astype(np.uint64) * np.uint64(8), (np.cumsum(sizes) - sizes).astype(np.uint64)
        made.data = data
        return made

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts of bigrams, 0 for those that aren't there."""
        out = np.zeros(len(keys), np.float64)
        alive, level = np.arange(len(keys)), 1
        part = (keys >> self.shift).astype(np.int64)
        bits, base = self.bits[part], self.base[part]
        while len(alive):
            for i in range(PROBES):  # most keys miss at the first probe
                if not len(alive):
                    break
                place = probe(keys[alive], level, i, bits[alive])
                hit = (self.data[base[alive] + (place >> np.uint64(3))] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                alive = alive[hit.astype(bool)]
            out[alive] = self.min_count * 2.0 ** (level - 1)
            level += 1
        return out


class Words:
    """Counts of words by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order].astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0).astype(np.float64)


class Ranges:
    """Answers of the hash ranges to a block's keys, in place of the filter."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.found = keys[order], counts[order]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.keys, keys)]


def score(texts: pa.Array, words: Words, bloom: Filter | Ranges, total: int, types: int) -> list[np.ndarray]:
    """n_tokens, n_known, base_score, score of each text."""
    out = []
    for at, length in slices(texts):
        hashes, codes, ends = tokens(texts.slice(at, length))
        starts = np.concatenate([[0], ends[:-1]])
        known = words(hashes)
        p = (known + 0.5) / (total + 0.5 * (types + 1))
        base = np.add.reduceat(np.log10(p)[codes], starts)
        keys = bigram_hashes(hashes, codes)
        before = np.empty(len(codes))
        before[:1], before[1:] = known[-1], known[codes[:-1]]
        follow = np.clip((bloom.counts(keys) - DISCOUNT) / np.maximum(before, 1), 0.0, 1.0)
        sums = [base]
        some = np.nonzero(follow)[0]
        text = np.searchsorted(ends, some, side="right")
        for a in WEIGHTS[1:]:  # all bigrams lose 1 - a; those in the filter gain
            gain = np.log10(((1 - a) * p[codes[some]] + a * follow[some]) / ((1 - a) * p[codes[some]]))
            sums.append(base + (ends - starts) * np.log10(1 - a) + np.bincount(text, gain, len(ends)))
        sums = np.stack(sums)
        top = sums.max(0)
        mixed = top + np.log10(np.mean(10.0 ** (sums - top), 0))
        out.append((ends - starts, np.add.reduceat((known > 0).astype(np.int64)[codes], starts), base, mixed))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 4


def train(texts: DataFrame, min_count: int = 1, bits_per_entry: float = 10.0) -> DataFrame:
    """texts (text) -> a row for each hash range and kind: kind ('words' or 'bigrams'), part, hashes, counts, filter, tokens, types."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 8
    while parts * PART_BYTES < size:
        parts *= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = parts.bit_length() - 1
        for batch in batches:
            column = batch.column(0)
            for at, length in slices(column):
                hashes, codes, _ = tokens(column.slice(at, length))
                rows = []
                for kind, (values, counts), bits in (
                    ("words", counted(hashes, np.bincount(codes, minlength=len(hashes)).astype(np.uint64)), 64),
                    ("bigrams", np.unique(bigram_hashes(hashes, codes), return_counts=True), 48),
                ):
                    cuts = np.searchsorted(values >> np.uint64(bits - log), np.arange(parts + 1, dtype=np.uint64))
                    for part, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if hi > lo:  # in order, so differences are short
                            rows.append((kind, part, pack_numbers(np.diff(values[lo:hi], prepend=np.uint64(0))[1:]), int(values[lo]), pack_numbers(counts[lo:hi].astype(np.uint64))))
                kinds = (pa.string(), pa.int32(), pa.binary(), pa.uint64(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                columns[3] = columns[3].view(pa.int64())
                yield pa.record_batch(columns, ["kind", "part", "steps", "least", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        values, weights = [], []
        for steps, least, counts in zip(table["steps"].to_pylist(), table["least"].to_numpy().view(np.uint64), table["counts"].to_pylist(), strict=True):
            values.append(np.cumsum(np.concatenate([[least], unpack_numbers(steps)]), dtype=np.uint64))
            weights.append(unpack_numbers(counts))
        hashes, counts = counted(np.concatenate(values), np.concatenate(weights))
        kind, part = table["kind"][0], table["part"][0]
        row = {"kind": kind, "part": part, "hashes": None, "counts": None, "filter": None, "tokens": int(counts.sum()), "types": len(counts)}
        if kind.as_py() == "words":
            row |= {"hashes": hashes.tobytes(), "counts": counts.tobytes()}
        else:
            often = counts >= min_count
            row |= {"filter": filter_of(hashes[often], counts[often], min_count, bits_per_entry)}
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array([v.as_py() if isinstance(v, pa.Scalar) else v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    blocks = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(count, "kind string, part int, steps binary, least long, counts binary")
    merged = blocks.groupBy("kind", "part").applyInArrow(merge, "kind string, part int, hashes binary, counts binary, filter binary, tokens long, types long")
    return materialise(merged.withColumn("parts", F.lit(parts)))


def score_texts(docs: DataFrame, model: DataFrame, min_count: int = 1, most_words: int = 1 << 23, block: int = 32 << 20, most_filter: int = MOST_FILTER) -> DataFrame:
    """docs (doc_id, text) and train()'s result -> doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    words, bigrams = model.where("kind = 'words'"), model.where("kind = 'bigrams'")
    total, types = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("types")).first())
    parts, size = bigrams.agg(F.max("parts"), F.sum(F.octet_length("filter"))).first()
    parts = parts or 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(ids: pa.Array, texts: pa.Array, table: Words, bloom: Filter | Ranges) -> pa.RecordBatch:
        n, known, base, full = score(texts, table, bloom, total, types)
        return pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), total), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())], names)

    if types <= most_words and (size or 0) <= most_filter:
        # Row by row into arrays of known size: the driver never holds the model twice.
        sizes = np.full(parts, 8, np.int64)
        for r in bigrams.select("part", F.octet_length("filter").alias("n")).collect():  # a row a hash range
            sizes[r["part"]] = r["n"]
        data, base = np.zeros(sizes.sum(), np.uint8), np.cumsum(sizes) - sizes
        for r in bigrams.select("part", "filter").toLocalIterator():
            data[base[r["part"]] : base[r["part"]] + sizes[r["part"]]] = np.frombuffer(r["filter"], np.uint8)
        bloom = spark.sparkContext.broadcast(Filter.of(sizes, data, min_count))
        del data
        table, at = (np.empty(types, np.uint64), np.empty(types, np.uint64)), 0
        for r in words.select("hashes", "counts").toLocalIterator():
            n = len(r["hashes"]) // 8
            table[0][at : at + n], table[1][at : at + n] = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.uint64)
            at += n
        counts = spark.sparkContext.broadcast(Words(*table))
        del table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield scored(batch.column(0), batch.column(1), counts.value, bloom.value)

        return rows.mapInArrow(run, schema)

    # The keys of a block of texts, by hash range, meet the range's counts or filter; the answers meet the block's texts.
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    rows = materialise(rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))))
    log = parts.bit_length() - 1

    def ask(table: pa.Table) -> pa.Table:
        column, out = table["text"].combine_chunks(), []
        asked: dict[str, list[np.ndarray]] = {"words": [], "bigrams": []}
        for at, n in slices(column):
            hashes, codes, _ = tokens(column.slice(at, n))
            asked["words"].append(np.unique(hashes))
            asked["bigrams"].append(np.unique(bigram_hashes(hashes, codes)))
        for kind, bits in (("words", 64), ("bigrams", 48)):
            keys = np.unique(np.concatenate(asked[kind]))
            cuts = np.searchsorted(keys >> np.uint64(bits - log) if log else np.zeros(len(keys), np.uint64), np.arange(parts + 1, dtype=np.uint64))
            out += [(kind, part, int(keys[lo]), pack_numbers(np.diff(keys[lo:hi]))) for part, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        kind, part, least, steps = zip(*out, strict=True)
        return pa.table([pa.array([table["b"][0].as_py()] * len(out)), pa.array(kind), pa.array(part, pa.int32()), pa.array(least, pa.uint64()).view(pa.int64()), pa.array(steps, pa.binary())], ["b", "kind", "part", "least", "steps"])

    answers_of = pa.schema([("b", pa.int64()), ("kind", pa.string()), ("least", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary())])

    def keys_of(least: int, steps: bytes) -> np.ndarray:
        return np.cumsum(np.concatenate([np.array([least], np.int64).view(np.uint64), unpack_numbers(steps)]), dtype=np.uint64)

    def answer(table: pa.Table, held: pa.Table) -> pa.Table:
        """All blocks' keys of a hash range, and the range (none: nothing is known there), which is loaded once for them."""
        if table.num_rows == 0:
            return answers_of.empty_table()
        if table["kind"][0].as_py() == "words":
            of = [np.frombuffer(held[c][0].as_py() if held.num_rows else b"", np.uint64) for c in ("hashes", "counts")]
            known = Words(*of)
        else:
            known = Filter([held["filter"][0].as_py() if held.num_rows else bytes(8)], min_count, 48).counts
        got = [pack_numbers(known(keys_of(a.as_py(), s.as_py())).astype(np.uint64)) for a, s in zip(table["least"], table["steps"], strict=True)]
        return table.select(["b", "kind", "least", "steps"]).append_column("counts", pa.array(got, pa.binary())).cast(answers_of)

    def run_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found = {}
        for kind in ("words", "bigrams"):
            some = answers.filter(pc.equal(answers["kind"], kind))
            keys = [keys_of(a, s) for a, s in zip(some["least"].to_pylist(), some["steps"].to_pylist(), strict=True)]
            counts = [unpack_numbers(c) for c in some["counts"].to_pylist()]
            found[kind] = np.concatenate(keys), np.concatenate(counts)
        bloom = Ranges(found["bigrams"][0], found["bigrams"][1].astype(np.float64))
        return pa.Table.from_batches([scored(texts["doc_id"].combine_chunks(), texts["text"].combine_chunks(), Words(*found["words"]), bloom)])

    asked = rows.groupBy("b").applyInArrow(ask, "b long, kind string, part int, least long, steps binary")
    answers = asked.groupBy("kind", "part").cogroup(model.select("kind", "part", "hashes", "counts", "filter").groupBy("kind", "part")).applyInArrow(answer, "b long, kind string, least long, steps binary, counts binary")
    return rows.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(run_block, schema)


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 1


def query(docs: DataFrame) -> DataFrame:
    found = score_texts(docs, train(docs.where(~held_out(F.col("doc_id"))).select("text")))
    gain = (F.col("score") - F.col("base_score")) / F.col("n_tokens")  # what the corpus tells of the text's word order, a token
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", gain.alias("gain_per_token"))
