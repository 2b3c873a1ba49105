"""Packing by power-of-two decomposition.

A document's ids are split into pieces whose lengths are powers of two, at
most `capacity`, longest first. A piece is a sequence of its own, so no
sequence crosses documents and none needs padding. Equal lengths form the
buckets that training batches draw from: `bucket` is a length's logarithm,
and write_buckets() stores each bucket in a folder of its own.

Ids are those of the tokenizers library for a tokenizer file. Where the file
is byte-level BPE with the common pattern and no other steps, tiktoken gives
the same ids from the file's vocabulary, in a third of the time; any other
file, and any text with an added token or a very long run of white space, is
left to tokenizers.

Defined results: a null text is the empty text, which has the end id alone;
repeated rows are packed each; an empty table gives no piece; extra columns
are ignored, whatever their names; the string of a token that the file adds to
its vocabulary is that token, as the file's tokenizer has it; very long texts
are encoded whole; ties don't occur.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's pattern that such files stand for.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of white space in a run that tiktoken's pattern is known to pass; beyond, it can fail.
RUN = 50_000
WHITE = re.compile(r"\s+")
CHUNK = 4 << 20  # bytes of text that are encoded at once
ROWS = 16_384  # pieces in a record batch
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def decompose(n: int, capacity: int = 2048) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out, at = [], 0
    while at < n:
        length = min(capacity, 1 << ((n - at).bit_length() - 1))
        out.append((at, length))
        at += length
    return out


def byte_ranks(tokenizer: dict) -> dict[bytes, int] | None:
    """Bytes and ids of a tokenizer file's vocabulary, if ids follow the merges and nothing but the common byte-level pattern comes before; else None."""
    model, pre = tokenizer["model"], tokenizer.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or not plain or odd or tokenizer.get("normalizer"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = {k: i for k, i in model["vocab"].items() if all(c in byte_of for c in k)}
    order = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in order or order != sorted(order) or any(vocab.get(c, len(vocab)) > min(order, default=0) for c in byte_of):
        return None
    return {bytes(byte_of[c] for c in k): i for k, i in vocab.items()}


class Encoder:
    """Ids of whole texts, each followed by the end id."""

    def __init__(self, path: str, end_id: int):
        self.path, self.end = path, end_id
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ranks = byte_ranks(file)
        self.added = [t["content"] for t in file.get("added_tokens") or []]
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Loaded only where a text needs it: beside tiktoken's tables it would take as much memory again."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(token in text for token in self.added) and (len(text) < RUN or all(m.end() - m.start() < RUN for m in WHITE.finditer(text))):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without nulls -> all ids one after the other, and the number of each text's."""
        found = [self.ids(text) for text in texts.to_pylist()]
        counts = np.array([len(ids) + 1 for ids in found], np.int64)
        end = (self.end,)
        return np.fromiter(chain.from_iterable(chain(ids, end) for ids in found), np.uint32, int(counts.sum())), counts

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as bytes (unsigned 32 bits, little-endian)."""
        ids, counts = self.encode(pa.array(texts, pa.string()))
        for found in np.split(ids, np.cumsum(counts)[:-1]):
            yield found.astype("<u4").tobytes()


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """One a worker process, whatever number of tasks it runs."""
    return Encoder(path, end_id)


def chunks(texts: pa.Array) -> Iterator[slice]:
    """Runs of texts of about CHUNK bytes (or one text)."""
    part = np.cumsum(np.array(pc.binary_length(texts), np.int64)) // CHUNK
    ends = np.append(np.nonzero(np.diff(part))[0] + 1, len(texts))
    for at, to in zip(np.append(0, ends[:-1]), ends, strict=True):
        if to > at:
            yield slice(int(at), int(to))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset

    and bucket (the length's logarithm).

    capacity: a power of two. sequence_id is unique, not dense; a recomputed
    partition gives the same ids only as it reads the same rows in order, so
    docs should be a stored table.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer, end_id)
        for batch in batches:
            for some in chunks(batch.column(1)):
                ids, counts = known.encode(batch.column(1)[some])
                cuts = [decompose(n, capacity) for n in counts.tolist()]
                of = np.repeat(np.arange(len(counts)), [len(c) for c in cuts])
                start, length = np.array([piece for c in cuts for piece in c], np.int64).T
                ends = np.concatenate([[0], np.cumsum(length)]) * 4  # pieces follow each other as their ids do
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                doc = batch.column(0)[some].take(pa.array(of))
                for at in range(0, len(of), ROWS):
                    few = slice(at, at + ROWS)
                    columns = [doc[few], pa.array(start[few]), pa.array(length[few]), pa.array(counts[of[few]]), held[few].cast(pa.binary())]
                    yield pa.record_batch(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])

    pieces = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
    bucket = F.log2("length").cast("int")
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": bucket})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """pack()'s rows as Parquet, a folder for each bucket: a batch reader meets sequences of one length. Tasks write their own files, so no bucket is gathered."""
    pieces.write.partitionBy("bucket").parquet(path)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
