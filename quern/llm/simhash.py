"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are put in tiles by the population counts of their four
16-bit quarters. A pair of tiles whose counts differ by more than the radius
in sum can't hold a link and is skipped; of the others all pairs are compared
by exclusive-or and bit counts. A pair of tiles yields a forest of its links,
never all of them, and components join the forests.

deduplicate_similar() finds texts whose sets of five-word shingles have a
Jaccard similarity of 4/5 or more. At 4/5 about 15 % of the bits differ, so
fingerprints have WORDS words of 64 bits: of pairs of tiles that aren't
skipped all pairs are compared by the first word within NEAR bits, and what
passes by all words within FAR bits; a pair at 4/5 is missed by about one in
ten thousand. That radius leaves population counts little to skip, so the
comparisons grow with the square of the distinct texts. Forests of these
candidates join texts to groups, and inside a group sets of shingles are
compared exactly: a search from node to node meets only nodes that aren't
reached yet, so many copies of one text cost about one comparison each. A group
of more than PART nodes is dealt in parts, and pairs of parts are compared.

Defined results: a null text is the empty text; texts of fewer words than a
shingle are one shingle; without words the fingerprint
is zero, which links like any other; repeated rows share a component; a
component of null ids has a null component_id; an empty table gives no rows;
extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, small, text_key
from ._graph import components, roots
from .bloomlm import mix, slices, tokens

SEED = 42
QUARTERS = 4
SIDE = 17  # values of a quarter's population count
TILE = 4096  # fingerprints in a tile, on average at most
WIDTH = 5
WORDS = 4
NEAR, FAR = 22, 72  # bits of the first word, and of all, that may differ between candidates
WIDE_TILE = 16_384  # wide fingerprints in a tile
PART = 4096  # nodes in a part of a group, on average at most
STEP = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, width: int = 3, chunk: int = 1 << 16) -> int:
    """Signed 64 bits. Shingles are hashed by chunks, so memory is bounded for any text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, chunk):
        part = words[at : at + chunk + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        for block in np.split(hashes, range(4096, len(hashes), 4096)):
            counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then fp (long)."""
    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), width) for t in batch.column(len(keep))], pa.int64())
            yield pa.record_batch([*batch.columns[: len(keep)], fps], [*batch.schema.names[: len(keep)], "fp"])

    schema = ", ".join([*(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "fp long"])
    return rows.mapInArrow(run, schema).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "fp")


def _offsets(radius: int) -> list[int]:
    """Differences of tile codes within the radius that aren't negative: each pair of tiles is met once."""
    steps = [()]
    for _ in range(QUARTERS):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    codes = (sum(d * SIDE**i for i, d in enumerate(s)) for s in steps)
    return sorted({c for c in codes if c >= 0})


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """A forest (fingerprint, root) over the links between two arrays of fingerprints."""
    n = len(a)
    node = np.concatenate([a, b])
    root = np.arange(len(node))
    a, b = a.view(np.uint64), b.view(np.uint64)  # numpy counts the bits of absolute values
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        if len(i):
            rows = np.arange(len(node))
            root = roots(len(node), np.concatenate([rows, i + at]), np.concatenate([root, j + n]))
    moved = np.nonzero(root != np.arange(len(node)))[0]
    return np.stack([node[moved], node[root[moved]]], 1)


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps (fp), distinct -> a forest (u, v) of the links at `radius` or fewer differing bits."""
    code = F.lit(0)
    for i in range(QUARTERS):
        code = code + F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) * SIDE**i
    coded = materialise(fps.select("fp", code.cast("int").alias("cell")))
    cells = coded.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))  # 17**4 rows at most
    dealt = coded.join(F.broadcast(cells), "cell").select("cell", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"), "fp")
    tiles = materialise(dealt.groupBy("cell", "part").agg(F.collect_list("fp").alias("fps")))
    left = tiles.select(F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.col("fps").alias("a"), F.explode(F.array(*(F.lit(o) for o in _offsets(radius)))).alias("o"))
    pairs = left.withColumn("cell", F.col("cell_a") + F.col("o")).join(tiles.withColumnRenamed("fps", "b"), "cell")
    pairs = pairs.where("o > 0 or part_a <= part").where("o > 0 or part_a < part or size(a) > 1").select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            a, b = batch.column(0), batch.column(1)
            va, vb, oa, ob = np.asarray(a.flatten()), np.asarray(b.flatten()), np.asarray(a.offsets), np.asarray(b.offsets)
            oa, ob = oa - oa[0], ob - ob[0]
            for i in range(batch.num_rows):
                found.append(close_pairs(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], radius))
            uv = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            yield pa.record_batch([pa.array(uv[:, 0]), pa.array(uv[:, 1])], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long").where("u <> v")


def groups(prints: DataFrame, radius: int = 2) -> DataFrame:
    """prints (doc_id, fp) -> fp, root (a fingerprint), component_id for each distinct fingerprint."""
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(reps.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = reps.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def deduplicate(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """docs, one row of each component: the smallest doc_id, and of repeated ids one row."""
    columns = docs.columns
    same = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *text_key(F.col("text"))).alias("_same")  # the same for repeats of a row
    prints = materialise(fingerprints(docs.select("doc_id", "text", same), width, ("doc_id", "_same")))
    first = prints.join(groups(prints, radius), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_same")).alias("first"))
    whole = docs.select(F.struct(*columns).alias("_row"), same)
    kept = whole.join(first.select(F.col("first._same").alias("_same")), "_same", "left_semi").dropDuplicates(["_same"])
    return kept.select(*(F.col("_row")[c].alias(c) for c in columns))


def shingles(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for at, length in slices(texts):
        hashes, codes, ends = tokens(texts.slice(at, length))
        start = 0
        for end in ends:
            words = hashes[codes[start : end - 1]]  # without the end token
            start = end
            n = min(width, len(words))
            found = words[: len(words) - n + 1] if n else words
            for i in range(1, n):
                found = mix(found * STEP + words[i : len(words) - n + 1 + i])
            yield np.unique(found)


def wide_fingerprint(found: np.ndarray, chunk: int = 4096) -> bytes:
    """WORDS words of 64 bits: each bit is 1 if set in over half of the shingles' hashes."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), chunk):
        part = found[at : at + chunk]
        hashes = mix(part[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * STEP)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, np.int64)
    return np.packbits(2 * counts > len(found), bitorder="little").tobytes()


def linked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links of similarity 4/5 or more, as places in `sets`."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(codes.max(initial=0) + 1, bool)
    rest, u, v = np.arange(len(sets)), [], []
    owner = np.repeat(rest, sizes)
    while len(rest):
        todo = [rest[0]]
        keep = rest != rest[0]
        while todo:
            if not keep.all():
                rest = rest[keep]
                left = np.zeros(len(sets), bool)
                left[rest] = True
                held = left[owner]
                codes, owner = codes[held], owner[held]
            if not len(rest):
                break
            x = todo.pop()
            mark[own[x]] = True
            shared = np.bincount(owner, mark[codes], len(sets))[rest]
            mark[own[x]] = False
            near = 9 * shared >= 4 * (sizes[x] + sizes[rest])  # shared / union >= 4/5
            u += [x] * int(near.sum())
            v += rest[near].tolist()
            todo += rest[near].tolist()
            keep = ~near
        else:
            rest = rest[keep]
    return np.array(u, np.int64), np.array(v, np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, _same, text) -> doc_id, _same, node (of the set of shingles), bits (its wide fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bits = [], []
            for found in shingles(batch.column(2)):
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                bits.append(wide_fingerprint(found))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(bits, pa.binary())], ["doc_id", "_same", "node", "bits"])

    rows = docs.select("doc_id", "_same", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _same string, node long, bits binary")


def close_wide(a: np.ndarray, b: np.ndarray, same: bool, block: int = 64) -> np.ndarray:
    """Root of each row of a, then of b, over pairs within NEAR and FAR bits; a, b: (rows, WORDS); same: b is a."""
    n, m = len(a), 0 if same else len(b)
    root, nodes = np.arange(n + m), np.arange(n + m)
    wide = -(-len(b) // 8) * 8  # marks are looked through eight at a time
    first = np.zeros(wide, np.uint64)
    first[: len(b)] = b[:, 0]
    differ, ones, mark = (np.empty((block, wide), t) for t in (np.uint64, np.uint8, bool))
    for at in range(0, n, block):
        k, low = min(block, n - at), at // 8 * 8 if same else 0  # each pair once
        size = wide - low
        x, c, hit = (v.ravel()[: k * size].reshape(k, size) for v in (differ, ones, mark))
        np.bitwise_xor(a[at : at + k, 0][:, None], first[None, low:], out=x)
        np.less_equal(np.bitwise_count(x, out=c), NEAR, out=hit)
        eights = np.flatnonzero(hit.ravel().view(np.uint64))
        of, bit = np.nonzero(hit.reshape(-1, 8)[eights])
        i, j = np.divmod(eights[of] * 8 + bit, size)
        i, j = i + at, j + low
        real = (j < len(b)) & (i < j) if same else j < len(b)
        i, j = i[real], j[real]
        near = np.bitwise_count(a[i] ^ b[j]).sum(1, dtype=np.int64) <= FAR
        if near.any():
            i, j = i[near], j[near] + (0 if same else n)
            root = roots(n + m, np.concatenate([nodes, i]), np.concatenate([root, j]))
    return root


def candidate_links(prints: DataFrame) -> DataFrame:
    """signatures() -> a forest (u, v) of nodes over candidates."""
    reps = materialise(prints.groupBy("node").agg(F.min("bits").alias("bits")))
    tiles = max(1, -(-reps.count() // WIDE_TILE))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
            yield pa.record_batch([*batch.columns, pa.array(np.bitwise_count(words[:, 0]).astype(np.int32))], ["node", "bits", "ones"])

    weighed = reps.mapInArrow(weigh, "node long, bits binary, ones int")
    order = F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int")
    dealt = materialise(weighed.groupBy(order.alias("tile")).agg(F.collect_list(F.struct("node", "bits", "ones")).alias("rows"), F.min("ones").alias("low"), F.max("ones").alias("high")))
    left = dealt.select(F.col("tile").alias("i"), F.col("rows").alias("a"), "low", "high", F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("j"))
    right = dealt.select(F.col("tile").alias("j"), F.col("rows").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    pairs = left.join(right, "j").where(f"low_b - high <= {NEAR} and low - high_b <= {NEAR}").select("a", F.when(F.col("i") < F.col("j"), F.col("b")).alias("b"))

    def side(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(rows.field(0)), np.frombuffer(b"".join(rows.field(1).to_pylist()), np.uint64).reshape(-1, WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                nodes, x = side(a.values)
                others, y = side(b.values) if b.is_valid else (nodes[:0], x)
                root = close_wide(x, y, not b.is_valid)
                nodes = np.concatenate([nodes, others])
                moved = np.nonzero(root != np.arange(len(nodes)))[0]
                yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def exact_links(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """signatures() and their docs (_same, text) -> a forest (u, v) over nodes of similarity 4/5 or more."""
    groups = components(candidate_links(prints))
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = groups.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    one = prints.groupBy("node").agg(F.min("_same").alias("_same")).join(dealt, "node")
    asked = materialise(one.select("_same", "node", "component", "parts", "part"))
    texts = docs.join(small(asked), "_same").dropDuplicates(["_same"])
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: (o != F.col("part")) | (F.col("parts") == 1))
    rows = texts.select("node", "component", "part", F.explode(others).alias("o"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("component", F.least("part", "o").alias("low"), F.greatest("part", "o").alias("high"), "node", "text")

    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        u, v = linked(list(shingles(table["text"].combine_chunks()))) if len(nodes) > 1 else (nodes[:0], nodes[:0])
        return pa.table([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])

    return rows.groupBy("component", "low", "high").applyInArrow(run, "u long, v long")


def deduplicate_similar(docs: DataFrame) -> DataFrame:
    """docs, one row of each component at a Jaccard similarity of 4/5 or more: the smallest doc_id, and of repeated ids one row."""
    columns = docs.columns
    same = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *text_key(F.col("text"))).alias("_same")  # the same for repeats of a row
    prints = materialise(signatures(docs.select("doc_id", "text", same)))
    found = components(exact_links(prints, docs.select(same, "text")))
    rooted = prints.select("doc_id", "_same", "node").join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_same")).alias("first"))
    whole = docs.select(F.struct(*columns).alias("_row"), same)
    kept = whole.join(first.select(F.col("first._same").alias("_same")), "_same", "left_semi").dropDuplicates(["_same"])
    return kept.select(*(F.col("_row")[c].alias(c) for c in columns))


def query(docs: DataFrame) -> DataFrame:
    prints = materialise(fingerprints(docs))
    found = prints.join(groups(prints).select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
