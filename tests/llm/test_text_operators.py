"""Operators on texts against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import bloomlm, langid, mixing, packing, simhash, suffixdedup, suffixstore

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies string, fp string"
SF = "/root/testdata/sf0.001"


def words(seed, n, kinds=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(2 + r.randrange(6))) if r.random() < 0.5 else f"w{r.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = words("shared", 120)
    made = [(i, words(i, 5 + 12 * i), "en" if i % 3 else "de", f"s{i % 5}", 0) for i in range(30)]
    made += [(100 + i, f"{words(i + 50, 60)} {shared} {words(i + 90, 30)}", "en", "s0", 0) for i in range(8)]
    made += [(200 + i, made[20][1], "en", "s0", 0) for i in range(6)]
    made += [(300 + i, made[25][1] + f" tail{i}", "en", "s0", 0) for i in range(6)]
    made += [(400, None, "en", "s1", None), (401, "", None, None, 0), (402, " \t\n ", "en", "s1", 0), (403, "123 !! --", "en", "s1", 0), (404, "ti " * 900, "de", "s9", 0)]
    made += [(405, words("long", 9000), "en", "s2", 0), (None, words("null id", 50), "en", "s2", 0), (7, made[7][1], "en", "s2", 0), (406, "ü" * 300 + " é", "de", "ß", 0), (407, "Ünï cödé\u00a0x\x1cy A\x0bB", "de", "ß", 0)]
    return [(*r, "x", "y") for r in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def empty(spark):
    return spark.createDataFrame([], DOCS)


# packing


def test_packing_round_trip(docs, rows, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and {p["offset"] for p in pieces} == {0}
    by = collections.defaultdict(list)
    for p in pieces:
        assert p["length"] & (p["length"] - 1) == 0 and p["length"] <= 2048 and len(p["ids"]) == 4 * p["length"]
        by[p["doc_id"]].append((p["start"], p["ids"], p["doc_tokens"]))
    for doc_id, text, *_ in rows:
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        found = sorted(by[doc_id])
        copies = 2 if doc_id == 7 else 1  # a repeated row is packed twice
        assert b"".join(x[1] for x in found[::copies]) == want and {x[2] for x in found} == {len(want) // 4}
        assert found[::copies] == found[copies - 1 :: copies]
    assert packing.query(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a \n b", "a\n\nb c", "x\u00a0 y \u2003z", "it's 's  ", "", "a <|endoftext|> b", "don't we'll, É's.", "one.\nTwo,\n\nthree\r\nx2", "ÿ\nß÷b×.c ab<|endoftext|>", "\x1c a \x1d b", "日本 語 1 2"])
def test_encoder_equals_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = next(packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1)([text]))
    assert np.frombuffer(found, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_encoder_of_many_texts_keeps_their_order():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a b", " a b", "", "b", "b  a", words(1, 90), "\x00 b \x00", "\u3000 a", "a\u3000b a", "a\nb a", "a \nb", "a ", words(2, 9)] * 3
    found = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1)(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [[*t.encode(text, add_special_tokens=False).ids, 1] for text in texts]


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "ab" * 500_000, "a" * 30_000, "Ab" * 4000 + " c", "!?" * 3000, " " * 5000 + "x", "12" * 3000, "日本" * 2500, "\n" * 2500])
def test_long_pre_tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    found = next(packing.encoder(path, 1)([text]))
    assert np.frombuffer(found, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_another_tokenizer_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    e = packing.Encoder(path, 7)
    assert e.fast is None
    for text in ("Two words, don't", "  a\n b", ""):
        assert np.frombuffer(next(e([text])), "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 7]


def test_buckets(docs, tmp_path, monkeypatch, spark):
    import public_tokenizers

    monkeypatch.setattr(packing, "CHUNK", 64)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    packing.write_buckets(pieces, f"{tmp_path}/p")
    for r in spark.read.parquet(f"{tmp_path}/p").select("bucket", "length").distinct().collect():
        assert r["length"] == 1 << r["bucket"]
    assert spark.read.parquet(f"{tmp_path}/p").count() == pieces.count()


def test_decompose():
    assert packing.decompose(2048 * 2 + 1 + 64) == [(0, 2048), (2048, 2048), (4096, 64), (4160, 1)]
    assert packing.decompose(0) == []


# mixing


def test_mixing(docs, rows, spark):
    found = mixing.query(docs).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(split(text))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:  # reshare until none is above its cap
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and left * weight[s] / w > 3 * sizes[s]}
        if not new:
            break
        capped |= new
    target = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in order}
    source = {r[0]: r[3] for r in rows if r[0] != 7}
    for r in found:
        if r["doc_id"] in source:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert sorted(map(str, mixing.query(docs.repartition(3)).collect())) == sorted(map(str, found))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(split(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in found)
    assert mixing.query(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    named = docs.withColumns({"_copy": F.lit("c"), "size": F.lit(1), "rate": F.lit(2), "target": F.lit(3), "seed": F.lit("s"), "_row": F.lit("r")})
    assert mixing.mix(named).columns == named.columns and {(r["_copy"], r["rate"], r["_row"]) for r in mixing.mix(named).collect()} == {("c", 2, "r")}


def test_mixing_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken, target, sizes = collections.Counter(), {}, {}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in mixing.query(docs).collect():
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s], sizes[s] = r["target"], r["source_size"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


# simhash


def plain_fingerprint(text):
    w = split(text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(nodes))]


def test_simhash(docs, rows, spark):
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    ids = list(fps)
    root = plain_components(ids, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    least = {r: min((i for i, x in zip(ids, root, strict=True) if x == r and i is not None), default=None) for r in root}
    want = {i: (f"{fps[i]:016x}", least[r]) for i, r in zip(ids, root, strict=True)}
    found = simhash.query(docs).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(v[1] for v in {r: (0, least[r]) for r in root}.values())
    assert simhash.query(empty(spark)).count() == 0 and simhash.deduplicate(empty(spark)).count() == 0


def test_simhash_long_text_and_chunks():
    text = words("x", 3000)
    assert simhash.fingerprint(text, chunk=64) == simhash.fingerprint(text)
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("kind", ["spread", "dense", "chain"])
def test_simhash_links(spark, kind, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 50)
    r = random.Random(kind)
    base = [r.getrandbits(64) for _ in range(3 if kind == "dense" else 60)]
    fps = set(base)
    for _ in range(250):
        x = r.choice(sorted(fps) if kind == "chain" else base)
        for _ in range(r.randrange(1, 5)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    nodes = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    root = plain_components(nodes, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    least = {x: min(n for n, y in zip(nodes, root, strict=True) if y == x) for x in root}
    prints = spark.createDataFrame([(n, n) for n in nodes], "doc_id long, fp long")
    assert {(g["fp"], g["component_id"]) for g in simhash.groups(prints).collect()} == {(n, least[x]) for n, x in zip(nodes, root, strict=True)}


# suffix arrays


def brute(texts, span=400):
    starts = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if starts[t[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        yield len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("group", [16_384, 12])
def test_suffix_dedup(docs, rows, spark, group, monkeypatch):
    monkeypatch.setattr(suffixdedup, "GROUP", group)  # 12: anchors are split in pairs of chunks
    want = collections.Counter((r[0], *b) for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows]), strict=True))
    found = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.query(docs).collect())
    assert found == want
    assert any(0 < x[2] < x[1] for x in want)


def test_suffix_dedup_texts(docs, rows, spark):
    told = {r["doc_id"]: r for r in suffixdedup.query(docs).collect()}
    kept = suffixdedup.remove_repeats(docs).collect()
    assert {r["doc_id"] for r in kept} == {i for i, r in told.items() if r["n_removed"] < r["n_bytes"] or not r["n_bytes"]}
    for r in kept:
        if told[r["doc_id"]]["n_removed"] and (r["text"] or "").isascii():
            assert hashlib.sha256(r["text"].encode()).hexdigest() == told[r["doc_id"]]["kept_sha256"] and r["n_chars"] == len(r["text"])
    assert suffixdedup.query(empty(spark)).count() == 0 and suffixdedup.remove_repeats(empty(spark)).count() == 0


def test_repeat_far_apart_in_one_text(spark):
    r = random.Random(1)
    noise = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = noise(700)
    text = f"{noise(600_000)}A{passage}B{noise(700_000)}C{passage}D"  # several blocks lie between
    (found,) = suffixdedup.query(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (found["n_removed"], found["n_spans"]) == (1400, 2)


@pytest.mark.parametrize("group", [16_384, 12])
def test_both_spans_share_their_tables(docs, rows, spark, group, monkeypatch):
    """The shorter span is exact too, and the longer one is found in its groups: no table is indexed or stored a second time."""
    stored = []
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    monkeypatch.setattr(suffixdedup, "materialise", lambda df, real=suffixdedup.materialise: stored.append(df.columns) or real(df))
    want = collections.Counter((r[0], b[1]) for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows], suffixdedup.SHORT), strict=True))
    assert collections.Counter((r["doc_id"], r["n_removed_short"]) for r in suffixdedup.query(docs).collect()) == want
    assert len(stored) == 3


def test_strings_across_blocks_are_not_their_own_repeats(spark):
    """An anchor's strings that a block's end divides are two contexts of one place."""
    r = random.Random(2)
    unit = "".join(r.choices("abcdefgh ", k=300))
    texts = ["".join(r.choices("abcdefgh ", k=400_000)), f"{unit}{''.join(r.choices('abcdefgh ', k=500_000))}{unit}"]
    found = suffixdedup.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["n_removed_short"]) for r in found) == [(0, 0, 0), (1, 0, 600)]


def test_contexts_are_sent_in_bounded_batches():
    """A task's contexts don't grow with its texts."""
    texts = [words(f"bounded {i}", 9000).encode() for i in range(160)]
    hashes = [[] for _ in texts]
    for i, _, h, _, _ in suffixdedup.anchors(texts, 240):
        for of, gram in zip(i.tolist(), h.tolist(), strict=True):
            hashes[of].append(gram)
    batch = pa.record_batch([pa.array(range(160)), pa.array(range(160)), pa.array(texts), pa.array(hashes)], ["k1", "k2", "data", "hs"])
    sent = list(suffixdedup._contexts(iter([batch]), 240, 400))
    assert sum(b.num_rows for b in sent) >= sum(map(len, hashes))
    assert sum(b.nbytes for b in sent) > 20e6 > 1.5 * max(b.nbytes for b in sent)


def test_stored_levels(docs, rows, spark, tmp_path):
    """Batches compared with stored levels give what the whole table gives; levels merge; nulls, copies and empty batches."""
    family = suffixstore.StoredFamily(spark, str(tmp_path))
    cuts = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1"), empty(spark), docs.where("doc_id % 3 = 2 or doc_id is null")]
    for i, batch in enumerate(cuts):
        new = family.add(batch)
        assert i != 2 or new.count() == 0
    levels = family.state()[1]
    assert len(set(levels.values())) == len(levels) > 0
    want = collections.Counter((r[0], *b) for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows]), strict=True))
    found = family.told(docs)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()) == want


@pytest.mark.parametrize("seed", range(6))
def test_index_family(seed):
    r = random.Random(seed)
    pool = [bytes(r.choice(b"abcd ") for _ in range(r.randrange(80, 500))) for _ in range(5)]
    texts = [b"".join(bytes(r.choice(b"abcd ") for _ in range(r.randrange(200))) + r.choice(pool) for _ in range(r.randrange(1, 5))) for _ in range(12)]
    texts += [b"ti " * 200, b"\x00" * 500 + texts[0]]
    span = 100
    found = [(h, i, p, f, e) for part in suffixdedup.anchors(texts, span) for i, p, h, f, e in zip(*(x.tolist() for x in part), strict=True)]
    often = collections.Counter(x[0] for x in found)
    found = [x for x in found if often[x[0]] > 1]
    r.shuffle(found)
    before = [texts[i][f:p][::-1] for _, i, p, f, _ in found]
    after = [texts[i][p : e + span] for _, i, p, _, e in found]
    gone = [np.zeros(len(t), bool) for t in texts]
    for x, a, b in zip(*suffixdedup.scan_group(np.array([x[0] for x in found]), before, after, span, batch=8), strict=True):
        _, i, p, _, _ = found[x]
        gone[i][p - a : p - b + span] = True
    assert [int(g.sum()) for g in gone] == [b[1] for b in brute(texts, span)]


# language model


def test_language_model(docs, rows, spark):
    found = bloomlm.query(docs).collect()
    assert len(found) == len(rows)
    train = collections.Counter(t for r in rows if crc(r[0]) % 5 != 1 for t in [*split(r[1]), None])
    n, v = sum(train.values()), len(train)
    text = {r[0]: r[1] for r in rows}
    gain = 0
    for r in found:
        mine = [*split(text[r["doc_id"]]), None]
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in mine)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"]) % 5 == 1, len(mine), sum(t in train for t in mine), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] >= base - math.log10(len(bloomlm.WEIGHTS)) - 1e-9
        gain += r["score"] - base
    assert gain > 0
    assert bloomlm.query(empty(spark)).count() == 0


def test_words_beyond_the_broadcast(docs):
    model = bloomlm.train(docs.select("text"))
    a, b = (sorted(map(str, bloomlm.score_texts(docs, model, **more).collect())) for more in ({}, {"most_words": 10, "block": 5000}))
    assert a == b
    model = bloomlm.train(docs.select("text").limit(12))
    a, b = (sorted(map(str, bloomlm.score_texts(docs, model, **more).collect())) for more in ({}, {"most_filter": 8, "block": 9000}))
    assert a == b


def plain_score(text, words, pairs, n, v):
    """log10 of the mean, over the weights, of the text's probability; counts are quantised down to powers of two."""
    mine = [*split(text), None]
    sums = []
    for a in bloomlm.WEIGHTS:
        total = 0.0
        for h, w in zip([None, *mine], mine, strict=False):
            c = 2 ** int(math.log2(pairs[h, w])) if pairs[h, w] else 0
            follow = min(1.0, max(0.0, (c - bloomlm.DISCOUNT) / max(1, words[h])))
            total += math.log10((1 - a) * (words[w] + 0.5) / (n + 0.5 * (v + 1)) + a * follow)
        sums.append(total)
    top = max(sums)
    return top + math.log10(sum(10 ** (s - top) for s in sums) / len(sums))


def test_scores_equal_the_plain_model(docs, rows):
    train = [[*split(r[1]), None] for r in rows if crc(r[0]) % 5 != 1]
    words = collections.Counter(t for text in train for t in text)
    pairs = collections.Counter(p for text in train for p in zip([None, *text], text, strict=False))
    model = bloomlm.train(docs.where(~bloomlm.held_out(docs["doc_id"])).select("text"), bits_per_entry=600)  # false positives are as good as excluded
    text = {r[0]: r[1] for r in rows}
    for r in bloomlm.score_texts(docs, model).collect():
        assert r["score"] == pytest.approx(plain_score(text[r["doc_id"]], words, pairs, words.total(), len(words)), rel=1e-9)


def test_bigram_counts_from_the_filter():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(1 << 48, size=20_000, dtype=np.uint64))
    counts = np.minimum(r.zipf(1.6, len(keys)) + 1, 10_000).astype(np.uint64)
    half = keys >> np.uint64(47) == 0
    f = bloomlm.Filter([bloomlm.filter_of(keys[m], counts[m], 2, 12) for m in (half, ~half)], 2)
    got = f.counts(keys)
    exact = 2.0 ** np.floor(np.log2(counts.astype(float)))
    assert (got >= exact).all() and (got > exact).mean() < 0.02
    assert (f.counts(np.unique(r.integers(1 << 48, size=20_000, dtype=np.uint64))) > 0).mean() < 0.02


def test_model_is_a_distribution():
    import pyarrow as pa

    texts = pa.array([words(1, 300, 20), words(1, 300, 20), words(2, 100, 20)])
    hashes, codes, _ = bloomlm.tokens(texts)
    counts = np.bincount(codes, minlength=len(hashes))
    keys, often = np.unique(bloomlm.bigram_hashes(hashes, codes), return_counts=True)
    often, keys = often.astype(np.uint64), keys
    f = bloomlm.Filter([bloomlm.filter_of(keys[often > 1], often[often > 1], 2, 30)], 2)
    for h in range(0, len(hashes), 17):
        pair = bloomlm.mix(np.full(len(hashes), hashes[h]) * np.uint64(0x9E3779B97F4A7C15) + hashes) >> np.uint64(16)
        assert (f.counts(pair) / counts[h]).sum() <= 1 + 1e-9


def test_unseen_training(spark):
    only = spark.createDataFrame([(next(i for i in range(50) if crc(i) % 5 == 1), "a b")], "doc_id long, text string")
    r = bloomlm.query(only).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"]) == (0, 0, 3, 0.0)


# language ID


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.query(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in found)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(docs, spark):
    found = {r["doc_id"]: r["lang_pred"] for r in langid.query(docs).collect()}
    assert {i: found[i] for i in (400, 401, 402, 403)} == dict.fromkeys((400, 401, 402, 403), "und")
    assert found[404] == "de" and set(found.values()) == {"und", "en", "de"}
    assert langid.query(empty(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.query(unlabelled).first()["lang_pred"] == "und"


def plain_phrases(text, sample):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_cross_parsing(seed):
    r = random.Random(seed)
    samples = {x: bytes(r.choice(b"abc ") for _ in range(200)) for x in ("p", "q")}
    texts = [bytes(r.choice(b"abcd ") for _ in range(r.randrange(1, 90))) for _ in range(30)] + [samples["p"] * 3, b"", bytes(r.choice(b"abc ") for _ in range(4000))]
    m = langid.Model(samples, piece=(5, 16, 64, 1000)[seed])  # phrases go on over the ends of pieces
    h = m.entropies(texts)
    for t, row in zip(texts, h, strict=True):
        assert [round(x * max(1, len(t)) / b) for x, b in zip(row, m.bits, strict=True)] == [max(1, plain_phrases(t, samples[x])) for x in ("p", "q")]


def test_predictions_equal_the_plain_method():
    r = random.Random(5)
    samples = {lang: langid.normal(words(lang, 300, 40)) for lang in ("aa", "bb", "cc")}
    m = langid.Model(samples)
    texts = [words(r.choice(["aa", "bb", "cc"]), r.randrange(1, 200), 40) for _ in range(40)] + ["½ ² Ⅷ ① 12", "", None, "Q", "words " * 3000]
    langs, scores = m.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        if text is None or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0)
            continue
        b = langid.normal(text)
        h = sorted((max(1, plain_phrases(b, s)) * math.log2(len(s)) / max(1, len(b)), k) for k, s in samples.items())
        assert lang == h[0][1] and score == pytest.approx(1 - h[0][0] / h[1][0])


def test_sample_takes_whole_texts_within_its_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "Model", lambda samples, piece: samples)
    rows = [(f"{chr(97 + i) * 2} " * 10, "en") for i in range(20)] + [("longer " * 500, "de"), ("longest " * 900, "de")]
    sample = langid.learn(spark.createDataFrame(rows, "text string, lang string"), chars=200)
    found = sample["en"].decode().split()
    assert len(sample["en"]) <= 100 and found and all(found.count(w) == 10 for w in set(found))
    assert sample["de"].decode().split() == ["longer"] * 500  # where nothing shorter is there


def test_language_sample_counts_copies_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "Model", lambda samples, piece: samples)
    names = [chr(97 + i) * 3 for i in range(20)]
    rows = [(name, "en") for name in names for _ in range(50)]
    sample = langid.learn(spark.createDataFrame(rows, "text string, lang string"), docs_per_language=20)["en"]
    assert sorted(sample.decode().split()) == names
