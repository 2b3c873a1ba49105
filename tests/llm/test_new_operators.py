"""Spelling variants, centroid clustering and tree BPE against brute force, and their edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import chain

import pytest

from quern.llm import laesa, spelling, treebpe

DOCS = "doc_id long, text string, word string, n long, ids string, seg string"

# spelling variants


def plain_words(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    form, out = {}, {}
    for w, n in words.items():
        near = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and plain_near(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near))
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, k, words[form[w]] if form[w] else None) for w, (n, k) in out.items()}


def spelled(spark, rows):
    docs = spark.createDataFrame([(i, t, "w", 1, "x", "y") for i, t in rows], DOCS)
    got = spelling.query(docs).collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


@pytest.mark.parametrize("cell, leaf", [(spelling.CELL, spelling.LEAF), (64, 4)])
def test_spelling_against_brute_force(spark, monkeypatch, cell, leaf):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    if cell == 64:
        monkeypatch.setattr(spelling, "SAMPLE", 40)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé×÷ÀZ") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    rows = []
    for i in range(300):
        text = []
        for _ in range(60):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "bé", "q"]) + w[k + rng.randint(0, 1) :]
            text.append(w)
        rows.append((rng.choice([None, i]), rng.choice(" ,\n1").join(text)))
    want = plain_variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] and v[0] != v[1] for v in want.values())
    assert spelled(spark, rows) == want


def test_spelling_edges(spark, monkeypatch):
    assert spelled(spark, []) == {} and spelled(spark, [(1, None), (2, ""), (None, " \n1")]) == {}
    rows = [(i, "lamppost " * 2 + "lamp-post Lämppost lämppost LÄMPPOST") for i in range(6)] * 2 + [(7, "aaaaa " * 3 + "aaaab " * 3 + "aaaac " * 8 + "baaac " * 40)]
    assert spelled(spark, rows) == plain_variants(rows)
    monkeypatch.setattr(spelling, "PIECE", 50)  # pieces end between runs
    long = [(1, "x" * 500 + " " + "hello, " * 400 + "hallo " * 90 + "y" * 70), (2, "x" * 500 + " z"), (3, "x" * 500), (4, "x" * 499)]
    assert spelled(spark, long) == plain_variants(long)


def test_spelling_shares(spark, monkeypatch):
    """Words whose letter counts are all the same can't be split; shares keep tasks small."""
    import itertools

    monkeypatch.setattr(spelling, "CELL", 20)
    rows = [(1, " ".join(("ab" + "".join(p) + "yz") for p in itertools.permutations("cdefg")) + " " + "abcdefxyz " * 9)] * 3
    assert spelled(spark, rows) == plain_variants(rows)


# centroid clustering


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        to = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, to) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    to = assign()
    own = Counter()
    for d, j in to:
        own[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for (i, _), (d, j) in zip(kept, to)), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, cluster int, pivot string, distance double"


def clustered(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, "p", 0.5) for i, v in rows], VECTORS)
    return sorted((tuple(r) for r in laesa.query(df).collect()), key=str)


def test_clusters_against_brute_force(spark):
    rng = random.Random(5)
    bad = [None, [], [1.0] * 63, [1.0] * 65, [math.nan] * 64, [math.inf] + [0.0] * 63, [None] + [0.0] * 63]
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(64)]) for i in range(180)]
    rows += [(i, [float(rng.randint(0, 1)) / 64] + [0.0] * 63) for i in range(1000, 1060)]  # many ties
    rows += [(2000 + i, v) for i, v in enumerate(bad)] + rows[:7] + [(None, [0.5] * 64), (None, [-0.25] * 64), (3, [0.125] * 64), (9, [1e5, -1e5] * 32)]
    assert clustered(spark, rows) == plain_clusters(rows)


def test_cluster_edges(spark):
    assert clustered(spark, []) == [] and clustered(spark, [(1, None), (2, [1.0])]) == []
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clustered(spark, few) == plain_clusters(few)
    same = [(i, [0.3] * 64) for i in range(40)]
    assert clustered(spark, same) == plain_clusters(same)
    with pytest.raises(Exception, match="too large"):
        clustered(spark, [(1, [1e30] * 64)])


def test_bounds_leave_out_centroids(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    c = rng.integers(-640, 640, (16, 64))
    x = c[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 64))
    which, square, asked = laesa.nearest(x, laesa.distances(x, c), c, laesa.distances(c, c))
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (which == every.argmin(1)).all() and (square == every.min(1)).all() and asked < 2 * len(x)


# byte-level BPE


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = treebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed(rng, n):
    some = ["the ", "don't", "we'll", "'re", "'r", "'", "''s", " ", "  ", "\n\n", "\t \n", " ", "　", "a", "aaaa", "über", "日本語のテキスト", "ชื่อ", "🙂👩‍👩‍👧", "123 4567", " 12", "!!!", "...", "<|endoftext|>", "é", "\x00\x1c\x85", "Ǆ", "ß", "ﬁ", "\U00010348", " ?"]
    return "".join(rng.choice(some) for _ in range(n))


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64, 4096])
def test_joins_are_exact(leaf, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(treebpe, "LEAF", leaf)
    monkeypatch.setattr(treebpe, "WORD", max(1, min(leaf, 16)))
    plain, rng = tiktoken_encoding(), random.Random(leaf)
    tree = treebpe.Encoder(treebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = ["", "a", " ", "\n" * 50, " " * 40 + "x", "a" * 333, "ab" * 200, "=" * 129, "日" * 99, "'" * 31 + "re"] + [mixed(rng, rng.randint(1, 120)) for _ in range(120)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(500))]
    for text in texts:
        words, ids = tree.part(text)
        assert "".join(words) == text and list(chain.from_iterable(ids)) == plain.encode_ordinary(text), text


def test_words_of_the_vocabulary_and_their_classes():
    """All words of the file are tokens of their own; all code points split as in the library."""
    import public_tokenizers

    plain = tiktoken_encoding()
    tree = treebpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(tree.merges.whole(b) == [i] for b, i in tree.merges.ranks.items())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for between in ("", "a", "1", " ", "!"):
        for at in range(0, len(every), 400):  # the library takes the square of a word's length
            text = between.join(every[at : at + 400])
            assert list(chain.from_iterable(tree.part(text)[1])) == plain.encode_ordinary(text)


def test_tree_bpe_query(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(treebpe, "SEGMENT", 50)
    monkeypatch.setattr(treebpe, "FAN", 3)
    monkeypatch.setattr(treebpe, "LEAF", 16)
    plain, rng = tiktoken_encoding(), random.Random(8)
    texts = [None, "", "x", " " * 60 + "y", "a" * 2000, "don't" * 40, "'" * 49 + "'re" * 9] + [mixed(rng, rng.randint(1, 400)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, "null id")]
    docs = spark.createDataFrame([(i, t, "w", 1, "x", "y") for i, t in rows], DOCS)
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hexed(",".join(map(str, ids)).encode()), hexed((t or "").encode())))
    assert sorted((tuple(r) for r in treebpe.query(docs).collect()), key=str) == sorted(want, key=str)
    assert treebpe.query(docs.limit(0)).count() == 0
    told = treebpe.decode(treebpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in told.collect()) == sorted((t or "").encode() for _, t in rows)


def test_ranks_file_round_trip(tmp_path):
    path = tmp_path / "x.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)) + b"\n")
    assert treebpe.read_ranks(str(path)) == {bytes([i]): i for i in range(256)}
