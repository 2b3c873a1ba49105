"""Operators on pages and vectors against brute force, and their edge cases."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import embdedup, htmltext, urlfilter, vptree

PAGES = "page_id long, url string, html string, host string, text string"
VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int"


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


URLS = ["http://a.example.com/en/1", "https://WWW.Example.com/en/x?q#f", "http://x.www.example.com/en/", "http://example.com/en", "http://example.com", "ftp://b.net/es/1", "http://bnet/fr/", "http://net/fr/", "x.net/es/", None, "", "http://://com/", "a://b.com?x://net/es/", "HTTP://É.COM/", "http://q.com/\n/en/", "http://a.example.com/en/1", "http://.net/es/", "http://u@h.net:80/es/", "http://h.net/fr/#/"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "", "h", "t") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None, None)], PAGES)
    found = {r["page_id"]: tuple(r)[1:] for r in urlfilter.query(pages).collect()}
    assert found == {i: plain_verdict(u) for i, u in enumerate(URLS)} | {None: plain_verdict(URLS[0])}
    assert urlfilter.query(pages.limit(0)).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urlfilter.filter_urls(pages, none).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    rules = spark.createDataFrame([(f"h{i}.com", f"/p{i % 7}/", "block") for i in range(3000)], "host string, path string, verdict string")
    urls = spark.createDataFrame([(i, f"http://a.h{i}.com/p{i % 7}/x") for i in range(4000)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(urls, rules).collect()}
    assert got == {i: "block" if i < 3000 else "allow" for i in range(4000)}


def test_html_extraction(spark):
    long = " ".join(["word"] * 40)
    page = f'''<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A b c</a></li></ul></nav><!-- <p>{long}</p> -->
    <div class="cookie-notice">{long}</div><div class=ad>{long}</div>
    <article><h1>Title &amp;  more</h1><p><b>One<br>two&nbsp;<a href="x">three</a> &lt;p&gt;<p>{long}</p><p>Fin.</p>
    <form><label>{long}</label></form><div id="comments"><p>{long}</p></div></article>
    <aside><p>{long}</p></aside><footer>&copy; {long}</footer>'''
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "plain words"), (None, "u", page), (5, "u", "<p"), (6, "u", "<!-- x"), (7, "u", "<article><p>" + "x y " * 60_000)]
    pages = spark.createDataFrame([(*r, "h", "t") for r in rows], PAGES)
    found = {r["page_id"]: r for r in htmltext.query(pages).collect()}
    want = f"Title & more\nOne two three <p>\n{long}\nFin."
    assert found[1]["text"] == found[None]["text"] == want and found[1]["n_chars"] == len(want)
    assert {i: found[i]["text"] for i in (2, 3, 5, 6)} == {2: "", 3: "", 5: "", 6: ""}
    assert found[7]["n_chars"] == 240_000 - 1
    assert htmltext.query(pages.limit(0)).count() == 0


def test_html_whole_articles(spark):
    import html
    import re

    for r in htmltext.query(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def plain_html(page):
    """The page with names gone and tags that tell zones made plain containers."""
    import re

    page = re.sub(r"(<[a-z0-9]+)[^>]*?\s(?:class|id)=[^>]*>", r"\1>", page)
    return re.sub(r"(</?)(?:article|nav|header|footer|aside|main)\b", r"\1div", page)


def test_html_without_zones():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    told, plain = htmltext.extract(pages), htmltext.extract([plain_html(p) for p in pages])
    assert sum(a == b for a, b in zip(told, plain, strict=True)) >= 0.98 * len(pages)


def changed_pages():
    """Ways to write the same page: other markup for menus, no names, no tags that tell zones, wrappers whose names mean nothing."""
    import re

    names = lambda p: re.sub(r"(<[a-z0-9]+)[^>]*?\s(?:class|id)=[^>]*>", r"\1>", p)
    zones = lambda p: re.sub(r"(</?)(?:article|nav|header|footer|aside|main)\b", r"\1div", p)
    as_p = lambda p: re.sub(r"</?ul>", "", p.replace("<li>", "<p>").replace("</li>", "</p>"))
    as_a = lambda p: re.sub(r"</?(?:li|ul)>", "", p)
    wrap = lambda c: lambda p: p.replace("<body>", f'<body><div class="{c}">').replace("</body>", "</div></body>")
    return {"p": as_p, "a": as_a, "names": names, "zones": zones, "all": lambda p: as_p(zones(names(p))), "bare": lambda p: as_a(zones(names(p))), "layout": wrap("layout sidebar-left"), "form": wrap("main-content form")}


@pytest.mark.parametrize("change", changed_pages())
def test_html_written_in_other_ways(change):
    """The article as its markup tells it, by a plain reading, from pages that are written in other ways."""
    import html
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    want = []
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want.append("\n".join(b for b in blocks if b))
    got = htmltext.extract([changed_pages()[change](p) for p in pages])
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.98 * len(pages)


LONG = " ".join(["word"] * 40)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav><a>Home</a> <a>World News</a></nav><article><p>%s</p></article>", "%s"),
        ("<article><p>%s</p></article><footer><a>Privacy policy</a> <a>Terms of use</a></footer>", "%s"),
        ('<div class="ad"><a>Buy cheap shoes now</a></div><article><p>%s</p></article>', "%s"),
        ('<div class="breadcrumb"><a>Home</a> &gt; <a>Sea</a></div><article><p>%s</p></article>', "%s"),
        ('<div class="page sidebar-left"><p>%s</p><p>Short one.</p></div>', "%s\nShort one."),
        ('<div class="main-content form"><p>%s</p></div>', "%s"),
        ('<div><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></div><div>%s</div>', "%s"),
        ("<nav><a>Home</a><a>News</a></nav><div>%s</div>", "%s"),
        ("<form><div><p>%s</p></div></form>", "%s"),
        ("<article><p>%s</p><p><a>See the map</a></p><p>The end of it all is near.</p></article>", "%s\nSee the map\nThe end of it all is near."),
        ('<article><p>%s</p></article><div id="comments"><p>' + LONG * 3 + "</p></div>", "%s"),
    ],
)
def test_html_links_and_names(page, text):
    assert htmltext.extract([page % LONG]) == [text % LONG]


def test_link_density_counts_the_block_as_it_reads():
    _, x = htmltext.flat_blocks("<p><a>Home</a><a>News</a> or <a>two words</a></p>")
    assert x[0, 0] == 4 and x[0, 1] == 0.75


@pytest.mark.parametrize("opening", ['<article class="post has-comments">', '<main class="site-main sidebar-right">', '<div class="entry social-post">', '<article aria-label="search results">'])
def test_html_names_do_not_drop_an_article(opening):
    text = " ".join(["word"] * 40)
    close = "</" + opening[1:].split()[0] + ">"
    page = f"<nav><ul><li><a href='/'>Home</a></li></ul></nav>{opening}<h1>Some title here</h1><p>{text}</p><p>Short.</p>{close}<footer>&copy; x</footer>"
    assert htmltext.extract([page]) == [f"Some title here\n{text}\nShort."]


@pytest.mark.parametrize("part", ["<a ", "<a =\"", "<p><div>", "</ul><div>", "<!--", "<script ", "</script", "= ' ", "<![", "&amp"])
def test_html_long_pages_take_linear_time(part):
    import time

    begin = time.process_time()
    htmltext.extract([part * (1_000_000 // len(part)) + '"'])
    assert time.process_time() - begin < 20


def vectors(seed, n, d=16, copies=0):
    r = np.random.default_rng(seed)
    base = r.standard_normal((max(2, n // 5), d))
    x = base[r.integers(len(base), size=n)] + r.standard_normal((n, d)) * r.choice([0.05, 0.25, 1.0], (n, 1))
    x[: copies] = x[0]
    return (x / np.linalg.norm(x, axis=1)[:, None] * r.choice([1.0, 1.0, 2.5], (n, 1))).astype(np.float32)


BAD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [math.nan] * 16, 1), (9004, [None, *[1.0] * 15], 1), (9005, [math.inf] + [1.0] * 15, 1), (9007, [1.0, 2.0], 1), (9008, [1.0, 2.0], 1), (9009, [], 1)]


@pytest.fixture(scope="module")
def table(spark):
    x = vectors(4, 400, copies=30)
    rows = [(i, [float(c) for c in v], None if i % 11 == 0 else i % 3) for i, v in enumerate(x)]
    rows += [*BAD, (None, rows[1][1], 1), (3, rows[3][1], 0), (3, rows[3][1], 0)]
    return rows, spark.createDataFrame([(*r, 0.0, 1) for r in rows], VECTORS).repartition(4).cache()


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)


def test_embedding_dedup(table, monkeypatch):
    monkeypatch.setattr(embdedup, "TILE", 40)
    rows, df = table
    live = [i for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and usable(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in live}
    links, root = {i: 0 for i in live}, {i: i for i in live}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in live:
        for b in live:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i in live:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    want = sorted(((k, links.get(i, 0), least[find(i)] if i in root else k) for i, (k, _, _) in enumerate(rows)), key=str)
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embdedup.query(df).collect()), key=str)
    assert found == want
    assert embdedup.query(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    x = vectors(1, 300, 64).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, factors = embdedup.encode(x)
    signs = np.unpackbits(codes, axis=1, count=64) * 2.0 - 1
    estimate = signs @ (x @ embdedup.rotation(64)).T / 8 / factors[:, None]
    exact = x @ x.T
    assert abs((estimate - exact).mean()) < 0.01
    assert not ((exact >= 0.93) & ~embdedup.uncertain(codes, factors, x, 0.93)).any()
    assert embdedup.uncertain(codes, factors, x, 0.93)[exact < 0.3].mean() < 0.1


def plain_nearest(rows, k=20):
    for q, v, _ in rows:
        if q is not None and q % 20 == 0 and usable(v):
            pairs = [(-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w, _ in rows if i is not None and i != q and usable(w) and len(w) == len(v)]
            for rank, (s, i) in enumerate(sorted(pairs)[:k], 1):
                yield q, rank, i, -s


@pytest.mark.parametrize("shard", [16_384, 60])
def test_nearest_is_exact_at_factor_one(table, shard, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", shard)
    monkeypatch.setattr(vptree, "BLOCK", 7)
    monkeypatch.setattr(vptree, "LEAF", 16)
    rows, df = table
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).collect())
    want = sorted(plain_nearest(rows))
    assert [(a, b) for a, b, _, _ in found] == [(a, b) for a, b, _, _ in want]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in want], abs=1e-12)
    assert [x[2] for x in found] == [x[2] for x in want]
    assert vptree.nearest(df.limit(0), F.lit(True)).count() == 0


def test_recall_of_the_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], None) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in plain_nearest(rows)}
    found = {(r["query_id"], r["vec_id"]) for r in vptree.query(df).collect()}
    assert len(want & found) / len(want) >= 0.95


@pytest.mark.parametrize("factor", [0.2, 0.15])
def test_recall_of_relaxed_factors(factor):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.stack(table["embedding"].to_pylist()).astype(float), np.array(table["vec_id"].to_pylist())
    asked = np.nonzero(ids % 20 == 0)[0]
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    least = np.sort(score, 1)[:, -20]
    work = {}
    for f in (1.0, factor):
        tree, seen = vptree.Tree(ids, x, (x * x).sum(1).max(), leaf=16), []
        scan = tree._scan
        tree._scan = lambda members, rows, seen=seen, scan=scan: (seen.append((members.stop - members.start) * len(rows)), scan(members, rows))
        row, _, found = tree.search(x[asked], ids[asked], 20, f)
        assert (found >= least[row] - 1e-9).sum() >= (1.0 if f == 1.0 else 0.9) * 20 * len(asked)
        work[f] = sum(seen)
    assert work[factor] < work[1.0]


def search_all(vectors, shard, monkeypatch, spark):
    monkeypatch.setattr(vptree, "SHARD", shard)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in vectors], "vec_id long, embedding array<float>").repartition(3)
    return df, sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vptree.query(df).collect())


@pytest.mark.parametrize("shard", [8192, 100])
def test_ties_go_to_the_smaller_id_whatever_their_number(spark, shard, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(int(i), [1.0, *np.eye(40)[int(i) % 40], float(i // 40)]) for i in r.permutation(400) + 1]  # all have product 1 with the query
    rows.append((0, [1.0] + [0.0] * 41))
    _, found = search_all(rows, shard, monkeypatch, spark)
    assert [x[2] for x in found if x[0] == 0] == list(range(1, 21))


@pytest.mark.parametrize("shard", [8192, 60])
def test_copies_and_one_huge_norm(spark, shard, monkeypatch):
    x = vectors(9, 300, copies=120).astype(float)
    x[250] *= 1e6
    rows = list(enumerate(x)) + [(20, x[20]), (20, x[200]), *[(5, x[0])] * 3]
    _, found = search_all(rows, shard, monkeypatch, spark)
    rows = [(i, np.asarray(v, np.float32).tolist(), None) for i, v in rows]
    twice = [r for r in plain_nearest(rows) if r[0] != 20]
    assert [f for f in found if f[0] != 20] == sorted((q, n, i) for q, n, i, _ in twice)
    assert sum(f[0] == 20 for f in found) == 40  # one id with two vectors: two queries; the repeated row is none


def test_tree_prunes():
    x = vectors(3, 3000, 4).astype(float)
    tree = vptree.Tree(np.arange(3000), x, (x * x).sum(1).max(), leaf=16)
    tree = vptree.Tree.load(tree.dump())
    seen = []
    scan = tree._scan
    tree._scan = lambda members, rows: (seen.append((members.stop - members.start) * len(rows)), scan(members, rows))
    row, found, _ = tree.search(x[:50], np.full(50, -1), 5)
    assert sum(seen) < 0.6 * 50 * 3000
    exact = np.sort(x[:50] @ x.T, 1)[:, -5:]
    assert np.allclose(np.sort((x[found] * x[row]).sum(1).reshape(50, 5), 1), exact)
    fewer = []
    tree._scan = lambda members, rows: (fewer.append((members.stop - members.start) * len(rows)), scan(members, rows))
    tree.search(x[:50], np.full(50, -1), 5, 0.5)
    assert sum(fewer) < sum(seen)
