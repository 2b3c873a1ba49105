"""URL filter: a blocked Bloom filter of listed keys, then an exact hash join.

Everything is a DataFrame operation. A key is a rule's host followed by its
path. The keys that could match a url are its host's suffixes, each followed
by the path's prefixes of the lengths that rules have. Keys whose bits are
all set in their block of the filter go on to the exact join, which removes
the false positives; the longest rule that is left decides.

Defined results: a url that is null or has no `://` has empty host and path
and fits no rule; what fits no rule gets `default`; ties go to the longer
host; repeated urls are judged once and all get the result; of a rule given
twice with two verdicts, block counts; no rules: all get `default`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lower_ascii, small

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LANES = 4  # longs of 64 bits in a block; a key sets one bit in each
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _lane(key: str, lane: int) -> Column:
    """The one bit that a key has in a lane."""
    return F.expr(f"shiftleft(1L, cast(shiftright(xxhash64('bits', {key}), {6 * lane}) & 63 AS INT))")


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """keys (key) -> the filter's blocks that have bits: block, b0, b1, ..."""
    rows = keys.select(_block("key", blocks).alias("block"), *(_lane("key", i).alias(f"b{i}") for i in range(LANES)))
    return rows.groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(LANES)))


def judge(urls: DataFrame, rules: DataFrame, bits_per_key: int = 16) -> DataFrame:
    """urls (host, path), distinct; rules (host, path, verdict) -> host, path, rule, verdict of the urls that fit a rule."""
    listed = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("verdict"))
    listed = listed.withColumn("key", F.concat("rule_host", "rule_path"))
    lengths = sorted(r[0] for r in listed.select(F.length("rule_path")).distinct().collect())  # as many as the longest path is long, at most
    blocks = 1
    while blocks * 64 * LANES < bits_per_key * listed.count():
        blocks *= 2
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 1000000), '.'))")
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    keys = (
        urls.where("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", F.explode(F.transform("prefixes", lambda p: F.concat("suffix", p))).alias("key"))
    )
    keys = keys.withColumn("block", _block("key", blocks))
    hit = [f"b{i}" for i in range(LANES)]
    maybe = keys.join(small(bloom(listed, blocks)), "block")
    for i, b in enumerate(hit):
        maybe = maybe.where(F.col(b).bitwiseAND(_lane("key", i)) != 0)
    found = maybe.select("host", "path", "key").join(small(listed), "key")
    best = F.max(F.struct(F.length("key").alias("n"), F.length("rule_host").alias("nh"), F.col("key"), F.col("verdict"))).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each page: the columns in `keep`, host, path, rule, verdict."""
    parts = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judge(parts.select("host", "path").distinct(), rules)
    judged = judged.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "rule", "verdict")
    out = parts.join(judged, (parts["host"] == judged["_h"]) & (parts["path"] == judged["_p"]), "left")
    return out.select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(pages, rules)


SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT n, rh || rp AS rule, rv, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""
