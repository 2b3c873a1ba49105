"""Text expressions, and a fuzzy scorer as an Arrow-based function."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TOKEN = r"[\p{L}\p{N}_\p{M}]+"
#: White space of any script: Unicode's, and the four separators among the control characters.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Vietnamese letters with marks, lower case; upper case follows from them.
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
BOTH = MARKED + MARKED.upper()
PLAIN = "".join("dD"[c == "Đ"] if c in "đĐ" else unicodedata.normalize("NFD", c)[0] for c in BOTH)


def normalize(text: Column, lower: bool = True) -> Column:
    """White space to single spaces, trimmed; lower case if asked."""
    out = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.lower(out) if lower else out


def match_form(text: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\p{M}\s]", " "), SPACE, " "))


def fold(text: Column) -> Column:
    """Without the marks of MARKED letters; đ becomes d."""
    return F.translate(text, BOTH, PLAIN)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def ngrams(tokens: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams_of(text: Column, n: int) -> Column:
    """The distinct grams of n characters of a text without spaces, lower case; the whole if it is shorter, none if empty."""
    t = F.lower(F.regexp_replace(text, SPACE, ""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
    return F.when(F.length(t) > 0, F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def quality(text: Column) -> Column:
    """+1.5 a marked letter, +2 a token, +0.05 a character, -2 an odd character, -0.5 a character over 8 in a token."""
    raw, form = F.trim(text), match_form(text)
    words = F.filter(F.split(form, " "), lambda w: w != "")
    marked = F.length(F.regexp_replace(raw, f"[^{MARKED}{MARKED.upper()}]", ""))
    odd = F.length(F.regexp_replace(raw, r"[\p{L}\p{N}_\p{M}\s.,!?;:'\"()\-]", ""))
    over = F.aggregate(words, F.lit(0), lambda s, w: s + F.greatest(F.length(w) - 8, F.lit(0)))
    return marked * 1.5 + F.size(words) * 2.0 + F.length(form) * 0.05 - odd * 2.0 - over * 0.5


def quality_score(text: str) -> float:
    """quality() of one text, for folds: the same words, marks and odd characters."""
    raw, form = text.strip(), " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())
    words = form.split()
    marked = sum(c in MARKED or c in MARKED.upper() for c in raw)
    odd = sum(not (c.isalnum() or c.isspace() or c == "_" or unicodedata.category(c)[0] == "M" or c in ".,!?;:'\"()-") for c in raw)
    return 1.5 * marked + 2.0 * len(words) + 0.05 * len(form) - 2.0 * odd - 0.5 * sum(max(0, len(w) - 8) for w in words)


def timecode(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS.mmm (rounded) or HH:MM:SS,mmm (cut)."""
    ms = (F.round(seconds * 1000) if mark == "." else F.floor(seconds * 1000)).cast("long")
    part = lambda size, of: F.lpad((F.floor(ms / size) % of).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def safe_id(value: Column) -> Column:
    """Characters but letters, digits, - and _ become _; ends are stripped of _; empty becomes empty_id."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(value, r"[^a-zA-Z0-9_-]", "_"), F.lit("_")), F.lit("")), F.lit("empty_id"))


def preview(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("…")))


def strip_marks(text: Column) -> Column:
    """Without combining marks of any script; đ becomes d. The marks of MARKED letters go by fold(), all others once they stand alone."""
    return F.regexp_replace(fold(text), r"\p{Mn}", "")


def clean_translation(text: Column) -> Column:
    """A model's translation without a fence around it and labels at its start, in single spaces."""
    plain = F.trim(F.regexp_replace(text, SPACE, " "))
    plain = F.regexp_replace(F.regexp_replace(plain, r"^```(?:text)?", ""), r"```$", "")
    for label in ("Output", "Translation"):
        plain = F.regexp_replace(F.trim(plain), rf"(?i)^{label}\s*:\s*", "")
    return F.trim(plain)


def subtitle_block(items: Column) -> Column:
    """items: array of (start, end, text), seconds -> JSON for a prompt: [{"relative_time": "0.000s - 1.500s", "text": ...}, ...]."""
    second = lambda c: F.format_string("%.3fs", c.cast("double"))
    rows = F.transform(items, lambda i: F.struct(F.concat(second(i["start"]), F.lit(" - "), second(i["end"])).alias("relative_time"), i["text"].alias("text")))
    return F.coalesce(F.to_json(rows), F.lit("[]"))


def json_payload(text: Column) -> Column:
    """The outermost braces of a model's answer, without fences and thoughts."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)^.*</think>", ""), r"```(json)?", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def best_ratio(a: str, others: list[str], at_least: float = 0.0) -> float:
    """The best ratio of a with any of the others: those that could be best by their letters alone come first, and the rest are left out once none can."""
    own = Counter(a)
    bounds = sorted(((2 * sum(min(n, own[c]) for c, n in Counter(o).items()) / (len(a) + len(o)), o) for o in others), reverse=True) if a else []
    best = at_least
    for bound, o in bounds:
        if bound <= best:
            break
        best = max(best, ratio(a, o))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer, windows at the ends included.

    No window shares more than the letters that both have, which sliding counts tell for all windows at once; windows are
    compared from the highest such bound down, until none can be better.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    n, m = len(a), len(b)
    begin, end = np.maximum(0, np.arange(1 - n, m)), np.minimum(m, np.arange(1, m + n))
    points = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    shared = np.zeros(len(begin), np.int64)
    for c, count in Counter(a).items():
        seen = np.concatenate([[0], np.cumsum(points == ord(c))])
        shared += np.minimum(seen[end] - seen[begin], count)
    bound = 2 * shared / (n + end - begin)
    best = 0.0
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] <= best:
            break
        best = max(best, ratio(a, b[begin[i] : end[i]]))
    return best


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, ra, rb = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not ra or not rb):
        return 1.0
    la, lb = f"{both} {ra}".strip(), f"{both} {rb}".strip()
    found = [ratio(la, lb)]
    if both:
        found += [ratio(both, la), ratio(both, lb)]
    return max(found)


def fuzzy_score(query: str, document: str) -> float:
    """1 if the document holds the query; else the mean of three ratios: without spaces, best n-gram, token set."""
    q, d = " ".join((query or "").lower().split()), " ".join((document or "").lower().split())
    if not q or not d:
        return 0.0
    if q in d:
        return 1.0
    qs, ds = q.replace(" ", ""), d.replace(" ", "")
    whole = ratio(qs, ds) if len(qs) >= len(ds) else partial_ratio(qs, ds)
    words, n = d.split(), len(q.split())
    grams = {" ".join(words[i : i + k]) for k in (n - 1, n) if k > 0 for i in range(len(words) - k + 1)}
    return (whole + best_ratio(q, list(grams)) + token_set_ratio(q, d)) / 3


@F.pandas_udf(DoubleType())
def fuzzy(query: pd.Series, document: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_score(q, d) for q, d in zip(query, document, strict=True)], dtype="float64")


def similarity(a: str, b: str) -> float:
    """Larger of the ratios of the match forms with and without marks."""

    def form(t: str) -> str:
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in unicodedata.normalize("NFC", t.lower())).split())

    def plain(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", t.replace("đ", "d")) if unicodedata.category(c) != "Mn")

    x, y = form(a), form(b)
    return max(ratio(x, y), ratio(plain(x), plain(y)))
