"""Similarity of strings: the indel ratio, its partial form, and matching against vocabularies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlark.functions.text import match_form
from medlark.operators.merge import best


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return bin(~s & full).count("1")


def ratio_of(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_of(a: str | None, b: str | None) -> float | None:
    """The best ratio of the shorter text to a window of its length in the longer, windows cut at the edges too."""
    if a is None or b is None:
        return None
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(ratio_of(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def partials_of(word: str, texts: list[str], cells: int = 1 << 18) -> np.ndarray:
    """partial_of(word, text) for each of the texts: the bit vectors of all windows of a block of texts move together.
    A place beyond a text has no letter, which leaves a vector as it is, so windows cut at the edges need no extra care."""
    n, out = len(word), np.empty(len(texts))
    if not 0 < n <= 64:
        return np.array([partial_of(word, t) for t in texts], dtype="float64")
    kind = np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64
    full = kind((1 << n) - 1)
    places = np.zeros(max(map(ord, word)) + 2, dtype=kind)  # the last is that of every other character
    for i, c in enumerate(word):
        places[ord(c)] |= kind(1 << i)
    todo = []
    for i, t in enumerate(texts):
        if len(t) < n:
            out[i] = partial_of(word, t)  # here the text is what is moved along the word
        else:
            todo.append(i)
    todo.sort(key=lambda i: len(texts[i]))
    at = 0
    while at < len(todo):
        to = at + 1
        while to < len(todo) and (to + 1 - at) * (len(texts[todo[to]]) + 2 * n) <= cells:
            to += 1
        block, size = [texts[i] for i in todo[at:to]], np.array([[len(texts[i])] for i in todo[at:to]])
        width = int(size.max())
        codes = np.frombuffer("".join(t.ljust(width) for t in block).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(block), width)
        masks = np.zeros((len(block), width + 2 * n - 2), dtype=kind)
        masks[:, n - 1 : n - 1 + width] = places[np.minimum(codes, len(places) - 1)] * (np.arange(width) < size).astype(kind)
        windows = width + n - 1
        s = np.full((len(block), windows), full)
        for j in range(n):
            u = s & masks[:, j : j + windows]
            s = (s + u) | (s - u)
        start = np.arange(windows) - (n - 1)
        length = np.maximum(np.minimum(start + n, size) - np.maximum(start, 0), 0)
        out[todo[at:to]] = (200.0 * np.bitwise_count(~s & full) / (n + length)).max(axis=1)
        at = to
    return out


def _scored(measure, a: Column | str, b: Column | str) -> Column:
    # made at the call: a worker that imports this module has no session
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([measure(v, w) for v, w in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def ratio(a: Column | str, b: Column | str) -> Column:
    return _scored(ratio_of, a, b)


def partial_ratio(a: Column | str, b: Column | str) -> Column:
    return _scored(partial_of, a, b)


def fuzzy_word(text: Column, word: Column, least: float = 80.0) -> Column:
    """Whether a word of 4 to 12 letters comes close to some word of the text."""

    @F.pandas_udf("boolean")
    def near(t: pd.Series, w: pd.Series) -> pd.Series:
        hit = lambda x, y: x is not None and y is not None and 4 <= len(y) <= 12 and any(4 <= len(p) <= 12 and ratio_of(p, y) >= least for p in x.split())
        return pd.Series([hit(x, y) for x, y in zip(t, w)])

    return near(text, word)


def match_vocabulary(spans: DataFrame, vocabulary: DataFrame, least: float = 70.0) -> DataFrame:
    """spans(id, field, span), vocabulary(field, value) -> id, field, span, value, confidence, tier.

    Equal but for case and accents: 1.0; equal in match form: 0.95; closest with a ratio of at least `least`: the
    ratio; otherwise the span itself where the vocabulary has `autre`: 0.6; otherwise NA: 0."""
    v = vocabulary.select(F.col("field").alias("_f"), F.col("value").alias("_v"))
    pairs = spans.join(F.broadcast(v), F.col("field") == F.col("_f"), "left")
    folded = lambda c: F.lower(F.trim(c))
    exact, form = folded(F.col("span")) == folded(F.col("_v")), match_form(F.col("span")) == match_form(F.col("_v"))
    score = F.when(exact, 1.0).when(form, 0.95).otherwise(F.coalesce(ratio(match_form(F.col("span")), match_form(F.col("_v"))) / 100, F.lit(0.0)))
    top = best(pairs.withColumn("_s", score).withColumn("_open", F.max((F.col("_v") == "autre").cast("int")).over(_by_id())), ["id"], F.col("_s").desc(), F.col("_v"))
    blank = F.coalesce(F.trim("span"), F.lit("")) == ""
    hit = F.col("_s") * 100 >= least
    return top.select(
        "id", "field", "span", F.when(blank, "NA").when(hit, F.col("_v")).when(F.col("_open") == 1, F.col("span")).otherwise("NA").alias("value"),
        F.when(blank, 0.0).when(hit, F.col("_s")).when(F.col("_open") == 1, 0.6).otherwise(0.0).alias("confidence"),
        F.when(blank, "none").when(F.col("_s") == 1, "exact").when(F.col("_s") == 0.95, "form").when(hit, "fuzzy").when(F.col("_open") == 1, "other").otherwise("none").alias("tier"),
    )


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("id")


def resolve_span(rows: DataFrame, least: float = 85.0) -> DataFrame:
    """rows(id, text, span) -> id, start, end, method: exact, then whatever case, then whatever white space, then the
    closest window of the span's length; -1 and `unresolved` otherwise."""
    space = F.regexp_replace(F.trim("span"), r"([\\.*+?^${}()|\[\]])", r"\\$1")
    pattern = F.concat(F.lit("(?is)"), F.regexp_replace(space, r"\s+", r"\\s+"))
    exact, lower = F.instr("text", F.col("span")), F.instr(F.lower("text"), F.lower("span"))
    loose = F.regexp_instr("text", pattern)

    @F.pandas_udf("struct<at:int,size:int>")
    def nearest(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(t, s):
            top = (0.0, -1, 0)
            for size in {len(y), int(len(y) * 0.9), int(len(y) * 1.1)} if x and y else ():
                for i in range(0, max(1, len(x) - size + 1)):
                    top = max(top, (ratio_of(x[i : i + size].lower(), y.lower()), -i, size))
            out.append((-top[1], top[2]) if top[0] >= least else (-1, 0))
        return pd.DataFrame(out, columns=["at", "size"])

    rows = rows.withColumn("_e", exact).withColumn("_l", lower).withColumn("_w", loose)
    rows = rows.withColumn("_n", F.when((F.col("_e") == 0) & (F.col("_l") == 0) & (F.col("_w") == 0), nearest("text", "span")))
    start = F.when(F.col("_e") > 0, F.col("_e") - 1).when(F.col("_l") > 0, F.col("_l") - 1).when(F.col("_w") > 0, F.col("_w") - 1).otherwise(F.col("_n.at"))
    size = F.when((F.col("_e") > 0) | (F.col("_l") > 0), F.length("span")).when(F.col("_w") > 0, F.length(F.regexp_substr("text", pattern))).otherwise(F.col("_n.size"))
    method = F.when(F.col("_e") > 0, "exact").when(F.col("_l") > 0, "case").when(F.col("_w") > 0, "space").when(F.col("_n.at") >= 0, "fuzzy").otherwise("unresolved")
    return rows.select("id", start.alias("start"), F.when(start >= 0, start + size).otherwise(-1).alias("end"), method.alias("method"))
