"""Two texts against each other: rare n-grams as anchors, rising chains, common subsequences and near words."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

GRAM = 7


def grams(texts: DataFrame, key: str, n: int = GRAM, text: str = "text", hashed: bool = False) -> DataFrame:
    """key, pos and gram for each run of n tokens of each text; hashed: gram is a 64-bit hash of the tokens."""
    at = texts.select(key, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("w")).where(F.size("w") >= n)
    each = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(F.slice("w", i + 1, n)) if hashed else F.array_join(F.slice("w", i + 1, n), " "))
    return at.select(key, F.posexplode(each).alias("pos", "gram"))


def lone(made: DataFrame) -> DataFrame:
    """Grams that stand once in all texts of a side, by the 64-bit hash that stands for them."""
    return made.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in made.columns if c != "gram"]).where("_n = 1").drop("_n")


def anchors(a: DataFrame, b: DataFrame, a_key: str, b_key: str, n: int = GRAM) -> DataFrame:
    """Places of the grams that stand once on either side: a_key, a_pos, b_key, b_pos.

    Grams are exchanged and told apart by 64-bit hashes, as numbers of fixed
    width: two different ones of 10^8 share one with a chance of 3 in 10^4.
    Null texts and texts of fewer words have none; of equal texts none is lone.
    """
    x = lone(grams(a, a_key, n, hashed=True)).select("gram", a_key, F.col("pos").alias("a_pos"))
    y = lone(grams(b, b_key, n, hashed=True)).select("gram", b_key, F.col("pos").alias("b_pos"))
    return x.join(y, "gram").drop("gram")


def rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly rising subsequence, by patience sorting."""
    tails, ends, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def first_rising(values: list[int]) -> list[int]:
    """Indexes of the longest strictly rising subsequence that ends first and, at each step back, comes from the first of the longest."""
    length, back = [1] * len(values), [-1] * len(values)
    for i, v in enumerate(values):
        for j in range(i):
            if values[j] < v and length[j] + 1 > length[i]:
                length[i], back[i] = length[j] + 1, j
    if not values:
        return []
    i, out = length.index(max(length)), []
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; of ways back, up (in a) before left."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(a: list[str], b: list[str], n: int = GRAM, most_cells: int = 4_000_000, share: float = 0.25, least: int = 20) -> list[int]:
    """For each word of a, its place in b or -1.

    Grams that stand once on either side anchor; the longest rising chain of
    them stands. Each gap between anchors takes its equal beginning and end, and
    what is left a common subsequence if it fits most_cells. In gaps of over
    ``least`` words, words paired one at a time stand only if they are ``share``
    of the shorter side or have a paired neighbour.
    """

    def once(w: list[str]) -> dict[tuple, int]:
        seen: dict[tuple, int] = {}
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            seen[g] = -1 if g in seen else i
        return {g: i for g, i in seen.items() if i >= 0}

    x, y = once(a), once(b)
    pairs = sorted((i, y[g]) for g, i in x.items() if g in y)
    pairs = [pairs[k] for k in rising([j for _, j in pairs])]
    out = [-1] * len(a)
    for i, j in pairs:
        for k in range(n):
            if out[i + k] < 0:
                out[i + k] = j + k
    i = 0
    while i < len(a):
        if out[i] >= 0:
            i += 1
            continue
        e = i
        while e < len(a) and out[e] < 0:
            e += 1
        _gap(a, b, i, e, out[i - 1] + 1 if i else 0, out[e] if e < len(a) else len(b), out, most_cells, share, least)
        i = e
    return out


def _gap(a, b, i, e, j, f, out, most_cells, share, least) -> None:
    while i < e and j < f and a[i] == b[j]:
        out[i] = j
        i, j = i + 1, j + 1
    while i < e and j < f and a[e - 1] == b[f - 1]:
        e, f = e - 1, f - 1
        out[e] = f
    if i >= e or j >= f or (e - i) * (f - j) > most_cells:
        return
    found = common(a[i:e], b[j:f])
    dense = min(e - i, f - j) <= least or len(found) >= share * min(e - i, f - j)
    have = set(found)
    for p, q in found:
        if dense or (p - 1, q - 1) in have or (p + 1, q + 1) in have:
            out[i + p] = j + q


def chained(found: DataFrame, pair: list[str]) -> DataFrame:
    """The anchors of each pair of texts that lie on its longest rising chain; a fold over the pair's anchors."""
    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in pair)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a_pos")
        return pdf.iloc[rising(pdf["b_pos"].tolist())][[*pair, "a_pos", "b_pos"]]

    return found.select(*pair, "a_pos", "b_pos").groupBy(*pair).applyInPandas(fold, f"{kinds}, a_pos int, b_pos int")


def near_words(a: DataFrame, b: DataFrame, a_word: str = "word", b_word: str = "word", block: int = 3) -> DataFrame:
    """For words of a, the one nearest word of b that begins alike (block letters) within an eighth of the length in edits; none if two are as near."""
    x = a.select(F.col(a_word).alias("a")).distinct().withColumn("k", F.substring("a", 1, block)).withColumn("cap", F.floor(F.length("a") / 8).cast("int")).where("cap >= 1")
    y = b.select(F.col(b_word).alias("b")).distinct().withColumn("k", F.substring("b", 1, block))
    at = x.join(y, "k").where(F.abs(F.length("a") - F.length("b")) <= F.col("cap")).withColumn("d", F.levenshtein("a", "b")).where("d <= cap")
    best = at.groupBy("a").agg(F.min("d").alias("d"))
    tied = at.join(best, ["a", "d"]).groupBy("a", "d").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    return tied.where("n = 1").select("a", "b", F.col("d").cast("long").alias("d"))
