"""Lines of pages: positions, indents, repeated furniture, spacing and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

#: A masked edge line is furniture when it stands on so many pages.
REPEATED = 3
EDGE = 3


def explode(pages: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_no (from 0) and line of each page."""
    return pages.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each group; of several, the smallest."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x"))
    return best.select(*keys, F.col("x.v").alias(value), (-F.col("x.m")).alias("n_lines"))


def edges(lines: DataFrame, page: str) -> DataFrame:
    """Adds edge: whether a line is among the first or last EDGE lines with text of its page."""
    shown = F.col("line").rlike(r"[^ \t\n\r\f\x0B]")
    up = W.partitionBy(page).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(page).orderBy("line_no").rowsBetween(0, W.unboundedFollowing)
    n = F.when(shown, 1).otherwise(0)
    return lines.withColumn("edge", shown & ((F.sum(n).over(up) <= EDGE) | (F.sum(n).over(down) <= EDGE)))


def furniture(lines: DataFrame, volume: str, page: str) -> DataFrame:
    """Masked edge lines of a volume that stand on REPEATED or more pages: volume, key, n_pages."""
    at = edges(lines, page).where("edge").select(volume, page, T.furniture_key(F.col("line")).alias("key")).where("key <> ''")
    return at.distinct().groupBy(volume, "key").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= REPEATED)


def strip_furniture(lines: DataFrame, volume: str, page: str, least_share: float = 0.0) -> DataFrame:
    """Lines without the furniture at the edges of their pages.

    Two passes: keys are counted for each volume, then joined back on volume
    and key. A key must also stand on least_share of the volume's pages.
    """
    known = furniture(lines, volume, page)
    if least_share:
        pages = lines.groupBy(volume).agg(F.countDistinct(page).alias("_pages"))
        known = known.join(pages, volume).where(F.col("n_pages") >= least_share * F.col("_pages"))
    keyed = edges(lines, page).withColumn("key", F.when(F.col("edge"), T.furniture_key(F.col("line"))))
    gone = keyed.join(known.select(volume, "key", F.lit(True).alias("_gone")), [volume, "key"], "left")
    return gone.where(F.col("_gone").isNull()).select(*lines.columns)


def pages_in_step(numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Share of neighbouring occurrences whose number moves as the page does, give or take one.

    numbers: keys, index (page) and number. Returns keys, pairs, in_step, tracks
    (half or more).
    """
    w = W.partitionBy(*keys).orderBy("index")
    step = F.col("index") - F.lag("index").over(w)
    ok = (F.abs(F.col("number") - F.lag("number").over(w) - step) <= 1).cast("int")
    out = numbers.select(*keys, ok.alias("ok")).where("ok is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.sum("ok").alias("in_step"))
    return out.withColumn("tracks", F.col("in_step") * 2 >= F.col("pairs"))


def tabular_context(lines: DataFrame, page: str, aligned: Column) -> DataFrame:
    """Adds aligned, and tabular: an aligned line stands within three lines before and within three after."""
    w = W.partitionBy(page).orderBy("line_no")
    flag = aligned.cast("int")
    before, after = F.max("_a").over(w.rowsBetween(-3, -1)), F.max("_a").over(w.rowsBetween(1, 3))
    return lines.withColumn("_a", flag).withColumn("aligned", F.col("_a") == 1).withColumn("tabular", (F.coalesce(before, F.lit(0)) == 1) & (F.coalesce(after, F.lit(0)) == 1)).drop("_a")


def double_spaced(lines: DataFrame, page: str) -> DataFrame:
    """Pages where at least three lines have text and 60 % of them stand above an empty line."""
    shown = F.col("line").rlike(r"[^ \t\n\r\f\x0B]")
    nxt = F.lead("_s").over(W.partitionBy(page).orderBy("line_no"))
    at = lines.withColumn("_s", shown).withColumn("_gap", F.col("_s") & (nxt == F.lit(False)))
    out = at.groupBy(page).agg(F.count_if(F.col("_s")).alias("n_text"), F.count_if(F.col("_gap")).alias("n_gaps"))
    return out.withColumn("double_spaced", (F.col("n_text") >= 3) & (F.col("n_gaps") * 10 >= F.col("n_text") * 6))
