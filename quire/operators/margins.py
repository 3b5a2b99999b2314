"""Left margins of pages: of numbered openings, of the commonest indent, of shifted scans and of facing pages.

Pages come as rows of whole texts. Lines are counted by page and column with
partial sums before the exchange; only counts are exchanged. Null and empty
texts have no lines and take the fallback; keys are grouped as they are, null
ones too; rows that repeat a key are one page; an empty table gives none. Of
columns with equal counts the smaller is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

from .lines import explode, mode

# A numbered opening up to its text; lines with text that tell a page's margin; lines of prose that tell a shifted page, and by how much it may be.
OPENER = r"^[ \t\n\r\f\x0B]{0,8}[0-9]{1,2}\.[0-9]{1,3}[ �]{2,}(?=[^ \t\n\r\f\x0B])"
PAGE_LINES, SHIFTED_LINES, SHIFT = 8, 15, (2, 6)


def _joined(pages: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which any may be null."""
    right = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return pages.join(right, on, "left").drop(*[f"_{k}" for k in keys])


def openers(pages: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys and opener: the commonest column at which the text of a page's numbered paragraphs begins; pages without any are left out."""
    at = explode(pages, *keys, text=text).where(F.col("line").rlike(OPENER))
    return mode(at.withColumn("opener", F.length(F.regexp_extract("line", OPENER, 0))), list(keys), "opener").drop("n_lines")


def page_margins(pages: DataFrame, *keys: str, text: str = "text", fallback: int = 0) -> DataFrame:
    """keys and margin: where numbered paragraphs begin, else the commonest indent of PAGE_LINES lines with text or more, else fallback."""
    shown = explode(pages, *keys, text=text).where(F.col("line").rlike(r"[^ \t\n\r\f\x0B]")).withColumn("indent", T.indent(F.col("line")))
    many = shown.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    common = _joined(mode(shown, list(keys), "indent").drop("n_lines"), many, list(keys)).where(F.col("_n") >= PAGE_LINES).drop("_n")
    every = pages.select(*keys).distinct()
    out = _joined(_joined(every, openers(pages, *keys, text=text), list(keys)), common, list(keys))
    return out.select(*keys, F.coalesce("opener", "indent", F.lit(fallback)).alias("margin"))


def shifted_margins(pages: DataFrame, *keys: str, text: str = "text", fallback: int = 0) -> DataFrame:
    """keys and margin of pages that a scan has shifted as a whole, else fallback.

    A page is shifted if over SHIFTED_LINES lines of four words or more the
    commonest indent is also the least, and SHIFT columns from the fallback.
    """
    words = F.size(F.split(T.normalise(F.col("line")), " "))
    prose = explode(pages, *keys, text=text).where(words > 3).withColumn("indent", T.indent(F.col("line")))
    least = prose.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("indent").alias("_least"))
    common = _joined(mode(prose, list(keys), "indent").drop("n_lines"), least, list(keys))
    shift = F.col("indent") - fallback
    common = common.where((F.col("_n") >= SHIFTED_LINES) & (F.col("indent") == F.col("_least")) & shift.between(*SHIFT))
    return _joined(pages.select(*keys).distinct(), common, list(keys)).select(*keys, F.coalesce("indent", F.lit(fallback)).alias("margin"))


def facing_margins(pages: DataFrame, volume: str, index: str, text: str = "text", fallback: int = 0) -> DataFrame:
    """volume, index and margin: a page's own numbered openings, else the commonest of the volume's pages on its side of the spread, else of the other side, else fallback."""
    own = openers(pages, volume, index, text=text)
    side = mode(own.withColumn("side", F.pmod(F.col(index), F.lit(2)).cast("int")), [volume, "side"], "opener").drop("n_lines")
    every = pages.select(volume, index, F.pmod(F.col(index), F.lit(2)).cast("int").alias("side")).distinct()
    out = _joined(every, own, [volume, index])
    out = _joined(out, side.withColumnRenamed("opener", "_same"), [volume, "side"])
    out = _joined(out.withColumn("side", 1 - F.col("side")), side.withColumnRenamed("opener", "_other"), [volume, "side"])
    return out.select(volume, index, F.coalesce("opener", "_same", "_other", F.lit(fallback)).alias("margin"))


def asterisks_apart(t: Column) -> Column:
    """A text whose lines of three asterisks or more have an empty line on either side; null for null."""
    rule = r"(?m)(?<=[^ \t\r\f\x0B\n])([ \t\r\f\x0B]*\n)(?=[ \t\r\f\x0B]*\*(?:[ \t\r\f\x0B]*\*){2,}[ \t\r\f\x0B]*$)"
    after = r"(?m)(^[ \t\r\f\x0B]*\*(?:[ \t\r\f\x0B]*\*){2,}[ \t\r\f\x0B]*\n)(?=[ \t\r\f\x0B]*[^ \t\r\f\x0B\n])"
    return F.regexp_replace(F.regexp_replace(t, rule, "$1\n"), after, "$1\n")
