"""Printed numbers of paragraphs told from lists, and sentences that a page break parts.

Windows are by document, in its order; a document is the unit that one task
holds. Null texts are no numbered blocks. Rows that repeat a document and place
take any order among themselves; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

S = T.SPACE
# A numbered block; how many numbers and blocks may be missing in a run; shares of prose, long runs, words on average, and the length of a single paragraph.
NUMBERED = rf"(?s)^([0-9]{{1,4}})[.)]{S}+([^ \t\n\r\f\x0B].*)$"
SKIPPED, BETWEEN, SHARE, LONG_RUN, LONG_SHARE, MEAN_WORDS, LONG_SINGLE = 3, 12, 6, 10, 4, 10, 100
# Blocks that are no prose, how a sentence goes on, a page's mark, and note markers behind a sentence.
NO_PROSE, GOES_ON, PAGE_MARK = r"^(#|>|-|%%|\[\^|\|)", "^[a-zà-ÿ,;]", "^%%page [^%]+%%$"
NOTE_MARKS = rf"(?:\[\^[0-9]+(?:-[0-9]+)?\])+{S}*$"


def reads_as_prose(rest: Column, runs_on: Column) -> Column:
    """Whether what follows a number reads as a paragraph: eight words with an end or a continuation, or twenty."""
    n = F.size(T.chunks(rest))
    item = rest.rlike(f"^[a-z]|;{S}*$") | (rest.rlike(f",{S}*$") & (n < 20))
    return ~item & (n >= 8) & (runs_on | rest.rlike(f"[.!?\"”’)]{S}*$") | (n >= 20))


def fragment(rest: Column) -> Column:
    """Fewer than eight words and no closing mark."""
    return (F.size(T.chunks(rest)) < 8) & ~rest.rlike(f"[.!?:\"”’)]{S}*$")


def left_open(t: Column) -> Column:
    """No closing mark at the end, or a bracket left open."""
    return (F.regexp_count(t, F.lit(r"\(")) > F.regexp_count(t, F.lit(r"\)"))) | ~t.rlike(rf"[.!?:;\"”’)\]]{S}*$")


def mark_numbers(blocks: DataFrame, key: str, order: str, kind: str = "kind", text: str = "text", finding: str | None = None, hard: str | None = None) -> DataFrame:
    """Adds printed_number (the number is the paragraph's, to be escaped) and joins (a year that ends the sentence of the block before).

    Numbered paragraphs make a run while numbers rise by SKIPPED + 1 at most and BETWEEN other blocks at most stand between.
    A run is numbering if its items read as prose; fragments in it stay. A single one is if it is long, a year, or runs on.
    """
    w = W.partitionBy(key).orderBy(order)
    t, k = F.col(text), F.col(kind)
    at = blocks.withColumn("_stop", F.coalesce(F.col(hard), F.lit(False)) if hard else F.lit(False))
    shaped = F.coalesce(t.rlike(NUMBERED), F.lit(False))
    own = (k == "paragraph") & shaped & (F.col(finding).isNull() if finding else F.lit(True))
    at = at.withColumn("_own", F.coalesce(own, F.lit(False)))
    at = at.withColumn("_n", F.when(F.col("_own"), F.regexp_extract(t, NUMBERED, 1).cast("int"))).withColumn("_rest", F.when(F.col("_own"), F.regexp_extract(t, NUMBERED, 2)))
    other = (~F.col("_own") & ~F.coalesce(k == "page", F.lit(False))).cast("int")
    at = at.withColumn("_others", F.sum(other).over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("_own"), F.struct("_n", "_others")), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    year = F.col("_n").between(1900, 2099)
    rises = (F.col("_n") > last["_n"]) & (F.col("_n") <= last["_n"] + 1 + SKIPPED) & (F.col("_others") - last["_others"] <= BETWEEN) & ~year
    follows = F.first(F.when(~F.coalesce(k == "page", F.lit(False)), (k == "paragraph") & ~shaped), True).over(w.rowsBetween(1, W.unboundedFollowing))
    before = F.lag(F.struct(k.alias("kind"), t.alias("text"), F.col("_stop").alias("stop"))).over(w)
    meets = (before["kind"] == "paragraph") & ~before["stop"] & ~F.col("_stop") & left_open(before["text"])
    at = at.withColumn("_new", (F.col("_own") & ~F.coalesce(rises, F.lit(False))).cast("int")).withColumn("_cut", F.coalesce(follows, F.lit(False))).withColumn("_meets", F.coalesce(meets, F.lit(False)))
    at = at.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_prose", reads_as_prose(F.col("_rest"), F.col("_cut")))
    r = W.partitionBy(key, "_run")
    size, prose, n_words = F.count("_n").over(r), F.count_if("_prose").over(r), F.sum(F.size(T.chunks(F.col("_rest")))).over(r)
    run = (n_words >= size * MEAN_WORDS) & (prose * 10 >= size * F.when(size >= LONG_RUN, LONG_SHARE).otherwise(SHARE)) & ~fragment(F.col("_rest"))
    single = year | (F.col("_rest").rlike("^[a-z]") & F.col("_meets")) | (F.col("_prose") & (F.length("_rest") >= LONG_SINGLE))
    joins = F.col("_own") & (size == 1) & year & F.col("_meets")
    at = at.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("printed_number", F.coalesce(F.col("_own") & ~joins & F.when(size == 1, single).otherwise(run), F.lit(False)))
    return at.select(*blocks.columns, "printed_number", "joins")


def join_marked(marked: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Blocks with those that join the block before put behind it, a space between; the first block's other columns stay."""
    w = W.partitionBy(key).orderBy(order)
    at = marked.withColumn("_g", F.sum((~F.col("joins")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    whole = F.array_join(F.collect_list(text).over(W.partitionBy(key, "_g").orderBy(order).rowsBetween(0, W.unboundedFollowing)), " ")
    return at.withColumn(text, F.when(F.col(text).isNotNull(), whole)).where(~F.col("joins")).drop("_g", "joins")


def page_splits(blocks: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """doc, order, kind, before and after of each sentence that stops at page marks and goes on behind them.

    kind: paragraph (goes on in lower case), capitalised, quote (a quotation goes
    on in lower case) or skewQuote (it doesn't, but the paragraph behind it does).
    """
    w = W.partitionBy(doc).orderBy(order)
    t = F.col(text)
    mark = F.coalesce(t.rlike(PAGE_MARK), F.lit(False))
    ends = lambda c: T.ends_sentence(F.regexp_replace(c, NOTE_MARKS, ""))
    at = blocks.select(doc, order, t.alias("before"), mark.alias("_mark"), F.lead(text).over(w).alias("_next"))
    ahead = F.first(F.when(~F.col("_mark"), F.struct(F.col("before").alias("after"), F.col("_next").alias("then"))), True).over(w.rowsBetween(1, W.unboundedFollowing))
    at = at.withColumn("_to", ahead).where(F.col("_next").rlike(PAGE_MARK) & ~F.col("before").rlike(NO_PROSE) & ~ends(F.col("before")))
    after, then = F.col("_to.after"), F.col("_to.then")
    said = F.substring(after, 3, 1 << 30)
    skewed = ~ends(said) & ~then.rlike(NO_PROSE) & then.rlike(GOES_ON)
    quoted = F.when(said.rlike("^[\"“‘'\\[(]"), None).when(said.rlike(GOES_ON), "quote").when(skewed, "skewQuote")
    plain = F.when(after.rlike(GOES_ON), "paragraph").otherwise("capitalised")
    kind = F.when(~after.rlike(NO_PROSE), plain).when(after.rlike("^> ") & ~after.rlike("^> -"), quoted)
    return at.select(doc, order, kind.alias("kind"), "before", after.alias("after")).where("kind IS NOT NULL")
