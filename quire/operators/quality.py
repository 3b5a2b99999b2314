"""Gates over made texts: density, retention, losslessness, structure, severed sentences, baselines and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

LEAST_DIGITS = 30.0
RETAINED = (0.9, 1.05)
MOST_FOREIGN = 0.001


def digit_density(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Digits in a thousand words of each group, and whether there are enough of them."""
    out = texts.groupBy(*keys).agg(F.sum(F.size(T.chunks(F.col(text)))).cast("long").alias("n_words"), F.sum(F.regexp_count(F.col(text), F.lit(r"[0-9]"))).cast("long").alias("n_digits"))
    rate = F.when(F.col("n_words") > 0, F.col("n_digits") / F.col("n_words") * 1000).otherwise(0.0)
    return out.withColumn("per_thousand", F.round(rate, 6)).withColumn("ok", rate >= LEAST_DIGITS)


def retention(sources: DataFrame, made: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Words of what was made against words of its source."""
    n = F.sum(F.size(T.plain_words(F.col(text)))).cast("long")
    out = sources.groupBy(*keys).agg(n.alias("source_words")).join(made.groupBy(*keys).agg(n.alias("made_words")), list(keys), "left")
    out = out.withColumn("made_words", F.coalesce("made_words", F.lit(0).cast("long")))
    share = F.when(F.col("source_words") > 0, F.col("made_words") / F.col("source_words")).otherwise(0.0)
    return out.withColumn("retained", F.round(share, 6)).withColumn("ok", (share > RETAINED[0]) & (share < RETAINED[1]))


def foreign_words(made: DataFrame, sources: DataFrame, text: str = "text") -> DataFrame:
    """Words of made texts that no source has, with their counts: an anti-join of distinct words, which combine before the exchange."""
    count = made.select(F.explode(T.plain_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = sources.select(F.explode(T.plain_words(F.col(text))).alias("word")).distinct()
    return count.join(known, "word", "left_anti")


def lossless(made: DataFrame, sources: DataFrame, text: str = "text") -> DataFrame:
    """One row: words made, foreign words and whether their share is below MOST_FOREIGN."""
    total = made.agg(F.sum(F.size(T.plain_words(F.col(text)))).cast("long").alias("n_words"))
    alien = foreign_words(made, sources, text).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_foreign"))
    share = F.when(F.col("n_words") > 0, F.col("n_foreign") / F.col("n_words")).otherwise(1.0)
    return total.crossJoin(alien).withColumn("ok", share < MOST_FOREIGN)  # one row each


def structure(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Counts of what a made text must not hold, and of its headings and page markers."""
    lines = F.split(F.col(text), "\n")
    c = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")
    return texts.select(
        *keys,
        c(r"^[ \t\r\f\x0B]*[0-9]{1,4}[ \t\r\f\x0B]*$").alias("bare_numbers"),
        F.regexp_count(F.col(text), F.lit(r"\f")).cast("long").alias("form_feeds"),
        F.regexp_count(F.col(text), F.lit(r"[\x00-\x08\x0B\x0D-\x1F\x7F]")).cast("long").alias("controls"),
        c(r"^#{1,6}[ \t]").alias("headings"),
        c(r"^[ \t\r]*%%page [^%]+%%[ \t\r]*$").alias("page_markers"),
        F.col(text).rlike("\n{4,}").alias("blank_runs"),
    )


def unresolved_notes(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """References [^N] without a note [^N]: in the same text, and how often each stands."""
    refs = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[\^(\d+(?:-\d+)?)\](?!:)"), 1)).alias("label"))
    notes = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\[\^(\d+(?:-\d+)?)\]:"), 1)).alias("label")).distinct()
    return refs.join(notes, [key, "label"], "left_anti").groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))


def severed(blocks: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """Paragraphs of each document, and those that run on into a quotation that begins in lower case."""
    w = W.partitionBy(doc).orderBy(order)
    nxt = F.lead(text).over(w)
    prose = ~F.col(text).rlike(r"^(#|>|-|%%|\[\^)")
    broken = prose & nxt.rlike("^> [a-zà-ÿ]") & ~F.col(text).rlike("[.?!:;][\"”]?$")
    at = blocks.select(doc, prose.alias("prose"), F.coalesce(broken, F.lit(False)).alias("broken"))
    return at.groupBy(doc).agg(F.count_if("prose").alias("n_paragraphs"), F.count_if("broken").alias("n_severed"))


def baseline(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Digest and counts of each made text."""
    lines = F.split(F.col(text), "\n")
    c = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")
    plain = F.size(F.filter(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^([#>-]|%%page|\[\^)"))).cast("long")
    return texts.select(
        *keys,
        F.sha2(F.col(text), 256).alias("sha"),
        F.size(T.chunks(F.col(text))).cast("long").alias("words"),
        c(r"^#{1,6}[ \t]").alias("headings"),
        c(r"^>[ \t]").alias("quotes"),
        c(r"^(>[ \t])?-[ \t]").alias("list_items"),
        plain.alias("paragraphs"),
        c(r"^[ \t]*%%page [0-9]+%%[ \t]*$").alias("page_markers"),
    )


def baseline_diff(before: DataFrame, after: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Rows (key, field, before, after) of every count that moved; missing documents count 0."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in counts])).alias("x")).select(key, "x.field", F.col("x.v").alias(name))
    both = long(before, "before").join(long(after, "after"), [key, "field"], "full")
    both = both.select(key, "field", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.where("before <> after")


def score(expected: DataFrame, produced: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """True and false positives and misses of counts, by keys."""
    both = expected.select(*keys, F.col(n).alias("t")).join(produced.select(*keys, F.col(n).alias("o")), keys, "full")
    t, o = F.coalesce("t", F.lit(0)), F.coalesce("o", F.lit(0))
    return both.select(*keys, F.least(t, o).alias("tp"), F.greatest(o - t, F.lit(0)).alias("fp"), F.greatest(t - o, F.lit(0)).alias("fn"))
