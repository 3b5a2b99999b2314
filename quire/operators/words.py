"""Vocabulary, broken words and scanning errors of whole collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

BREAK = "([A-Za-zÀ-ÿ]{2,})[-­‐][ \t\n\r\f\x0b]+([a-zà-ÿ][A-Za-zÀ-ÿ]*)"
_WORD = "[a-zà-ÿ-]+"


def word_counts(texts: DataFrame, *keys: str, text: str = "text", whole: bool = True) -> DataFrame:
    """Words of more than two characters and how often they stand; whole leaves out both halves of broken words."""
    t = F.regexp_replace(F.col(text), BREAK, " ") if whole else F.col(text)
    w = texts.select(*keys, F.explode(F.regexp_extract_all(F.lower(t), F.lit(_WORD), 0)).alias("w"))
    w = w.select(*keys, F.regexp_replace("w", "^-+|-+$", "").alias("word")).where("length(word) > 2")
    return w.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def breaks(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Broken words: keys, pos (from 0), head, tail."""
    found = F.regexp_extract_all(F.col(text), F.lit(BREAK), 0)
    at = texts.select(*keys, F.posexplode(found).alias("pos", "whole"))
    return at.select(*keys, "pos", F.regexp_extract("whole", BREAK, 1).alias("head"), F.regexp_extract("whole", BREAK, 2).alias("tail"))


def rejoin(broken: DataFrame, vocabulary: DataFrame, whole: DataFrame | None = None, majority: bool = False) -> DataFrame:
    """Adds spelling: what a broken word becomes, null where neither spelling is known.

    vocabulary: word, n. The joined spelling wins if both are known, unless
    majority asks for the commoner one. whole (word): words that stand unbroken;
    given these, an unknown break whose head is no word, or whose tail is none,
    is closed too.
    """
    v = vocabulary.select("word", "n")
    b = broken.withColumn("_j", F.lower(F.concat("head", "tail"))).withColumn("_h", F.lower(F.concat_ws("-", "head", "tail")))
    b = b.join(v.select(F.col("word").alias("_j"), F.col("n").alias("_nj")), "_j", "left").join(v.select(F.col("word").alias("_h"), F.col("n").alias("_nh")), "_h", "left")
    joined, hyphened = F.concat("head", "tail"), F.concat_ws("-", "head", "tail")
    both = F.when(F.lit(majority) & (F.col("_nh") > F.col("_nj")), hyphened).otherwise(joined)
    out = F.when(F.col("_nj").isNotNull() & F.col("_nh").isNotNull(), both).when(F.col("_nj").isNotNull(), joined).when(F.col("_nh").isNotNull(), hyphened)
    if whole is not None:
        w = whole.select("word").distinct()
        b = b.withColumn("_hl", F.lower("head")).withColumn("_tl", F.lower("tail"))
        b = b.join(w.select(F.col("word").alias("_hl"), F.lit(True).alias("_kh")), "_hl", "left").join(w.select(F.col("word").alias("_tl"), F.lit(True).alias("_kt")), "_tl", "left")
        kh, kt = F.col("_kh").isNotNull(), F.col("_kt").isNotNull()
        piece = (F.length("tail") > 2) & F.when(kh, ~kt).otherwise(~((F.length("head") <= 3) & kt))
        out = F.coalesce(out, F.when(piece, joined))
    return b.withColumn("spelling", out).drop("_j", "_h", "_nj", "_nh", "_hl", "_tl", "_kh", "_kt")


def suspects(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Possible scanning errors: keys, label, confidence, match; safe words are left out."""
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(sure).alias("confidence"), F.regexp_extract_all(F.col(text), F.lit(T.suspect_pattern(p, border)), 0).alias("found")) for label, p, sure, border in T.SUSPECTS])
    at = texts.select(*keys, F.explode(each).alias("s")).select(*keys, "s.label", "s.confidence", F.explode("s.found").alias("match"))
    return at.where(~F.lower("match").isin(T.SAFE))


def ranked_suspects(found: DataFrame) -> DataFrame:
    """Each label and match once, with its count and rank: likely before possible, then the commonest."""
    from pyspark.sql import Window as W

    n = found.groupBy("label", "confidence", "match").agg(F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("confidence") == "certain", 0).when(F.col("confidence") == "likely", 1).otherwise(2)
    return n.withColumn("place", F.row_number().over(W.partitionBy("confidence").orderBy(order, F.desc("n"), "label", "match")))
