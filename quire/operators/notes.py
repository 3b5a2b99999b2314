"""Markers and notes: joins by page and order, orphans, scoped corrections and cached decisions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def near_page(markers: DataFrame, notes: DataFrame, keys: list[str], page: str = "page", reach: int = 1) -> DataFrame:
    """Markers with the notes of their keys at most ``reach`` pages away; an equality join, as each note is dealt to the pages around it."""
    spread = notes.withColumn("note_page", F.col(page)).withColumn(page, F.explode(F.sequence(F.col(page) - reach, F.col(page) + reach)))
    return markers.join(spread, [*keys, page])


def in_order(refs: DataFrame, defs: DataFrame, key: str, order: str) -> DataFrame:
    """The k-th reference of a key with its k-th definition, the last for all beyond: key, ref_order, def_order."""
    w = W.partitionBy(key).orderBy(order)
    r = refs.select(key, F.col(order).alias("ref_order"), F.row_number().over(w).alias("k"))
    d = defs.select(key, F.col(order).alias("def_order"), F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(W.partitionBy(key)).alias("n"))
    counts = d.select(key, "n").distinct()
    r = r.join(counts, key).withColumn("k", F.least(F.col("k").cast("long"), F.col("n")).cast("int")).drop("n")
    return r.join(d.drop("n"), [key, "k"]).select(key, "ref_order", "def_order")


def orphans(defs: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    return defs.join(refs.select(*keys).distinct(), keys, "left_anti")


def occurrences_of(text: Column, find: Column) -> Column:
    """How often find stands in text, without overlap; an empty find nowhere, null for null."""
    return F.when(F.length(find) == 0, 0).otherwise((F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.nullif(F.length(find), F.lit(0))).cast("long")


def corrections(blocks: DataFrame, fixes: DataFrame, volume: str, printed: str, text: str = "text") -> DataFrame:
    """How often each correction (id, find, where_volume, where_printed; null: anywhere) matches; it may be applied where that is once."""
    scope = (F.col("where_volume").isNull() | (F.col("where_volume") == F.col(volume))) & (F.col("where_printed").isNull() | (F.col("where_printed") == F.col(printed)))
    at = blocks.join(fixes, scope & F.col(text).contains(F.col("find"))).select("id", occurrences_of(F.col(text), F.col("find")).alias("n"))
    out = fixes.select("id").join(at.groupBy("id").agg(F.sum("n").alias("matches")), "id", "left")
    return out.select("id", F.coalesce("matches", F.lit(0)).cast("long").alias("matches")).withColumn("exactly_once", F.col("matches") == 1)


def request_key(request: Column) -> Column:
    return F.substring(F.sha2(request, 256), 1, 16)


def decided(cases: DataFrame, cache: DataFrame, request: str, by_rule: str) -> DataFrame:
    """Cases with the cached answer of their key, or else the rule's: adds key, cached, join."""
    keyed = cases.withColumn("key", request_key(F.col(request)))
    out = keyed.join(cache.select("key", F.col("join").alias("_a")), "key", "left")
    return out.withColumn("cached", F.col("_a").isNotNull()).withColumn("join", F.coalesce("_a", by_rule)).drop("_a")


# Contexts in which a number behind a mark is no note. Before the number: abbreviations that cite one, leaders, months, numbers in a list; after it: months, telephone numbers, counts, reporters and codes.
_GAP = r"(?:(?!\n[ \t]*\n)\s)"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_BEFORE = [
    r"(?<!(?<![A-Za-z0-9_])(?i:nos?|nn?|pp?|art|ch|sec|para|vol|ex|fig|tbl|id|at|see)\.)",
    r"(?<!\.\s?\.\s?\.\s?\.\s?\.)",
    r"(?<!(?<![A-Za-z0-9_])(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\.)",
    r"(?<![0-9][0-9-]{0,20},\s?[0-9][0-9-]{0,20},)",
    rf"(?!(?<=(?<![A-Za-z0-9_])(?:{_MONTHS}|Jan\.|Feb\.|Mar\.|Apr\.|Jun\.|Jul\.|Aug\.|Sept?\.|Oct\.|Nov\.|Dec\.)\s[0-9]{{1,2}},){_GAP}+(?:1[89]|20)[0-9]{{2}}(?=\s|$))",
    rf"(?!(?<=,){_GAP}+[0-9]{{1,4}}\s+(?:years?|months?|weeks?|days?|hours?|minutes?|seconds?|percent|per\s?cent|times|million|billion|thousand|hundred)(?![A-Za-z0-9_]))",
    rf"(?!(?<=[0-9],){_GAP}+[0-9]{{1,4}}\s*(?:(?:and|or|to)\s+[0-9]|[-–]\s*[0-9]|\())",
]
_AFTER = [
    rf"(?!(?:(?!\n[ \t]*\n)[\s,]){{0,4}}(?:(?i:and){_GAP}{{1,20}}[0-9]{{1,2}}(?:(?!\n[ \t]*\n)[\s,]){{0,4}})?(?i:{_MONTHS})(?![A-Za-z0-9_]))",
    r"(?!\s+[0-9]{4}\s+[0-9]{4}(?![A-Za-z0-9_]))",
    r"(?!\s+(?i:out\s+of)(?![A-Za-z0-9_]))",
    r"(?!\s+(?!(?:Ibid|Id)\.)(?:(?:[A-Z][A-Za-z]{0,5}\.\s?){1,4}\s*[0-9]|[A-Z]{2,6}\s[0-9]{1,4}(?![0-9-])))",
    r"(?!\s+of\s)",
    r"(?!\s+(?:U\.S\.C|C\.F\.R)(?![A-Za-z0-9_]))",
]
MARKED = r"(?<=[.,;:!?\"')])" + "".join(_BEFORE) + rf"({_GAP}+)([1-9][0-9]{{0,3}})(?=\s|$)" + "".join(_AFTER)


def linked(text: Column, known: Column) -> Column:
    """A text whose known note numbers behind a mark and white space are references [^N].

    known: an array of numbers; null is none. Numbers in other contexts (see
    above), behind a blank line or with a leading zero stay. Words are of ASCII letters, so an accented letter ends one.
    The characters 1 to 3 become spaces. Null for null.
    """
    known = F.coalesce(known.cast("array<int>"), F.array().cast("array<int>"))
    return _put(F.regexp_replace(F.translate(text, "\x01\x02\x03", "   "), MARKED, "\x01$1\x02$2\x03"), known)


def _put(marked: Column, known: Column) -> Column:
    """Candidates, marked as 1 gap 2 digits 3, as references where they are known and as they stood elsewhere."""
    parts = F.split(marked, "\x01")

    def one(part: Column, k: Column) -> Column:
        gap, behind = F.substring_index(part, "\x02", 1), F.substring_index(part, "\x02", -1)
        digits, rest = F.substring_index(behind, "\x03", 1), F.substring_index(behind, "\x03", -1)
        is_note = F.array_contains(known, digits.try_cast("int"))
        return F.when(k == 0, part).when(is_note, F.concat(F.lit("[^"), digits, F.lit("]"), rest)).otherwise(F.concat(gap, digits, rest))

    return F.array_join(F.transform(parts, one), "")


# What a number set flush may stand behind, and what may stand behind the number.
FLUSH = r"((?:[a-zà-ÿ]{3,}[.,;:!?]?|(?<![A-Za-z0-9_])(?:1[89]|20)[0-9][0-9][.,;:])[\"”’')]*)([0-9]{1,4})(?=[ \t\n\r\f\x0B,.;:)\]]|$)"


def flush_linked(text: Column, near: Column) -> Column:
    """A text whose numbers set flush against a word (or a year and its stop) are references [^N] if near, an array of the notes about the page, has them. Null for null."""
    near = F.coalesce(near.cast("array<int>"), F.array().cast("array<int>"))
    return _put(F.regexp_replace(F.translate(text, "\x01\x02\x03", "   "), FLUSH, "$1\x01\x02$2\x03"), near)


# Closing marks, how far numbers of notes may run ahead, and a candidate.
_CLOSE = r"[)\"”’'\]]"
AHEAD = 12
_NEXT = re.compile(rf"\[\^([0-9]+)\]|(?P<head>{_CLOSE}*[.?!,;:]{_CLOSE}*|{_CLOSE}+)(?P<n>[1-9][0-9]{{0,2}})(?=\s|$)")


def sequenced_text(text: str, near: set[int]) -> str:
    """Numbers set flush against a stop or closing mark as references, where they run on from the last one.

    A number is one if it is in near, above the last and by AHEAD at most; not behind white space, in a
    heading, or behind a digit unless a sentence follows. A fold, as each decides for the next.
    """
    last, at, out = 0, 0, []
    for m in _NEXT.finditer(text):
        if m[1]:
            last = int(m[1])
            continue
        n, left = int(m["n"]), text[m.start() - 1 : m.start()]
        follows = text[m.end() :].lstrip()[:1]
        within = left in "0123456789" and follows and not re.match(r'[A-Z"“(]', follows)
        heading = text.startswith("#", text.rfind("\n", 0, max(m.start() - 1, 0) + 1) + 1)
        if n not in near or not last < n <= last + AHEAD or not left.strip() or within or heading:
            continue
        last = n
        out += [text[at : m.start()], m["head"], f"[^{n}]"]
        at = m.end()
    return "".join([*out, text[at:]])


def sequence_linked(text: Column, near: Column) -> Column:
    """sequenced_text over rows, in Arrow batches; null for null, a null array has no notes."""

    def each(texts: pd.Series, notes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else sequenced_text(t, set() if k is None else set(map(int, k))) for t, k in zip(texts, notes, strict=True)], dtype=object)

    return F.pandas_udf(each, "string")(text, near)
