"""Page breaks: whether the paragraph below one goes on from the one above, by the lines on either side; and a referee's answers.

A row holds one break. Null texts read as empty; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

S = T.SPACE
# Fixed values, in em or points: a flush line, how near to that is unsure, a full line, a justified page, a short line; words of a line that may go on; sizes that are one; lines that tell a page and their length.
FLUSH, UNSURE, FULL, JUSTIFIED, SHORT, FEW_WORDS, SAME_SIZE, SAME_SIZE_SCAN, PAGE_LINES, LINE_LENGTH = 0.6, 0.25, 0.5, 0.5, 5, 4, 0.25, 1, 5, 30
# Labels that open a block, a number that only a layout takes for one, and a note's number behind a stop.
LABEL = rf"^(?:[0-9]{{1,4}}(?:\.[0-9]{{1,4}})+[.)]?{S}|[0-9]{{1,4}}[.)]{S}|\(?(?:[a-z]|[ivxlc]{{1,5}})[.)]{S}|\([a-z0-9]{{1,4}}\){S}|[A-Z]\.{S}|[•·▪●○◦■□➢►–-])"
BARE = rf"^[0-9]{{1,4}}{S}"
NOTED = rf"([.?!:;][\"'”’)\]]*){S}?(?:[0-9]{{1,4}}|\[\^[A-Za-z0-9_-]{{1,12}}\])$"


def finished(t: Column) -> Column:
    """Whether a text ends a sentence, a note's number behind the stop or not."""
    s = F.regexp_replace(T.stripped(F.coalesce(t, F.lit(""))), NOTED, "$1")
    return s.rlike("[.?!:;][\"'”’)\\]]*$") & ~s.rlike(T.ABBREVIATION) & ~s.rlike(T.INITIAL)


def same_face(a: Column, b: Column, scanned: bool = False) -> Column:
    """Whether two lines (family, color, bold, italic, size) are set alike; on a scan sizes may differ by a point."""
    alike = F.abs(a["size"] - b["size"]) <= (SAME_SIZE_SCAN if scanned else SAME_SIZE)
    for field in ("family", "color", "bold", "italic"):
        alike = alike & a[field].eqNullSafe(b[field])
    return F.coalesce(alike, F.lit(False))


def justified(lines: DataFrame, *keys: str, gap: str = "right_gap", body: str = "body", text: str = "text") -> DataFrame:
    """keys and justified: whether the middle gap (the upper of two) of a page's long body lines, PAGE_LINES at least, is small. Pages without lines have no row."""
    fit = F.coalesce(F.col(body), F.lit(False)) & (F.length(T.stripped(F.col(text))) >= LINE_LENGTH)
    gaps = F.sort_array(F.collect_list(F.when(fit, F.abs(gap))))
    middle = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))
    return lines.groupBy(*keys).agg(F.coalesce((F.size(gaps) >= PAGE_LINES) & (middle < JUSTIFIED), F.lit(False)).alias("justified"))


def decide(before: Column, after: Column, above: Column, below: Column, under: Column, runs_on: Column, even: Column, scanned: bool = False) -> Column:
    """join, rule (R1, R2 or split), indent_em and confidence of a break.

    before, after: texts of the blocks; above, below: last and first line, structs of
    family, color, bold, italic, size, left, right_gap, label, text; under: left of the
    line under below (null: none), runs_on: whether it goes on from below; even: whether the page above is justified.
    """
    after = T.stripped(F.coalesce(after, F.lit("")))
    ended, labelled = finished(before), F.coalesce(below["label"], F.lit(False))
    bare = labelled & F.coalesce(T.stripped(below["text"]).rlike(BARE), F.lit(False)) & ~ended
    indent = F.when(below["size"] > 0, F.floor((below["left"] - under) / below["size"] * 100 + 0.5) / 100)
    flush = F.coalesce(F.abs(indent) < FLUSH, F.lit(False))
    near = F.coalesce(F.abs(F.abs(indent) - FLUSH) < UNSURE, F.lit(False))
    gap = F.abs(F.coalesce(above["right_gap"], F.lit(0.0)))
    sure = lambda doubt, low="low": F.when(doubt, low).otherwise("high")
    call = lambda rule, how: F.struct((F.lit(rule) != "split").alias("join"), F.lit(rule).alias("rule"), how.alias("confidence"))
    going = F.when(flush & (gap >= SHORT), call("split", F.lit("low"))).when(flush, call("R1", sure(near | ~F.coalesce(runs_on, F.lit(False)))))
    going = going.when(after.rlike("^[a-z,;]"), call("R1", F.lit("high"))).otherwise(call("split", sure(indent.isNull() | near)))
    full = F.coalesce(even, F.lit(False)) & (gap < FULL) & flush & (F.size(T.chunks(F.coalesce(below["text"], F.lit("")))) > FEW_WORDS)
    ending = F.when(full, call("R2", F.lit("low"))).otherwise(call("split", sure(flush, "medium")))
    d = F.when(F.concat(after, F.lit(" ")).rlike(LABEL), call("split", F.lit("high"))).when(labelled & ~bare, call("split", sure(~ended, "medium")))
    d = d.when(~same_face(above, below, scanned), call("split", F.lit("high"))).when(ended, ending).otherwise(going)
    faced = F.concat(after, F.lit(" ")).rlike(LABEL) | (labelled & ~bare) | ~same_face(above, below, scanned)
    how = F.when(bare & (d["confidence"] == "high") & ~F.concat(after, F.lit(" ")).rlike(LABEL), "medium").otherwise(d["confidence"])
    return F.struct(d["join"].alias("join"), d["rule"].alias("rule"), F.when(~faced, indent).alias("indent_em"), how.alias("confidence"))


def answers(t: Column) -> Column:
    """A referee's answers as a map of case id to whether it joins: the widest {...} in the text, JOIN or SPLIT only, the last of an id. Anything else is an empty map; null for null."""
    found = F.from_json(F.regexp_extract(t, r"(?s)\{.*\}", 0), "answers array<struct<id:string,answer:string>>")["answers"]
    told = F.filter(F.coalesce(found, F.array().cast("array<struct<id:string,answer:string>>")), lambda x: x["id"].isNotNull() & x["answer"].isin("JOIN", "SPLIT"))
    last = F.filter(told, lambda x, i: ~F.exists(F.slice(told, i + 2, F.size(told) + 1), lambda y: y["id"] == x["id"]))
    return F.when(t.isNotNull(), F.map_from_entries(F.transform(last, lambda x: F.struct(x["id"], x["answer"] == "JOIN"))))
