"""Headings, contents pages and division labels, told by what a line says and by what stands around it.

Column functions give null for null. Letters count as capital where no lower
case letter stands; letters without case are neither. Windows are by page, the
unit that one task holds; an empty table gives none, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

S = T.SPACE
NO_WORD = "(?:^|[^A-Za-z0-9_])"
LOWER = r"\p{Ll}"

# Dot leaders before a page number, an entry that opens with its page, and how many of them make a page of contents or illustrations.
LEADER = rf"[.·]{{4,}}{S}*[0-9]{{1,4}}{S}*$"
PAGE_FIRST = rf"^{S}*p\.{S}*[0-9]{{1,4}}(?:[–-][0-9]{{1,4}})?{S}{{2,}}[^ \t\n\r\f\x0B]"
ENTRIES = 3
# A line that lists a heading, by leaders or by a gap that no sentence's end stands before.
LISTED = rf"{LEADER}|(?:^|[^.,;:])[ \t]{{3,}}[0-9]{{1,4}}{S}*$"
# Most words of a heading; words before a number that is no page; a range of years.
MOST_WORDS = 14
OWN_NUMBER = rf"(?i){NO_WORD}(?:part|chapter|appendix|section|volume|phase|floor|stage|flat){S}+[0-9]{{1,4}}$"
YEARS = rf"{NO_WORD}(?:1[89]|20)[0-9][0-9]{S}*(?:to|and|-|–){S}*(?:1[89]|20)[0-9][0-9]$"
# Divisions that carry a number, those of the first level, and markers of numbered headings.
DIVISION = rf"(?s)^(Part|Chapter|Appendix|Annex|Volume|Section){S}+([0-9]{{1,3}}|[IVXLC]{{1,7}})((?:[^A-Za-z0-9_].*)?)$"
TOP = ["Part", "Appendix", "Annex", "Volume"]
NUMBERED = rf"(?s)^(?:[IVXLC]{{1,6}}|[A-Z]|[0-9]{{1,2}})\.{S}+(.+)$"
MARKER = rf"^(?:\((?:[0-9]{{1,2}}|[a-z]|[ivxlc]{{1,6}})\)|(?:[IVXLC]{{1,6}}|[A-Z]{{1,2}}|[0-9]{{1,2}})\.){S}+"
# Words that say nothing of a title's case, words that no finished title ends on, and small words of short subheads.
SMALL = "of the a an in to for and or nor with by from that as at on is was were are be been it its their his her our my your has have had but not no than then so if when which who whom whose into upon per via".split()
DANGLING = "of the a an in to for and or with by from that was is are were on at as its their his her".split()
SUBHEAD_SMALL = "a an and as at but by for from in of on or the to with vs".split()
# Units that follow a quantity and no paragraph's number.
UNITS = r"per[ \t\n\r\f\x0B]?cent|percent|million|billion|thousand|hundred|degrees?|inches?|centimetres?|centimeters?|metres?|meters?|miles?|kilometres?|kilometers?|pounds?|kg|km|years?|months?|weeks?|days?|hours?|minutes?|seconds?|times"
# A paragraph that is only a division's label.
LABEL = rf"^(?:Recommendations?|Findings?|Issue(?:{S}+(?:[0-9]{{1,2}}|[IVXLC]{{1,4}}))?):?$"
# Headings that stay sections though no contents list them.
SECTION = [r"^(?:Part|Chapter|Appendix) [^:]+: ", rf"^(?:[A-Z]|[0-9]{{1,2}})\.[0-9]{{1,2}}{S}", r"(?i)^appendix [a-z](?:[^A-Za-z0-9_]|$)", rf"(?i){NO_WORD}(?:part|chapter|appendix){S}+(?:[0-9]{{1,2}}|[a-z])$"]


def _count(t: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(pattern)))


def contents_page(t: Column) -> Column:
    """Whether a page lists contents: ENTRIES lines or more with dot leaders."""
    return _count(t, LEADER) >= ENTRIES


def illustration_list(t: Column) -> Column:
    """Whether a page lists illustrations: ENTRIES lines or more that open with a page."""
    return _count(t, PAGE_FIRST) >= ENTRIES


def heading_key(t: Column) -> Column:
    """What a heading and its entry in the contents share: no marker, no dots at the end, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(T.normalise(t), MARKER, ""), r"[. \t\n\r\f\x0B]+$", ""))


def without_page(t: Column) -> Column:
    """A heading without the page number behind it; numbers of divisions and ranges of years stay."""
    s = T.stripped(t)
    return F.when(s.rlike(OWN_NUMBER) | s.rlike(YEARS), s).otherwise(T.stripped(F.regexp_replace(s, f"{S}+[0-9]{{1,4}}$", "")))


def titular(t: Column) -> Column:
    """Whether a line is in capitals, or six of ten of its words with letters, two at least, begin with one."""
    words = F.filter(T.chunks(t), lambda w: w.rlike("[A-Za-z]"))
    capital = F.filter(words, lambda w: w.rlike("^[A-Z]"))
    return ~t.rlike(LOWER) | ((F.size(words) >= 2) & (F.size(capital) * 10 >= F.size(words) * 6))


def dangles(t: Column) -> Column:
    """Whether a line ends on a word that no title ends on."""
    return T.stripped(t).rlike(rf"(?i){NO_WORD}(?:{'|'.join(DANGLING)})$")


def numbered_opening(t: Column) -> Column:
    """Whether a line opens a numbered paragraph (7.1, 10.14) and no quantity."""
    number, s = rf"^[0-9]{{1,3}}[.)][0-9]{{1,3}}{S}+", T.stripped(t)
    return s.rlike(number) & ~s.rlike(rf"{number}(?:{UNITS})(?:[^A-Za-z0-9_]|$)")


def heading_tail(t: Column) -> Column:
    """A line as the wrapped end of a heading (six words at most, all but small ones capital, no stop), else null."""
    s = T.normalise(t)
    fits = F.forall(T.chunks(s), lambda w: w.rlike("^[A-Z(\"'“]") | F.lower(w).isin(SMALL))
    ok = s.rlike("^[A-Z]") & (F.size(T.chunks(s)) <= 6) & ~s.rlike("[.?!:;,]$") & ~s.rlike(rf"^(?:[IVXLC]{{1,6}}|[A-Z]|[0-9]{{1,2}})\.{S}") & fits
    return F.when(ok, s)


def division_label(t: Column) -> Column:
    """The heading that a paragraph of nothing but a division's label becomes, else null."""
    s = T.stripped(F.regexp_replace(t, f"{S}+", " "))
    return F.when(s.rlike(LABEL), F.regexp_replace(s, ":$", ""))


def keeps_section(t: Column, listed: Column) -> Column:
    """Whether a heading stays a section where unlisted ones don't: listed, numbered like a section, or named like a division."""
    named = F.lit(False)
    for pattern in SECTION:
        named = named | t.rlike(pattern)
    return F.coalesce(listed, F.lit(False)) | named


def heading(t: Column, divisions: bool = True, capitals: bool = True, numbers: bool = True) -> Column:
    """level and text of the heading that a line is, else null.

    Entries of contents, more than MOST_WORDS words and ends on ; : , or a hyphen are none.
    Then a division with its number, a numbered or lettered title, and a line in capitals are tried in turn.
    """
    s = T.stripped(t)
    body = without_page(s)
    made = lambda level, text: F.struct(level.cast("int").alias("level"), text.alias("text"))
    out = F.lit(None).cast("struct<level:int,text:string>")
    if capitals:
        letters = F.length(F.regexp_replace(body, "[^A-Za-z]", ""))
        plain = ~body.rlike(rf"\.$|[$%]|[0-9]{{3}}|{LOWER}") & (F.regexp_count(body, F.lit(",")) < 2)
        word = body.rlike(S) | ((letters >= 5) & ~body.rlike("[-0-9]"))
        out = F.when((letters >= 4) & plain & (letters * 10 > F.length(body) * 6) & word, made(F.lit(2), body))
    if numbers:
        title = T.stripped(F.regexp_extract(body, NUMBERED, 1))
        prose = F.exists(T.chunks(title), lambda w: w.rlike("^[a-z]") & ~F.lower(w).isin(SMALL))
        caps = ~title.rlike(LOWER)
        is_title = title.rlike("^[A-Z]") & ~title.rlike("[.?!]$") & titular(title) & ~prose
        if not capitals:
            is_title = is_title & ~caps
        out = F.when(is_title, made(F.when(caps, 2).otherwise(3), title)).otherwise(out)
    if divisions:
        kind = F.regexp_extract(body, DIVISION, 1)
        rest = T.stripped(F.regexp_replace(F.regexp_extract(body, DIVISION, 3), "^:", ""))
        label = F.concat(kind, F.lit(" "), F.regexp_extract(body, DIVISION, 2), F.lit(": "), rest)
        out = F.when(rest.rlike("^[\"'(A-Z0-9]") & ~rest.rlike("[.,;]$"), made(F.when(kind.isin(TOP), 2).otherwise(3), label)).otherwise(out)
    open_end = body.rlike("[;:,\\-­‐]$")
    return F.when((body != "") & ~s.rlike(LISTED) & (F.size(T.chunks(body)) <= MOST_WORDS) & ~open_end, out)


def short_subheads(lines: DataFrame, page: str, order: str = "line_no", line: str = "line") -> DataFrame:
    """Adds subhead: whether a line is a short title by itself above the paragraph that it heads.

    A blank line or the page's beginning above; 60 characters and seven words at
    most, capital but for small ones; then a line of 60 characters or more that
    opens a sentence at about the same indent. Null lines are blank.
    """
    w = W.partitionBy(page).orderBy(order)
    s, raw = T.normalise(F.col(line)), F.lead(line).over(w)
    follow = T.normalise(raw)
    above = F.coalesce(F.lag(line).over(w), F.lit(""))
    words = F.split(s, " ")
    fits = F.forall(words, lambda x: x.rlike('^[A-Z0-9“"(]') | F.lower(x).isin(SUBHEAD_SMALL))
    title = s.rlike("^[A-Z]") & s.rlike(LOWER) & (F.length(s) <= 60) & (F.size(words) <= 7) & ~s.rlike(r'[.,;:?!”")\]0-9]$') & fits
    near = (F.length(follow) >= 60) & follow.rlike('^[A-Z“"(]') & (F.abs(T.indent(raw) - T.indent(F.col(line))) <= 2)
    return lines.withColumn("subhead", F.coalesce(title & near & ~above.rlike(r"[^ \t\n\r\f\x0B]"), F.lit(False)))


def centred(lines: DataFrame, page: str, line: str = "line") -> DataFrame:
    """Adds centred: whether a line stands in the middle of its page's longest line: 20 columns in at least, sides that differ by 30 % of their sum at most. Null lines don't."""
    right = F.max(F.length(F.regexp_replace(F.col(line), f"{S}+$", ""))).over(W.partitionBy(page)) - F.length(F.regexp_replace(F.col(line), f"{S}+$", ""))
    left = T.indent(F.col(line))
    return lines.withColumn("centred", F.coalesce((left >= 20) & (F.abs(left - right) * 10 <= (left + right) * 3), F.lit(False)))


# Numbers of divisions in words, and Roman numerals.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ROMAN = [("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100)]


def division_number(kind: Column, token: Column) -> Column:
    """A division's number however it is set (3, III, Three), a letter for an appendix or annex; null if it is none."""
    t = F.lower(token)
    worth = lambda c: F.coalesce(*[F.when(c == r, v) for r, v in ROMAN], F.lit(0))
    signs = F.filter(F.split(t, ""), lambda c: c != "")
    roman = F.aggregate(F.transform(signs, lambda c, i: F.when(worth(c) < worth(F.coalesce(F.get(signs, i + 1), F.lit(""))), -worth(c)).otherwise(worth(c))), F.lit(0), lambda a, c: a + c)
    word = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), t)
    plain = F.when(t.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(t, "^0+", ""), F.lit("")), F.lit("0")))
    plain = plain.when(F.lower(kind).isin("appendix", "annex") & t.rlike("^[a-z]$"), t)
    return plain.when(word > 0, word.cast("string")).when(t.rlike("^[ivxlc]+$"), roman.cast("string"))


def outline_level(label: Column, title: Column, scanned: bool = False) -> Column:
    """Level of an outline's label: 2 for a Roman one over capitals, 3 for a letter or number, 4 below; on a scan by the label alone."""
    roman, letter, number = label.rlike(r"^[IVXLC]+\.$"), label.rlike(r"^[A-Z]\.$"), label.rlike(r"^[0-9]{1,2}\.$")
    if scanned:
        return F.when(roman & ~label.rlike(r"^[A-H]\.$"), 2).when(letter, 3).when(number, 4).when(label.isNotNull(), 5)
    return F.when(roman & ~title.rlike(LOWER), 2).when(letter | number, 3).when(label.isNotNull(), 4)


def tolerance(letters: Column) -> Column:
    """How many letters of a scanned heading may differ from its entry: an eighth, three at least."""
    return F.greatest(F.lit(3), F.floor(F.length(letters) / 8 + 0.5).cast("int"))
