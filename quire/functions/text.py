"""Column functions over lines and blocks of text. JVM-side only; whitespace and word classes are spelt out so that engines agree."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.sources.entities import decode_entities  # noqa: F401  part of this module's surface

SPACE = r"[ \t\n\r\f\x0B]"
#: Letters of one base letter and combining marks, by rule, with their base letters.
MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii() and d[0].isalpha() and all(map(unicodedata.combining, d[1:])))
BASES = "".join(unicodedata.normalize("NFKD", c)[0] for c in MARKED)

# Words that carry no meaning in a paragraph's id.
STOPWORDS = ["the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "with", "as", "is", "was", "were", "that", "this", "it", "he", "she", "they", "mr", "mrs", "ms"]

# Certain repairs of scanning errors, as (pattern, replacement); no word character may stand beside a match.
REPAIRS = [
    (r"0 (\d)/(\d{2})/(\d{4})", "0$1/$2/$3"),
    (r"(\d{1,2}) ?: ?(\d{2})", "$1:$2"),
    ("in tum", "in turn"),
    ("UnUed States", "United States"),
    ("ofthe", "of the"),
    ("inthe", "in the"),
    ("bo th", "both"),
    ("(?i:conceming)", "concerning"),
    ("fonn", "form"),
]

# What may be a scanning error, as (label, pattern, confidence, whether word borders must stand around it).
SUSPECTS = [
    ("possible rn/m confusion", r"\w*[a-z]rn[a-z]\w*", "possible", True),
    ("digit inside a word", r"[A-Za-z]*\d[A-Za-z]+", "likely", True),
    ("stray punctuation inside a word", r"[A-Za-z]{2,}[;!\\|][A-Za-z]{2,}", "likely", False),
    ("known OCR artefact", r"(?i:tum|modem|conceming|thc|fl-om|arid|bo th|ofthe|inthe|fonn)", "likely", True),
    ("case break inside a word", r"[a-z]{1,2}[A-Z][a-z]", "possible", None),
]
# Words that are no scanning errors.
SAFE = ["turn", "turned", "turning", "modern", "concerning", "the", "from", "and", "government", "governmental", "attorney", "internal", "external", "alternate", "alternative", "return", "returned", "returning", "journal", "journalist", "eternal", "paternal", "fraternal", "burn", "burned", "learn", "learned"]

# Top-level domains that a link without http:// or www. may end in, and second-level labels that are no site by themselves.
COMMON_DOMAINS = ["com", "org", "net", "gov", "edu", "mil", "int", "info", "biz", "io", "eu", "us", "uk"]
SECOND_LEVEL = ["co", "org", "gov", "ac", "com", "net", "edu", "ltd", "plc", "nhs", "sch", "me"]
# Words of letters that a slash joins are words of their own.
SLASHED = r"""^[("'‘“]*\p{L}+(?:/\p{L}+)+[)"'’”.,;:]*$"""
# What marks a note's own text as a citation.
CITATION = r"\b[A-Z]{2,}(?:[ _-][A-Z0-9]{1,12}){0,4}[ -]{0,2}[0-9]{4,}\b|Hearing Exhibit|Int\. Tr\.|HSC Tr\.|Subcommittee QFR"
# A column boundary, and the least lines with text and share of them that make a page a table.
ALIGNED, TABLE_LINES, TABLE_SHARE = r"[^ \t\n\r\f\x0B] {3,}[^ \t\n\r\f\x0B]", 8, 0.25


def normalise(t: Column) -> Column:
    """NBSP and U+FFFD to spaces, curly quotes to straight, runs of spaces and tabs to one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(t, " �‘’“”", "  ''\"\""), "[ \t]+", " "))


def plain_controls(t: Column) -> Column:
    """Control characters but tab, line feed and form feed become spaces."""
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0D-\x1F]", " ")


def indent(t: Column) -> Column:
    """Number of white characters that a line begins with."""
    return F.length(F.regexp_extract(t, f"^{SPACE}*", 0))


def chunks(t: Column) -> Column:
    """What stands between white characters."""
    return F.regexp_extract_all(t, F.lit(r"[^ \t\n\r\f\x0B]+"), 0)


def fold(t: Column) -> Column:
    """Lower case without marks."""
    return F.lower(F.translate(t, MARKED, BASES))


def tokens(t: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(t), F.lit(r"[\p{L}\p{N}]+"), 0)


def plain_words(t: Column) -> Column:
    """Words by ASCII letters and digits alone, as for comparing a source with what was made of it; null for null.

    A slash between letters parts two words; one in an address doesn't.
    """
    each = F.transform(chunks(F.lower(F.regexp_replace(t, r"\[\^\d+(-\d+)?\]:?", " "))), lambda w: F.when(w.rlike(SLASHED), F.split(w, "/")).otherwise(F.array(w)))
    bare = F.transform(F.flatten(each), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(bare, lambda w: w != "")


def furniture_key(t: Column) -> Column:
    """A line with its numbers masked."""
    return F.regexp_replace(normalise(t), r"\d+", "#")


def title_letters(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), "[^a-z0-9]", "")


def slug(t: Column) -> Column:
    bare = F.regexp_replace(F.lower(t), r"[^A-Za-z0-9_ \t\n\r\f\x0B-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(bare, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+", "-"), 1, 80)


def paragraph_id_base(t: Column) -> Column:
    """The first five words that carry meaning (or the first five words), joined by hyphens, of at most 60 characters."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(t), r"\[\^\d+(-\d+)?\]", " "), r"[^\p{L}\p{N} \t\n\r\f\x0B-]", " ")
    every = chunks(clean)
    told = F.filter(every, lambda w: ~w.isin(STOPWORDS))
    base = F.regexp_replace(F.substring(F.array_join(F.slice(F.when(F.size(told) >= 2, told).otherwise(every), 1, 5), "-"), 1, 60), "-+$", "")
    return F.when(base == "", F.lit("para")).otherwise(base)


def fingerprint_text(t: Column) -> Column:
    """Letters and digits in lower case with marks taken apart (each leaves a gap), one space between runs."""
    low = F.lower(t)
    apart = F.translate(F.regexp_replace(low, f"([{MARKED}])", "$1 "), MARKED, BASES)
    return F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " "))


def _fnv(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        plain = re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKD", text.lower())).strip(" ")
        h = 2166136261
        for unit in memoryview(plain.encode("utf-16-le", "surrogatepass")).cast("H"):
            h = (h ^ unit) * 16777619 & 4294967295
        return f"{h:08x}"

    return texts.map(one, na_action="ignore")


def fingerprint(t: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 units of a text's letters and digits (lower case, marks taken apart, one space between runs), as eight hex digits; null for null.

    A fold over characters runs faster over Arrow batches than as an interpreted expression.
    """
    return F.pandas_udf(_fnv, StringType())(t)


# What ends with a stop and is no sentence's end; a letter by itself is none either.
ABBREVIATION = r"(?i:(?<![A-Za-z0-9_])(mr|mrs|ms|dr|prof|sen|rep|gov|st|nos?|vs?|inc|co|corp|ltd|jr|sr|u\.s|e\.g|i\.e|cf|ch|art|sec|fig|para|pp?|ecf|tr)\.$)"
INITIAL = r"(?<![A-Za-z0-9_])[A-Z]\.$"
# Words that open a figure's or table's caption or source line.
CAPTION = r"(?i)^(?:figure|fig\.|table|chart|map|photo|source|image|exhibit|box|graph|diagram)(?![A-Za-z0-9_])"
# A byline of a name, a slash and a capital.
BYLINE = r"^[A-Z][A-Za-z0-9_.'’&-]*(?: [A-Za-z0-9_.'’&-]+){0,5}/[A-Z]"


def stripped(t: Column) -> Column:
    """Without white characters at either end."""
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def ends_sentence(t: Column) -> Column:
    """Whether a block ends with closing punctuation, past quotes and brackets, and not with an abbreviation or initial; null for null."""
    return F.regexp_replace(stripped(t), "[\"')\\]]+$", "").rlike("[.?!:;]$") & ~t.rlike(ABBREVIATION) & ~t.rlike(INITIAL)


def introduces(t: Column) -> Column:
    """Whether a block may stand before a quotation: a sentence's end, a note marker behind it or not; null for null."""
    return ends_sentence(t) | stripped(t).rlike(r"""[.?!:]["'”’)\]]*[ \t\n\r\f\x0B]?(?:[0-9]{1,4}|\[\^[0-9]+\])$""")


def caption(t: Column) -> Column:
    return stripped(t).rlike(CAPTION)


def photo_credit(t: Column) -> Column:
    """A short byline with a slash, no sentence; null for null."""
    s = stripped(t)
    return (F.length(s) <= 90) & ~ends_sentence(s) & s.rlike(BYLINE) & ~s.rlike("[,;]$")


def title_cased(t: Column) -> Column:
    """Whether of the words that begin with a letter, two at least, 60 % begin with a capital; null for null."""
    lettered = F.filter(chunks(t), lambda w: w.rlike("^[A-Za-z]"))
    return (F.size(lettered) >= 2) & (F.size(F.filter(lettered, lambda w: w.rlike("^[A-Z]"))) * 10 >= F.size(lettered) * 6)


def outside(pattern: str) -> str:
    """The pattern with no word character of ASCII beside it."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def repair(t: Column) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, outside(r[0]), r[1]), REPAIRS, t)


def repairs(t: Column) -> Column:
    """How many certain repairs apply, each counted on the text that the ones before it left."""
    total, now = F.lit(0), t
    for pattern, put in REPAIRS:
        total = total + F.regexp_count(now, F.lit(outside(pattern)))
        now = F.regexp_replace(now, outside(pattern), put)
    return total


def suspect_pattern(pattern: str, border: bool | None) -> str:
    if border is None:
        return rf"(?<![A-Za-z0-9_])(?:{pattern})"
    return outside(pattern) if border else pattern


def plausible_url(t: Column, common: list[str], second: list[str]) -> Column:
    """Whether a linkable text reads as an address: a dotted host, a likely top-level domain, not cut at a hyphen or an upload folder."""
    explicit = t.rlike(r"(?i)^(https?://|www\.)")
    host = F.lower(F.regexp_extract(F.regexp_replace(t, r"(?i)^[a-z][a-z0-9+.-]*://", ""), "^[^/?#:]*", 0))
    labels = F.split(host, r"\.")
    tld = F.element_at(labels, -1)
    cut = t.rlike("-$") | t.rlike(r"/wp-content/(uploads/(\d{4}/(\d{2}/)?)?)?$")
    suffix = (F.size(labels) == 2) & F.element_at(labels, 1).isin(second) & (F.length(tld) == 2)
    return ~cut & (F.size(labels) >= 2) & ~F.array_contains(labels, "") & ~suffix & (tld.isin(common) | (explicit & tld.rlike("^[a-z]{2}$")))


def unfinished(t: Column) -> Column:
    """Whether a text stops in mid sentence: no closing mark once note markers and emphasis are off, or a letter and a hyphen at its end. Null for null; an empty text does."""
    end = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(\[\^[^\]]*\])+$", ""), "[*_]+$", ""), f"{SPACE}+$", "")
    return ~end.rlike("[.?!:;\"')\\]’”…]$") | end.rlike("[a-z]-$")


def citation(t: Column) -> Column:
    """Whether a text reads as a note's citation: an identifier of capitals and a run of four digits or more, or the words of an exhibit. Null for null."""
    return t.rlike(CITATION)


def _without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def html_word_count(html: Column) -> Column:
    """Number of words outside tags; null for null."""
    return F.regexp_count(_without_tags(html), F.lit(r"[^ \t\n\r\f\x0B]+"))


def html_text_length(html: Column) -> Column:
    """Characters outside tags, runs of white characters being one and none at the ends; null for null."""
    return F.length(F.trim(F.regexp_replace(_without_tags(html), f"{SPACE}+", " ")))


def intro_length(html: Column) -> Column:
    """Characters of a section outside tags without its own heading and the page markers; null for null."""
    body = F.regexp_replace(html, r"(?s)^<h2\b.*?</h2>", "")
    return html_text_length(F.regexp_replace(body, r"""(?s)<a class="page-marker"[^>]*>.*?</a>""", ""))


def tabular_page(t: Column) -> Column:
    """Whether a page is laid out as a table: TABLE_LINES lines with text at least, and columns on TABLE_SHARE of them. Null for null."""
    shown = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\r\f\x0B]"))
    aligned = F.size(F.filter(shown, lambda x: x.rlike(ALIGNED)))
    return (F.size(shown) >= TABLE_LINES) & (aligned >= TABLE_SHARE * F.size(shown))


def without_notes(t: Column) -> Column:
    """A made text without its section of notes; null for null."""
    return F.regexp_replace(t, r"(?s)\n## Notes\n.*$", "\n")


def without_front(t: Column) -> Column:
    """A made text without its header; null for null."""
    return F.regexp_replace(t, r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")


def without_redactions(t: Column) -> Column:
    """A text with spaces for the labels of redactions; null for null."""
    return F.regexp_replace(t, r"\[Redacted(?::[^\]]*)?\]", " ")


def without_thumb(t: Column) -> Column:
    """A line with a space for the letter of a thumb index beside a note's number; null for null."""
    return F.regexp_replace(t, rf"^({SPACE}{{0,2}})[A-L](?={SPACE}{{2,}}[0-9]{{1,4}}(?:{SPACE}*$|{SPACE}{{2,}}[^ \t\n\r\f\x0B]))", "$1 ")


def source_pieces(t: Column) -> Column:
    """Words of a source cut at their punctuation, and after each word that a line's end parted (a dash behind, an apostrophe ahead, an address cut at its punctuation) what it makes with the next. Null for null."""
    raw = chunks(F.lower(F.regexp_replace(t, r"\[\^\d+(-\d+)?\]:?", " ")))

    def each(w: Column, ahead: Column) -> Column:
        cut = w.rlike("[-\u2013\u2014\u00ad]$") | ahead.rlike("^[\u2019']") | (w.rlike(r"https?:|www\.|/") & w.rlike("[/._=?&%#]$"))
        whole = F.when(ahead.isNotNull() & cut, F.regexp_replace(F.concat(w, ahead), "[^a-z0-9]", ""))
        return F.concat(F.split(w, "[^a-z0-9]+"), F.array(F.coalesce(whole, F.lit(""))))

    behind = F.slice(raw, 2, F.greatest(F.size(raw), F.lit(0)))  # beside it, as an index into the array would read the text anew for each word
    return F.filter(F.flatten(F.zip_with(raw, behind, each)), lambda w: w != "")
