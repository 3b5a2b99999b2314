"""Order-dependent folds, as plain functions."""

import unicodedata
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import align, folios, idents
from quire.sources import html


def test_free_ids_meet_numbered_bases():
    assert idents.free_ids(["x", "x", "x-2", "x"]) == ["x", "x-2", "x-2-2", "x-3"]
    assert idents.free_ids(["x-2", "x", "x"]) == ["x-2", "x", "x-3"]


def test_strays():
    even = [(i, i + 10) for i in range(1, 9)]
    assert folios.stray_indexes(even) == set()
    assert folios.stray_indexes([*even[:4], (5, 99), *even[5:]]) == {5}
    assert folios.stray_indexes([(1, 50), (2, 12), (3, 13), (4, 14)]) == {1}
    assert folios.stray_indexes([]) == set()


def longest(values, strict=True):
    return max((len(c) for n in range(len(values) + 1) for c in combinations(values, n) if all(a < b for a, b in zip(c, c[1:], strict=False))), default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9))
def test_rising(values):
    for f in (align.rising, align.first_rising):
        at = f(values)
        assert at == sorted(at) and len(at) == longest(values)
        assert all(values[a] < values[b] for a, b in zip(at, at[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_common(a, b):
    got = align.common(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:], strict=False))
    subs = lambda x: {c for n in range(len(x) + 1) for c in combinations(x, n)}
    assert len(got) == max(map(len, subs(a) & subs(b)))


def test_align_finds_what_was_left_out():
    a = [f"w{i}" for i in range(60)]
    b = a[:20] + a[25:]
    got = align.align(a, b)
    assert got[:20] == list(range(20)) and got[20:25] == [-1] * 5 and got[25:] == list(range(20, 55))
    assert align.align([], b) == [] and align.align(a, []) == [-1] * 60


def test_html_events():
    got = list(html.events('<!-- x --><P Class="a&amp;b">1 &lt; 2 &eacute;&#150;&nope;<br/><script>if (a<b) {}</script> < </p>'))
    assert got == [
        ("start", "p", {"class": "a&b"}, None),
        ("text", None, None, "1 < 2 é–&nope;"),
        ("start", "br", {}, None),
        ("end", "br", None, None),
        ("text", None, None, " "),
        ("text", None, None, "<"),
        ("text", None, None, " "),
        ("end", "p", None, None),
    ]
    assert list(html.events("")) == []


def test_html_events_of_broken_pages():
    texts = lambda x: [(k, t or s) for k, t, _, s in html.events(x)]
    assert texts("a<!-- b") == [("text", "a")]
    assert texts("a<!doctype x>b<?y?>c") == [("text", "a"), ("text", "b"), ("text", "c")]
    assert texts("<SCRIPT src=x>if (a</b>) <p></script >t<style>u") == [("text", "t")]
    assert texts("<p" + " a" * 3000 + ">x") == [("text", "<"), ("text", "p" + " a" * 3000 + ">x")]
    assert texts("1 < 2") == [("text", "1 "), ("text", "<"), ("text", " 2")]
    assert list(html.events("<a HREF='x&amp;y' b=\"1\" c=d/e f g='h'/>"))[0][2] == {"href": "x&y", "b": "1", "c": "d/e", "f": "", "g": "h"}
    assert html.decode("&amp;lt; &#65;&#x41; &#151; &#9999999; &Eacute;&EACUTE; &bogus; &nbsp;. AT&T &lt") == "&lt; AA — &#9999999; Éé &bogus;  . AT&T <"


def test_html_events_of_anything():
    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from(["<", ">", "<p>", "</p>", "<br/>", "<!--", "-->", "<script>", "</script>", "a", " ", "&amp;", "<i x='>'"]), max_size=12))
    def run(parts):
        got = list(html.events("".join(parts)))
        assert all(k in ("start", "end", "text") for k, *_ in got) and all(s for k, _, _, s in got if k == "text")

    run()


def fnv(text):
    h = 0x811C9DC5
    raw = text.encode("utf-16-be")
    for hi, lo in zip(raw[::2], raw[1::2], strict=True):
        h = (h ^ (hi << 8 | lo)) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


def test_fingerprints(spark):
    from pyspark.sql import functions as F

    from quire.functions import text as T

    texts = ["a", "foobar", "é", "Ça va, naïve  Über!", "\U00020000", "ﬁ ǅ Ễ", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.fingerprint(F.col("t"))).collect()]

    def apart(t):
        return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in unicodedata.normalize("NFKD", t.lower()))

    assert got == [None if t is None else fnv(" ".join(apart(t).split())) for t in texts]
    assert got[:2] == ["e40c292c", "bf9cf968"] and got[4] == "b722598d"


def test_text_predicates(spark):
    from pyspark.sql import functions as F

    from quire.functions import text as T

    def of(f, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]

    url = lambda c: T.plausible_url(c, T.COMMON_DOMAINS, T.SECOND_LEVEL)
    assert of(url, ["two.ls", "www.levesoninquiry", "org.uk/wp-content/x", "nhs.uk", "a.mil", "guardian.co.uk", "http://x.fr", "x.fr", "ft.com/a-", None]) == [False, False, False, False, True, True, True, False, False, None]
    assert of(T.plain_words, ["OTHER/NUC (food/nutrition), http://a/b 1/2 it's[^3]", "", None]) == [["other", "nuc", "food", "nutrition", "httpab", "12", "its"], [], None]
    assert of(T.unfinished, ["It ends.", "at that time.”[^85-5]", "*it goes on*", "a bro-", "An end…", "", None]) == [False, False, True, True, False, True, None]
    assert of(T.citation, ["GS MBS-E-011184213", "PSI_QFR_GS0249", "OTSWMEF-0000031969", "UBS-CT 021485", "Hearing Exhibit 1", "In 2009 the bank", None]) == [True, True, True, True, True, False, None]
    assert of(T.html_word_count, ["<p>one <b>two</b></p>three", "", None]) == [3, 0, None]
    assert of(T.html_text_length, ["<p>one</p> <b>two</b>", None]) == [7, None]
    assert of(T.intro_length, ['<h2 id="a">Head\nof</h2>Text <a class="page-marker" href="#">12</a>on', None]) == [7, None]
    rows = ["a    b"] * 2 + ["plain line"] * 6
    assert of(T.tabular_page, ["\n".join(rows), "\n\n".join(rows[1:]), "\n".join(rows[1:] + ["x"]), None]) == [True, False, False, None]


def test_corrections_and_rejoin(spark):
    from quire.operators import notes, words

    blocks = spark.createDataFrame([("v", 1, "aa bb aa"), ("v", 2, "bb"), (None, None, None)], "vol string, printed long, text string")
    fixes = spark.createDataFrame([("one", "bb aa", None, None), ("two", "aa", "v", 1), ("none", "zz", None, None), ("scoped", "bb", None, 2)], "id string, find string, where_volume string, where_printed long")
    got = {r["id"]: (r["matches"], r["exactly_once"]) for r in notes.corrections(blocks, fixes, "vol", "printed").collect()}
    assert got == {"one": (1, True), "two": (2, False), "none": (0, False), "scoped": (1, True)}

    texts = spark.createDataFrame([("the infor- mation and re- elect co- op zz- yyy",)], "text string")
    vocab = spark.createDataFrame([("information", 3), ("re-elect", 2), ("reelect", 1), ("co-op", 1)], "word string, n long")
    spell = lambda **k: {r["head"]: r["spelling"] for r in words.rejoin(words.breaks(texts), vocab, **k).collect()}
    assert spell() == {"infor": "information", "re": "reelect", "co": "co-op", "zz": None}
    assert spell(majority=True)["re"] == "re-elect"
    assert spell(whole=spark.createDataFrame([("the",)], "word string"))["zz"] == "zzyyy"


def test_folds_over_empty_tables(spark):
    empty = spark.createDataFrame([], "source string, pdf_index long, printed long")
    assert folios.strays(empty, "source").count() == 0
    assert folios.fill_gaps(empty, "source").count() == 0
    assert idents.paragraph_ids(spark.createDataFrame([], "d long, o int, t string"), "d", "o", "t").count() == 0


def test_pages():
    from quire.operators import pages

    assert pages.take_folio(["a", "b", "", " 12 ", ""]) == (12, None, ["a", "b", "", ""])
    assert pages.take_folio(["", "7", "a"]) == (7, None, ["", "a"])
    assert pages.take_folio(["a", "12", "", "C"]) == (12, None, ["a", ""])
    assert pages.take_folio(["a", "C    12"]) == (12, None, ["a"])
    assert pages.take_folio(["a", "(3)"]) == (None, None, ["a", "(3)"]) and pages.take_folio(["a", "(3)"], paren=True)[0] == 3
    assert pages.take_folio(["a", "ix  ix"], roman=True) == (None, "ix", ["a"])
    assert pages.take_folio(["a", "iiii"], roman=True)[1] is None
    assert pages.take_folio([]) == (None, None, [])
    two = ["left column of text      right column of text"] * 9
    assert pages.gutter(two) is not None and two[0][slice(*pages.gutter(two))].strip() in ("", "t", "r", "t      r")
    assert pages.gutter(["one line of plain text that fills the width of the page"] * 20) is None and pages.gutter([]) is None


def test_columns_over_pages(spark):
    from pyspark.sql import functions as F

    from quire.operators import pages

    df = spark.createDataFrame([("a\n\nb\n\nc\n\n\n\nd\n\ne",), ("a\nb\nc\nd",), (None,)], "t string")
    assert [r[0] for r in df.select(pages.single_spaced(F.col("t"))).collect()] == ["a\nb\nc\n\nd\ne", "a\nb\nc\nd", None]
    df = spark.createDataFrame([("x (b)(6), (b)(7)(C) y",), (" (b)(3) ",), ("none",)], "t string")
    assert [r[0] for r in df.select(pages.redacted(F.col("t"))).collect()] == ["x [Redacted: (b) (6), (b) (7)(C)] y", None, "none"]
    assert df.select(pages.exemption_codes(F.col("t")).alias("c")).first()["c"] == ["(b) (6)", "(b) (7)(C)"]
    files = spark.createDataFrame([("k", i, n) for i, n in enumerate([5, 5, 9, 30, 1])], "k string, o long, n long")
    assert [r["batch"] for r in pages.batches(files, "k", "o", "n", 10).orderBy("o").collect()] == [0, 0, 1, 2, 3]


def test_merge_guards(spark):
    from pyspark.sql import functions as F

    from quire.functions import text as T
    from quire.operators import margins

    def of(f, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]

    assert of(T.ends_sentence, ["He left.", 'He said "go."', "See Mr.", "Donald J.", "and then", "as follows:", "(See p.", None]) == [True, True, False, False, False, True, False, None]
    assert of(T.introduces, ["He said:414", "suggested that:[^605]", "He said", "Done.", None]) == [True, True, False, True, None]
    assert of(T.caption, ["FIGURE 2.4: Wells", "Source: staff", "Figures show", " Fig. 3", None]) == [True, True, False, True, None]
    assert of(T.photo_credit, ["Mark Wilson/Getty Images", "Patrick Semansky/Associated Press", "a/B", "Mark Wilson/Getty,", "It was he/She.", None]) == [True, True, False, False, False, None]
    assert of(T.title_cased, ["The Capture of Ramzi bin al-Shibh", "The capture of one man", "One", None]) == [False, False, False, None]
    assert of(T.title_cased, ["The Capture of Ramzi Bin"]) == [True]
    assert of(margins.asterisks_apart, ["a\n* * *\nb", "a\n\n***\n\nb", "***\nb", "a\n ** \nb", None]) == ["a\n\n* * *\n\nb", "a\n\n***\n\nb", "***\n\nb", "a\n ** \nb", None]


def test_margins(spark):
    from quire.operators import margins

    numbered = "\n".join(["1.1   text here", "1.2   more text", "  1.3  other"])
    prose = "\n".join(["    four words or more"] * 16)
    rows = [("v", 1, numbered), ("v", 2, "no number"), ("v", 3, None), ("v", 4, prose), (None, 5, prose + "\n  out of the line"), ("w", 7, "\n".join(["x"] * 7 + ["  y"]))]
    pages = spark.createDataFrame(rows, "vol string, page long, text string")
    get = lambda df: {r["page"]: r["margin"] for r in df.collect()}
    assert get(margins.page_margins(pages, "vol", "page", fallback=9)) == {1: 6, 2: 9, 3: 9, 4: 4, 5: 4, 7: 0}
    assert get(margins.shifted_margins(pages, "vol", "page")) == {1: 0, 2: 0, 3: 0, 4: 4, 5: 0, 7: 0}
    assert get(margins.facing_margins(pages, "vol", "page", fallback=9)) == {1: 6, 2: 6, 3: 6, 4: 6, 5: 9, 7: 9}
    assert margins.page_margins(pages.limit(0), "vol", "page").count() == 0


def test_runs(spark):
    from quire.operators import runs

    said = ['"He goes', "", "on and on”", "- a", "b", None, "‘x", "y"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(said)], "page long, line_no int, line string")
    assert [r["opens"] for r in runs.open_quotations(lines, "page").orderBy("line_no").collect()] == [False, False, False, False, False, False, True, False]
    assert [r["run"] for r in runs.blank_runs(lines, "page").orderBy("line_no").collect()] == [1, None, 2, 2, 2, None, 3, 3]
    assert [r["inside"] for r in runs.runs_opened_by(lines, "page", "^on").orderBy("line_no").collect()] == [False, False, True, True, True, False, False, False]
    at = spark.createDataFrame([("v", i, p) for i, p in enumerate([5, None, 3, 9, None])], "v string, o int, p int")
    assert [r["p"] for r in runs.clamped(at, "v", "o", "p", 50).orderBy("o").collect()] == [3, 3, 3, 9, 50]
    a = spark.createDataFrame([("k", i, x) for i, x in enumerate("aabcd")], "k string, o int, v string")
    b = spark.createDataFrame([("k", 0, "c"), ("k", 1, "c")], "k string, o int, v string")
    assert [tuple(r) for r in runs.missing_first(a, b, "k", "o", "v", 3).collect()] == [("k", 4, ["a", "a", "b"])]
    for f in (runs.neighbours, runs.blank_runs, runs.open_quotations):
        assert f(lines.limit(0), "page").count() == 0
