"""Headings, printed numbers, page splits, merged sections and note markers, on made cases with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import headings, idents, notes, printed


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()
    return [tuple(r.x) if isinstance(r.x, tuple) else r.x for r in rows]


def test_headings(spark):
    lines = {
        "I. THE RESULTS OF THE INQUIRY": (2, "THE RESULTS OF THE INQUIRY"),
        "A. Pressure on State Officials": (3, "Pressure on State Officials"),
        "Part 4:  Why would anyone wish it": (2, "Part 4: Why would anyone wish it"),
        "Chapter 12 The Third Day 94": (3, "Chapter 12: The Third Day"),
        "INTRODUCTION 7": (2, "INTRODUCTION"),
        "ENDNOTES FOR CHAPTER 1": (2, "ENDNOTES FOR CHAPTER 1"),
        "Part 5 above, as the witness said.": None,
        "1. The Agency should examine each of the concerns": None,
        "THE FIRST DAY ..... 12": None,
        "THE FIRST DAY     12": None,
        "RISC": None,
        "G-BNWX": None,
        "TOTAL ASSETS 4500 USD": None,
        "THE BOARD SHALL REDE-": None,
        "ordinary words of a sentence": None,
        "": None,
        None: None,
    }
    assert column(spark, list(lines), headings.heading) == list(lines.values())
    assert column(spark, ["B. HE SAID SO", "LONG TITLE"], lambda t: headings.heading(t, capitals=False)) == [None, None]
    assert column(spark, ["Part 4: Why", "B. A Title Here"], lambda t: headings.heading(t, divisions=False, numbers=False)) == [None, None]


def test_guards(spark):
    assert column(spark, ["7.1 The witness", "10.14  On that day", "1.8 million people", "2.8 Second, later", "382. Mr B", None], headings.numbered_opening) == [True, True, False, True, False, None]
    assert column(spark, ["Results of the", "Results of the day", "", None], headings.dangles) == [True, False, False, None]
    assert column(spark, ["Response", "of the spill", "Response.", "The Oil Spill and the Coast", "It was a wet day", None], headings.heading_tail) == ["Response", None, None, "The Oil Spill and the Coast", None, None]
    assert column(spark, ["Floor 14", "tests 1997 to 2006", "The Day 31", None], headings.without_page) == ["Floor 14", "tests 1997 to 2006", "The Day", None]
    assert column(spark, ["(a) The “Day”...", "IV. THE DAY. .", "The day"], headings.heading_key) == ['the "day"', "the day", "the day"]
    assert column(spark, ["Findings", " Recommendation: ", "Issue  3", "Issue three", "Findings of fact", None], headings.division_label) == ["Findings", "Recommendation", "Issue 3", None, None, None]
    assert column(spark, ["a .... 1\nb ..... 22\nc ...... 3", "a .... 1\nb .... 2", "", None], headings.contents_page) == [True, False, False, None]
    assert column(spark, ["p. 3  A\n p. 32–33   B\np.4  C", "p. 3 A\np. 4 B\np. 5 C"], headings.illustration_list) == [True, False]
    kept = lambda t: headings.keeps_section(t, t == "Odd Title")
    assert column(spark, ["Odd Title", "Part 2: Days", "8.1 The Day", "Appendix B maps", "notes on chapter 3", "A Day"], kept) == [True, True, True, True, True, False]


def test_subheads_and_centre(spark):
    full = "In the spring of that year, the level of reporting rose to heights not seen before."
    lines = [None, "The Drumbeat Begins", full, "", "The Drumbeat Begins.", full, "", "  the Drumbeat", full, "", "The Drumbeat Begins", "short", "", " " * 34 + "FINDINGS OF FACT", ""]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "p int, line_no int, line string")
    got = headings.centred(headings.short_subheads(df, "p"), "p").orderBy("line_no").collect()
    assert [r.line_no for r in got if r.subhead] == [1] and [r.line_no for r in got if r.centred] == [13]
    assert headings.short_subheads(df.limit(0), "p").count() == 0


def prose(n):
    return f"{n}. The papers show that officers in the hall kept people away from the tunnel."


@pytest.mark.parametrize(
    "texts, marked",
    [
        (["Intro.", prose(1), prose(2), prose(3)], [1, 2, 3]),
        ([prose(1).replace(". ", ") ", 1), prose(2).replace(". ", ") ", 1)], [0, 1]),
        ([prose(1), "and so on to the end of the sentence.", prose(2), prose(4)], [0, 2, 3]),
        (["1. Setting up and preliminaries", "2. Visits", "3. Powers and remedies"], []),
        (["2. Fairness of Standards", prose(3), prose(4), prose(5)], [1, 2, 3]),
        (["A heading-like paragraph.", "2. role of the assessors"], []),
        (["it was found in the", "2. role of the assessors"], [1]),
        ([prose(1), "%%page 3%%", prose(2)], [0, 2]),
        ([prose(1), prose(9)], []),
        ([None, "", prose(1) + " " + prose(1)[3:]], [2]),
    ],
)
def test_printed_numbers(spark, texts, marked):
    df = spark.createDataFrame([(1, i, "page" if (x or "").startswith("%%") else "paragraph", x) for i, x in enumerate(texts)], "d int, o int, kind string, text string")
    got = printed.mark_numbers(df, "d", "o").where("printed_number").select("o").collect()
    assert sorted(r.o for r in got) == marked


def test_years_join(spark):
    df = spark.createDataFrame([(1, 0, "paragraph", "(second quarter", 5), (1, 1, "paragraph", "2008) was 16.1x", 6), (1, 2, "paragraph", None, 7), (2, 0, "paragraph", "It ended.", 8), (2, 1, "paragraph", "2008. It began.", 9)], "d int, o int, kind string, text string, joins_not int")
    got = printed.join_marked(printed.mark_numbers(df, "d", "o"), "d", "o").orderBy("d", "o").collect()
    assert [(r.text, r.printed_number, r.joins_not) for r in got] == [("(second quarter 2008) was 16.1x", False, 5), (None, False, 7), ("It ended.", False, 8), ("2008. It began.", True, 9)]


@pytest.mark.parametrize(
    "blocks, kinds",
    [
        (["deceit-knowingly false claims of", "%%page 3#2%%", "%%page 4#2%%", "fraud-and the papers show."], ["paragraph"]),
        (["had insight into the", "%%page 15%%", "> ultimate plan.", "Something else.", "the call was placed by", "%%page 16%%", "> Mr. M, who told them that", "the man wanted to talk."], ["quote", "skewQuote"]),
        (["election fraud.[^13]", "%%page 7%%", "and then."], []),
        (["He said that", "%%page 7%%", '> "we won."', "the memo listed", "%%page 8%%", "> - convene", "The statute provides:", "%%page 9%%", "> any person who"], []),
        (["It was", "and then", None, "%%page 9%%"], []),
        (["said to Mr", "%%page 2%%", "Trump that"], ["capitalised"]),
    ],
)
def test_page_splits(spark, blocks, kinds):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(blocks)], "d int, o int, text string")
    assert [r.kind for r in printed.page_splits(df, "d", "o").orderBy("o").collect()] == kinds


def part(level, title, n):
    return f"<h{level}>{title}</h{level}><p>{'word ' * (n // 5)}</p>"


def test_slivers():
    merge = lambda *parts: [re.findall("<h[23]>(.*?)</h", p) for p in idents.merge_slivers(list(parts))]
    long = lambda level, title, n=4000: part(level, title, n)
    assert merge(long(2, "A"), part(2, "b", 50), long(2, "C")) == [["A", "b"], ["C"]]
    assert merge(part(2, "b", 50), long(2, "C")) == [["b", "C"]]
    assert merge(long(2, "A"), part(2, "Part III: The Costs", 0), long(3, "9"), long(2, "10")) == [["A"], ["Part III: The Costs", "9"], ["10"]]
    assert merge(long(2, "A"), part(2, "Part III: The Costs", 400), long(3, "9", 6000), long(2, "10")) == [["A"], ["Part III: The Costs"], ["9"], ["10"]]
    assert merge(long(2, "A"), part(2, "Part III: The Costs", 400), part(3, "Opening", 300), long(3, "9", 3000)) == [["A"], ["Part III: The Costs", "Opening", "9"]]
    assert merge(long(2, "A"), part(2, "8", 0), long(3, "8.1 The Summer")) == [["A"], ["8", "8.1 The Summer"]]
    assert merge(long(2, "A"), part(2, "8", 0), long(3, "The Summer")) == [["A", "8"], ["The Summer"]]
    assert merge(long(2, "A"), part(2, "Planes", 300), long(3, "1.1 Aboard")) == [["A"], ["Planes", "1.1 Aboard"]]
    assert merge(long(2, "A"), part(2, "Foreword", 300), part(3, "Title", 300), long(2, "Chair")) == [["A"], ["Foreword", "Title"], ["Chair"]]
    assert merge(long(2, "A"), part(2, "Annex 1", 0)) == [["A", "Annex 1"]]
    assert merge() == [] and merge("  ") == [] and merge(part(2, "x", 5)) == [["x"]]


def test_merged_sections(spark):
    df = spark.createDataFrame([(1, "<p>a</p>" + part(2, "A", 4000) + part(2, "b", 10)), (2, ""), (3, None)], "page_id int, html string")
    got = idents.merged_sections(df, "page_id").collect()
    assert [(r.page_id, r.section) for r in got] == [(1, 0)] and got[0].body == df.first().html


LINKED = [
    ("relied on high risk loans. 1 In late 2006,", [1], "relied on high risk loans.[^1] In late 2006,"),
    ('he said it "would . . . . 7 In fact,', [7], 'he said it "would . . . .[^7] In fact,'),
    ("A. Their Work . . . . . . 1", [1], None),
    ("In the case of Long Beach, 75 out of 75 rated", [75], None),
    ("it ended.\n 18 wraps", [18], "it ended.[^18] wraps"),
    ("it ended.\n\n18 opens", [18], None),
    ("about 8,000 by 2009, 3 while at the same time", [3], "about 8,000 by 2009,[^3] while at the same time"),
    ("paragraphs 17, 19, 20 and 21", [19, 20], None),
    ("At 37 seconds, 45 seconds later", [45], None),
    ('250,000"; 152 days after that', [152], '250,000";[^152] days after that'),
    ("Co., 47 F.T.C. 1393 held", [47], None),
    ("the proceeds of a fraud. 47 The Court holds", [47], "the proceeds of a fraud.[^47] The Court holds"),
    ("(Paper 20395, May 2010). 112 Ibid. 113 Laurel", [112, 113], "(Paper 20395, May 2010).[^112] Ibid.[^113] Laurel"),
    ("of racketeering activity, 18 U.S.C. § 1961", [18], None),
    ("Moreover, 53 of the reviewers", [53], None),
    ("August 31, 2007 was", [2007], None),
    ("on Sept. 11 and 13", [11], None),
    ("made on 11, 13, and 19 March 2003", [13], None),
    ("On, 13 July 2011, they spoke", [13], None),
    ("told him the same. 10 On November 13,", [10], "told him the same.[^10] On November 13,"),
    ("the predecessor. 10\n\nJanuary 6, 2025\n\nNext.", [10], "the predecessor.[^10]\n\nJanuary 6, 2025\n\nNext."),
    ("Orders: 20 7219 3890", [20], None),
    ("See ECF No. 252 at 79.", [252], None),
    ("about 12,000 voters", [12], None),
    ("the same. 99 Next.", [10], None),
    ("the file. 0050 Next.", [50], None),
    ("", [1], ""),
]


def test_inline_markers(spark):
    df = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(LINKED)] + [(99, "so. 1 A", None), (100, None, [1])], "i int, t string, k array<int>")
    got = [r.x for r in df.select("i", notes.linked(F.col("t"), F.col("k")).alias("x")).orderBy("i").collect()]
    assert got == [t if want is None else want for t, _, want in LINKED] + ["so. 1 A", None]


def test_inline_markers_over_whole_documents(spark):
    """The query's rows against a scan by another pattern engine, over documents in which no context of the list stands."""
    from quire.plans import catalog

    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in catalog.Q["inline_markers"](spark, path).collect()}
    assert got.keys() == texts.keys()
    contexts = re.compile(r"(?ai)[0-9],|\b(?:" + "|".join(["nos?", "nn?", "pp?", "art", "ch", "sec", "para", "vol", "ex", "fig", "tbl", "id", "at", "see", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sept?", "oct", "nov", "dec"]) + r")\. |\. of |\. [A-Z]+\.")
    plain = 0
    for i, text in texts.items():
        if text is None or contexts.search(text) or re.search(r"[.,;:!?\"')]\s+[0-9]", text):
            continue
        plain += 1
        n = i % 9 + 1
        assert got[i] == text.replace(". ", f".[^{n}] " if n % 2 == 0 else f". {n} ")
    assert plain > 20
