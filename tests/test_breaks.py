"""Page breaks, a referee's answers, markers set flush, division numbers and tokens, on made cases with known answers."""

import hashlib
import hmac

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import breaks, headings, idents, notes

FACE = "struct<family:string,color:string,bold:boolean,italic:boolean,size:double,left:double,right_gap:double,label:boolean,text:string>"


def line(text="the next line of the text goes on", left=10.0, gap=0.1, label=False, size=10.0, family="a"):
    return (family, "k", False, False, size, left, gap, label, text)


BREAKS = [
    # before, after, above, below, left under, runs on, justified -> join, rule, indent, confidence
    ("it went on to the", "Court of that day", line(), line(), 10.0, True, False, (True, "R1", 0.0, "high")),
    ("it went on to the", "Court of that day", line(), line(), 10.0, False, False, (True, "R1", 0.0, "low")),
    ("it went on to the", "Court of that day", line(), line(left=15.0), 10.0, True, False, (True, "R1", 0.5, "low")),
    ("it went on to the", "Court of that day", line(), line(left=40.0), 10.0, True, False, (False, "split", 3.0, "high")),
    ("it went on to the", "court of that day", line(), line(left=40.0), 10.0, True, False, (True, "R1", 3.0, "high")),
    ("it went on to the", "Court of that day", line(), line(), None, True, False, (False, "split", None, "low")),
    ("June 25, 2001", "Thomas P", line(gap=9.0), line(), 10.0, True, False, (False, "split", 0.0, "low")),
    ("It ended.", "Court of that day", line(), line(), 10.0, True, True, (True, "R2", 0.0, "low")),
    ("It ended.46", "Court of that day", line(), line(), 10.0, True, False, (False, "split", 0.0, "medium")),
    ("It ended.", "Court of that day", line(), line(left=40.0), 10.0, True, True, (False, "split", 3.0, "high")),
    ("he told Mr.", "Court of that day", line(), line(), 10.0, True, False, (True, "R1", 0.0, "high")),
    ("it went on to the", "(b) the court", line(), line(), 10.0, True, False, (False, "split", None, "high")),
    ("it went on to the", "Court", line(), line(label=True), 10.0, True, False, (False, "split", None, "medium")),
    ("It ended.", "Court", line(), line(label=True), 10.0, True, False, (False, "split", None, "high")),
    ("what occurred in the", "24 hours before", line(), line("24 hours before", label=True), 10.0, True, False, (True, "R1", 0.0, "medium")),
    ("it went on to the", "court", line(), line(size=11.0), 10.0, True, False, (False, "split", None, "high")),
    ("it went on to the", "court", line(), line(family="b"), 10.0, True, False, (False, "split", None, "high")),
    (None, None, line(), line(), 10.0, None, None, (True, "R1", 0.0, "low")),
]


def test_decisions(spark):
    rows = [(i, *b[:7]) for i, b in enumerate(BREAKS)]
    df = spark.createDataFrame(rows, f"i int, before string, after string, above {FACE}, below {FACE}, under double, runs boolean, even boolean")
    decided = breaks.decide(*[F.col(c) for c in ("before", "after", "above", "below", "under", "runs", "even")])
    got = [tuple(r.d) for r in df.select("i", decided.alias("d")).orderBy("i").collect()]
    assert got == [b[7] for b in BREAKS]
    scan = breaks.decide(*[F.col(c) for c in ("before", "after", "above", "below", "under", "runs", "even")], scanned=True)
    assert df.where("i = 15").select(scan["join"]).first()[0]


def test_justified(spark):
    long = "x" * 30
    rows = [(1, g, True, long) for g in (0.1, -0.2, 0.3, 2.0, 3.0)] + [(1, 9.0, True, "short")] + [(2, g, True, long) for g in (0.1, 0.2, 0.6, 2.0, 3.0)] + [(3, 0.1, True, long)] * 4 + [(4, None, None, None)]
    df = spark.createDataFrame(rows, "page int, right_gap double, body boolean, text string")
    assert {r.page: r.justified for r in breaks.justified(df, "page").collect()} == {1: True, 2: False, 3: False, 4: False}
    assert breaks.justified(df.limit(0), "page").count() == 0


def test_answers(spark):
    said = 'Here: {"answers": [{"id": "c1", "answer": "JOIN"}, {"id": "c2", "answer": "JOIN"}, {"id": "c2", "answer": "SPLIT"}, {"id": "c3", "answer": "MAYBE"}]} done'
    df = spark.createDataFrame([(0, said), (1, "no json"), (2, "{not json}"), (3, None), (4, '{"answers": 3}')], "i int, t string")
    assert [r.a for r in df.select("i", breaks.answers(F.col("t")).alias("a")).orderBy("i").collect()] == [{"c1": True, "c2": False}, {}, {}, None, {}]


def test_flush_markers(spark):
    cases = [
        ("diarrhoea112 and childhood.1 Then", [1, 112], "diarrhoea[^112] and childhood.[^1] Then"),
        ("Section V.D.2 says", [2], "Section V.D.2 says"),
        ('in 2008.2847 and investors."2860', [2847, 2860], 'in 2008.[^2847] and investors."[^2860]'),
        ("childhood.1 Then", None, "childhood.1 Then"),
        (None, [1], None),
        ("", [1], ""),
    ]
    df = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(cases)], "i int, t string, k array<int>")
    got = df.select("i", notes.flush_linked(F.col("t"), F.col("k")).alias("f"), notes.sequence_linked(F.col("t"), F.col("k")).alias("s")).orderBy("i").collect()
    assert [r.f for r in got] == [c[2] for c in cases]
    assert [r.s for r in got[3:]] == ["childhood.1 Then", None, ""]


def test_sequenced_markers():
    near = set(range(1, 40))
    link = notes.sequenced_text
    assert link("It rose.1 It fell,”2 and stood.3", near) == "It rose.[^1] It fell,”[^2] and stood.[^3]"
    assert link("It rose.5 It fell.4 And.18 So.17", near) == "It rose.[^5] It fell.4 And.18 So.[^17]"
    assert link("See [^20] there.21 Then.3", near) == "See [^20] there.[^21] Then.3"
    assert link("about 3.5 million and 4.6 So", near) == "about 3.5 million and 4.[^6] So"
    assert link("## 2.1 A Day\nIt was .1 so", near) == "## 2.1 A Day\nIt was .1 so"
    assert link("", near) == "" and link("It rose.1", set()) == "It rose.1"


def test_labels(spark):
    cases = [("Part", "3", "3"), ("Part", "007", "7"), ("Part", "III", "3"), ("Part", "XIV", "14"), ("Chapter", "Three", "3"), ("Appendix", "C", "c"), ("Part", "C", "100"), ("Chapter", "on", None), ("Part", "", None), ("Part", None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind string, token string, want string")
    assert all(r.x == r.want for r in df.select("want", headings.division_number(F.col("kind"), F.col("token")).alias("x")).collect())
    df = spark.createDataFrame([(0, "V.", "THE PLAN"), (1, "I.", "The Plan"), (2, "II.", "The Plan"), (3, "(2)", "The Plan"), (4, "12.", "The Plan")], "i int, label string, title string")
    got = df.select("i", headings.outline_level(F.col("label"), F.col("title")).alias("x"), headings.outline_level(F.col("label"), F.col("title"), scanned=True).alias("y")).orderBy("i").collect()
    assert [(r.x, r.y) for r in got] == [(2, 2), (3, 2), (4, 2), (4, 5), (3, 4)]


def test_cuts(spark):
    df = spark.createDataFrame([("---\na: 1\n---\n\nText\n## Notes\n[^1]: x", "I   70", "a [Redacted: b6] c [Redacted]")], "t string, l string, r string")
    got = df.select(T.without_front(F.col("t")).alias("a"), T.without_notes(F.col("t")).alias("b"), T.without_thumb(F.col("l")).alias("c"), T.without_redactions(F.col("r")).alias("d")).first()
    assert tuple(got) == ("\nText\n## Notes\n[^1]: x", "---\na: 1\n---\n\nText\n", "    70", "a   c  ")


def test_tokens(spark):
    df = spark.createDataFrame([("report-a",), ("bericht-ü",), (None,)], "i string")
    for secret in ("s3cret", "k" * 100):
        got = df.select("i", idents.token(secret, F.col("i")).alias("t"), idents.authorised(secret, F.col("i"), idents.token(secret, F.lit("report-a"))).alias("ok")).collect()
        assert [r.t for r in got] == [hmac.new(secret.encode(), r.i.encode(), hashlib.sha256).hexdigest() if r.i else None for r in got]
        assert [r.ok for r in got] == [True, False, False]
    assert [r[0] for r in df.select(idents.authorised(None, F.col("i"), F.lit("x"))).collect()] == [False] * 3


def test_source_pieces(spark):
    df = spark.createDataFrame([(0, "re- joined word-play Don \u2019t"), (1, "see www.a.org/ page.[^3]"), (2, ""), (3, None)], "i int, t string")
    got = [r.p for r in df.select("i", T.source_pieces(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [["re", "rejoined", "joined", "word", "play", "don", "dont", "t"], ["see", "www", "a", "org", "wwwaorgpage", "page"], [], None]


def test_empty_corrections_match_nowhere(spark):
    df = spark.createDataFrame([("aaa", ""), ("aaa", "a"), ("aaa", None), (None, "a")], "t string, f string")
    assert [r.n for r in df.select(notes.occurrences_of(F.col("t"), F.col("f")).alias("n")).collect()] == [0, 3, None, None]
