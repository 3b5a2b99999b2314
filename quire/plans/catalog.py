"""Queries that apply the operators to the driver's tables, and the same rows in SQL.

Documents stand for pages and their sources for volumes; where the tables have
no input of a kind (page numbers, notes, corrections), it is made of key columns
by the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import align, breaks, folios, headings, idents, lines, margins, notes, printed, quality, runs, words
from quire.sources import entities, html

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WS = r"[ \t\n\r\f\x0B]"
NWS = r"[^ \t\n\r\f\x0B]+"


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        Q[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[name] = sql
        return f

    return add


# The functions of functions.text in SQL.
def q(s: str) -> str:
    return s.replace("'", "''")


def s_norm(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, '{chr(0xA0)}{chr(0xFFFD)}‘’“”', '  ''''\"\"'), '[ \\t]+', ' ', 'g'), ' ')"


def s_key(x: str) -> str:
    return f"regexp_replace({s_norm(x)}, '[0-9]+', '#', 'g')"


def s_words(x: str) -> str:
    split = f"list_transform(regexp_extract_all(lower(regexp_replace({x}, '\\[\\^\\d+(-\\d+)?\\]:?', ' ', 'g')), '{NWS}'), lambda w: CASE WHEN regexp_matches(w, '{q(T.SLASHED)}') THEN string_split(w, '/') ELSE [w] END)"
    return f"list_filter(list_transform(flatten({split}), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '')"


def s_fold(x: str) -> str:
    return f"lower(translate({x}, '{T.MARKED}', '{T.BASES}'))"


def s_base(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    every = f"regexp_extract_all(regexp_replace(regexp_replace(lower({x}), '\\[\\^\\d+(-\\d+)?\\]', ' ', 'g'), '[^\\p{{L}}\\p{{N}} \\t\\n\\r\\f\\x0B-]', ' ', 'g'), '{NWS}')"
    told = f"list_filter({every}, lambda w: w NOT IN ({stop}))"
    base = f"regexp_replace(substr(array_to_string((CASE WHEN len({told}) >= 2 THEN {told} ELSE {every} END)[1:5], '-'), 1, 60), '-+$', '')"
    return f"CASE WHEN {base} = '' THEN 'para' ELSE {base} END"


def s_print(x: str) -> str:
    return f"trim(regexp_replace(translate(regexp_replace(lower({x}), '([{T.MARKED}])', '\\1 ', 'g'), '{T.MARKED}', '{T.BASES}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def s_fnv(x: str) -> str:
    return f"lower(printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: CAST((CAST(xor(a, c) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT))))"


LINES = "l AS (SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"
EDGES = LINES + f""", sh AS (SELECT * FROM l WHERE regexp_matches(line, '[^ \\t\\n\\r\\f\\x0B]')),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 3 OR row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) <= 3 AS edge FROM sh),
k AS (SELECT source, key, count(*) AS n_pages FROM (SELECT DISTINCT source, doc_id, {s_key("line")} AS key FROM e WHERE edge) WHERE key <> '' GROUP BY source, key HAVING count(*) >= 3)"""


def doc_lines(t) -> DataFrame:
    return lines.explode(t("documents"), "doc_id", "source")


@query(f"WITH {LINES} SELECT doc_id, line_no, CAST(length(line) - length(regexp_replace(line, '^[ \\t\\n\\r\\f\\x0B]*', '')) AS BIGINT) AS indent, CAST(length(line) AS BIGINT) AS n_chars, {s_norm('line')} AS normal FROM l")
def lines_explode(t):
    line = F.col("line")
    return doc_lines(t).select("doc_id", "line_no", T.indent(line).cast("long").alias("indent"), F.length(line).cast("long").alias("n_chars"), T.normalise(line).alias("normal"))


@query(f"""WITH {LINES}, n AS (SELECT source, CAST(length(line) % 10 AS INTEGER) AS width, count(*) AS n_lines FROM l GROUP BY ALL)
SELECT source, width, n_lines FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_lines DESC, width) AS r FROM n) WHERE r = 1""")
def line_mode(t):
    return lines.mode(doc_lines(t).withColumn("width", F.length("line") % 10), ["source"], "width")


@query(f"WITH {EDGES} SELECT source, key, n_pages FROM k")
def repeated_edge_lines(t):
    return lines.furniture(doc_lines(t), "source", "doc_id")


@query(f"""WITH {EDGES}, g AS (SELECT e.doc_id, e.line_no FROM e JOIN k ON e.source = k.source AND {s_key("e.line")} = k.key WHERE e.edge)
SELECT l.doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id""")
def furniture_stripped(t):
    kept = lines.strip_furniture(doc_lines(t), "source", "doc_id")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, source, line_no, CAST(length(line) AS BIGINT) AS number FROM l),
w AS (SELECT source, line_no, CASE WHEN abs(number - lag(number) OVER p - (doc_id - lag(doc_id) OVER p)) <= 1 THEN 1 WHEN lag(doc_id) OVER p IS NOT NULL THEN 0 END AS ok FROM s WINDOW p AS (PARTITION BY source, line_no ORDER BY doc_id))
SELECT source, line_no, count(*) AS pairs, CAST(sum(ok) AS BIGINT) AS in_step, 2 * sum(ok) >= count(*) AS tracks FROM w WHERE ok IS NOT NULL GROUP BY source, line_no""")
def line_numbers_in_step(t):
    """The length of a line stands for a number at its place; every place of the whole texts is weighed."""
    at = doc_lines(t).select("source", "line_no", F.col("doc_id").alias("index"), F.length("line").cast("long").alias("number"))
    return lines.pages_in_step(at, ["source", "line_no"])


@query(f"""WITH {LINES}, a AS (SELECT doc_id, line_no, CASE WHEN length(line) > 200 THEN 1 ELSE 0 END AS x FROM l)
SELECT doc_id, line_no, x = 1 AS aligned, coalesce(max(x) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 1
  AND coalesce(max(x) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) = 1 AS tabular FROM a""")
def tabular_context(t):
    return lines.tabular_context(doc_lines(t), "doc_id", F.length("line") > 200).select("doc_id", "line_no", "aligned", "tabular")


SPACED = "concat(replace(text, chr(10), concat(chr(10), CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END)))"


@query(f"""WITH d AS (SELECT doc_id, source, {SPACED} AS text FROM documents), {LINES.replace("documents", "d")},
a AS (SELECT doc_id, line_no, regexp_matches(line, '[^ \\t\\n\\r\\f\\x0B]') AS s, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM l),
c AS (SELECT doc_id, count(*) FILTER (s) AS n_text, count(*) FILTER (s AND NOT regexp_matches(nx, '[^ \\t\\n\\r\\f\\x0B]')) AS n_gaps FROM a GROUP BY doc_id)
SELECT doc_id, n_text, n_gaps, n_text >= 3 AND n_gaps * 10 >= n_text * 6 AS double_spaced FROM c""")
def double_spaced(t):
    text = F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "\n\n").otherwise("\n"))
    return lines.double_spaced(lines.explode(t("documents").withColumn("text", text), "doc_id"), "doc_id")


@query(f"""WITH c AS (SELECT source, CAST(sum(len(regexp_extract_all(text, '{NWS}'))) AS BIGINT) AS n_words, CAST(sum(len(regexp_extract_all(text, '[0-9]'))) AS BIGINT) AS n_digits FROM documents GROUP BY source)
SELECT *, round(CASE WHEN n_words > 0 THEN n_digits / n_words * 1000 ELSE 0 END, 6) AS per_thousand, n_digits / n_words * 1000 >= 30 AS ok FROM c""")
def digit_density(t):
    return quality.digit_density(t("documents"), "source")


@query(f"""WITH {EDGES}, g AS (SELECT e.doc_id, e.line_no FROM e JOIN k ON e.source = k.source AND {s_key("e.line")} = k.key WHERE e.edge),
m AS (SELECT source, CAST(sum(len({s_words("line")})) AS BIGINT) AS made_words FROM (SELECT l.* FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.line_no = g.line_no) GROUP BY source),
o AS (SELECT source, CAST(sum(len({s_words("line")})) AS BIGINT) AS source_words FROM l GROUP BY source)
SELECT source, source_words, coalesce(made_words, 0) AS made_words, round(made_words / source_words, 6) AS retained, made_words / source_words > 0.9 AND made_words / source_words < 1.05 AS ok FROM o LEFT JOIN m USING (source)""")
def retention_ratio(t):
    at = doc_lines(t)
    return quality.retention(at, lines.strip_furniture(at, "source", "doc_id"), "source", text="line")


@query(f"""WITH m AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest({s_words("text")}) AS w FROM benchmark) GROUP BY w),
s AS (SELECT DISTINCT unnest({s_words("text")}) AS word FROM conversations) SELECT word, n FROM m ANTI JOIN s USING (word)""")
def lossless_foreign_words(t):
    return quality.foreign_words(t("benchmark"), t("conversations"))


@query(f"""WITH m AS (SELECT unnest({s_words("text")}) AS word FROM benchmark), s AS (SELECT DISTINCT unnest({s_words("text")}) AS word FROM documents)
SELECT count(*) AS n_words, count(*) FILTER (s.word IS NULL) AS n_foreign, count(*) FILTER (s.word IS NULL) / count(*) < 0.001 AS ok FROM m LEFT JOIN s USING (word)""")
def lossless_check(t):
    return quality.lossless(t("benchmark"), t("documents"))


MADE = "concat('# ', source, chr(10), '%%page ', doc_id % 40, '%%', chr(10), CASE WHEN doc_id % 5 = 0 THEN concat(doc_id % 100, chr(10)) ELSE '' END, replace(text, chr(10), CASE WHEN doc_id % 7 = 0 THEN concat(chr(10), '> ') ELSE concat(chr(10), '- ') END), chr(10), '[^', doc_id % 4, '] x [^2]', chr(10), '[^2]: note')"
MADE_SQL = f"md AS (SELECT doc_id, source, lang, {MADE} AS text FROM documents)"


def made(t) -> DataFrame:
    return t("documents").select("doc_id", "source", "lang", F.expr(MADE.replace("chr(10)", "char(10)")).alias("text"))


def s_count(pattern: str) -> str:
    return f"CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{pattern}'))) AS BIGINT)"


@query(f"""WITH {MADE_SQL} SELECT doc_id, {s_count('^[ \\t\\r\\f\\x0B]*[0-9]{1,4}[ \\t\\r\\f\\x0B]*$')} AS bare_numbers, CAST(len(regexp_extract_all(text, '\\f')) AS BIGINT) AS form_feeds,
CAST(len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0D-\\x1F\\x7F]')) AS BIGINT) AS controls, {s_count('^#{1,6}[ \\t]')} AS headings, {s_count('^[ \\t\\r]*%%page [^%]+%%[ \\t\\r]*$')} AS page_markers, regexp_matches(text, '\\n{{4,}}') AS blank_runs FROM md""".replace("{1,4}", "{1,4}"))
def structural_checks(t):
    return quality.structure(made(t), "doc_id")


@query(f"""WITH {MADE_SQL}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\^(\\d+(?:-\\d+)?)\\](?:[^:]|$)', 1)) AS label FROM md),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?m)^\\[\\^(\\d+(?:-\\d+)?)\\]:', 1)) AS label FROM md)
SELECT doc_id, label, count(*) AS n FROM r ANTI JOIN d USING (doc_id, label) GROUP BY doc_id, label""")
def unresolved_notes(t):
    return quality.unresolved_notes(made(t), "doc_id")


@query(f"""WITH {MADE_SQL}, {LINES.replace("documents", "md")},
a AS (SELECT doc_id, NOT regexp_matches(line, '^(#|>|-|%%|\\[\\^)') AS prose, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM l)
SELECT doc_id, count(*) FILTER (prose) AS n_paragraphs, count(*) FILTER (prose AND regexp_matches(nx, '^> [a-zà-ÿ]') AND NOT regexp_matches(line, '[.?!:;]["”]?$')) AS n_severed FROM a GROUP BY doc_id""")
def severed_sentences(t):
    return quality.severed(lines.explode(made(t), "doc_id"), "doc_id", "line_no", "line")


@query(f"""WITH {MADE_SQL} SELECT doc_id, sha256(text) AS sha, CAST(len(regexp_extract_all(text, '{NWS}')) AS BIGINT) AS words, {s_count('^#{1,6}[ \\t]')} AS headings, {s_count('^>[ \\t]')} AS quotes,
{s_count('^(>[ \\t])?-[ \\t]')} AS list_items, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(trim(x, ' '), '^([#>-]|%%page|\\[\\^)'))) AS BIGINT) AS paragraphs, {s_count('^[ \\t]*%%page [0-9]+%%[ \\t]*$')} AS page_markers FROM md""")
def baseline_counts(t):
    return quality.baseline(made(t), "doc_id")


@query(f"""WITH b AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '{NWS}')) AS BIGINT) AS words, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents WHERE doc_id % 10 <> 3),
a AS (SELECT doc_id, words + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS words, lines FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '{NWS}')) AS BIGINT) AS words, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents)),
x AS (SELECT doc_id, 'words' AS field, words AS v FROM b UNION ALL SELECT doc_id, 'lines', lines FROM b), y AS (SELECT doc_id, 'words' AS field, words AS v FROM a UNION ALL SELECT doc_id, 'lines', lines FROM a)
SELECT doc_id, field, coalesce(x.v, 0) AS before, coalesce(y.v, 0) AS after FROM x FULL JOIN y USING (doc_id, field) WHERE coalesce(x.v, 0) <> coalesce(y.v, 0)""")
def baseline_diff(t):
    now = t("documents").select("doc_id", F.size(T.chunks(F.col("text"))).cast("long").alias("words"), F.size(F.split("text", "\n")).cast("long").alias("lines"))
    later = now.withColumn("words", F.col("words") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0))
    return quality.baseline_diff(now.where("doc_id % 10 <> 3"), later, "doc_id", ["words", "lines"])


@query("""WITH e AS (SELECT quality AS k, count(*) AS n FROM labels GROUP BY 1), p AS (SELECT toxic AS k, count(*) AS n FROM labels GROUP BY 1)
SELECT k, least(coalesce(e.n, 0), coalesce(p.n, 0)) AS tp, greatest(coalesce(p.n, 0) - coalesce(e.n, 0), 0) AS fp, greatest(coalesce(e.n, 0) - coalesce(p.n, 0), 0) AS fn FROM e FULL JOIN p USING (k)""")
def score_precision_recall(t):
    n = F.count(F.lit(1)).alias("n")
    return quality.score(t("labels").groupBy(F.col("quality").alias("k")).agg(n), t("labels").groupBy(F.col("toxic").alias("k")).agg(n), ["k"])


# Words broken at the end of a line, made from every long word that stands before another.
BROKEN = "regexp_replace(text, '([a-z]{{4}})([a-z]{{3,9}}) ', '{}- {} '{})"
VOCAB_SQL = "SELECT regexp_replace(w, '^-+|-+$', '', 'g') AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ-]+')) AS w FROM {})"


@query(f"WITH v AS ({VOCAB_SQL.format('documents')}) SELECT word, count(*) AS n FROM v WHERE length(word) > 2 GROUP BY word")
def vocabulary_counts(t):
    return words.word_counts(t("documents"), whole=False)


def s_broken() -> str:
    return BROKEN.format("\\1", "\\2", ", 'g'")


@query(f"""WITH b AS (SELECT {s_broken()} AS text FROM documents), c AS (SELECT regexp_replace(text, '{words.BREAK}', ' ', 'g') AS text FROM b),
v AS ({VOCAB_SQL.format('c')}) SELECT word, count(*) AS n FROM v WHERE length(word) > 2 GROUP BY word""")
def whole_word_counts(t):
    broken = t("documents").select(F.regexp_replace("text", "([a-z]{4})([a-z]{3,9}) ", "$1- $2 ").alias("text"))
    return words.word_counts(broken)


@query(f"""WITH b AS (SELECT doc_id, {s_broken()} AS text FROM documents), u AS (SELECT regexp_replace(text, '{words.BREAK}', ' ', 'g') AS text FROM b), v AS (SELECT word, count(*) AS n FROM ({VOCAB_SQL.format('u')}) WHERE length(word) > 2 GROUP BY word),
x AS (SELECT unnest(regexp_extract_all(text, '{words.BREAK}')) AS whole FROM b),
y AS (SELECT regexp_extract(whole, '{words.BREAK}', 1) AS head, regexp_extract(whole, '{words.BREAK}', 2) AS tail FROM x)
SELECT CASE WHEN j.word IS NOT NULL THEN head || tail WHEN h.word IS NOT NULL THEN head || '-' || tail END AS spelling, count(*) AS n
FROM y LEFT JOIN v j ON lower(head || tail) = j.word LEFT JOIN v h ON lower(head || '-' || tail) = h.word GROUP BY 1""")
def hyphens_rejoined(t):
    """Broken words of documents, spelt by the words that stand unbroken in documents."""
    broken = t("documents").select("doc_id", F.regexp_replace("text", "([a-z]{4})([a-z]{3,9}) ", "$1- $2 ").alias("text"))
    out = words.rejoin(words.breaks(broken, "doc_id"), words.word_counts(broken))
    return out.groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))


FAULTY = "concat(replace(replace(text, ' the ', ' ofthe '), ' in ', ' in tum '), ' 12 : 30 on 0 ', doc_id % 9 + 1, '/11/2001, Conceming bo th fonn; inthe x1y aBcd governmnt intern pa;rt')"


def faulty(t) -> DataFrame:
    return t("documents").select("doc_id", F.expr(FAULTY).alias("text"))


def s_repairs() -> str:
    n, now = "0", "text"
    for p, r in T.REPAIRS:
        p = rf"\b(?:{p})\b"
        n, now = f"{n} + len(regexp_extract_all({now}, '{p}'))", f"regexp_replace({now}, '{p}', '{r.replace('$', chr(92))}', 'g')"
    return f"CAST({n} AS BIGINT) AS n_repairs, md5({now}) AS repaired"


@query(f"WITH f AS (SELECT doc_id, {FAULTY} AS text FROM documents) SELECT doc_id, {s_repairs()} FROM f")
def repair_counts(t):
    return faulty(t).select("doc_id", T.repairs(F.col("text")).cast("long").alias("n_repairs"), F.md5(T.repair(F.col("text"))).alias("repaired"))


def s_suspects() -> str:
    each = []
    for label, p, sure, border in T.SUSPECTS:
        p = p.replace("(?i:", "(?i:")
        p = rf"\b(?:{p})\b" if border else (rf"\b(?:{p})" if border is None else p)
        each.append(f"SELECT '{label}' AS label, '{sure}' AS confidence, unnest(regexp_extract_all(text, '{p}')) AS match FROM f")
    safe = ", ".join(f"'{w}'" for w in T.SAFE)
    return " UNION ALL ".join(each), safe


@query(f"""WITH f AS (SELECT doc_id, {FAULTY} AS text FROM documents), s AS ({s_suspects()[0]}), n AS (SELECT label, confidence, match, count(*) AS n FROM s WHERE lower(match) NOT IN ({s_suspects()[1]}) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY confidence ORDER BY n DESC, label, match) AS INTEGER) AS place FROM n""")
def suspects_ranked(t):
    return words.ranked_suspects(words.suspects(faulty(t), "doc_id"))


@query(f"SELECT doc_id, {s_base('text')} AS base, {s_fold('text')} AS folded FROM documents")
def paragraph_bases(t):
    return t("documents").select("doc_id", T.paragraph_id_base(F.col("text")).alias("base"), T.fold(F.col("text")).alias("folded"))


@query()
def paragraph_ids(t):
    return idents.paragraph_ids(doc_lines(t), "doc_id", "line_no", "line")


@query(f"WITH {LINES} SELECT doc_id, line_no, {s_fnv(s_print('line'))} AS fingerprint FROM l")
def fingerprints(t):
    return doc_lines(t).select("doc_id", "line_no", T.fingerprint(F.col("line")).alias("fingerprint"))


@query(f"""WITH p AS (SELECT doc_id, source, {s_print("text")} AS x FROM documents), f AS (SELECT doc_id, source, CASE WHEN x <> '' AND doc_id % 4 <> 1 THEN {s_fnv("x")} END AS fingerprint FROM p)
SELECT source, doc_id, fingerprint, coalesce(first_value(fingerprint IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS next FROM f""")
def next_fingerprints(t):
    at = t("documents").select("source", "doc_id", F.when(F.col("doc_id") % 4 != 1, F.col("text")).otherwise("").alias("text"))
    return idents.fingerprints(at, "source", "doc_id").drop("text")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_force FROM events""")
def page_in_force(t):
    at = t("events").select("event_id", "user_id", F.when(F.col("event_type") == "click", F.col("event_id")).alias("v"))
    return folios.in_force(at, "user_id", "event_id", "v").drop("v")


@query("""WITH m AS (SELECT source, CAST(doc_id AS VARCHAR) || '.html' AS path, sha256(text) AS hash FROM documents)
SELECT source, count(*) AS n_files, substr(sha256(string_agg(length(path) || ':' || path || ':' || hash, chr(10) ORDER BY path)), 1, 16) AS version FROM m GROUP BY source""")
def manifest_versions(t):
    files = t("documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), "text")
    return idents.content_hash(idents.manifest(files, "source", body="text"), "source")


@query("""WITH m AS (SELECT source, CASE WHEN doc_id % 50 = 0 THEN 'meta.json' WHEN doc_id % 50 = 7 THEN '../x' ELSE 'fragments/' || doc_id || '.html' END AS path, CASE WHEN doc_id % 11 = 0 THEN 'none' ELSE sha256(text) END AS hash FROM documents),
a AS (SELECT source, count(*) FILTER (NOT (path IN ('meta.json', 'full-body.html') OR regexp_matches(path, '^fragments/[A-Za-z0-9_-]{1,120}\\.html$'))) AS a, count(*) FILTER (NOT regexp_matches(hash, '^[0-9a-f]{64}$')) AS b, count(*) - count(DISTINCT path) AS c,
 CASE WHEN bool_or(path = 'meta.json') THEN 0 ELSE 1 END AS d, CASE WHEN bool_or(path = 'full-body.html') THEN 0 ELSE 1 END AS e, CASE WHEN bool_or(starts_with(path, 'fragments/')) THEN 0 ELSE 1 END AS f FROM m GROUP BY source)
SELECT source, problem, CAST(n AS BIGINT) AS n FROM (SELECT source, unnest(['bad path', 'bad digest', 'path twice', 'no meta.json', 'no full-body.html', 'no fragments']) AS problem, unnest([a, b, c, d, e, f]) AS n FROM a) WHERE n > 0""")
def manifest_problems(t):
    path = F.expr("CASE WHEN doc_id % 50 = 0 THEN 'meta.json' WHEN doc_id % 50 = 7 THEN '../x' ELSE 'fragments/' || doc_id || '.html' END")
    at = t("documents").select("source", path.alias("path"), F.when(F.col("doc_id") % 11 == 0, "none").otherwise(F.sha2("text", 256)).alias("hash"))
    return idents.manifest_problems(at, "source")


# Page numbers: sources are volumes, and documents their pages in order; some are misread, some unread.
READS = "r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pdf_index, doc_id FROM documents), reads AS (SELECT source, pdf_index, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN pdf_index + 40 WHEN pdf_index > 30 THEN pdf_index + 12 ELSE pdf_index + 10 END AS printed FROM r)"


def reads(t) -> DataFrame:
    from pyspark.sql import Window as W

    at = t("documents").select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long").alias("pdf_index"))
    return at.select("source", "pdf_index", F.expr("CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN pdf_index + 40 WHEN pdf_index > 30 THEN pdf_index + 12 ELSE pdf_index + 10 END").alias("printed"))


@query(f"""WITH {READS}, o AS (SELECT *, printed - pdf_index AS "offset" FROM reads WHERE printed IS NOT NULL),
n AS (SELECT *, CASE WHEN "offset" = lag("offset") OVER (PARTITION BY source ORDER BY pdf_index) THEN 0 ELSE 1 END AS nw FROM o), g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY source ORDER BY pdf_index) AS BIGINT) AS run FROM n)
SELECT source, run, "offset", min(pdf_index) AS from_pdf, max(pdf_index) AS to_pdf, count(*) AS n_reads, min(printed) AS first_printed, max(printed) AS last_printed FROM g GROUP BY source, run, "offset" """)
def folio_runs(t):
    return folios.offset_runs(reads(t), "source")


@query()
def folio_strays(t):
    return folios.strays(reads(t), "source")


@query(f"""WITH {READS}, k AS (SELECT * FROM reads WHERE printed IS NOT NULL), n AS (SELECT *, lead(pdf_index) OVER w AS i, lead(printed) OVER w AS p FROM k WINDOW w AS (PARTITION BY source ORDER BY pdf_index))
SELECT source, pdf_index, printed, false AS inferred FROM k UNION ALL
SELECT source, x, printed - pdf_index + x, true FROM (SELECT *, unnest(generate_series(pdf_index + 1, i - 1)) AS x FROM n WHERE i - pdf_index > 1 AND p - printed = i - pdf_index)""")
def folio_gaps(t):
    return folios.fill_gaps(reads(t), "source")


@query("SELECT event_id, CASE WHEN n > 1 THEN CAST(n AS INTEGER) END AS occurrence FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)")
def occurrence_numbers(t):
    return folios.occurrences(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "occurrence")


@query("""WITH d AS (SELECT DISTINCT user_id, event_id AS n FROM events), g AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM d), r AS (SELECT user_id, min(n) AS first, count(*) AS length FROM g GROUP BY user_id, k)
SELECT user_id, first, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) AS p FROM r) WHERE p = 1""")
def consecutive_runs(t):
    return folios.longest_run(t("events").select("user_id", F.col("event_id").alias("n")), "user_id")


def s_grams(table: str, key: str) -> str:
    w = f"regexp_extract_all({s_fold('text')}, '[\\p{{L}}\\p{{N}}]+')"
    return f"SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, array_to_string(w[i:i+6], ' ') AS gram FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 6)) AS i FROM (SELECT {key}, {w} AS w FROM {table}))"


@query(f"""WITH a AS ({s_grams('documents', 'doc_id')}), b AS ({s_grams('benchmark', 'item_id')}), x AS (SELECT gram, first(doc_id) AS doc_id, first(pos) AS a_pos FROM a GROUP BY gram HAVING count(*) = 1),
y AS (SELECT gram, first(item_id) AS item_id, first(pos) AS b_pos FROM b GROUP BY gram HAVING count(*) = 1) SELECT doc_id, a_pos, item_id, b_pos FROM x JOIN y USING (gram)""")
def unique_anchors(t):
    return align.anchors(t("documents"), t("benchmark"), "doc_id", "item_id")


@query()
def anchor_chains(t):
    return align.chained(align.anchors(t("documents"), t("benchmark"), "doc_id", "item_id"), ["doc_id", "item_id"])


@query(f"""WITH a AS (SELECT DISTINCT unnest({s_words('text')}) AS a FROM benchmark), b AS (SELECT DISTINCT unnest({s_words('text')}) AS b FROM conversations),
j AS (SELECT a, b, levenshtein(a, b) AS d FROM a JOIN b ON substr(a, 1, 3) = substr(b, 1, 3) WHERE length(a) >= 8 AND abs(length(a) - length(b)) <= length(a) // 8), k AS (SELECT * FROM j WHERE d <= length(a) // 8),
m AS (SELECT a, min(d) AS d FROM k GROUP BY a) SELECT a, min(b) AS b, CAST(d AS BIGINT) AS d FROM k JOIN m USING (a, d) GROUP BY a, d HAVING count(*) = 1""")
def near_words(t):
    w = lambda name: t(name).select(F.explode(T.plain_words(F.col("text"))).alias("word"))
    return align.near_words(w("benchmark"), w("conversations"))


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_orderkey AS note FROM lineitem l JOIN (SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS INTEGER) AS n FROM orders) o ON l.l_linenumber = o.n AND o.o_orderkey BETWEEN l.l_orderkey - 1 AND l.l_orderkey + 1""")
def note_band_join(t):
    marks = t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"))
    defs = t("orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("n"))
    return notes.near_page(marks, defs, ["n"]).select(F.col("page").alias("l_orderkey"), F.col("n").alias("l_linenumber"), F.col("note_page").alias("note"))


@query("""WITH r AS (SELECT user_id, event_id AS ref_order, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'click'),
d AS (SELECT user_id, event_id AS def_order, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'click')
SELECT r.user_id, ref_order, def_order FROM r JOIN d ON r.user_id = d.user_id AND least(r.k, d.n) = d.k""")
def note_ordinal_join(t):
    e = t("events")
    return notes.in_order(e.where("event_type <> 'click'"), e.where("event_type = 'click'"), "user_id", "event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def orphan_notes(t):
    return notes.orphans(t("customer").select("c_custkey", "c_name"), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


FIXES = "SELECT item_id AS id, substr(text, 5, 40) AS find, CASE WHEN item_id % 2 = 0 THEN 'src' || item_id % 20 END AS where_volume, CAST(NULL AS BIGINT) AS where_printed FROM benchmark"


@query(f"""WITH f AS ({FIXES}), m AS (SELECT id, sum(CAST((length(text) - length(replace(text, find, ''))) / length(find) AS BIGINT)) AS n FROM documents JOIN f ON (where_volume IS NULL OR where_volume = source) AND contains(text, find) GROUP BY id)
SELECT id, CAST(coalesce(n, 0) AS BIGINT) AS matches, coalesce(n, 0) = 1 AS exactly_once FROM f LEFT JOIN m USING (id)""")
def corrections_exactly_once(t):
    fixes = t("benchmark").selectExpr("item_id AS id", "substr(text, 5, 40) AS find", "CASE WHEN item_id % 2 = 0 THEN 'src' || item_id % 20 END AS where_volume", "CAST(NULL AS BIGINT) AS where_printed")
    return notes.corrections(t("documents"), fixes, "source", "doc_id")


@query("""WITH c AS (SELECT conv_id, turn, substr(sha256(text), 1, 16) AS key, turn % 2 = 0 AS rule FROM conversations), a AS (SELECT DISTINCT key, true AS x FROM c WHERE turn % 3 = 0)
SELECT conv_id, turn, c.key AS key, x IS NOT NULL AS cached, coalesce(x, rule) AS "join" FROM c LEFT JOIN a ON c.key = a.key""")
def referee_cache(t):
    cases = t("conversations").withColumn("rule", F.col("turn") % 2 == 0)
    cache = cases.where("turn % 3 = 0").select(notes.request_key(F.col("text")).alias("key"), F.lit(True).alias("join")).distinct()
    return notes.decided(cases, cache, "text", "rule").select("conv_id", "turn", "key", "cached", "join")


TAGS = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>"
HIDDEN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script[^>]*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style[^>]*>', '', 'g'), '<[!?][^>]*>', '', 'g')"


@query(f"""WITH x AS (SELECT page_id, unnest(regexp_extract_all({HIDDEN}, '{TAGS}')) AS tag FROM pages)
SELECT CASE WHEN starts_with(tag, '</') THEN 'end' ELSE 'start' END AS kind, lower(regexp_extract(tag, '{TAGS}', 2)) AS tag, count(*) AS n FROM x GROUP BY ALL""")
def html_tag_counts(t):
    return html.html_events(t("pages")).where("kind <> 'text'").groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("n"))


def s_decode(x: str) -> str:
    for name in entities.COMMON:
        x = f"replace({x}, '&{name};', '{q(entities.named(name))}')"
    return x


@query(f"SELECT page_id, trim(regexp_replace({s_decode('regexp_replace(' + HIDDEN + ', ' + repr('<[^>]+>') + ', ' + repr(' ') + ', ' + repr('g') + ')')}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ') AS text FROM pages")
def html_text(t):
    return t("pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("""WITH s AS (SELECT page_id, replace(replace(html, '<p>', '<h2>Part</h2><p id="x-1" data-page="4">'), '<br>', '<h3>a</h3>') AS html FROM pages),
m AS (SELECT page_id, html, regexp_replace(html, '<h([23])', chr(1) || '<h\\1', 'g') AS c FROM s)
SELECT page_id, CAST(len(list_filter(string_split(c, chr(1)), lambda x: trim(x, ' ') <> '')) AS BIGINT) AS n_sections, CAST(len(regexp_extract_all(html, '<h2>')) AS BIGINT) AS n_parts FROM m""")
def section_split(t):
    at = t("pages").select("page_id", F.expr("""replace(replace(html, '<p>', '<h2>Part</h2><p id="x-1" data-page="4">'), '<br>', '<h3>a</h3>')""").alias("html"))
    out = idents.sections(at, "page_id")
    return out.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if((F.col("level") == 2) & (F.col("title") == "Part")).alias("n_parts"))


COMMON_TLDS = T.COMMON_DOMAINS
SECOND = T.SECOND_LEVEL


@query(f"""WITH h AS (SELECT page_id, url, lower(regexp_extract(regexp_replace(url, '(?i)^[a-z][a-z0-9+.-]*://', ''), '^[^/?#:]*')) AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS p FROM h)
SELECT page_id, NOT (regexp_matches(url, '-$') OR regexp_matches(url, '/wp-content/(uploads/(\\d{{4}}/(\\d{{2}}/)?)?)?$')) AND len(p) >= 2 AND NOT list_contains(p, '') AND NOT (len(p) = 2 AND p[1] IN ({', '.join(f"'{x}'" for x in SECOND)}) AND length(p[-1]) = 2)
 AND (p[-1] IN ({', '.join(f"'{x}'" for x in COMMON_TLDS)}) OR (regexp_matches(url, '(?i)^(https?://|www\\.)') AND regexp_matches(p[-1], '^[a-z]{{2}}$'))) AS plausible FROM l""")
def url_plausible(t):
    return t("pages").select("page_id", T.plausible_url(F.col("url"), COMMON_TLDS, SECOND).alias("plausible"))


@query(f"SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9_ \\t\\n\\r\\f\\x0B-]', '', 'g'), '^{WS}+|{WS}+$', '', 'g'), '{WS}+', '-', 'g'), 1, 80) AS slug, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS letters FROM documents")
def slugs(t):
    return t("documents").select("doc_id", T.slug(F.col("text")).alias("slug"), F.md5(T.title_letters(F.col("text"))).alias("letters"))


# Blocks: the lines of a document by turns as headings, quotes, list items, contents, page markers and paragraphs.
KIND = "CASE (doc_id + line_no) % 7 WHEN 0 THEN 'heading' WHEN 1 THEN 'quote' WHEN 2 THEN 'list' WHEN 3 THEN 'contents' WHEN 4 THEN 'page' ELSE 'paragraph' END"


@query(f"""WITH {LINES}, b AS (SELECT doc_id, line_no, line, {KIND} AS kind, CASE WHEN doc_id % 2 = 0 THEN concat('12. ', line) ELSE concat('# ', line) END AS t FROM l),
m AS (SELECT doc_id, line_no, CASE kind WHEN 'heading' THEN concat('## ', line) WHEN 'quote' THEN concat('> ', regexp_replace(t, '^(#{{1,6}})([ \\t]|$)', '\\\\\\1\\2')) WHEN 'contents' THEN concat('- ', line, ' — ', line_no)
 WHEN 'page' THEN concat('%%page ', line_no, CASE WHEN line_no % 2 = 0 THEN concat('#', 2) ELSE '' END, '%%') WHEN 'list' THEN concat('> - ', line, chr(10), '> - ', 'end')
 ELSE regexp_replace(regexp_replace(t, '^(#{{1,6}})([ \\t]|$)', '\\\\\\1\\2'), '^(\\d+)([.)])', '\\1\\\\\\2') END AS md FROM b)
SELECT doc_id, concat(rtrim(regexp_replace(concat('---', chr(10), 'source: "', d.source, '"', chr(10), 'pages: ', doc_id % 9, chr(10), '---', chr(10), chr(10), x.md), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), chr(10) || ' '), chr(10)) AS markdown
FROM documents d JOIN (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY line_no) AS md FROM m GROUP BY doc_id) x USING (doc_id)""")
def blocks_markdown(t):
    from quire.operators import blocks

    at = doc_lines(t).withColumn("kind", F.expr(KIND)).withColumn("t", F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('12. ', line) ELSE concat('# ', line) END"))
    text = F.when(F.col("kind").isin("heading", "contents"), F.col("line")).otherwise(F.col("t"))
    md = blocks.block_markdown(F.col("kind"), text, F.array("line", F.lit("end")), F.lit(2), F.col("line_no").cast("string"), F.when(F.col("line_no") % 2 == 0, 2), F.lit(True), F.lit(True), escape_hash=True)
    body = blocks.joined(at.select("doc_id", "line_no", md.alias("md")), "doc_id", "line_no", "md")
    head = blocks.front_matter({"source": F.col("source"), "pages": F.col("doc_id") % 9, "none": F.lit(None).cast("string")}, {"pages"})
    return t("documents").select("doc_id", "source").join(body, "doc_id").select("doc_id", blocks.document(head, F.col("md"), F.lit(None).cast("string")).alias("markdown"))


@query("""WITH n AS (SELECT conv_id, turn, CAST(turn // 2 AS VARCHAR) AS label, role AS text, turn % 5 = 3 AS restart FROM conversations),
s AS (SELECT *, CASE WHEN lag(label) OVER w IS NOT DISTINCT FROM label AND NOT restart AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw, lag(text) OVER w AS before FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM s)
SELECT conv_id, min(turn) AS turn, first(label) AS label, string_agg(text, ' ' ORDER BY turn) FILTER (nw = 1 OR before IS DISTINCT FROM text) AS text FROM r GROUP BY conv_id, run""")
def endnotes_merged(t):
    from quire.operators import blocks

    at = t("conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).cast("string").alias("label"), F.col("role").alias("text"), (F.col("turn") % 5 == 3).alias("restart"))
    return blocks.merged_notes(at, "conv_id", "turn")


def numbered_pages(t) -> DataFrame:
    return t("documents").select("doc_id", F.expr("CASE doc_id % 6 WHEN 0 THEN concat(text, '\n\n', doc_id % 300) WHEN 1 THEN concat('  ', doc_id % 300, '\n', text) WHEN 2 THEN concat(text, '\n xiv \n') WHEN 3 THEN concat(text, '\nB   ', doc_id % 300) WHEN 4 THEN concat(text, '\n(', doc_id % 300, ')') ELSE text END").alias("text"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 3, 4) THEN CAST(doc_id % 300 AS INTEGER) END AS printed, CASE WHEN doc_id % 6 = 2 THEN 'xiv' END AS roman,
 CASE doc_id % 6 WHEN 0 THEN text || chr(10) WHEN 2 THEN text || chr(10) ELSE text END AS body FROM documents) SELECT doc_id, printed, roman, md5(body) AS body FROM p""")
def folios_taken(t):
    from quire.operators import pages

    return pages.folios(numbered_pages(t), "doc_id", paren=True, roman=True).withColumn("body", F.md5("body"))


@query()
def page_gutters(t):
    from quire.operators import pages

    # The whole text in two columns of 25 characters, the left one first.
    cut = t("documents").select("doc_id", F.regexp_extract_all(F.translate("text", "\n ", "__"), F.lit("(?s).{1,25}"), 0).alias("cut"))
    half = cut.withColumn("n", F.ceil(F.size("cut") / 2).cast("int"))
    rows = F.zip_with(F.slice("cut", F.lit(1), F.col("n")), F.slice("cut", F.col("n") + 1, F.col("n")), lambda x, y: F.concat(F.rpad(x, 26, " "), F.lit("    "), F.coalesce(y, F.lit(""))))
    return pages.gutters(half.select("doc_id", F.array_join(rows, "\n").alias("text")), "doc_id")


@query()
def single_spacing(t):
    from quire.operators import pages

    return t("documents").select("doc_id", F.md5(pages.single_spaced(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("text"))


@query()
def redaction_labels(t):
    from quire.operators import pages

    at = doc_lines(t).withColumn("line", F.expr("CASE line_no % 3 WHEN 0 THEN concat(line, ' (b)(6) , (b)(7)(C) end') WHEN 1 THEN '  (b)(1) ' ELSE line END"))
    return at.select("doc_id", "line_no", pages.redacted(F.col("line")).alias("line"), F.array_join(pages.exemption_codes(F.col("line")), ";").alias("codes")).where("line is not null")


@query()
def publish_batches(t):
    from quire.operators import pages

    return pages.batches(t("documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes")), "source", "doc_id", "bytes", 20_000)


S_TEXT = "regexp_replace({}, '<[^>]+>', ' ', 'g')"


@query(f"""SELECT page_id, CAST(len(regexp_extract_all({S_TEXT.format("html")}, '{NWS}')) AS INTEGER) AS n_words, CAST(length(trim(regexp_replace({S_TEXT.format("html")}, '{WS}+', ' ', 'g'), ' ')) AS INTEGER) AS n_chars,
 CAST(length(trim(regexp_replace({S_TEXT.format("'<h2>' || url || '</h2>' || html")}, '{WS}+', ' ', 'g'), ' ')) AS INTEGER) AS n_whole, CAST(length(trim(regexp_replace({S_TEXT.format("html")}, '{WS}+', ' ', 'g'), ' ')) AS INTEGER) AS n_intro FROM pages""")
def html_lengths(t):
    """Word counts and lengths of pages; a heading set before a page counts for the whole and not for its introduction."""
    headed = F.concat(F.lit("<h2>"), "url", F.lit("</h2>"), "html")
    return t("pages").select("page_id", T.html_word_count(F.col("html")).alias("n_words"), T.html_text_length(F.col("html")).alias("n_chars"), T.html_text_length(headed).alias("n_whole"), T.intro_length(headed).alias("n_intro"))


@query(f"WITH {LINES} SELECT doc_id, line_no, NOT regexp_matches(e, '[.?!:;\"'')\\]’”…]$') OR regexp_matches(e, '[a-z]-$') AS unfinished, regexp_matches(line, '{q(T.CITATION)}') AS citation FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(line, '(\\[\\^[^\\]]*\\])+$', ''), '[*_]+$', ''), '{WS}+$', '') AS e FROM l)")
def line_endings(t):
    """Lines that stop in mid sentence, and lines that read as citations."""
    return doc_lines(t).select("doc_id", "line_no", T.unfinished(F.col("line")).alias("unfinished"), T.citation(F.col("line")).alias("citation"))


_TABLE = "replace(replace(text, ', ', '    '), '. ', chr(10))"


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split({_TABLE}, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\r\f\x0B]')) AS w FROM documents)
SELECT doc_id, len(w) >= 8 AND len(list_filter(w, lambda x: regexp_matches(x, '{T.ALIGNED}'))) >= 0.25 * len(w) AS tabular FROM d""")
def tabular_pages(t):
    """Whole documents as pages, a line a sentence; commas stand for column boundaries."""
    page = F.replace(F.replace("text", F.lit(", "), F.lit("    ")), F.lit(". "), F.lit("\n"))
    return t("documents").select("doc_id", T.tabular_page(page).alias("tabular"))


# Documents as pages: a line a sentence, set in by some columns, every third with a number before it.
_PAGE = "repeat(' ', CAST(doc_id % 5 AS INTEGER)) || regexp_replace(replace(text, '. ', chr(10) || repeat(' ', CAST(doc_id % 5 AS INTEGER))), '(\\n *)([a-f])', '\\11.' || CAST(doc_id % 10 AS VARCHAR) || repeat(' ', CAST(2 + doc_id % 3 AS INTEGER)) || '\\2', 'g')"


def pages_of(t):
    text = F.replace("text", F.lit(". "), F.concat(F.lit("\n"), F.repeat(F.lit(" "), (F.col("doc_id") % 5).cast("int"))))
    numbered = F.regexp_replace(text, F.lit("(\\n *)([a-f])"), F.concat(F.lit("$11."), (F.col("doc_id") % 10).cast("string"), F.repeat(F.lit(" "), (F.col("doc_id") % 3 + 2).cast("int")), F.lit("$2")))
    return t("documents").select("doc_id", "source", F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 5).cast("int")), numbered).alias("text"))


_OPEN = "'^[ \\t\\n\\r\\f\\x0B]{0,8}[0-9]{1,2}\\.[0-9]{1,3}[ \\x{FFFD}]{2,}[^ \\t\\n\\r\\f\\x0B]'"
_MARGINS = f"""pl AS (SELECT doc_id, source, unnest(string_split({_PAGE}, chr(10))) AS line FROM documents),
o AS (SELECT source, doc_id, length(regexp_extract(line, {_OPEN})) - 1 AS v, count(*) AS n FROM pl WHERE regexp_matches(line, {_OPEN}) GROUP BY ALL),
own AS (SELECT source, doc_id, v AS opener FROM o QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY n DESC, v) = 1),
i AS (SELECT doc_id, line, length(regexp_extract(line, '^{WS}*')) AS v FROM pl)"""


@query(f"""WITH {_MARGINS}, s AS (SELECT doc_id, v, count(*) AS n FROM i WHERE regexp_matches(line, '[^ \\t\\n\\r\\f\\x0B]') GROUP BY ALL),
b AS (SELECT doc_id, v, sum(n) OVER (PARTITION BY doc_id) AS m FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, v) = 1)
SELECT d.doc_id, CAST(coalesce(opener, CASE WHEN m >= 8 THEN v END, 0) AS INTEGER) AS margin FROM documents d LEFT JOIN own ON d.doc_id = own.doc_id LEFT JOIN b ON d.doc_id = b.doc_id""")
def page_margins(t):
    return margins.page_margins(pages_of(t), "doc_id")


@query(f"""WITH {_MARGINS}, s AS (SELECT doc_id, v, count(*) AS n FROM i WHERE len(string_split({s_norm("line")}, ' ')) > 3 GROUP BY ALL),
b AS (SELECT doc_id, v, sum(n) OVER (PARTITION BY doc_id) AS m, min(v) OVER (PARTITION BY doc_id) AS lo FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, v) = 1)
SELECT d.doc_id, CAST(coalesce(CASE WHEN m >= 15 AND v = lo AND v BETWEEN 2 AND 6 THEN v END, 0) AS INTEGER) AS margin FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id""")
def shifted_margins(t):
    return margins.shifted_margins(pages_of(t), "doc_id")


@query(f"""WITH {_MARGINS}, c AS (SELECT source, doc_id % 2 AS side, opener, count(*) AS n FROM own GROUP BY ALL),
f AS (SELECT source, side, opener AS v FROM c QUALIFY row_number() OVER (PARTITION BY source, side ORDER BY n DESC, opener) = 1)
SELECT d.source, d.doc_id, CAST(coalesce(opener, x.v, y.v, 0) AS INTEGER) AS margin FROM documents d LEFT JOIN own ON d.doc_id = own.doc_id
LEFT JOIN f x ON d.source = x.source AND d.doc_id % 2 = x.side LEFT JOIN f y ON d.source = y.source AND d.doc_id % 2 = 1 - y.side""")
def facing_margins(t):
    return margins.facing_margins(pages_of(t), "source", "doc_id")


_SHOWN = "regexp_matches(line, '[^ \\t\\n\\r\\f\\x0B]')"


@query(f"""WITH {LINES}, s AS (SELECT *, CASE WHEN {_SHOWN} THEN line END AS x FROM l), g AS (SELECT *, x IS NOT NULL AND lag(x) OVER w IS NULL AS begins FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, last_value(x IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(x IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
 CASE WHEN x IS NOT NULL THEN CAST(sum(CAST(begins AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) END AS run FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def line_neighbours(t):
    return runs.blank_runs(runs.neighbours(doc_lines(t).select("doc_id", "line_no", "line"), "doc_id"), "doc_id").drop("line")


@query("""WITH p AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 7919) % 1000 END AS position FROM documents),
b AS (SELECT source, doc_id, coalesce(least(min(position) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5000), 5000) AS x FROM p)
SELECT source, doc_id, max(x) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM b""")
def positions_clamped(t):
    at = t("documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") * 7919 % 1000).alias("position"))
    return runs.clamped(at, "source", "doc_id", "position", 5000)


@query(f"""WITH a AS (SELECT source, doc_id, substr(text, 1, strpos(text || ' ', ' ') - 1) AS h FROM documents WHERE doc_id // 20 % 2 = 0), b AS (SELECT DISTINCT source, substr(text, 1, strpos(text || ' ', ' ') - 1) AS h FROM documents WHERE doc_id // 20 % 2 = 1),
g AS (SELECT a.*, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM a.source AND b.h IS NOT DISTINCT FROM a.h))
SELECT source, count(*) AS n_missing, array_to_string(list(h ORDER BY p) FILTER (p <= 10), '|') AS first FROM g GROUP BY source""")
def headings_removed(t):
    """First words of documents, by twenties of ids in turn, as headings before and after: what is gone, the first ten told."""
    d = t("documents").select("source", "doc_id", F.substring_index("text", " ", 1).alias("h"))
    return runs.missing_first(d.where("doc_id div 20 % 2 = 0"), d.where("doc_id div 20 % 2 = 1"), "source", "doc_id", "h").withColumn("first", F.array_join("first", "|"))


# Lines of documents as headings of every kind: capitals, divisions, numbered and lettered titles, plain lines.
_ASCII = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_HEADS = f"""{LINES}, hl AS (SELECT doc_id, line_no, CASE (doc_id + line_no) % 6 WHEN 0 THEN translate(substr(line, 1, 30), {_ASCII}) WHEN 1 THEN 'Part 3: ' || substr(line, 1, 40) WHEN 2 THEN '4. ' || translate(substr(line, 1, 30), {_ASCII})
 WHEN 3 THEN 'B. Report On The ' || substr(line, 1, 20) || ' 12' WHEN 4 THEN 'Chapter IV ' || substr(line, 1, 25) || '    17' ELSE line END AS line FROM l)"""


def head_lines(t):
    line, k = F.col("line"), (F.col("doc_id") + F.col("line_no")) % 6
    caps = F.translate(F.substring(line, 1, 30), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    made = F.when(k == 0, caps).when(k == 1, F.concat(F.lit("Part 3: "), F.substring(line, 1, 40))).when(k == 2, F.concat(F.lit("4. "), caps))
    made = made.when(k == 3, F.concat(F.lit("B. Report On The "), F.substring(line, 1, 20), F.lit(" 12"))).when(k == 4, F.concat(F.lit("Chapter IV "), F.substring(line, 1, 25), F.lit("    17")))
    return doc_lines(t).select("doc_id", "line_no", made.otherwise(line).alias("line"))


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_all(words: str, pattern: str, small: list[str]) -> str:
    return f"len(list_filter({words}, lambda w: NOT (regexp_matches(w, '{q(pattern)}') OR lower(w) IN ({', '.join(map(repr, small))})))) = 0"


def s_titular(x: str) -> str:
    words = f"list_filter(regexp_extract_all({x}, '{NWS}'), lambda w: regexp_matches(w, '[A-Za-z]'))"
    return f"(NOT regexp_matches({x}, '{headings.LOWER}') OR (len({words}) >= 2 AND len(list_filter({words}, lambda w: regexp_matches(w, '^[A-Z]'))) * 10 >= len({words}) * 6))"


_BODY = f"b AS (SELECT *, CASE WHEN regexp_matches(s, '{headings.OWN_NUMBER}') OR regexp_matches(s, '{headings.YEARS}') THEN s ELSE {s_strip(f"regexp_replace(s, '{WS}+[0-9]{{1,4}}$', '')")} END AS body FROM (SELECT *, {s_strip('line')} AS s FROM hl))"


@query(f"""WITH {_HEADS}, {_BODY}, c AS (SELECT *, regexp_extract(body, '{headings.DIVISION}', 1) AS kind, regexp_extract(body, '{headings.DIVISION}', 2) AS num, {s_strip(f"regexp_replace(regexp_extract(body, '{headings.DIVISION}', 3), '^:', '')")} AS rest,
 {s_strip(f"regexp_extract(body, '{headings.NUMBERED}', 1)")} AS title, length(regexp_replace(body, '[^A-Za-z]', '', 'g')) AS letters FROM b),
k AS (SELECT *, CASE WHEN body = '' OR regexp_matches(s, '{headings.LISTED}') OR len(regexp_extract_all(body, '{NWS}')) > 14 OR regexp_matches(body, '[;:,\\-{chr(0xAD)}{chr(0x2010)}]$') THEN 0
 WHEN regexp_matches(rest, '^["''(A-Z0-9]') AND NOT regexp_matches(rest, '[.,;]$') THEN 1
 WHEN regexp_matches(title, '^[A-Z]') AND NOT regexp_matches(title, '[.?!]$') AND {s_titular('title')} AND len(list_filter(regexp_extract_all(title, '{NWS}'), lambda w: regexp_matches(w, '^[a-z]') AND lower(w) NOT IN ({', '.join(map(repr, headings.SMALL))}))) = 0 THEN 2
 WHEN letters >= 4 AND NOT regexp_matches(body, '{headings.LOWER}') AND NOT regexp_matches(body, '\\.$|[$%]|[0-9]{{3}}') AND len(regexp_extract_all(body, ',')) < 2 AND letters * 10 > length(body) * 6 AND (regexp_matches(body, '{WS}') OR (letters >= 5 AND NOT regexp_matches(body, '[-0-9]'))) THEN 3 ELSE 0 END AS k FROM c)
SELECT doc_id, line_no, CAST(CASE k WHEN 1 THEN CASE WHEN kind IN ('Part', 'Appendix', 'Annex', 'Volume') THEN 2 ELSE 3 END WHEN 2 THEN CASE WHEN regexp_matches(title, '{headings.LOWER}') THEN 3 ELSE 2 END ELSE 2 END AS INTEGER) AS level,
 CASE k WHEN 1 THEN kind || ' ' || num || ': ' || rest WHEN 2 THEN title ELSE body END AS heading FROM k WHERE k > 0""")
def heading_lines(t):
    """Lines that are headings, with their levels and what of them is the heading."""
    at = head_lines(t).withColumn("h", headings.heading(F.col("line"))).where("h IS NOT NULL")
    return at.select("doc_id", "line_no", F.col("h.level").alias("level"), F.col("h.text").alias("heading"))


@query(f"""WITH {_HEADS}, {_BODY}, n AS (SELECT *, {s_norm('line')} AS nl FROM b)
SELECT doc_id, line_no, body AS without_page, {s_titular('line')} AS titular, regexp_matches(s, '(?i){headings.NO_WORD}(?:{"|".join(headings.DANGLING)})$') AS dangles,
 regexp_matches(s, '^[0-9]{{1,3}}[.)][0-9]{{1,3}}{WS}+') AND NOT regexp_matches(s, '^[0-9]{{1,3}}[.)][0-9]{{1,3}}{WS}+(?:{headings.UNITS})(?:[^A-Za-z0-9_]|$)') AS numbered,
 CASE WHEN regexp_matches(nl, '^[A-Z]') AND len(regexp_extract_all(nl, '{NWS}')) <= 6 AND NOT regexp_matches(nl, '[.?!:;,]$') AND NOT regexp_matches(nl, '^(?:[IVXLC]{{1,6}}|[A-Z]|[0-9]{{1,2}})\\.{WS}') AND {s_all(f"regexp_extract_all(nl, '{NWS}')", "^[A-Z(\"'“]", headings.SMALL)} THEN nl END AS tail,
 lower(regexp_replace(regexp_replace(nl, '{headings.MARKER}', ''), '[. \t\n\r\f\x0B]+$', '')) AS key, {" OR ".join(f"regexp_matches(line, '{x}')" for x in headings.SECTION)} AS keeps FROM n""")
def heading_guards(t):
    """What the guards of headings say of each line."""
    c = F.col("line")
    return head_lines(t).select("doc_id", "line_no", headings.without_page(c).alias("without_page"), headings.titular(c).alias("titular"), headings.dangles(c).alias("dangles"), headings.numbered_opening(c).alias("numbered"), headings.heading_tail(c).alias("tail"), headings.heading_key(c).alias("key"), headings.keeps_section(c, F.lit(False)).alias("keeps"))


_LISTS = "replace(replace(text, '. ', ' ..... 7' || chr(10)), ', ', chr(10) || 'p. 12   ')"


@query(f"""WITH d AS (SELECT doc_id, string_split({_LISTS}, chr(10)) AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '{headings.LEADER}'))) >= 3 AS contents, len(list_filter(w, lambda x: regexp_matches(x, '{headings.PAGE_FIRST}'))) >= 3 AS illustrations FROM d""")
def listing_pages(t):
    """Whole documents as pages: sentences end in leaders and a page, commas open entries of illustrations."""
    page = F.replace(F.replace("text", F.lit(". "), F.lit(" ..... 7\n")), F.lit(", "), F.lit("\np. 12   "))
    return t("documents").select("doc_id", headings.contents_page(page).alias("contents"), headings.illustration_list(page).alias("illustrations"))


_SUBHEADS = "s AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS i, a FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(10) || 'The Next of ' || substr(text, 1, 9) || chr(10)), chr(10)) AS a FROM documents)), sl AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, repeat(' ', CAST(doc_id % 3 * 12 AS INTEGER)) || a[i] AS line FROM s)"


def subhead_lines(t):
    text = F.replace("text", F.lit(". "), F.concat(F.lit(".\n\nThe Next of "), F.substring("text", 1, 9), F.lit("\n")))
    at = lines.explode(t("documents").select("doc_id", text.alias("text")), "doc_id")
    return at.withColumn("line", F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 3 * 12).cast("int")), "line"))


@query(f"""WITH {_SUBHEADS}, n AS (SELECT *, {s_norm('line')} AS x, lead(line) OVER w AS raw, coalesce(lag(line) OVER w, '') AS above, max(length(regexp_replace(line, '{WS}+$', ''))) OVER (PARTITION BY doc_id) - length(regexp_replace(line, '{WS}+$', '')) AS r, length(regexp_extract(line, '^{WS}*')) AS p FROM sl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), f AS (SELECT *, {s_norm('raw')} AS follow FROM n)
SELECT doc_id, line_no, coalesce(regexp_matches(x, '^[A-Z]') AND regexp_matches(x, '{headings.LOWER}') AND length(x) <= 60 AND len(string_split(x, ' ')) <= 7 AND NOT regexp_matches(x, '[.,;:?!”")\\]0-9]$') AND {s_all("string_split(x, ' ')", '^[A-Z0-9“"(]', headings.SUBHEAD_SMALL)}
 AND length(follow) >= 60 AND regexp_matches(follow, '^[A-Z“"(]') AND abs(length(regexp_extract(raw, '^{WS}*')) - p) <= 2 AND NOT regexp_matches(above, '[^ \t\n\r\f\x0B]'), false) AS subhead, p >= 20 AND abs(p - r) * 10 <= (p + r) * 3 AS centred FROM f""")
def subheads_centred(t):
    """Short titles set above paragraphs, and lines in the middle of their page."""
    return headings.centred(headings.short_subheads(subhead_lines(t), "doc_id"), "doc_id").select("doc_id", "line_no", "subhead", "centred")


# Blocks of documents: a sentence each, two of three numbered in each stretch, some of them years, a page mark at every seventh.
_BLOCKS = "bs AS (SELECT doc_id, unnest(generate_series(0, len(a) - 1)) AS i, a FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), '. ') AS a FROM documents)), bl AS (SELECT doc_id, CAST(i AS INTEGER) AS block_no, CASE WHEN i % 7 = 6 THEN 'page' ELSE 'paragraph' END AS kind, CASE WHEN i % 7 = 6 THEN '%%page ' || i || '%%' WHEN i % 23 = 11 THEN '19' || CAST(10 + doc_id % 80 AS VARCHAR) || '. ' || a[i + 1] WHEN (i + doc_id) % 3 > 0 THEN CAST(1 + i // 2 % 40 AS VARCHAR) || '. ' || a[i + 1] || CASE WHEN i % 4 > 0 THEN '.' ELSE '' END ELSE a[i + 1] END AS text FROM bs)"


def blocks_of(t):
    said = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")
    i, s = F.col("block_no"), F.col("s")
    text = F.when(i % 7 == 6, F.concat(F.lit("%%page "), i.cast("string"), F.lit("%%"))).when(i % 23 == 11, F.concat(F.lit("19"), (F.col("doc_id") % 80 + 10).cast("string"), F.lit(". "), s))
    text = text.when((i + F.col("doc_id")) % 3 > 0, F.concat((F.floor(i / 2) % 40 + 1).cast("string"), F.lit(". "), s, F.when(i % 4 > 0, ".").otherwise(""))).otherwise(s)
    return t("documents").select("doc_id", F.posexplode(said).alias("block_no", "s")).select("doc_id", "block_no", F.when(i % 7 == 6, "page").otherwise("paragraph").alias("kind"), text.alias("text"))


_N = printed.NUMBERED
_PROSE = f"(NOT regexp_matches(rest, '^[a-z]|;{WS}*$') AND NOT (regexp_matches(rest, ',{WS}*$') AND nw < 20) AND nw >= 8 AND (cut OR regexp_matches(rest, '[.!?\"”’)]{WS}*$') OR nw >= 20))"
_OPEN_END = f"(len(regexp_extract_all(pt, '\\(')) > len(regexp_extract_all(pt, '\\)')) OR NOT regexp_matches(pt, '[.!?:;\"”’)\\]]{WS}*$'))"


@query(f"""WITH {_BLOCKS}, o AS (SELECT *, kind = 'paragraph' AND regexp_matches(text, '{_N}') AS own FROM bl),
c AS (SELECT *, CASE WHEN own THEN CAST(regexp_extract(text, '{_N}', 1) AS INTEGER) END AS n, CASE WHEN own THEN regexp_extract(text, '{_N}', 2) END AS rest, sum(CASE WHEN own OR kind = 'page' THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS others, lag(kind) OVER w AS pk, lag(text) OVER w AS pt,
 coalesce(first_value(CASE WHEN kind <> 'page' THEN kind = 'paragraph' AND NOT regexp_matches(text, '{_N}') END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS cut FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
e AS (SELECT *, len(regexp_extract_all(rest, '{NWS}')) AS nw, last_value(n IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ln, last_value(CASE WHEN own THEN others END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
g AS (SELECT *, {_PROSE} AS prose, pk = 'paragraph' AND {_OPEN_END} AS meets, n BETWEEN 1900 AND 2099 AS yr, sum(CASE WHEN own AND NOT coalesce(n > ln AND n <= ln + 4 AND others - lo <= 12 AND NOT (n BETWEEN 1900 AND 2099), false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS run FROM e),
r AS (SELECT *, count(n) OVER p AS size, sum(CASE WHEN prose THEN 1 ELSE 0 END) OVER p AS np, sum(nw) OVER p AS words FROM g WINDOW p AS (PARTITION BY doc_id, run)),
j AS (SELECT *, coalesce(own AND size = 1 AND yr AND meets, false) AS joins, coalesce(own AND CASE WHEN size = 1 THEN yr OR (regexp_matches(rest, '^[a-z]') AND meets) OR (prose AND length(rest) >= 100) ELSE words >= size * 10 AND np * 10 >= size * CASE WHEN size >= 10 THEN 4 ELSE 6 END AND NOT (nw < 8 AND NOT regexp_matches(rest, '[.!?:\"”’)]{WS}*$')) END, false) AS printed FROM r),
x AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS grp FROM j)
SELECT doc_id, min(block_no) AS block_no, string_agg(text, ' ' ORDER BY block_no) AS text, arg_min(printed, block_no) AND NOT arg_min(joins, block_no) AS printed_number FROM x GROUP BY doc_id, grp""")
def printed_numbers(t):
    """Blocks with the numbers that are printed paragraph numbers marked, and years that end a sentence joined to it."""
    marked = printed.mark_numbers(blocks_of(t), "doc_id", "block_no")
    return printed.join_marked(marked, "doc_id", "block_no").select("doc_id", "block_no", "text", "printed_number")


def s_ends(x: str) -> str:
    y = f"regexp_replace({x}, '{printed.NOTE_MARKS}', '')"
    abbreviation = q(T.ABBREVIATION).replace("(?<![A-Za-z0-9_])", headings.NO_WORD)
    return f"(regexp_matches(regexp_replace({s_strip(y)}, '[\"'')\\]]+$', ''), '[.?!:;]$') AND NOT regexp_matches({y}, '{abbreviation}') AND NOT regexp_matches({y}, '{headings.NO_WORD}[A-Z]\\.$'))"


# Blocks about page marks: what stands behind a mark is a quotation in every other document.
_SPLITS = _BLOCKS + ", sb AS (SELECT doc_id, block_no, CASE WHEN block_no % 7 = 0 AND doc_id % 2 = 0 THEN '> ' || CASE WHEN block_no % 3 = 0 THEN lower(text) ELSE text END ELSE CASE WHEN block_no % 3 = 1 THEN lower(text) ELSE text END END AS text FROM bl)"


@query(f"""WITH {_SPLITS}, a AS (SELECT doc_id, block_no, text AS before, lead(text) OVER w AS nx FROM sb WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
z AS (SELECT *, first_value(CASE WHEN NOT regexp_matches(before, '{printed.PAGE_MARK}') THEN struct_pack(a := before, b := nx) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t FROM a),
y AS (SELECT doc_id, block_no, before, t.a AS after, t.b AS nxt, substr(t.a, 3) AS said FROM z WHERE regexp_matches(nx, '{printed.PAGE_MARK}') AND NOT regexp_matches(before, '{printed.NO_PROSE}') AND NOT {s_ends('before')})
SELECT * FROM (SELECT doc_id, block_no, CASE WHEN NOT regexp_matches(after, '{printed.NO_PROSE}') THEN CASE WHEN regexp_matches(after, '{printed.GOES_ON}') THEN 'paragraph' ELSE 'capitalised' END
 WHEN regexp_matches(after, '^> ') AND NOT regexp_matches(after, '^> -') THEN CASE WHEN regexp_matches(said, '^["“‘''\\[(]') THEN NULL WHEN regexp_matches(said, '{printed.GOES_ON}') THEN 'quote' WHEN NOT {s_ends('said')} AND NOT regexp_matches(nxt, '{printed.NO_PROSE}') AND regexp_matches(nxt, '{printed.GOES_ON}') THEN 'skewQuote' END END AS kind, before, after FROM y) WHERE kind IS NOT NULL""")
def page_splits(t):
    """Sentences that stop at a page's mark and go on behind it."""
    i = F.col("block_no")
    quoted = F.concat(F.lit("> "), F.when(i % 3 == 0, F.lower("text")).otherwise(F.col("text")))
    at = blocks_of(t).withColumn("text", F.when((i % 7 == 0) & (F.col("doc_id") % 2 == 0), quoted).otherwise(F.when(i % 3 == 1, F.lower("text")).otherwise(F.col("text"))))
    return printed.page_splits(at, "doc_id", "block_no")


@query()
def sections_merged(t):
    """Pages cut at made headings, short sections gathered; a fold in the order of parts, so SQL gives none."""
    at = t("pages").select("page_id", F.replace(F.replace("html", F.lit("<p>"), F.lit("<h2>Part 2</h2><p>")), F.lit("<br>"), F.lit("<h3>1.2 a</h3>")).alias("html"))
    return idents.merged_sections(at, "page_id").select("page_id", "section", F.length("body").cast("long").alias("n_chars"))


@query()
def inline_markers(t):
    """Whole documents with a number behind each sentence; the even ones are known notes. Its contexts look behind and ahead, which the other engine's patterns can't."""
    text = F.replace("text", F.lit(". "), F.concat(F.lit(". "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" ")))
    return t("documents").select("doc_id", notes.linked(text, F.array(*map(F.lit, range(0, 10, 2)))).alias("text"))


_LABEL, _BARE = breaks.LABEL.replace("'", "''"), breaks.BARE
_ENDED = r"(regexp_matches(x, '[.?!:;][\"''”’)\]]*$') AND NOT regexp_matches(x, '" + q(T.ABBREVIATION).replace("(?<![A-Za-z0-9_])", headings.NO_WORD) + "') AND NOT regexp_matches(x, '" + headings.NO_WORD + r"[A-Z]\.$'))"


@query(f"""WITH d AS (SELECT doc_id, {s_strip("split_part(text, chr(10), 1)")} AS p0, {s_strip("CASE WHEN doc_id % 5 = 0 THEN lower(split_part(text, chr(10), 2)) WHEN doc_id % 19 = 0 THEN '(b) ' || split_part(text, chr(10), 2) ELSE split_part(text, chr(10), 2) END")} AS nx, doc_id % 11 = 0 AS label, CASE WHEN doc_id % 22 = 0 THEN '19 of them' ELSE split_part(text, chr(10), 2) END AS line,
 CASE WHEN doc_id % 13 > 0 THEN floor((doc_id % 9 * 4 - 8) / 10.0 * 100 + 0.5) / 100 END AS em, abs(doc_id % 7) AS gap, doc_id % 17 > 0 AS face, doc_id % 2 = 0 AS even, doc_id % 3 > 0 AS runs FROM documents),
c AS (SELECT *, regexp_replace(CASE WHEN doc_id % 4 > 0 THEN regexp_replace(p0, '[.]+$', '') ELSE p0 END, '{q(breaks.NOTED)}', '\\1') AS x FROM d),
e AS (SELECT *, {_ENDED} AS ended, coalesce(abs(em) < 0.6, false) AS flush, coalesce(abs(abs(em) - 0.6) < 0.25, false) AS near, regexp_matches(nx || ' ', '{_LABEL}') AS l0 FROM c), g AS (SELECT *, label AND regexp_matches({s_strip('line')}, '{_BARE}') AND NOT ended AS bare FROM e),
k AS (SELECT *, CASE WHEN l0 THEN 'split high' WHEN label AND NOT bare THEN CASE WHEN ended THEN 'split high' ELSE 'split medium' END WHEN NOT face THEN 'split high'
 WHEN ended THEN CASE WHEN even AND gap < 0.5 AND flush AND len(regexp_extract_all(line, '{NWS}')) > 4 THEN 'R2 low' WHEN flush THEN 'split medium' ELSE 'split high' END
 WHEN flush AND gap >= 5 THEN 'split low' WHEN flush THEN CASE WHEN near OR NOT runs THEN 'R1 low' ELSE 'R1 high' END WHEN regexp_matches(nx, '^[a-z,;]') THEN 'R1 high' WHEN em IS NULL OR near THEN 'split low' ELSE 'split high' END AS k FROM g)
SELECT doc_id, split_part(k, ' ', 1) <> 'split' AS joins, split_part(k, ' ', 1) AS rule, CASE WHEN bare AND NOT l0 AND split_part(k, ' ', 2) = 'high' THEN 'medium' ELSE split_part(k, ' ', 2) END AS confidence, CASE WHEN NOT l0 AND NOT (label AND NOT bare) AND face THEN em END AS indent_em FROM k""")
def page_break_decisions(t):
    """First and second lines of documents as the blocks about a page's break, in places and faces made of their ids."""
    i, two = F.col("doc_id"), F.coalesce(F.get(F.split("text", "\n"), 1), F.lit(""))
    one = T.stripped(F.get(F.split("text", "\n"), 0))
    before = F.when(i % 4 > 0, F.regexp_replace(one, "[.]+$", "")).otherwise(one)
    after = F.when(i % 5 == 0, F.lower(two)).when(i % 19 == 0, F.concat(F.lit("(b) "), two)).otherwise(two)
    face = lambda size, left, gap, label, text: F.struct(F.lit("a").alias("family"), F.lit("k").alias("color"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), size.alias("size"), left.alias("left"), gap.cast("double").alias("right_gap"), label.alias("label"), text.alias("text"))
    above = face(F.when(i % 17 == 0, 12.0).otherwise(10.0), F.lit(0), i % 7, F.lit(False), before)
    below = face(F.lit(10.0), i % 9 * 4, F.lit(0), i % 11 == 0, F.when(i % 22 == 0, "19 of them").otherwise(two))
    d = breaks.decide(before, after, above, below, F.when(i % 13 > 0, 8), i % 3 > 0, i % 2 == 0)
    return t("documents").withColumn("d", d).select("doc_id", F.col("d.join").alias("joins"), "d.rule", "d.confidence", "d.indent_em")


_TOKENS = "CASE doc_id % 5 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN upper(substr('ivxlc', CAST(1 + doc_id % 3 AS INTEGER), 2)) WHEN 2 THEN 'Seven' WHEN 3 THEN 'c' ELSE lang END"


@query(f"""WITH x AS (SELECT doc_id, text, lower({_TOKENS}) AS tk, CASE WHEN doc_id % 2 = 0 THEN 'Appendix' ELSE 'Part' END AS kind, {_TOKENS} || '.' AS label, split_part(text, chr(10), 1) AS title FROM documents),
r AS (SELECT *, list_transform(list_filter(string_split(tk, ''), lambda c: c <> ''), lambda c: CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 ELSE 0 END) AS v FROM x)
SELECT doc_id, CASE WHEN regexp_matches(tk, '^[0-9]+$') THEN CAST(CAST(tk AS BIGINT) AS VARCHAR) WHEN kind = 'Appendix' AND regexp_matches(tk, '^[a-z]$') THEN tk WHEN tk = 'seven' THEN '7' WHEN regexp_matches(tk, '^[ivxlc]+$') THEN CAST(CAST(list_sum(list_transform(v, lambda c, i: CASE WHEN c < coalesce(v[i + 1], 0) THEN -c ELSE c END)) AS BIGINT) AS VARCHAR) END AS number,
 CASE WHEN regexp_matches(label, '^[IVXLC]+\\.$') AND NOT regexp_matches(title, '{headings.LOWER}') THEN 2 WHEN regexp_matches(label, '^(?:[A-Z]|[0-9]{{1,2}})\\.$') THEN 3 ELSE 4 END AS level,
 CASE WHEN regexp_matches(label, '^[IVXLC]+\\.$') AND NOT regexp_matches(label, '^[A-H]\\.$') THEN 2 WHEN regexp_matches(label, '^[A-Z]\\.$') THEN 3 WHEN regexp_matches(label, '^[0-9]{{1,2}}\\.$') THEN 4 ELSE 5 END AS scanned, greatest(3, CAST(floor(length(title) / 8.0 + 0.5) AS INTEGER)) AS tolerance FROM r""")
def division_labels(t):
    """Numbers and levels of divisions whose labels are made of ids and languages."""
    i = F.col("doc_id")
    token = F.when(i % 5 == 0, i.cast("string")).when(i % 5 == 1, F.upper(F.substring(F.lit("ivxlc"), i.cast("int") % 3 + 1, F.lit(2)))).when(i % 5 == 2, "Seven").when(i % 5 == 3, "c").otherwise(F.col("lang"))
    title, label = F.get(F.split("text", "\n"), 0), F.concat(token, F.lit("."))
    return t("documents").select("doc_id", headings.division_number(F.when(i % 2 == 0, "Appendix").otherwise("Part"), token).alias("number"), headings.outline_level(label, title).alias("level"), headings.outline_level(label, title, scanned=True).alias("scanned"), headings.tolerance(title).alias("tolerance"))


@query()
def flush_markers(t):
    """Whole documents with a number set flush behind each sentence, linked by the notes about it and then in sequence: a fold, so SQL gives none."""
    text = F.replace("text", F.lit(". "), F.concat(F.lit("."), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" ")))
    near = F.array(*map(F.lit, range(2, 8, 2)))
    return t("documents").select("doc_id", notes.flush_linked(text, near).alias("flush"), notes.sequence_linked(text, near).alias("sequenced"))


_CUT = "replace(replace(text, 'en ', 'en- '), 'e ', 'e www./ ')"
_RAW = f"regexp_extract_all(lower(regexp_replace({_CUT}, '\\[\\^\\d+(-\\d+)?\\]:?', ' ', 'g')), '{NWS}')"


@query(f"""WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents),
p AS (SELECT doc_id, list_filter(flatten(list_transform(raw, lambda w, i: list_append(regexp_split_to_array(w, '[^a-z0-9]+'), CASE WHEN i < len(raw) AND (regexp_matches(w, '[-–—­]$') OR regexp_matches(raw[i + 1], '^[’'']') OR (regexp_matches(w, 'https?:|www\\.|/') AND regexp_matches(w, '[/._=?&%#]$'))) THEN regexp_replace(w || raw[i + 1], '[^a-z0-9]', '', 'g') ELSE '' END))), lambda w: w <> '') AS pieces FROM r)
SELECT doc_id, CAST(len(pieces) AS BIGINT) AS n_pieces, array_to_string(pieces, ' ') AS pieces FROM p""")
def source_pieces(t):
    """Pieces of whole documents in which some words are parted by a hyphen and some stand before an address."""
    cut = F.replace(F.replace("text", F.lit("en "), F.lit("en- ")), F.lit("e "), F.lit("e www./ "))
    pieces = T.source_pieces(cut)
    return t("documents").select("doc_id", F.size(pieces).cast("long").alias("n_pieces"), F.array_join(pieces, " ").alias("pieces"))
