"""One query for each operator over its whole table, with production parameters; SQL where it can state the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, decontaminate, jaccard, licenses, packing, pivots, shards, toxicity, urls, warc
from .base import Scratch

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(ident: str, n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % n


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = brown.score(table(spark, sf_dir, "documents"), Scratch(spark, "op1"), train=remainder("doc_id", 7) != 2)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shards.histogram_sort(docs, Scratch(spark, "op2"), shards=24)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivots.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return pivots.search(vectors, vectors.where("id % 100 = 0"), Scratch(spark, "op3"), k=10)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    folder = scratch.path("archives")
    warc.write(table(spark, sf_dir, "pages"), folder, scratch)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.join(table(spark, sf_dir, "documents"), Scratch(spark, "op7"), n=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages"), RULES, Scratch(spark, "op8"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents"), tokenizer(), most=2048)
    out = packing.pack(pieces, Scratch(spark, "op9"), most=2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 4) != 2))
    out = toxicity.scores(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown_classes": op1,
        "op2_histogram_sort_shards": op2,
        "op3_pivot_topk": op3,
        "op4_license_scan": op4,
        "op5_decontaminate": op5,
        "op6_warc_shards": op6,
        "op7_ngram_jaccard_join": op7,
        "op8_url_equivalence": op8,
        "op9_pattern_packing": op9,
        "op10_toxicity": op10,
    }


_WORDS5 = r"[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES)

SQL = {
    "op4_license_scan": f"""
WITH t(license, t) AS (VALUES {_TEMPLATES}),
tw AS (SELECT license, regexp_extract_all({_LOW.format("t")}, '{_WORDS5}') AS w FROM t),
tg AS (SELECT license, w, CASE WHEN len(w) <= 5 THEN 0 ELSE CAST(pow(2, greatest(0, ceil(log2((len(w) - 5) / 2)))) AS BIGINT) END AS g FROM tw),
ts AS (SELECT DISTINCT license, g, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT license, w, g, unnest(generate_series(1, len(w) - 4)) AS i FROM tg)),
tn AS (SELECT license, g, count(*) AS n FROM ts GROUP BY license, g),
d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS5}') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS p, len(w) - 4 AS m, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, license, g, p, m, ts.s FROM ds JOIN ts ON ds.s = ts.s),
x AS (SELECT doc_id, license, g, m, s, CASE WHEN g = 0 THEN p ELSE unnest(generate_series(greatest(0, p // greatest(g, 1) - 2), p // greatest(g, 1))) * g END AS i FROM h),
k AS (SELECT doc_id, x.license, i, count(DISTINCT s) AS k FROM x WHERE g = 0 OR i = 0 OR i // greatest(g, 1) <= (m + g - 1) // greatest(g, 1) - 3 GROUP BY doc_id, x.license, i)
SELECT doc_id, k.license AS license, count(*) AS n_windows, CAST(min(i) AS BIGINT) AS first_word, max(k / n) AS containment
FROM k JOIN tn ON k.license = tn.license WHERE 100 * k >= 80 * n GROUP BY doc_id, k.license""",
    "op3_pivot_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS5}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS5}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS t, least(len(w), 10) AS n
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op6_warc_shards": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.s AS payload_digest,
       CASE WHEN m IS NOT NULL AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN f ON p.s = f.s AND p.n >= 1000""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x{{20}}\\x{{9}}-\\x{{D}}]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+3], ' '))) AS l FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, len(l) AS n, unnest(l) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT a, a AS z FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.z = p.a),
c AS (SELECT a, min(z) AS m FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN c ON d.doc_id = c.a""",
    "op8_url_equivalence": """
WITH RECURSIVE t AS (SELECT page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
x AS (SELECT url AS a, replace(coalesce(
        CASE WHEN regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?\\s*canonical\\b') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) END,
        CASE WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b') THEN regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*["'']?\\s*0*\\s*[;,]\\s*url\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) END), '&amp;', '&') AS u FROM t),
y AS (SELECT a, CASE WHEN starts_with(u, '//') THEN regexp_extract(a, '(?s)^(.*?:)//', 1) || u WHEN starts_with(u, '/') THEN regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) || u WHEN contains(u, '://') THEN u END AS b FROM x),
e AS (SELECT a, b FROM y WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM y WHERE b IS NOT NULL AND a <> b),
r AS (SELECT a, a AS z FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.z = e.a),
u AS (SELECT url FROM pages UNION SELECT z FROM r),
s AS (SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT s.url, host, path, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule, arg_max(verdict, (length(rh || rp), length(rh))) AS v
      FROM s LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY s.url, host, path),
bad AS (SELECT DISTINCT r.a AS url FROM r JOIN m ON r.z = m.url WHERE m.v = 'block')
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bad.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN m ON pages.url IS NOT DISTINCT FROM m.url LEFT JOIN bad ON pages.url = bad.url""",
}
