"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import base, brown, decontaminate, jaccard, licenses, packing, pivots, queries, shards, tokens, toxicity, urls, warc


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def test_long_words_and_white_space():
    """Words of a million letters, Thue-Morse words of one length, and long runs of space."""
    import pyarrow as pa

    def twins(n):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)

    seen = set()
    for w in [*twins(1024), *twins(4096), *twins(512), "x" * 1_000_000, "x" * 999_999, "x" * 8, "x" * 9, "x" * 16]:
        for first, last, off, data in tokens.pieces(pa.array([" " * 100_000 + w + " "])):
            starts, ends, before, lowered = tokens.words(off, data)
            seen |= set(tokens.hashes(starts, ends, lowered).tolist())
    assert len(seen) == 11


def test_components(spark, scratch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (None, 3), (300, 1000), (301, 1000), (302, 1000)]
    got = {r["node"]: r["component"] for r in base.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200, 300: 300, 301: 300, 302: 300, 1000: 300}
    assert base.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    again = base.Scratch(spark, "again")
    for last in (1 << 20, 8):
        assert got == {r["node"]: r["component"] for r in base.components(spark.createDataFrame(edges, "a long, b long"), again, last=last).collect()}


def test_tokens_are_words():
    import pyarrow as pa

    texts = ["Ab c\x0bd", "", None, "é\x1cÉ x", "  z"]
    seen = {}
    for first, last, off, data in tokens.pieces(pa.array(texts), most=4):
        starts, ends, before, lowered = tokens.words(off, data)
        h = tokens.hashes(starts, ends, lowered)
        for i in range(first, last):
            seen[i] = [(bytes(lowered[a:b]).decode(), x) for a, b, x in zip(starts, ends, h, strict=True)][before[i - first] : before[i - first + 1]]
    assert [[w for w, _ in seen[i]] for i in range(5)] == [words(t) for t in texts]
    assert len({x for ws in seen.values() for _, x in ws}) == len({w for ws in seen.values() for w, _ in ws})


def brown_by_hand(rows, is_train, k, tolerance, most_rounds):
    """Classes and log10 probabilities, word by word with plain dictionaries."""
    import pyarrow as pa

    def h(w):
        if w == "\n":
            return int(brown.END)
        (_, _, off, data), = tokens.pieces(pa.array([w]))
        return int(tokens.hashes(*[x for i, x in enumerate(tokens.words(off, data)) if i != 2])[0])

    stream = ["\n"] + [w for r in rows if is_train(r["doc_id"]) for w in [*words(r["text"]), "\n"]]
    c = Counter(stream[1:])
    order = sorted(c, key=lambda w: (-c[w], h(w)))
    cls = {w: min(i, k - 1) for i, w in enumerate(order)}
    xlogx = lambda x: x * math.log(x) if x > 0 else 0.0
    two = Counter(zip(stream, stream[1:], strict=False))

    def pairs_of(cls):
        m = np.zeros((k, k))
        for (a, b), n in two.items():
            m[cls[a], cls[b]] += n
        return m

    value = lambda m: sum(map(xlogx, m.ravel())) - sum(map(xlogx, m.sum(0))) - sum(map(xlogx, m.sum(1)))
    m, values = pairs_of(cls), []
    values.append(value(m))
    for _ in range(most_rounds):
        new = {}
        for w in c:
            after, before = Counter(), Counter()
            for (a, b), n in two.items():
                if a == w:
                    after[cls[b]] += n
                if b == w:
                    before[cls[a]] += n

            def gain(x, sign, w=w, after=after, before=before):
                g = sum(xlogx(m[x, d] + (n if sign > 0 else 0)) - xlogx(m[x, d] - (n if sign < 0 else 0)) for d, n in after.items())
                g += sum(xlogx(m[d, x] + (n if sign > 0 else 0)) - xlogx(m[d, x] - (n if sign < 0 else 0)) for d, n in before.items())
                for total, n in ((m[x].sum(), sum(after.values())), (m[:, x].sum(), sum(before.values()))):
                    g -= xlogx(total + (n if sign > 0 else 0)) - xlogx(total - (n if sign < 0 else 0))
                return g

            best, to = gain(cls[w], -1), cls[w]
            for x in range(k):
                if x != cls[w] and gain(x, 1) > best + 1e-9:
                    best, to = gain(x, 1), x
            new[w] = to
        now = pairs_of(new)
        rise = (value(now) - values[-1]) / sum(c.values())
        if rise > 0:
            cls, m = new, now
            values.append(value(m))
        if rise < tolerance:
            break
    mass, kinds = m.sum(0), Counter(cls.values())
    share = mass / mass.sum()
    move = (m + 4 * share) / (m.sum(1, keepdims=True) + 4)

    def score(text):
        total, prev = 0.0, cls["\n"]
        for w in [*words(text), "\n"]:
            if w in c:
                total += math.log10(move[prev, cls[w]] * (c[w] - 0.75) / mass[cls[w]])
                prev = cls[w]
            else:
                total += math.log10(sum(move[prev, x] * 0.75 * kinds[x] / mass[x] for x in range(k) if mass[x]))
        return total

    return score, values


@pytest.mark.parametrize(("rounds", "buckets"), [(1, 1 << 15), (40, 8)])
def test_brown(spark, docs, scratch, rounds, buckets, monkeypatch):
    monkeypatch.setattr(brown, "BUCKET", buckets)
    monkeypatch.setattr(brown, "SMALL", 3)
    monkeypatch.setattr(brown, "SLICE", 5)
    train = queries.remainder("doc_id", 7) != 2
    kept = []
    got = brown.score(docs, scratch, train, classes=4, tolerance=0.001, most_rounds=rounds, steps=lambda k, m: kept.append(brown.likelihood(m))).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    is_train = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2
    c = Counter(w for r in rows if is_train(r["doc_id"]) for w in [*words(r["text"]), "\n"])
    n, v = sum(c.values()), len(c)
    score, values = brown_by_hand(rows, is_train, 4, 0.001, rounds)
    want, close = Counter(), {}
    for r in rows:
        w = [*words(r["text"]), "\n"]
        key = r["doc_id"], not is_train(r["doc_id"]), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)
        want[key] += 1
        close.setdefault(key, []).append(score(r["text"]))
    key = lambda r: (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
    assert want == Counter(map(key, got))
    for k in want:
        assert sorted(close[k]) == pytest.approx(sorted(r["score"] for r in got if key(r) == k), abs=1e-6)
    assert kept == pytest.approx(values) and kept == sorted(kept) and len(kept) > 1
    assert len({r["score"] for r in got}) > 10


def test_brown_probabilities_sum_to_one():
    pairs = np.array([[5, 3, 0], [2, 1, 4], [1, 5, 2]])
    counts = [np.array([4, 4]), np.array([9]), np.array([1, 2, 3])]  # words of each class; each class is entered as often as its words stand
    pairs = np.array([[3, 2, 1], [2, 4, 2], [3, 3, 3]])
    m = brown.Model(pairs, np.array([2, 1, 3]), 0, 23, 6)
    for prev in range(3):
        total = 10 ** m.unknown[prev]
        for k, c in enumerate(counts):
            total += sum(10 ** (m.move[prev, k] + math.log10(x - m.d) - m.mass[k]) for x in c)
        assert abs(total - 1) < 1e-9


def test_brown_empty(spark, empty, docs, scratch):
    assert brown.score(empty, scratch, F.lit(True), classes=4, most_rounds=1).count() == 0
    none = brown.score(docs.where("doc_id < 5"), scratch, F.lit(False), classes=4, most_rounds=1).collect()
    assert all(r["n_known"] == 0 and r["score"] == 0 and r["base_score"] == 0 for r in none) and len(none) == 5


@pytest.mark.parametrize("n", [1, 5, 24])
def test_histogram_sort(spark, docs, scratch, n):
    got = shards.histogram_sort(docs, scratch, shards=n).collect()
    rows = docs.collect()
    body = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len(body(r["text"])) + 8, zlib.crc32(body(r["text"]))) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(n)) and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in x) - total / n) <= 2 * most for x in by.values())


def test_equal_texts_are_neighbours_and_split(spark, scratch):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    got = shards.histogram_sort(df, scratch, shards=6).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 200
    order = [r["text"] == "same text" for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) <= 2


def test_histogram_sort_empty(empty, scratch):
    assert shards.histogram_sort(empty, scratch, shards=3).count() == 0


def test_pivot_search(spark, scratch):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(0, 0.2, 6)], 1) for i in range(400)]
    rows += [(400 + i, rows[0][1], 1) for i in range(50)]  # ties
    rows += [(900, None, 1), (901, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] + [0.0] * 5, 1), (904, [], 1), (None, [0.0] * 6, 1), (300, rows[300][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    v = pivots.quantised(df, "vec_id", "embedding", 1024)
    have = [(i, [math.floor(1024 * x) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    got = pivots.search(v, v.where("id % 50 = 0"), scratch, k=10, pivots=4, rings=3).collect()
    want = set()
    for q, e in {i: e for i, e in have if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(e, x, strict=True)), i) for i, x in have if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert Counter(tuple(r) for r in got) == Counter(want)
    few = v.where("id < 4")
    assert pivots.search(few, few, scratch, k=10).count() == 12
    assert pivots.search(v.where("id < 0"), v, scratch).count() == 0


@pytest.mark.parametrize("scale", [1e5, 4e9, 1e20])
def test_pivot_search_of_large_components(spark, scratch, scale):
    """Products beyond 2^53 are exact; scores beyond 64 bits are the nearest 64-bit number."""
    rnd = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rnd.normal(0, scale, 8)]) for i in range(120)]
    v = pivots.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1024)
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    have = [(i, [hold(math.floor(1024 * x)) for x in e]) for i, e in rows]
    want = set()
    for q, e in have[:3]:
        best = sorted((-hold(sum(a * b for a, b in zip(e, x, strict=True))), i) for i, x in have if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in pivots.search(v, v.where("id < 3"), scratch, k=10, pivots=4, rings=3).collect()} == want


def test_pivot_search_of_unequal_lengths(spark, scratch):
    v = spark.createDataFrame([(1, [1, 2]), (2, [1])], "id long, vec array<long>")
    with pytest.raises(ValueError):
        pivots.search(v, v, scratch)


def test_licenses(spark, scratch):
    apache = dict(licenses.TEMPLATES)["Apache-2.0-header"]
    changed = apache.replace("obtain a copy", "get one copy")
    texts = ["a b. Released under the MIT license! c", apache, "x " * 5000 + changed + " y" * 300, "Released under the MIT", "", None, "MIT", dict(licenses.TEMPLATES)["MPL-2.0"] + " tail", "a b. Released under the MIT license! c"]
    df = spark.createDataFrame([(0 if i == 8 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(0, "MIT"), (0, "MIT"), (1, "Apache-2.0"), (1, "Apache-2.0-header"), (2, "Apache-2.0"), (2, "Apache-2.0-header"), (7, "MPL-2.0")]
    assert {r["first_word"] for r in got if r["license"] == "MIT"} == {2}
    assert all(r["containment"] == 1 for r in got if r["doc_id"] in (0, 1, 7)) and all(0.8 <= r["containment"] <= 1 for r in got)
    with pytest.raises(ValueError):
        licenses.scan(df, [("short", "too few words")])
    assert licenses.scan(df.limit(0)).count() == 0


def hits(doc, items, size):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    d, hit, ids = w(doc), set(), set()
    for i, t in items:
        x = w(t)
        for k in range(max(1, len(x) - size + 1)) if x else []:
            g = x[k : k + size]
            for p in range(len(d) - len(g) + 1):
                if d[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    ids.add(str(i))
    return len(d), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [1 << 26, 200])
def test_decontamination(spark, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", limit)
    rows = docs.collect()
    texts = [r["text"] for r in rows if r["text"]]
    items = [(10, " ".join(texts[3].split()[:14])), (9, "One, two?"), (2, None), (3, ""), (4, "!!"), (5, " ".join(texts[-1].split()[:30])), (11, texts[3]), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, keep=("doc_id", "score"))
    want = Counter((r["doc_id"], *hits(r["text"], items[:-1], 10)) for r in rows)
    found = got.collect()
    assert want == Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found)
    assert sum(r["contaminated"] for r in found) >= 3
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(empty, bench).count() == 0


@pytest.mark.parametrize(("g", "share", "most"), [(32, 0.8, 0.005), (64, 0.8, 0.005), (128, 0.8, 0.005), (64, 1.0, 0.0005)])
def test_license_bands_at_the_edge(g, share, most):
    """How often no band of a full window agrees with a level's shortest template, of which it holds a share."""
    assert licenses.level_of(g + 1) < licenses.level_of(g + 2) == g
    rnd, n, draws = np.random.default_rng(7), g + 2, 20000
    held = math.ceil(share * n)
    missed = 0
    for _ in range(draws // 2000):
        h = rnd.integers(-(2**63), 2**63 - 1, (2000, n + 3 * g - held), dtype=np.int64)
        hit = np.zeros(2000, bool)
        for mask in licenses._seeds():
            x = h ^ np.int64(mask)
            hit |= x[:, :n].min(1) == x[:, n - held :].min(1)
        missed += int((~hit).sum())
    assert missed < most * draws


def test_decontamination_spans(spark):
    df = spark.createDataFrame([(1, "É x -- ONE,\n two; three four")], "doc_id long, text string")
    r = decontaminate.scan(df, spark.createDataFrame([(1, "one two three")], "item_id long, text string"), size=3).first()
    assert [df.first()["text"][s["first"] : s["last"]] for s in r["spans"]] == ["ONE,\n two; three"]


def test_warc(spark, scratch, tmp_path):
    big = "<p>" + "é" * 700
    rows = [(i, f"http://x/{i}", big if i % 3 == 0 else f"<b>{i}</b>", "x") for i in range(40)] + [(50, None, None, "x"), (51, "http://x/a\r\nb", "", "x"), (None, "http://n", big, "x"), (39, "http://twice", big, "x"), (60, "u", "small", "x"), (61, "u", "small", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    names = []
    for k in range(2):
        folder = f"file://{tmp_path}/{k}"
        made = warc.write(df.repartition(k + 1), folder, scratch, file_bytes=500, shard_bytes=4000)
        names.append([(r["file"], r["sha256"], r["records"]) for r in made.collect()])
        assert len(names[k]) > 3 and sum(n for _, _, n in names[k]) == len(rows)
        assert not list((tmp_path / str(k)).rglob("*.tmp"))
    assert names[0] == names[1]
    got = warc.read(spark, folder).collect()
    want = Counter()
    for i, _, t, _ in rows:
        b = (t or "").encode()
        again = len(b) >= 1000 and i != 39
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 39 if again else None] += 1
    assert want == Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    assert {bytes(r["payload"]) for r in got if r["page_id"] == 39} == {big.encode()}
    warc.write(df.limit(0), f"file://{tmp_path}/none", scratch)
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
    # A folder used before, and files that no manifest lists.
    warc.write(df.where("page_id < 3"), folder, scratch)
    (tmp_path / "1" / "pages-000000-00099.warc.gz").write_bytes(b"x")
    (run,) = {p.parent for p in (tmp_path / "1").glob("run-*/*.gz")} - {p.parent for p in (tmp_path / "1").glob("run-*/*.gz") if sum(1 for _ in p.parent.iterdir()) > 3}
    (run / "pages-000000-00098.warc.gz").write_bytes(b"x")
    assert sorted(r["page_id"] for r in warc.read(spark, folder).collect()) == [0, 1, 2]
    (file,) = run.glob("pages-000000-00000*")
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(Exception, match="not as the manifest has it"):
        warc.read(spark, folder).count()
    file.unlink()
    with pytest.raises(FileNotFoundError):
        warc.read(spark, folder)
    long = spark.createDataFrame([(1, "http://x", "<p>" + "word " * 400_000)], "page_id long, url string, html string")
    warc.write(long, f"file://{tmp_path}/long", scratch)
    assert warc.read(spark, f"file://{tmp_path}/long").first()["payload_bytes"] == 2_000_003
    with pytest.raises(FileNotFoundError):
        warc.read(spark, f"file://{tmp_path}/never")


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard(spark, docs, scratch, n, percent):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                up[root(i)] = root(j)
    low_ = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            low_[root(i)] = min(low_.get(root(i), 10**9), r["doc_id"])
    want = Counter((r["doc_id"], len(s), low_.get(root(i)) if s else r["doc_id"]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    got = jaccard.join(docs, scratch, n=n, percent=percent).collect()
    assert want == Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    assert len({r["component_id"] for r in got}) < len(rows) - 10


def test_jaccard_large_group(spark, scratch):
    """A group of near copies, with outliers that share its shingles, over several rounds."""
    import random

    rnd = random.Random(1)
    body = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(body)
        for _ in range(rnd.choice([0, 1, 1, 2, 6])):
            w[rnd.randrange(60)] = f"z{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    test_jaccard(spark, spark.createDataFrame(rows, "doc_id long, text string"), scratch, 4, 85)


def test_jaccard_empty(spark, empty, scratch):
    assert jaccard.join(empty, scratch).count() == 0
    none = jaccard.join(spark.createDataFrame([(1, None), (2, ""), (2, " ")], "doc_id long, text string"), scratch).collect()
    assert Counter(tuple(r)[:3] for r in none) == Counter([(1, 0, 1), (2, 0, 2), (2, 0, 2)])


def test_urls(spark, scratch):
    pages = [
        (1, "http://A.example.net/en/1", '<link href="http://x.org/q" rel=canonical>'),
        (2, "http://x.org/q", ""),
        (3, "http://b.net/", "<META HTTP-EQUIV='refresh' content='0; url=/r'>"),
        (4, "http://b.net/r", None),
        (5, "http://y.org/a", '<link rel="canonical" href="http://b.net/r">'),
        (6, "http://sub.org/fr/a", '<link rel="canonical" href="http://y.org/a">'),
        (7, None, '<link rel="canonical" href="http://b.net/r">'),
        (8, "no scheme", ""),
        (9, "http://example.com/de", ""),
        (10, "http://example.com/de/x?y", ""),
        (2, "http://x.org/q", ""),
        (11, "http://notexample.com/de/", "<link rel='stylesheet' href='http://b.net/r'>"),
        (12, "http://z.org/1", '<link rel="canonical" href="http://z.org/1">'),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, verdict string")
    got = urls.judge(df, queries.RULES, scratch).collect()
    verdicts = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(pages)
    assert verdicts == {
        1: ("example.net/en/", "allow"),
        2: (None, "allow"),
        3: ("net/", "block"),
        4: ("net/", "block"),
        5: (None, "block"),
        6: ("org/fr/", "allow"),
        7: (None, "allow"),
        8: (None, "allow"),
        9: (None, "allow"),
        10: ("example.com/de/", "block"),
        11: (None, "allow"),
        12: (None, "allow"),
    }
    many = [*queries.RULES, *[("block", f"h{i}.test", "/") for i in range(300)]]
    again = urls.judge(df, many, scratch, redirects=spark.createDataFrame([("http://x.org/q", "http://h7.test/z")], "a string, b string"))
    assert {r["page_id"]: r["verdict"] for r in again.collect()} == {k: "block" if k == 2 else v for k, (_, v) in verdicts.items()}
    assert urls.judge(df.limit(0), queries.RULES, scratch).count() == 0


def test_urls_of_relative_links(spark, scratch):
    from urllib.parse import urljoin

    bases = ["http://y.org/a/b/c?q=1#f", "http://y.org", "http://y.org/a/b/", "http://y.org/a/./b/../c", "http://y.org?x=/z"]
    tos = ["page.html", "../x", "?id=3", "#t", "./", "..", "../..", "../../../x/./y", ".", "/a/../b?u=../c", "//z.org/b", "g?u=http://z.org/", "http://z.org/x", "...", "x/..", "a.b/.c/..d"]
    df = spark.createDataFrame([(a, t) for a in bases for t in tos], "a string, t string")
    got = {(r["a"], r["t"]): r["b"] for r in df.select("a", "t", urls.resolved(F.col("a"), F.col("t")).alias("b")).collect()}
    assert got == {(a, t): urljoin(a, t) for a in bases for t in tos}
    none = spark.createDataFrame([("http://y.org/a", ""), ("http://y.org/a", "mailto:x"), ("no scheme", "x"), ("http://y.org/a", None)], "a string, t string")
    assert none.select(urls.resolved(F.col("a"), F.col("t"))).distinct().collect() == [(None,)]
    pages = [
        (1, "http://y.org/a/b", '<link rel="canonical" href="../q/page.html">'),
        (2, "http://w.org/", '<meta http-equiv="refresh" content="5; url=http://b.net/r">'),
        (3, "http://v.org/x/y", "<meta content='2.5;URL=z' http-equiv=refresh>"),
        (4, "http://y.org/q/page.html", '<link href="http://b.net/r" rel="canonical">'),
        (5, "http://v.org/x/z", '<link rel=canonical href=http://b.net/r>'),
        (6, "http://u.org/", '<meta http-equiv="refresh" content="30">'),
        (7, "http://t.org/", '<link rel="alternate canonical" href="http://b.net/r">'),
        (8, "http://s.org/", '<!-- <link rel="canonical" href="http://b.net/r"> --><b>'),
        (9, "HTTP://R.org/p#x", ""),
        (10, "http://q.org/", '<link rel=canonical href="http://r.ORG/p#y">'),
        (11, "http://r.org/p", '<link rel="canonical" href="http://b.net/r">'),
        (12, "http://p.org/", '<link rel="canonical-not" href="http://b.net/r">'),
    ]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.RULES, scratch).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {i: "allow" if i in (6, 8, 12) else "block" for i in range(1, 13)}


def test_packing(spark, docs, empty, scratch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer())
    some = docs.unionByName(spark.createDataFrame([(500, "a <|endoftext|> b", 0, "x"), (501, "日本 \U0001f600 x\r\n\t 1's", 0, "x")], docs.schema))
    most = 128
    got = packing.pack(packing.cut(some, queries.tokenizer(), keep=("doc_id", "text"), most=most), scratch, most=most).collect()
    by, want = {}, Counter()
    for r in some.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % most + 1, len(ids) + 1, most)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= most
    total = sum(r["length"] for r in got)
    assert len(by) <= math.ceil(total / most) * 1.2 + 1
    assert packing.pack(packing.cut(empty, queries.tokenizer()), scratch).count() == 0


def test_long_white_space_and_full_pieces(spark, scratch):
    from tokenizers import Tokenizer

    texts = [" " * 1_000_000, "a" + "\n" * 60_000 + "b", "x" * 200_000, "w " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(packing.cut(df, queries.tokenizer()), scratch).collect()
    tok = Tokenizer.from_file(queries.tokenizer())
    for i, t in enumerate(texts):
        assert sum(r["length"] for r in got if r["doc_id"] == i) == len(tok.encode(t, add_special_tokens=False).ids) + 1
    full = [r for r in got if r["length"] == 2048]
    assert len(full) > 3 and len({r["sequence_id"] for r in full}) == len(full) and not {r["sequence_id"] for r in full} & {r["sequence_id"] for r in got if r["length"] < 2048}


def test_plan_uses_each_piece_once():
    rnd = np.random.default_rng(2)
    counts = np.zeros(257, np.int64)
    counts[1:] = rnd.integers(0, 50, 256)
    counts[[100, 156, 256]] = [4000, 3500, 77]
    made = packing.plan(counts, 256)
    used = np.zeros(257, np.int64)
    for pat, n in made:
        assert sum(pat) <= 256
        for a in pat:
            used[a] += n
    assert (used == counts).all()
    assert sum(n for _, n in made) <= math.ceil((counts * np.arange(257)).sum() / 256) * 1.02


def test_toxicity(spark, scratch):
    import random

    rnd = random.Random(4)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(2):
                w[rnd.randrange(len(w))] = rnd.choice(["vile", "NASTY", "éxécrable"])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    rows += [(None, "vile", "x"), (2000, None, "x"), (2001, "", "x"), (5, "vile nasty vile", "x")]
    labels += [(3, 1), (4, None), (None, 1), (77777, 1)]  # 3 is labelled both ways
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab.where("doc_id % 2 = 0 or doc_id is null"))
    got = [(r["doc_id"], r["score"]) for r in toxicity.scores(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    seen = [(s >= 0.3, i % 9 == 0) for i, s in got if i is not None and i < 900 and i % 2 and i != 5]
    assert sum(a == b for a, b in seen) >= 0.97 * len(seen)
    assert dict(got)[2000] == dict(got)[2001] < 0.3
    for none in (lab.limit(0), lab.where("toxic = 1")):
        flat = toxicity.scores(docs, toxicity.train(docs, none)).select("score").distinct().collect()
        assert len(flat) == 1 and 0 <= flat[0][0] <= 1
    assert toxicity.scores(docs.limit(0), model).count() == 0


def toxicity_by_hand(texts, ys, discount=0.9, rare=0.001, mixed=40.0):
    """P(w | v, class) for any two words, from dictionaries of continuation counts."""
    before = [{}, {}], [{}, {}]  # words before each word, before each pair; by class
    for t, y in zip(texts, ys, strict=True):
        w = [None, None, *re.findall(r"[^\W\d_]+", t.lower())]
        for i in range(2, len(w)):
            before[0][y].setdefault(w[i], set()).add(w[i - 1])
            before[1][y].setdefault((w[i - 1], w[i]), set()).add(w[i - 2] if w[i - 1] is not None else None)
    beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def counts(level):
        n = [{x: len(s) for x, s in side.items()} for side in before[level]]
        total = [sum(x.values()) for x in n]
        p, out = total[1] / sum(total), [{}, {}]
        for x in {*n[0], *n[1]}:
            a, b = n[0].get(x, 0), n[1].get(x, 0)
            apart = beta(b + 0.5, a + 0.5) - math.log(math.pi)
            alike = beta(b + mixed * p, a + mixed * (1 - p)) - beta(mixed * p, mixed * (1 - p))
            weight = 1 / (1 + math.exp(-(apart - alike + math.log(rare / (1 - rare)))))
            for k, own in enumerate((a, b)):
                out[k][x] = weight * own * sum(total) / total[k] + (1 - weight) * (a + b)
        return n, out

    n, uni = counts(0)
    _, two = counts(1)
    every = {x: n[0].get(x, 0) + n[1].get(x, 0) for x in uni[0]}
    shared = lambda w: ((every[w] - min(discount, every[w])) if w in every else sum(min(discount, x) for x in every.values())) / sum(every.values())

    def word(w, k):
        size = sum(uni[k].values())
        x = uni[k].get(w, 0)
        return (x - min(discount, x) + sum(min(discount, c) for c in uni[k].values()) * shared(w)) / size

    def law(w, v, k):
        after = {x: c for (b, x), c in two[k].items() if b == v}
        if not after:
            return word(w, k)
        x = after.get(w, 0)
        return (x - min(discount, x) + sum(min(discount, c) for c in after.values()) * word(w, k)) / sum(after.values())

    return law, sorted(every)


def test_toxicity_laws_sum_to_one_and_match_brute_force():
    import random

    import pyarrow as pa

    rnd = random.Random(6)
    vocab = ["la", "le", "mi", "mo", "ne", "po"]
    texts, ys = [], []
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 9))]
        texts.append(" ".join([*w, *(["vile", "thing"] if i % 3 == 0 else [])]))
        ys.append(int(i % 3 == 0))
    law, words_ = toxicity_by_hand(texts, ys)
    model = toxicity.Models(texts, np.array(ys))
    for k in (0, 1):
        for v in [None, *words_, "unheard"]:
            assert sum(law(w, v, k) for w in [*words_, "never"]) == pytest.approx(1)
            for w in [*words_, "never"]:
                got = model.likelihoods(pa.array([w if v is None else f"{v} {w}"]))[k, 0] * (1 if v is None else 2)
                want = math.log(law(w, v, k)) + (math.log(law(v, None, k)) if v is not None else 0)
                assert got == pytest.approx(want, abs=1e-4)
    some = ["La po, vile THING never", "", "!!"]
    both = model.likelihoods(pa.array(some))
    seq = ["la", "po", "vile", "thing", "never"]
    for k in (0, 1):
        assert both[k] == pytest.approx([sum(math.log(law(w, v, k)) for v, w in zip([None, *seq], seq, strict=False)) / 5, 0, 0], abs=1e-4)
    assert both[1, 0] > both[0, 0]
    model.share = 0.2
    assert list(model.score(both)[1:]) == [0.2, 0.2]


def test_toxicity_weighs_rare_expressions():
    import random

    import pyarrow as pa

    rnd = random.Random(5)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    plain = lambda: [rnd.choice(vocab) for _ in range(60)]
    texts, ys = [], []
    for i in range(800):
        w, y = plain(), i % 2
        if y:
            w[30] = "seldomrare" if i < 28 else "rarer" if i < 38 else w[30]
            w[rnd.randrange(20)] = "vile" if i >= 38 else w[0]
        texts.append(" ".join(w))
        ys.append(y)
    model = toxicity.Models(texts, np.array(ys))
    base = plain()
    some = [" ".join([*base[:30], x, *base[31:]]) for x in (base[30], "unheard", "rarer", "seldomrare", "vile")]
    same, unheard, rarer, seldom, vile = model.means(pa.array(some)) * 60
    assert abs(same - unheard) < 0.3
    assert unheard < rarer < seldom < vile and seldom - unheard > 0.5


def test_toxicity_of_an_id_in_very_many_rows(spark):
    """Copies and texts of one id leave all others in the sample."""
    ids = list(range(20))
    hot = spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(F.xxhash64("doc_id")).first()[0]
    rows = [(i, "vile nasty words" if i % 2 else "plain good words") for i in ids] + [(hot, "plain good words")] * 200 + [(hot, f"text {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = [(r["h"], r["t"]) for r in toxicity.sample(docs, labels, "text", "doc_id", "toxic", 10)[0].collect()]
    n = Counter(h for h, _ in got)
    assert len(got) == len(set(got)) and len(n) == 20 and sorted(n.values()) == [1] * 19 + [toxicity.EACH]
    model = toxicity.train(docs, labels, most=10)
    score = {r["doc_id"]: r["score"] for r in toxicity.scores(docs.where(F.col("text").endswith("words")), model).collect()}
    assert min(s for i, s in score.items() if i % 2) > max(s for i, s in score.items() if not i % 2)


def test_queries_and_pipeline(spark):
    import os

    import corpus_pipeline

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, "/root/testdata/sf0.001")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out = base.Scratch(spark, "stage").keep(out, str(k))
        if k == 1:
            again = jaccard.join(out, base.Scratch(spark, "again"), n=5, percent=80)
            assert again.where("component_id <> doc_id").count() == 0
            groups = jaccard.join(left, base.Scratch(spark, "groups"), n=5, percent=80)
            assert groups.where("n_shingles > 0").select("component_id").distinct().count() + groups.where("n_shingles = 0").count() == out.count()
        if k == 2:
            items = [(r["item_id"], r["text"]) for r in queries.table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in left.collect() if not hits(r["text"], items, 10)[-1]}
        if k == 3:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in left.collect()}
        left = out
