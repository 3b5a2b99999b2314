"""Every query of the catalog against its SQL, and none of them empty."""

import collections
import glob
import math
import os

import duckdb
import pytest

from quire.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or type(v).__name__ in ("NAType", "NaTType"):
        return None
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    return v


def rows(df):
    return collections.Counter(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.Q))
def test_query(spark, con, name):
    got = catalog.Q[name](spark, DIR).toPandas()
    if name in catalog.SQL:
        want = con.sql(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    if name not in ("anchor_chains", "unique_anchors", "near_words"):
        assert len(got)


def gutter(lines):
    """The widest-sided strip of columns that are blank on nine lines of ten, column by column."""
    shown = [x for x in lines if x.strip()]
    width = max(map(len, shown), default=0)
    if len(shown) < 8 or width < 40:
        return None
    blank = lambda x, c: c >= len(x) or any(x[k : k + 2] == "  " for k in range(max(0, c - 2), c + 2))
    free = [c for c in range(math.floor(width * 0.3), math.ceil(width * 0.7) + 1) if sum(blank(x, c) for x in shown) >= 0.9 * len(shown)]
    strips = [(a, a + n) for a in free if a - 1 not in free for n in [next(n for n in range(1, width + 2) if a + n not in free)] if n >= 3]
    best = max(((sum(bool(x[:a].strip() and x[b:].strip()) for x in shown), b - a, -a) for a, b in strips), default=(0, 0, 0))
    return (-best[2], -best[2] + best[1]) if best[0] >= max(6, 0.22 * len(shown)) else None


def test_page_gutters_of_whole_texts(spark, con):
    want, short = set(), 0
    for i, text in con.sql("SELECT doc_id, text FROM documents").fetchall():
        flat = (text or "").replace("\n", "_").replace(" ", "_")
        cut = [flat[k : k + 25] for k in range(0, len(flat), 25)]
        n = (len(cut) + 1) // 2
        at = gutter([a.ljust(26) + "    " + b for a, b in zip(cut[:n], [*cut[n:], ""], strict=False)])
        if at:
            want.add((i, *at))
            short += len(flat) <= 700
    got = catalog.Q["page_gutters"](spark, DIR).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert short


def test_page_gutters_sees_the_end_of_a_text(spark, tmp_path):
    """A strip that only the first lines of a page have is no gutter."""
    texts = [(1, "x" * 2000), (2, "x" * 400), (3, "x" * 300), (4, ""), (5, None), (6, ("é" * 24 + "\t") * 30 + "  \n" * 300)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["first"], r["last"]) for r in catalog.Q["page_gutters"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 6}
    assert got[1] == got[2]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
