"""Benchmark decontamination by one Aho-Corasick automaton over the normalised items."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch

#: Words are runs of letters and digits of ASCII and of all other characters.
_NORMAL = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first:int,last:int>>"
#: Item bytes that one automaton may hold; larger benchmarks are scanned for in several passes. Windows overlap, so an
#: automaton of 1 MB of items takes about 470 MB of each worker process, as measured.
PASS_BYTES = 1 << 20
_built: dict = {}


def normalise(text: str | None) -> bytes:
    """Words in lower case (A-Z only), one space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split())


def windows(text: str | None, size: int) -> list[bytes]:
    """All runs of size words; the whole of an item of fewer, but not none."""
    w = normalise(text).split()
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def _automaton(key: str, items: list[tuple[str, str | None]], size: int):
    """One automaton a worker process; patterns are padded with spaces so that only whole words match."""
    if key not in _built:
        import ahocorasick

        patterns: dict[bytes, set[str]] = {}
        for ident, text in items:
            for w in windows(text, size):
                patterns.setdefault(w, set()).add(ident)
        auto = ahocorasick.Automaton()
        for w, ids in patterns.items():
            auto.add_word(f" {w.decode('utf-8', 'surrogatepass')} ", (w.count(b" ") + 1, sorted(ids)))
        auto.make_automaton()
        _built.clear()
        _built[key] = auto if patterns else None
    return _built[key]


def _scan(auto, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged runs (first word, word after) that are hit, and the items."""
    plain = normalise(text)
    n = plain.count(b" ") + 1 if plain else 0
    if auto is None or not n:
        return n, [], set()
    padded = f" {plain.decode('utf-8', 'surrogatepass')} "
    runs: list[list[int]] = []
    items: set[str] = set()
    seen = at = 0
    for end, (size, ids) in auto.iter(padded):  # ends rise, so the spaces before them are counted once
        at += padded.count(" ", seen, end)
        seen = end
        first, items = at - size, items.union(ids)
        while runs and runs[-1][1] >= first:
            first = min(first, runs.pop()[0])
        runs.append([first, at])
    return n, [(a, b) for a, b in runs], items


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """Finds occurrences of the items' windows of size words in every whole text.

    Returns the columns of keep and: n_words; n_hit, words inside any
    occurrence; n_items and items, those with occurring windows, in order of
    their ids as strings; items_sha256 of the comma-joined ids; contaminated;
    spans of characters (first, after the last) in the original text.

    Null and empty texts have no words; null and empty items have no windows;
    items that share a window are all named; repeated documents are separate
    rows; an empty benchmark leaves all clean; other columns of docs are not
    read. Items must have ids: rows without are left out of the benchmark.

    The benchmark's bytes are counted before it is sent to the executors. Over
    PASS_BYTES it is cut into parts by a hash of the ids, each scanned for in a
    pass of its own, and the runs of each document are then merged.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = 1 + total // PASS_BYTES
    if parts == 1:
        sent = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
        return _pass(docs, sent, text, keep, size)
    scratch = Scratch(spark, "decontaminate")
    numbered = scratch.keep(docs.select(*keep, text).withColumn("_row", F.monotonically_increasing_id()), "docs")
    part = F.pmod(F.xxhash64("item"), F.lit(parts))
    found = []
    for k in range(parts):
        sent = spark.sparkContext.broadcast([tuple(r) for r in items.where(part == k).collect()])
        found.append(scratch.keep(_pass(numbered, sent, text, ("_row",), size), f"part-{k}"))
        sent.unpersist()
    hits = found[0].where("contaminated")
    for f in found[1:]:
        hits = hits.unionByName(f.where("contaminated"))
    merged = hits.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return numbered.join(merged, "_row", "left").mapInArrow(lambda batches: _merge(batches, text, keep), _schema(docs, keep))


def _schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), FOUND])


def _row(n: int, runs: list[tuple[int, int]], items: list[str], text: str | None) -> tuple:
    spans = []
    if runs:
        at = [m.span() for m in _WORD.finditer(text)]
        spans = [{"first": at[a][0], "last": at[b - 1][1]} for a, b in runs]
    return n, sum(b - a for a, b in runs), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(runs), items, spans


def _table(batch: pa.RecordBatch, keep: tuple[str, ...], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
    names = [x.split()[0] for x in FOUND.replace("struct<first:int,last:int>", "s").split(", ")]
    cols = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], [*keep, *names])


def _pass(docs: DataFrame, sent, text: str, keep: tuple[str, ...], size: int) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, sent.value, size)
        for batch in batches:
            rows = []
            for value in batch.column(text):
                n, runs, items = _scan(auto, s := value.as_py())
                rows.append(_row(n, runs, sorted(items), s))
            yield _table(batch, keep, rows)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, _schema(docs, keep))


def _merge(batches: Iterator[pa.RecordBatch], text: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Joins what several passes found in a text."""
    for batch in batches:
        rows = []
        for s, items, spans in zip(batch.column(text).to_pylist(), batch.column("items").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs: list[list[int]] = []
            if spans:
                at = {}
                for k, m in enumerate(_WORD.finditer(s)):
                    at[m.start()], at[-m.end()] = k, k + 1
                for a, b in sorted((at[x["first"]], at[-x["last"]]) for x in spans):
                    if runs and runs[-1][1] >= a:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
            plain = normalise(s)
            rows.append(_row(plain.count(b" ") + 1 if plain else 0, [tuple(r) for r in runs], items or [], s))
        yield _table(batch, keep, rows)
