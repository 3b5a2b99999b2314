"""Whole pages as lists of lines: printed numbers taken off, gutters between columns, spacing, redaction labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = re.compile(r"\s*([0-9]{1,4})\s*")
_ROMAN = re.compile(r"\s*([ivxlc]{1,6})(?:\s+\1)*\s*")
_VALID = re.compile(r"(?:xl|l)?x{0,3}(?:ix|iv|v?i{0,3})")
_TABBED = re.compile(r"\s*(?:[A-Z]\s{2,}([0-9]{1,4})|([0-9]{1,4})\s{2,}[A-Z])\s*")
FOOT, HEAD = 4, 3

# A gutter is blank on so many of the lines, so wide, in the middle part of the page, with text on both sides of so many lines.
BLANK, WIDE, MIDDLE, SIDES, SIDES_SHARE, LINES, WIDTH = 0.9, 3, (0.3, 0.7), 6, 0.22, 8, 40


def _edge(lines: list[str], last: bool) -> int | None:
    """The outermost line with text, if it is near enough to the foot or the head."""
    at = range(len(lines) - 1, max(-1, len(lines) - 1 - FOOT), -1) if last else range(min(HEAD, len(lines)))
    return next((i for i in at if lines[i].strip()), None)


def take_folio(lines: list[str], paren: bool = False, roman: bool = False) -> tuple[int | None, str | None, list[str]]:
    """Printed number (or, if asked for, Roman one) of a page and the lines without it.

    The foot's outermost line is tried first, then the head's. At the foot a
    thumb letter may stand beside the number, or on a line of its own below it.
    """

    def number(i: int) -> int | None:
        if m := _NUMBER.fullmatch(lines[i]):
            return int(m[1])
        if paren and (m := re.fullmatch(r"\s*\(\s*([0-9]{1,4})\s*\)\s*", lines[i])):
            return int(m[1])
        return None

    without = lambda *gone: [x for k, x in enumerate(lines) if k not in gone]
    foot, head = _edge(lines, True), _edge(lines, False)
    if foot is not None:
        if m := _TABBED.fullmatch(lines[foot]):
            return int(m[1] or m[2]), None, without(foot)
        if re.fullmatch(r"\s*[A-Z]\s*", lines[foot]):
            above = next((k for k in range(foot - 1, -1, -1) if lines[k].strip()), None)
            if above is not None and (m := _NUMBER.fullmatch(lines[above])):
                return int(m[1]), None, without(foot, above)
        elif (n := number(foot)) is not None:
            return n, None, without(foot)
    if head is not None and (n := number(head)) is not None:
        return n, None, without(head)
    if roman:
        for i in (foot, head):
            if i is not None and (m := _ROMAN.fullmatch(lines[i])) and _VALID.fullmatch(m[1]):
                return None, m[1], without(i)
    return None, None, list(lines)


def folios(pages: DataFrame, key: str, text: str = "text", **options: bool) -> DataFrame:
    """key, printed, roman and the body of each page (lines joined again); a stateless scan of pages."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [take_folio((t or "").split("\n"), **options) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.string()), pa.array(["\n".join(m[2]) for m in made], pa.string())], [key, "printed", "roman", "body"])

    return pages.select(key, text).mapInArrow(run, f"`{key}` {kind}, printed int, roman string, body string")


def gutter(lines: list[str]) -> tuple[int, int] | None:
    """First and last column (exclusive) of the blank strip between two columns of text, or None."""
    shown = [x for x in lines if x.strip()]
    width = max(map(len, shown), default=0)
    if len(shown) < LINES or width < WIDTH:
        return None
    lo, hi = int(np.floor(width * MIDDLE[0])), int(np.ceil(width * MIDDLE[1]))
    blank = np.zeros((len(shown), hi + 2), dtype=bool)
    for row, line in zip(blank, shown, strict=True):
        row[len(line) :] = True  # beyond the line's end
        for m in re.finditer(" {2,}", line):
            row[max(0, m.start() - 1) : m.end() + 1] = True  # give or take one
    free = blank.mean(0) >= BLANK
    free[:lo] = free[hi + 1 :] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(int)))
    best = max(((sum(bool(x[:a].strip()) and bool(x[b:].strip()) for x in shown), b - a, -a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= WIDE), default=None)
    if best is None or best[0] < SIDES or best[0] < SIDES_SHARE * len(shown):
        return None
    return -best[2], -best[2] + best[1]


def gutters(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, first and last of the pages that have a gutter."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gutter((t or "").split("\n")) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, g in enumerate(found) if g])
            some = [g for g in found if g]
            if some:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([g[0] for g in some], pa.int32()), pa.array([g[1] for g in some], pa.int32())], [key, "first", "last"])

    return pages.select(key, text).mapInArrow(run, f"`{key}` {kind}, first int, last int")


def single_spaced(text: Column) -> Column:
    """A page with every run of empty lines one shorter, where 60 % of its lines with text stand above an empty line (of four or more)."""
    text = F.regexp_replace(text, "(?m)^[ \t\r\f\x0b]+$", "")
    lines = F.split(text, "\n")
    shown = F.size(F.filter(lines, lambda x: x != ""))
    above = F.regexp_count(text, F.lit("[^\n]\n(?=\n|$)"))
    tight = F.regexp_replace(F.regexp_replace(text, "(?<!\n)\n\n(?!\n)", "\n"), "\n{3,}", "\n\n")
    return F.when((shown >= 4) & (above * 10 >= shown * 6), tight).otherwise(text)


CODE = r"\(b\)\((?:7\)(?:\([A-F]\))?|[1-9]\))"


def redacted(line: Column) -> Column:
    """Exemption codes in a line become one label; a line of a code alone, which stands in the margin, becomes null."""
    label = F.regexp_replace(line, rf"(?<![0-9§])({CODE}(?:[ ,.]{{0,2}}{CODE})*)(?! ?\([A-Z]\))", "[Redacted: $1]")
    spaced = F.regexp_replace(label, r"\(b\)\((?=[1-9])", "(b) (")
    spaced = F.regexp_replace(spaced, r"(\))[ ,.]{0,2}(?=\(b\) \()", "$1, ")
    return F.when(~line.rlike(rf"^\s*{CODE}\s*$"), spaced)


def exemption_codes(text: Column) -> Column:
    """All exemption codes of a text, in order, as (b) (7)(C)."""
    return F.transform(F.regexp_extract_all(text, F.lit(CODE), 0), lambda c: F.replace(c, F.lit("(b)("), F.lit("(b) (")))


def batches(files: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Adds batch: files in order, as many to a batch as stay within ``most`` bytes, one at least. A fold over each key, as where a batch ends decides where the next begins."""
    import pandas as pd

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in (key, order, size))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, n, held = [], 0, 0
        for x in pdf[size]:
            if held and held + x > most:
                n, held = n + 1, 0
            held += x
            out.append(n)
        return pdf.assign(batch=out)[[key, order, size, "batch"]]

    return files.select(key, order, size).groupBy(key).applyInPandas(fold, f"{kinds}, batch int")
