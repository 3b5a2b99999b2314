"""Printed page numbers: runs of one offset, strays, gaps and occurrences."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offset_runs(reads: DataFrame, volume: str) -> DataFrame:
    """Gaps and islands: runs of reads (pdf_index, printed) whose printed number keeps its distance to the index."""
    w = W.partitionBy(volume).orderBy("pdf_index")
    at = reads.where("printed is not null").withColumn("offset", F.col("printed") - F.col("pdf_index"))
    at = at.withColumn("_new", F.when(F.col("offset") == F.lag("offset").over(w), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    out = at.groupBy(volume, "run", "offset").agg(F.min("pdf_index").alias("from_pdf"), F.max("pdf_index").alias("to_pdf"), F.count(F.lit(1)).alias("n_reads"), F.min("printed").alias("first_printed"), F.max("printed").alias("last_printed"))
    return out.withColumn("run", F.col("run").cast("long"))


def stray_indexes(reads: list[tuple[int, int]], least: int = 3, bracketed: int = 8) -> set[int]:
    """Indexes whose number is out of step, of reads in order of the index.

    A run of one offset goes if both neighbours agree on another offset and it
    is short enough to be bracketed, or if it is shorter than ``least`` beside a
    run that isn't; again, until nothing goes.
    """
    left, gone = list(reads), set()
    while True:
        runs = [list(g) for _, g in groupby(left, key=lambda r: r[1] - r[0])]
        off = [r[0][1] - r[0][0] for r in runs]
        out: set[int] = set()
        for i, run in enumerate(runs):
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(runs)]
            between = len(near) == 2 and len(run) <= bracketed and off[near[0]] == off[near[1]] != off[i]
            beside = len(run) < least and any(len(runs[j]) >= least for j in near)
            if between or beside:
                out.update(x for x, _ in run)
        if not out:
            return gone
        gone |= out
        left = [r for r in left if r[0] not in out]


def strays(reads: DataFrame, volume: str) -> DataFrame:
    """Adds stray to reads (volume, pdf_index, printed): a fold over each volume, as dropping runs makes neighbours of others."""
    kind = reads.schema[volume].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pdf_index")
        known = pdf[pdf["printed"].notna()]
        out = stray_indexes(list(zip(known["pdf_index"].astype(int), known["printed"].astype(int), strict=True)))
        return pdf.assign(stray=pdf["pdf_index"].isin(out))[[volume, "pdf_index", "printed", "stray"]]

    return reads.select(volume, "pdf_index", "printed").groupBy(volume).applyInPandas(fold, f"`{volume}` {kind}, pdf_index long, printed long, stray boolean")


def fill_gaps(reads: DataFrame, volume: str) -> DataFrame:
    """Numbers for unread pages between two reads that are as far apart in print as in the file: volume, pdf_index, printed, inferred."""
    w = W.partitionBy(volume).orderBy("pdf_index")
    known = reads.where("printed is not null")
    nxt = known.select(volume, "pdf_index", "printed", F.lead("pdf_index").over(w).alias("_i"), F.lead("printed").over(w).alias("_p"))
    even = (F.col("_i") - F.col("pdf_index") > 1) & (F.col("_p") - F.col("printed") == F.col("_i") - F.col("pdf_index"))
    filled = nxt.where(even).select(volume, F.explode(F.sequence(F.col("pdf_index") + 1, F.col("_i") - 1)).alias("pdf_index"), (F.col("printed") - F.col("pdf_index")).alias("_d"))
    filled = filled.select(volume, "pdf_index", (F.col("pdf_index") + F.col("_d")).alias("printed"), F.lit(True).alias("inferred"))
    return known.select(volume, "pdf_index", "printed", F.lit(False).alias("inferred")).unionByName(filled)


def occurrences(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds occurrence: null the first time that keys come, then 2, 3 and so on."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return pages.withColumn("occurrence", F.when(n > 1, n))


def longest_run(numbers: DataFrame, key: str) -> DataFrame:
    """The longest run of consecutive numbers of each group: first number and length; of several, the first."""
    d = numbers.select(key, "n").distinct()
    d = d.withColumn("_g", F.col("n") - F.row_number().over(W.partitionBy(key).orderBy("n")))
    runs = d.groupBy(key, "_g").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("length"))
    best = runs.groupBy(key).agg(F.min(F.struct((-F.col("length")).alias("m"), F.col("first").alias("first"))).alias("x"))
    return best.select(key, F.col("x.first").alias("first"), (-F.col("x.m")).alias("length"))


def in_force(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds in_force: the last value up to here that isn't null."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("in_force", F.last(value, True).over(w))

