"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch

#: Rows that pivots and annuli are chosen from, at most: those of smallest hash of the id.
SAMPLE = 4096
#: Rows of a cell that one task scores at a time.
BLOCK = 4096

INDEX = "id long, vec array<long>, norm double, pivot int, ring int, dist double"
#: Scores are 64-bit numbers; one beyond them counts as the nearest of them.
MOST_SCORE = (1 << 63) - 1


def quantised(df: DataFrame, ident: str, vector: str, scale: int) -> DataFrame:
    """id and vec, the floor of scale times each component as a double; rows with a null vector or id, or with null or non-finite components, are left out, and so are empty vectors. A component beyond 64 bits counts as the nearest 64-bit number."""
    v = F.col(vector)
    ok = v.isNotNull() & F.col(ident).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    vec = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    return df.where(ok).select(F.col(ident).cast("long").alias("id"), vec.alias("vec"))


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal lengths as a matrix of doubles; sums of products below 2^53 are exact."""
    return _whole(column).astype(np.float64)


def _whole(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, pair by pair, held to 64 bits."""
    sums = (q.astype(object) * v.astype(object)).sum(axis=1)
    return np.array([max(-MOST_SCORE - 1, min(MOST_SCORE, int(x))) for x in sums], dtype=np.int64)


class Pivots:
    """Pivots, the largest squared norm and the annuli's borders; bounded by the sample and the number of pivots.

    Vectors are lifted by one component, the root of largest norm^2 - norm^2, so
    all lie on one sphere and the inner product with a query falls as the
    distance to it rises: |q - v|^2 = |q|^2 + largest - 2 q v.
    """

    def __init__(self, sample: np.ndarray, largest: float, pivots: int, rings: int):
        self.largest = float(largest)
        lifted = self.lift(sample)
        chosen = [0]
        near = ((lifted - lifted[0]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(lifted)) and near.max() > 0:
            chosen.append(int(near.argmax()))  # the farthest from all so far
            near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        p = lifted[chosen]
        for _ in range(5):  # moved to the means of their cells
            own = self._distances(lifted, p).argmin(1)
            p = np.stack([lifted[own == i].mean(0) if (own == i).any() else p[i] for i in range(len(p))])
        self.points = p
        own, dist = self.cell(lifted)
        self.borders = [np.quantile(dist[own == i], np.linspace(0, 1, rings + 1)[1:-1]) if (own == i).any() else np.zeros(rings - 1) for i in range(len(p))]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.largest - (x * x).sum(1)))[:, None]], axis=1)

    @staticmethod
    def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T))

    def cell(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._distances(lifted, self.points)
        own = d.argmin(1)
        return own, d[np.arange(len(d)), own]

    def ring(self, own: np.ndarray, dist: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(self.borders[i], d) for i, d in zip(own, dist, strict=True)], dtype=np.int32)

    def to_queries(self, q: np.ndarray) -> np.ndarray:
        """Distances from queries, lifted by 0, to the pivots."""
        return self._distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.points)


def index(vectors: DataFrame, pivots: int, rings: int) -> tuple[DataFrame, Pivots | None]:
    """Every row of vectors (id, vec) keyed by its nearest pivot and the annulus of its distance; rows of INDEX.

    Pivots and borders come from a bounded sample (SAMPLE rows), the largest
    norm from all rows. Vectors must all have one length.
    """
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = vectors.agg(F.max(norm).alias("m"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
    if facts["m"] is None:
        return vectors.select("id", "vec", F.lit(0.0).alias("norm"), F.lit(0).alias("pivot"), F.lit(0).alias("ring"), F.lit(0.0).alias("dist")), None
    if facts["lo"] != facts["hi"]:
        raise ValueError(f"vectors have from {facts['lo']} to {facts['hi']} components")
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    model = Pivots(np.array([r["vec"] for r in sample], dtype=np.float64), facts["m"] * (1 + 1e-9), pivots, rings)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("vec"))
            own, dist = m.cell(m.lift(x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array((x * x).sum(1)), pa.array(own.astype(np.int32)), pa.array(m.ring(own, dist)), pa.array(dist)], ["id", "vec", "norm", "pivot", "ring", "dist"])

    return vectors.mapInArrow(run, INDEX), model


def search(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 10, pivots: int = 32, rings: int = 8, query_block: int = 128) -> DataFrame:
    """Each query's k highest inner products among all other vectors: query_id, rank (from 1), vec_id, score.

    vectors, queries: id, vec (whole numbers); ties go to the smaller id; a
    query's own id is no candidate. Fewer than k other vectors: all of them. A
    scores beyond 64 bits count as the nearest 64-bit number, so they tie. A
    query id that comes more than once is searched once (of its vectors, the
    least); vectors with one id are candidates each.

    The index keeps, for every cell (pivot and annulus), the bounds of the
    distances found in it over all rows. By the triangle inequality no vector of
    a cell is nearer to a query than the distance from the query's distance to
    the pivot to those bounds. First each query's nearest annuli, until they
    hold enough rows, give a lower bound of its k-th score; then the annuli are
    taken in order of their bound, and all beyond that score are never looked
    at. Rows of a cell are dealt into blocks, and queries into blocks for each
    cell, which are multiplied as matrices; each block gives back at most k rows
    a query, none below the bound.
    """
    found, model = index(vectors, pivots, rings)
    if model is None:
        return scratch.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = scratch.keep(found, "index")
    cells = rows.groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # at most pivots * rings
    cells = [(r["pivot"], r["ring"], r["lo"], r["hi"], r["n"]) for r in cells]
    place, lo, hi, n = np.array([c[0] for c in cells]), np.array([c[2] for c in cells]), np.array([c[3] for c in cells]), np.array([c[4] for c in cells])
    largest = model.largest
    sent = scratch.spark.sparkContext.broadcast(model)
    once = queries.groupBy("id").agg(F.min("vec").alias("vec"))

    def bounds(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance from each query to any vector of each cell, and the highest score that it leaves."""
        d = sent.value.to_queries(q)[:, place]
        size = (q * q).sum(1)[:, None] + largest
        least = np.maximum(0, np.maximum(lo - d, d - hi) - 1e-6 * np.maximum(1, np.sqrt(size)))
        return least, (size - least**2) / 2 + 1e-3 + 1e-9 * size

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _rows(batch.column("vec"))
                least, top = bounds(q)
                order = np.argsort(least, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                if first:  # annuli until k + 1 rows are surely met
                    i, j = np.nonzero(before < k + 1)
                else:
                    floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
                    i, j = np.nonzero((np.take_along_axis(top, order, 1) >= np.nan_to_num(floor, nan=-np.inf)[:, None]) & (before >= k + 1))
                c = order[i, j]
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("vec").take(at), batch.column("floor").take(at), pa.array(c.astype(np.int32))], ["id", "vec", "floor", "cell"])

        return run

    number = {(c[0], c[1]): i for i, c in enumerate(cells)}
    blocks = [max(1, -(-c[4] // BLOCK)) for c in cells]
    cell_of = F.element_at(F.create_map(*[x for (p, r), i in number.items() for x in (F.lit(p * rings + r), F.lit(i))]), F.col("pivot") * rings + F.col("ring"))
    count_of = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("cell") + 1)
    data = rows.select(cell_of.alias("cell"), "id", "vec").withColumn("part", F.pmod(F.xxhash64("id", "vec"), count_of).cast("int"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .jaccard import runs

        for _, tab in runs(_keyed(batches), "_key"):
            kind = tab["kind"].to_numpy()
            own, asked = tab.filter(pa.array(kind == 0)), tab.filter(pa.array(kind == 1))
            if not own.num_rows or not asked.num_rows:
                continue
            v, ids = _rows(own["vec"]), own["id"].to_numpy()
            for a in range(0, asked.num_rows, query_block):
                some = asked.slice(a, query_block)
                qi = some["id"].to_numpy()
                q = _rows(some["vec"])
                s = q @ v.T
                # Beyond 2^53 doubles only tell which pairs may be wanted; those are multiplied as whole numbers.
                slack = np.sqrt((q * q).sum(1) * (v * v).sum(1).max())
                slack = np.where(slack < 1 << 52, 0.0, slack * 1e-12)
                s[qi[:, None] == ids[None]] = -np.inf
                floor = np.nan_to_num(some["floor"].to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                if s.shape[1] > k:  # the k-th best of the block is a bound too; ties stay
                    floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
                i, j = np.nonzero((s >= np.where(floor >= 2.0**62, -np.inf, floor - 2 * slack)[:, None]) & np.isfinite(s))
                if slack.any():
                    whole = _exact(_whole(some["vec"])[i], _whole(own["vec"])[j])
                else:
                    whole = s[i, j].astype(np.int64)
                order = np.lexsort((ids[j], ~whole, i))
                i, j, whole = i[order], j[order], whole[order]
                start = np.searchsorted(i, np.arange(len(qi)))
                keep = np.arange(len(i)) - start[i] < k
                i, j, whole = i[keep], j[keep], whole[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(ids[j]), pa.array(whole)], ["query_id", "vec_id", "score"])

    def met(asked: DataFrame) -> DataFrame:
        asks = asked.withColumn("part", F.explode(F.sequence(F.lit(0), count_of - 1))).withColumn("kind", F.lit(1))
        both = data.withColumn("kind", F.lit(0)).withColumn("floor", F.lit(None).cast("long")).unionByName(asks)
        dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        return dealt.mapInArrow(score, "query_id long, vec_id long, score long")

    kind = "id long, vec array<long>, floor long, cell int"
    near = scratch.keep(met(once.withColumn("floor", F.lit(None).cast("long")).mapInArrow(visits(True), kind)), "near")
    ranked = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # at most k a block met first
    floor = ranked.select(F.col("query_id").alias("id"), F.when(F.size("s") >= k, F.element_at("s", k)).alias("floor"))
    far = met(once.join(floor, "id", "left").select("id", "vec", "floor").mapInArrow(visits(False), kind))
    return best(near.unionByName(far), k)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = (batch.column("cell").to_numpy().astype(np.int64) << 32) + batch.column("part").to_numpy()
        yield batch.append_column("_key", pa.array(key))


def best(scored: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
