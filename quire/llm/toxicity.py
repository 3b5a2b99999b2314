"""Toxicity by two class-conditional Kneser-Ney models that share their backoff."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .base import Scratch, lean, trim

#: Words are runs of ASCII letters and of all characters beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Labelled texts of each class that the models are fitted on, at most.
MOST = 2000
#: Different texts of one id that they are fitted on, at most.
EACH = 4
#: Bytes of a row of a model's file.
PART_BYTES = 8 << 20


def sample(docs: DataFrame, labels: DataFrame, text: str, ident: str, label: str, most: int) -> tuple[DataFrame, float]:
    """Rows (h, t, y) of at most ``most`` labelled ids of each class, those with the smallest hash of the id, and the share of toxic ones among all labelled.

    Rows that repeat both id and text are one, and of each id's texts at most
    EACH stay, those with the smallest hash, so an id in very many rows takes no
    other's place. This bounds all that the models hold. Rows of labels with another value than
    0 or 1 are left out, and so are ids labelled both ways; null texts are empty.
    """
    mine = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_id")).agg(F.min(label).alias("y"), F.max(label).alias("hi")).where("y = hi").select("_id", "y")
    share = mine.agg(F.avg("y")).first()[0]
    there = mine.join(docs.select(F.col(ident).alias("_id")), "_id", "left_semi")
    # Ids are chosen first, so texts of the chosen alone are dealt out.
    ids = [there.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most) for y in (0, 1)]
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(ids[0].unionByName(ids[1])), "_id")
    place = F.row_number().over(W.partitionBy("_id").orderBy(F.xxhash64("t"), "t"))
    rows = rows.distinct().withColumn("place", place).where(F.col("place") <= EACH)
    return rows.select(F.xxhash64("_id").alias("h"), "t", "y"), float(share if share is not None else 0.0)


class Table:
    """Open hash table from 64-bit keys to rows; key 0 isn't used. Rows are 1 and up, 0 is absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.slots = np.zeros(1 << self.bits, dtype=np.int32)
        self.keys = np.concatenate([[np.uint64(0)], keys]).astype(np.uint64)
        left, at = np.arange(1, len(self.keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]  # of several, the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((out != 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            out[open_] = self.slots[at[open_]]
            here = out[open_]
            open_ = open_[(here != 0) & (self.keys[here] != keys[open_])]
        return out


def stream(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts, in lower case, with the hashes of their words and the number of words before each text."""
    for first, last, off, data in tokens.pieces(pc.utf8_lower(texts)):
        starts, ends, before, low = tokens.words(off, data, LETTERS)
        yield first, last, tokens.hashes(starts, ends, low) | np.uint64(1), before


def before_of(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The word before each word; 0 at the start of a text."""
    prev = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h
    prev[before[:-1][np.diff(before) > 0]] = 0
    return prev


def pair_keys(h: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """Key of each word with the word before it."""
    return tokens.mix(prev * np.uint64(0x9E3779B97F4A7C15) + h) | np.uint64(1)


def _contexts(keys: np.ndarray, context: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and for both classes in how many different contexts each stands."""
    both = np.unique(keys)
    out = np.zeros((2, len(both)))
    for k in (0, 1):
        at = np.flatnonzero(ys == k)
        _, first = np.unique(tokens.mix(keys[at] ^ tokens.mix(context[at])), return_index=True)
        u, n = np.unique(keys[at[first]], return_counts=True)
        out[k, np.searchsorted(both, u)] = n
    return both, out


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(a) + _lgamma(b) - _lgamma(a + b), dtype=float)


def _own(n: np.ndarray, total: np.ndarray, rare: float, mixed: float) -> np.ndarray:
    """Probability that the classes use an expression at rates of their own, from its counts in both.

    Beforehand it is ``rare``. Else the classes share it up to the mix of
    languages and topics, which spreads its share in the toxic class as a beta
    law of strength ``mixed`` about that class's share of all counts.
    """
    kinds, back = np.unique(n.T.astype(np.int64), axis=0, return_inverse=True)
    if not len(kinds):
        return np.zeros(0)
    p = min(max(float(total[1] / max(1.0, total.sum())), 1e-6), 1 - 1e-6)
    a, b = np.array([mixed * p]), np.array([mixed * (1 - p)])
    apart = _log_beta(kinds[:, 1] + 0.5, kinds[:, 0] + 0.5) - math.log(math.pi)
    alike = _log_beta(kinds[:, 1] + a, kinds[:, 0] + b) - _log_beta(a, b)
    return (1 / (1 + np.exp(-np.clip(apart - alike + math.log(rare / (1 - rare)), -30, 30))))[back.ravel()]


def _per_class(n: np.ndarray, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Counts of each class as if it had the texts of both: its own as far as the classes differ in an expression, those of both together as far as they share it."""
    every, out = n.sum(0), np.zeros((2, n.shape[1]))
    for k in (0, 1):
        own = n[k] * (total.sum() / total[k]) if total[k] else every
        out[k] = weight * own + (1 - weight) * every
    return out


class Models:
    """Bigram models of the ordinary (0) and the toxic (1) class, by interpolated Kneser-Ney with shared backoff.

    All counts are continuation counts: of a pair, how many different words
    stand before it; of a word, how many different words stand before it. Copies
    of a passage therefore count once. A class's counts are its own so far as
    the classes are taken to differ in an expression, else those of both
    (``_own``, ``_per_class``); every word and pair of the texts is kept. Then

        P(w)            = (n(w) - d(w)) / n                              of both classes, an unknown word has sum d / n
        P(w | class)    = (n_c(w) - d_c(w)) / n_c + sum d_c / n_c P(w)
        P(w | v, class) = (n_c(v w) - d_c(v w)) / n_c(v) + sum d_c / n_c(v) P(w | class)

    with d the lesser of the count and ``discount``, which is below 1. A word before which there
    is no word that the texts have follows P(w | class). Over all words of the
    texts and the unknown one, each law sums to 1.
    """

    def __init__(self, texts: list[str], ys: np.ndarray, discount: float = 0.9, rare: float = 0.001, mixed: float = 40.0):
        hs, prevs, owner = [], [], []
        for first, last, h, b in stream(pa.array(texts, pa.string())):
            hs.append(h)
            prevs.append(before_of(h, b))
            owner.append(np.repeat(ys[first:last].astype(np.int8), np.diff(b)))
        h, prev, y = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hs, np.uint64), (prevs, np.uint64), (owner, np.int8)))
        del hs, prevs, owner
        words, uni = _contexts(h, prev, y)
        total = uni.sum(1)
        n = uni.sum(0)
        held = np.minimum(n, discount)
        shared = np.concatenate([n - held, [held.sum()]]) / max(1.0, n.sum())  # the last is the unknown word
        if not len(words):
            shared[:] = 1.0
        mine = _per_class(uni, total, _own(uni, total, rare, mixed))
        held = np.minimum(mine, discount)
        size = mine.sum(1, keepdims=True)
        p = np.concatenate([mine - held, np.zeros((2, 1))], axis=1) / np.maximum(size, 1e-300) + np.where(size > 0, held.sum(1, keepdims=True) / np.maximum(size, 1e-300), 1.0) * shared
        with np.errstate(divide="ignore"):
            # Row 0 of a table is what it doesn't hold.
            self.word = np.log(np.concatenate([p[:, -1:], p[:, :-1]], axis=1)).astype(np.float32)
        self.words = Table(words)
        pairs = pair_keys(h, prev)
        two_before = np.where(prev == 0, np.uint64(0), np.concatenate([prev[:1], prev[:-1]]))
        keys, two = _contexts(pairs, two_before, y)
        at = np.searchsorted(keys, pairs)
        # Both words of each pair; v is 0 at the start of a text.
        v, w = np.zeros(len(keys), dtype=np.int32), np.zeros(len(keys), dtype=np.int32)
        v[at], w[at] = np.where(prev == 0, 0, np.searchsorted(words, prev) + 1), np.searchsorted(words, h)
        del pairs, two_before, at, h, prev, y
        mine = _per_class(two, two.sum(1), _own(two, two.sum(1), rare, mixed))
        self.pair, self.rest = np.zeros((2, len(keys) + 1), np.float32), np.zeros((2, len(words) + 1), np.float32)
        for k in (0, 1):
            held = np.minimum(mine[k], discount)
            after, freed = (np.bincount(v, weights=x, minlength=len(words) + 1) for x in (mine[k], held))
            rest = np.where(after > 0, freed / np.maximum(after, 1e-300), 1.0)
            self.pair[k, 1:] = np.log((mine[k] - held) / np.maximum(after[v], 1e-300) + rest[v] * p[k][w])
            self.rest[k] = np.log(rest)
        self.pairs = Table(keys)
        self.curve, self.share = (0.0, -1.0), 0.0

    def logs(self, h: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(word | word before it, class) for each word of a run of texts, a row a class; a pair that the texts don't hold backs off to the word."""
        prev = before_of(h, before)
        q, w = self.pairs.rows(pair_keys(h, prev)), self.words.rows(h)
        v = np.where(prev == 0, 0, self.words.rows(prev))
        known = (prev == 0) | (v > 0)
        return np.where(q > 0, self.pair[:, q], self.word[:, w] + np.where(known, self.rest[:, v], np.float32(0))).astype(float)

    def likelihoods(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihood of each text under the ordinary and the toxic model, each divided by the number of words; 0 without words."""
        out = np.zeros((2, len(texts)))
        for first, last, h, b in stream(texts):
            d = np.concatenate([np.zeros((2, 1)), np.cumsum(self.logs(h, b), axis=1)], axis=1)
            out[:, first:last] = (d[:, b[1:]] - d[:, b[:-1]]) / np.maximum(np.diff(b), 1)
        return out

    def means(self, texts: pa.Array) -> np.ndarray:
        """Toxic less ordinary log-likelihood a word."""
        both = self.likelihoods(texts)
        return both[1] - both[0]

    def score(self, likelihoods: np.ndarray) -> np.ndarray:
        """From what ``likelihoods`` gives; a text without words gets the share of toxic labels."""
        a, b = self.curve
        score = 1 / (1 + np.exp(-np.clip(a * bend(likelihoods[1] - likelihoods[0]) + b, -30, 30)))
        return np.where((likelihoods == 0).all(0), self.share, score)


def bend(x: np.ndarray) -> np.ndarray:
    """Sign and order of x, with a scale that rises steeply near 0: one expression in a thousand words counts."""
    return np.sign(x) * np.log1p(np.abs(x) / 0.001)


def logistic(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | x) by Newton's steps, classes weighted to the given share; a weak prior holds both finite."""
    n1 = max(1, int(y.sum()))
    n0 = max(1, len(y) - int(y.sum()))
    wt = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    X, t = np.stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(t @ X, -30, 30)))
        step = np.linalg.solve((X * (wt * p * (1 - p))) @ X.T + 0.01 * np.eye(2), X @ (wt * (y - p)) - 0.01 * t)
        t = t + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def fit(texts: list[str], ys: np.ndarray, share: float) -> Models:
    """Models of all texts; the curve from difference to score is fitted on texts that the models at hand have not seen, in two halves.

    Without texts of both classes every text gets the share of toxic labels.
    """
    share = min(max(share, 1e-4), 1 - 1e-4)
    curve = None
    if min(int((ys == 0).sum()), int((ys == 1).sum())) > 1:
        half = np.zeros(len(ys), dtype=np.int64)
        for k in (0, 1):
            half[np.flatnonzero(ys == k)[1::2]] = 1
        x = np.zeros(len(ys))
        for k in (0, 1):  # one model at a time is held
            seen, new = np.flatnonzero(half != k), np.flatnonzero(half == k)
            x[new] = Models([texts[i] for i in seen], ys[seen]).means(pa.array([texts[i] for i in new], pa.string()))
            trim()
        curve = logistic(bend(x), ys, share)
    model = Models(texts, ys)
    model.share = share
    if curve is None:
        flat = float(np.log(share / (1 - share)))
        model.curve, model.share = (0.0, flat), float(1 / (1 + np.exp(-flat)))
    else:
        model.curve = (max(curve[0], 0.0), curve[1])
    return model


class Fitted:
    """Where a fitted model lies in the shared folder. Executors read it there; the driver never holds it."""

    def __init__(self, path: str, share: float):
        self.path, self.share = path, share

    def load(self) -> Models:
        """The model, read once a worker process."""
        if self.path not in _held:
            from pyarrow import fs

            where, path = fs.FileSystem.from_uri(self.path)
            parts = ds.dataset(path, filesystem=where, format="parquet", schema=pa.schema([("part", pa.int32()), ("data", pa.binary())])).to_table().sort_by("part")
            _held.clear()
            _held[self.path] = pickle.loads(b"".join(parts["data"].to_pylist())) if len(parts) else fit([], np.zeros(0, np.int64), self.share)
        return _held[self.path]


_held: dict[str, Models] = {}


def scores(docs: DataFrame, model: Fitted, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score (0 to 1, higher: likelier toxic), toxic_ll and ordinary_ll (log-likelihoods a word) of every whole text; texts without words (null and empty ones too) get 0 for both and the share of toxic labels as their score.

    The model is bounded by the sample that it was fitted on, and executors read
    it from the shared folder. Only the text is read for the score; repeated
    rows are scored alike, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            fitted = model.load()
            ordinary, toxic = both = fitted.likelihoods(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, (fitted.score(both), toxic, ordinary))], [*keep, "score", "toxic_ll", "ordinary_ll"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, f"{kinds}, score double, toxic_ll double, ordinary_ll double")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "toxic", most: int = MOST) -> Fitted:
    """Models fitted on at most ``most`` labelled texts of each class (documented bound; chosen by hash of the id, alike at every size).

    One task fits them, as the sample is bounded, and writes them into the
    shared folder in parts of PART_BYTES.
    """
    rows, share = sample(docs, labels, text, ident, label, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        parts = [b for b in batches if b.num_rows]
        got = pa.Table.from_batches(parts).sort_by([("h", "ascending"), ("t", "ascending")]) if parts else None
        made = pickle.dumps(fit(got["t"].to_pylist() if got else [], got["y"].to_numpy().astype(np.int64) if got else np.zeros(0, np.int64), share), protocol=5)
        for k in range(0, len(made), PART_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([k // PART_BYTES], pa.int32()), pa.array([made[k : k + PART_BYTES]], pa.binary())], ["part", "data"])
        del got, made, parts
        trim()

    scratch = Scratch(docs.sparkSession, "toxicity")
    scratch.keep(rows.repartition(1).mapInArrow(run, "part int, data binary"), "model")
    return Fitted(scratch.path("model"), share)
