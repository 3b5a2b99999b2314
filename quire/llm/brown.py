"""Brown class-based bigrams: exchange clustering of all words, smoothed class transitions and word emissions, log-probabilities of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .base import Scratch, lean, release
from .jaccard import planes, runs, unplanes

#: Bytes of text in a block, the unit that a task holds at a time.
BLOCK_BYTES = 8 << 20
#: Blocks, and buckets, that one task goes through one after the other.
BLOCKS, BUCKETS = 5, 10
#: Distinct words that one bucket is to have, about.
BUCKET = 1 << 15
#: Words that are weighed against all classes at a time.
SLICE = 4096
#: Counts below this are looked up in tables of their logarithms.
SMALL = 64
#: Stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)

ENC = "block long, ids array<{}>, lengths array<int>, train array<boolean>, words binary, counts binary, stream binary"
WORDS = "bucket int, block long, deltas binary, counts binary"
VOCABULARY = "bucket int, words binary, counts binary, n_words long, n_tokens long, top array<struct<n:long,bucket:int,at:int>>"
NUMBERS = "bucket int, block long, known binary, at binary, counts binary"
BLOCK = "block long, ids array<{}>, lengths array<int>, train array<boolean>, stream binary, end int, buckets array<int>, sizes array<int>, at binary, counts binary"
ASK = "bucket int, block long, at binary, per binary, tags binary, ns binary"
STATE = "bucket int, classes binary, ending int"
REPLY = "bucket int, block long, classes binary"


def encode(docs: DataFrame, text: str, ident: str, train: Column) -> DataFrame:
    """Blocks of texts as local numbers of their distinct words, in order of the hash; nothing is exchanged."""
    own = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    kind = own.schema["_id"].dataType.simpleString()

    def flush(number: int, held: list) -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        lengths = np.concatenate([x[1] for x in held])
        ids = pa.concat_arrays([x[2] for x in held])
        train_ = np.concatenate([x[3] for x in held])
        u, inverse = np.unique(h, return_inverse=True)
        counts = np.bincount(inverse[np.repeat(train_, lengths)], minlength=len(u))
        block = (TaskContext.get().partitionId() << 32) + number
        one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, t))
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), one(ids, None), one(lengths.astype(np.int32), pa.int32()), one(train_, pa.bool_()), pa.array([u.astype("<u8").tobytes()], pa.binary()), pa.array([planes(counts)], pa.binary()), pa.array([planes(inverse)], pa.binary())],
            ["block", "ids", "lengths", "train", "words", "counts", "stream"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size, number = [], 0, 0
        for batch in batches:
            marks = batch.column("_train").to_numpy(zero_copy_only=False).astype(bool)
            for first, last, off, data in tokens.pieces(batch.column("_text")):
                starts, ends, before, low = tokens.words(off, data)
                h = tokens.hashes(starts, ends, low)
                h = np.insert(h, before[1:], END)  # one end after each text
                held.append((h, np.diff(before) + 1, batch.column("_id").slice(first, last - first), marks[first:last]))
                size += len(data) + 16 * (last - first)
                if size >= BLOCK_BYTES:
                    yield flush(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield flush(number, held)

    return own.mapInArrow(run, ENC.format(kind))


class Buckets:
    """Ranges of the hash to which words are dealt."""

    def __init__(self, n: int):
        self.n = max(1, n)
        self.bounds = np.array([-(-(j << 64) // self.n) for j in range(self.n)], dtype=np.uint64)

    def cut(self, u: np.ndarray) -> list[tuple[int, int, int]]:
        at = [*np.searchsorted(u, self.bounds), len(u)]
        return [(j, int(a), int(b)) for j, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<struct<n:long,bucket:int,at:int>>": pa.list_(pa.struct([("n", pa.int64()), ("bucket", pa.int32()), ("at", pa.int32())]))}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 64:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one after the other; nothing of a row stays when the next is asked for."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _by_bucket(df: DataFrame, buckets: Buckets) -> DataFrame:
    return df.repartition(max(12, -(-buckets.n // BUCKETS)), "bucket").sortWithinPartitions("bucket", "block")


def asked_words(enc: DataFrame, buckets: Buckets) -> DataFrame:
    """For every block and bucket the hashes of the block's words there and their counts in its training texts; rows of WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()

        def rows():
            for r in _rows(batches):
                u, c = np.frombuffer(r["words"], "<u8"), unplanes(r["counts"])
                for j, a, b in buckets.cut(u):
                    yield j, r["block"], planes(np.diff(u[a:b], prepend=buckets.bounds[j])), planes(c[a:b])

        yield from _batches(rows(), WORDS)

    return enc.select("block", "words", "counts").mapInArrow(run, WORDS)


def count(asked: DataFrame, buckets: Buckets, top: int) -> DataFrame:
    """The vocabulary, bucket by bucket: sorted hashes of the words of training texts, their counts, and each bucket's commonest; rows of VOCABULARY.

    Blocks' lists are added to the bucket's a few at a time, so a bucket costs its words, however many blocks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        now, u, c = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add():
            nonlocal u, c, held
            h = np.concatenate([u, *(x for x, _ in held)])
            n = np.concatenate([c, *(y for _, y in held)])
            u, inverse = np.unique(h, return_inverse=True)
            c = np.bincount(inverse, weights=n.astype(float), minlength=len(u)).astype(np.int64)
            held = []

        def done():
            add()
            best = np.lexsort((u, -c))[:top]
            return now, u.astype("<u8").tobytes(), planes(c), len(u), int(c.sum()), [{"n": int(c[i]), "bucket": now, "at": int(i)} for i in best]

        def rows():
            nonlocal now, u, c
            for r in _rows(batches):
                if r["bucket"] != now:
                    if now is not None:
                        yield done()
                    now, u, c = r["bucket"], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                n = unplanes(r["counts"]).astype(np.int64)
                h = _hashes(r["deltas"], buckets.bounds[now])
                held.append((h[n > 0], n[n > 0]))
                if sum(len(x) for x, _ in held) > max(BUCKET, len(u)):
                    add()
            if now is not None:
                yield done()

        yield from _batches(rows(), VOCABULARY)

    return _by_bucket(asked, buckets).mapInArrow(run, VOCABULARY)


def number(asked: DataFrame, vocabulary: DataFrame, buckets: Buckets) -> DataFrame:
    """Which words of a block training texts have, their places in their buckets and their counts; rows of NUMBERS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()

        def rows():
            for r in _rows(batches):
                if r["block"] < 0:
                    u, c = np.frombuffer(r["words"], "<u8"), unplanes(r["totals"])
                    continue
                h = _hashes(r["deltas"], buckets.bounds[r["bucket"]])
                at = np.minimum(np.searchsorted(u, h), max(0, len(u) - 1))
                known = u[at] == h if len(u) else np.zeros(len(h), bool)
                at = at[known]
                yield r["bucket"], r["block"], np.packbits(known).tobytes() + bytes([len(known) % 8]), planes(np.diff(at, prepend=0)), planes(c[at])

        yield from _batches(rows(), NUMBERS)

    first = vocabulary.select("bucket", F.lit(-1).cast("long").alias("block"), "words", F.col("counts").alias("totals"))
    return _by_bucket(first.unionByName(asked.select("bucket", "block", "deltas"), allowMissingColumns=True), buckets).mapInArrow(run, NUMBERS)


def _hashes(deltas: bytes, base: np.uint64) -> np.ndarray:
    return base + np.cumsum(unplanes(deltas), dtype=np.uint64)


def _known(packed: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(packed[:-1], np.uint8)).astype(bool)
    return bits[: len(bits) - (8 - packed[-1]) % 8]


def numbered(enc: DataFrame, numbers: DataFrame, parts: int) -> DataFrame:
    """Blocks whose streams number the known words from 1, bucket by bucket, and all others 0; rows of BLOCK."""
    kind = BLOCK.format(enc.schema["ids"].dataType.elementType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for block, tab in runs(batches, "block"):
            last = tab.slice(tab.num_rows - 1, 1)
            told = tab.slice(0, tab.num_rows - 1)
            known = np.concatenate([_known(x) for x in told["known"].to_pylist()])
            places = np.where(known, np.cumsum(known), 0)
            words = np.frombuffer(last["words"][0].as_py(), "<u8")
            end = np.searchsorted(words, END)
            end = int(places[end]) if end < len(words) and words[end] == END else 0
            at, counts = [unplanes(x) for x in told["at"].to_pylist()], [unplanes(x) for x in told["_counts"].to_pylist()]
            some = [i for i, x in enumerate(at) if len(x)]
            joined = lambda x: planes(np.concatenate([x[i] for i in some]) if some else np.zeros(0, np.uint64))
            which = told["bucket"].to_pylist()
            one = lambda x: pa.array([x], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *(last[c].combine_chunks() for c in ("ids", "lengths", "train")), pa.array([planes(places[unplanes(last["stream"][0].as_py()).astype(np.int64)])], pa.binary())]
                + [pa.array([end], pa.int32()), one([which[i] for i in some]), one([len(at[i]) for i in some]), pa.array([joined(at)], pa.binary()), pa.array([joined(counts)], pa.binary())],
                [f.split(" ")[0] for f in BLOCK.split(", ")],
            )

    rows = enc.drop("counts").withColumn("bucket", F.lit(1 << 30))
    told = numbers.select("block", "bucket", "known", "at", F.col("counts").alias("_counts"))
    return rows.unionByName(told, allowMissingColumns=True).repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, kind)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """What the classes add to the log-likelihood of the training texts (in nats): all else stays when words move."""
    m = pairs.astype(float)
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def _with_replies(blocks: DataFrame, replies: DataFrame | None, parts: int, *columns: str) -> DataFrame:
    """Blocks, each with the replies of the buckets before it."""
    rows = blocks.select("block", *columns).withColumn("bucket", F.lit(1 << 30))
    if replies is None:
        return rows
    rows = rows.unionByName(replies.select("block", "bucket", F.col("classes").alias("_classes")), allowMissingColumns=True)
    return rows.repartition(parts, "block").sortWithinPartitions("block", "bucket")


def _classes_of(tab: pa.Table, replied: bool, seeds: dict[tuple[int, int], int], k: int) -> np.ndarray:
    """Classes of a block's words by their number; -1 at 0."""
    last = tab.slice(tab.num_rows - 1, 1)
    if replied:
        told = [np.frombuffer(c, np.int16) for c in tab.slice(0, tab.num_rows - 1)["_classes"].to_pylist()]
        return np.concatenate([np.array([-1], np.int16), *told]).astype(np.int64)
    out = np.full(1 + sum(last["sizes"][0].as_py()), k - 1, np.int64)
    out[0], first = -1, 1
    for j, at in _lists(last["buckets"][0].as_py(), last["sizes"][0].as_py(), last["at"][0].as_py()):
        for (bucket, x), c in seeds.items():
            if bucket == j and (i := int(np.searchsorted(at, x))) < len(at) and at[i] == x:
                out[first + i] = c
        first += len(at)
    return out


def _lists(buckets: list[int], sizes: list[int], at: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket of a block the places of the block's words in it."""
    deltas, first = unplanes(at), 0
    for j, n in zip(buckets, sizes, strict=True):
        yield j, np.cumsum(deltas[first : first + n]).astype(np.int64)
        first += n


def observe(blocks: DataFrame, replies: DataFrame | None, seeds: dict[tuple[int, int], int], k: int, parts: int) -> DataFrame:
    """What each block saw: for its words, how often a word of each class followed and preceded them in training texts; and, in a row of bucket -1, its class pairs. Rows of ASK."""
    replied = replies is not None

    def see(block: int, s: np.ndarray, classes: np.ndarray, buckets: list[int], sizes: list[int], at: bytes) -> Iterator[tuple]:
        cls = classes[s]
        yield -1, block, None, planes(np.bincount(cls[:-1] * k + cls[1:], minlength=k * k)), None, None
        kind = np.int32 if (sum(sizes) + 1) * 2 * k < 1 << 31 else np.int64
        s, cls = s.astype(kind), cls.astype(kind)
        key, n = np.unique(np.concatenate([s[:-1] * (2 * k) + cls[1:], s[1:] * (2 * k) + k + cls[:-1]]), return_counts=True)
        word, tag = np.divmod(key, 2 * k)
        per = np.bincount(word, minlength=sum(sizes) + 1)[1:]
        a = x = 0
        for j, places in _lists(buckets, sizes, at):
            mine = per[a : a + len(places)]
            a, y = a + len(places), x + int(mine.sum())
            some = mine > 0  # words of held-out texts alone have nothing to tell
            if some.any():
                yield j, block, planes(np.diff(places[some], prepend=0)), planes(mine[some]), tag[x:y].astype(np.uint8).tobytes(), planes(n[x:y])
            x = y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()

        def rows():
            for block, tab in runs(batches, "block"):
                last = tab.slice(tab.num_rows - 1, 1)
                classes = _classes_of(tab, replied, seeds, k)
                train = np.repeat(np.array(last["train"][0].as_py(), bool), np.array(last["lengths"][0].as_py(), np.int64))
                s = unplanes(last["stream"][0].as_py()).astype(np.int32)[train]
                if len(s):  # all of its words are known, and the end of a text stands before it
                    s = np.concatenate([np.array([last["end"][0].as_py()], np.int32), s])
                    yield from see(block, s, classes, last["buckets"][0].as_py(), last["sizes"][0].as_py(), last["at"][0].as_py())

        yield from _batches(rows(), ASK)

    return _with_replies(blocks, replies, parts, "lengths", "train", "stream", "end", "buckets", "sizes", "at").mapInArrow(run, ASK)


class Moves:
    """What moving a word would bring, from counts of class pairs; what small counts add is kept in tables."""

    def __init__(self, m: np.ndarray):
        self.k = len(m)
        self.m, self.left, self.right = m, m.sum(1), m.sum(0)
        # Row d: class d follows; row k + d: class d precedes. Columns: the class moved to.
        self.beside = np.concatenate([m.T, m])
        self.f = _xlogx(self.beside)
        v = np.arange(SMALL)
        self.more = np.stack([_xlogx(self.beside + x) - self.f for x in v])
        self.total = [np.stack([_xlogx(t + x) - _xlogx(t) for x in v]) for t in (self.left, self.right)]

    def _rise(self, n: np.ndarray, side: int) -> np.ndarray:
        """By how much the total of each class, to which n is added, raises x log x; a row a word."""
        out = self.total[side][np.minimum(n, SMALL - 1)]
        t = (self.left, self.right)[side]
        for i in np.flatnonzero(n >= SMALL):
            out[i] = _xlogx(t + n[i]) - _xlogx(t)
        return out

    def __call__(self, w: np.ndarray, tag: np.ndarray, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Best class of each word. w, tag, n: how often word w has the neighbour tag, in order of w; every word has one at least."""
        size, k = len(cls), self.k
        after = tag < k
        n_left, n_right = (np.bincount(w[x], n[x], size).astype(np.int64) for x in (after, ~after))
        now = self.beside[tag, cls[w]]
        stay = np.bincount(w, _xlogx(now) - _xlogx(np.maximum(now - n, 0)), size)
        for t, x in ((self.left, n_left), (self.right, n_right)):
            stay -= _xlogx(t[cls]) - _xlogx(np.maximum(t[cls] - x, 0))
        gain = np.zeros((size, k))
        for a in range(0, len(w), 1 << 15):
            ww, tt, nn = w[a : a + (1 << 15)], tag[a : a + (1 << 15)], n[a : a + (1 << 15)]
            rows = self.more[np.minimum(nn, SMALL - 1), tt]
            big = np.flatnonzero(nn >= SMALL)
            rows[big] = _xlogx(self.beside[tt[big]] + nn[big, None]) - self.f[tt[big]]
            first = np.flatnonzero(np.concatenate([[True], ww[1:] != ww[:-1]]))
            gain[ww[first]] += np.add.reduceat(rows, first, axis=0)
        gain -= self._rise(n_left, 0) + self._rise(n_right, 1)
        gain[np.arange(size), cls] = -np.inf
        best = gain.max(1)
        to = (gain >= best[:, None] - 1e-9).argmax(1)  # of near equal ones, the first class
        return np.where(best > stay + 1e-9, to, cls)


def exchange(asks: DataFrame, state: DataFrame, pairs: np.ndarray, k: int, buckets: Buckets) -> DataFrame:
    """Moves every word to the class that raises the likelihood of the class pairs most, all other words held where they were; rows of STATE.

    pairs: counts of class pairs in all training texts. What blocks saw is added
    up as it comes, words of a bucket by classes; words are weighed SLICE at a
    time. Ties go to the smaller class, and a word stays where no move is better.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        moves = Moves(pairs.astype(float))

        def moved(cls: np.ndarray, seen: np.ndarray) -> bytes:
            new = cls.copy()
            for a in range(0, len(cls), SLICE):
                w, tag = np.nonzero(seen[a : a + SLICE])
                new[a : a + SLICE] = moves(w, tag, seen[a : a + SLICE][w, tag], cls[a : a + SLICE])
            return new.astype(np.int16).tobytes()

        def rows():
            now = None
            for r in _rows(batches):
                if r["block"] < 0:
                    if now is not None:
                        yield now, moved(cls, seen), ending
                    now, ending, cls = r["bucket"], r["ending"], np.frombuffer(r["_classes"], np.int16).astype(np.int64)
                    seen = np.zeros((len(cls), 2 * k), np.int64)
                    continue
                w = np.repeat(np.cumsum(unplanes(r["at"])).astype(np.int64), unplanes(r["per"]).astype(np.int64))
                seen[w, np.frombuffer(r["tags"], np.uint8)] += unplanes(r["ns"]).astype(np.int64)  # no cell twice in one row
            if now is not None:
                yield now, moved(cls, seen), ending

        yield from _batches(rows(), STATE)

    first = state.select("bucket", F.lit(-1).cast("long").alias("block"), F.col("classes").alias("_classes"), "ending")
    return _by_bucket(first.unionByName(asks.where("bucket >= 0"), allowMissingColumns=True), buckets).mapInArrow(run, STATE)


def tell(blocks: DataFrame, state: DataFrame, buckets: Buckets) -> DataFrame:
    """The classes of every block's words, bucket by bucket; rows of REPLY."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from _batches(((j, r["block"], planes(np.diff(at, prepend=0))) for r in _rows(batches) for j, at in _lists(r["buckets"], r["sizes"], r["at"])), "bucket int, block long, at binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()

        def rows():
            for r in _rows(batches):
                if r["block"] < 0:
                    cls = np.frombuffer(r["_classes"], np.int16)
                else:
                    yield r["bucket"], r["block"], cls[np.cumsum(unplanes(r["at"])).astype(np.int64)].tobytes()

        yield from _batches(rows(), REPLY)

    first = state.select("bucket", F.lit(-1).cast("long").alias("block"), F.col("classes").alias("_classes"))
    asked = blocks.select("block", "buckets", "sizes", "at").mapInArrow(lists, "bucket int, block long, at binary")
    return _by_bucket(first.unionByName(asked, allowMissingColumns=True), buckets).mapInArrow(run, REPLY)


def begun(vocabulary: DataFrame, seeds: dict[tuple[int, int], int], k: int, buckets: Buckets) -> DataFrame:
    """The state before any move; rows of STATE. ending: the place of the end of a text in its bucket, else -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for r in _rows(batches):
                u = np.frombuffer(r["words"], "<u8")
                cls = np.full(len(u), k - 1, np.int16)
                for (bucket, at), c in seeds.items():
                    if bucket == r["bucket"]:
                        cls[at] = c
                end = int(np.searchsorted(u, END))
                yield r["bucket"], cls.tobytes(), end if end < len(u) and u[end] == END else -1

        yield from _batches(rows(), STATE)

    return vocabulary.select("bucket", "words").mapInArrow(run, STATE)


def _pairs(asks: DataFrame, k: int) -> np.ndarray:
    """Class pairs of all blocks, added up by Spark; k * k counts come to the driver."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for r in _rows(batches):
            total += unplanes(r["per"]).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    out = np.zeros(k * k, np.int64)
    for r in asks.where("bucket = -1").select("per").mapInArrow(spread, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(k, k)


class Model:
    """Class transitions and emission totals; bounded by the number of classes.

    P(w | v) = P(class of w | class of v) (c(w) - d) / N(class of w). The
    discounts of a class go to words that no training text has, one type, so
    P(unknown | v) is the sum over classes of P(class | class of v) d kinds / N.
    Transitions are smoothed towards the classes' own shares. The class before
    is that of the last known word; at a text's start, of the end of a text.
    Over all known words and the unknown one, probabilities sum to 1.
    """

    def __init__(self, pairs: np.ndarray, kinds: np.ndarray, end_class: int, tokens_: int, words: int, discount: float = 0.75, prior: float = 4.0):
        self.end, self.n, self.v, self.d = end_class, tokens_, words, discount
        mass = pairs.sum(0).astype(float)  # tokens of each class: every token follows one
        share = mass / max(1.0, mass.sum())
        move = (pairs + prior * share) / (pairs.sum(1, keepdims=True) + prior)
        with np.errstate(divide="ignore"):
            self.move = np.log10(move)
            self.mass = np.log10(mass)
            self.unknown = np.log10(move @ np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 0))

    def score(self, classes: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 P of each token of a stream; classes are -1 for unknown words; begins: where a text begins."""
        known = classes >= 0
        last = np.maximum.accumulate(np.where(known, np.arange(len(classes)), -1))  # every text ends with a known token
        before = np.concatenate([[-1], last[:-1]])
        prev = np.where(before >= 0, classes[np.maximum(before, 0)], self.end)
        prev[begins] = self.end
        c = np.maximum(classes, 0)
        return np.where(known, self.move[prev, c] + np.log10(np.maximum(counts - self.d, 1e-9)) - self.mass[c], self.unknown[prev])


def score(
    docs: DataFrame, scratch: Scratch, train: Column, text: str = "text", ident: str = "doc_id", classes: int = 64, tolerance: float = 0.02, most_rounds: int = 40, steps: Callable[[int, np.ndarray], None] | None = None
) -> DataFrame:
    """Scores all whole texts under the class model learnt from the rows where ``train`` holds.

    Words are runs of other bytes than space and 0x09-0x0D, A-Z in lower case;
    one end token follows each text. Returns ident, held_out, n_tokens, n_known
    (tokens that training has), train_tokens, base_score (add-one unigram over
    training words and one unknown), score, and perplexity of the text.

    All words of all training texts are counted and clustered. The commonest
    classes - 1 words begin in classes of their own, all others in the last. In
    each round every word moves to the class of most gain against the counts of
    the round before. As words move at once, the likelihood of what came of it
    is counted: a round that lowers it is taken back and is the last, and so is
    one that gains less than ``tolerance`` nats a training token; most_rounds is
    a guard that no run should meet. ``steps``, if given, is called with the
    number and class pairs of each state that was kept, the first (0) included.
    Words are told apart by 64-bit hashes.

    Texts stay in blocks where they were read. Blocks send, for each distinct
    word, how often each class stood next to it; buckets of words add up, choose
    and answer. A message is for one block and one bucket and holds a word at
    least, so there are never more than there are distinct words of all blocks.
    Nothing but class pairs (classes squared) and the commonest ``classes``
    words come to the driver or go out to all.

    Null and empty texts are the end alone; repeated rows count and are scored
    each; ties between words or classes go to the smaller hash or class; without
    training rows every token has log10(1 / 1) for base_score and score; other
    columns are not read. classes: 128 at most.
    """
    enc = scratch.keep(encode(docs, text, ident, train), "texts")
    release(docs.sparkSession)
    sized = enc.agg(F.sum(F.length("words") / 8).alias("w"), F.count(F.lit(1)).alias("n")).first()
    buckets = Buckets(int((sized["w"] or 0) // 4 // BUCKET) + 1)
    parts = max(12, -(-int(sized["n"]) // BLOCKS))
    asked = scratch.keep(asked_words(enc, buckets), "asked")
    vocabulary = scratch.keep(count(asked, buckets, classes), "vocabulary")
    release(docs.sparkSession)
    total = vocabulary.agg(F.sum("n_words").alias("v"), F.sum("n_tokens").alias("n")).first()
    v, n = int(total["v"] or 0), int(total["n"] or 0)
    top = vocabulary.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "bucket", "at").limit(classes - 1).collect()
    seeds = {(r["bucket"], r["at"]): i for i, r in enumerate(top)}
    state = scratch.keep(begun(vocabulary, seeds, classes, buckets), "state-0")
    numbers = scratch.keep(number(asked, vocabulary, buckets), "numbers")
    scratch.drop("asked", "vocabulary")
    blocks = scratch.keep(numbered(enc, numbers, parts), "blocks")
    scratch.drop("texts", "numbers")

    replies = None
    asks = scratch.keep(observe(blocks, None, seeds, classes, parts), "asks-0")
    pairs = _pairs(asks, classes)
    if steps:
        steps(0, pairs)
    for k in range(1, most_rounds + 1):
        moved = scratch.keep(exchange(asks, state, pairs, classes, buckets), f"state-{k}")
        scratch.drop(f"asks-{k - 1}")
        told = scratch.keep(tell(blocks, moved, buckets), f"replies-{k}")
        release(docs.sparkSession)
        asks = scratch.keep(observe(blocks, told, seeds, classes, parts), f"asks-{k}")
        now = _pairs(asks, classes)
        gain = (likelihood(now) - likelihood(pairs)) / max(1, n)
        if gain > 0:
            state, replies, pairs = moved, told, now
            scratch.drop(f"state-{k - 1}", f"replies-{k - 1}")
            if steps:
                steps(k, pairs)
        if gain < tolerance:
            scratch.drop(f"asks-{k}")
            break
    if replies is None:
        replies = scratch.keep(tell(blocks, state, buckets), "replies-0")
    kinds, end_class = _kinds(state, classes)
    model = Model(pairs, kinds, end_class, n, v)
    return _scored(blocks, replies, model, parts, ident)


def _kinds(state: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Distinct words of each class, and the class of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            c = np.frombuffer(r["classes"], np.int16)
            end = [int(c[r["ending"]])] if r["ending"] >= 0 else []
            n = np.bincount(c, minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array([*range(k), *([-1] if end else [])], pa.int32()), pa.array([*n.tolist(), *end], pa.int64())], ["c", "n"])

    out, end = np.zeros(k), 0
    for r in state.mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        if r["c"] < 0:
            end = int(r["n"])
        else:
            out[r["c"]] = r["n"]
    return out, end


def _scored(blocks: DataFrame, replies: DataFrame, model: Model, parts: int, ident: str) -> DataFrame:
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for _, tab in runs(batches, "block"):
            last = tab.slice(tab.num_rows - 1, 1)
            classes = _classes_of(tab, True, {}, 0)
            stream = unplanes(last["stream"][0].as_py()).astype(np.int32)
            lengths, train = np.array(last["lengths"][0].as_py(), np.int64), np.array(last["train"][0].as_py(), bool)
            c = np.concatenate([np.zeros(1, np.int64), unplanes(last["counts"][0].as_py()).astype(np.int64)])[stream]
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            base = np.log10((c + 1.0) / (model.n + model.v + 1.0))
            own = model.score(classes[stream], c, begins) if model.n else base
            total = lambda x: np.add.reduceat(x, begins)
            s = total(own)
            yield pa.RecordBatch.from_arrays(
                [last["ids"][0].values, pa.array(~train), pa.array(lengths), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(len(lengths), model.n)), pa.array(total(base)), pa.array(s), pa.array(10 ** np.minimum(300, -s / lengths))],
                [ident, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return _with_replies(blocks, replies, parts, "ids", "lengths", "train", "stream", "counts").mapInArrow(run, f"`{ident}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
