"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .base import Scratch, joined, lean, partitions_of, release, trim

#: Bytes of text in a block, the unit whose shingles one task holds at a time.
BLOCK_BYTES = 2 << 20
#: Shingles of all blocks that one task counts at a time.
BUCKET = 1 << 20
#: Bytes of a batch that a task gives back.
OUT_BYTES = 2 << 20
#: Bits of a set's sketch, which the suffix filter compares.
SKETCH = 512
#: Ranges of the suffix filter.
RANGES = 32


def planes(a: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes first, so that the exchange's compression finds the zeros; high bytes that are 0 throughout are left out."""
    raw = np.ascontiguousarray(a, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    n = 8
    while n > 1 and not raw[n - 1].any():
        n -= 1
    return bytes([n]) + np.ascontiguousarray(raw[:n]).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    n = data[0]
    body = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :n] = body.T
    return out.view("<u8").reshape(-1)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one key after the other; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and k[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
                trim()
            now = int(k[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
        trim()


def sorting(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the numbers v and v in that order; where number and place fit 64 bits together they are sorted as one."""
    bits = len(v).bit_length()
    if len(v) and int(v.max()).bit_length() + bits <= 64:
        p = np.sort((v << np.uint64(bits)) | np.arange(len(v), dtype=np.uint64))
        return (p & np.uint64((1 << bits) - 1)).astype(np.int64), p >> np.uint64(bits)
    order = np.argsort(v, kind="stable")
    return order, v[order]


#: Bits of a shingle's hash; the others number the texts of a run while it is sorted.
HASH_BITS = 50


def sets_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the number before each text."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    low_bits = np.uint64(64 - HASH_BITS)
    for first, last, off, data in tokens.pieces(texts):
        starts, ends, before, low = tokens.words(off, data)
        h, after = tokens.shingles(tokens.hashes(starts, ends, low), before, n)
        h >>= low_bits
        for a in range(0, last - first, 1 << (64 - HASH_BITS)):
            b = min(a + (1 << (64 - HASH_BITS)), last - first)
            owner = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(after[a : b + 1]))
            key = np.sort((owner << np.uint64(HASH_BITS)) | h[after[a] : after[b]])
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            key = key[new]
            parts.append(key << low_bits)
            sizes.append(np.bincount((key >> np.uint64(HASH_BITS)).astype(np.int64), minlength=b - a))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


class Frequencies:
    """How many distinct texts of all have each shingle, for every block of texts, with no row a shingle.

    Blocks send sorted shingle hashes, cut to ``bits``, to buckets by their
    range; buckets add up and answer with one byte a shingle, in the order in
    which it was asked. The exchange takes about three bytes for each distinct
    shingle of a block.
    """

    def __init__(self, total_bytes: int, n: int):
        self.n = n
        self.bits = min(64, max(24, int(total_bytes).bit_length() + 9))
        self.buckets = max(1, total_bytes // 6 // BUCKET)
        self.bounds = np.array([-(-(j << self.bits) // self.buckets) for j in range(self.buckets)], dtype=np.uint64)

    def cut(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def ask(self, block: int, texts: pa.Array) -> Iterator[tuple[int, int, bytes, bytes]]:
        h, _ = sets_of(texts, self.n)
        u, c = np.unique(self.cut(h), return_counts=True)
        at = [*np.searchsorted(u, self.bounds), len(u)]
        for j, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a < b:
                part = u[a:b] - self.bounds[j]
                yield j, block, planes(np.diff(part, prepend=np.uint64(0))), planes(c[a:b])

    @staticmethod
    def answer(rows: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        asked = [np.cumsum(unplanes(d.as_py()), dtype=np.uint64) for d in rows["deltas"]]
        counts = np.concatenate([unplanes(d.as_py()) for d in rows["counts"]])
        order, v = sorting(np.concatenate(asked))
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        group = np.cumsum(new) - 1
        df = np.empty(len(v))
        df[order] = np.bincount(group, weights=counts[order].astype(float))[group]
        level = np.where(df > 1, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(df, 1)))), 0).astype(np.uint8)
        at = 0
        for block, bucket, a in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), asked, strict=True):
            yield block, bucket, level[at : at + len(a)].tobytes()
            at += len(a)


def sketches(h: np.ndarray, before: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of the sets chosen, whether each of SKETCH parts of the hash has an odd number of their shingles, as 64-bit words.

    One shingle that only one of two sets has turns one bit, so the bits in
    which two sketches differ are never more than what the sets don't share.
    """
    out = np.zeros((len(which), SKETCH // 8), np.uint8)
    for first in range(0, len(which), 2048):
        some = which[first : first + 2048]
        n = before[some + 1] - before[some]
        owner = np.repeat(np.arange(len(some)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(before[some], n)
        odd = np.bincount(owner * SKETCH + (h[at] % np.uint64(SKETCH)).astype(np.int64), minlength=len(some) * SKETCH) & 1
        out[first : first + len(some)] = np.packbits(odd.astype(bool).reshape(len(some), SKETCH), axis=1)
    return out.view("<i8").reshape(-1)


def _prefixes(keys: pa.Array, texts: pa.Array, levels: np.ndarray, freq: Frequencies, percent: int) -> Iterator[pa.RecordBatch]:
    """A row for each text: its key, set size, set id and, where others share shingles of its prefix, these, the set's sketch and the set.

    The prefix of a set of n, in the order of rising frequency and hash, has
    n - ceil(percent n / 100) + 1 shingles: two sets that link share one of both.
    """
    h, before = sets_of(texts, freq.n)
    n = np.diff(before)
    owner = np.repeat(np.arange(len(n)), n)
    order, v = sorting(freq.cut(h))
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    level = np.zeros(len(h), np.uint8)
    level[order] = levels[np.cumsum(new) - 1]
    length = n - -(-percent * n // 100) + 1
    alone = np.bincount(owner[level == 0], minlength=len(n))  # shingles that no other text has stand first
    some = np.flatnonzero((level > 0) & (alone < length)[owner])
    order = some[np.lexsort((h[some], level[some], owner[some]))]
    who = owner[order]
    place = alone[who] + np.arange(len(order)) - np.searchsorted(who, who)
    take = place < length[who]
    picked, who, place = order[take], who[take], place[take]
    per = np.bincount(who, minlength=len(n))
    offs = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(tokens.mix(h ^ np.uint64(x)), dtype=np.uint64)]) for x in (0, 0xA5A5A5A5A5A5A5A5)]
    ids = np.stack([c[before[1:]] - c[before[:-1]] for c in sums], axis=1).astype("<u8").tobytes()
    raw = memoryview(h.astype("<u8")).cast("B")
    some = np.flatnonzero(per)
    marks = pa.array(np.concatenate([[0], np.cumsum((per > 0) * (SKETCH // 64))]), pa.int32())
    whole = pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array(n, pa.int32()),
            pa.array([ids[16 * i : 16 * i + 16] for i in range(len(n))], pa.binary()),
            pa.ListArray.from_arrays(offs, pa.array(h[picked].view(np.int64))),
            pa.ListArray.from_arrays(offs, pa.array(place.astype(np.int32))),
            pa.ListArray.from_arrays(marks, pa.array(sketches(h, before, some))),
            pa.array([raw[8 * before[i] : 8 * before[i + 1]] if per[i] else None for i in range(len(n))], pa.binary()),
        ],
        ["_key", "n", "set_id", "hashes", "places", "sketch", "shingles"],
    )
    size = np.cumsum(64 + (per > 0) * (8 * n + 12 * per + SKETCH // 8))
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + OUT_BYTES, "right")))
        yield whole.slice(first, last - first)
        first = last


TEXTS = "_key binary, n int, set_id binary, hashes array<long>, places array<int>, sketch array<long>, shingles binary"


def prefixes(docs: DataFrame, scratch: Scratch, text: str, n: int, percent: int, total: int) -> DataFrame:
    """Rows of TEXTS for all distinct texts (a text may come a few times). docs has _key, a digest of the text."""
    blocks = max(1, -(-total // BLOCK_BYTES))
    parts = max(blocks, min(partitions_of(docs), 4 * blocks))
    freq = Frequencies(total, n)

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen: set[bytes] = set()  # keys of one partition: copies leave before the exchange
        for batch in batches:
            keep = []
            for i, k in enumerate(batch.column("_key").to_pylist()):
                if k not in seen:
                    seen.add(k)
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep))

    own = docs.select("_key", F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int").alias("block"))
    own = own.mapInArrow(first_of, "_key binary, text string, block int")

    def distinct(tab: pa.Table) -> tuple[pa.Array, pa.Array]:
        keys = tab["_key"].to_pylist()
        at = pa.array(sorted({k: i for i, k in reversed(list(enumerate(keys)))}.values()))
        tab = tab.take(at)
        return tab["_key"].combine_chunks(), tab["text"].cast(pa.large_string()).combine_chunks()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for block, tab in runs(batches, "block"):
            rows = list(freq.ask(block, distinct(tab)[1]))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "deltas", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for _, tab in runs(batches, "bucket"):
            cols = list(zip(*freq.answer(tab), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "bucket", "levels"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for _, tab in runs(batches, "block"):
            is_text = tab["bucket"].to_numpy() < 0
            replies = tab.filter(pa.array(~is_text))
            parts = sorted(zip(replies["bucket"].to_pylist(), replies["levels"].to_pylist(), strict=True))
            levels = np.frombuffer(b"".join(x for _, x in parts), np.uint8)
            keys, texts = distinct(tab.filter(pa.array(is_text)))
            yield from _prefixes(keys, texts, levels, freq, percent)

    asked = own.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(ask, "bucket int, block int, deltas binary, counts binary")
    answers = scratch.keep(asked.repartition(max(freq.buckets, 2), "bucket").sortWithinPartitions("bucket", "block").mapInArrow(answer, "block int, bucket int, levels binary"), "answers", size=total)
    release(docs.sparkSession)
    both = own.withColumn("bucket", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    out = both.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(finish, TEXTS)
    return out


def verify(pairs: DataFrame, sets: DataFrame, percent: int, split: int = 512) -> DataFrame:
    """pairs (a, b) with linked: whether 100 * intersection >= percent * union of their whole sets.

    The set of a stands once before its partners, which are dealt into parts of
    about ``split``, so an a with any number of partners is no single task's.
    Sets are compared range by range first: the sum of the differences of their
    counts in RANGES equal parts of the hash is a lower bound of what they don't
    share; what passes is intersected in whole.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(split)).cast("int").alias("_m"))
    sized = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_m")).cast("int").alias("_s"))
    right = sized.join(sets.select(F.col("id").alias("b"), "shingles"), "b").select("a", "_s", "b", "shingles")
    left = many.join(sets.select(F.col("id").alias("a"), "shingles"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_s"), F.lit(-1).cast("long").alias("b"), "shingles")
    edges = np.array([int(j * (1 << 64) // RANGES) for j in range(RANGES)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        x = hx = None
        for batch in batches:
            out = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles"), strict=True):
                y = np.frombuffer(s.as_buffer() or b"", "<u8")
                if b < 0:
                    x, hx = y, np.diff(np.searchsorted(y, edges), append=len(y))
                    continue
                need = -(-percent * (len(x) + len(y)) // (100 + percent))  # least intersection of a link
                apart = np.abs(hx - np.diff(np.searchsorted(y, edges), append=len(y))).sum()
                linked = False
                if (len(x) + len(y) - apart) // 2 >= need:
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    linked = int((x[at] == y).sum()) >= need
                out.append((a, b, linked))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "linked"])
        trim()

    both = left.unionByName(right)
    return both.repartition(F.col("a"), F.col("_s")).sortWithinPartitions("a", "_s", "b").mapInArrow(run, "a long, b long, linked boolean")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filter for two postings of one shingle, as columns of prefixes x and y.

    The shingle and what stands after it in both orders are all that can be
    shared if it is the first shared one; at later ones the test is stricter,
    so a pair that could link passes at its first shared shingle at least.
    """
    of = lambda side, c: F.col(side + c)
    na, nb, pa_, pb = of(x, "n"), of(y, "n"), of(x, "p"), of(y, "p")
    length = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    place = F.least(na - pa_, nb - pb) * (100 + percent) >= (na + nb) * percent
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.get(of(x, "sketch"), F.lit(i)).bitwiseXOR(F.get(of(y, "sketch"), F.lit(i)))) for i in range(SKETCH // 64)])
    return length & place & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def join(docs: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id", n: int = 5, percent: int = 80, most_rounds: int = 8) -> DataFrame:
    """Connected components of documents that link: 100 * intersection size >= percent * union size of their n-word shingle sets.

    Returns ident, n_shingles, component_id (smallest id reachable by links) and
    set_id (equal for equal sets; null for empty ones). Words are runs of other
    bytes than space and 0x09-0x0D, A-Z in lower case; a text of fewer words, but
    not none, is one shingle; null texts and texts without words are empty and
    linked with nothing. Repeated rows and ids are rows of their own; a null id
    is never a component's id unless no other is there; other columns are not
    read. Shingles are compared by HASH_BITS bits of a hash.

    Equal texts, then equal sets, are one node. Documents whose prefixes share
    a shingle and pass the filters are candidates. In a first phase each prefix
    shingle has a leader, the text in whose order it stands first, which is the
    one with fewest shingles of its own; only pairs with the leader are verified,
    and links merge nodes into components. Further rounds pit a leader of another
    component than the largest against all others, until what the last phase
    would weigh is in proportion to the postings. Last, every candidate pair that
    isn't yet in one component is verified, so no link between components is
    missed; pairs within one need no proof, so a group of copies costs its size,
    not the square.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias(text)).withColumn("_key", F.unhex(F.md5(F.col(text))))
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    texts = scratch.keep(prefixes(rows, scratch, text, n, percent, total), "texts", size=total)
    release(spark)
    keys = scratch.keep(texts.select("_key", "n", "set_id").distinct(), "keys", size=total)
    sets = texts.where("shingles is not null").groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "shingles", "hashes", "places", "sketch")])
    sets = scratch.keep(sets.withColumn("id", F.monotonically_increasing_id()), "sets", size=total)
    scratch.drop("texts", "answers")
    label = _components(sets, scratch, percent, most_rounds, total)
    best = rows.groupBy("_key").agg(F.min("_id").alias("low"))
    known = keys.join(sets.select("set_id", "id"), "set_id", "left").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    # Nodes without links stand for themselves: their set.
    known = known.select("_key", "n", "set_id", F.coalesce(F.hex("set_id"), F.lit("")).alias("_s"), F.col("component").cast("string").alias("_c"))
    known = known.withColumn("_c", F.coalesce("_c", "_s")).join(best, "_key")
    lowest = known.groupBy("_c").agg(F.min("low").alias("component_id"))
    per_key = scratch.keep(known.join(lowest, "_c").select("_key", F.col("n").cast("long").alias("n_shingles"), "component_id", "set_id"), "per_key", size=total)
    out = rows.select("_id", "_key").join(per_key, "_key")
    some = F.col("n_shingles") > 0
    return out.select(F.col("_id").alias(ident), "n_shingles", F.when(some, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"), F.when(some, F.col("set_id")).alias("set_id"))


#: Pairs that the last phase may weigh for each posting, before its filters, when a round of leaders could still lessen them.
WEIGHED = 16


def _components(sets: DataFrame, scratch: Scratch, percent: int, most_rounds: int, total: int) -> DataFrame:
    """(node, component) of all sets that link to another."""
    each = sets.select("id", "n", "sketch", F.explode(F.arrays_zip("hashes", "places")).alias("z"))
    post = scratch.keep(each.select(F.col("z.hashes").alias("h"), "id", "n", F.col("z.places").alias("p"), "sketch"), "postings", size=total)
    size = post.count()
    label = tried = None
    weighed = float("inf")
    for k in range(most_rounds + 1):
        now, groups = _groups(post, label, percent, scratch, k, size)
        sums = groups.agg(F.sum("m").alias("m"), F.sum(F.col("m") * (F.col("m") - F.col("most"))).alias("pairs")).first()
        scratch.drop("postings", *[f"now-{j}" for j in range(k)])
        if not sums["m"]:
            break
        last = k > 0 and (k == most_rounds or sums["pairs"] <= WEIGHED * size or sums["pairs"] > weighed / 2)
        weighed = sums["pairs"]
        pairs = (_across if last else _led)(now, groups, percent).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        checked = scratch.keep(verify(scratch.keep(pairs, f"pairs-{k}", size), sets, percent), f"checked-{k}", size)
        release(scratch.spark)
        tried = checked.select("a", "b") if tried is None else tried.unionByName(checked.select("a", "b"))
        found = checked.where("linked").select("a", "b")
        if label is None or not found.isEmpty():
            label = _merged(label, found, scratch, k)
        if last:
            break
        post = now.drop("c")  # a shingle whose postings are of one component needs no more
    scratch.drop(*[f"{x}-{j}" for j in range(k + 1) for x in ("pairs", "checked", "now", "groups")])
    return label if label is not None else sets.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)


def _groups(post: DataFrame, label: DataFrame | None, percent: int, scratch: Scratch, k: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Postings with c, the component so far, of the shingles that join several components, and for each of these: m postings, those of its largest (most), that (major) and the leader.

    A posting is left out where even the smallest set that shares its shingle is
    too large to link with what stands from the shingle on. The leader is of
    least place, in the first round of all, then of those out of the largest
    component.
    """
    if label is None:
        now = post.withColumn("c", F.col("id"))
    else:
        now = post.join(label.select(F.col("node").alias("id"), "component"), "id", "left").select(*post.columns, F.coalesce("component", "id").alias("c"))
        now = scratch.keep(now, f"labelled-{k}", size)
    spread = now.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).where("lo < hi").select("h", "least")
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    alive = (F.col("n") - F.col("p")) * (100 + percent) >= (F.col("n") + smallest) * percent
    now = scratch.keep(now.join(spread, "h").where(alive).drop("least"), f"now-{k}", size)
    scratch.drop(f"labelled-{k}")
    lead = F.min(F.struct("p", F.xxhash64("id", F.lit(k)).alias("r"), "id", "n", "sketch", "c")).alias("lead")
    per = now.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), lead)
    top = per.groupBy("h").agg(F.sum("n").alias("m"), F.max(F.struct("n", "c")).alias("x"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mine = per.join(top.select("h", F.col("x.c").alias("major"), F.col("x.n").alias("most"), "m"), "h")
    if label is not None:
        mine = mine.where("c <> major")
    return now, scratch.keep(mine.groupBy("h").agg(F.first("m").alias("m"), F.first("most").alias("most"), F.first("major").alias("major"), F.min("lead").alias("lead")), f"groups-{k}", size)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _led(now: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of each shingle's leader with postings of other components."""
    lead = groups.select("h", *[F.col(f"lead.{c}").alias(f"y_{c}") for c in ("id", "n", "p", "sketch", "c")])
    x = now.select("h", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "p", "sketch", "c")])
    return x.join(lead, "h").where((F.col("x_c") != F.col("y_c")) & _may_link("x_", "y_", percent)).select(*_ordered("x_id", "y_id"))


def _across(now: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of one shingle in different components: of each shingle's largest component with all others, and of the others among themselves."""
    held = now.join(groups.select("h", "major"), "h")
    names = ("id", "n", "p", "sketch", "c")
    x = held.where("c <> major").select("h", *[F.col(c).alias(f"x_{c}") for c in names])
    y = held.select("h", "major", *[F.col(c).alias(f"y_{c}") for c in names])
    once = (F.col("x_c") != F.col("y_c")) & ((F.col("y_c") == F.col("major")) | (F.col("x_id") < F.col("y_id")))
    return x.join(y, "h").where(once & _may_link("x_", "y_", percent)).select(*_ordered("x_id", "y_id"))


def _merged(label: DataFrame | None, found: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Components after more links; only the components that the links join are worked on."""
    if label is None:
        return joined(found, Scratch(scratch.spark, "components"))
    of = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = joined(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), Scratch(scratch.spark, "components"))
    old = label.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = moved.join(label.select("node"), "node", "left_anti")
    return scratch.keep(old.unionByName(fresh), f"label-{k}")
