"""Best-fit packing by length patterns: non-negative least squares fits how often each pattern repeats, residuals go by best fit."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch

_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of so much white space are left to the file's own library; the other's pattern can't take a million.
_SPACE = re.compile(r"\s{50000}")
_encoders: dict = {}


def encoder(path: str):
    """Function from a list of texts to lists of ids, as of the tokenizer file at path with add_special_tokens=False.

    A byte-level BPE file whose merges stand in order of their ids is run by
    the faster of two libraries that give equal ids; texts with one of its
    added tokens' strings or with very long white space, and other files, go
    through the file's own library.
    """
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_padding()
        own.no_truncation()
        spec = json.load(open(path, encoding="utf-8"))
        added = [t["content"] for t in spec.get("added_tokens") or []]
        fast = None
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["model"].get("ignore_merges") and not spec.get("normalizer"):
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
            vocab = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
            merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
            ids = [spec["model"]["vocab"][m] for m in merges]
            if ids == sorted(ids) and len(vocab) == 256 + len(merges):
                fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=vocab, special_tokens={})

        def encode(texts: list[str]) -> list[list[int]]:
            if fast is None:
                return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
            return [own.encode(t, add_special_tokens=False).ids if any(a in t for a in added) or _SPACE.search(t) else fast.encode_ordinary(t) for t in texts]

        _encoders[path] = encode
    return _encoders[path]


def cut(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document: keep, piece, start, length, ids_crc32.

    A document's ids are those of its whole text, then end_id. Only documents of
    more than most ids are cut; their first piece is the shorter one. A null or
    empty text is one piece that holds end_id alone; repeated rows are cut each;
    an empty table gives none. Columns other than keep and text are not read.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, value in enumerate(batch.column(text)):
                ids = np.array([*encode([value.as_py() or ""])[0], end_id], dtype="<u4")
                start, length = 0, (len(ids) - 1) % most + 1
                for piece in range(-(-len(ids) // most)):
                    rows.append((i, piece, start, length, zlib.crc32(ids[start : start + length])))
                    start, length = start + length, most
            of, *cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            kept = batch.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), pa.array(cols[0], pa.int32()), *map(pa.array, cols[1:])], [*keep, "piece", "start", "length", "ids_crc32"])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, f"{kinds}, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """Sets of one to three lengths that fill a sequence, or come as near as the lengths at hand allow.

    counts: documents of each length. For each length a: a alone if full, each
    b that fills the rest, and for the twelve commonest partners c, an exact
    third. Their number is bounded by the square of most, not by the documents.
    """
    have = [int(a) for a in np.flatnonzero(counts) if a]
    there = set(have)
    common = sorted(have, key=lambda a: (-counts[a], a))[:12]
    out = {(a,) for a in have if a == most}
    for a in have:
        b = most - a
        if b in there and b >= a:
            out.add((b, a))
        for c in common:
            d = most - a - c
            if d > 0 and d in there:
                out.add(tuple(sorted((a, c, d), reverse=True)))
    return sorted(out, reverse=True)


def nnls(counts: np.ndarray, pats: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' use of each length near the histogram: min |A x - h|^2.

    Multiplicative steps keep x positive and lower the error in every round.
    """
    if not pats:
        return np.zeros(0)
    row = np.concatenate([np.asarray(p) for p in pats])
    col = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    h = counts.astype(float)
    x = np.minimum.reduceat(h[row], np.concatenate([[0], np.cumsum([len(p) for p in pats])[:-1]])) / 2 + 1e-9
    up = np.bincount(col, h[row], len(pats))
    for _ in range(rounds):
        use = np.bincount(row, x[col], len(h))
        x *= up / np.maximum(np.bincount(col, use[row], len(pats)), 1e-12)
    return x


def plan(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """How often each set of lengths is packed as one sequence; uses every document of the histogram exactly once.

    Fitted repeats are rounded down, and held to what is left of each length.
    What remains is packed longest first into the fullest sequence with room,
    alike sequences together, so the work follows the number of lengths.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    pats = patterns(counts, most)
    x = np.floor(nnls(counts, pats) + 1e-6).astype(np.int64)
    for k in sorted(range(len(pats)), key=lambda k: (-x[k], pats[k])):
        need = defaultdict(int)
        for a in pats[k]:
            need[a] += 1
        if times := min(int(x[k]), *(int(left[a]) // n for a, n in need.items())):
            out.append((pats[k], times))
            for a, n in need.items():
                left[a] -= n * times
    room: dict[int, list[list]] = defaultdict(list)  # room left: sets of lengths with their count
    for a in range(most, 0, -1):
        n = int(left[a])
        while n and (fit := [r for r in room if r >= a and room[r]]):
            r = min(fit)  # the fullest
            pat, times = room[r].pop()
            used = min(n, times)
            if times > used:
                room[r].append([pat, times - used])
            room[r - a].append([(*pat, a), used])
            n -= used
        while n:  # new sequences, which several pieces of the length share
            each = min(n, most // a)
            times = n // each
            room[most - a * each].append([(a,) * each, times])
            n -= each * times
    return out + [(tuple(p), t) for sets in room.values() for p, t in sets]


def pack(pieces: DataFrame, scratch: Scratch, most: int = 2048, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to pieces (length from 1 to most each), so that few sequences hold all.

    Only the histogram of lengths, at most ``most`` counts, comes to the driver,
    and only the plan, bounded likewise, goes out. Pieces of one length are
    numbered by salted parts (partition of origin and salt), so a length that a
    third of all pieces have is not numbered by one task; pieces of full length,
    the commonest of long texts, are a sequence each and are not numbered with
    others at all. Ties between pieces of one length are free, repeated rows are
    placed each, an empty table gives none. Columns of the names added are replaced.
    """
    from pyspark.sql import Window as W

    rest = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rest]), F.lit(salts)).cast("int")
    rows = scratch.keep(pieces.select(*rest, part.alias("_salt")), "pieces")
    whole = rows.where(F.col("length") == most)
    rows = rows.where(F.col("length") < most)
    hist = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    parts = hist.collect()  # at most most * salts counts
    counts = np.zeros(most + 1, dtype=np.int64)
    before: dict[int, list[int]] = {}
    for r in sorted(parts, key=lambda r: (r["length"], r["_salt"])):
        before.setdefault(r["length"], [0] * salts)[r["_salt"]] = int(counts[r["length"]])
        counts[r["length"]] += r["n"]
    # For each length: from which number on its pieces go to which slot.
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used, sequence = np.zeros(most + 1, dtype=np.int64), 0
    for pat, times in plan(counts, most):
        at = 0
        for a in pat:
            slots[a].append((int(used[a]), sequence, at))
            used[a] += times
            at += a
        sequence += times
    assert (used == counts).all()
    sent = pieces.sparkSession.sparkContext.broadcast({a: (np.array(before[a]), *map(np.array, zip(*s, strict=True))) for a, s in slots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_rank"))
            ids, offs = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for a in np.unique(length):
                here = np.flatnonzero(length == a)
                base, first, seq, at = of[int(a)]
                n = base[salt[here]] + rank[here]
                k = np.searchsorted(first, n, "right") - 1
                ids[here], offs[here] = seq[k] + n - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(ids), pa.array(offs)], [*rest, "sequence_id", "offset"])

    rank = F.row_number().over(W.partitionBy("length", "_salt").orderBy(*rest)) - 1
    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in rest)
    placed = rows.withColumn("_rank", rank).mapInArrow(place, f"{kinds}, sequence_id long, offset long")
    return placed.unionByName(whole.select(*rest, (F.lit(sequence) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
