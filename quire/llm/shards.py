"""Histogram sort into shards: exact counts below candidate boundaries, refined until the splitters hold, then one exchange.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch

#: Bits of the key that one round of probes resolves.
BITS = 16
TOP = 1 << 63


def sort_key(text: Column, ident: Column) -> Column:
    """64 bits, as a long: the upper half from the text, so equal texts are neighbours; the lower half from the id, so a text that a third of all rows share can be split between shards."""
    upper = F.shiftleft(F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32), 32)
    return upper.bitwiseOR(F.shiftrightunsigned(F.xxhash64(ident.cast("string"), F.lit(7)), 32))


def _unsigned(key: Column) -> Column:
    """The key with its sign bit turned, so that its digits follow its order."""
    return key.bitwiseXOR(F.lit(-TOP))


def _signed(k: int) -> int:
    return k - TOP


def splitters(df: DataFrame, key: str, weight: str, shards: int, tolerance: float = 0.0005) -> tuple[list[int], list[int], int, int]:
    """Boundaries between shards of near equal weight.

    df: long columns key and weight (no nulls). Each round counts, exactly and
    over all rows, weight and rows below the probes: the boundaries of the 2^16
    equal parts of each range that still holds an unsettled splitter. Partial
    sums are combined before the exchange, and the driver gets at most
    (shards - 1) * 2^16 counts, whatever the input's size. A splitter is settled
    when its weight is within tolerance times a shard's share, or when the range
    is a single key, at most after 64 / 16 = 4 rounds.

    Returns the splitters (as signed keys: a row belongs after all splitters at
    or below its key), exact rows below each, and total weight and rows.
    """
    part = df.select(_unsigned(F.col(key)).alias("k"), F.col(weight).alias("w"))
    total = rows = 0
    open_: dict[int, tuple[int, int, int]] = {}  # splitter: prefix of its range, weight and rows below it
    settled: dict[int, tuple[int, int]] = {}
    for depth in range(1, 64 // BITS + 1):
        shift = 64 - BITS * depth
        digit = F.shiftrightunsigned(F.col("k"), shift) if shift else F.col("k")
        here = part
        if depth > 1:
            here = part.where(F.shiftrightunsigned(F.col("k"), shift + BITS).isin(sorted({p for p, _, _ in open_.values()})))
        counts = sorted((int(r["d"]) % (1 << 64), int(r["w"]), int(r["n"])) for r in here.groupBy(digit.alias("d")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect())
        if depth == 1:
            total, rows = sum(w for _, w, _ in counts), sum(n for _, _, n in counts)
            open_ = {i: (0, 0, 0) for i in range(1, shards)}
        share = max(1.0, total / shards)
        for i, (prefix, w, n) in list(open_.items()):
            goal = total * i / shards
            mine = [c for c in counts if depth == 1 or c[0] >> BITS == prefix]
            best = (prefix << (shift + BITS), w, n)
            inside = None
            for d, dw, dn in mine:
                if w + dw > goal and inside is None:
                    inside = (d, w, n)
                w, n = w + dw, n + dn
                best = min(best, ((d + 1) << shift, w, n), key=lambda b: abs(b[1] - goal))
            if abs(best[1] - goal) <= tolerance * share or shift == 0 or inside is None:
                settled[i] = (best[0], best[2])
                del open_[i]
            else:
                open_[i] = inside
        if not open_:
            break
    at = [settled[i] for i in sorted(settled)]
    for i in range(1, len(at)):  # a range of one key may settle neighbours in either order
        at[i] = max(at[i], at[i - 1])
    return [_signed(min(k, (1 << 64) - 1)) if k < 1 << 64 else None for k, _ in at], [n for _, n in at], total, rows


def shard_of(key: Column, cuts: list[int | None]) -> Column:
    """Number of splitters at or below the key."""
    out = F.lit(0)
    for c in cuts:
        if c is not None:
            out = out + (key >= F.lit(c)).cast("int")
    return out


def histogram_sort(df: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id", shards: int = 24, overhead: int = 8) -> DataFrame:
    """All rows of df dealt into shards of near equal bytes, sorted by a key that keeps equal texts together.

    The law is ``bytes``: size is the text's UTF-8 bytes plus overhead. Adds
    size, text_crc32, law, shard, slot (the row's place in its shard, gapless
    from 0) and grown_shard (null: only for laws by key). A column of df with
    one of these names is replaced. Null text counts as empty, null ids and
    repeated rows are ordinary rows, ties on all of key, size and text_crc32
    take any order among themselves, and an empty table gives an empty result.

    The key column and the sizes are written once to the shared folder, as the
    rounds of probes read them again; other columns are read once and exchanged
    once. Places come from exact counts of prefixes of
    the key (longer ones where many rows share a prefix), so no task has to
    number a whole shard or a whole group of equal texts.
    """
    names = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    rest = [c for c in df.columns if c not in names]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    made = df.select(*rest, (F.length(body) + F.lit(overhead)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), sort_key(F.col(text), F.col(ident)).alias("_key"))
    keys = scratch.keep(made.select("_key", "size"), "keys")
    cuts, below, _, rows = splitters(keys, "_key", "size", shards)

    # Cells: prefixes of 12 bits of the key; where one holds over 1 / 512 of all rows, of 22 bits; where that still does, of 44.
    u = _unsigned(F.col("_key"))
    c12, c22, c44 = (F.shiftrightunsigned(u, 64 - b) for b in (12, 22, 44))
    many = max(1, rows // 512)
    heavy12 = [r["c"] for r in keys.groupBy(c12.alias("c")).count().where(F.col("count") > many).select("c").collect()]
    heavy22 = [r["c"] for r in keys.where(c12.isin(heavy12)).groupBy(c22.alias("c")).count().where(F.col("count") > many).select("c").collect()]
    none = F.lit(0).cast("long")
    cell = F.struct(c12.alias("c"), F.when(c12.isin(heavy12), c22).otherwise(none).alias("f"), F.when(c22.isin(heavy22), c44).otherwise(none).alias("l"))
    return _placed(made.withColumn("_cell", cell), keys.withColumn("_cell", cell), cuts, below, rest)


def _placed(made: DataFrame, keys: DataFrame, cuts: list, below: list[int], rest: list[str]) -> DataFrame:
    from pyspark.sql import Window as W

    counts = keys.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
    # Rows before each cell: within its range of the key, then over the at most 2^12 ranges.
    ranges = counts.groupBy(F.col("_cell.c").alias("c")).agg(F.sum("n").alias("n"))
    ranges = ranges.select("c", (F.sum("n").over(W.orderBy("c")) - F.col("n")).alias("before"))
    inner = W.partitionBy("_cell.c").orderBy("_cell.f", "_cell.l")
    counts = counts.select("_cell", (F.sum("n").over(inner) - F.col("n")).alias("within"))
    starts = counts.join(F.broadcast(ranges), F.col("_cell.c") == F.col("c")).select("_cell", (F.col("before") + F.col("within")).alias("_before"))
    shard = shard_of(F.col("_key"), cuts)
    first = F.element_at(F.array(*[F.lit(int(n)) for n in [0, *below]]), F.col("shard") + 1)
    rank = F.row_number().over(W.partitionBy("_cell").orderBy("_key", "size", "text_crc32"))
    out = made.withColumn("_rank", rank - 1).join(starts, "_cell").withColumn("shard", shard)
    return out.select(
        *rest, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
