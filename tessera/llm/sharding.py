"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by a 128-bit key: the hash of the text, then of the id.  Equal texts stand together, whatever their
source, in one shard unless they are wider than `GROUP` of one.  Splitters that cut the bytes into equal parts are found by
counting: each round counts bytes (and the range of keys) in 1,024 equal slices of every interval that still holds a
splitter too loosely, exactly and over all rows, and keeps the slice in which the target falls.  A round returns at most
1,024 sums for each unsettled splitter, however many rows or partitions there are.  When all are settled the rows are
exchanged once, by pieces of shards that are slices of the key, so no task holds a whole shard; a row's slot is its rank in
its piece and the number of rows in the shard's pieces before it.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parallelism, read, table

N_SHARDS, TOLERANCE, GROUP, FIXED_BYTES, SLICE_BITS = 40, 0.002, 0.25, 16, 10
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def keyed(documents: DataFrame) -> DataFrame:
    """documents with __shard_size, __shard_text and __shard_id: the row's weight in bytes and the two halves of its key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.withColumns({"__shard_size": (F.octet_length(text) + FIXED_BYTES).cast("long"), "__shard_text": F.xxhash64(text), "__shard_id": F.xxhash64(F.col("doc_id").cast("string"))})


def find_splitters(keys: DataFrame, n_parts: int, tolerance: float = TOLERANCE, group: float = GROUP) -> list[tuple[int, int]]:
    """n_parts - 1 ascending keys; part j holds the rows from splitter j - 1 up to, but without, splitter j.

    Each splitter has its share of the bytes below it to within tolerance of a part, or, where a single row, a text of at
    most `group` of a part or rows alike in text and id are wider than that, the nearest border of theirs.
    """
    total = keys.agg(F.sum("__shard_size")).first()[0] or 0
    if not total:
        return [(HIGH, HIGH)] * (n_parts - 1)
    slack = tolerance * total / n_parts
    settled: dict[int, tuple[int, int]] = {}
    # An open interval: level 0 slices text hashes, level 1 the id hashes of one text; keys low to high, bytes below it.
    open_: dict[tuple, list[tuple[int, float]]] = {(0, 0, LOW, HIGH, 0): [(j, total * j / n_parts) for j in range(1, n_parts)]}
    while open_:
        rows = _count(keys, list(open_))
        after: dict[tuple, list[tuple[int, float]]] = {}
        for k, (interval, targets) in enumerate(open_.items()):
            level, text, low, high, base = interval
            slices = sorted(rows.get(k, []))
            sums = [base, *accumulate((r[1] for r in slices), initial=base)][1:]
            for j, target in targets:
                at = min(bisect_right(sums, target) - 1, len(slices) - 1)
                below, (_, size, least, most) = sums[at], slices[at]
                key = (lambda x, level=level, text=text: (x, LOW) if level == 0 else (text, x))
                past = key(most + 1) if most < HIGH else ((text + 1, LOW) if level else (HIGH, HIGH))
                if target - below <= slack:
                    settled[j] = key(least)
                elif below + size - target <= slack:
                    settled[j] = past
                elif least < most:
                    after.setdefault((level, text, least, most, below), []).append((j, target))
                elif level == 0 and size > group * total / n_parts:
                    after.setdefault((1, least, LOW, HIGH, below), []).append((j, target))
                else:
                    settled[j] = key(least) if target - below <= below + size - target else past
        open_ = after
    return [settled[j] for j in sorted(settled)]


def _reached(starts: list[tuple[int, int]]) -> Column:
    """How many of these ascending keys a row's key has reached: a search that halves them at each step."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        text, id_ = starts[mid]
        past = (F.col("__shard_text") > text) | ((F.col("__shard_text") == text) & (F.col("__shard_id") >= id_))
        return F.when(past, search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(starts))


def _count(keys: DataFrame, intervals: list[tuple]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each interval, (slice, bytes, least key, largest key) of its slices that hold rows."""
    start = lambda x: (x[1], x[2]) if x[0] else (x[2], LOW)
    order = sorted(range(len(intervals)), key=lambda k: start(intervals[k]))
    ordered = [intervals[k] for k in order]
    pick = lambda values: F.try_element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.greatest(F.col("_k"), F.lit(1)))
    widths = [max(1, -(-(high - low + 1) >> SLICE_BITS)) for _, _, low, high, _ in ordered]
    rows = keys.withColumn("_k", _reached([start(x) for x in ordered])).where("_k > 0")
    rows = rows.select("_k", "__shard_size", "__shard_text", F.when(pick([x[0] for x in ordered]) == 1, F.col("__shard_id")).otherwise(F.col("__shard_text")).alias("_key"), *(pick(v).alias(c) for c, v in (("level", [x[0] for x in ordered]), ("text", [x[1] for x in ordered]), ("low", [x[2] for x in ordered]), ("high", [x[3] for x in ordered]), ("width", widths))))
    # key - low may pass 2**63, so wide intervals are halved first; rounding in the quotient keeps the order of keys.
    place = F.when(F.col("width") > 2, F.floor((F.shiftright("_key", 1) - F.shiftright("low", 1)) / F.floor(F.col("width") / 2))).otherwise(F.col("_key") - F.col("low"))
    inside = ((F.col("level") == 0) | (F.col("__shard_text") == F.col("text"))) & F.col("_key").between(F.col("low"), F.col("high"))
    counted = rows.where(inside).groupBy("_k", place.cast("long").alias("slice")).agg(F.sum("__shard_size").alias("size"), F.min("_key").alias("least"), F.max("_key").alias("most"))
    out: dict[int, list] = {}
    for r in counted.collect():
        out.setdefault(order[r["_k"] - 1], []).append((r["slice"], r["size"], r["least"], r["most"]))
    return out


def shard(documents: DataFrame, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE, group: float = GROUP) -> DataFrame:
    """documents, all columns, with size, text_crc32, shard (0 to n_shards - 1), slot (gapless from 0 in a shard) and
    group_split, whether the row's text stands in several shards.

    Sizes, UTF-8 bytes of the text plus 16, are near equal over shards.  A null text counts as empty, a null id as a key
    of its own; rows alike in text and id stand in one shard, in either order; an empty table gives an empty one.
    Columns called size, text_crc32, shard, slot or group_split are replaced.
    """
    keys = table(keyed(documents).select("__shard_size", "__shard_text", "__shard_id"))
    splitters = find_splitters(keys, n_shards, tolerance, group)
    split = sorted({text for text, id_ in splitters if id_ != LOW and text != HIGH})  # texts that a splitter divides
    # Pieces of a shard, in the order of keys: slices of the text's hash, and within a divided text of the id's.
    shift = 64 - max(1, (2 * max(parallelism(documents.sparkSession), n_shards) - 1).bit_length())
    divided = F.col("__shard_text").isin(split) if split else F.lit(False)
    piece = {
        "__shard_number": _reached(splitters), "__shard_slice": F.shiftright("__shard_text", shift),
        "__shard_among": sum(((F.col("__shard_text") > t).cast("int") for t in split), divided.cast("int") + sum(((F.col("__shard_text") > t).cast("int") for t in split), F.lit(0))),
        "__shard_within": F.when(divided, F.shiftright(F.coalesce("__shard_id", F.lit(LOW)), shift)).otherwise(F.lit(0)),
    }
    before = Window.partitionBy("__shard_number").orderBy(*list(piece)[1:]).rowsBetween(Window.unboundedPreceding, -1)
    rows = keys.withColumns(piece).groupBy(*piece).agg(F.count(F.lit(1)).alias("__shard_rows"))
    # A row for each piece: a few times as many as there are partitions, so it may be broadcast.
    bases = table(rows.withColumn("__shard_base", F.coalesce(F.sum("__shard_rows").over(before), F.lit(0))).drop("__shard_rows"))
    place = F.row_number().over(Window.partitionBy(*piece).orderBy("__shard_text", "__shard_id"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))  # before the exchange, which then needs no text of its own
    found = keyed(documents).withColumn("__shard_crc", crc).withColumns(piece).withColumn("__shard_place", place).join(F.broadcast(bases), list(piece))
    return found.withColumns({
        "size": F.col("__shard_size"), "text_crc32": F.col("__shard_crc"), "shard": F.col("__shard_number"),
        "slot": F.col("__shard_base") + F.col("__shard_place") - 1, "group_split": divided,
    }).select(*(c for c in documents.columns if c not in ADDED), *ADDED)


ADDED = ("size", "text_crc32", "shard", "slot", "group_split")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_split")
