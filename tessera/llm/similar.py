"""SimHash near-duplicates of five words and a similarity of 0.8 or more: trees propose links, the sets decide them.

At a Jaccard similarity of 0.8 two 64-bit fingerprints are some ten bits apart, up to twenty, where slices of equal bits
no longer find them.  So the shards of the BK-trees are dealt here by keys of the sets themselves: `BANDS` keys, each of
`DEPTH` least hashes, so that two sets of similarity s share none with a chance of (1 - s**DEPTH)**BANDS: 0.0006 at 0.8,
less above.  In each shard the tree is searched within `RADIUS` bits, and each link it proposes is held against the sets.

Where a shard still holds several classes after that, all pairs of its classes that no earlier key has brought together
are held against each other, class by class but the largest: in blocks of at most about `BLOCK` sets, so that a hot group
is many tasks and none of them grows with it.  Only links are returned, never pairs.

Sets travel as 32 bits of each shingle's hash: of two texts of 20,000 words, a tenth of a shingle is taken for another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dups import WEIGHTS, components, linked, one_of_each, searched
from .shared import kept, lists, map_batches, scratch, table
from .words import SPACED, WORD_BASES, U, between, mix, prefix, text_blocks

WIDTH, LEAST, BANDS, DEPTH, SEED, RADIUS = 5, 0.8, 40, 8, 42, 24
_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(1 << 32, size=BANDS * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFTS = _draw.integers(1 << 32, size=BANDS * DEPTH, dtype=np.uint64).astype(np.uint32)
MIXERS = mix(np.arange(1, BANDS * DEPTH + 1, dtype=U)).reshape(BANDS, DEPTH) | U(1)
PART, SHORT = 4096, np.uint32
#: Sets, and bytes of them, that one task searches through on each side.
BLOCK, BLOCK_BYTES = 1024, 1 << 25


def shingles(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Each row's sorted set of hashes of `width` words in a row, lower-cased; of fewer words, all in one; of none, empty."""
    for _, block in text_blocks(column, SPACED, lower=True):
        sums = prefix(block.hashes(), WORD_BASES[0])
        for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist()):
            starts = np.arange(a, max(b - width, a) + 1 if b > a else a)
            yield np.unique(mix(between(sums, starts, np.minimum(starts + width, b), WORD_BASES[0])))


def bands(own: np.ndarray) -> np.ndarray:
    """The keys of a set."""
    least = np.full(BANDS * DEPTH, 0xFFFFFFFF, np.uint32)
    low = (own >> U(32)).astype(np.uint32)
    for k in range(0, len(low), PART):
        h = low[k : k + PART, None] * FACTORS
        h ^= h >> np.uint32(15)
        h += SHIFTS
        h *= FACTORS[::-1]
        np.minimum(least, h.min(axis=0), out=least)
    return mix((least.reshape(BANDS, DEPTH).astype(U) * MIXERS).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U))


def simhash(own: np.ndarray) -> int:
    """The SimHash of a set of hashes: bit set where over half of them have it."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 16):
        counts += np.unpackbits(own[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(WEIGHTS[counts * 2 > len(own)].sum())


def sets(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, node (of its set), fp (its SimHash), keys and hashes (the sorted set, 4 bytes each) of every row."""

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        found = list(shingles(batch.column(1)))
        node = np.array([mix(np.array([mix(s).sum(dtype=U) + U(len(s))], U))[0] for s in found], U)
        fp = np.array([simhash(s) for s in found], U)
        keys = np.concatenate([bands(s) for s in found]) if found else np.zeros(0, U)
        yield {"doc_id": batch.column(0), "text_key": batch.column(2), "node": node.view(np.int64), "fp": fp.view(np.int64), "keys": lists(keys.view(np.int64), np.full(len(found), BANDS), pa.int64()), "hashes": pa.array([np.unique((s >> U(32)).astype(SHORT)).tobytes() for s in found], pa.binary())}

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")), each, "doc_id long, text_key long, node long, fp long, keys array<long>, hashes binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """(u, v) of those pairs (u, v, a, b: their sets) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [similarity(np.frombuffer(x.as_buffer(), SHORT), np.frombuffer(y.as_buffer(), SHORT)) >= least for x, y in zip(a, b)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def crossed(found: list[np.ndarray], root: list[int], keys: np.ndarray, asks: np.ndarray, band: int, least: float = LEAST) -> Iterator[tuple[int, int]]:
    """Links (i, j) between sets of different roots, i among those that ask: enough of them to join all classes that a
    similar pair joins.  Pairs that agree in a key before the band's are left to that one's shard."""
    sizes = np.array([len(s) for s in found])
    first, flat = np.cumsum(sizes) - sizes, np.concatenate(found)
    of = np.unique(root, return_inverse=True)[1]
    for i in np.flatnonzero(asks).tolist():
        other = np.flatnonzero((of != of[i]) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i])) & ~(keys[:, :band] == keys[i, :band]).any(axis=1))
        for a in range(0, len(other), 256):
            own = other[a : a + 256]
            own = own[of[own] != of[i]]
            if not len(own):
                continue
            ends = np.cumsum(sizes[own])
            values = flat[np.repeat(first[own] - ends + sizes[own], sizes[own]) + np.arange(ends[-1])]
            at = np.minimum(np.searchsorted(found[i], values), sizes[i] - 1)
            both = np.diff(np.concatenate([[0], np.cumsum(found[i][at] == values)])[np.concatenate([[0], ends])])
            for j in own[both >= least * (sizes[own] + sizes[i] - both)].tolist():
                if of[j] != of[i]:
                    yield i, j
                    of[of == of[j]] = of[i]


def _search(told: DataFrame, shown: DataFrame, least: float) -> DataFrame:
    """(u, v) that join the classes within each shard of told (mask, bits, node, root); shown has node, keys, hashes."""
    by = ["mask", "bits"]
    sizes = table(told.join(shown.select("node", F.octet_length("hashes").alias("bytes")), "node").groupBy(*by, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("long").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 31))).alias("s")))
    shards = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("classes"), F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("most"), F.bit_xor("x").alias("x"), F.sum("s").alias("s")).where("classes > 1")
    # Of shards with the same nodes the first key's stands for all.
    shards = shards.groupBy("x", "s", "n").agg(F.min_by(F.struct(*by, "main", "bytes", "most"), F.struct(*by)).alias("k")).select("k.*", "n")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.ceil(n / F.col("n") * F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    shards = table(shards.select(*by, "main", blocks(F.col("n") - F.col("most")).alias("asking"), blocks(F.col("n")).alias("held")))
    rows = told.join(shards, by).withColumn("asks", F.col("root") != F.col("main"))
    place = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A set is held in one block for every block of those that ask, and asks in one for every block of those held.
    to_held = F.transform(every("asking"), lambda a: F.struct(a.alias("a"), place(7, "held").alias("b"), F.lit(False).alias("asks")))
    to_ask = F.when(F.col("asks"), F.transform(every("held"), lambda b: F.struct(place(8, "asking").alias("a"), b.alias("b"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<a:int,b:int,asks:boolean>>"))
    rows = rows.select(*by, "node", "root", F.explode(F.concat(to_held, to_ask)).alias("t")).select(*by, "t.a", "t.b", "node", "root", "t.asks")
    rows = rows.groupBy(*by, "a", "b", "node", "root").agg(F.max("asks").alias("asks")).join(shown, "node")

    def each(group: pa.Table) -> pa.Table:
        nodes, asks = group["node"].to_pylist(), group["asks"].to_numpy(zero_copy_only=False)
        links = []
        if asks.any() and len(nodes) > 1:
            keys = group["keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), -1)
            found = [np.frombuffer(x, SHORT) for x in group["hashes"].to_pylist()]
            links = [(max(nodes[i], nodes[j]), min(nodes[i], nodes[j])) for i, j in crossed(found, group["root"].to_pylist(), keys, asks, group["mask"][0].as_py(), least)]
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return rows.select(*by, "a", "b", "node", "root", "asks", "keys", "hashes").groupBy(*by, "a", "b").applyInArrow(each, "u long, v long")


def classes(documents: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, root for every row: rows have one root where a chain of similar documents joins them."""
    with scratch(documents.sparkSession):
        found = table(sets(documents))
        nodes = table(found.select("node", "fp", "keys").dropDuplicates(["node"]))
        shards = table(searched(nodes.select("node", "fp", F.posexplode("keys").alias("mask", "bits")), radius))
        # The sets of nodes that share a key, once each.
        members = table(shards.select("node").dropDuplicates())
        shown = table(found.select("node", "keys", "hashes").join(members, "node", "left_semi").dropDuplicates(["node"]))
        pairs = linked(shards)
        one, other = (shown.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("u", "a"), ("v", "b")))
        edges = table(_alike(pairs.join(one, "u").join(other, "v"), least))
        roots = components(edges)
        told = table(shards.join(roots, "node", "left").select("mask", "bits", "node", F.coalesce("root", "node").alias("root")))
        more = table(_search(told, shown, least))
        roots = components(edges.unionByName(more).dropDuplicates())
        return kept(found.select("doc_id", "text_key", "node").join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root")))


def keep_one(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents, all columns, without those that stand behind another of their class (see near_dups.one_of_each).

    Null and empty texts have the empty set and are one class; an empty table gives an empty one."""
    with scratch(documents.sparkSession):
        return one_of_each(documents, classes(documents, least))
