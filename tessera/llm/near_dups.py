"""SimHash near-duplicates: fingerprints in numpy, BK-trees in shards of fingerprints, components by star contraction.

Two 64-bit fingerprints within `radius` bits agree on all but `radius` of the `blocks` slices they are cut into.  So every
fingerprint goes, once for each choice of the other slices, to the shard of fingerprints equal in those slices; in each
shard a BK-tree (children keyed by their Hamming distance to the parent) is searched for neighbours along the edges
within the radius.  The trees are dealt out by a shuffle, not broadcast: together they grow with the corpus.

Documents with equal fingerprints are one node from the start, and a shard gives no pairs but a spanning forest of its
links (each node found leaves the tree and is searched from once), so thousands of copies cost thousands of rows.

`similar` deals shards by other keys and searches the same trees; the pipeline's stage is that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept, map_batches, parallelism, read, scratch, table
from .words import LOWER, text_rows

SHINGLE, RADIUS, BLOCKS, SEED = 4, 4, 6, 42
WEIGHTS = (np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The SimHash of a lower-cased text: bit set where over half of its shingles' hashes have it."""
    words = text.split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    starts = [0, *(e + 1 for e in ends)]
    hashes = [digest(view[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(WEIGHTS[counts * 2 > len(hashes)].sum())


def fingerprints(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_key) of every document; fp is the unsigned fingerprint's bits as a long."""

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = text_rows(batch.column(1))
        lowered = LOWER[data].tobytes() if len(data) < 1 << 28 else None
        found = np.zeros(batch.num_rows, np.uint64)
        for i in range(batch.num_rows):
            a, b = int(offsets[i]), int(offsets[i + 1])
            found[i] = fingerprint(lowered[a:b] if lowered is not None else LOWER[data[a:b]].tobytes(), width)
        yield {"doc_id": batch.column(0), "fp": found.view(np.int64), "text_key": batch.column(2)}

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")), each, "doc_id long, fp long, text_key long")


class BKTree:
    """Fingerprints by distance to a parent; removed ones stay as signposts until their branch is empty."""

    def __init__(self, values: list[int]):
        self.values, self.parent, self.live, self.gone = values, [-1] * len(values), [1] * len(values), [False] * len(values)
        self.edges: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at = 0
            while True:
                self.live[at] += 1
                d = (values[i] ^ values[at]).bit_count()
                to = self.edges[at].setdefault(d, i)
                if to == i:
                    self.parent[i] = at
                    break
                at = to

    def remove(self, i: int) -> None:
        self.gone[i] = True
        while i >= 0:
            self.live[i] -= 1
            i = self.parent[i]

    def near(self, value: int, radius: int) -> list[int]:
        """The nodes still there within radius bits of value."""
        found, todo = [], [0] if self.live[0] else []
        while todo:
            i = todo.pop()
            d = (value ^ self.values[i]).bit_count()
            if d <= radius and not self.gone[i]:
                found.append(i)
            todo += [c for e, c in self.edges[i].items() if d - radius <= e <= d + radius and self.live[c]]
        return found


def forest(values: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links (index, index it was found from) that span each component of the values."""
    if len(values) == 2:
        if (values[0] ^ values[1]).bit_count() <= radius:
            yield 1, 0
        return
    tree = BKTree(values)
    for first in range(len(values)):
        if tree.gone[first]:
            continue
        tree.remove(first)
        todo = [first]
        while todo and tree.live[0]:
            at = todo.pop()
            for i in tree.near(values[at], radius):
                tree.remove(i)
                todo.append(i)
                yield i, at


def _slices(n: int) -> list[int]:
    """Masks of n slices of the 64 bits, as even as can be."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sliced(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(node, fp, mask, bits): fingerprints fp, each its own node, dealt to a shard for every choice of slices.

    Every shard's key is the choice of slices and their bits, so two fingerprints meet in a shard exactly when they
    agree there."""
    masks = [_signed(sum(_slices(blocks)[k] for k in kept)) for kept in combinations(range(blocks), blocks - radius)]
    choices = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)]))
    return distinct.select("fp", choices.alias("s")).select(F.col("fp").alias("node"), "fp", "s.mask", "s.bits")


def searched(shards: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(mask, bits, node, near) for every node of a shard (mask, bits) of several: a node within radius bits from which a
    search of the shard's tree found it, or itself where a search began.  Over all shards of the nodes these links join
    all that are reachable."""
    n = parallelism(shards.sparkSession)
    dealt = shards.select("mask", "bits", "fp", "node").repartition(n, "mask", "bits").sortWithinPartitions("mask", "bits", "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []  # the parts of the shard that may go on in the next batch
        for batch in batches:
            parts = tuple(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            if not len(parts[0]):
                continue
            cut = np.flatnonzero((parts[0][1:] != parts[0][:-1]) | (parts[1][1:] != parts[1][:-1])) + 1
            cuts = [0, *cut.tolist(), len(parts[0])]
            whole = []
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(p[a:b] for p in parts)
                if open_ and (open_[0][0][0], open_[0][1][0]) != (own[0][0], own[1][0]):
                    whole.append(tuple(map(np.concatenate, zip(*open_))))
                    open_ = []
                open_.append(own)
            yield from _forests(whole, radius)
        if open_:
            yield from _forests([tuple(map(np.concatenate, zip(*open_)))], radius)

    return dealt.mapInArrow(run, "mask int, bits long, node long, near long")


def _forests(shards: list[tuple], radius: int) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    for mask, bits, fp, node in shards:
        if len(fp) > 1:
            near = np.arange(len(fp))
            for i, at in forest(fp.view(np.uint64).tolist(), radius):
                near[i] = at
            found.append((mask, bits, node, node[near]))
    if found:
        mask, bits, node, near = map(np.concatenate, zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(mask, pa.int32()), pa.array(bits), pa.array(node), pa.array(near)], ["mask", "bits", "node", "near"])


def linked(found: DataFrame) -> DataFrame:
    """(u, v), u > v, once each, of the links that searches found."""
    return found.where("node <> near").select(F.greatest("node", "near").alias("u"), F.least("node", "near").alias("v")).dropDuplicates()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from every node that has a link, by alternating large and small stars.

    Each round is two aggregates that combine before they shuffle, and two joins of the links with what they give, a row
    for each node.  Those rows are written first, so that Spark knows their size: few are broadcast by its own threshold,
    and of many the links of a hub, dealt by an exchange of their own, are split by AQE's skew join.  Rounds end when the
    links no longer change."""
    with scratch(edges.sparkSession):
        edges, state = table(edges.select("u", "v")), None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").dropDuplicates()
            lower = table(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).select("col.*").where("u > v").dropDuplicates()
            edges = table(small)
            now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
            if now == state or not now[0]:
                return kept(edges.select(F.col("u").alias("node"), F.col("v").alias("root")))
            state = now


def classes(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """prints (doc_id, fp, ...) with component_id: the smallest doc_id reachable over links.  Null ids count only where
    a class has no other."""
    with scratch(prints.sparkSession):
        firsts = table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
        roots = components(linked(searched(sliced(firsts.select("fp"), radius, blocks), radius)))
        placed = table(firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
        ids = table(placed.groupBy("root").agg(F.min("first_id").alias("component_id")))
        found = kept(placed.join(ids, "root").select("fp", "component_id"))
    return prints.join(found, "fp")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp, component_id for every row of documents.

    Null and empty texts have fingerprint zero and are linked like any other; texts of fewer words than a shingle are one
    shingle; repeated rows each get a row; an empty table gives an empty one; other columns are not read.
    """
    return classes(table(fingerprints(documents, width)), radius, blocks)


def one_of_each(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row of documents, all columns, for each root in found (doc_id, text_key, root; a row for each of documents):
    the smallest doc_id, nulls last; of different texts under that id the one with the smallest hash; of rows alike in
    id and text any one.  Documents of different roots never stand behind each other, whatever their ids."""
    alike = table(found.groupBy("doc_id", "text_key").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    ranked = alike.join(table(alike.groupBy("root").agg(F.min(order).alias("best"))), "root")
    ranked = ranked.withColumn("first", F.col("text_key").eqNullSafe(F.col("best.text_key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    told = kept(ranked.where("not first or n > 1").select(F.col("doc_id").alias("__one_id"), F.col("text_key").alias("__one_key"), "first"))
    on = documents["doc_id"].cast("long").eqNullSafe(F.col("__one_id")) & (F.xxhash64(documents["text"]) == F.col("__one_key"))
    repeated = documents.join(told.where("first").drop("first"), on).dropDuplicates(["__one_id", "__one_key"]).select(*documents.columns)
    return documents.join(told, on, "left_anti").unionByName(repeated)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
