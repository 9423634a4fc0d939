"""Benchmark decontamination by winnowing.

Words are cut and hashed in numpy inside Arrow maps.  Both sides keep, of every span of `window` words, the least hash of
the k-grams in it, k being half the span; of equal ones the last.  A run of spans with the same least gram keeps it once, so
a text has about one fingerprint for three words, yet every shared span of `window` words has one in common at the same
place.  Documents' fingerprints are joined with the benchmark's, and each hit is extended to both sides over equal words:
where it reaches the length of a span, the words it covers are hit.

Plan: the benchmark's words are counted first.  Up to `MOST_WORDS` (about 35 MB of fingerprints and word hashes) they are
broadcast, and documents are read once, with no shuffle.  A larger benchmark's fingerprints are a table that those of the
documents are joined with, each with the hashes of the words around it, and documents that are hit meet their hits in a
second join; documents are then read twice, whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lists, map_batches, read, table
from .words import ALNUM, Block, U, between, mix, prefix, text_blocks

WINDOW, MOST_WORDS, PAIRS = 10, 2_000_000, 1 << 20
GRAM_BASE = 0xC2B2AE3D27D4EB4F
FOUND = "doc_id long, text_key long, n_words long, hits array<struct<start:int,end:int>>, item_ids array<string>"


def _gram(length: int) -> int:
    """Words in a fingerprint's k-gram for spans of so many words."""
    return (length + 1) // 2


def winnowed(hashes: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least, and last of equal ones, in some span of `length` words; room tells
    how many words of its row start at each word."""
    k = _gram(length)
    starts = np.flatnonzero(room >= length)
    if not len(starts):
        return starts, np.zeros(0, U)
    grams = np.full(len(hashes), np.iinfo(U).max, U)
    at = np.flatnonzero(room >= k)
    grams[at] = mix(between(prefix(hashes, GRAM_BASE), at, at + k, GRAM_BASE))
    least, where = grams[starts], starts.copy()
    for shift in range(1, length - k + 1):
        other = grams[starts + shift]
        less = other <= least
        least[less], where[less] = other[less], starts[less] + shift
    places = np.unique(where)
    return places, grams[places]


def _lengths(counts: np.ndarray, window: int) -> list[int]:
    """The lengths of an item's span: `window`, and those of items of fewer words."""
    return np.unique(np.minimum(counts[counts > 0], window)).tolist()


ITEM = "item_id string, n_words int, words binary, fps binary, places binary"


def benchmark_items(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n_words, words, fps, places) of every item: its words' hashes, and its fingerprints with their places, as
    arrays of 64-bit numbers.  Null ids and null texts, and texts without words, give none; item ids are text."""

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column(0)
        for at, block in text_blocks(batch.column(1), ALNUM, lower=True):
            hashes, room = block.hashes(), block.room()
            held = [[], [], [], [], []]
            for k in np.flatnonzero(block.counts).tolist():
                a, b = block.first[k], block.first[k + 1]
                places, fps = winnowed(hashes[a:b], room[a:b], min(window, int(b - a)))
                for column, value in zip(held, (ids[at + k].as_py(), int(b - a), hashes[a:b].tobytes(), fps.tobytes(), places.astype(np.int64).tobytes())):
                    column.append(value)
            yield {"item_id": pa.array(held[0], pa.string()), "n_words": pa.array(held[1], pa.int32()), **{n: pa.array(v, pa.binary()) for n, v in zip(("words", "fps", "places"), held[2:])}}

    items = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null")
    return map_batches(items, each, ITEM)


class Index:
    """The benchmark in arrays: all items' word hashes, and by span length the sorted fingerprints with their places."""

    def __init__(self, items: pa.Table, window: int):
        sizes = items["n_words"].to_numpy().astype(np.int64)
        self.names, self.item = np.unique(np.array(items["item_id"].to_pylist(), dtype=object), return_inverse=True)
        self.words = np.frombuffer(b"".join(items["words"].to_pylist()), U)
        first = np.cumsum(sizes) - sizes
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.low, self.high = first, first + sizes
        self.by_length = {}
        for length in _lengths(sizes, window):
            own = np.flatnonzero(np.minimum(sizes, window) == length).tolist()
            fps = np.concatenate([np.frombuffer(items["fps"][k].as_py(), U) for k in own])
            places = np.concatenate([np.frombuffer(items["places"][k].as_py(), np.int64) + first[k] for k in own])
            order = np.argsort(fps, kind="stable")
            self.by_length[length] = (fps[order], places[order])


class _Cover:
    """What is hit of a block of rows: words covered, and pairs of row and item."""

    def __init__(self, block: Block):
        self.block, self.rows = block, block.rows()
        self.cover, self.pairs = np.zeros(len(block.starts) + 1, np.int32), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(self, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> None:
        np.add.at(self.cover, begin, 1)
        np.add.at(self.cover, end, -1)
        self.pairs.append((self.rows[begin], item))

    def result(self, names: np.ndarray) -> dict:
        block, n_rows, n_words = self.block, len(self.block.counts), len(self.block.starts)
        covered = np.cumsum(self.cover[:-1]) > 0
        lead = np.zeros(n_words + 1, bool)
        lead[block.first[:-1][block.counts > 0]] = True
        lead[n_words] = True
        begins = np.flatnonzero(covered & (lead[:-1] | ~np.concatenate([[False], covered[:-1]])[:n_words]))
        stops = np.flatnonzero(covered & (lead[1:] | ~np.concatenate([covered[1:], [False]])[:n_words])) + 1
        row = self.rows[begins]
        pair = np.unique(np.concatenate([r * max(1, len(names)) + i for r, i in self.pairs]))
        hits = pa.StructArray.from_arrays([pa.array((begins - block.first[row]).astype(np.int32)), pa.array((stops - block.first[row]).astype(np.int32))], ["start", "end"])
        of = pair // max(1, len(names))
        return {"n_words": block.counts.astype(np.int64), "hits": lists(hits, np.bincount(row, minlength=n_rows), hits.type), "item_ids": lists(names[pair % max(1, len(names))], np.bincount(of, minlength=n_rows), pa.string())}


def _extended(mine: np.ndarray, p: np.ndarray, p_low: np.ndarray, p_high: np.ndarray, theirs: np.ndarray, q: np.ndarray, q_low: np.ndarray, q_high: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and after the gram of k words at p and q are equal too, at most `most` on each side; a gram
    whose own words differ has -most of both."""
    same = np.ones(len(p), bool)
    for i in range(k):
        same &= mine[p + i] == theirs[q + i]
    before, after = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    on = same.copy()
    for i in range(1, most + 1):
        on &= (p - i >= p_low) & (q - i >= q_low)
        on[on] = mine[p[on] - i] == theirs[q[on] - i]
        before += on
    on = same.copy()
    for i in range(k, k + most):
        on &= (p + i < p_high) & (q + i < q_high)
        on[on] = mine[p[on] + i] == theirs[q[on] + i]
        after += on
    before[~same] = after[~same] = -most - k
    return before, after


def _find(block: Block, index: Index) -> dict:
    found = _Cover(block)
    hashes, room, low = (block.hashes(), block.room(), block.first[found.rows]) if len(block.starts) else (None,) * 3
    for length, (fps, places) in index.by_length.items() if len(block.starts) else ():
        k = _gram(length)
        at, own = winnowed(hashes, room, length)
        left, right = np.searchsorted(fps, own, "left"), np.searchsorted(fps, own, "right")
        at, left, many = at[right > left], left[right > left], (right - left)[right > left]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + PAIRS, PAIRS)) if len(many) else np.zeros(1, np.int64)
        for a, b in zip(np.unique(cuts)[:-1], np.unique(cuts)[1:]):  # a frequent gram of many items is taken in parts
            m = many[a:b]
            p = np.repeat(at[a:b], m)
            q = places[np.repeat(left[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            item = index.of[q]
            before, after = _extended(hashes, p, low[p], low[p] + block.counts[found.rows[p]], index.words, q, index.low[item], index.high[item], k, length - k)
            good = before + k + after >= length
            found.add(p[good] - before[good], p[good] + k + after[good], index.item[item[good]])
    return found.result(index.names)


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, text_key, n_words, hits (spans of word numbers, end exclusive, merged) and item_ids of every document.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; repeated rows each get a row; equal
    windows in several items name them all; columns other than doc_id, item_id and text are not read.
    """
    spark = documents.sparkSession
    items = table(benchmark_items(benchmark, window))
    docs = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    n_words, lengths = items.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.collect_set(F.least("n_words", F.lit(window)))).first()
    if n_words > most_words:
        return _joined(docs, items, sorted(lengths), window)
    held = spark.sparkContext.broadcast(Index(items.toArrow(), window))  # bounded by most_words

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, block in text_blocks(batch.column(1), ALNUM, lower=True):
            n = len(block.counts)
            yield {"doc_id": batch.column(0).slice(at, n), "text_key": batch.column(2).slice(at, n)} | _find(block, held.value)

    return map_batches(docs, each, FOUND)


def _joined(docs: DataFrame, items: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """find_contamination by a join of both sides' fingerprints."""

    def of_item(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in batch.to_pylist():
            words, n = np.frombuffer(row["words"], U), row["n_words"]
            length = min(window, n)
            k, most = _gram(length), length - _gram(length)
            places = np.frombuffer(row["places"], np.int64)
            starts = np.maximum(places - most, 0)
            around = [words[a : min(n, p + k + most)].tobytes() for a, p in zip(starts.tolist(), places.tolist())]
            yield {"length": np.full(len(places), length, np.int32), "fp": np.frombuffer(row["fps"], np.int64), "item_id": pa.array([row["item_id"]] * len(places), pa.string()), "around": pa.array(around, pa.binary()), "at": (places - starts).astype(np.int32)}

    def of_document(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, block in text_blocks(batch.column(1), ALNUM, lower=True):
            if len(block.starts):
                hashes, room, rows = block.hashes(), block.room(), block.rows()
                for length in lengths:
                    places, fps = winnowed(hashes, room, length)
                    row = rows[places]
                    yield {"doc_id": batch.column(0).take(pa.array(at + row)), "text_key": batch.column(2).take(pa.array(at + row)), "length": np.full(len(places), length, np.int32), "place": (places - block.first[row]).astype(np.int32), "fp": fps.view(np.int64)}

    theirs = map_batches(items, of_item, "length int, fp long, item_id string, around binary, at int")
    ours = map_batches(docs, of_document, "doc_id long, text_key long, length int, place int, fp long").dropDuplicates()
    hit = F.struct("length", "place", "around", "at", "item_id")
    hits = ours.join(theirs, ["length", "fp"]).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(hit).alias("found"))
    met = docs.join(hits, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["text_key"] == F.col("_key")), "left").select("doc_id", "text", "text_key", "found")

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, block in text_blocks(batch.column(1), ALNUM, lower=True):
            n, cover = len(block.counts), _Cover(block)
            own = [(k, x) for k in range(n) for x in batch.column(3)[at + k].as_py() or ()]
            names = np.unique(np.array([x["item_id"] for _, x in own], dtype=object)) if own else np.zeros(0, object)
            number, hashes = {name: i for i, name in enumerate(names)}, block.hashes() if own else None
            for k, x in own:
                length, words = x["length"], np.frombuffer(x["around"], U)
                gram, low = _gram(length), int(block.first[k])
                one = lambda v: np.array([v], np.int64)
                before, after = _extended(hashes, one(low + x["place"]), one(low), one(block.first[k + 1]), words, one(x["at"]), one(0), one(len(words)), gram, length - gram)
                if before[0] + gram + after[0] >= length:
                    cover.add(one(low + x["place"] - before[0]), one(low + x["place"] + gram + after[0]), one(number[x["item_id"]]))
            yield {"doc_id": batch.column(0).slice(at, n), "text_key": batch.column(2).slice(at, n)} | cover.result(names)

    return map_batches(met, each, FOUND)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, in which no benchmark span occurs.  Rows with null ids or texts are kept."""
    hit = find_contamination(documents, benchmark, window).where(F.size("hits") > 0).select(F.col("doc_id").alias("__hit_id"), F.col("text_key").alias("__hit_key")).dropDuplicates()
    on = documents["doc_id"].cast("long").eqNullSafe(F.col("__hit_id")) & (F.xxhash64(documents["text"]) == F.col("__hit_key"))
    return documents.join(hit, on, "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
spans as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as span
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as s from i where len(w) > 0)),
lengths as (select distinct n from spans),
places as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d, lengths where len(w) >= n),
hit as (select p.doc_id, p.s, p.n, spans.item_id from places p join spans on spans.n = p.n and spans.span = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item_id::varchar, ',' order by item_id::varchar)) as items_sha256 from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
