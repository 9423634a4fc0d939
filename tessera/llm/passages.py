"""Removal of repeated passages, found by difference-cover anchors.

Any two positions of two documents can be shifted by one same amount below `PERIOD` so that both fall on a place of the
cover.  So anchors, hashes of a run of words, are taken only where the word number modulo the period is in the cover
(5 of 21 places): every match of `window` words holds an anchor of window - 20 words at the same place in both copies.
Anchors that occur twice mark the windows that may be repeated; these are hashed whole (128 bits) and counted in turn.

Both counts run alike.  A task packs what it has found into compressed arrays, one for each bucket of hashes: a hash seen
twice by the task is settled there and sent once, as a mark, so a passage in a third of all documents sends a record for
each task, not for each document.  Buckets give back places, packed by buckets of documents, which meet the texts in a
cogroup.  No pairs are made, and no group holds more than its share of hashes or documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parallelism, read, table
from .words import SPACED, WORD_BASES, Block, U, between, mix, prefix, text_blocks

WINDOW, PERIOD, COVER = 35, 21, (0, 1, 4, 14, 16)
FLUSH = 1_000_000
#: Texts of one bucket on average, and of rows alike in id and text in it, at most.
BUCKET_BYTES, ALIKE_BYTES, ALIKE_ROWS = 1 << 27, 1 << 26, 1000
MARK = 0xFFFFFFFF
PACKED = "bucket int, flags boolean, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; the bytes of equal weight stand together, which compresses ids and places."""
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], np.int64)
    parts = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    sizes = raw[8 : 8 + 16 * n].view(np.int64)
    at, out = 8 + 16 * n, []
    for length, width in zip(sizes[:n].tolist(), sizes[n:].tolist()):
        out.append(np.ascontiguousarray(raw[at : at + length * width].reshape(width, length).T).reshape(-1).view(f"u{width}"))
        at += length * width
    return out


def _groups(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal hashes together, and the number of each place's group in it."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    return order, np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]) if len(a) else np.zeros(0, np.int64)


class _Found:
    """Hashes with their places, gathered from many documents: ids, keys and buckets of the documents, then records."""

    def __init__(self, n_buckets: int):
        self.n_buckets, self.docs, self.records, self.n = n_buckets, [], [], 0

    def add(self, ids, keys, buckets, doc, pos, h1, h2) -> None:
        base = sum(len(d[0]) for d in self.docs)
        self.docs.append((ids, keys, buckets))
        self.records.append((doc + base, pos, h1, h2))
        self.n += len(doc)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            ids, keys, buckets = (np.concatenate(x) for x in zip(*self.docs))
            doc, pos, h1, h2 = (np.concatenate(x) for x in zip(*self.records))
            order, group = _groups(h1, h2)
            many = np.bincount(group) > 1
            first = np.concatenate([[True], group[1:] != group[:-1]])
            repeated = np.empty(len(order), bool)
            repeated[order] = many[group]
            rows = list(_by_documents(ids, keys, buckets, doc[repeated], pos[repeated], flags=True))
            sent = np.sort(order[first])  # in order of documents, so that they compress
            marked = repeated[sent]
            to = ((h1[sent] >> U(32)) * U(self.n_buckets) >> U(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(self.n_buckets + 1))
            for b in range(self.n_buckets):
                part = order[cuts[b] : cuts[b + 1]]
                if len(part):
                    rows.append((b, False, _records(ids, keys, buckets, doc, pos, h1, h2, sent[part], marked[part])))
            yield _batch(rows)
        self.__init__(self.n_buckets)


def _records(ids, keys, buckets, doc, pos, h1, h2, own, marked) -> bytes:
    used, at = np.unique(doc[own][~marked], return_inverse=True)
    which = np.full(len(own), MARK, np.uint32)
    which[~marked] = at
    place = np.where(marked, 0, pos[own]).astype(np.uint32)
    return pack(ids[used], keys[used], buckets[used], which, place, h1[own], h2[own] if h2[own].any() else np.zeros(0, U))


def _by_documents(ids, keys, buckets, doc, pos, flags: bool) -> Iterator[tuple[int, bool, bytes]]:
    """Places, packed by buckets of documents."""
    order = np.lexsort((pos, doc, buckets[doc]))
    doc, pos = doc[order], pos[order]
    of = buckets[doc]
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        used, at = np.unique(doc[a:b], return_inverse=True)
        yield int(of[a]), flags, pack(ids[used], keys[used], at.astype(np.uint32), pos[a:b].astype(np.uint32))


def _batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    b, f, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(f, pa.bool_()), pa.array(blob, pa.binary())], ["bucket", "flags", "blob"])


def _joined(bucket: int, parts: list[list[np.ndarray]]) -> list[tuple[int, bool, bytes]]:
    """Places that tasks have settled for one bucket of documents, as one row."""
    if not parts:
        return []
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    which = np.concatenate([p[2] + np.uint32(b) for p, b in zip(parts, base)])
    return [(bucket, True, pack(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)), which, np.concatenate([p[3] for p in parts])))]


def _meet(group: pa.Table) -> pa.Table:
    """The places, by buckets of documents, of hashes that came twice to this bucket or with a mark."""
    flags, blobs = group["flags"].to_pylist(), group["blob"].to_pylist()
    rows = _joined(group["bucket"][0].as_py(), [unpack(blob) for f, blob in zip(flags, blobs) if f])
    parts = [unpack(blob) for f, blob in zip(flags, blobs) if not f]
    if parts:
        ids, keys, buckets = (np.concatenate([p[k] for p in parts]) for k in range(3))
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        which = np.concatenate([np.where(p[3] == MARK, -1, p[3].astype(np.int64) + b) for p, b in zip(parts, base)])
        pos, h1 = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        h2 = np.concatenate([p[6] if len(p[6]) else np.zeros(len(p[5]), U) for p in parts])
        order, of = _groups(h1, h2)
        many = (np.bincount(of) > 1) if len(of) else np.zeros(0, bool)
        hit = order[many[of]]
        hit = hit[which[hit] >= 0]
        rows += _by_documents(ids, keys, buckets, which[hit], pos[hit], True)
    return pa.Table.from_batches([_batch(rows)])


def _flagged(flags: pa.Table) -> dict[tuple[int, int], list[np.ndarray]]:
    """The flagged places of a bucket's documents, by id and text hash."""
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for blob in flags["blob"].to_pylist():
        own_ids, own_keys, which, pos = unpack(blob)
        cuts = np.searchsorted(which, np.arange(len(own_ids) + 1))
        for k, pair in enumerate(zip(own_ids.view(np.int64).tolist(), own_keys.view(np.int64).tolist())):
            found.setdefault(pair, []).append(pos[cuts[k] : cuts[k + 1]])
    return found


def _places(found: dict[tuple[int, int], list[np.ndarray]], ids: pa.Array, keys: pa.Array) -> list[np.ndarray | None]:
    """For each document its flagged places; documents alike in id and text share them."""
    none = np.iinfo(np.int64).min  # packs a null id
    return [np.concatenate(x) if (x := found.get((none if i is None else i, k))) else None for i, k in zip(ids.to_pylist(), keys.to_pylist())]


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
    return ids.astype(np.int64).view(U), batch.column(1).to_numpy().astype(np.int64).view(U), batch.column(2).to_numpy().astype(np.uint32)


def anchors(docs: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """The anchors at cover places of every document."""
    width = window - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(n_buckets)
        for batch in batches:
            ids, keys, buckets = _arrays(batch)
            for at, block in text_blocks(batch.column(3), SPACED):
                rows, n = block.rows(), len(block.counts)
                pos = np.arange(len(rows)) - block.first[rows]
                starts = np.flatnonzero((block.room() >= width) & (block.counts[rows] >= window) & cover[pos % PERIOD])
                if len(starts):
                    h = mix(between(prefix(block.hashes(), WORD_BASES[0]), starts, starts + width, WORD_BASES[0]))
                    own = slice(at, at + n)
                    found.add(ids[own], keys[own], buckets[own], rows[starts], pos[starts], h, np.zeros(len(h), U))
            if found.n >= FLUSH:
                yield from found.flush()
        yield from found.flush()

    return docs.mapInArrow(run, PACKED)


def repeated_windows(docs: DataFrame, flagged: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Extends flagged anchors: the hash of every window that holds one where it may lie in a match."""

    def each(_key, texts: pa.Table, flags: pa.Table) -> pa.Table:
        flagged_places, found, out = _flagged(flags), _Found(n_buckets), []
        for batch in texts.to_batches():
            out += one(batch, flagged_places, found)
        out += found.flush()
        return pa.Table.from_batches(out or [_batch([])])

    def one(batch: pa.RecordBatch, flagged_places: dict, found: _Found) -> Iterator[pa.RecordBatch]:
        ids, keys, buckets = _arrays(batch)
        places = _places(flagged_places, batch.column(0), batch.column(1))
        for at, block in text_blocks(batch.column(3), SPACED):
            mark = np.zeros(len(block.starts) + PERIOD + 1, np.int64)
            for k, first in enumerate(block.first[:-1].tolist()):
                if places[at + k] is not None:
                    mark[first + places[at + k].astype(np.int64) + 1] = 1
            if not mark.any():
                continue
            seen = np.cumsum(mark)
            n = len(block.starts)
            starts = np.flatnonzero((block.room() >= window) & (seen[PERIOD : PERIOD + n] > seen[:n]))
            if len(starts):
                h, rows = block.hashes(), block.rows()
                h1 = mix(between(prefix(h, WORD_BASES[0]), starts, starts + window, WORD_BASES[0]))
                h2 = mix(between(prefix(mix(h + U(1)), WORD_BASES[1]), starts, starts + window, WORD_BASES[1]))
                own = slice(at, at + len(block.counts))
                found.add(ids[own], keys[own], buckets[own], rows[starts], starts - block.first[rows[starts]], h1, h2)
            if found.n >= FLUSH:
                yield from found.flush()

    return docs.groupBy("bucket").cogroup(flagged.groupBy("bucket")).applyInArrow(each, PACKED)


def _kept(block: Block, k: int, places: np.ndarray | None, window: int) -> tuple[np.ndarray, int]:
    """Which words of a row stay, and how many go."""
    n = int(block.counts[k])
    cover = np.zeros(n + 1, np.int64)
    if places is not None:
        places = np.unique(places.astype(np.int64))
        cover[places] += 1
        cover[places + window] -= 1
    gone = np.cumsum(cover[:n]) > 0
    return ~gone, int(gone.sum())


def remove_passages(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) and removed (spans of word numbers) of every row.

    A word goes if a window over it occurs elsewhere, in another row or at another place of its own; all windows are
    judged on the input.  Null and empty texts have no words; texts shorter than a window lose none; repeated rows repeat
    each other's windows; an empty table gives an empty one.  window is at least PERIOD.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words or more")
    docs = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    sizes = table(docs.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.sum(n_bytes).alias("bytes")))
    many = (F.col("n") > 2) & ((F.col("n") > ALIKE_ROWS) | (F.col("bytes") > ALIKE_BYTES))
    hot, total = sizes.agg(F.count_if(many), F.sum(F.when(many, F.col("bytes") / F.col("n") * 2).otherwise(F.col("bytes")))).first()
    n_buckets = max(parallelism(documents.sparkSession), -int(-(total or 0) // BUCKET_BYTES))
    docs = docs.withColumn("copies", F.lit(1).cast("long"))
    if hot:
        # Many rows alike in id and text stand in one bucket: two of them, which repeat each other as all do, stand for all.
        alike = sizes.where(many).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n")
        on = docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["text_key"] == F.col("__key"))
        two = docs.join(alike, on).dropDuplicates(["__id", "__key"]).withColumn("copies", F.explode(F.array(F.col("n"), F.lit(0).cast("long"))))
        docs = docs.join(alike, on, "left_anti").unionByName(two.select(*docs.columns))
    docs = docs.select("doc_id", "text_key", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(n_buckets)).cast("int").alias("bucket"), "text", "copies")
    flagged = anchors(docs, window, n_buckets).groupBy("bucket").applyInArrow(_meet, PACKED)
    repeated = repeated_windows(docs, flagged, window, n_buckets).groupBy("bucket").applyInArrow(_meet, PACKED)

    def each(_key, texts: pa.Table, flags: pa.Table) -> pa.Table:
        found = _flagged(flags)
        return pa.concat_tables([one(batch, found) for batch in texts.to_batches()] or [schema.empty_table()])

    def one(batch: pa.RecordBatch, found: dict) -> pa.Table:
        places = _places(found, batch.column(0), batch.column(1))
        n_words, n_removed, kept, spans = [], [], [], []
        for at, block in text_blocks(batch.column(3), SPACED):
            raw = block.data.tobytes()
            for k in range(len(block.counts)):
                stay, gone = _kept(block, k, places[at + k], window)
                a, b = block.first[k], block.first[k + 1]
                pairs = zip(block.starts[a:b][stay].tolist(), block.ends[a:b][stay].tolist())
                kept.append(b" ".join([raw[s:e] for s, e in pairs]) if gone else b" ".join(raw[block.offsets[k] : block.offsets[k + 1]].split()))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], ~stay, [False]])))
                spans.append([{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())])
                n_words.append(int(b - a))
                n_removed.append(gone)
        return pa.table({"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(spans, schema.field("removed").type), "copies": batch.column(4)}, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("copies", pa.int64())])
    out = docs.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(each, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>, copies long")
    return (out.withColumn("_", F.explode(F.expr("case when copies > 0 then sequence(1L, copies) end"))) if hot else out).drop("copies", "_")


def op10_passages(spark, sf_dir: str) -> DataFrame:
    found = remove_passages(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, row_number() over () as r from documents),
places as (select r, w, unnest(generate_series(1, len(w) - 34)) as s from d where len(w) >= 35),
windows as (select r, s, md5(array_to_string(w[s:s + 34], ' ')) as h from places),
again as (select h from windows group by h having count(*) > 1),
gone as (select distinct r, unnest(generate_series(s, s + 34)) as p from windows where h in (select h from again)),
words as (select d.r, p, w[p] as word from (select r, w, unnest(generate_series(1, len(w))) as p from d) d),
kept as (select words.r, string_agg(word, ' ' order by p) as kept, count(*) as n from words left join gone using (r, p) where gone.r is null group by words.r)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.kept, '')) as kept_sha256
from d left join kept using (r)
"""
