"""A bigram language model with interpolated modified Kneser-Ney smoothing, counted in Spark.

Counting: tasks count their own pairs of words and pack them, sorted and compressed, by buckets of hashes; each bucket
adds them up and keeps its pairs as a sorted array of 64-bit hashes with counts.  What a word is as a context (how many
tokens and kinds follow it, how many of them once, twice, ...) and as a follower (after how many words it stands, how
often) is added up in a second round, again as sorted arrays.  A context's followers are dealt to `SALTS` buckets, so a
very frequent word is no group of its own.  Only a row of sums for each bucket reaches the driver.

The arrays lie as plain files in the shared folder; scoring tasks map them into memory and look up the distinct words
and pairs of many documents at once, in sorted order.  A worker maps a file once, whatever the number of its tasks and
batches; from shared folders that are no mounted file system it takes a copy, unlinked once it is mapped.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import pack, unpack
from .shared import doc_bucket, parallelism, read, shared_dir
from .words import SPACED, U, mix, text_blocks

SALTS, FLUSH, ASK = 4, 1_500_000, 1_000_000
#: Text counted in one bucket, on average, at most.
BUCKET_BYTES = 1 << 26
BEGIN, END = mix(np.array([0xB, 0xE], U))
PACKED = "bucket int, blob binary"
WORD_FIELDS = ("total", "kinds", "n1", "n2", "n3", "n4", "before", "count")


def _at(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{os.path.abspath(path)}")


def save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays as one file, each as narrow as its largest value allows, 8-byte aligned.  A task that runs twice writes the
    same bytes; the file appears whole."""
    fs, top = _at(folder)
    fs.create_dir(top, recursive=True)
    narrow = [a if a.dtype == U and k == 0 else a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for k, a in enumerate(arrays)]
    head = np.array([len(arrays), len(arrays[0]), *(a.dtype.itemsize for a in narrow)], np.int64)
    part = f"{top}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(head.tobytes())
        for a in narrow:
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    try:
        fs.move(part, f"{top}/{name}")
    except OSError:
        if fs.get_file_info(f"{top}/{name}").type != pyarrow.fs.FileType.File:
            raise
        fs.delete_file(part)  # another try of this task was first


@lru_cache(maxsize=1 << 16)
def mapped(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory, once by each worker; models have folders of their own."""
    fs, top = _at(folder)
    path, own = f"{top}/{name}", None
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        with tempfile.NamedTemporaryFile(delete=False) as own, fs.open_input_stream(path) as source:
            while block := source.read(1 << 24):
                own.write(block)
        path = own.name
    raw = np.memmap(path, np.uint8, "r")
    if own:
        os.unlink(own.name)
    n = int(raw[:8].view(np.int64)[0])
    length, *widths = raw[8 : 16 + 8 * n].view(np.int64).tolist()
    out, at = [], 16 + 8 * n
    for w in widths:
        out.append(raw[at : at + length * w].view(f"u{w}"))
        at += length * w + -length * w % 8
    return out


def _deal(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _pair_bucket(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return _deal(mix(a + (b & U(SALTS - 1))), n)


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def _sums(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys, sorted, with the sums of their rows of values (fields by rows)."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, values
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return [k[new] for k in keys], np.add.reduceat(values[:, order], new, axis=1)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    bucket, blob = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "blob"])


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, then for its block of rows: each token's word, the one before it, and its row.  A row ends with END."""
    for at, block in text_blocks(column, SPACED, lower=True):
        n_rows = len(block.counts)
        words = np.insert(block.hashes(), block.first[1:], END)
        rows = np.insert(block.rows(), block.first[1:], np.arange(n_rows))
        before = np.concatenate([[BEGIN], words[:-1]]).astype(U)
        before[1:][rows[1:] != rows[:-1]] = BEGIN
        yield at, words, before, rows


class Model:
    """Where the arrays are, into how many buckets they are dealt, and the sums that hold for all of them."""

    def __init__(self, folder: str, n: int, sums: dict[str, int]):
        self.folder, self.n, self.sums = folder, n, sums
        self.tokens, self.vocabulary, self.pairs = sums["count"], sums["words"], sums["before"]
        self.pair_cut = self._discounts(*(sums[f"n{k}"] for k in range(1, 5)))
        self.word_cut = self._discounts(*(sums[f"b{k}"] for k in range(1, 5)))
        d = self.word_cut
        spare = d[0] * sums["b1"] + d[1] * sums["b2"] + d[2] * (sums["followers"] - sums["b1"] - sums["b2"])
        self.floor = spare / max(1, self.pairs) / (self.vocabulary + 1) if self.pairs else 1.0

    @staticmethod
    def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
        """Modified Kneser-Ney's three discounts; where counts of counts are missing, as in tiny tables, 0.5, 1 and 1.5."""
        if not (n1 and n2):
            return 0.5, 1.0, 1.5
        y = n1 / (n1 + 2 * n2)
        own = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        return tuple(d if 0 < d < k + 1 else 0.5 * (k + 1) for k, d in enumerate(own))

    @staticmethod
    def cut(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
        return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)], 0.0)

    def words(self, h: np.ndarray) -> dict[str, np.ndarray]:
        """The fields of sorted, distinct word hashes; zero for unknown words."""
        out = {f: np.zeros(len(h)) for f in WORD_FIELDS}
        cuts = np.searchsorted(_deal(h, self.n), np.arange(self.n + 1))
        for b in range(self.n):
            own = slice(cuts[b], cuts[b + 1])
            if own.start < own.stop:
                keys, *fields = mapped(self.folder, f"words-{b}")
                at, hit = _find(keys, h[own])
                for f, values in zip(WORD_FIELDS, fields):
                    out[f][own][hit] = values[at]
        return out

    def pair_counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How often each pair stands in the training texts."""
        bucket, key, out = _pair_bucket(a, b, self.n), _pair_key(a, b), np.zeros(len(a))
        order = np.lexsort((key, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(self.n + 1))
        for k in range(self.n):
            own = order[cuts[k] : cuts[k + 1]]
            if len(own):
                keys, counts = mapped(self.folder, f"pairs-{k}")
                at, hit = _find(keys, key[own])
                out[own[hit]] = counts[at]
        return out

    def logs(self, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probabilities of tokens by the model and by the add-one unigrams, and which words are known."""
        known, place = np.unique(np.concatenate([words, before]), return_inverse=True)
        w, a = place[: len(words)], place[len(words) :]
        f = self.words(known)
        follows = self.cut(f["before"], self.word_cut) / max(1, self.pairs) + self.floor
        total = np.maximum(f["total"], 1)
        d = self.pair_cut
        spare = np.where(f["total"] > 0, (d[0] * f["n1"] + d[1] * f["n2"] + d[2] * (f["kinds"] - f["n1"] - f["n2"])) / total, 1.0)
        pairs, of = np.unique(a.astype(np.int64) * len(known) + w, return_inverse=True)
        pa_, pb = pairs // len(known), pairs % len(known)
        c = self.pair_counts(known[pa_], known[pb])
        p = self.cut(c, d) / total[pa_] + spare[pa_] * follows[pb]
        base = np.log10((f["count"] + 1) / (self.tokens + 1 * (self.vocabulary + 1)))
        return np.log10(p)[of], base[w], f["count"][w] > 0


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in keys of those asked for that are there, and which those are.  Both are sorted."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == asked)
    return at[hit], hit


def _count_pairs(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            (a, b), counts = _sums([a, b], np.ones((1, len(a)), np.int64))
            bucket = _pair_bucket(a, b, n)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            parts = [(k, order[cuts[k] : cuts[k + 1]]) for k in range(n) if cuts[k] < cuts[k + 1]]
            return _batch([(k, _packed_pairs(a[own], b[own], counts[0][own])) for k, own in parts])

        size = 0
        for batch in batches:
            for _, words, before, _ in _tokens(batch.column(0)):
                held.append((before, words))
                size += len(words)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, PACKED)


def _packed_pairs(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> bytes:
    """Contexts once each with how many follow, then followers and counts."""
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return pack(a[new], np.diff(np.append(new, len(a))).astype(np.uint32), b, counts.astype(np.uint32))


def train(documents: DataFrame) -> Model:
    """The model of all texts of documents: null and empty ones are their END alone; repeated rows count each; an empty
    table gives a model in which every word is as likely as any; columns other than text are not read."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n, folder = max(parallelism(spark), -(-size // BUCKET_BYTES)), shared_dir(spark)

    def add_pairs(group: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in group["blob"].to_pylist()]
        a = np.concatenate([np.repeat(p[0], p[1].astype(np.int64)) for p in parts])
        (a, b), counts = _sums([a, np.concatenate([p[2] for p in parts])], np.concatenate([p[3] for p in parts]).astype(np.int64)[None])
        del parts
        counts = counts[0]
        key = _pair_key(a, b)
        order = np.argsort(key, kind="stable")
        save(folder, f"pairs-{group['bucket'][0].as_py()}", [key[order], counts[order]])
        one = np.ones(len(a), np.int64)
        (contexts,), as_context = _sums([a], np.stack([counts, one, *(counts == k for k in (1, 2, 3, 4))]).astype(np.int64))
        (followers,), as_follower = _sums([b], np.stack([one, counts]))
        zero = lambda rows, like: np.zeros((rows, len(like)), np.int64)
        (words,), fields = _sums([np.concatenate([contexts, followers])], np.concatenate([np.concatenate([as_context, zero(2, contexts)]), np.concatenate([zero(6, followers), as_follower])], axis=1))
        cuts = np.searchsorted(_deal(words, n), np.arange(n + 1))
        narrow = lambda x: x.astype(np.min_scalar_type(int(x.max())))
        return pa.Table.from_batches([_batch([(k, pack(words[s], *(narrow(f[s]) for f in fields))) for k in range(n) if (s := slice(cuts[k], cuts[k + 1])).start < s.stop])])

    def add_words(group: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in group["blob"].to_pylist()]
        fields = np.stack([np.concatenate([p[k + 1].astype(np.int64) for p in parts]) for k in range(len(WORD_FIELDS))])
        (words,), fields = _sums([np.concatenate([p[0] for p in parts])], fields)
        save(folder, f"words-{group['bucket'][0].as_py()}", [words, *(f.astype(U) for f in fields)])
        of = dict(zip(WORD_FIELDS, fields))
        sums = {f: int(of[f].sum()) for f in ("n1", "n2", "n3", "n4", "before", "count")} | {f"b{k}": int((of["before"] == k).sum()) for k in (1, 2, 3, 4)} | {"words": int((of["count"] > 0).sum()), "followers": int((of["before"] > 0).sum())}
        return pa.table({k: pa.array([v], pa.int64()) for k, v in sums.items()} | {"bucket": pa.array([group["bucket"][0].as_py()], pa.int32())})

    names = ["n1", "n2", "n3", "n4", "before", "count", "b1", "b2", "b3", "b4", "words", "followers"]
    pairs = _count_pairs(documents.select("text"), n).groupBy("bucket").applyInArrow(add_pairs, PACKED)
    rows = pairs.groupBy("bucket").applyInArrow(add_words, ", ".join(f"{k} long" for k in names) + ", bucket int").collect()  # a row for each bucket
    fs, top = _at(folder)
    fs.create_dir(top, recursive=True)
    there = {os.path.basename(x.path) for x in fs.get_file_info(pyarrow.fs.FileSelector(top))}
    for k in range(n):
        for name, fields in ((f"pairs-{k}", 1), (f"words-{k}", len(WORD_FIELDS))):
            if name not in there:
                save(folder, name, [np.zeros(0, U)] * (fields + 1))
    return Model(folder, n, {k: sum(r[k] for r in rows) for k in names})


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (sums of log10 over the words and the end) and perplexity of every
    row.  Null and empty texts are their END alone; repeated rows each get a row; an empty table gives an empty one;
    columns other than doc_id and text are not read."""
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "perplexity": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size, n = [], [], 0, 0

        def answer() -> pa.RecordBatch:
            words, before, rows = (np.concatenate(x) for x in zip(*held))
            logs, base, known = model.logs(words, before)
            counts, total = np.bincount(rows, minlength=n), np.bincount(rows, logs, minlength=n)
            values = [pa.concat_arrays(ids), counts, np.bincount(rows, known, minlength=n).astype(np.int64), np.bincount(rows, base, minlength=n), total, 10 ** np.minimum(-total / counts, 300)]
            return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds.values())], list(kinds))

        for batch in batches:
            for at, words, before, rows in _tokens(batch.column(1)):
                held.append((words, before, rows + n))
                ids.append(batch.column(0).slice(at, int(rows[-1]) + 1))
                n += int(rows[-1]) + 1
                size += len(words)
                if size >= ASK:
                    yield answer()
                    ids, held, size, n = [], [], 0, 0
        if held:
            yield answer()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(doc_bucket(F.col("doc_id"), 7) != 2))
    found = score(docs, model)
    return found.select("doc_id", (doc_bucket(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
