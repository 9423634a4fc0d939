"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

Both start from a dictionary that zstandard trains on windows of ordinary documents.  The toxic one also holds the
stretches that toxic documents repeat in many different surroundings and ordinary ones do not, where the ordinary one has
blanks, so that offsets agree and a window's two compressed lengths differ only by what such stretches save.  A document
is judged by the savings of all its overlapping windows; weights and threshold are calibrated on documents that the
dictionaries of the other half of the sample have not seen.

Training reads a bounded sample (`TOXIC` and `ORDINARY` documents at most, with the bounds on bytes of `labelled`) and runs in
one task of an executor.  Scoring is one pass, with no shuffle, over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import chance, logistic, sample, trained
from .shared import doc_bucket, map_batches, read
from .words import LOWER, text_rows

TOXIC, ORDINARY, DICTIONARY = 1500, 3000, 4096
#: Windows of ordinary text that zstandard trains on, at most; the longest stretch; the least ratio of a telling gram.
TRAINED_ON, LONGEST, LEAST, SHARE = 40_000, 24, 20.0, 0.02
WINDOW, STRIDE, GRAM, THRESHOLD, FEATURES = 10, 5, 5, 0.7, 10
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TAIL = b" " + bytes(range(33, 65))
SEARCH = zstandard.ZstdCompressionParameters(compression_level=3, strategy=5, min_match=5, hash_log=14, chain_log=14, search_log=9, window_log=14, write_checksum=False, write_content_size=False, write_dict_id=False)


def words(lowered: bytes) -> list[bytes]:
    return WORD.findall(lowered)


def windows(tokens: list[bytes]) -> list[bytes]:
    """Overlapping windows of words that cover all; a text without words is one empty window."""
    return [b" " + b" ".join(tokens[i : i + WINDOW]) + b" " for i in range(0, max(1, len(tokens) - WINDOW + STRIDE), STRIDE)]


def _grams(docs: list[list[bytes]]) -> tuple[Counter, int]:
    """How many different (word before, word, word after) hold each gram: copies of a text count once."""
    seen: set[tuple[bytes, bytes, bytes]] = set()
    for d in docs:
        seen.update(zip([b"", *d[:-1]], d, [*d[1:], b""]))
    found: Counter[bytes] = Counter()
    for _, word, _ in seen:
        padded = b" " + word + b" "
        found.update({padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)})
    return found, len(seen)


def telling(toxic: list[list[bytes]], ordinary: list[list[bytes]], least: float = LEAST, share: float = SHARE) -> list[bytes]:
    """Stretches of grams over-represented in toxic text (log-likelihood ratio above least and above share of the top),
    each drawn out as long as most toxic words that hold it go on alike."""
    (ours, n), (theirs, m) = _grams(toxic), _grams(ordinary)
    x = lambda k, of: k * np.log(k / of) if k else 0.0
    ratio = {}
    for gram, a in ours.items():
        b = theirs.get(gram, 0)
        if a >= 3 and a * m > 4 * b * n:
            v = 2 * (x(a, n) + x(n - a, n) + x(b, m) + x(m - b, m) - x(a + b, n + m) - x(n + m - a - b, n + m))
            if v > least:
                ratio[gram] = v
    keep = {g for g, v in ratio.items() if v >= share * max(ratio.values())}
    runs: Counter[bytes] = Counter()
    for d in toxic:
        for word in set(d):
            padded, start = b" " + word + b" ", -1
            for i in range(len(padded) - GRAM + 2):
                if padded[i : i + GRAM] in keep and i <= len(padded) - GRAM:
                    start = i if start < 0 else start
                elif start >= 0:
                    runs[padded[start : i + GRAM - 1]] += 1
                    start = -1
    padded = Counter(b" " + w + b" " for d in toxic for w in set(d))
    drawn: Counter[bytes] = Counter()
    for run, n_run in runs.items():
        holding = [(w, k) for w, k in padded.items() if run in w]
        while len(run) < LONGEST:
            after: Counter[int] = Counter()
            for w, k in holding:
                if 0 <= (i := w.find(run)) < len(w) - len(run):
                    after[w[i + len(run)]] += k
            byte, k = max(after.items(), key=lambda x: x[1], default=(0, 0))
            if k < 0.7 * max(n_run, after.total()):
                break
            run += bytes([byte])
        drawn[run] += n_run
    runs, whole = drawn, []
    for run in sorted(runs, key=lambda r: (-len(r), r)):
        if not any(run in w for w in whole):
            whole.append(run)
    return sorted(whole, key=lambda r: (runs[r], r))


class Dictionaries:
    """The two dictionaries; compressors are made where they are used."""

    def __init__(self, docs: list[list[bytes]], toxic: np.ndarray):
        ordinary = [d for d, y in zip(docs, toxic) if not y]
        stretches = b"".join(telling([d for d, y in zip(docs, toxic) if y], ordinary))
        rng = np.random.default_rng(3)
        pieces = [w for d in ordinary for w in windows(d)]
        pieces = [pieces[i] for i in rng.permutation(len(pieces))[:TRAINED_ON]]
        try:
            base = zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself
            base = b"".join(pieces)[:DICTIONARY]
        self.contents = (base + b" " * len(stretches) + TAIL, base + stretches + TAIL)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=SEARCH) for c in self.contents]


def features(tokens: list[bytes], ordinary, toxic) -> np.ndarray:
    """What a document's windows save, in bytes: the most, the next ones, how many save, and of how many."""
    gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(tokens)])
    top = np.sort(np.concatenate([gain, np.zeros(8, gain.dtype)]))[::-1]
    high = (gain >= 3).sum()
    saved = gain[gain >= 3].sum()
    return np.array([top[0], top[1:4].sum(), top[4:8].sum(), np.log1p(high), high / len(gain), (gain >= 5).mean(), np.log(len(gain)), np.log1p(saved), saved / len(gain), np.log1p((gain >= 5).sum())])


def train(documents: DataFrame, labels: DataFrame) -> tuple[Dictionaries, tuple]:
    """Dictionaries on the whole sample; the calibration on each half by the dictionaries of the other half."""
    rows, counts = sample(documents, labels, "toxic", {1: TOXIC, 0: ORDINARY})

    def fit(texts: list[str], y: np.ndarray) -> tuple[Dictionaries, tuple]:
        docs = [words(LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes()) for t in texts]
        if len(set(y.tolist())) < 2:  # nothing to tell apart: everything is as likely as the labels say
            rate = float(np.clip(counts.get(1, 0) / max(1, sum(counts.values())), 1e-6, 1 - 1e-6))
            return Dictionaries([[b"none"]], np.zeros(1)), (np.zeros(FEATURES), np.ones(FEATURES), np.array([0.0] * FEATURES + [np.log(rate / (1 - rate))]))
        half = np.arange(len(y)) % 2
        x = np.zeros((len(y), FEATURES))
        for k in (0, 1):
            a, b = (c.compress for c in Dictionaries([d for d, f in zip(docs, half) if f != k], y[half != k]).compressors())
            for i in np.flatnonzero(half == k):
                x[i] = features(docs[i], a, b)
        weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
        return Dictionaries(docs, y), logistic(x, y, weight / weight.mean())

    return trained(rows, fit)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_key and score (0 to 1, the chance of label 1) of every row of documents.

    Only labels of documents outside fold 1 of 3 are learnt from.  Null and empty texts are one empty window; repeated
    rows each get a row; without labels of both kinds every score is the share of label 1; an empty table gives an empty
    one; columns other than doc_id and text are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(train(documents, labels))  # two dictionaries, a few KB

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        dictionaries, model = held.value
        a, b = (c.compress for c in dictionaries.compressors())
        data, offsets = text_rows(batch.column(1))
        x = np.zeros((batch.num_rows, FEATURES))
        for i in range(batch.num_rows):
            x[i] = features(words(LOWER[data[offsets[i] : offsets[i + 1]]].tobytes()), a, b)
        yield {"doc_id": batch.column(0), "text_key": batch.column(2), "score": chance(model, x)}

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")), each, "doc_id long, text_key long, score double")


def keep_civil(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score below the threshold.  One pass: the score is made beside the row."""
    held = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries, model = held.value
        a, b = (c.compress for c in dictionaries.compressors())
        at = names.index("text")
        for batch in batches:
            data, offsets = text_rows(batch.column(at))
            x = [features(words(LOWER[data[offsets[i] : offsets[i + 1]]].tobytes()), a, b) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(chance(model, np.array(x).reshape(-1, FEATURES)) < threshold))

    return documents.mapInArrow(run, documents.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", (doc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
