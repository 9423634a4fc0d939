"""Quality by a byte-level convolutional network, trained and run in numpy.

Bytes are embedded, filters of `WIDTH` bytes slide over them, and each filter's largest response is kept in every chunk
of 256 bytes; chunks overlap by half and cover the whole text.  A document's probability comes from the mean and the
maximum over its chunks.  Gradients reach only the places that won a maximum, so training is cheap.

Training reads a bounded sample (`LOW` and `HIGH` documents at most, with the bounds on bytes of `labelled`) and runs in one
task of an executor.  Scoring is one pass, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample, trained
from .shared import doc_bucket, map_batches, read
from .words import row_blocks, text_rows

LOW, HIGH, THRESHOLD = 1500, 3000, 0.5
WIDTH, EMBED, FILTERS, SEGMENT, PER_CHUNK, STEP = 5, 8, 16, 64, 4, 2
NEVER = np.float32(-1e9)
#: Bytes convolved at a time; a longer text is convolved in several goes.
GO = 1 << 16


class Net:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 1, (256, EMBED)), "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)), "bias": np.zeros(FILTERS),
            "mean": np.zeros(FILTERS), "most": np.zeros(FILTERS), "base": np.zeros(1),
        }
        self.tables: np.ndarray | None = None

    def ready(self) -> Net:
        """The response of each filter place to each byte: embedding and filter in one table."""
        self.tables = np.einsum("be,wef->wbf", self.p["embed"], self.p["filters"]).astype(np.float32)
        return self

    def respond(self, data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each segment, and where it was.  data has WIDTH - 1 bytes more."""
        n = len(valid)
        out, at = np.empty((n // SEGMENT, FILTERS), np.float32), np.empty((n // SEGMENT, FILTERS), np.int64)
        for a in range(0, n, GO):
            b = min(n, a + GO)
            conv = self.tables[0][data[a:b]]
            for j in range(1, WIDTH):
                conv += self.tables[j][data[a + j : b + j]]
            conv[~valid[a:b]] = NEVER
            conv = conv.reshape(-1, SEGMENT, FILTERS)
            where = conv.argmax(1)
            s = slice(a // SEGMENT, b // SEGMENT)
            out[s] = np.take_along_axis(conv, where[:, None], 1)[:, 0] + self.p["bias"].astype(np.float32)
            at[s] = where + a + SEGMENT * np.arange(len(where))[:, None]
        return out, at

    def forward(self, texts: list[np.ndarray]) -> dict:
        sizes = np.array([len(t) for t in texts])
        segments = np.maximum(1, -(-sizes // SEGMENT))
        first = np.cumsum(segments) - segments
        data = np.zeros(segments.sum() * SEGMENT + WIDTH - 1, np.uint8)
        valid = np.zeros(segments.sum() * SEGMENT, bool)
        for t, f in zip(texts, first * SEGMENT):
            data[f : f + len(t)] = t
            valid[f : f + len(t)] = True
        best, at = self.respond(data, valid)
        chunks = np.maximum(1, -(-(segments - PER_CHUNK) // STEP) + 1)
        starts = np.cumsum(chunks) - chunks
        doc = np.repeat(np.arange(len(texts)), chunks)
        begin = first[doc] + STEP * (np.arange(len(doc)) - starts[doc])
        index = np.minimum(begin[:, None] + np.arange(PER_CHUNK), (first + segments - 1)[doc][:, None])
        four = best[index]
        won = four.argmax(1)
        pooled = np.maximum(np.take_along_axis(four, won[:, None], 1)[:, 0], 0).astype(np.float64)
        mean, most = np.add.reduceat(pooled, starts) / chunks[:, None], np.maximum.reduceat(pooled, starts)
        logit = mean @ self.p["mean"] + most @ self.p["most"] + self.p["base"][0]
        return {"data": data, "doc": doc, "chunks": chunks, "pooled": pooled, "mean": mean, "most": most, "logit": logit, "place": np.take_along_axis(at[index], won[:, None], 1)[:, 0]}

    def gradients(self, f: dict, y: np.ndarray, weight: np.ndarray) -> dict:
        error = weight * (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / weight.sum()
        doc = f["doc"]
        top = f["pooled"] == f["most"][doc]  # chunks overlap, so one place may be the maximum of two: they share its part
        top = top / np.add.reduceat(top, np.cumsum(f["chunks"]) - f["chunks"], dtype=float)[doc]
        to = error[doc, None] * (self.p["mean"] / f["chunks"][doc, None] + self.p["most"] * top)
        to *= f["pooled"] > 0
        tables = np.zeros((WIDTH, 256, FILTERS))
        column = np.broadcast_to(np.arange(FILTERS), to.shape)
        for j in range(WIDTH):
            np.add.at(tables[j], (f["data"][f["place"] + j], column), to)
        return {
            "embed": np.einsum("wbf,wef->be", tables, self.p["filters"]), "filters": np.einsum("be,wbf->wef", self.p["embed"], tables), "bias": to.sum(0),
            "mean": error @ f["mean"], "most": error @ f["most"], "base": np.array([error.sum()]),
        }

    def fit(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, decay: float = 1e-4) -> Net:
        """Adam, in an order fixed by the seed; the rate falls to a tenth."""
        rng = np.random.default_rng(2)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, total = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                own = order[a : a + batch]
                g = self.gradients(self.ready().forward([texts[i] for i in own]), y[own], weight[own])
                step += 1
                for k in self.p:
                    d = g[k] + decay * self.p[k] * (k != "base")
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.p[k] = self.p[k] - rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self.ready()

    def chances(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(texts)["logit"], -30, 30)))


def train(documents: DataFrame, labels: DataFrame) -> Net:
    rows, counts = sample(documents, labels, "quality", {0: LOW, 1: HIGH})

    def fit(texts: list[str], y: np.ndarray) -> Net:
        net = Net()
        if len(set(y.tolist())) < 2:
            rate = np.clip(counts.get(1, 0) / max(1, sum(counts.values())), 1e-6, 1 - 1e-6)
            net.p["base"][0] = np.log(rate / (1 - rate))
            return net.ready()
        data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
        return net.fit(data, y, weight / weight.mean(), epochs=int(np.clip(12_000 // len(y), 4, 40)))

    return trained(rows, fit)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1, the chance of label 1) of every row of documents.

    Only labels of documents outside fold 1 of 3 are learnt from.  Null and empty texts have one chunk without a
    response; repeated rows each get a row; without labels of both kinds every score is the share of label 1; an empty
    table gives an empty one; columns other than doc_id and text are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(train(documents, labels))  # 20 KB of weights

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = text_rows(batch.column(1))
        for a, b in row_blocks(offsets, 1 << 18):
            yield {"doc_id": batch.column(0).slice(a, b - a), "score": held.value.chances([data[offsets[i] : offsets[i + 1]] for i in range(a, b)])}

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", (doc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
