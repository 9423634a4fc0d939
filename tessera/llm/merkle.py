"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections.

Leaves are sentences, cut again every `LEAF` characters from their start; a line is a paragraph; a section ends with an
empty line or a paragraph whose digest says so, so that an edit moves no border but its own.  Every node is a digest of
its children's, made apart for each level.  The fingerprint writes the tree as text: the root, then each section's digest
with its paragraphs, each with its leaves (digest and length).

Roots test equality.  Where they differ, two trees are compared from the top: sections that both have are alike whole, only
those left over are opened into paragraphs, and only paragraphs left over into leaves; the leaves left over are the edits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parallelism, read, table

LEAF, SECTION, SHOWN = 48, 8, 6
#: Rows alike in id and text beyond which one stands for all.
ALIKE = 1000
PIECES = re.compile(r"[^.!?]{1,%d}[.!?]*\s*|[.!?]+\s*" % LEAF)


def _digest(data: bytes, level: bytes) -> bytes:
    return blake2b(data, digest_size=16, person=level).digest()


class Node(NamedTuple):
    """A branch: the digest shown, where its characters start, how many there are, and its children."""

    digest: str
    start: int
    size: int
    children: tuple = ()


class Tree:
    """The tree of a text: text form, root and sections.

    Digests have 128 bits; the text form and nodes show the first 48 of all but the root's."""

    __slots__ = ("fingerprint", "root", "sections")

    def __init__(self, text: str):
        self.sections: list[Node] = []
        section, nodes, tops, at = [], [], [], 0

        def end() -> None:
            tops.append(_digest(b"".join(nodes), b"section"))
            self.sections.append(Node(tops[-1][:SHOWN].hex(), section[0].start, at - section[0].start, tuple(section)))
            section.clear()
            nodes.clear()

        paragraphs = text.split("\n")
        for k, paragraph in enumerate(paragraphs):
            leaves, digests, start = [], [], at
            for piece in PIECES.findall(paragraph):
                digests.append(_digest(piece.encode(), b"leaf"))
                leaves.append(Node(digests[-1][:SHOWN].hex(), at, len(piece)))
                at += len(piece)
            at += k < len(paragraphs) - 1  # a line's end belongs to its paragraph
            node = _digest(b"".join(digests), b"paragraph")
            nodes.append(node)
            section.append(Node(node[:SHOWN].hex(), start, at - start, tuple(leaves)))
            if not leaves or node[0] % SECTION == 0:
                end()
        if section:
            end()
        self.root = _digest(b"".join(tops), b"root").hex()
        written = (f"{s.digest}={';'.join(p.digest + ':' + ','.join(f'{x.digest}{x.size:x}' for x in p.children) for p in s.children)}" for s in self.sections)
        self.fingerprint = f"{self.root}|{'|'.join(written)}"

    @classmethod
    def parsed(cls, fingerprint: str) -> Tree:
        tree, at, width = cls.__new__(cls), 0, 2 * SHOWN
        tree.fingerprint = fingerprint
        tree.root, *sections = fingerprint.split("|")
        tree.sections, last = [], sum(s.count(";") + 1 for s in sections) - 1
        for section in sections:
            paragraphs, start = [], at
            for paragraph in section[width + 1 :].split(";"):
                leaves, begin = [], at
                for leaf in filter(None, paragraph[width + 1 :].split(",")):
                    leaves.append(Node(leaf[:width], at, int(leaf[width:], 16)))
                    at += leaves[-1].size
                at += last > 0
                last -= 1
                paragraphs.append(Node(paragraph[:width], begin, at - begin, tuple(leaves)))
            tree.sections.append(Node(section[:width], start, at - start, tuple(paragraphs)))
        return tree


def compared(a: Tree, b: Tree) -> tuple[float, list[tuple[int, int]]]:
    """The share of both texts' characters under equal branches, and the spans of the first text, line ends counted, under
    branches that the second has not."""
    total = sum(s.size for s in a.sections), sum(s.size for s in b.sections)
    if a.root == b.root:
        return 1.0, []
    mine, theirs, both = a.sections, b.sections, 0
    while True:
        left = Counter(n.digest for n in theirs)
        own, taken = [], Counter()
        for n in mine:
            if taken[n.digest] < left[n.digest]:
                taken[n.digest] += 1
                both += n.size
            else:
                own.append(n)
        other = []
        for n in reversed(theirs):
            if left[n.digest] > taken[n.digest]:
                left[n.digest] -= 1
                other.append(n)
        if not any(n.children for n in own):
            break
        mine, theirs = [c for n in own for c in n.children], [c for n in reversed(other) for c in n.children]
    spans: list[tuple[int, int]] = []
    for n in own:
        if n.size:
            spans.append((spans.pop()[0], n.start + n.size) if spans and spans[-1][1] == n.start else (n.start, n.start + n.size))
    return min(1.0, 2 * both / max(1, sum(total))), spans


def likeness(a: str, b: str) -> float:
    """The share of two fingerprints' characters under equal branches; 1 for equal roots."""
    return compared(Tree.parsed(a), Tree.parsed(b))[0]


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Spans of characters of the first text under branches that the second has not."""
    return compared(Tree.parsed(a), Tree.parsed(b))[1]


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text and copies, in the order of doc_id (nulls last), then the hash of the text, dealt so that the rows of a
    bucket are neighbours and end (last = true) with the first row of the next bucket, or of the first after the last.
    Texts move once.

    Buckets are ranges of ids; one id with more rows than its share of them, and the rows without an id, are ranges of
    text hashes.  Of over `ALIKE` rows alike in id and text one stands for all, with their number."""
    n = parallelism(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    ids = table(docs.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")))
    total, alike, cuts = ids.agg(F.sum("n"), F.count_if(F.col("n") > ALIKE), F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5])).first()
    heavy = {r["doc_id"]: r["n"] for r in ids.groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") > (total or 0) / n + 1).collect()}  # n at most
    cuts, known = sorted(set(cuts or [])), sorted(i for i in heavy if i is not None)
    id_ = F.col("doc_id")
    reached = lambda values: F.size(F.filter(F.array(*map(F.lit, values)), lambda c: c <= id_)) if values else F.lit(0)
    among = 2 * reached(known) - (id_.isin(known).cast("int") if known else F.lit(0))
    # A heavy id has as many slices of text hashes as its rows are shares of a bucket.
    shift = {i: 64 - max(1, (2 * n * k // total).bit_length()) for i, k in heavy.items()}
    slice_ = F.lit(0).cast("long")
    for bits in sorted(set(shift.values())):
        own = [i for i in known if shift[i] == bits]
        of = (id_.isin(own) if own else F.lit(False)) | (id_.isNull() if shift.get(None) == bits else F.lit(False))
        slice_ = F.when(of, F.shiftright("text_key", bits)).otherwise(slice_)
    none = id_.isNull().cast("int")
    docs = docs.withColumn("bucket", F.struct(none.alias("none"), F.coalesce(reached(cuts), F.lit(0)).alias("range"), F.coalesce(among, F.lit(0)).alias("among"), F.coalesce(slice_, F.lit(0).cast("long")).alias("slice")))
    docs = docs.withColumn("copies", F.lit(1).cast("long"))
    if alike:
        many = ids.where(F.col("n") > ALIKE).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n")
        on = docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["text_key"] == F.col("__key"))
        one = docs.join(many, on).dropDuplicates(["__id", "__key"]).withColumn("copies", F.col("n"))
        docs = docs.join(many, on, "left_anti").unionByName(one.select(*docs.columns))
    # The head of each bucket, of which there are a few times n, and the number of the bucket before it.
    heads = [(r["bucket"], r["head"]) for r in docs.groupBy("bucket").agg(F.min(F.struct(none.alias("none"), "doc_id", "text_key")).alias("head")).orderBy("bucket").collect()]
    numbers = documents.sparkSession.createDataFrame([(tuple(b), k) for k, (b, _) in enumerate(heads)], "of struct<none:int,range:int,among:int,slice:long>, number int")
    before = documents.sparkSession.createDataFrame([(h["doc_id"], h["text_key"], (k - 1) % len(heads)) for k, (_, h) in enumerate(heads)], "head long, head_key long, before int")
    docs = docs.join(F.broadcast(numbers), docs["bucket"] == numbers["of"]).drop("bucket", "of")
    docs = docs.join(F.broadcast(before), docs["doc_id"].eqNullSafe(before["head"]) & (docs["text_key"] == before["head_key"]), "left")
    also = F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("last")))
    to = F.array_compact(F.array(F.struct(F.col("number").alias("bucket"), F.lit(False).alias("last")), also))
    dealt = docs.select("doc_id", "text", "text_key", "copies", F.explode(to).alias("to")).select("to.bucket", "to.last", "doc_id", "text", "copies", "text_key")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "last", F.col("doc_id").asc_nulls_last(), "text_key")


FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_spans array<struct<start:long,end:long>>, copies long"


def fingerprints(documents: DataFrame) -> DataFrame:
    """The fingerprint of every document's text and of its edited text (its last half replaced by the first of the next
    document's), its likeness to the latter's and to the next document's, and the spans of the text that differ from the
    edited one, as the trees locate them.

    A null text is empty; null ids come after all others; rows with equal ids follow each other by the hash of their text;
    the only row of a table is its own next; an empty table gives an empty one; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, held, ended = [], 0, None, None
        for bucket, last, doc_id, text, copies in rows(batches):
            if last and bucket == ended:
                continue  # more rows alike with the next bucket's first
            text = text or ""
            tree = Tree(text)
            if held is not None:
                out.append(_row(*held, text, tree, 1))
                size += len(text)
            if copies > 1 and not last:  # all but the last of rows alike are followed by one of them
                out.append(_row(doc_id, text, tree, text, tree, copies - 1))
            if size > 1 << 22:
                yield _rows(out)
                out, size = [], 0
            held, ended = (None, bucket) if last else ((doc_id, text, tree), ended)
        if out:
            yield _rows(out)

    found = with_next(documents).drop("text_key").mapInArrow(run, FOUND)
    return found.withColumn("copies", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")


def _row(doc_id, text: str, tree: Tree, after: str, next_tree: Tree, copies: int) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    other = Tree(edited)
    near, spans = compared(tree, other)
    return doc_id, len(text), sha256(edited.encode()).hexdigest(), tree.fingerprint, other.fingerprint, near, compared(tree, next_tree)[0], [{"start": a, "end": b} for a, b in spans], copies


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "edited_spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "copies": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.values())], list(kinds))


def op9_merkle(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(read(spark, sf_dir, "documents"))
    spans = F.transform("edited_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("edited_spans", F.array_join(spans, ","))
