"""Cases in which operators once did less than the whole job."""

from __future__ import annotations

import itertools
import random
from collections import Counter

from tessera.llm import near_dups, passages, similar

from .conftest import prose


def test_unlinked_documents_that_share_an_id_or_have_none_all_stay(spark):
    texts = [prose(k, 60) for k in range(300, 307)]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (8, texts[4]), (8, texts[4]), (8, texts[4]), (None, texts[5]), (None, texts[5]), (9, texts[6]), (None, texts[6])]
    docs = spark.createDataFrame([(i, t, f"row {k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, other string").repartition(3)
    want = Counter([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (8, texts[4]), (None, texts[5]), (9, texts[6])])
    assert Counter((r["doc_id"], r["text"]) for r in similar.keep_one(docs).collect()) == want


def shingled(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_the_stage_leaves_no_near_copies(spark):
    """Copies with some words changed, most of them over 4 bits of SimHash apart, and chains of them, against brute force."""
    import corpus_pipeline

    rng, rows = random.Random(4), [(900, ""), (901, None), (902, "two words"), (903, "Two Words"), (904, "words two")]
    for k in range(20):
        words = prose(400 + k, rng.randint(60, 300)).split()
        for copy in range(6):
            rows.append((10 * k + copy, " ".join(words)))
            for _ in range(rng.randint(0, 1 + len(words) // 50)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    own, root = [shingled(t) for _, t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
            root = [root[i] if r == root[j] else r for r in root]
    first: dict[int, int] = {}
    for (i, _), r in zip(rows, root):
        first[r] = min(first.get(r, i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(first.values())


def test_buckets_of_passages_follow_the_bytes_of_text(spark, monkeypatch):
    monkeypatch.setattr(passages, "BUCKET_BYTES", 4000, raising=False)
    monkeypatch.setattr(passages, "ALIKE_ROWS", 3, raising=False)
    seen, anchors = [], passages.anchors
    monkeypatch.setattr(passages, "anchors", lambda docs, window, n: seen.append((n, docs.count())) or anchors(docs, window, n))
    shared = prose(500, 40)
    rows = [(1, prose(501, 80))] * 9 + [(None, prose(502, 20))] * 7 + [(2, prose(503, 50) + " " + shared), (3, shared + " " + prose(504, 70))] + [(4, None)] * 5 + [(k, prose(k, 60)) for k in range(600, 640)]
    found = passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = Counter({(1, ""): 9, (None, prose(502, 20)): 7, (2, prose(503, 50)): 1, (3, prose(504, 70)): 1, (4, ""): 5} | {(k, prose(k, 60)): 1 for k in range(600, 640)})
    assert Counter((r["doc_id"], r["kept"]) for r in found) == want
    assert seen[0][0] > 4 and seen[0][1] == len(rows) - (9 - 2) - (7 - 2) - (5 - 2)
