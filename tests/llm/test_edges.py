"""Every operator on awkward rows and on empty tables: a row out for each row in, and nothing out of nothing."""

from __future__ import annotations

from collections import Counter

import pytest

from tessera.llm import decontaminate, kneser_ney, merkle, mixing, near_dups, passages, quality, secrets, sharding, similar, toxicity

OPERATORS = {
    "decontaminate": lambda d, b, y: decontaminate.find_contamination(d, b),
    "secrets": lambda d, b, y: secrets.find_secrets(d),
    "mixing": lambda d, b, y: mixing.mix(d, block_words=None),
    "sharding": lambda d, b, y: sharding.shard(d, 3),
    "toxicity": lambda d, b, y: toxicity.score(d, y),
    "kneser_ney": lambda d, b, y: kneser_ney.score(d, kneser_ney.train(d)),
    "quality": lambda d, b, y: quality.score(d, y),
    "near_dups": lambda d, b, y: near_dups.near_duplicates(d),
    "merkle": lambda d, b, y: merkle.fingerprints(d),
    "passages": lambda d, b, y: passages.remove_passages(d),
}
FILTERS = {
    "decontaminate": lambda d, b, y: decontaminate.decontaminate(d, b),
    "toxicity": lambda d, b, y: toxicity.keep_civil(d, y),
    "near_dups": lambda d, b, y: similar.keep_one(d),
    "mixing": lambda d, b, y: mixing.mix_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(edges, nothing, benchmark_items, labels, edge_rows, name):
    got = OPERATORS[name](edges, benchmark_items, labels).select("doc_id").collect()
    assert Counter(r[0] for r in got) == Counter(r[0] for r in edge_rows)
    assert OPERATORS[name](nothing, benchmark_items.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(edges, nothing, benchmark_items, labels, edge_rows, name):
    out = FILTERS[name](edges, benchmark_items, labels)
    assert out.columns == edges.columns
    assert {tuple(r) for r in out.collect()} <= set(edge_rows)
    assert FILTERS[name](nothing, benchmark_items, labels).count() == 0
    assert FILTERS[name](edges, benchmark_items.limit(0), labels.limit(0)).columns == edges.columns
