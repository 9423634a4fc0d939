from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score int, bucket int, fp int, key string, block int, words string, times int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with names the operators use."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 300)), (2, prose(2, 300)), (3, prose(2, 150) + " " + prose(3, 150)), (4, ""), (5, None), (6, " \t\n \r "), (7, "one"), (7, "one"), (8, "a\x00b c ß İ 你好 👍🏽"), (9, long), (10, long + " tail"),
        (None, prose(4, 50)), (None, None), (None, None), (11, "x" * 50_000), (12, "\n\n\n"), (13, "password: hunter2 token=abcdefgh12345678"), (14, prose(5, 36)), (15, prose(5, 36)), (15, "other text under a used id"), (-3, "!!! ??? ..."),
    ]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"src{k % 2}", None if t is None else len(t), "clash", None, k, k, k, "k", k, "w", 1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    spark.createDataFrame(edge_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 15)] + [(None, 1, 1), (2, None, None), (2, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    items = [(1, " ".join(prose(2, 300).split()[20:60])), (2, "one"), (3, None), (None, "one"), (4, ""), (5, "x y z"), (10, "One")]
    return spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
