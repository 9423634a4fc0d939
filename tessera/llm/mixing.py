"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

A source's documents are cut into blocks of words (or taken whole) and put in a fixed random order.  Its quota is the
number of blocks, counted along that order and again from its start, that meets its target.  How many of a source's blocks
go to each output shard is drawn by a tree: the root holds the exact quotas of all sources, and each node deals them to
two halves of its shards as a draw without replacement would.  Every shard then draws its blocks from the permuted
sequence of each source at its own quotas, so draws are disjoint and what is taken is what the shards have drawn; within a
shard blocks follow a second random order.

Running sums are taken over ranges of the order, in parallel: a hot source is many ranges.  The tree splits groups of
`SOURCES` sources first, a row for each group, and then the sources of each group in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, parallelism, read, scratch, table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS, N_SHARDS, SEED, SOURCES = 256, 64, 11, 4096
WORD = r"[^ \t-\r]+"


def running(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its value over all rows before in the order; the table is written on the way."""
    ranged = df.withColumns({f"_{n}": v for n, v in values.items()}).repartitionByRange(parallelism(df.sparkSession), *order)
    ranged = table(ranged.withColumn("_range", F.spark_partition_id()))
    sums = {r["_range"]: r for r in ranged.groupBy("_range").agg(*(F.sum(f"_{n}").alias(n) for n in values)).collect()}
    last = max(sums, default=0)
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for n in values:
        parts = np.cumsum([0, *(int(sums[k][n]) if k in sums else 0 for k in range(last))]).tolist()
        out[n] = F.element_at(F.array(*[F.lit(x).cast("long") for x in parts]), F.col("_range") + 1) + F.coalesce(F.sum(f"_{n}").over(inner), F.lit(0))
    return ranged.withColumns(out).drop("_range", *(f"_{n}" for n in values))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, source_rank, source_start, target) from (source, size): sources by code point, null last,
    weigh `weights` in turn and share `share` times all sizes; none gets over `most` times its own size, and what is over
    is shared again by weight.  An empty table gives an empty one; sources of size zero get zero."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = running(sources, [F.col("source").isNull(), F.col("source")], {"source_rank": F.lit(1).cast("long"), "source_start": F.col("source_size")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    sources = table(sources.withColumn("_weight", weight))
    cap = F.col("source_size") * F.lit(most)
    level, full = 0.0, -1
    while True:
        above = F.col("_weight") * F.lit(level) > cap
        total, capped, weighed, n = sources.agg(F.sum("source_size"), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("_weight"))), F.count_if(above)).first()
        if n == full or not weighed:
            break
        full, level = n, (share * total - (capped or 0.0)) / weighed
    return sources.withColumn("target", F.least(cap, F.col("_weight") * F.lit(level))).drop("_weight")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """One exact draw for counts of any size: how many of `drawn` items out of good + bad are good.

    Probabilities around the mode are made by their ratios, out to where they vanish, and inverted."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    spread = int(14 * np.sqrt(drawn / total * good * (bad / total) * ((total - drawn) / max(total - 1, 1)))) + 30
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], "right").clip(0, b - a))


def even(total: int, n_shards: int) -> list[int]:
    """Sizes of shards that differ by one at most."""
    return [total * (j + 1) // n_shards - total * j // n_shards for j in range(n_shards)]


def split(counts: list[int], room: list[int], seed: tuple[int, ...] = (SEED,)) -> np.ndarray:
    """Quotas by shard (rows) and source (columns), as draws without replacement would give: sums over shards are the
    counts, sums over sources the room of each shard."""
    out = np.zeros((len(room), len(counts)), np.int64)
    todo = [(0, len(room), list(counts))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        mid = (a + b) // 2
        rng, drawn, rest, left = np.random.default_rng([*seed, a, b]), sum(room[a:mid]), sum(have), []
        for n in have:
            k = hypergeometric(rng, n, rest - n, drawn)
            left.append(k)
            rest, drawn = rest - n, drawn - k
        todo += [(a, mid, left), (mid, b, [n - k for n, k in zip(have, left)])]
    return out


def quotas(sources: DataFrame, n_shards: int, seed: int, group: int = SOURCES) -> DataFrame:
    """(source, first, cycle, ends) of sources (source, source_rank, n, first, cycle): ends are the running sums of a
    source's quotas over the shards.  Groups of sources are split like sources, and then each group within its quotas."""
    sources = sources.withColumn("part", F.floor(F.col("source_rank") / group))

    def of_groups(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part", kind="stable")
        counts = [int(n) for n in rows["n"]]
        return pd.DataFrame({"part": rows["part"], "room": list(split(counts, even(sum(counts), n_shards), (seed,)).T)})

    def of_sources(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_rank", kind="stable")
        drawn = split([int(n) for n in rows["n"]], [int(k) for k in rows["room"].iloc[0]], (seed, int(rows["part"].iloc[0]) + 1))
        return pd.DataFrame({"source": rows["source"], "first": rows["first"], "cycle": rows["cycle"], "ends": list(np.cumsum(drawn, axis=0).T)})

    totals = sources.groupBy("part").agg(F.sum("n").alias("n"))
    room = totals.groupBy(F.lit(0).alias("all")).applyInPandas(lambda rows: of_groups(rows), "part long, room array<long>")
    return sources.join(room, "part").groupBy("part").applyInPandas(lambda rows: of_sources(rows), "source string, first long, cycle long, ends array<long>")


def mix(documents: DataFrame, block_words: int | None = BLOCK_WORDS, n_shards: int = N_SHARDS, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each block of every document: row_id, doc_id, text_key, source, size, source_size, target, block, words
    and shards: the output shard that draws it, each time it is drawn, so an empty list if it is not.

    block_words=None takes documents whole.  size counts words; null and empty texts are one empty block, which is never
    drawn; a null source is a source, the last; repeated rows count each; other columns are not read.  Runs over the same
    rows agree.
    """
    with scratch(documents.sparkSession):
        docs = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_key"))
        docs = table(docs.withColumn("row_id", F.monotonically_increasing_id()))
        sources = table(targets(docs, weights, share, most))
        if block_words:
            n_blocks = F.greatest(F.ceil(F.col("size") / block_words), F.lit(1))
            blocks = docs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
            blocks = blocks.withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words))
        else:
            blocks = docs.withColumns({"block": F.lit(0).cast("long"), "words": F.col("size")})
        blocks = blocks.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "text_key", "block"))
        order = [F.col("source").isNull(), F.col("source"), F.col("_order"), F.col("doc_id"), F.col("size"), F.col("block"), F.col("row_id")]
        blocks = running(blocks, order, {"_before": F.col("words"), "_number": (F.col("words") > 0).cast("long")})
        by_source = lambda a, b: a["source"].eqNullSafe(b["_source"])
        other = sources.withColumnRenamed("source", "_source")
        blocks = table(blocks.join(other, by_source(blocks, other)).drop("_source"))
        # A draw belongs to the quota while half of its block lies below the target; draws go round `most` times at most.
        rounds = int(np.ceil(most))
        half = F.col("_before") - F.col("source_start") + F.col("words") / 2
        below = sum(((half + F.col("source_size") * c <= F.col("target")).cast("long") for c in range(rounds)), F.lit(0).cast("long"))
        quota = blocks.where("words > 0").groupBy("source", "source_rank").agg(F.sum(below).alias("n"), F.min("_number").alias("first"), F.count(F.lit(1)).alias("cycle"))
        drawn = table(quotas(quota, n_shards, seed)).select(F.col("source").alias("_source"), "first", "cycle", "ends")
        placed = blocks.join(drawn, by_source(blocks, drawn), "left")
        draws = F.array(*(F.col("_number") - F.col("first") + c * F.col("cycle") for c in range(rounds)))
        shards = F.transform(F.filter(draws, lambda k: k < F.element_at("ends", -1)), lambda k: F.size(F.filter("ends", lambda e: e <= k)))
        return kept(placed.select("row_id", "doc_id", "text_key", "source", "size", "source_size", "target", "block", "words", F.when(F.col("words") > 0, shards).otherwise(F.array().cast("array<int>")).alias("shards")))


def drawn(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Every draw of a plan as a row, with its shard and its slot there: from 0, gapless, in the shard's own random order."""
    draws = plan.select("*", F.posexplode("shards").alias("turn", "shard")).drop("shards")
    draws = draws.withColumn("_place", F.xxhash64(F.lit(seed + 1), "doc_id", "text_key", "block", "turn"))
    order = [F.col("shard"), F.col("_place"), F.col("doc_id"), F.col("row_id"), F.col("block"), F.col("turn")]
    with scratch(plan.sparkSession):
        draws = running(draws, order, {"_at": F.lit(1).cast("long")})
        starts = table(draws.groupBy("shard").agg(F.min("_at").alias("_start")))  # a row for each shard
        return kept(draws.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_at") - F.col("_start")).drop("_place", "_at", "_start"))


def mix_documents(documents: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, **options) -> DataFrame:
    """documents, all columns: a row for each draw of a mix of whole documents, dealt to its shard and there in its slot's
    order.  Rows alike in id, text and source are the same to the mix; what else they hold comes from any one of them."""
    key = ["__mix_id", "__mix_key", "__mix_source"]
    named = [F.col(c).alias(k) for c, k in zip(("doc_id", "text_key", "source"), key)]
    with scratch(documents.sparkSession):
        plan = mix(documents, block_words=None, n_shards=n_shards, seed=seed, **options)
        draws = kept(drawn(plan, seed).select(*named, F.col("shard").alias("__mix_shard"), F.col("slot").alias("__mix_slot")))
        alike = kept(plan.select(*named).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = lambda a, b: a[key[0]].eqNullSafe(b[key[0]]) & (a[key[1]] == b[key[1]]) & a[key[2]].eqNullSafe(b[key[2]])
    docs = documents.withColumns(dict(zip(key, (F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("source").cast("string")))))
    once = draws.join(alike, same(draws, alike), "left_anti").toDF(*(f"{c}_" for c in draws.columns))
    often = draws.join(alike, same(draws, alike), "left_semi").toDF(*(f"{c}_" for c in draws.columns))
    one = table(docs.join(alike, same(docs, alike), "left_semi").dropDuplicates(key))  # one row for many alike
    on = lambda a, b: a[key[0]].eqNullSafe(b[f"{key[0]}_"]) & (a[key[1]] == b[f"{key[1]}_"]) & a[key[2]].eqNullSafe(b[f"{key[2]}_"])
    out = docs.join(once, on(docs, once)).unionByName(one.join(often, on(one, often)))
    # A shard is as many partitions as the cluster needs, each a range of its slots.
    pieces = max(1, -(-parallelism(documents.sparkSession) // n_shards))
    width = max(1, -(-draws.count() // (n_shards * pieces)))
    piece = F.col("__mix_shard_") * pieces + F.least(F.floor(F.col("__mix_slot_") / width), F.lit(pieces - 1)).cast("int")
    return out.repartitionById(n_shards * pieces, piece).sortWithinPartitions("__mix_shard_", "__mix_slot_").select(*documents.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mix(read(spark, sf_dir, "documents"))
    draws = drawn(plan.select("row_id", "doc_id", "text_key", "block", "words", "shards"))
    taken = draws.groupBy("row_id").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("places"))
    docs = plan.where("block = 0").select("row_id", "doc_id", "size", "source_size", "target").join(taken, "row_id", "left")
    places = F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["shard"].cast("string"), p["slot"].cast("string"))), ",")
    return docs.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(places, F.lit("")).alias("places"))
