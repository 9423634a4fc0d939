"""The operators against brute force on small tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from tessera.llm import decontaminate, kneser_ney, merkle, mixing, near_dups, passages, quality, secrets, sharding, similar, toxicity
from tessera.llm.words import ALNUM, SPACED, Block

from .conftest import prose

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def test_word_kernels(edge_rows):
    texts = [r[1] or "" for r in edge_rows]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for kept, lower, words in ((SPACED, False, spaced), (ALNUM, True, alnum)):
        block = Block(data, offsets, kept, lower)
        body, h = block.data.tobytes(), block.hashes()
        seen = {}
        for k, t in enumerate(texts):
            own = range(block.first[k], block.first[k + 1])
            assert [body[block.starts[i] : block.ends[i]].decode() for i in own] == words(t)
            for i, w in zip(own, words(t)):
                assert seen.setdefault(w, h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("most_words", [1_000_000, 7])
def test_contamination(edges, edge_rows, benchmark_items, most_words):
    items = {r["item_id"]: alnum(r["text"]) for r in benchmark_items.collect() if r["item_id"] is not None and alnum(r["text"])}
    want = Counter()
    for doc_id, text, *_ in edge_rows:
        w, hit, found = alnum(text), set(), set()
        for item, iw in items.items():
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        want[(doc_id, len(w), tuple(sorted(hit)), tuple(sorted(found)))] += 1
    got = Counter()
    for r in decontaminate.find_contamination(edges, benchmark_items, most_words=most_words).collect():
        hit = sorted({p for s in r["hits"] for p in range(s["start"], s["end"])})
        got[(r["doc_id"], r["n_words"], tuple(hit), tuple(sorted(r["item_ids"])))] += 1
    assert got == want


def test_winnowing_keeps_few_grams_and_finds_every_span():
    rng = np.random.default_rng(3)
    hashes = rng.integers(1 << 60, size=5000, dtype=np.uint64)
    places, _ = decontaminate.winnowed(hashes, len(hashes) - np.arange(len(hashes)), 10)
    assert len(places) < 0.35 * len(hashes)
    for n in (1, 2, 3, 7, 10):  # a planted span at any offset, of two words only so that hashes tie
        for offset in range(0, 30):
            span = rng.integers(2, size=n).astype(np.uint64)
            one, two = (np.concatenate([rng.integers(5, 9, size=k).astype(np.uint64), span, rng.integers(5, 9, size=9).astype(np.uint64)]) for k in (offset, 13))
            (p, f), (q, g) = (decontaminate.winnowed(x, len(x) - np.arange(len(x)), n) for x in (one, two))
            assert {(a - offset, h) for a, h in zip(p.tolist(), f.tolist())} & {(a - 13, h) for a, h in zip(q.tolist(), g.tolist()) if 13 <= a < 13 + n}


def test_clean_documents_stay(edges, benchmark_items):
    kept = [r["doc_id"] for r in decontaminate.decontaminate(edges, benchmark_items).collect()]
    assert not {1, 2, 3, 7} & set(kept) and {4, 5, 6, 9, 13} <= set(kept)


def least_guesses(value: str, ranks) -> float:
    """The cheapest segmentation over every span there is."""
    n, brute, (lower, plain) = len(value), secrets.brute_cost(value), secrets._plain(value)
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = best[j - 1] + brute
        for i in range(j):
            own, costs = value[i:j], []
            if plain[i:j] in ranks.rank:
                costs.append(secrets.word_cost(own, lower[i:j], plain[i:j], ranks.rank[plain[i:j]]))
            if own[-1].isdigit() and secrets.DATE.fullmatch(own):
                costs.append(secrets.date_cost(j - i))
            steps = [secrets._step(a, b) for a, b in zip(own, own[1:])]
            if len(steps) > 1 and all(steps):
                costs.append(secrets.walk_cost(len(steps), 1 + sum(a != b for a, b in zip(steps, steps[1:]))))
            costs += [secrets.repeat_cost(u, (j - i) // u, brute) for u in range(1, 5) if (j - i) % u == 0 and (j - i) // u >= 3 and own == own[:u] * ((j - i) // u)]
            for cost in costs:
                best[j] = min(best[j], best[i] + cost + (secrets.PENALTY if i else 0))
    return best[n]


def test_guesses_are_the_least_over_segmentations():
    rng = random.Random(11)
    ranks = secrets.Ranks(secrets.WORDS, ["blue", "elephant", "dancing", "zzz", "abab", "ferdin"])
    parts = ["password", "Admin", "t0ken", "blue", "elephant", "1999", "2024-02-28", "qwerty", "qazwsx", "abcdefgh", "9876", "1111", "xyxyxy", "zzzzzz", "121212", "abcabcabc", "K9", "$mQ", "7f", "-", "é"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(1500)] + ["".join(rng.choice("ab12qw") for _ in range(rng.randint(1, 24))) for _ in range(1500)]
    values += ["K9111112024tokenQK9", "zzzzzz1999qwertyxyxyxyf7", "passwordefghijklm", "xpxpxpassword"]
    for v in values:
        assert secrets.guesses(v, ranks) == pytest.approx(least_guesses(v, ranks), abs=1e-9), v
    assert secrets.guesses("password") < 1 < secrets.guesses("password1987") < 8 < 20 < secrets.guesses("xK9#mQ2$vL7p")
    assert secrets.guesses("ab" * 50_000) < 10 and secrets.guesses("z" * 100_000) < 10 and secrets.guesses("12321" * 20_000) > 1
    assert secrets.guesses("2024-02-28") < 6 and secrets.guesses("qwertyuiop") < 6


def test_words_of_the_corpus_are_ranked(spark):
    rows = [(i, "Common élan " * 3 + ("rarer" if i < 7 else "") + (" unique" if i < 4 else "")) for i in range(9)]
    docs = spark.createDataFrame(rows + [(None, None)], "doc_id long, text string")
    assert secrets.corpus_words(docs) == ["common", "élan", "rarer"] and secrets.corpus_words(docs, 2) == ["common", "élan"]


def test_spans():
    text = 'ä PassWord : "abc" secret=\'abcdefgh\' ſecret=abcdefgh AKIA0123456789AB AKIA01 ' + "0123456789abcdef" * 2 + " pwd: xK9#mQ2$vL7p! api_key:" + "k" * 9
    got = [(k, text[s:e]) for s, e, k, _ in secrets.scan(text)]
    assert got == [("assign", "secret='abcdefgh"), ("access", "AKIA0123456789AB"), ("hex", "0123456789abcdef" * 2), ("guess", "xK9#mQ2$vL7p!"), ("assign", "api_key:" + "k" * 9)]


def water_level(sizes: dict, share: float = 1.5) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = dict(zip(names, itertools.cycle((5, 2, 1)))), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        above = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = {r["doc_id"]: len(spaced(r["text"])) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sums = defaultdict(int)
    for i, n in size.items():
        sums[source[i]] += n
    want, plan = water_level(sums), mixing.mix(docs, block_words=32, n_shards=8).collect()
    taken, by_doc, shards = defaultdict(int), defaultdict(int), Counter()
    for r in plan:
        assert r["size"] == size[r["doc_id"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["words"] * len(r["shards"])
        by_doc[r["doc_id"]] += r["words"] * len(r["shards"])
        shards.update(r["shards"])
    assert all(abs(taken[s] - want[s]) <= 32 for s in want)
    assert all(by_doc[i] <= 2 * size[i] for i in size)
    assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 1
    key = lambda r: (r["doc_id"], r["block"], r["turn"], r["shard"], r["slot"])
    once, again = (mixing.drawn(mixing.mix(d, block_words=32, n_shards=8)).collect() for d in (docs, docs.repartition(5)))
    assert Counter(map(key, again)) == Counter(map(key, once))
    slots = defaultdict(list)
    for r in once:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values()) and {s: len(own) for s, own in slots.items()} == shards


def test_what_is_taken_is_what_the_tree_deals(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    split = mixing.split
    monkeypatch.setattr(mixing, "split", lambda counts, room, seed: split(counts, room, seed) // 2)  # a tree that deals half
    half = sum(r["words"] * len(r["shards"]) for r in mixing.mix(docs, block_words=32, n_shards=8).collect())
    monkeypatch.undo()
    assert 0.1 < half / sum(r["words"] * len(r["shards"]) for r in mixing.mix(docs, block_words=32, n_shards=8).collect()) < 0.6


def test_groups_of_sources_split_as_one_tree_would(spark):
    rows = [(f"s{k:02}", k, 50 + 7 * k, 0, 40) for k in range(10)]
    sources = spark.createDataFrame(rows, "source string, source_rank long, n long, first long, cycle long")
    for group in (3, 100):
        ends = {r["source"]: r["ends"] for r in mixing.quotas(sources, 6, 5, group).collect()}
        assert {s: e[-1] for s, e in ends.items()} == {r[0]: r[2] for r in rows}
        sizes = np.diff(np.concatenate([[0], np.sum(list(ends.values()), axis=0)]))
        assert np.ptp(sizes) <= 1


def test_quotas_are_exact():
    quotas = mixing.split([1000, 0, 37, 5], mixing.even(1042, 7))
    assert quotas.sum(0).tolist() == [1000, 0, 37, 5] and np.ptp(quotas.sum(1)) <= 1
    rng = np.random.default_rng(0)
    draws = [mixing.hypergeometric(rng, 40, 60, 25) for _ in range(4000)]
    assert np.mean(draws) == pytest.approx(10, abs=0.15) and np.var(draws) == pytest.approx(25 * 0.4 * 0.6 * 75 / 99, rel=0.1)
    assert abs(mixing.hypergeometric(rng, 4 * 10**9, 6 * 10**9, 5 * 10**9) - 2 * 10**9) < 10**6


def test_shards(spark, edges):
    for docs in (edges, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sharding.shard(docs.select("doc_id", "text"), 5).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r)
            assert r["size"] == len((r["text"] or "").encode()) + 16
        assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
        sizes, widest = [sum(r["size"] for r in own) for own in by.values()], max(r["size"] for r in rows)
        assert set(by) <= set(range(5)) and (docs is edges or max(sizes) - min(sizes) <= 2 * widest)
        together = defaultdict(set)
        for r in rows:
            together[r["text"] or ""].add((r["shard"], r["group_split"]))
        weight = Counter()
        for r in rows:
            weight[r["text"] or ""] += r["size"]
        assert all(len({s for s, _ in own}) == 1 or weight[t] > 0.25 * sum(sizes) / 5 and all(split for _, split in own) for t, own in together.items())


def test_a_hot_text_is_split(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('same ', 20) else concat('text ', id, repeat('x', id % 90)) end as text")
    sizes = [r["s"] for r in sharding.shard(docs, 8).groupBy("shard").sum("size").withColumnRenamed("sum(size)", "s").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8


def auc(score, y) -> float:
    score, y = np.asarray(score, float), np.asarray(y)
    a, b = score[y == 1], score[y == 0]
    return float((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.85), (quality, "quality", 0.97)])
def test_classifiers_on_held_out_documents(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score(docs, labels).join(labels, "doc_id").selectExpr("score", f"{label} as y", "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 as held_out").where("y is not null").collect()
    held = [(r["score"], r["y"]) for r in rows if r["held_out"]]
    assert all(0 <= s <= 1 for s, _ in held) and auc(*zip(*held)) >= least


def test_windows_cover_all_words():
    for n in range(0, 40):
        tokens = [b"%d" % i for i in range(n)]
        assert set(b" ".join(toxicity.windows(tokens)).split()) == set(tokens)


def test_network_gradients():
    rng = np.random.default_rng(0)
    texts = [rng.integers(32, 127, n).astype(np.uint8) for n in (700, 0, 40)]
    net, y, w = quality.Net(), np.array([1, 0, 1]), np.ones(3)
    for k in ("mean", "most"):
        net.p[k] = rng.normal(0, 1, quality.FILTERS)
    g = net.gradients(net.ready().forward(texts), y, w)
    loss = lambda: float(np.mean(np.logaddexp(0, -(2 * y - 1) * net.ready().forward(texts)["logit"])))
    for name in net.p:
        at = np.unravel_index(int(np.argmax(np.abs(g[name]))), g[name].shape)
        before, step = net.p[name][at], 1e-3
        net.p[name][at] = before + step
        up = loss()
        net.p[name][at] = before - step
        down = loss()
        net.p[name][at] = before
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def test_language_model(edges, edge_rows):
    docs = [[*spaced((r[1] or "").translate(ASCII)), "</s>"] for r in edge_rows]
    pairs = Counter((a, b) for d in docs for a, b in zip(["<s>", *d], d))
    count, before, total, kinds = Counter(w for d in docs for w in d), Counter(b for _, b in pairs), Counter(), defaultdict(list)
    for (a, _), n in pairs.items():
        total[a] += n
        kinds[a].append(n)
    cut = lambda values: [0, *kneser_ney.Model._discounts(*(sum(v == k for v in values) for k in (1, 2, 3, 4)))]
    d2, d1 = cut(pairs.values()), cut(before.values())
    spare = sum(d1[min(n, 3)] for n in before.values()) / len(pairs) / (len(count) + 1)
    p1 = lambda w: max(before[w] - d1[min(before[w], 3)], 0) / len(pairs) + spare
    p2 = lambda a, w: max(pairs[a, w] - d2[min(pairs[a, w], 3)], 0) / total[a] + sum(d2[min(n, 3)] for n in kinds[a]) / total[a] * p1(w)
    want = sorted((len(d), round(sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *d], d)), 5), round(sum(math.log10((count[w] + 1) / (sum(count.values()) + len(count) + 1)) for w in d), 5)) for d in docs)
    model = kneser_ney.train(edges)
    got = kneser_ney.score(edges, model).collect()
    assert model.tokens == sum(count.values()) and model.vocabulary == len(count)
    for a, b in zip(sorted((r["n_tokens"], r["score"], r["base_score"]) for r in got), want):
        assert a == pytest.approx(b, abs=1e-4)
    assert sum(p2("</s>" if not total["one"] else "one", w) for w in count) + p2("one", "?") == pytest.approx(1)


def simhash(text: str | None) -> int:
    w = spaced((text or "").translate(ASCII))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints: list[int], radius: int) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(prints))]


def alike(texts: list[str | None], least: float = 0.8) -> list[int]:
    """Roots of texts joined by chains of a Jaccard similarity of `least` of their sets of five words, over all pairs."""
    words = [spaced((t or "").translate(ASCII)) for t in texts]
    own = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if root[i] != root[j] and len(own[i] & own[j]) >= least * len(own[i] | own[j]):
            root = [root[i] if r == root[j] else r for r in root]
    return root


def test_near_duplicates(edges, edge_rows):
    found = near_dups.near_duplicates(edges).collect()
    prints = {(r[0], r[1]): simhash(r[1]) for r in edge_rows}
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in found) == Counter((r[0], prints[r[0], r[1]]) for r in edge_rows)
    values = [prints[r[0], r[1]] for r in edge_rows]
    first = defaultdict(list)
    for r, c in zip(edge_rows, linked(values, 4)):
        first[c] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], min(first[c], default=None)) for r, c in zip(edge_rows, linked(values, 4)))
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == want


def test_chains_of_links(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for start in range(8):  # chains that reach far beyond the radius
        x = values[start]
        for _ in range(40):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            values.append(x)
    rows = [(1000 - i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    found = {r["doc_id"]: r["component_id"] for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    first = {}
    for (i, _), c in zip(rows, linked(values, 4)):
        first[c] = min(first.get(c, i), i)
    assert found == {i: first[c] for (i, _), c in zip(rows, linked(values, 4))}


def test_tree_search_is_exact():
    rng = random.Random(5)
    values = list({rng.getrandbits(64) ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for _ in range(300)})
    tree = near_dups.BKTree(values)
    for gone in range(0, 300, 7):
        tree.remove(gone)
    for v in values[:50]:
        assert sorted(tree.near(v, 24)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 24 and i % 7]


def test_one_of_each_class_stays(edges):
    kept = [r["doc_id"] for r in similar.keep_one(edges).collect()]
    assert {1, 3, 9}.issubset(kept) and not {2, 10} & set(kept)


def leaves_in_order(text: str) -> list[str]:
    return [piece for line in text.split("\n") for piece in [*merkle.PIECES.findall(line), "\n"]][:-1]


def test_merkle(edges, edge_rows, spark):
    from pyspark.sql import functions as F

    keys = {r["text"]: r["k"] for r in edges.select("text", F.xxhash64("text").alias("k")).collect()}
    rows = sorted(edge_rows, key=lambda r: (r[0] is None, r[0] or 0, keys[r[1]]))
    texts = [r[1] or "" for r in rows]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
    found = merkle.fingerprints(edges).collect()
    near = lambda a, b: round(merkle.compared(merkle.Tree(a), merkle.Tree(b))[0], 9)
    want = Counter((r[0], len(t), sha256(e.encode()).hexdigest(), near(t, e), near(t, n)) for r, t, e, n in zip(rows, texts, edited, after))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found) == want
    for r in found:
        assert r["near_edited"] == pytest.approx(merkle.likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert [tuple(s) for s in r["edited_spans"]] == merkle.edits(r["fingerprint"], r["edited_fingerprint"])
    prints = {t: merkle.Tree(t).fingerprint for t in texts}
    assert len(set(prints.values())) == len(set(texts)) and {r["fingerprint"] for r in found} == set(prints.values())


def test_likeness_against_a_comparison_of_all_leaves():
    rng = random.Random(8)
    for k in range(60):
        lines = [prose(700 + k * 40 + i, rng.randint(0, 30)) + "." * rng.randint(0, 1) for i in range(rng.randint(1, 30))]
        a = "\n".join(lines)
        for _ in range(rng.randint(0, 4)):
            lines[rng.randrange(len(lines))] = prose(9000 + rng.randrange(999), 12) + "."
        b = "\n".join(lines)
        (near, spans), x, y = merkle.compared(merkle.Tree(a), merkle.Tree(b)), Counter(leaves_in_order(a)), Counter(leaves_in_order(b))
        flat = 2 * sum(len(p) * min(n, y[p]) for p, n in x.items()) / max(1, len(a) + len(b))
        assert a == b or near == pytest.approx(flat, abs=0.05)
        gone = {i for s, e in spans for i in range(s, e)}
        at = 0
        for p in leaves_in_order(a):  # what the other text has nowhere lies in a span
            assert p == "\n" or y[p] or set(range(at, at + len(p))) <= gone
            at += len(p)


def test_neighbours_with_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ALIKE", 5)
    rows = [(None, f"none {k}.") for k in range(40)] + [(7, f"seven {k}.") for k in range(40)] + [(k, f"own {k}.") for k in range(20)] + [(None, "alike.")] * 9 + [(3, None)] * 8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    from pyspark.sql import functions as F

    keys = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).distinct().collect()}
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, keys[r[1]]))
    texts = [t or "" for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in merkle.fingerprints(docs).collect())
    assert got == Counter((r[0], len(t), sha256(e.encode()).hexdigest()) for r, t, e in zip(rows, texts, edited))


def test_branches_locate_an_edit():
    text = "\n".join(prose(k, 30) + "." for k in range(40))
    at = len(text) // 2
    changed = text[:at] + "CHANGED HERE" + text[at + 12 :]
    a, b = merkle.Tree(text).fingerprint, merkle.Tree(changed).fingerprint
    spans = merkle.edits(b, a)
    assert merkle.edits(a, a) == [] and spans and all(at - 300 < s < e < at + 300 for s, e in spans) and merkle.likeness(a, b) > 0.9


def removed(texts: list[str | None], window: int) -> list[list[str]]:
    docs = [spaced(t) for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = {p for i in range(len(d) - window + 1) if seen[tuple(d[i : i + window])] > 1 for p in range(i, i + window)}
        out.append([w for p, w in enumerate(d) if p not in gone])
    return out


def test_passages(spark, edges, edge_rows):
    found = passages.remove_passages(edges).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in found) == Counter((e[0], " ".join(k)) for e, k in zip(edge_rows, removed([e[1] for e in edge_rows], 35)))
    shared = prose(77, 80).split()
    rng, texts = random.Random(9), []
    for k in range(40):  # passages of any length about the window's, at any shift, and repeats within a text
        n = rng.randint(30, 45)
        a = rng.randint(0, 35)
        texts.append(" ".join(prose(100 + k, rng.randint(0, 60)).split() + shared[a : a + n] + prose(200 + k, rng.randint(0, 60)).split() + (shared[:36] if k % 9 == 0 else [])))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"].split() for r in passages.remove_passages(docs).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 35)
    assert {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER} == set(range(passages.PERIOD))


def hit_by(words: list[str], spans: dict[int, set]) -> bool:
    return any(tuple(words[p : p + n]) in own for n, own in spans.items() for p in range(len(words) - n + 1))


def test_pipeline(spark):
    """Each stage, on what the one before it kept, against brute force."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    spans = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = alnum(r["text"])
        for s in range(max(1, len(w) - 9) if w else 0):
            spans[min(10, len(w))].add(tuple(w[s : s + 10]))

    def toxicity_stage(rows):
        score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
        ordinary = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
        kept = {i for i, s in score.items() if s < 0.7}
        assert len(kept & ordinary) >= 0.98 * len(ordinary & set(score))
        return Counter(kept)

    def near_duplicates_stage(rows):
        first: dict[int, int] = {}
        for r, c in zip(rows, alike([r["text"] for r in rows])):
            first[c] = min(first.get(c, r["doc_id"]), r["doc_id"])
        return Counter(first.values())

    def decontamination_stage(rows):
        return Counter(r["doc_id"] for r in rows if not hit_by(alnum(r["text"]), spans))

    def mixing_stage(rows):
        size, sums, taken = {r["doc_id"]: len(spaced(r["text"])) for r in rows}, defaultdict(int), defaultdict(int)
        for r in rows:
            sums[r["source"]] += size[r["doc_id"]]
            taken[r["source"]] += size[r["doc_id"]] * got[r["doc_id"]]
        want, widest = water_level(sums), {s: max(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sums}
        assert all(abs(taken[s] - want[s]) <= widest[s] for s in sums) and max(got.values()) <= 2 and set(got) <= set(size)
        return got

    def sharding_stage(rows):
        by = defaultdict(list)
        for r in out.collect():
            by[r["shard"]].append(r["slot"])
            assert r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and 0 <= r["shard"] < 40
        assert all(sorted(own) == list(range(len(own))) for own in by.values())
        return Counter(r["doc_id"] for r in rows)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    wanted = {"toxicity": toxicity_stage, "near_duplicates": near_duplicates_stage, "decontamination": decontamination_stage, "mixing": mixing_stage, "sharding": sharding_stage}
    assert [name for name, _ in corpus_pipeline.STAGES] == list(wanted)
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}"
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "sharding":
            assert {"size", "text_crc32", "shard", "slot"} <= set(out.columns)
        else:
            assert out.columns == columns
        got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        assert got == wanted[name](docs.collect())
        docs = out
    assert sum(got.values()) > 100
