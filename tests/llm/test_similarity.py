"""N-gram Jaccard join, components and decontamination against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyline.llm import decontam, graph, ngram_join, words
from keyline.llm.storage import Scratch

BLANKS = "[\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=5):
    w = [x for x in re.split(BLANKS, (text or "").translate(LOWER)) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute_components(rows):
    """{id: (n, component, class)} by comparing every pair of distinct sets."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    first: dict = {}
    for i, s in sets:
        if s:
            first[s] = min(i, first.get(s, i))
    distinct = list(first)
    parent = {first[s]: first[s] for s in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            p, q = distinct[a], distinct[b]
            both = len(p & q)
            if 100 * both >= 75 * (len(p) + len(q) - both):
                x, y = sorted((find(first[p]), find(first[q])))
                parent[y] = x
    return {i: (len(s), find(first[s]), first[s]) if s else (0, i, i) for i, s in sets}


def edited(rng, base, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in base]


VOCABULARY = [f"w{i}" for i in range(4000)]


def corpus(seed):
    rng = random.Random(seed)
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    texts = []
    for group in range(6):  # near copies with all degrees of edits
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([12, 60, 130, 300]))]
        texts += [" ".join(edited(rng, base, rng.random() * 0.08)) for _ in range(rng.choice([3, 30]))]
    for _ in range(60):  # one passage in many documents
        own = [rng.choice(VOCABULARY) for _ in range(rng.randrange(5, 150))]
        texts.append(" ".join(own + passage))
    for _ in range(40):
        texts.append(" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 9))))
    texts += [rng.choice(texts) for _ in range(40)] + ["", None, "  \n", "One", "one", "ONE two\tthree", "a b c d e", "a b c d e a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "crowd"), [(1, 16), (1, 2), (2, 3)])
def test_components_equal_brute_force(spark, seed, crowd):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["class_id"]) for r in ngram_join.jaccard_components(df, crowd=crowd).collect()}
    assert got == brute_components(rows)


def test_join_edge_cases(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node long, sig string")
    assert ngram_join.jaccard_components(df).collect() == []
    rows = [(3, "a b c d e f", 1, "x"), (3, "a b c d e f", 1, "x"), (1, None, None, None), (2, "A b c d e F", 2, "y")]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, df.schema)).collect()
    assert sorted(tuple(r) for r in out) == [(1, 0, 1, 1), (2, 2, 2, 2), (3, 2, 2, 2), (3, 2, 2, 2)]


def test_repeated_and_missing_keys(spark):
    """Rows are told apart by their texts, not their keys."""
    rng = random.Random(8)
    base = [[rng.choice(VOCABULARY) for _ in range(80)] for _ in range(3)]
    near = lambda b: " ".join(b[:-1] + ["changed"])
    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (7, near(base[0])), (9, near(base[1])), (None, " ".join(base[0]))]
    rows += [(None, " ".join(base[2])), (11, near(base[2])), (None, None), (None, "alone here"), (12, "")]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r["doc_id"], r["component_id"], r["class_id"]) for r in out), key=str)
    want = [(5, 5, 5), (5, 5, 5), (7, 5, 7), (9, 5, 9), (None, 5, 5), (None, 11, None), (11, 11, 11), (None, None, None), (None, None, None), (12, 12, 12)]
    assert got == sorted(want, key=str)


def test_one_hot_group_and_names_in_use(spark):
    """Hundreds of different near copies and a shared line; input columns named like outputs."""
    rng = random.Random(3)
    base = [rng.choice(VOCABULARY) for _ in range(200)]
    texts = [" ".join(edited(rng, base, 0.002 + 0.02 * rng.random())) for _ in range(250)]
    texts += [" ".join(base[:40] + [rng.choice(VOCABULARY) for _ in range(rng.randrange(10, 60))]) for _ in range(120)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "component_id long, text string, key long, id long, hi string")
    out = ngram_join.jaccard_components(df.withColumnRenamed("component_id", "doc_id"), crowd=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["class_id"]) for r in out} == brute_components(rows)


def test_bounds_of_signatures():
    """Linked sets share as many signatures as promised, and few sets are thin;
    sketches never overstate the difference."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 31, 48, 63, 64, 65, 96, 127, 200, 255, 256, 384, 1000):
        for _ in range(20):
            base = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
            kept = base[rng.permutation(size)[: size - rng.integers(0, size // 7 + 1)]]
            added = rng.integers(0, 2**63, rng.integers(0, max(size // 7, 1) + 1), dtype=np.uint64)
            p, q = np.sort(base), np.unique(np.concatenate([kept, added]))
            both = len(np.intersect1d(p, q))
            sketch = lambda x: np.unpackbits(np.frombuffer(ngram_join._parity(x, 512), np.uint8))
            assert (sketch(p) != sketch(q)).sum() <= len(p) + len(q) - 2 * both
            if 100 * both < 75 * (len(p) + len(q) - both):
                continue
            band = max(int(ngram_join.sides(np.array([len(x)]))[0][0]) for x in (p, q))
            found = []
            for x in (p, q):
                own, upper = ngram_join.sides(np.array([len(x)]))
                assert own[0] == band or (upper[0] and own[0] + 1 == band)
                sig, _ = ngram_join.signatures(x, np.array([0, len(x)]), np.array([band]), extra=False)
                assert len(sig) > ngram_join.spoiled(np.array([len(x)]), np.array([band]))[0]  # not thin
                found.append(set(sig.tolist()))
            k = (len(p) + len(q)) // 7
            promised = max(map(len, found)) - k - min(k, int(ngram_join.GROUPS[band]))
            assert len(found[0] & found[1]) >= max(promised, 1)


def test_thin_sets_meet():
    """Sets whose features fall into one partition share the extra signature of their band."""
    features = np.sort(np.arange(8, dtype=np.uint64))
    for x in (features, features[:7]):
        sig, _ = ngram_join.signatures(x, np.array([0, len(x)]), np.array([4]))
        assert len(sig) == 3
    shared = [set(ngram_join.signatures(x, np.array([0, len(x)]), np.array([4]))[0].tolist()) for x in (features, features[:7])]
    assert len(shared[0] & shared[1]) == 1


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for values in ([0], [5, 5, 9], [2**64 - 1], rng.integers(0, 2**64, 1000, dtype=np.uint64)):
        values = np.sort(np.array(values, np.uint64))
        assert (ngram_join._unpack(ngram_join._pack(values)) == values).all()


def test_shingles_of_words():
    texts = ["A b  c\td e f", None, "x", "", "é É", "a b c d e f a b c d e f", "w " * 5000]
    got, starts = words.shingles(pa.array(texts), 5)
    assert np.diff(starts).tolist() == [len(shingle_set(t)) for t in texts]
    same, where = words.shingles(pa.array(["q", "a b c d e f"]).slice(1), 5)
    assert set(same.tolist()) == set(got[:2].tolist()) and where.tolist() == [0, 2]


def test_components_of_a_graph(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in graph.components(df, Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(df.limit(0), Scratch(spark, "t")).collect() == []


# --- decontamination ---------------------------------------------------------------------


def brute_tiling(p, t, tile):
    """Plain greedy string tiling: always the longest unmarked match, first by places."""
    mp, mt, found = [False] * len(p), [False] * len(t), []
    while True:
        best = (tile - 1, 0, 0)
        for a in range(len(p)):
            for b in range(len(t)):
                n = 0
                while a + n < len(p) and b + n < len(t) and p[a + n] == t[b + n] and not mp[a + n] and not mt[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < tile:
            return found
        n, a, b = best
        for i in range(n):
            mp[a + i] = mt[b + i] = True
        found.append((a, b, n))


def test_tiling_against_brute_force():
    rng = np.random.default_rng(9)
    for round_ in range(300):
        p, t = (rng.integers(0, 3 + round_ % 3, rng.integers(0, 45)).astype(np.uint64) for _ in range(2))
        tiles = decontam.tile_matches(p, t, 3)
        for seq, k in ((p, 0), (t, 1)):
            used = [i for m in tiles for i in range(m[k], m[k] + m[2])]
            assert len(used) == len(set(used)) and all(i < len(seq) for i in used)
        assert all((p[a : a + n] == t[b : b + n]).all() for a, b, n in tiles)
        assert sorted(tiles) == sorted(brute_tiling(p.tolist(), t.tolist(), 3))
        left_p = np.ones(len(p), bool)
        left_t = np.ones(len(t), bool)
        for a, b, n in tiles:
            left_p[a : a + n] = left_t[b : b + n] = False
        assert not decontam._windows(p, t, ~left_p, ~left_t, 3)  # nothing of three tokens is left


def test_leaks(spark):
    rng = random.Random(2)
    word = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = {i: word(rng.randrange(20, 60)) for i in range(30)}
    items[30] = ["tiny", "item"]
    docs, want = [], set()
    for i in range(200):
        body = word(rng.randrange(0, 400))
        if i % 4 == 0:
            item = i % 30
            passage = list(items[item])
            if i % 8 == 0:  # reordered halves
                half = len(passage) // 2
                passage = [*passage[half:], *word(3), *passage[:half]]
            body[len(body) // 2 : len(body) // 2] = passage
            want.add((i, item))
        docs.append((i, " ".join(body)))
    docs += [(900, " ".join(w.upper() + "!!" for w in items[3])), (901, None), (902, ""), (903, " ".join(items[5][: len(items[5]) // 3])), (904, "a Tiny, item"), (905, "item tiny")]
    want |= {(900, 3), (904, 30)}
    docs += [docs[0], docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (31, None), (32, ""), (33, "...")], "item_id long, text string")
    for block_bytes in (1 << 20, 2000):
        rows = decontam.find_leaks(df, bench, block_bytes=block_bytes).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want
        assert sum(r["doc_id"] == 0 for r in rows) == 3 and all(0.5 <= r["coverage"] <= 1 for r in rows)
    assert decontam.find_leaks(df.limit(0), bench).collect() == []
    assert decontam.find_leaks(df, bench.limit(0)).collect() == []
    assert decontam.find_leaks(df.withColumn("item_id", F.lit(1)), bench.withColumn("doc_id", F.lit(1))).count() == len(rows)


def brute_leaks(docs, items, tile=5, threshold=0.5):
    """Every document against every item: plain tiling over Unicode words."""
    alone = re.compile(r"[\u4e00-\u9fff\u3041-\u30ff\u0e01-\u0e3a]|[^\W_\u4e00-\u9fff\u3041-\u30ff\u0e01-\u0e3a]+")
    words_of = lambda t: alone.findall((t or "").lower())
    out = []
    for d, text in docs:
        t = words_of(text)
        for i, item in items:
            p = words_of(item)
            found = brute_tiling(p, t, min(tile, len(p))) if p else []
            covered = sum(n for _, _, n in found)
            if p and covered and covered >= threshold * len(p):
                out.append((d, i, len(p), covered, len(found), max(n for _, _, n in found)))
    return out


def test_leaks_equal_brute_force(spark):
    """The whole operator, with quotes and dashes, Chinese, shared openings, null ids and repeated rows."""
    rng = random.Random(12)
    opening = [rng.choice(VOCABULARY) for _ in range(14)]
    items = [(i, " ".join((opening if i % 3 else []) + [rng.choice(VOCABULARY) for _ in range(rng.randrange(6, 20))])) for i in range(24)]
    items += [(None, "“one two—three four” five six"), (-1, "quoted ‘words’ of four"), (100, "机器学习是人工智能的一个分支它研究算法"), (101, "été d’hiver, l’œuvre"), (102, ""), (None, None), (103, "...")]
    docs = []
    for i in range(60):
        body = [rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 40))]
        part = (rng.choice(items[:24])[1]).split()
        cut = rng.randrange(len(part))
        body[len(body) // 2 : len(body) // 2] = [*part[cut:], "x", *part[: rng.randrange(cut, len(part) + 1)]]
        docs.append((i, " ".join(body)))
    docs += [(200, "He said: one – two, three… four; «five» six!"), (201, "quoted words of four"), (201, "quoted words of four"), (202, "我们认为机器学习是人工智能的一个分支,它研究算法。"),
             (None, "ÉTÉ d'hiver l'œuvre"), (204, " ".join(opening)), (205, None), (206, "")]
    df = spark.createDataFrame([(*d, 1, "a") for d in docs], "doc_id long, text string, item_id int, key string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    for block in (1 << 20, 900):
        got = decontam.find_leaks(df, bench, block_bytes=block).select("doc_id", *decontam.MATCH).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        kept = decontam.drop_leaks(df, bench, block_bytes=block)
        leaked = {d for d, *_ in want}
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in leaked), key=str)


def test_seeds_that_many_items_share(spark, monkeypatch):
    """What is held is bounded, and the result does not depend on the bound."""
    rng = random.Random(4)
    opening = [f"o{i}" for i in range(30)]
    texts = [" ".join(opening + [f"i{i}w{j}" for j in range(rng.choice([4, 60]))]) for i in range(300)]
    index = decontam.Index(list(range(300)), texts, 5)
    hashes, start = decontam.tokens(pa.array([" ".join(opening), "none of it", " ".join(opening * 2), texts[7]]))
    want = sorted(decontam._candidates(index, hashes, start, 0.5))
    assert len(want) > 100
    for held in (1, 100, 5000):
        monkeypatch.setattr(decontam, "HELD", held)
        assert sorted(decontam._candidates(index, hashes, start, 0.5)) == want


def test_one_row_of_each_component(spark):
    rng = random.Random(3)
    base = [[rng.choice(VOCABULARY) for _ in range(60)] for _ in range(4)]
    near = lambda b: " ".join([*b[:-1], "changed"])
    text = lambda b: " ".join(b)
    rows = [(5, text(base[0]), "s"), (5, text(base[1]), "s"), (7, near(base[0]), "s"), (9, near(base[1]), "s"), (5, text(base[0]), "a"), (None, text(base[2]), "s"),
            (3, near(base[2]), "s"), (None, text(base[3]), "s"), (None, near(base[3]), "s"), (None, None, "s"), (None, None, "s"), (8, "", "s"), (8, "alone", "s")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, hi int").repartition(3)
    out = ngram_join.drop_linked(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    alone = [k for k in got if k[0] is None and k[1] in (text(base[3]), near(base[3]))]
    assert len(alone) == 1
    want = Counter([(5, text(base[0]), "a"), (5, text(base[1]), "s"), (3, near(base[2]), "s"), alone[0], (None, None, "s"), (None, None, "s"), (8, "", "s"), (8, "alone", "s")])
    assert got == want
