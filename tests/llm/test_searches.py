"""Ranked search and hard negatives against brute force, with nulls, ties, repeats, hot rows and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import ball_search, hard_negatives, queries
from tablewarden.llm.ball_search import Tree, rank_documents
from tablewarden.llm.hard_negatives import combined, mine, primes_for, product_mod, residues

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, all_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        got = []
        for ident, c, n in held:
            m = 25 + 75 * n * n_docs // all_terms if all_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                got.append((-s, ident is None, ident))
        got.sort(key=lambda g: (g[0], g[1], g[2] or 0))
        out += [(item, r + 1, g[2], -g[0]) for r, g in enumerate(got[:k])]
    return sorted(out, key=repr)


def some_documents():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(400)]
    docs += [(1000 + i, "Hot w1 w2, w3! É w1") for i in range(300)]                     # a hot group of copies: ties by id
    docs += [(7, "w5 w5 w6"), (7, "w5 w5 w6"), (None, "w7 rare"), (None, None), (8, None), (9, ""), (10, "?! -"), (11, "w1 " * 30_000 + "rare É")]
    return docs


ITEMS = [(0, "W1 w2 w2 hot"), (1, "é rare, w7"), (2, "unseen words only"), (3, None), (4, ""), (5, "w5 w6"), (5, "w9"), (None, "w3 w4")]


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_ranked_search_is_exact(spark, monkeypatch, block):
    queries.table(spark, SF, "region")
    monkeypatch.setattr(ball_search, "BLOCK_CELLS", block)     # the small one makes a block of nearly every item
    docs = some_documents()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string").repartition(3)
    items = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, doc_id int")
    assert sorted((tuple(r) for r in rank_documents(frame, items).collect()), key=repr) == ranked(docs, ITEMS)


@pytest.mark.parametrize("which", ["documents", "items", "both"])
def test_ranked_search_of_empty_tables(spark, which):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rank_documents(docs.limit(0) if which != "items" else docs, items.limit(0) if which != "documents" else items).count() == 0


def test_bounds_of_the_tree_hold_and_prune():
    rng = np.random.default_rng(1)
    width, rows = 200, 1500
    centres = rng.integers(0, width, (30, 12))
    index = [np.unique(np.r_[centres[r % 30], rng.integers(0, width, 2)]) for r in range(rows)]
    value = [np.where(np.isin(i, centres[r % 30]), rng.integers(900_000, 1_000_000, len(i)), rng.integers(1, 50_000, len(i))) for r, i in enumerate(index)]
    tree = Tree(np.r_[0, np.cumsum([len(i) for i in index])], np.concatenate(index), np.concatenate(value), width)
    dense = np.zeros((rows, width), np.int64)
    for r in range(rows):
        dense[r, index[r]] = value[r]
    queries_ = np.zeros((5, width), np.int64)
    for q in range(5):
        queries_[q, centres[q]] = rng.integers(1, 20_000, 12)
    bound = tree.bounds(queries_.astype(float))
    for node, own in enumerate(tree.rows):
        assert ((dense[own] @ queries_.T).max(0) <= bound[node]).all()
    visited = []
    inner = Tree.entries
    tree.entries = lambda own: (visited.append(len(own)), inner(tree, own))[1]
    for q in range(5):
        visited.clear()
        found, _ = tree.best(queries_[q], bound[:, q], np.arange(rows), [], 0, 10)
        want = sorted((-int(s), i) for i, s in enumerate(dense @ queries_[q]))[:10]
        assert found == want
        assert sum(visited) < rows / 2                          # whole subtrees stay unvisited


def test_residue_products_are_exact():
    rng = np.random.default_rng(2)
    for largest in (3, 300, 1 << 20):
        a, b = rng.integers(-largest, largest + 1, (7, 1500)), rng.integers(-largest, largest + 1, (9, 1500))
        bound = 1500 * largest * largest
        primes = primes_for(bound)
        assert math.prod(primes) > 2 * bound and all(p < 256 and all(p % d for d in range(2, p)) for p in primes)
        parts = [product_mod(residues(a, p), residues(b, p), p) for p in primes]
        assert (combined(parts, primes, bound) == a @ b.T).all()


def negatives_of(rows, k=5):
    fine = [(r, i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for r, (i, v, l) in enumerate(rows)
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, i, l, v in fine:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for s, j, m, w in fine if s != r)
        for p, pid, _ in [x for x in scored if x[2] == l][:k]:
            inside = [(n, nid) for n, nid, m in scored if m != l and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(i, pid, at + 1, nid, -p, -n) for at, (n, nid) in enumerate(inside[:k])]
    return sorted(out)


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def test_hard_negatives_are_exact(spark):
    queries.table(spark, SF, "region")
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, .2) for _ in range(6)], rng.randint(0, 3)) for i in range(1, 500)]
    rows += [(1000 + i, [.5, .5, 0., 0., 0., 0.], i % 3) for i in range(150)]                       # a hot vector: ties
    rows += [(300, [.1] * 6, 1), (300, [.1] * 6, 1), (700, [.2] * 4, 2), (800, [], 2), (900, [0.] * 6, 0),    # repeated anchor, short, empty, zero
             (100, None, 1), (1100, [None] * 6, 1), (1200, [float("nan")] * 6, 1), (1300, [.1] * 6, None), (None, [.1] * 6, 1), (1400, [float("inf")] * 6, 1)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, score string").repartition(4)
    for cells in (1 << 20, 18):
        got = mine(frame, F.col("id") % 100 == 0, label(), block_cells=cells)
        assert sorted(tuple(r) for r in got.collect()) == negatives_of(rows)


def test_hard_negatives_without_rows_and_with_large_components(spark, monkeypatch):
    schema = "vec_id long, embedding array<double>, label int"
    assert mine(spark.createDataFrame([], schema), F.col("id") % 100 == 0, label()).count() == 0
    assert mine(spark.createDataFrame([(3, [1.0], 1)], schema), F.col("id") % 100 == 0, label()).count() == 0
    big = [(100, [1e4, -2e4], 1), (1, [2e4, -1e4], 1), (2, [1.9e4, -1.1e4], 2), (3, [-1e4, 0.0], 3)]
    assert sorted(tuple(r) for r in mine(spark.createDataFrame(big, schema), F.col("id") % 100 == 0, label()).collect()) == negatives_of(big)
    with pytest.raises(ValueError):
        mine(spark.createDataFrame([(100, [1e9], 1)], schema), F.col("id") % 100 == 0, label())
    monkeypatch.setattr(hard_negatives, "CELLS", 4)
    assert sorted(tuple(r) for r in mine(spark.createDataFrame(big, schema), F.col("id") % 100 == 0, label()).collect()) == negatives_of(big)
