"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfall.llm import negatives as M
from inkfall.llm.negatives import Ball, Negatives, Positives, hard_negatives, leaf_pairs, meet, products, whole_parts

SCHEMA = "vec_id long, label int, anchor boolean, vec array<double>, row int, cell string, part int, block int"


def by_hand(rows, positives=5, negatives=3, low=50, high=95):
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    late = lambda i: (i is None, i or 0)
    out = []
    for at, (aid, label, anchor, v) in enumerate(rows):
        if not anchor or aid is None:
            continue
        scored = [(-dot(v, w), late(i), lab == label) for k, (i, lab, _, w) in enumerate(rows) if k != at]
        for ps, (none, pid), _ in sorted(s for s in scored if s[2])[:positives]:
            fit = sorted(s for s in scored if not s[2] and low * -ps <= 100 * -s[0] <= high * -ps)[:negatives]
            out += [(aid, None if none else pid, k + 1, None if i[0] else i[1], -ps, -s) for k, (s, i, _) in enumerate(fit)]
    return sorted(map(str, out))


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3)
    return sorted(str(tuple(r)) for r in hard_negatives(df, **how).collect())


def vectors(kind, n, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "random":
        return rng.integers(-40, 40, (n, 6)).astype(float)
    if kind == "ties":
        return rng.integers(0, 2, (n, 3)).astype(float)
    if kind == "clusters":
        centers = rng.integers(-900, 900, (6, 8))
        return (centers[rng.integers(0, 6, n)] + rng.integers(-3, 4, (n, 8))).astype(float)
    if kind == "copies":
        return np.where(rng.random((n, 1)) < 0.4, np.full((1, 5), 7.0), rng.integers(-9, 30, (n, 5)).astype(float))
    return np.floor(rng.normal(size=(n, 4)) * 2.0**29)  # scores beyond 2**53


@pytest.mark.parametrize("kind", ["random", "ties", "clusters", "copies", "large"])
def test_by_hand(spark, kind, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 90)
    monkeypatch.setattr(M, "GROUP", 7)
    monkeypatch.setattr(M, "SENT", 8 * 8 * 7 * 2)
    x = vectors(kind, 300)
    rows = [(i if i % 41 else 7, i % 4, i % 9 == 0, x[i].tolist()) for i in range(len(x))]
    assert run(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(20)]), rng.randrange(3), rng.random() < 0.4, [float(rng.randrange(-5, 9)) for _ in range(rng.randrange(5))]) for _ in range(70)]
    assert run(spark, rows, positives=3, negatives=2, low=30, high=100) == by_hand(rows, 3, 2, 30, 100)


@pytest.mark.parametrize("rows", [[], [(1, 0, False, [1.0])], [(0, 0, True, [3.0])], [(0, 0, True, [3.0]), (1, 0, False, [2.0])]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == by_hand(rows) == []


def test_whole_parts(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("inf"), 1.0],), ([1.0, None],), (None,), ([],), ([1e300],)], "v array<double>")
    assert [r[0] for r in df.select(whole_parts(F.col("v"))).collect()] == [[128.0, -1.0], None, None, None, None, [], [256e300]]


def made(x, labels, **more):
    return M.opened(x, np.arange(len(x)), np.arange(len(x)), labels, **more)


def test_intervals_hold_and_prune():
    x = vectors("clusters", 2000, 3)
    labels = np.arange(len(x)) % 5
    block, group = made(x, labels), made(x[:400], labels[:400], floors=[None] * 400)
    a, b, seen = group["tree"], block["tree"], []

    def keep(i, j, low, high):
        seen.extend(zip(i.tolist(), j.tolist(), low, high))
        return np.ones(len(i), bool)

    leaf_pairs(a, b, keep)
    for i, j, low, high in seen:
        s = products(a.x[slice(*a.spans[i])], b.x[slice(*b.spans[j])], a.most * b.most)
        assert low <= s.min() and s.max() <= high
    counts = [0, 0]
    search = Positives(group, 5)
    meet(search, block)
    again = Positives(group | {"floors": [int(f) for f in search.best.floor]}, 5)
    meet(again, block, counts)
    assert counts[0] < 0.4 * counts[1], "most pairs of clusters are left without scoring"
    assert [list(v) for v in again.found()] == [list(v) for v in search.found()]
    counts = [0, 0]
    meet(Negatives(group | {"bands": [[[0], [10**7], [10**8]]] * 400}, 3), block, counts)
    assert counts[0] == 0, "no score reaches the band"


def test_leaves_cover_all_rows():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 129, 1000, 4097):
        tree = Ball(rng.integers(0, 9, (n, 3)).astype(float), np.zeros(n, np.int64))
        leaves = sorted(s for s, k in zip(tree.spans, tree.left) if k < 0)
        assert leaves[0][0] == 0 and leaves[-1][1] == n and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
        assert all(b - a <= M.LEAF for a, b in leaves)
    copies = Ball(np.ones((500, 2)), np.zeros(500, np.int64))
    assert copies.spans == [(0, 500)] and copies.radius[0] == 0


def test_parts_of_cells():
    first, ways, n = M.dealt({0: 3, 1: 250, 3: 40, 4: 40, 5: 40}, 100)
    assert ways == [1, 3, 1, 1, 1, 1] and first[1] == 1 and first[3] == first[4] == 4 and first[5] == 5 and n == 6
    assert M.dealt({}, 10) == ([0], [1], 0)
